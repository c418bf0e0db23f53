"""Asset rarity. The score formula is this engine's own choice: the sum of inverse
trait frequencies inside the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rarity_score(assets: DataFrame, traits: str = "traits") -> DataFrame:
    """``assets(mint, collection, traits array<struct<trait,value>>)`` to scores.

    An asset without traits scores 0. Frequencies are aggregated with partial sums; what is
    joined back is one row per (collection, trait, value). A hot collection is left to the
    skew-join split.
    """
    held = assets.select("mint", "collection", F.explode_outer(traits).alias("t")).select(
        "mint", "collection", "t.trait", "t.value"
    )
    counts = (
        held.filter("trait IS NOT NULL")
        .groupBy("collection", "trait", "value")
        .agg(F.count("*").alias("with_value"))
    )
    sizes = assets.groupBy("collection").agg(F.count("*").alias("members"))
    weights = counts.join(sizes, "collection").select(
        "collection", "trait", "value", (F.col("members") / F.col("with_value")).alias("weight")
    )
    return (
        held.join(weights, ["collection", "trait", "value"], "left")
        .groupBy("mint", "collection")
        .agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("rarity_score"))
    )
