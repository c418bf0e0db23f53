"""Heartbeat state: keyed upsert, staleness sweep, locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ixlake import constants as K


def shard_lock_state(heartbeats: DataFrame, order: list[str]) -> DataFrame:
    """One row per (root, node): the first shard count, the latest status and time."""
    arrival = F.struct(*order)
    return heartbeats.groupBy("merkle_root", "node_pubkey").agg(
        F.min_by("shard_count", arrival).alias("shard_count"),
        F.max_by("status", arrival).alias("status"),
        F.max("ts").alias("last_heartbeat"),
    )


def upsert_state(stored: DataFrame, heartbeats: DataFrame, order: list[str]) -> DataFrame:
    """The stored state after later heartbeats: a known (root, node) keeps its shard count and
    takes the new status and time; a new one is added.

    The heartbeats are reduced to one row per key before they meet the stored rows.
    """
    new = shard_lock_state(heartbeats, order).alias("n")
    old = stored.alias("o")
    keys = ["merkle_root", "node_pubkey"]
    same = (F.col("o.merkle_root") == F.col("n.merkle_root")) & (F.col("o.node_pubkey") == F.col("n.node_pubkey"))
    return old.join(new, same, "full").select(
        *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys],
        F.coalesce("o.shard_count", "n.shard_count").alias("shard_count"),
        F.coalesce("n.status", "o.status").alias("status"),
        F.greatest("o.last_heartbeat", "n.last_heartbeat").alias("last_heartbeat"),
    )


def stale_sweep(state: DataFrame, as_of: Column, minutes: int = K.STALE_MINUTES) -> DataFrame:
    """ONLINE rows not heard for longer than ``minutes`` become OFFLINE. No shuffle."""
    limit = as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    stale = (F.col("status") == K.ONLINE) & (F.col("last_heartbeat") < limit)
    return state.withColumn("status", F.when(stale, F.lit(K.OFFLINE)).otherwise(F.col("status")))


def shard_locations(state: DataFrame, merkle_root: str | None = None) -> DataFrame:
    """Nodes holding a root now; of every root when none is named."""
    rows = state.filter(F.col("status") == K.ONLINE)
    if merkle_root is not None:
        rows = rows.filter(F.col("merkle_root") == merkle_root)
    return rows.select("merkle_root", "node_pubkey", "shard_count", "status", "last_heartbeat")
