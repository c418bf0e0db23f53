"""Gap and lag monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ixlake import constants as K

# Slots per bucket of the gap scan, then buckets per coarser bucket: no group holds more rows
# than this, up to the largest slot there can be.
GAP_BUCKET = 100_000
COARSER = 1_000


def slot_gaps(log: DataFrame, threshold: int = K.GAP_SLOTS, bucket: int = GAP_BUCKET) -> DataFrame:
    """Neighbouring slots more than ``threshold`` apart: (gap_start, gap_end, gap).

    No global sort: neighbours are found inside slot buckets. The pair that spans a bucket's border
    comes from the (first, last) rows of the buckets, whose neighbours are found inside
    coarser buckets in turn.
    """
    slots = log.filter("slot IS NOT NULL").select(F.col("slot").cast("bigint").alias("slot")).distinct()
    return span_gaps(slots.select(F.col("slot").alias("first"), F.col("slot").alias("last")), threshold, bucket)


def span_gaps(spans: DataFrame, threshold: int = K.GAP_SLOTS, bucket: int = GAP_BUCKET) -> DataFrame:
    """The gaps between disjoint spans (first, last) of slots, none of which crosses a bucket's border."""
    found, width = [], bucket
    while True:
        # One group of a few rows at last, keyed so that it needs no plan of its own.
        key = F.expr(f"first DIV {width}") if width < 2**63 else F.expr("first % 1")
        keyed = spans.withColumn("bucket", key)
        inside = Window.partitionBy("bucket").orderBy("first")
        found.append(keyed.select(F.lag("last").over(inside).alias("gap_start"), F.col("first").alias("gap_end")))
        if width >= 2**63:
            break
        spans = keyed.groupBy("bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        width *= COARSER
    gaps = found[0]
    for more in found[1:]:
        gaps = gaps.unionByName(more)
    gap = F.col("gap_end") - F.col("gap_start")
    return gaps.filter(gap > threshold).withColumn("gap", gap)


def cursor_audit(cursor: DataFrame, head: Column, threshold: int = K.GAP_SLOTS) -> DataFrame:
    """One audit step: distance of the cursor to the chain head and the next baseline.

    A zero cursor starts at the head. The baseline only moves up.
    """
    slot = F.col("value").cast("bigint")
    gap = F.when(slot == 0, F.lit(0).cast("bigint")).otherwise(head - slot)
    return cursor.select(
        "key",
        slot.alias("cursor"),
        gap.alias("gap"),
        (gap > threshold).alias("gap_detected"),
        F.when(slot == 0, head).otherwise(slot).alias("baseline"),
    )


def lag_status(last: DataFrame, head: Column) -> DataFrame:
    """``desync`` slots behind the head and its band; ``last`` has ``last_slot``."""
    desync = F.greatest(F.lit(0).cast("bigint"), head - F.col("last_slot"))
    return last.withColumn("desync", desync).withColumn(
        "band",
        F.when(F.col("desync") < K.LAG_OK_BELOW, F.lit("ok"))
        .when(F.col("desync") > K.LAG_CRITICAL_ABOVE, F.lit("critical"))
        .otherwise(F.lit("warn")),
    )
