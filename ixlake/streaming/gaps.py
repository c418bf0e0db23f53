"""Gap audit on a stream: which slots were seen, as runs that late slots lengthen and join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ixlake import constants as K
from ixlake.operators.monitor import GAP_BUCKET, span_gaps
from ixlake.streaming.ingest import read_if_written, use_rocksdb

RUNS = "bucket bigint, first array<bigint>, last array<bigint>"


def joined_runs(first: np.ndarray, last: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans in any order to runs: spans at most ``threshold`` apart, or overlapping, are one."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    starts = np.ones(len(first), bool)
    starts[1:] = first[1:] - last[:-1] > threshold
    at = np.flatnonzero(starts)
    return first[at], last[np.append(at[1:], len(last)) - 1]


class _Runs(StatefulProcessor):
    """The runs of one bucket of slots: at most bucket / threshold of them, however many rows come."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "first bigint", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = {k[0]: v[0] for k, v in self.runs.iterator()}
        first = np.fromiter(stored.keys(), np.int64, len(stored))
        last = np.fromiter(stored.values(), np.int64, len(stored))
        # Chunks are reduced to runs as they arrive.
        for chunk in rows:
            seen = np.unique(chunk["slot"].to_numpy(np.int64))
            first, last = joined_runs(np.append(first, seen), np.append(last, seen), self.threshold)
        runs = dict(zip(first.tolist(), last.tolist(), strict=True))
        if runs == stored:
            return
        for start in stored.keys() - runs.keys():
            self.runs.removeKey((start,))
        for start, end in runs.items():
            if stored.get(start) != end:
                self.runs.updateValue((start,), (end,))
        yield pd.DataFrame({"bucket": [key[0]], "first": [list(runs)], "last": [list(runs.values())]})

    def close(self) -> None:
        pass


def slot_runs(tx: DataFrame, threshold: int = K.GAP_SLOTS, bucket: int = GAP_BUCKET) -> DataFrame:
    """Stream of the runs of every bucket that changed; a bucket's newest row holds all its runs.

    State is kept by bucket, so buckets are worked on in parallel and none is forgotten: a late slot of any
    age shrinks or closes its gap. Slots of a micro-batch are numbers only; the source's rate limit bounds them.
    """
    use_rocksdb(tx.sparkSession)
    slots = tx.filter("slot IS NOT NULL").select(F.col("slot").cast("bigint").alias("slot"))
    return (
        slots.withColumn("bucket", F.expr(f"slot DIV {int(bucket)}"))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=_Runs(threshold), outputStructType=RUNS, outputMode="Update", timeMode="None"
        )
    )


class GapAudit:
    """``foreachBatch`` sink of :func:`slot_runs`; a retried batch replaces its own directory."""

    def __init__(self, table: str):
        self.table = table

    def __call__(self, runs: DataFrame, batch_id: int) -> None:
        runs.write.mode("overwrite").parquet(f"{self.table}/batch_id={batch_id}")

    def start(self, tx: DataFrame, checkpoint: str, threshold: int = K.GAP_SLOTS, bucket: int = GAP_BUCKET, **trigger) -> StreamingQuery:
        return (
            slot_runs(tx, threshold, bucket)
            .writeStream.foreachBatch(self)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def current_gaps(
    spark: SparkSession, table: str, threshold: int = K.GAP_SLOTS, bucket: int = GAP_BUCKET
) -> DataFrame | None:
    """Gaps (gap_start, gap_end, gap) after all batches so far: what :func:`slot_gaps` finds in the log.

    Reads runs only, never the log. None when nothing was written yet.
    """
    written = read_if_written(spark, table)
    if written is None:
        return None
    newest = written.groupBy("bucket").agg(F.max("batch_id").alias("batch_id"))
    runs = written.join(newest, ["bucket", "batch_id"]).select(F.explode(F.arrays_zip("first", "last")).alias("run"))
    return span_gaps(runs.select("run.first", "run.last"), threshold, bucket)
