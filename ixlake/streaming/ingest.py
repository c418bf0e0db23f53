"""Structured Streaming ingest: one feed, many tables.

Every table has one layout, ``run=<run>/batch_id=<n>`` directories of parquet files, whichever
way it is written, so what a live run and a backfill wrote is read together. A batch keeps the
first write of each key in the module's order and leaves out keys that are stored already.

* :func:`start_modules` - one query and checkpoint per module. A module that fails stops
  alone and goes on from its failed batch when it is started again.
* :class:`BatchIngest` - one query, ``foreachBatch``, every module on the same persisted
  micro-batch, then the cursor. When a module fails the others still write; then the
  batch fails, and its rerun replaces what was written.

Runs on one table take turns: each looks up stored keys before it writes. The look-up reads the
key columns only.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ixlake.operators.aggregates import advance_cursor
from ixlake.operators.dedup import insert_ignore, insert_new
from ixlake.operators.extract import Extractor, Registry

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REJECTED = "rejected"
log = logging.getLogger(__name__)

# What reading a table that was never written says; anything else is an error.
_NOT_WRITTEN = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def start_modules(
    tx: DataFrame, registry: Registry, tables: str, checkpoints: str, run: str = "live", **trigger
) -> list[StreamingQuery]:
    """A query per module, each with its own progress."""
    return [
        BatchIngest(Registry().register(module), tables, run, cursor=False).start(
            tx, f"{checkpoints}/{module.id}", name=module.id, **trigger
        )
        for module in registry
    ]


def start_log(heartbeats: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every heartbeat to the event log."""
    return (
        heartbeats.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(table)
    )


def read_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None when nothing was written to it yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() in _NOT_WRITTEN:
            return None
        raise


class BatchIngest:
    """``foreachBatch`` sink: modules, their rejected rows, then the cursor.

    Output of batch ``n`` is the directory ``run=<run>/batch_id=n``. A retried batch
    overwrites it and compares its keys with everything written before it, so retries
    change nothing. A backfill or any new checkpoint takes a run name of its own. Rows that a module
    rejects lie in ``rejected/<module>`` as JSON text with their reason, and what the feed itself
    rejects (``stream_feed``) in ``rejected/feed``.
    """

    def __init__(self, registry: Registry, tables: str, run: str = "live", cursor: bool = True):
        self.registry = registry
        self.tables = tables
        self.run = run
        self.cursor = cursor

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        received = batch
        if "reason" in batch.columns:
            # A feed that judges its input: what it rejects is stored, the rest goes on.
            rejected = batch.filter("reason IS NOT NULL")
            self._reject(rejected.select("feed_partition", "feed_offset", "file", "text", "reason"), "feed", batch_id)
            batch = batch.filter("reason IS NULL").drop("file", "text", "reason")
        failures: list[tuple[str, PySparkException]] = []
        try:
            for module in self.registry:
                try:
                    self._write(module, batch, batch_id)
                except PySparkException as failure:
                    log.error("module %s failed in batch %s: %s", module.id, batch_id, failure)
                    failures.append((module.id, failure))
            if failures:
                # The others have written. The batch isn't done: the cursor and the
                # checkpoint stay before it, so that it runs again.
                raise RuntimeError(f"batch {batch_id}: failed modules {[m for m, _ in failures]}") from failures[0][1]
            if self.cursor:
                self._advance(batch, batch_id)
        finally:
            received.unpersist()

    def _before(self, spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
        """What the table held before this batch first ran."""
        written = read_if_written(spark, path)
        if written is None:
            return None
        return written.filter((F.col("run") != self.run) | (F.col("batch_id") < batch_id))

    def _directory(self, path: str, batch_id: int) -> str:
        return f"{path}/run={self.run}/batch_id={batch_id}"

    def _write(self, module: Extractor, batch: DataFrame, batch_id: int) -> None:
        kept, rejected = module.judged(batch)
        rows = insert_ignore(kept, list(module.keys), list(module.order)).select(*module.columns)
        path = f"{self.tables}/{module.id}"
        written = self._before(batch.sparkSession, path, batch_id)
        if written is not None:
            rows = insert_new(rows, written, list(module.keys))
        rows.write.mode("overwrite").parquet(self._directory(path, batch_id))
        self._reject(rejected, module.id, batch_id)

    def _reject(self, rows: DataFrame, name: str, batch_id: int) -> None:
        whole = F.to_json(F.struct(*[c for c in rows.columns if c != "reason"])).alias("row")
        rows.select(whole, "reason").write.mode("overwrite").parquet(
            self._directory(f"{self.tables}/{REJECTED}/{name}", batch_id)
        )

    def _advance(self, batch: DataFrame, batch_id: int) -> None:
        """Cursor history: one row per batch, never smaller than the one before."""
        path = f"{self.tables}/cursor"
        previous = 0
        written = self._before(batch.sparkSession, path, batch_id)
        if written is not None:
            previous = written.agg(F.max(F.col("value").cast("bigint"))).first()[0] or 0
        advance_cursor(batch, previous).write.mode("overwrite").parquet(self._directory(path, batch_id))

    def start(self, tx: DataFrame, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
        writer = (
            tx.writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
        )
        return (writer.queryName(name) if name else writer).start()


def current_cursor(spark: SparkSession, tables: str) -> int:
    written = read_if_written(spark, f"{tables}/cursor")
    if written is None:
        return 0
    return written.agg(F.max(F.col("value").cast("bigint"))).first()[0] or 0
