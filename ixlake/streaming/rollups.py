"""Roll-ups kept up to date from batches; the log is never read again.

Each roll-up is the sum of mergeable rows (counts, sums, maxima by group) that every batch adds.
Exact distinct counts come from a stored set of (node, root) pairs: a batch counts the pairs that
are not in it yet. All tables are append-only :class:`Partials`, so a batch that runs again
replaces its own rows and changes nothing. From time to time the rows of finished batches are
folded into one base.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ixlake import constants as K
from ixlake.operators.aggregates import call_counts, collapsed, stats_of_counts
from ixlake.streaming.ingest import read_if_written

FOLD_EVERY = 64  # batches between two folds


class Partials:
    """Rows by batch under ``batches/batch_id=<n>``, and their merged form under ``base/upto=<n>``.

    ``folded`` has one row for each base that is complete, so a fold that is lost half-way is
    never read. A base takes in batches that are done for good: one that may run again
    comes after it.
    """

    def __init__(self, path: str):
        self.path = path

    def put(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")

    def of_batch(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/batches/batch_id={batch_id}")

    def folded(self, spark: SparkSession) -> int:
        marks = read_if_written(spark, f"{self.path}/folded")
        return -1 if marks is None else marks.agg(F.max("upto")).first()[0]

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The base and the batches after it, up to batch ``before``; None when there are none."""
        upto = self.folded(spark)
        if before is not None and upto >= before:
            raise ValueError(f"batch {before} is part of the base {upto} already")
        parts = []
        batches = read_if_written(spark, f"{self.path}/batches")
        if batches is not None:
            later = F.col("batch_id") > upto
            if before is not None:
                later &= F.col("batch_id") < before
            parts.append(batches.filter(later).drop("batch_id"))
        if upto >= 0:
            parts.append(spark.read.parquet(f"{self.path}/base/upto={upto}"))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def fold(self, spark: SparkSession, upto: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Merge everything up to batch ``upto`` into one base. What older bases held may then be
        deleted (``batches/batch_id`` and ``base/upto`` up to the last base) once no reader is left."""
        if upto <= self.folded(spark):
            return
        rows = self.read(spark, upto + 1)
        if rows is not None:
            merge(rows).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
            mark = spark.range(1).select(F.lit(upto).cast("long").alias("upto"))
            mark.write.mode("overwrite").parquet(f"{self.path}/folded/at={upto}")


def merge_nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node_pubkey").agg(
        F.sum("files_locked").alias("files_locked"),
        F.sum("total_shards").alias("total_shards"),
        F.max("last_seen").alias("last_seen"),
        F.max("current_status").alias("current_status"),
    )


def merge_roots(rows: DataFrame) -> DataFrame:
    return rows.groupBy("merkle_root").agg(
        F.sum("replication_factor").alias("replication_factor"),
        F.sum("total_shards_distributed").alias("total_shards_distributed"),
        F.max("last_heartbeat").alias("last_heartbeat"),
    )


def merge_calls(rows: DataFrame) -> DataFrame:
    return rows.groupBy("program_id", "instruction").agg(F.sum("calls").alias("calls"))


def _every(fold_every: int, batch_id: int) -> bool:
    return batch_id > 0 and batch_id % fold_every == 0


def _start(sink, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class HeartbeatRollups:
    """``foreachBatch`` sink of heartbeats: availability by node and shard map by root.

    A null root is no file of its node and a null node no copy of its root, as in the batch
    forms; a null node (root) is a group of its own.
    """

    def __init__(self, tables: str, fold_every: int = FOLD_EVERY):
        self.pairs = Partials(f"{tables}/pairs")
        self.nodes = Partials(f"{tables}/nodes")
        self.roots = Partials(f"{tables}/roots")
        self.fold_every = fold_every

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _every(self.fold_every, batch_id):
            self.pairs.fold(spark, batch_id - 1, DataFrame.distinct)
            self.nodes.fold(spark, batch_id - 1, merge_nodes)
            self.roots.fold(spark, batch_id - 1, merge_roots)
        delta = collapsed(batch).persist()
        try:
            online = delta.filter(F.col("status") == K.ONLINE)
            self.pairs.put(self._unseen(delta, online, self.pairs.read(spark, batch_id)), batch_id)
            unseen = self.pairs.of_batch(spark, batch_id)
            self.nodes.put(self._of_nodes(delta, unseen.filter(~F.col("online"))), batch_id)
            self.roots.put(self._of_roots(online, unseen.filter("online")), batch_id)
        finally:
            delta.unpersist()

    @staticmethod
    def _unseen(delta: DataFrame, online: DataFrame, stored: DataFrame | None) -> DataFrame:
        """Pairs of the batch that no batch before had; those heard ONLINE are a set of their own."""
        pair = ["node_pubkey", "merkle_root"]
        rows = (
            delta.filter("merkle_root IS NOT NULL").select(*pair, F.lit(False).alias("online"))
            .union(online.filter("node_pubkey IS NOT NULL").select(*pair, F.lit(True)))
            .distinct()
        )
        if stored is None:
            return rows
        new, old = rows.alias("n"), stored.alias("o")
        same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*pair, "online"]])
        return new.join(old, same, "left_anti")

    @staticmethod
    def _of_nodes(delta: DataFrame, unseen: DataFrame) -> DataFrame:
        heard = delta.select(
            "node_pubkey", F.lit(0).cast("long").alias("files_locked"), F.col("shards").alias("total_shards"),
            F.col("ts").alias("last_seen"), F.col("status").alias("current_status"),
        )
        files = unseen.select("node_pubkey", F.lit(1).cast("long").alias("files_locked"))
        return merge_nodes(heard.unionByName(files, allowMissingColumns=True))

    @staticmethod
    def _of_roots(online: DataFrame, unseen: DataFrame) -> DataFrame:
        heard = online.select(
            "merkle_root", F.lit(0).cast("long").alias("replication_factor"),
            F.col("shards").alias("total_shards_distributed"), F.col("ts").alias("last_heartbeat"),
        )
        copies = unseen.select("merkle_root", F.lit(1).cast("long").alias("replication_factor"))
        return merge_roots(heard.unionByName(copies, allowMissingColumns=True))

    def node_availability(self, spark: SparkSession) -> DataFrame:
        """As ``aggregates.node_availability`` of all heartbeats so far."""
        return merge_nodes(self._rows(spark, self.nodes))

    def active_shard_map(self, spark: SparkSession) -> DataFrame:
        """As ``aggregates.active_shard_map`` of all heartbeats so far."""
        return merge_roots(self._rows(spark, self.roots))

    @staticmethod
    def _rows(spark: SparkSession, table: Partials) -> DataFrame:
        rows = table.read(spark)
        if rows is None:
            raise ValueError(f"no batch was written to {table.path}")
        return rows

    def start(self, heartbeats: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return _start(self, heartbeats, checkpoint, **trigger)


class CallRollup:
    """``foreachBatch`` sink of instructions: calls by program and instruction."""

    def __init__(self, tables: str, fold_every: int = FOLD_EVERY):
        self.calls = Partials(f"{tables}/calls")
        self.fold_every = fold_every

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if _every(self.fold_every, batch_id):
            self.calls.fold(batch.sparkSession, batch_id - 1, merge_calls)
        self.calls.put(call_counts(batch), batch_id)

    def program_stats(self, catalog: DataFrame) -> DataFrame:
        """As ``aggregates.program_stats`` of all instructions so far, for the catalog of now."""
        rows = self.calls.read(catalog.sparkSession)
        if rows is None:
            raise ValueError(f"no batch was written to {self.calls.path}")
        return stats_of_counts(merge_calls(rows), catalog)

    def start(self, instructions: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return _start(self, instructions, checkpoint, **trigger)
