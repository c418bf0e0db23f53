"""Parquet tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ixlake.constants import ONLINE

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its files and row groups decide the scan's tasks (see :func:`spread`)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as a shuffle has.

    For small files with much work per row: a scan cuts them by bytes and row groups, which is one
    or two tasks for a million rows. By number and not by key, so that null and repeated keys
    share the work, and AQE does not put the small partitions together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """The long log table, laid out for paging.

    One directory per (program, instruction) prunes partitions; slot order inside files
    gives narrow min/max ranges, so a newest-first page skips most row groups.
    """
    (
        log.sortWithinPartitions("program_id", "instruction", "slot")
        .write.mode(mode)
        .partitionBy("program_id", "instruction")
        .parquet(path)
    )


def append_heartbeats(heartbeats: DataFrame, path: str) -> None:
    """Append every heartbeat to the event log; nothing is merged or replaced."""
    heartbeats.select(
        F.col("ts").alias("timestamp"), "merkle_root", "node_pubkey", "shard_count", F.lit(ONLINE).alias("status")
    ).write.mode("append").parquet(path)
