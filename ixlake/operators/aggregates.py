"""Availability roll-ups, instruction counts, high-water marks, discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ixlake import constants as K


def collapsed(log: DataFrame) -> DataFrame:
    """One row per (node, root, status): the shards' sum and the latest time."""
    return log.groupBy("node_pubkey", "merkle_root", "status").agg(
        F.sum("shard_count").alias("shards"), F.max("ts").alias("ts")
    )


def node_availability(log: DataFrame) -> DataFrame:
    """Per node over the heartbeat log; status is the largest text, as the view defines it.

    Repeated heartbeats collapse first, in hash aggregations before and after an exchange
    on (node, root, status): a hot node is spread over its roots, and the text maximum,
    which needs a sort, runs on the collapsed rows.
    """
    return collapsed(log).groupBy("node_pubkey").agg(
        F.countDistinct("merkle_root").alias("files_locked"),
        F.sum("shards").alias("total_shards"),
        F.max("ts").alias("last_seen"),
        F.max("status").alias("current_status"),
    )


def node_availability_current(state: DataFrame) -> DataFrame:
    """Per node over the swept state: each root counts once, with its present status."""
    return state.groupBy("node_pubkey").agg(
        F.count("*").alias("files_locked"),
        F.sum("shard_count").alias("total_shards"),
        F.max("last_heartbeat").alias("last_seen"),
        F.count_if(F.col("status") == K.ONLINE).alias("files_online"),
        F.when(F.bool_or(F.col("status") == K.ONLINE), F.lit(K.ONLINE))
        .otherwise(F.lit(K.OFFLINE))
        .alias("current_status"),
    )


def active_shard_map(log: DataFrame) -> DataFrame:
    """Per root over ONLINE heartbeats."""
    return (
        log.filter(F.col("status") == K.ONLINE)
        .groupBy("merkle_root")
        .agg(
            F.countDistinct("node_pubkey").alias("replication_factor"),
            F.sum("shard_count").alias("total_shards_distributed"),
            F.max("ts").alias("last_heartbeat"),
        )
    )


def program_stats(log: DataFrame, catalog: DataFrame, since: Column | None = None) -> DataFrame:
    """Calls per cataloged instruction, zero included, and a total row per program.

    The total row has a NULL instruction. Counting precedes the join, which then sees one
    row per (program, instruction) on both sides.
    """
    if since is not None:
        log = log.filter(F.col("ts") >= since)
    return stats_of_counts(call_counts(log), catalog)


def call_counts(log: DataFrame) -> DataFrame:
    """Calls per program and instruction, names in lower case."""
    return log.groupBy("program_id", F.lower("instruction").alias("instruction")).agg(
        F.count("*").alias("calls")
    )


def stats_of_counts(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """``program_stats`` from calls counted before."""
    known = catalog.select("program_id", "instruction").distinct()
    per_ix = known.join(counts, ["program_id", "instruction"], "left")
    # GROUPING SETS over the joined counts: rows and totals from one exchange.
    return (
        per_ix.groupingSets(
            [["program_id", "instruction"], ["program_id"]], "program_id", "instruction"
        )
        .agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))
    )


def latest_slot(table: DataFrame) -> DataFrame:
    """Largest slot, 0 when the table is empty."""
    return table.agg(F.coalesce(F.max("slot"), F.lit(0)).alias("last_slot"))


def hwm_union(tables: list[DataFrame]) -> DataFrame:
    """Maximum over the distinct union of the tables' maxima; 0 without tables or rows."""
    if not tables:
        raise ValueError("hwm_union needs at least one table; use global_hwm on a log")
    maxima = reduce(DataFrame.union, [t.agg(F.max("slot").alias("s")) for t in tables])
    return maxima.distinct().agg(F.coalesce(F.max("s"), F.lit(0)).alias("hwm"))


def global_hwm(log: DataFrame) -> DataFrame:
    """The same mark over one log partitioned by instruction."""
    return log.agg(F.coalesce(F.max("slot"), F.lit(0)).alias("hwm"))


def batch_maxima(batches: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Largest slot of each batch, replays included."""
    return batches.groupBy(batch).agg(F.max("slot").alias("max_slot"), F.count("*").alias("received"))


def advance_cursor(rows: DataFrame, previous: int = 0) -> DataFrame:
    """Cursor row after ``rows``; it never moves back."""
    return rows.agg(
        F.lit(K.CURSOR_KEY).alias("key"),
        F.greatest(F.coalesce(F.max("slot"), F.lit(0)), F.lit(previous)).cast("string").alias("value"),
        F.max("ts").alias("updated_at"),
    )


def program_discovery(catalog: DataFrame) -> DataFrame:
    """Instructions and tables of each program, one row each (no array per program)."""
    return catalog.select("program_id", "idl_name", "instruction", "table_name").distinct()


def catalog_tables(catalog: DataFrame, name_prefix: str) -> DataFrame:
    """Generated tables whose name starts with a literal prefix."""
    return (
        catalog.filter(F.col("table_name").startswith(name_prefix)).select("table_name").distinct()
    )
