"""Transactions to instruction rows: explode, route, envelope, quarantine, catalog match."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ixlake import constants as K
from ixlake.functions.text import or_default


def explode_instructions(tx: DataFrame) -> DataFrame:
    """One row per instruction; a missing or empty list gives no row. No shuffle.

    The outer form and a filter behind it, because the inner form infers a size test that
    evaluates a computed list a second time, below the operators under it.
    """
    kept = [c for c in tx.columns if c != "instructions"]
    exploded = tx.select(*kept, F.posexplode_outer("instructions").alias("ix_index", "ix"))
    return exploded.filter("ix_index IS NOT NULL").select(
        *kept,
        "ix_index",
        F.col("ix.programId").alias("program_id"),
        F.col("ix.name").alias("name"),
        F.col("ix.data").alias("data"),
        F.col("ix.accounts").alias("accounts"),
    )


def route_by_program(ix: DataFrame, programs: Iterable[str] | DataFrame) -> DataFrame:
    """Instructions of the given programs.

    A list becomes an IN predicate, pushed to the scan where the column is stored. A
    registry DataFrame becomes a semi join whose strategy Spark picks from its size.
    """
    if isinstance(programs, DataFrame):
        return ix.join(programs.select("program_id"), "program_id", "left_semi")
    return ix.filter(F.col("program_id").isin(list(programs)))


def envelope(ix: DataFrame, signer: str = "fee_payer") -> DataFrame:
    """Signature, slot, time and signer columns every indexed row starts with."""
    return ix.withColumns(
        {
            "signature": or_default(F.col("signature"), K.UNKNOWN_SIGNATURE),
            "signer": or_default(F.col(signer), K.UNKNOWN_SIGNER),
        }
    )


def with_reason(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``reason``: the first check that fails (a NULL check fails), else NULL."""
    reason = F.coalesce(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    )
    return df.withColumn("reason", reason)


def missing_key_checks(*keys: str) -> dict[str, Column]:
    """Checks that reject rows whose key column is NULL or empty."""
    return {f"missing_{key}": F.coalesce(F.col(key).cast("string"), F.lit("")) != "" for key in keys}


def split_quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows passing every check, and the rejected rows with their ``reason``."""
    judged = with_reason(df, checks)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def join_catalog(ix: DataFrame, catalog: DataFrame) -> DataFrame:
    """Decoded instruction name to its table, case-insensitive.

    Equi-join on (program, lower-case name). The catalog's size decides the strategy: AQE
    broadcasts it below the session's threshold and splits a hot program's partition
    beyond it.
    """
    keys = catalog.select("program_id", F.col("instruction").alias("ix_key"), "table_name")
    return (
        ix.withColumn("ix_key", F.lower("name"))
        .join(keys, ["program_id", "ix_key"])
        .drop("ix_key")
    )


def unmapped_instructions(ix: DataFrame, catalog: DataFrame) -> DataFrame:
    """Count of instructions whose name is not in the catalog, per program and name.

    Counts first, so that the anti join sees one row per (program, name).
    """
    counts = (
        ix.filter("name IS NOT NULL")
        .groupBy("program_id", F.lower("name").alias("instruction"))
        .agg(F.count("*").alias("skipped"))
    )
    return counts.join(catalog, ["program_id", "instruction"], "left_anti")
