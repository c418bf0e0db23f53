"""Which archived transactions to run through the transform again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ixlake import constants as K


def by_signature(archive: DataFrame, signatures: DataFrame) -> DataFrame:
    """Archived transactions, or rows extracted from them, whose signature is listed.

    An inner join with each signature once: Spark would push a semi join below the extraction and exchange
    whole transactions where a few columns of a few rows are wanted.
    """
    return archive.join(signatures.select("signature").distinct(), "signature")


def by_slot_range(archive: DataFrame, first: int, last: int) -> DataFrame:
    """Archived transactions of an inclusive slot range; the range reaches the scan."""
    return archive.filter(F.col("slot").between(first, last))


def recent_signatures(ix: DataFrame, depth: int = K.REPLAY_DEPTH) -> DataFrame:
    """The newest ``depth`` signatures of every program.

    Signatures are made unique first (combined before the exchange); the rank bound is
    applied per task as a group limit, so a hot program sends ``depth`` rows per task.
    """
    seen = ix.groupBy("program_id", "signature").agg(F.max("slot").alias("slot"))
    newest = Window.partitionBy("program_id").orderBy(F.col("slot").desc(), F.col("signature"))
    return seen.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= depth)


def recent_per_program(
    archive: DataFrame, ix: DataFrame, depth: int = K.REPLAY_DEPTH, programs: DataFrame | None = None
) -> DataFrame:
    """Instructions of the newest ``depth`` transactions of every program, or of the listed ``programs``, to run
    through the transform again.

    Only (program, signature) pairs meet the archive, so a transaction of two programs is
    replayed for each of them where it is recent. Programs, each given once, are looked up for these pairs only, by an
    inner join: Spark would push a semi join below the ranking, to all instructions.
    """
    recent = recent_signatures(archive, depth).select("program_id", "signature")
    if programs is not None:
        recent = recent.join(programs.select("program_id").hint("merge"), "program_id")
    return ix.join(recent, ["program_id", "signature"], "left_semi")
