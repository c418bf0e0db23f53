"""Dashboard feeds: newest rows with display labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ixlake import constants as K
from ixlake.functions.text import iso_label, number_label, or_default, short_id
from ixlake.operators.paging import page


def _newest(df: DataFrame, limit: int, by: str = "timestamp") -> DataFrame:
    return page(df, [F.col(by).desc(), F.col("signature").asc()], limit)


def activity_feed(narratives: DataFrame, liquidations: DataFrame, proofs: DataFrame) -> DataFrame:
    """Newest narratives (15), liquidations (10) and proofs (10) with their labels."""
    told = _newest(narratives, 15).select(
        F.lit("narrative").alias("feed"),
        iso_label(F.col("timestamp")).alias("head"),
        F.concat(F.lit("> "), F.col("narrative")).alias("body"),
        F.lit(None).cast("string").alias("badge"),
    )
    repaid = _newest(liquidations, 10).select(
        F.lit("liquidation").alias("feed"),
        short_id(F.col("signature")).alias("head"),
        F.concat(short_id(F.col("protocol")), F.lit(" "), number_label(F.col("repaid_amount"))).alias("body"),
        F.lit(None).cast("string").alias("badge"),
    )
    status = F.col("verification_status")
    proved = _newest(proofs, 10).select(
        F.lit("proof").alias("feed"),
        short_id(F.col("signature")).alias("head"),
        short_id(F.col("state_root"), 12).alias("body"),
        F.concat(
            status, F.lit("/"), F.when(status == K.VERIFIED, F.lit("cyan")).otherwise(F.lit("yellow"))
        ).alias("badge"),
    )
    return told.unionByName(repaid).unionByName(proved)


def launch_feed(launches: DataFrame, limit: int = 10) -> DataFrame:
    """Newest launches; missing name, symbol and creator get their labels."""
    return _newest(launches, limit, "slot").select(
        or_default(F.col("name"), K.NO_LAUNCH_NAME).alias("title"),
        short_id(F.col("signature")).alias("signature_label"),
        or_default(F.col("symbol"), K.NO_SYMBOL).alias("symbol_label"),
        short_id(or_default(F.col("creator"), K.NO_CREATOR)).alias("creator_label"),
    )


def fee_feed(claims: DataFrame, limit: int = 10) -> DataFrame:
    """Newest fee claims; the vault is the platform's, else the fee-share authority."""
    vault = or_default(F.col("platform_vault"), or_default(F.col("fee_share_authority"), K.NO_VAULT))
    return _newest(claims, limit, "slot").select(
        short_id(F.col("signature")).alias("signature_label"),
        short_id(vault).alias("vault_label"),
        F.lit("DISTRIBUTED").alias("status"),
    )
