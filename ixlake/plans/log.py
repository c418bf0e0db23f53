"""Log pages, counts, high-water marks, monitors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ixlake.functions.text import short_id
from ixlake.operators import aggregates, monitor, paging
from ixlake.plans.registry import query
from ixlake.plans.views import (
    v_catalog,
    v_hb,
    v_ix,
    v_log,
    v_log_catalog,
    v_tx,
    with_views,
)
from ixlake.session import shared_folder
from ixlake.streaming.rollups import CallRollup


@query(
    "instruction_log",
    with_views(
        """
        SELECT signature, slot, ts, program_id, instruction, signer, args, value FROM v_log
        WHERE program_id = 'P1' AND instruction = 'click' ORDER BY slot DESC, signature LIMIT 100 OFFSET 10
        """,
        "v_log",
    ),
)
def instruction_log(spark, d):
    return paging.instruction_log(v_log(spark, d), "P1", "Click", {}, None, "10").data


@query(
    "instruction_log_newest",
    with_views(
        """
        SELECT signature, slot, program_id, instruction, signer,
          row_number() OVER (PARTITION BY program_id, instruction ORDER BY slot DESC, signature) AS rank
        FROM v_log QUALIFY rank <= 100
        """,
        "v_log",
    ),
)
def instruction_log_newest(spark, d):
    """The newest page of every instruction table at once."""
    log = v_log(spark, d).select("signature", "slot", "program_id", "instruction", "signer")
    return paging.page_per_group(
        log, ["program_id", "instruction"], [F.col("slot").desc(), F.col("signature")], 100
    )


@query(
    "log_filter",
    with_views(
        "SELECT signature, slot, ts, program_id, instruction, signer, args, value FROM v_log "
        "WHERE signer = 'U7' AND instruction = 'view'",
        "v_log",
    ),
)
def log_filter(spark, d):
    """Known columns filter, bound as values; the hostile key is not a column and is ignored."""
    return paging.equality_filters(
        v_log(spark, d), {"signer": "U7", "instruction": "view", "1=1; DROP TABLE v_log; --": "boom"}
    )


@query(
    "page_after",
    with_views(
        """
        SELECT signature, slot, instruction FROM v_log
        WHERE slot < 4263192000 OR (slot = 4263192000 AND signature > 'SIG000000000500')
        ORDER BY slot DESC, signature LIMIT 100
        """,
        "v_log",
    ),
)
def page_after(spark, d):
    """Key-set paging: the page behind a (slot, signature), without an offset."""
    return paging.page_after(v_log(spark, d), 4_263_192_000, "SIG000000000500").select(
        "signature", "slot", "instruction"
    )


@query(
    "program_stats",
    with_views(
        """
        , counts AS (
          SELECT c.program_id, c.instruction, count(l.signature) AS calls
          FROM v_log_catalog c LEFT JOIN v_log l ON l.program_id = c.program_id
            AND l.instruction = c.instruction AND l.ts >= TIMESTAMP '2024-01-10 12:00:00'
          GROUP BY ALL)
        SELECT program_id, instruction, calls FROM counts
        UNION ALL SELECT program_id, NULL, sum(calls)::BIGINT FROM counts GROUP BY program_id
        """,
        "v_log_catalog",
    ),
)
def program_stats(spark, d):
    since = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    return aggregates.program_stats(v_log(spark, d), v_log_catalog(spark, d), since)


_INDEXED_CALLS = with_views(
    """
    , counts AS (
      SELECT c.program_id, c.instruction, count(x.signature) AS calls
      FROM v_catalog c LEFT JOIN v_ix x ON x.program_id = c.program_id AND lower(x.name) = c.instruction
      GROUP BY ALL)
    SELECT program_id, instruction, calls FROM counts
    UNION ALL SELECT program_id, NULL, sum(calls)::BIGINT FROM counts GROUP BY program_id
    """,
    "v_ix",
    "v_catalog",
)


def _indexed_calls(spark, d):
    return v_ix(spark, d).select("program_id", F.col("name").alias("instruction"), "slot")


@query("program_stats_indexed", _INDEXED_CALLS)
def program_stats_indexed(spark, d):
    """Calls of every cataloged instruction over all transactions, straight from the feed."""
    return aggregates.program_stats(_indexed_calls(spark, d), v_catalog(spark, d))


@query("program_stats_kept", _INDEXED_CALLS)
def program_stats_kept(spark, d):
    """The same from stored counts of three batches; a fold comes after the second."""
    rollup = CallRollup(f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}", fold_every=2)
    calls = _indexed_calls(spark, d)
    for batch_id in range(3):
        rollup(calls.filter(F.pmod(F.coalesce("slot", F.lit(0)), F.lit(3)) == batch_id), batch_id)
    return rollup.program_stats(v_catalog(spark, d))


@query(
    "latest_slot",
    with_views("SELECT coalesce(max(slot), 0) AS last_slot FROM v_log WHERE instruction = 'purchase'", "v_log"),
)
def latest_slot(spark, d):
    return aggregates.latest_slot(v_log(spark, d).filter("instruction = 'purchase'"))


@query(
    "global_hwm",
    with_views("SELECT coalesce(max(slot), 0) AS hwm FROM v_log", "v_log"),
)
def global_hwm(spark, d):
    return aggregates.global_hwm(v_log(spark, d))


@query(
    "hwm_union",
    with_views(
        """
        SELECT coalesce(max(s), 0) AS hwm FROM (
          SELECT max(slot) AS s FROM v_log UNION SELECT max(slot) FROM v_tx
          UNION SELECT max(epoch_us(ts) // 400000) FROM v_hb)
        """,
        "v_log",
        "v_tx",
        "v_hb",
    ),
)
def hwm_union(spark, d):
    beats = v_hb(spark, d).selectExpr("unix_micros(cast(ts AS timestamp)) DIV 400000 AS slot")
    return aggregates.hwm_union([v_log(spark, d), v_tx(spark, d), beats])


@query(
    "catalog_tables",
    with_views("SELECT DISTINCT table_name FROM v_catalog WHERE starts_with(table_name, 'ix_')", "v_catalog"),
)
def catalog_tables(spark, d):
    return aggregates.catalog_tables(v_catalog(spark, d), "ix_")


@query(
    "program_discovery",
    with_views("SELECT DISTINCT program_id, idl_name, instruction, table_name FROM v_catalog", "v_catalog"),
)
def program_discovery(spark, d):
    return aggregates.program_discovery(v_catalog(spark, d))


_GAPS = """
SELECT gap_start, slot AS gap_end, slot - gap_start AS gap FROM (
  SELECT slot, lag(slot) OVER (ORDER BY slot) AS gap_start FROM (SELECT DISTINCT slot FROM {0}))
WHERE slot - gap_start > 100
"""


@query("slot_gap_audit", with_views(_GAPS.format("v_log"), "v_log"))
def slot_gap_audit(spark, d):
    return monitor.slot_gaps(v_log(spark, d))


@query("slot_gap_audit_feed", with_views(_GAPS.format("v_tx"), "v_tx"))
def slot_gap_audit_feed(spark, d):
    """Gaps of the transaction feed: dense days with long holes between them."""
    return monitor.slot_gaps(v_tx(spark, d))


@query(
    "cursor_audit",
    with_views(
        """
        SELECT 'last_processed_slot' AS key, max(slot) AS cursor,
          (SELECT max(slot) FROM v_log) - max(slot) AS gap,
          (SELECT max(slot) FROM v_log) - max(slot) > 100 AS gap_detected, max(slot) AS baseline
        FROM v_tx
        """,
        "v_tx",
        "v_log",
    ),
)
def cursor_audit(spark, d):
    """Distance of the feed's cursor to the head seen by the log."""
    head = v_log(spark, d).select(F.max("slot")).scalar()
    return monitor.cursor_audit(aggregates.advance_cursor(v_tx(spark, d)), head)


@query(
    "lag_status",
    with_views(
        """
        SELECT signer, last_slot, desync,
          CASE WHEN desync < 50 THEN 'ok' WHEN desync > 500 THEN 'critical' ELSE 'warn' END AS band
        FROM (SELECT signer, max(slot) AS last_slot,
                greatest(0, (SELECT max(slot) FROM v_log) - max(slot)) AS desync FROM v_log GROUP BY signer)
        """,
        "v_log",
    ),
)
def lag_status(spark, d):
    """Lag of every signer behind the head of the log."""
    log = v_log(spark, d)
    last = log.groupBy("signer").agg(F.max("slot").alias("last_slot"))
    return monitor.lag_status(last, log.select(F.max("slot")).scalar())


@query(
    "scalar_functions",
    with_views(
        """
        SELECT signature, lower(upper(instruction)) AS lowered, signature[:8] AS head,
          signature[:8] || '...' AS short, contains(instruction, 'r') AS has_r,
          replace(signature, 'SIG', '') AS digits, coalesce(nullif(replace(signer, 'U1', ''), ''), 'none') AS fallback,
          try_cast(replace(signature, 'SIG', '') AS INT) AS parsed, try_cast(signature AS INT) AS unparsed,
          least(greatest(slot % 1000, 100), 500) AS clamped, (args::JSON ->> '$.k')::INT AS k,
          lower(hex(instruction)) AS hexed, base64(instruction::BLOB) AS encoded,
          strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, ts - INTERVAL 10 MINUTES AS earlier,
          round(value, 1) AS rounded, length(instruction) AS chars,
          coalesce(string_split(instruction, 'i')[3], 'Unknown') AS third
        FROM v_log
        """,
        "v_log",
    ),
)
def scalar_functions(spark, d):
    """The scalar functions of the survey over the whole log, all built-ins."""
    col = F.col
    return v_log(spark, d).select(
        "signature",
        F.lower(F.upper("instruction")).alias("lowered"),
        F.substring("signature", 1, 8).alias("head"),
        short_id(col("signature")).alias("short"),
        col("instruction").contains("r").alias("has_r"),
        F.replace(col("signature"), F.lit("SIG"), F.lit("")).alias("digits"),
        F.coalesce(F.nullif(F.replace(col("signer"), F.lit("U1"), F.lit("")), F.lit("")), F.lit("none")).alias("fallback"),
        F.replace(col("signature"), F.lit("SIG"), F.lit("")).try_cast("int").alias("parsed"),
        col("signature").try_cast("int").alias("unparsed"),
        F.least(F.greatest(col("slot") % 1000, F.lit(100)), F.lit(500)).alias("clamped"),
        F.get_json_object("args", "$.k").try_cast("int").alias("k"),
        F.lower(F.hex("instruction")).alias("hexed"),
        F.base64(col("instruction").cast("binary")).alias("encoded"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        (col("ts") - F.expr("INTERVAL 10 MINUTES")).alias("earlier"),
        F.round("value", 1).alias("rounded"),
        F.length("instruction").cast("bigint").alias("chars"),
        F.coalesce(F.get(F.split("instruction", "i"), F.lit(2)), F.lit("Unknown")).alias("third"),
    )
