"""Feed, explode, route, envelope, keyed writes, extractors."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ixlake import constants as K
from ixlake.operators import aggregates, dedup, extract, ingest, paging, universal
from ixlake.operators.decode import heartbeat_checks
from ixlake.functions.binary import text_to_bytes
from ixlake.plans.registry import query
from ixlake.plans.views import (
    SQL,
    v_arrivals,
    v_calls,
    v_catalog,
    v_idl,
    v_ix,
    v_payload,
    v_tx,
    with_views,
)
from ixlake.sources.tables import table
from ixlake.session import shared_folder
from ixlake.sources.transactions import normalise, parse_batches, read_feed, split_batches

ROW = ["signature", "feed_partition", "feed_offset"]


@query(
    "tx_source",
    with_views(
        """
        SELECT signature, feed_partition, feed_offset, slot, fee_payer, description,
          CASE WHEN l_partkey % 40 = 0 THEN NULL WHEN l_partkey % 40 = 1 THEN 0
            ELSE 1 + (l_linenumber % 2 = 0)::INT + (l_linenumber % 6 = 0)::INT END AS instruction_count
        FROM v_tx WHERE l_linenumber <> 2
        """,
        "v_tx",
    ),
)
def tx_source(spark, d):
    """Pushed JSON batches, parsed; a batch that is not an array is ignored."""
    tx = v_tx(spark, d)
    body = F.to_json(
        F.struct(
            "signature",
            "slot",
            F.col("fee_payer").alias("feePayer"),
            "description",
            "instructions",
        )
    )
    pushed = tx.select(
        "feed_partition",
        "feed_offset",
        F.when(F.col("signature").endswith("-2"), body)
        .otherwise(F.concat(F.lit(" ["), body, F.lit("]")))
        .alias("value"),
    )
    return normalise(parse_batches(pushed)).select(
        *ROW,
        "slot",
        "fee_payer",
        "description",
        F.when(F.col("instructions").isNotNull(), F.size("instructions")).alias("instruction_count"),
    )


@query(
    "explode_instructions",
    with_views("SELECT signature, feed_partition, feed_offset, ix_index, program_id, name FROM v_ix", "v_ix"),
)
def explode_instructions(spark, d):
    return v_ix(spark, d).select(*ROW, "ix_index", "program_id", "name")


@query(
    "route_by_program",
    with_views(
        """
        SELECT signature, feed_partition, feed_offset, ix_index, program_id
        FROM v_ix WHERE program_id IN (SELECT program_id FROM v_catalog)
        """,
        "v_ix",
        "v_catalog",
    ),
)
def route_by_program(spark, d):
    programs = v_catalog(spark, d).select("program_id").distinct()
    return ingest.route_by_program(v_ix(spark, d), programs).select(*ROW, "ix_index", "program_id")


@query(
    "ix_envelope",
    with_views(
        """
        SELECT coalesce(nullif(signature, ''), 'unknown') AS signature, slot, ts,
          coalesce(nullif(fee_payer, ''), 'Unknown') AS signer, feed_partition, feed_offset, ix_index, name
        FROM v_ix
        """,
        "v_ix",
    ),
)
def ix_envelope(spark, d):
    return ingest.envelope(v_ix(spark, d)).select(
        "signature", "slot", "ts", "signer", "feed_partition", "feed_offset", "ix_index", "name"
    )


@query(
    "join_catalog",
    with_views(
        """
        SELECT signature, feed_partition, feed_offset, ix_index, program_id, table_name
        FROM v_ix JOIN v_catalog c USING (program_id) WHERE lower(v_ix.name) = c.instruction
        """,
        "v_ix",
        "v_catalog",
    ),
)
def join_catalog(spark, d):
    joined = ingest.join_catalog(v_ix(spark, d), v_catalog(spark, d))
    return joined.select(*ROW, "ix_index", "program_id", "table_name")


@query(
    "unmapped_instructions",
    with_views(
        """
        SELECT program_id, lower(name) AS instruction, count(*) AS skipped
        FROM v_ix WHERE NOT EXISTS (SELECT 1 FROM v_catalog c
          WHERE c.program_id = v_ix.program_id AND c.instruction = lower(v_ix.name))
        GROUP BY ALL
        """,
        "v_ix",
        "v_catalog",
    ),
)
def unmapped_instructions(spark, d):
    return ingest.unmapped_instructions(v_ix(spark, d), v_catalog(spark, d))


@query(
    "quarantine",
    with_views(
        "SELECT signature, feed_partition, feed_offset, reason FROM v_payload WHERE reason IS NOT NULL",
        "v_payload",
    ),
)
def quarantine(spark, d):
    rows = v_payload(spark, d).withColumn("payload", text_to_bytes(F.col("data"), "base64"))
    _, rejected = ingest.split_quarantine(rows, heartbeat_checks(F.col("payload")))
    return rejected.select(*ROW, "reason")


@query(
    "insert_ignore",
    with_views(
        """
        SELECT signature, ix_index, name, slot, feed_partition, feed_offset FROM v_ix
        QUALIFY row_number() OVER (PARTITION BY signature, ix_index
          ORDER BY slot, feed_partition, feed_offset) = 1
        """,
        "v_ix",
    ),
)
def insert_ignore(spark, d):
    rows = v_ix(spark, d).select("signature", "ix_index", "name", "slot", "feed_partition", "feed_offset")
    return dedup.insert_ignore(rows, ["signature", "ix_index"], extract.ARRIVAL)


@query(
    "insert_ignore_first_per_signature",
    with_views(
        """
        SELECT signature, name, ix_index, slot, feed_partition, feed_offset FROM v_ix
        QUALIFY row_number() OVER (PARTITION BY signature, lower(name), program_id
          ORDER BY slot, feed_partition, feed_offset, ix_index) = 1
        """,
        "v_ix",
    ),
)
def insert_ignore_first_per_signature(spark, d):
    """One row per signature in each instruction table (the key is the signature alone)."""
    rows = v_ix(spark, d).select(
        "signature", "name", "ix_index", "slot", "feed_partition", "feed_offset", "program_id",
        F.lower("name").alias("instruction"),
    )
    first = dedup.insert_ignore(
        rows, ["signature", "instruction", "program_id"], [*extract.ARRIVAL, "ix_index"]
    )
    return first.drop("instruction", "program_id")


@query(
    "insert_new",
    with_views(
        """
        SELECT DISTINCT signature FROM v_tx
        WHERE signature NOT IN (SELECT 'TX' || o_orderkey || '-1' FROM orders WHERE o_orderstatus = 'F')
        """,
        "v_tx",
    ),
)
def insert_new(spark, d):
    """Signatures not stored yet: the existing table holds the finished orders' first lines."""
    existing = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'F'").select(
        F.concat(F.lit("TX"), "o_orderkey", F.lit("-1")).alias("signature")
    )
    return dedup.insert_new(v_tx(spark, d).select("signature").distinct(), existing, ["signature"])


@query(
    "feed_quarantine",
    """
    SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'not_an_array' WHEN event_id % 43 = 0 THEN 'broken_json'
        ELSE CASE pos WHEN 0 THEN CASE WHEN event_id % 47 = 0 OR event_id % 53 = 0 THEN 'bad_slot' ELSE 'kept' END
          ELSE CASE WHEN event_id % 59 = 0 THEN 'bad_timestamp' ELSE 'kept' END END END AS outcome,
      CASE WHEN event_id % 41 <> 0 AND event_id % 43 <> 0 THEN 'E' || event_id || '-' || pos END AS signature
    FROM (SELECT event_id, unnest(CASE WHEN event_id % 41 = 0 OR event_id % 43 = 0 THEN [0] ELSE [0, 1] END) AS pos FROM events)
    """,
)
def feed_quarantine(spark, d):
    """Pushed batches of two transactions, some broken: every one is kept or has a reason."""
    slot = "CASE WHEN event_id % 47 = 0 THEN '\"x\"' WHEN event_id % 53 = 0 THEN '1.5' ELSE cast(event_id AS string) END"
    first = f"concat('{{\"signature\":\"E', event_id, '-0\",\"slot\":', {slot}, '}}')"
    second = (
        "concat('{\"signature\":\"E', event_id, '-1\",\"timestamp\":', "
        "if(event_id % 59 = 0, '\"soon\"', '5'), '}')"
    )
    text = (
        f"CASE WHEN event_id % 41 = 0 THEN {first} "
        f"WHEN event_id % 43 = 0 THEN concat('[', {first}, ',') ELSE concat('[', {first}, ',', {second}, ']') END"
    )
    batches = table(spark, d, "events").selectExpr("event_id", f"{text} AS value")
    kept, rejected = split_batches(batches)
    return kept.select("event_id", F.lit("kept").alias("outcome"), "signature").unionByName(
        rejected.select("event_id", F.col("reason").alias("outcome"), F.get_json_object("text", "$.signature").alias("signature"))
        .withColumn("signature", F.when(F.col("outcome").startswith("bad_"), F.col("signature")))
    )


@query(
    "feed_files",
    """
    SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'broken_json' WHEN event_id % 43 = 0 THEN 'no_object'
        WHEN event_id % 47 = 0 OR event_id % 53 = 0 THEN 'bad_slot' WHEN event_id % 59 = 0 THEN 'bad_timestamp' END AS reason,
      CASE WHEN event_id % 41 = 0 OR event_id % 43 = 0 OR event_id % 47 = 0 OR event_id % 53 = 0 OR event_id % 59 = 0
        THEN NULL ELSE event_id END AS slot
    FROM events
    """,
)
def feed_files(spark, d):
    """A feed of files with a transaction per line, written and read back: each is kept or has a reason."""
    slot = "CASE WHEN event_id % 47 = 0 THEN '\"x\"' WHEN event_id % 53 = 0 THEN '1.5' ELSE cast(event_id AS string) END"
    whole = (
        f"concat('{{\"signature\":\"', event_id, '\",\"slot\":', {slot}, ',\"timestamp\":', "
        "if(event_id % 59 = 0, '\"soon\"', '5'), '}')"
    )
    line = f"CASE WHEN event_id % 41 = 0 THEN concat('{{\"signature\":\"', event_id) WHEN event_id % 43 = 0 THEN cast(event_id AS string) ELSE {whole} END"
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    table(spark, d, "events").select(F.expr(line).alias("value")).write.text(path)
    kept, rejected = read_feed(spark, path, lines=True)
    number = F.regexp_extract("text", "[0-9]+", 0).cast("bigint")
    return kept.select(F.col("signature").cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("reason"), "slot").unionByName(
        rejected.select(number.alias("event_id"), "reason", F.lit(None).cast("bigint").alias("slot"))
    )


_TTL_ORACLE = """
, points AS (SELECT k, ts, min(event_id) AS event_id FROM
    (SELECT user_id || '/' || event_type AS k, ts, event_id FROM events) GROUP BY k, ts),
kept AS (
  SELECT k, min(ts) AS ts FROM points GROUP BY k
  UNION ALL
  SELECT kept.k, (SELECT min(p.ts) FROM points p WHERE p.k = kept.k
    AND p.ts >= kept.ts + INTERVAL 24 HOURS) AS ts
  FROM kept WHERE kept.ts IS NOT NULL)
SELECT k AS key, ts, event_id FROM kept JOIN points USING (k, ts)
"""


@query("ttl_dedup", "WITH RECURSIVE one AS (SELECT 1)" + _TTL_ORACLE)
def ttl_dedup(spark, d):
    return dedup.ttl_dedup(v_arrivals(spark, d), ["key"], "ts", "event_id")


@query("ttl_dedup_hot", "WITH RECURSIVE one AS (SELECT 1)" + _TTL_ORACLE)
def ttl_dedup_hot(spark, d):
    """The same rule with every key treated as one that is never quiet: all by transfer functions."""
    return dedup.ttl_dedup(v_arrivals(spark, d), ["key"], "ts", "event_id", split=False, run=0)


@query(
    "ttl_dedup_defects",
    """
    WITH RECURSIVE rows AS (
      SELECT CASE WHEN event_id % 41 <> 0 THEN user_id || '/' || event_type END AS key,
        CASE WHEN event_id % 37 <> 0 THEN ts END AS ts, event_id, value FROM events),
    points AS (SELECT key AS k, ts, min(event_id) AS event_id FROM rows
      WHERE key IS NOT NULL AND ts IS NOT NULL GROUP BY k, ts),
    kept AS (
      SELECT k, min(ts) AS ts FROM points GROUP BY k
      UNION ALL
      SELECT kept.k, (SELECT min(p.ts) FROM points p WHERE p.k = kept.k
        AND p.ts >= kept.ts + INTERVAL 24 HOURS) AS ts
      FROM kept WHERE kept.ts IS NOT NULL)
    SELECT 'accepted' AS outcome, event_id, value FROM kept JOIN points USING (k, ts) JOIN rows USING (event_id)
    UNION ALL
    SELECT CASE WHEN key IS NULL THEN 'missing_key' ELSE 'missing_ts' END, event_id, value FROM rows
    WHERE key IS NULL OR ts IS NULL
    """,
)
def ttl_dedup_defects(spark, d):
    """Rows with payload, some without key or time: accepted ones, and rejected ones by reason."""
    arrivals = table(spark, d, "events").selectExpr(
        "if(event_id % 41 = 0, NULL, concat(user_id, '/', event_type)) AS key",
        "if(event_id % 37 = 0, NULL, ts) AS ts",
        "event_id",
        "value",
    )
    good, rejected = ingest.split_quarantine(arrivals, dedup.ttl_checks(["key"], "ts"))
    accepted = dedup.ttl_dedup(good, ["key"], "ts", "event_id")
    return accepted.select(F.lit("accepted").alias("outcome"), "event_id", "value").unionByName(
        rejected.select(F.col("reason").alias("outcome"), "event_id", "value")
    )


_LIQUIDATIONS = """
liq AS (
  SELECT signature, program_id AS protocol, coalesce(nullif(fee_payer, ''), 'Unknown') AS liquidator,
    coalesce(repaid::VARCHAR, '0') AS repaid_amount, slot, ts AS timestamp
  FROM v_ix WHERE program_id IN {programs} AND contains(lower(name), 'liquidate')
  QUALIFY row_number() OVER (PARTITION BY signature ORDER BY slot, feed_partition, feed_offset, ix_index) = 1)
""".replace("{programs}", str(K.LENDING_PROGRAMS))

_NARRATIVES = """
nar AS (
  SELECT signature, 'Transaction ' || signature[:8] || ': ' || description || ' at slot ' || slot AS narrative,
    slot, ts AS timestamp
  FROM v_tx WHERE coalesce(description, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY signature ORDER BY slot, feed_partition, feed_offset) = 1)
"""

_PROOFS = """
prf AS (
  SELECT signature, slot, 'extracted_root_stub' AS state_root, 'PENDING' AS verification_status, ts AS timestamp
  FROM v_ix WHERE program_id = '{program}'
  QUALIFY row_number() OVER (PARTITION BY signature ORDER BY slot, feed_partition, feed_offset, ix_index) = 1)
""".replace("{program}", K.PROOF_PROGRAM)


def _over(tables: list[str], body: str) -> str:
    views = with_views("", "v_ix").rstrip()
    return views + ",\n" + ",\n".join(t.strip() for t in tables) + "\n" + body


@query(
    "liquidations",
    _over([_LIQUIDATIONS], "SELECT signature, protocol, liquidator, repaid_amount, slot, timestamp FROM liq"),
)
def liquidations(spark, d):
    return extract.LIQUIDATIONS.rows(v_tx(spark, d))


@query(
    "narratives",
    _over([_NARRATIVES], "SELECT signature, narrative, NULL::VARCHAR AS semantic_cluster, slot, timestamp FROM nar"),
)
def narratives(spark, d):
    return extract.NARRATIVES.rows(v_tx(spark, d))


@query(
    "narratives_missing_slot",
    with_views(
        """
        SELECT signature, 'Transaction ' || signature[:8] || ': ' || description || ' at slot ' ||
          coalesce(s::VARCHAR, 'unknown') AS narrative, s AS slot
        FROM (SELECT *, CASE WHEN feed_partition % 41 <> 5 THEN slot END AS s FROM v_tx)
        WHERE coalesce(description, '') <> ''
        QUALIFY row_number() OVER (PARTITION BY signature ORDER BY s NULLS FIRST, feed_partition, feed_offset) = 1
        """,
        "v_tx",
    ),
)
def narratives_missing_slot(spark, d):
    """A transaction without a slot keeps its narrative."""
    slot = F.when(F.col("feed_partition") % 41 != 5, F.col("slot"))
    rows = extract.NARRATIVES.rows(v_tx(spark, d).withColumn("slot", slot))
    return rows.select("signature", "narrative", "slot")


@query(
    "extractor_quarantine",
    with_views(
        """
        SELECT CASE WHEN k IS NULL OR k = '' THEN 'missing_signature' ELSE 'kept' END AS outcome,
          k AS signature, feed_partition, feed_offset, description
        FROM (SELECT *, CASE WHEN feed_partition % 41 = 0 THEN NULL WHEN feed_partition % 43 = 0 THEN ''
                ELSE signature END AS k FROM v_tx)
        WHERE coalesce(description, '') <> ''
        """,
        "v_tx",
    ),
)
def extractor_quarantine(spark, d):
    """A module's rows with a key and, apart from them, those without: together all of them."""
    part = F.col("feed_partition")
    key = F.when(part % 41 == 0, F.lit(None)).when(part % 43 == 0, F.lit("")).otherwise(F.col("signature"))
    tx = v_tx(spark, d).withColumn("signature", key)
    module = replace(extract.NARRATIVES, transform=lambda t: extract.narratives(t, kept=("description",)))
    kept, rejected = module.judged(tx)
    columns = ["signature", "feed_partition", "feed_offset", "description"]
    return kept.select(F.lit("kept").alias("outcome"), *columns).unionByName(
        rejected.select(F.col("reason").alias("outcome"), *columns)
    )


@query(
    "proof_log",
    _over([_PROOFS], "SELECT signature, slot, state_root, verification_status, timestamp FROM prf"),
)
def proof_log(spark, d):
    return extract.PROOF_LOGS.rows(v_tx(spark, d))


_BEATS = """
beats AS (
  SELECT DISTINCT signature FROM v_payload WHERE reason IS NULL)
"""

_CALLS = """
calls AS (
  SELECT DISTINCT 'TX' || l_orderkey || '-' || l_linenumber AS signature, ix_index, l_linenumber = 6 AS beat,
    CASE WHEN l_partkey % 4 = 1 THEN 'File' ELSE 'Prog' END || l_partkey AS p
  FROM v_note WHERE NOT (l_partkey % 4 <> 1 AND l_partkey % 5 = 2) AND l_linenumber <> 7)
"""


@query(
    "extractor_fan_out",
    _over(
        [_LIQUIDATIONS, _NARRATIVES, _PROOFS, "v_payload AS (" + SQL["v_payload"] + ")", "v_note AS (" + SQL["v_note"] + ")", _BEATS, _CALLS],
        """
        SELECT 'liquidations' AS module, count(*) AS written, max(slot) AS last_slot FROM liq
        UNION ALL SELECT 'narratives', count(*), max(slot) FROM nar
        UNION ALL SELECT 'proof_logs', count(*), max(slot) FROM prf
        UNION ALL SELECT 'heartbeats', (SELECT count(*) FROM beats), NULL
        UNION ALL SELECT 'instructions', (SELECT count(*) FROM calls), (SELECT max(epoch_us(l_shipdate) // 400000 + l_orderkey % 1000)
          FROM v_note WHERE NOT (l_partkey % 4 <> 1 AND l_partkey % 5 = 2) AND l_linenumber <> 7)
        """,
    ),
)
def extractor_fan_out(spark, d):
    """Every transaction to every registered module; what each table received.

    The feed holds the described transactions, heartbeats and calls of cataloged programs.
    """

    def as_transactions(rows, program, **more):
        call = F.struct(
            program.alias("programId"), F.lit(None).cast("string").alias("name"), "data", more["accounts"].alias("accounts")
        )
        return rows.select(
            "signature", F.lit(None).cast("bigint").alias("slot"), F.lit(None).cast("timestamp_ntz").alias("ts"),
            F.lit(None).cast("string").alias("fee_payer"), F.lit(None).cast("string").alias("description"),
            "feed_partition", "feed_offset", F.array(call).alias("instructions"),
        )

    tx = v_tx(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    beats = as_transactions(v_payload(spark, d), F.lit(K.HEARTBEAT_PROGRAM), accounts=F.col("accounts"))
    calls = v_calls(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    module = universal.universal_module(universal.catalog_layouts(v_idl(spark, d)))
    feed = tx.unionByName(beats).unionByName(calls)
    parts = [
        rows.agg(
            F.lit(module).alias("module"),
            F.count("*").alias("written"),
            F.max("slot").alias("last_slot"),
        )
        for module, rows in extract.default_registry(module).extract(feed, store=True).items()
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


@query(
    "liquidations_by_protocol",
    _over(
        [_LIQUIDATIONS],
        """
        SELECT protocol, signature, liquidator, repaid_amount, timestamp,
          row_number() OVER (PARTITION BY protocol ORDER BY timestamp DESC, signature) AS rank
        FROM liq QUALIFY rank <= 50
        """,
    ),
)
def liquidations_by_protocol(spark, d):
    """The newest page of every protocol."""
    n, o = paging.clamp_page(None, None, *K.LIQUIDATION_PAGE)
    rows = extract.LIQUIDATIONS.rows(v_tx(spark, d))
    return paging.page_per_group(
        rows, ["protocol"], [F.col("timestamp").desc(), F.col("signature")], n, o
    ).select("protocol", "signature", "liquidator", "repaid_amount", "timestamp", "rank")


@query(
    "page_by_time",
    _over(
        [_LIQUIDATIONS],
        """
        SELECT signature, protocol, liquidator, repaid_amount, timestamp FROM liq
        ORDER BY timestamp DESC, signature LIMIT 50 OFFSET 25
        """,
    ),
)
def page_by_time(spark, d):
    rows = extract.LIQUIDATIONS.rows(v_tx(spark, d))
    wanted = paging.page_by_time(rows, None, "25", K.LIQUIDATION_PAGE, ts="timestamp")
    return wanted.data.select("signature", "protocol", "liquidator", "repaid_amount", "timestamp")


@query(
    "ingest_cursor",
    with_views(
        "SELECT 'last_processed_slot' AS key, max(slot)::VARCHAR AS value, max(ts) AS updated_at FROM v_tx",
        "v_tx",
    ),
)
def ingest_cursor(spark, d):
    return aggregates.advance_cursor(v_tx(spark, d))


@query(
    "batch_maxima",
    with_views(
        """
        SELECT strftime(ts, '%Y-%m-%d') AS batch_id, max(slot) AS max_slot, count(*) AS received
        FROM v_tx GROUP BY 1
        """,
        "v_tx",
    ),
)
def batch_maxima(spark, d):
    """Largest slot of each daily batch, replays included."""
    daily = v_tx(spark, d).withColumn("batch_id", F.date_format("ts", "yyyy-MM-dd"))
    return aggregates.batch_maxima(daily)
