"""Payload decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ixlake.functions.base58 import bytes_to_base58
from ixlake.functions.binary import hex_text, text_to_bytes
from ixlake.operators import decode, dedup, extract, idl, paging, replay, universal
from ixlake.plans.registry import query
from ixlake.plans.views import (
    _PART_PROGRAM,
    SQL,
    le_hex,
    v_calls,
    v_catalog,
    v_idl,
    v_ix,
    v_note,
    v_payload,
    with_views,
)
from ixlake.sources.tables import table

_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@query(
    "payload_bytes",
    f"""
    WITH texts AS (
      SELECT event_id, replace(md5(event_id::VARCHAR), '0', 'z')[:20] AS t, event_type FROM events),
    numbers AS (
      SELECT event_id, event_type, length(t) - length(ltrim(t, '1')) AS zeros, lower(to_hex(list_reduce(
        list_prepend(0::HUGEINT, list_transform(string_split(t, ''), lambda c: (strpos('{_ALPHABET}', c) - 1)::HUGEINT)),
        lambda a, b: a * 58 + b))) AS digits
      FROM texts)
    SELECT event_id,
      repeat('00', zeros) || CASE length(digits) % 2 WHEN 1 THEN '0' ELSE '' END || digits AS base58_hex,
      lower(hex(event_type)) AS base64_hex, lower(hex(event_type)) AS hex_hex, TRUE AS bad_is_null
    FROM numbers
    """,
)
def payload_bytes(spark, d):
    """Base58, base64 and hex payload texts to bytes; an invalid text gives NULL."""
    texts = table(spark, d, "events").select(
        "event_id",
        F.substring(F.replace(F.md5(F.col("event_id").cast("string")), F.lit("0"), F.lit("z")), 1, 20).alias("b58"),
        F.base64(F.col("event_type").cast("binary")).alias("b64"),
        F.hex("event_type").alias("hx"),
    )
    bad = F.concat(F.lit("0"), "b58")
    return texts.select(
        "event_id",
        hex_text(text_to_bytes(F.col("b58"), "base58")).alias("base58_hex"),
        hex_text(text_to_bytes(F.col("b64"), "base64")).alias("base64_hex"),
        hex_text(text_to_bytes(F.col("hx"), "hex")).alias("hex_hex"),
        text_to_bytes(bad, "base58").isNull().alias("bad_is_null"),
    )


@query(
    "heartbeat_decode",
    with_views(
        """
        SELECT signature, feed_partition, feed_offset, merkle_root, shard_count, node_pubkey
        FROM v_payload WHERE reason IS NULL
        """,
        "v_payload",
    ),
)
def heartbeat_decode(spark, d):
    rows = v_payload(spark, d).withColumn("payload", text_to_bytes(F.col("data"), "base64"))
    return decode.heartbeat_decode(rows).select(
        "signature", "feed_partition", "feed_offset", "merkle_root", "shard_count", "node_pubkey"
    )


@query(
    "match_discriminator",
    with_views(
        """
        SELECT signature, feed_partition, feed_offset, ix_index, program_id, table_name
        FROM v_ix JOIN v_catalog c USING (program_id) WHERE v_ix.name = c.name
        """,
        "v_ix",
        "v_catalog",
    ),
)
def match_discriminator(spark, d):
    """Only the payload's first eight bytes identify the instruction here."""
    calls = v_ix(spark, d).withColumn(
        "payload", F.unhex(F.concat(F.hex(idl.discriminator(F.col("name"))), F.lit("0102")))
    )
    known = v_catalog(spark, d).select(
        "program_id", "table_name", idl.discriminator(F.col("name")).alias("disc")
    )
    return decode.match_discriminator(calls.drop("name"), known).select(
        "signature", "feed_partition", "feed_offset", "ix_index", "program_id", "table_name"
    )


# Field name, type, Spark SQL of the value that is encoded, DuckDB SQL of the value expected.
_FIELDS = [
    ("f_u8", "u8", "l_linenumber", "l_linenumber"),
    ("f_i8", "i8", "l_linenumber - 4", "l_linenumber - 4"),
    ("f_u16", "u16", "l_partkey % 65536", "(l_partkey % 65536)::INT"),
    ("f_i16", "i16", "l_suppkey % 1000 - 500", "(l_suppkey % 1000 - 500)::INT"),
    ("f_u32", "u32", "(l_orderkey * 65537 + 2147483648) % 4294967296", "(l_orderkey * 65537 + 2147483648) % 4294967296"),
    ("f_i32", "i32", "(l_partkey - l_orderkey) % 2147483648", "((l_partkey - l_orderkey) % 2147483648)::INT"),
    ("f_u64", "u64", "-1 - l_orderkey", "(18446744073709551615::HUGEINT - l_orderkey)::VARCHAR"),
    ("f_i64", "i64", "-9223372036854775807 - 1 + l_orderkey", "-9223372036854775808 + l_orderkey"),
    ("f_u128", "u128", None, "(l_partkey::HUGEINT * 18446744073709551616 + l_orderkey)::VARCHAR"),
    ("f_i128", "i128", None, "(-(l_partkey::HUGEINT) * 18446744073709551616 - 1 - l_orderkey)::VARCHAR"),
    ("f_f64", "f64", None, "CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END"),
    ("f_f32", "f32", None, "l_quantity::FLOAT"),
    ("f_bool", "bool", "if(l_linestatus = 'O', 1, 0)", "l_linestatus = 'O'"),
    ("f_key", "publicKey", None, "lower(lpad(to_hex(l_partkey), 64, '0'))"),
]
_WIDTHS = {"u8": 1, "i8": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "u64": 8, "i64": 8, "bool": 1}


def _float_bits(bits: int, bias: int) -> str:
    """Spark SQL text: IEEE bits of the whole number ``l_quantity`` (1..50)."""
    power = "cast(floor(log2(l_quantity)) AS int)"
    fraction = f"cast((l_quantity / pow(2D, {power}) - 1D) * {1 << bits}D AS bigint)"
    return f"(shiftleft(cast({power} + {bias} AS bigint), {bits}) + {fraction})"


@query(
    "decode_fixed_fields",
    "SELECT 'TX' || l_orderkey || '-' || l_linenumber AS signature, l_partkey AS feed_partition, "
    "l_suppkey AS feed_offset, "
    + ", ".join(f"{expected} AS {name}" for name, _, _, expected in _FIELDS)
    + ", l_linenumber AS f_arr_last FROM lineitem",
)
def decode_fixed_fields(spark, d):
    """Encode line-item values as one payload, decode it back by its declared layout."""
    sign = "if(l_linestatus = 'O', 0L, -9223372036854775807L - 1L)"
    special = {
        "f_u128": f"concat({le_hex('l_orderkey', 8)}, {le_hex('l_partkey', 8)})",
        # -(p * 2^64) - 1 - o is the complement of p * 2^64 + o.
        "f_i128": f"concat({le_hex('-1 - l_orderkey', 8)}, {le_hex('-1 - l_partkey', 8)})",
        "f_f64": le_hex(f"({_float_bits(52, 1023)} | {sign})", 8),
        "f_f32": le_hex(_float_bits(23, 127), 4),
        "f_key": "lpad(hex(l_partkey), 64, '0')",
    }
    parts = [
        special.get(name) or le_hex(f"({value})", _WIDTHS[kind]) for name, kind, value, _ in _FIELDS
    ]
    payload = f"unhex(concat('0102030405060708', {', '.join(parts)}, '0000', {le_hex('l_linenumber', 1)}))"
    rows = table(spark, d, "lineitem").selectExpr(
        "concat('TX', l_orderkey, '-', l_linenumber) AS signature",
        "l_partkey AS feed_partition",
        "l_suppkey AS feed_offset",
        f"{payload} AS payload",
    )
    layout = [(name, kind) for name, kind, _, _ in _FIELDS] + [("f_arr", '{"array":["u8",3]}')]
    decoded = decode.decode_fixed(rows, layout)
    return (
        decoded.withColumn("f_u64", F.col("f_u64").cast("string"))
        .withColumn("f_arr_last", F.element_at("f_arr", 3))
        .drop("payload", "f_arr")
    )


@query(
    "sanitize_args",
    """
    SELECT l_orderkey AS row_key, l_linenumber, l_partkey, l_suppkey,
      (l_orderkey * 1000000007)::VARCHAR AS big, l_quantity AS plain,
      '{"wide":"' || (l_partkey * 1000000007) || '","flags":["' || l_suppkey || '","' || l_orderkey ||
        '"],"note":"' || l_returnflag || '"}' AS nested,
      CASE WHEN l_linenumber <> 2 THEN '["' || l_suppkey || '"]' END AS list
    FROM lineitem
    """,
)
def sanitize_args(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS row_key",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_orderkey * 1000000007 AS big",
        "l_quantity AS plain",
        "named_struct('wide', cast(l_partkey * 1000000007 AS decimal(20,0)), "
        "'flags', array(l_suppkey, l_orderkey), 'note', l_returnflag) AS nested",
        "if(l_linenumber = 2, NULL, array(l_suppkey)) AS list",
    )
    return decode.sanitize(rows, ["big", "plain", "nested", "list"])


def _decoded_notes(spark, d):
    return universal.decode_calls(v_note(spark, d), universal.catalog_layouts(v_idl(spark, d)))


_KNOWN = "NOT (l_partkey % 4 <> 1 AND l_partkey % 5 = 2) AND l_linenumber <> 7"
_SHORT_PROGRAM = "CASE WHEN l_partkey % 4 = 1 THEN 'File' ELSE 'Prog' END || l_partkey"
_NOTE_COLUMNS = """
  CASE WHEN l_linenumber = 6 THEN 'ix_submitheartbeat' ELSE 'ix_note' END AS table_name,
  CASE WHEN l_linenumber <> 6 THEN 'part ' || l_partkey || ' ' || l_returnflag END AS text,
  CASE WHEN l_linenumber <> 6 THEN l_partkey::VARCHAR END AS second_amount,
  CASE WHEN l_linenumber NOT IN (3, 6) THEN (l_suppkey % 65536)::INT END AS memo,
  CASE WHEN l_linenumber <> 6 AND l_linestatus = 'O' THEN (l_partkey * 4000000000)::VARCHAR END AS sell_price,
  CASE WHEN l_linenumber <> 6 THEN l_linenumber::BIGINT + 10 * ix_index END AS leg_size,
  CASE WHEN l_linenumber = 6 THEN l_orderkey END AS shard_count
"""


@query(
    "decode_layouts",
    with_views(
        f"""
        SELECT 'TX' || l_orderkey || '-' || l_linenumber AS signature, l_partkey AS feed_partition,
          l_suppkey AS feed_offset, ix_index, NULL::VARCHAR AS error, {_NOTE_COLUMNS}
        FROM v_note WHERE {_KNOWN}
        """,
        "v_note",
    ),
)
def decode_layouts(spark, d):
    """Base58 payloads decoded by the layouts of the parts' documents."""
    return _note_fields(_decoded_notes(spark, d), "signature", "feed_partition", "feed_offset", "ix_index", "error")


_ARGS = (
    "text string, amounts array<string>, memo int, "
    "leg struct<side:struct<Sell:struct<price:string>>,size:bigint>, shardCount bigint"
)


def _note_fields(decoded, *kept):
    return decode.typed_args(decoded.select(*kept, "table_name", "args"), _ARGS).select(
        *kept,
        "table_name",
        "text",
        F.get("amounts", F.lit(1)).alias("second_amount"),
        "memo",
        F.col("leg.side.Sell.price").alias("sell_price"),
        F.col("leg.size").alias("leg_size"),
        F.col("shardCount").alias("shard_count"),
    )


@query(
    "index_instructions",
    with_views(
        f"""
        SELECT 'TX' || l_orderkey || '-' || l_linenumber AS signature, ix_index,
          epoch_us(l_shipdate) // 400000 + l_orderkey % 1000 AS slot,
          CASE WHEN l_suppkey % 50 <> 0 THEN 'C' || (l_orderkey % 1000) ELSE 'Unknown' END AS signer,
          {_NOTE_COLUMNS}
        FROM v_note WHERE {_KNOWN}
        QUALIFY row_number() OVER (PARTITION BY signature, ix_index, table_name, {_SHORT_PROGRAM}
          ORDER BY slot, l_partkey, l_suppkey) = 1
        """,
        "v_note",
    ),
)
def index_instructions(spark, d):
    """The whole universal path: decode by document, envelope, first write per call and table,
    named argument columns. One in three transactions makes its call twice, and both are kept."""
    good = _decoded_notes(spark, d).filter("error IS NULL")
    first = dedup.insert_ignore(good, list(universal.KEYS), extract.ARRIVAL)
    return _note_fields(first, "signature", "ix_index", "slot", "signer")


@query(
    "universal_module_rows",
    with_views(
        f"""
        SELECT 'TX' || l_orderkey || '-' || l_linenumber AS signature, ix_index,
          epoch_us(l_shipdate) // 400000 + l_orderkey % 1000 AS slot, l_shipdate AS timestamp,
          CASE WHEN l_suppkey % 50 <> 0 THEN 'C' || (l_orderkey % 1000) ELSE 'Unknown' END AS signer,
          {_PART_PROGRAM.replace("p_partkey", "l_partkey")} AS program_id,
          CASE WHEN l_linenumber = 6 THEN 'submitheartbeat' ELSE 'note' END AS instruction,
          {_NOTE_COLUMNS}
        FROM v_note WHERE {_KNOWN}
        QUALIFY row_number() OVER (PARTITION BY signature, ix_index, table_name, program_id
          ORDER BY slot, l_partkey, l_suppkey) = 1
        """,
        "v_note",
    ),
)
def universal_module_rows(spark, d):
    """The rows that the universal module writes as one of the registry's modules, transactions in."""
    module = universal.universal_module(universal.catalog_layouts(v_idl(spark, d)))
    rows = extract.default_registry(module).extract(v_calls(spark, d))["instructions"]
    return _note_fields(rows, "signature", "ix_index", "slot", "timestamp", "signer", "program_id", "instruction")


@query(
    "replay_recent_indexed",
    f"""
    WITH v_note AS ({SQL["v_note"]}),
    calls AS (
      SELECT 'TX' || l_orderkey || '-' || l_linenumber AS signature, ix_index,
        epoch_us(l_shipdate) // 400000 + l_orderkey % 1000 AS slot, l_partkey, l_suppkey,
        {_SHORT_PROGRAM} AS p, {_NOTE_COLUMNS}
      FROM v_note WHERE {_KNOWN.replace(" AND l_linenumber <> 7", "")}),
    recent AS (
      SELECT p, signature FROM (SELECT p, signature, max(slot) AS slot FROM calls GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY p ORDER BY slot DESC, signature) <= 20)
    SELECT signature, ix_index, slot, table_name, text, memo, leg_size, shard_count FROM calls
    WHERE (p, signature) IN (SELECT (p, signature) FROM recent) AND NOT ends_with(signature, '-7')
    QUALIFY row_number() OVER (PARTITION BY signature, ix_index, table_name, p ORDER BY slot, l_partkey, l_suppkey) = 1
    """,
)
def replay_recent_indexed(spark, d):
    """The newest 20 transactions of every cataloged program, decoded and written once."""
    layouts = universal.catalog_layouts(v_idl(spark, d))
    calls = v_note(spark, d)
    recent = replay.recent_per_program(calls, universal.read_payloads(calls), programs=universal.programs(layouts))
    again = universal.decode_calls(recent, layouts).filter("error IS NULL")
    first = dedup.insert_ignore(again, list(universal.KEYS), extract.ARRIVAL)
    return _note_fields(first, "signature", "ix_index", "slot").select(
        "signature", "ix_index", "slot", "table_name", "text", "memo", "leg_size", "shard_count"
    )


_TYPED = "ix_note"


@query(
    "typed_instruction_table",
    f"""
    WITH v_note AS ({SQL["v_note"]})
    SELECT * EXCLUDE (table_name, second_amount, sell_price, leg_size, shard_count) FROM (
      SELECT 'TX' || l_orderkey || '-' || l_linenumber AS signature, l_partkey, {_NOTE_COLUMNS},
        CASE WHEN l_linenumber <> 6 THEN '[' || l_orderkey || ',' || l_partkey || ']' END AS amounts,
        '{{"side":' || CASE WHEN l_linestatus = 'O' THEN '{{"Sell":{{"price":"' || (l_partkey * 4000000000) || '"}}}}'
          ELSE '{{"Buy":{{}}}}' END || ',"size":' || (l_linenumber + 10 * ix_index) || '}}' AS leg
      FROM v_note WHERE {_KNOWN} AND l_linenumber <> 6)
    """,
)
def typed_instruction_table(spark, d):
    """The ``Note`` table with columns made from the generated schema of one program; every
    program's document declares the same ones."""
    schema = idl.ix_schema(idl.parse_documents(v_idl(spark, d))).filter(F.col("table_name") == _TYPED)
    program = schema.agg(F.min("program_id")).first()[0]
    rows = _decoded_notes(spark, d).filter(F.col("table_name") == _TYPED)
    ddl = universal.typed_schema(schema, program, _TYPED)
    typed = universal.typed_table(rows.select("signature", F.col("feed_partition").alias("l_partkey"), "args"), ddl)
    nested = {"amounts": F.to_json("amounts")} if dict(typed.dtypes)["amounts"].startswith("array") else {}
    return typed.withColumns(nested).select("signature", "l_partkey", "text", "memo", "amounts", "leg")


@query(
    "log_filter_args",
    f"""
    WITH v_note AS ({SQL["v_note"]})
    SELECT 'TX' || l_orderkey || '-' || l_linenumber AS signature, l_partkey AS feed_partition,
      l_suppkey AS feed_offset, memo, text FROM (SELECT *, {_NOTE_COLUMNS} FROM v_note WHERE {_KNOWN})
    WHERE table_name = 'ix_note' AND memo = 7
    """,
)
def log_filter_args(spark, d):
    """Argument columns filter by their declared type; a name that is no column is ignored."""
    rows = _decoded_notes(spark, d).filter(F.col("table_name") == _TYPED)
    ddl = "text STRING, amounts STRING, memo INT, leg STRING"
    typed = universal.typed_table(rows.drop("error", "layout"), ddl)
    return paging.equality_filters(typed, {"memo": "7", "1=1; --": "x"}).select(
        "signature", "feed_partition", "feed_offset", "memo", "text"
    )


@query(
    "base58_round_trip",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, lower(lpad(to_hex(l_partkey), 16, '0') || "
    "lpad(to_hex(l_orderkey), 16, '0')) AS bytes_hex FROM lineitem",
)
def base58_round_trip(spark, d):
    raw = F.unhex(F.concat(F.lpad(F.hex("l_partkey"), 16, "0"), F.lpad(F.hex("l_orderkey"), 16, "0")))
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        hex_text(text_to_bytes(bytes_to_base58(raw), "base58")).alias("bytes_hex"),
    )
