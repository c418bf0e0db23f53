"""Views that carry the engine's inputs onto the given tables.

Each view has a Spark builder and the same rows as a DuckDB common table expression, so
every query has an independent oracle. All views are row-local and each grows with its table.
Only the documents are spread first: a part is a few bytes in its file, and a few kilobytes of
text with much work behind it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ixlake import constants as K
from ixlake.functions.base58 import bytes_to_base58
from ixlake.operators.decode import HEARTBEAT_HEX
from ixlake.operators.idl import discriminator
from ixlake.operators.ingest import explode_instructions
from ixlake.sources.tables import spread, table


def with_views(body: str, *views: str, recursive: bool = False) -> str:
    """A DuckDB statement over the named views, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{v} AS ({SQL[v].strip()})" for v in ordered) + "\n" + body.strip()


NEEDS = {"v_ix": ("v_tx",), "v_payload": ("v_hb",), "v_note": (), "v_refs": ("v_idl",), "v_args": ("v_idl",)}
SQL: dict[str, str] = {}


def program_of(key: str) -> str:
    """SQL text, valid in both engines: one of four shared programs, else one per key."""
    lending_a, lending_b = K.LENDING_PROGRAMS
    return (
        f"CASE {key} % 10 WHEN 0 THEN '{lending_a}' WHEN 1 THEN '{lending_b}' "
        f"WHEN 2 THEN '{K.PROOF_PROGRAM}' WHEN 3 THEN '{K.ASSET_PROGRAM}' "
        f"ELSE concat('P', {key}) END"
    )


# --- log -------------------------------------------------------------------------------

def v_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "concat('SIG', lpad(cast(event_id AS string), 12, '0')) AS signature",
        "unix_micros(cast(ts AS timestamp)) DIV 400000 AS slot",
        "ts",
        "concat('P', user_id % 4) AS program_id",
        "event_type AS instruction",
        "concat('U', user_id) AS signer",
        "props AS args",
        "value",
    )


SQL["v_log"] = """
SELECT 'SIG' || lpad(event_id::VARCHAR, 12, '0') AS signature, epoch_us(ts) // 400000 AS slot, ts,
  'P' || (user_id % 4) AS program_id, event_type AS instruction, 'U' || user_id AS signer,
  props AS args, value
FROM events
"""


def v_log_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Log catalog: per user bucket the event names seen, and one name never called."""
    names = v_log(spark, d).select("program_id", "instruction").distinct()
    idle = names.select("program_id", F.lit("refund").alias("instruction")).distinct()
    return names.unionByName(idle).withColumn("table_name", F.concat(F.lit("ix_"), "instruction"))


SQL["v_log_catalog"] = """
SELECT DISTINCT program_id, unnest([instruction, 'refund']) AS instruction FROM v_log
"""
NEEDS["v_log_catalog"] = ("v_log",)


# --- transactions ----------------------------------------------------------------------

_NAME_0 = (
    "CASE l_returnflag WHEN 'R' THEN 'LiquidateObligation' WHEN 'A' THEN 'CreateAndMint' "
    "ELSE 'Deposit' END"
)
_NAME_1 = "CASE l_linestatus WHEN 'O' THEN 'flashLiquidate' ELSE 'Withdraw' END"


def v_tx(spark: SparkSession, d: str) -> DataFrame:
    """One transaction per line item; equal signatures are replays in feed order."""

    def element(program: str, name: str, amount: str) -> str:
        return (
            f"named_struct('programId', {program_of(program)}, 'name', {name}, "
            f"'data', if({amount} % 7 = 0, NULL, concat('{{\"repaidAmount\":', {amount}, '}}')), "
            "'accounts', if(l_linenumber = 3, array(concat('A', l_orderkey)), "
            "array(concat('A', l_orderkey), concat('B', l_linenumber), concat('N', l_suppkey))))"
        )

    first = element("l_suppkey", _NAME_0, "l_partkey")
    second = element("l_partkey", _NAME_1, "l_partkey")
    third = element("l_suppkey", _NAME_0, "l_suppkey")
    instructions = (
        "CASE WHEN l_partkey % 40 = 0 THEN NULL "
        f"WHEN l_partkey % 40 = 1 THEN slice(array({first}), 1, 0) "
        f"WHEN l_linenumber % 6 = 0 THEN array({first}, {second}, {third}) "
        f"WHEN l_linenumber % 2 = 0 THEN array({first}, {second}) ELSE array({first}) END"
    )
    return table(spark, d, "lineitem").selectExpr(
        "concat('TX', l_orderkey, '-', l_linenumber) AS signature",
        "unix_micros(cast(l_shipdate AS timestamp)) DIV 400000 + l_orderkey % 1000 AS slot",
        "l_shipdate AS ts",
        "CASE l_suppkey % 50 WHEN 0 THEN NULL WHEN 1 THEN '' "
        "ELSE concat('C', l_orderkey % 1000) END AS fee_payer",
        "CASE l_linenumber WHEN 4 THEN NULL WHEN 5 THEN '' ELSE "
        "concat('Moved ', cast(l_quantity AS bigint), ' units of part ', l_partkey) END AS description",
        "l_partkey AS feed_partition",
        "l_suppkey AS feed_offset",
        f"{instructions} AS instructions",
    )


SQL["v_tx"] = """
SELECT 'TX' || l_orderkey || '-' || l_linenumber AS signature,
  epoch_us(l_shipdate) // 400000 + l_orderkey % 1000 AS slot, l_shipdate AS ts,
  CASE l_suppkey % 50 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'C' || (l_orderkey % 1000) END AS fee_payer,
  CASE l_linenumber WHEN 4 THEN NULL WHEN 5 THEN ''
    ELSE 'Moved ' || l_quantity::BIGINT || ' units of part ' || l_partkey END AS description,
  l_partkey AS feed_partition, l_suppkey AS feed_offset,
  l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus
FROM lineitem
"""


def v_ix(spark: SparkSession, d: str) -> DataFrame:
    return explode_instructions(v_tx(spark, d))


_IX_COLUMNS = "signature, slot, ts, fee_payer, description, feed_partition, feed_offset, l_orderkey, l_linenumber, l_suppkey"
SQL["v_ix"] = f"""
SELECT {_IX_COLUMNS}, 0 AS ix_index, {program_of('l_suppkey')} AS program_id, {_NAME_0} AS name,
  CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END AS repaid FROM v_tx WHERE l_partkey % 40 > 1
UNION ALL
SELECT {_IX_COLUMNS}, 1, {program_of('l_partkey')}, {_NAME_1},
  CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END FROM v_tx WHERE l_partkey % 40 > 1 AND l_linenumber % 2 = 0
UNION ALL
SELECT {_IX_COLUMNS}, 2, {program_of('l_suppkey')}, {_NAME_0},
  CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END FROM v_tx WHERE l_partkey % 40 > 1 AND l_linenumber % 6 = 0
"""


def v_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Programs of the suppliers with their instructions; some programs lack ``Deposit``."""
    return (
        table(spark, d, "supplier")
        .selectExpr(
            f"{program_of('s_suppkey')} AS program_id",
            "s_suppkey % 10 > 3 AND s_suppkey % 7 = 0 AS partial",
            "explode(array('LiquidateObligation', 'CreateAndMint', 'Deposit', 'Withdraw')) AS name",
        )
        .filter("NOT (partial AND name = 'Deposit')")
        .select(
            "program_id",
            F.concat(F.lit("idl-"), "program_id").alias("idl_name"),
            "name",
            F.lower("name").alias("instruction"),
            F.concat(F.lit("ix_"), F.lower("name")).alias("table_name"),
        )
        .distinct()
    )


SQL["v_catalog"] = f"""
SELECT DISTINCT program_id, 'idl-' || program_id AS idl_name, name, lower(name) AS instruction,
  'ix_' || lower(name) AS table_name
FROM (SELECT {program_of('s_suppkey')} AS program_id, s_suppkey,
        unnest(['LiquidateObligation', 'CreateAndMint', 'Deposit', 'Withdraw']) AS name FROM supplier)
WHERE NOT (s_suppkey % 10 > 3 AND s_suppkey % 7 = 0 AND name = 'Deposit')
"""


# --- heartbeats ------------------------------------------------------------------------

def v_hb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "lower(lpad(hex(l_partkey), 64, '0')) AS merkle_root",
        "concat('N', l_suppkey) AS node_pubkey",
        "cast(l_linenumber AS bigint) AS shard_count",
        "CASE l_linestatus WHEN 'O' THEN 'ONLINE' ELSE 'OFFLINE' END AS status",
        "l_shipdate AS ts",
        "l_orderkey AS feed_partition",
        "l_linenumber AS feed_offset",
    )


SQL["v_hb"] = """
SELECT lower(lpad(to_hex(l_partkey), 64, '0')) AS merkle_root, 'N' || l_suppkey AS node_pubkey,
  l_linenumber::BIGINT AS shard_count,
  CASE l_linestatus WHEN 'O' THEN 'ONLINE' ELSE 'OFFLINE' END AS status, l_shipdate AS ts,
  l_orderkey AS feed_partition, l_linenumber AS feed_offset, l_partkey, l_suppkey
FROM lineitem
"""

HB_ORDER = ["ts", "feed_partition", "feed_offset"]


def le_hex(number: str, width: int) -> str:
    """Spark SQL text: hex of the little-endian bytes of an integer (two's complement).

    Its bytes change places in pairs, fours and halves, as whole numbers and not as text.
    """
    swapped = f"cast({number} AS bigint)"
    for bits, mask in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        swapped = f"(shiftleft({swapped} & {mask}L, {bits}) | (shiftright({swapped}, {bits}) & {mask}L))"
    swapped = f"(shiftleft({swapped}, 32) | shiftrightunsigned({swapped}, 32))"
    return f"substr(lpad(hex({swapped}), 16, '0'), 1, {2 * width})"


_SHARDS = "(l_orderkey * 65537 + l_linenumber) % 4294967296"


def v_payload(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeat payloads as base64 text, one in ten of each defect of the payload."""
    wrong = HEARTBEAT_HEX[:4] + "19" + HEARTBEAT_HEX[6:]
    disc = f"if(l_partkey % 10 = 1, '{wrong}', '{HEARTBEAT_HEX}')"
    full = f"concat({disc}, lpad(hex(l_partkey), 64, '0'), {le_hex(_SHARDS, 4)})"
    body = f"CASE l_partkey % 10 WHEN 0 THEN substr({full}, 1, 86) WHEN 3 THEN concat({full}, '00') ELSE {full} END"
    return table(spark, d, "lineitem").selectExpr(
        "concat('TX', l_orderkey, '-', l_linenumber) AS signature",
        "l_partkey AS feed_partition",
        "l_suppkey AS feed_offset",
        f"if(l_partkey % 10 = 2, '@@@', base64(unhex({body}))) AS data",
        "if(l_linenumber = 7, array('x', 'y'), array('x', 'y', concat('N', l_suppkey))) AS accounts",
    )


SQL["v_payload"] = """
SELECT 'TX' || l_orderkey || '-' || l_linenumber AS signature, l_partkey AS feed_partition,
  l_suppkey AS feed_offset, lower(lpad(to_hex(l_partkey), 64, '0')) AS merkle_root,
  (l_orderkey * 65537 + l_linenumber) % 4294967296 AS shard_count,
  CASE l_linenumber WHEN 7 THEN 'Unknown' ELSE 'N' || l_suppkey END AS node_pubkey,
  CASE l_partkey % 10 WHEN 0 THEN 'payload_too_short' WHEN 1 THEN 'wrong_discriminator'
    WHEN 2 THEN 'bad_payload_text' END AS reason
FROM lineitem
"""
NEEDS["v_payload"] = ()


# --- assets ----------------------------------------------------------------------------

def v_asset(spark: SparkSession, d: str) -> DataFrame:
    """Assets with two traits; some have an empty list and some none at all."""
    return table(spark, d, "part").selectExpr(
        "concat('M', p_partkey) AS mint",
        "p_brand AS collection",
        "CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE slice(array(named_struct('trait', 'type', 'value', p_type), "
        "named_struct('trait', 'size', 'value', cast(p_size AS string))), 1, if(p_partkey % 43 = 0, 0, 2)) END AS traits",
    )


SQL["v_asset"] = """
SELECT 'M' || p_partkey AS mint, p_brand AS collection,
  CASE WHEN p_partkey % 41 <> 0 AND p_partkey % 43 <> 0 THEN p_type END AS type_trait,
  CASE WHEN p_partkey % 41 <> 0 AND p_partkey % 43 <> 0 THEN p_size::VARCHAR END AS size_trait FROM part
"""

SQL["v_score"] = """
SELECT mint, collection, CASE WHEN type_trait IS NULL THEN 0
  ELSE count(*) OVER c / count(*) OVER t + count(*) OVER c / count(*) OVER s END AS rarity_score
FROM v_asset WINDOW c AS (PARTITION BY collection), t AS (PARTITION BY collection, type_trait),
  s AS (PARTITION BY collection, size_trait)
"""
NEEDS["v_score"] = ("v_asset",)


# --- interface descriptions ------------------------------------------------------------

_EVERY_TYPE = ",".join(f'{{"name":"a_{t}","type":"{t}"}}' for t in K.SCALAR_TYPES)

TEMPLATE = (
    '{"name":"prog_@KEY@",@ADDRESS@"instructions":['
    '{"name":"submitHeartbeat","args":[{"name":"merkleRoot","type":{"array":["u8",32]}},'
    '{"name":"shardCount","type":"u32"}]},'
    '{"name":"Note","args":[{"name":"text","type":"string"},{"name":"amounts","type":{"vec":"u64"}},'
    '{"name":"memo","type":{"option":"u16"}},{"name":"leg","type":{"defined":"Leg"}}]},'
    '{"name":"set@TYPE@","args":[{"name":"slot","type":"u64"},{"name":"Signature","type":"publicKey"},'
    '{"name":"padding","type":"u8"},{"name":"padding","type":{"array":["u8",@SIZE@]}},'
    '{"name":"padding_1","type":"u16"},{"name":"PADDING","type":"bytes"},'
    '{"name":"@NAME@","type":{"option":{"vec":{"defined":{"name":"@TYPE@Cfg"}}}}}]},'
    '{"name":"everything","args":[' + _EVERY_TYPE + "]}],"
    '"accounts":[{"name":"Vault@TYPE@","type":{"kind":"struct","fields":[{"name":"slot","type":"u64"},'
    '{"name":"owner","type":"publicKey"},{"name":"Owner","type":{"vec":{"vec":"u8"}}}]}}],'
    '"types":[{"name":"Leg","type":{"kind":"struct","fields":[{"name":"side","type":{"defined":"Side"}},'
    '{"name":"size","type":"u32"}]}},'
    '{"name":"Side","type":{"kind":"enum","variants":[{"name":"Buy"},'
    '{"name":"Sell","fields":[{"name":"price","type":"u64"}]},'
    '{"name":"Swap","fields":["u8",{"defined":"Gone@SIZE@"}]}]}},'
    '{"name":"ECONOMYCfg","type":{"kind":"struct","fields":[{"name":"x","type":{"defined":"Missing@SIZE@"}},'
    '{"name":"m","type":{"hashMap":["u8","u8"]}}]}}],'
    '"events":[{"name":"Filled","fields":[{"name":"by","type":"publicKey"},'
    '{"name":"path","type":{"option":{"array":[{"defined":"Hop"},3]}}}]}]}'
)

# SQL texts valid in both engines.
_PART_PROGRAM = (
    "CASE WHEN p_partkey % 4 = 1 THEN concat('File', lpad(cast(p_partkey AS varchar(20)), 36, 'y')) "
    "WHEN p_partkey % 5 = 2 THEN concat('short', p_partkey) "
    "ELSE concat('Prog', lpad(cast(p_partkey AS varchar(20)), 36, 'x')) END"
)
_PART_ADDRESS = f"CASE WHEN p_partkey % 4 = 1 THEN '' ELSE concat('\"address\":\"', {_PART_PROGRAM}, '\",') END"
_PART_PATH = f"concat('/idl/', CASE WHEN p_partkey % 4 = 1 THEN {_PART_PROGRAM} ELSE concat('doc', p_partkey) END, '.json')"
_PART_MARKS = {
    "@KEY@": "cast(p_partkey AS varchar(20))",
    "@ADDRESS@": _PART_ADDRESS,
    "@TYPE@": "p_type",
    "@SIZE@": "cast(p_size AS varchar(20))",
    "@NAME@": "replace(p_name, ' ', '_')",
}
_PART_TEXT = f"'{TEMPLATE}'"
for _mark, _value in _PART_MARKS.items():
    _PART_TEXT = f"replace({_PART_TEXT}, '{_mark}', {_value})"
# The same text for Spark, its pieces put together in one pass instead of five searches of the whole text.
_PART_PIECES = ", ".join(
    _PART_MARKS.get(piece) or f"'{piece}'" for piece in re.split(f"({'|'.join(_PART_MARKS)})", TEMPLATE) if piece
)


def v_idl(spark: SparkSession, d: str) -> DataFrame:
    """One description document per part, as ``(path, text)``."""
    parts = spread(table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_name"))
    return parts.selectExpr(f"{_PART_PATH} AS path", f"concat({_PART_PIECES}) AS text")


SQL["v_idl"] = f"""
SELECT coalesce(nullif(text ->> '$.address', ''), regexp_extract(path, '([^/]+)\\.json$', 1)) AS program_id,
  text ->> '$.name' AS idl_name, text
FROM (SELECT {_PART_PATH} AS path, ({_PART_TEXT})::JSON AS text FROM part)
WHERE length(coalesce(nullif(text ->> '$.address', ''), regexp_extract(path, '([^/]+)\\.json$', 1))) >= 32
"""

_PLAIN = "CASE json_type({0}) WHEN 'VARCHAR' THEN {0} ->> '$' ELSE {0}::VARCHAR END"

SQL["v_args"] = f"""
SELECT program_id, ix_name, pos, arg ->> '$.name' AS field_name, {_PLAIN.format("(arg -> '$.type')")} AS field_type
FROM (SELECT program_id, ix ->> '$.name' AS ix_name, unnest((ix -> '$.args')::JSON[]) AS arg,
        generate_subscripts((ix -> '$.args')::JSON[], 1) AS pos
      FROM (SELECT program_id, unnest((text -> '$.instructions')::JSON[]) AS ix FROM v_idl))
"""


def _raw_calls(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with the bytes of their first call and, in one of three, of a second one."""
    text = "concat('part ', l_partkey, ' ', l_returnflag)"
    side = f"if(l_linestatus = 'O', concat('01', {le_hex('l_partkey * 4000000000', 8)}), '00')"
    beat = f"concat(lpad(hex(l_partkey), 64, '0'), {le_hex('l_orderkey', 4)})"
    note = (
        f"concat({le_hex(f'length({text})', 4)}, hex({text}), '02000000', "
        f"{le_hex('l_orderkey', 8)}, {le_hex('l_partkey', 8)}, "
        f"if(l_linenumber = 3, '00', concat('01', {le_hex('l_suppkey', 2)})), {side})"
    )

    def disc(name: str) -> Column:
        return F.hex(discriminator(F.lit(name)))

    def raw(size: str) -> str:
        return f"unhex(concat(_head, _body, if(l_linenumber = 6, '', {le_hex(size, 4)})))"

    head = (
        F.when(F.expr("l_linenumber = 7"), F.lit("0000000000000000"))
        .when(F.expr("l_linenumber = 6"), disc("submitHeartbeat"))
        .otherwise(disc("Note"))
    )
    return (
        table(spark, d, "lineitem")
        .withColumns({"_head": head, "_body": F.expr(f"if(l_linenumber = 6, {beat}, {note})")})
        .selectExpr(
            "concat('TX', l_orderkey, '-', l_linenumber) AS signature",
            "unix_micros(cast(l_shipdate AS timestamp)) DIV 400000 + l_orderkey % 1000 AS slot",
            "l_shipdate AS ts",
            "CASE l_suppkey % 50 WHEN 0 THEN NULL ELSE concat('C', l_orderkey % 1000) END AS fee_payer",
            "cast(NULL AS string) AS description",
            "l_partkey AS feed_partition",
            "l_suppkey AS feed_offset",
            f"{_PART_PROGRAM.replace('p_partkey', 'l_partkey')} AS program_id",
            f"{raw('l_linenumber')} AS once",
            f"if(l_partkey % 3 = 0, {raw('l_linenumber + 10')}, NULL) AS twice",
        )
    )


def _with_instructions(calls: DataFrame) -> DataFrame:
    """The list of the calls that are there; by cases, since a filter with a lambda isn't compiled."""
    call = "named_struct('programId', program_id, 'name', cast(NULL AS string), 'data', {}, 'accounts', cast(array() AS array<string>))"
    once, twice = call.format("once"), call.format("twice")
    listed = (
        f"CASE WHEN once IS NOT NULL AND twice IS NOT NULL THEN array({once}, {twice}) WHEN once IS NOT NULL THEN array({once}) "
        f"WHEN twice IS NOT NULL THEN array({twice}) ELSE slice(array({once}), 1, 0) END"
    )
    return calls.withColumn("instructions", F.expr(listed)).drop("once", "twice", "program_id")


def v_calls(spark: SparkSession, d: str) -> DataFrame:
    """Transactions of ``Note`` and ``submitHeartbeat`` calls on the parts' programs, payload in base58.

    One in three transactions makes its call twice; the second one differs in the size of its leg.
    """
    texts = {"once": bytes_to_base58(F.col("once")), "twice": bytes_to_base58(F.col("twice"))}
    return _with_instructions(_raw_calls(spark, d).withColumns(texts))


def v_note(spark: SparkSession, d: str) -> DataFrame:
    """The calls of :func:`v_calls`, one a row; their bytes become texts where these are asked for."""
    calls = explode_instructions(_with_instructions(_raw_calls(spark, d)))
    return calls.withColumn("data", bytes_to_base58(F.col("data"))).drop("name", "accounts", "description")


SQL["v_note"] = """
SELECT *, unnest(range(CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 1 END))::INT AS ix_index FROM lineitem
"""


def v_launch(spark: SparkSession, d: str) -> DataFrame:
    """Launches: one per part."""
    return table(spark, d, "part").selectExpr(
        "concat('LAUNCH', lpad(cast(p_partkey AS string), 12, '0')) AS signature",
        "p_partkey AS slot",
        "if(p_partkey % 3 = 0, '', p_name) AS name",
        "if(p_partkey % 4 = 0, NULL, upper(substr(p_type, 1, 3))) AS symbol",
        "if(p_partkey % 5 = 0, NULL, concat(p_brand, '-', p_partkey)) AS creator",
        "if(p_partkey % 3 = 1, NULL, concat(p_brand, '/vault')) AS platform_vault",
        "if(p_partkey % 4 = 2, NULL, concat(p_brand, '/share')) AS fee_share_authority",
    )


SQL["v_launch"] = """
SELECT 'LAUNCH' || lpad(p_partkey::VARCHAR, 12, '0') AS signature, p_partkey AS slot,
  CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '' END AS name,
  CASE WHEN p_partkey % 4 <> 0 THEN upper(substr(p_type, 1, 3)) END AS symbol,
  CASE WHEN p_partkey % 5 <> 0 THEN p_brand || '-' || p_partkey END AS creator,
  CASE WHEN p_partkey % 3 <> 1 THEN p_brand || '/vault' END AS platform_vault,
  CASE WHEN p_partkey % 4 <> 2 THEN p_brand || '/share' END AS fee_share_authority
FROM part
"""


def v_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals with real repeats inside and outside 24 hours."""
    return table(spark, d, "events").selectExpr(
        "concat(user_id, '/', event_type) AS key", "ts", "event_id"
    )
