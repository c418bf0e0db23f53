"""Edge cases on small fixtures, brute force where a rule is sequential."""

import datetime as dt
import json
import random
import struct

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ixlake import constants as K
from ixlake.functions import base58
from ixlake.functions.binary import text_to_bytes
from ixlake.functions.text import number_label, or_default, parse_int, short_id
from ixlake.operators import (
    aggregates,
    decode,
    dedup,
    extract,
    idl,
    ingest,
    monitor,
    paging,
    replay,
    state,
    universal,
)
from ixlake.plans.views import _PART_PATH, _PART_TEXT, le_hex, v_idl, v_note
from ixlake.sources.transactions import judge_batches, normalise, parse_batches, read_json
from ixlake.sources.tables import write_log

# Known vectors and sample texts of the formats under test.
HB = bytes(K.HEARTBEAT_DISCRIMINATOR)
LENDING = K.LENDING_PROGRAMS[0]


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


# --- text ------------------------------------------------------------------------------

def test_base58_known_vectors():
    assert base58.encode(b"Hello World!") == "2NEpo7TZRRrLZSi2U"
    decoded = base58.decode_series(pd.Series(["2NEpo7TZRRrLZSi2U", "11", "", "0", None]))
    assert list(decoded) == [b"Hello World!", b"\0\0", b"", None, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=20))
def test_base58_round_trip(values):
    texts = [base58.encode(v) for v in values]
    assert list(base58.decode_series(pd.Series(texts, dtype=object))) == values


def test_text_helpers(spark):
    df = spark.createDataFrame([("", 1234567.50001), (None, 12.0), ("abcdefghij", 0.12349)], "s string, n double")
    got = rows(df.select(or_default(F.col("s"), "d"), short_id(F.col("s")), number_label(F.col("n").cast("string"))))
    assert got == [("d", "-", "1,234,567.5"), ("d", "-", "12"), ("abcdefghij", "abcdefgh...", "0.1235")]


@pytest.mark.parametrize(
    "limit, offset, expected",
    [(None, None, (100, 0)), ("0", "x", (0, 0)), (-1, -5, (0, 0)), (10**6, "7abc", (1000, 7)), ("12.9", 3, (12, 3))],
)
def test_page_clamp(limit, offset, expected):
    assert paging.clamp_page(limit, offset, *K.LOG_PAGE) == expected
    assert parse_int("nope", 4) == 4


# --- decode ----------------------------------------------------------------------------

def test_heartbeat_edges(spark):
    body = HB + bytes(range(32)) + struct.pack("<I", 2**31 + 5)
    payloads = [
        ("ok", body, ["a", "b", "node"]),
        ("trailing", body + b"x", ["a", "b"]),
        ("short", body[:43], ["a", "b", "c"]),
        ("wrong", body[:2] + b"\x19" + body[3:], ["a", "b", "c"]),
        ("none", None, ["a", "b", "c"]),
    ]
    df = spark.createDataFrame(payloads, "id string, payload binary, accounts array<string>")
    got = {r.id: r for r in decode.heartbeat_decode(df).collect()}
    assert set(got) == {"ok", "trailing"}
    assert got["ok"].shard_count == 2**31 + 5 and got["ok"].node_pubkey == "node"
    assert got["ok"].merkle_root == bytes(range(32)).hex()
    assert got["trailing"].node_pubkey == "Unknown"
    judged = ingest.with_reason(df, decode.heartbeat_checks(F.col("payload")))
    assert dict(rows(judged, "id", "reason")) == {
        "ok": None, "trailing": None, "short": "payload_too_short",
        "wrong": "wrong_discriminator", "none": "bad_payload_text",
    }


def test_bad_payload_texts(spark):
    df = spark.createDataFrame([("@@@", "zz", "0Il")], "b64 string, hx string, b58 string")
    got = df.select(
        text_to_bytes(F.col("b64"), "base64"), text_to_bytes(F.col("hx"), "hex"), text_to_bytes(F.col("b58"), "base58")
    ).first()
    assert tuple(got) == (None, None, None)


LAYOUT = [
    ("a", "u64"), ("b", "i64"), ("c", "i32"), ("d", "u128"), ("e", "i128"), ("f", "f64"), ("g", "f32"),
    ("h", "i8"), ("i", "bool"), ("j", "u32"), ("k", '{"array":["u8",2]}'), ("l", "publicKey"),
]


def encode(v):
    return (
        b"discrimi" + struct.pack("<QqI", v["a"], v["b"], v["c"] & 0xFFFFFFFF)
        + v["d"].to_bytes(16, "little") + v["e"].to_bytes(16, "little", signed=True)
        + struct.pack("<dfb?I", v["f"], v["g"], v["h"], v["i"], v["j"]) + bytes(v["k"]) + bytes.fromhex(v["l"])
    )


def test_fixed_layout_extremes_and_random(spark):
    rnd = random.Random(7)
    key = "ab" * 32
    cases = [
        dict(a=2**64 - 1, b=-(2**63), c=-5, d=2**128 - 1, e=-(2**127), f=float("inf"), g=-0.5, h=-128, i=True, j=2**32 - 1, k=[0, 255], l=key),
        dict(a=0, b=2**63 - 1, c=2**31 - 1, d=0, e=2**127 - 1, f=5e-324, g=0.0, h=127, i=False, j=0, k=[1, 2], l=key),
        dict(a=10**19, b=-1, c=-(2**31), d=10**38, e=-(10**38), f=-1.7976931348623157e308, g=1.5, h=0, i=True, j=1, k=[9, 9], l=key),
    ]
    for _ in range(60):
        cases.append(dict(
            a=rnd.getrandbits(64), b=rnd.getrandbits(64) - 2**63, c=rnd.getrandbits(32) - 2**31,
            d=rnd.getrandbits(rnd.choice([10, 64, 70, 128])), e=rnd.getrandbits(128) - 2**127,
            f=rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-300, 300), g=struct.unpack("<f", struct.pack("<f", rnd.uniform(-9, 9)))[0],
            h=rnd.randint(-128, 127), i=rnd.random() < 0.5, j=rnd.getrandbits(32), k=[rnd.randrange(256)] * 2, l=key))
    df = spark.createDataFrame([(n, encode(c)) for n, c in enumerate(cases)], "n int, payload binary")
    for row in decode.decode_fixed(df, LAYOUT).collect():
        case = cases[row.n]
        for name, value in case.items():
            got = row[name]
            expected = str(value) if name in "de" else value
            assert (int(got) if name == "a" else got) == expected, (row.n, name)


def test_truncated_fixed_payload_is_null(spark):
    df = spark.createDataFrame([(b"discrimi\x01\x02",)], "payload binary")
    got = decode.decode_fixed(df, [("x", "u8"), ("y", "u32"), ("z", "u128")]).first()
    assert (got.x, got.y, got.z) == (1, None, None)


def test_variable_layout(spark):
    program = "Q" * 40
    document = {
        "name": "n", "address": program,
        "instructions": [{"name": "doIt", "args": [
            {"name": "slot", "type": "u64"}, {"name": "s", "type": "string"}, {"name": "v", "type": {"vec": {"option": "i128"}}},
            {"name": "e", "type": {"defined": "E"}}, {"name": "t", "type": {"defined": {"name": "T"}}}]}],
        "types": [
            {"name": "E", "type": {"kind": "enum", "variants": [{"name": "A"}, {"name": "B", "fields": ["u8", {"defined": "T"}]}]}},
            {"name": "T", "type": {"kind": "struct", "fields": [{"name": "on", "type": "bool"}, {"name": "kids", "type": {"vec": {"defined": "T"}}}]}},
            {"name": "Unused", "type": {"kind": "struct", "fields": []}}],
    }
    docs = spark.createDataFrame([("/x/y.json", json.dumps(document)), ("/x/bad.json", "{oops")], "path string, text string")
    layouts = idl.layouts(idl.parse_documents(docs))
    found = layouts.first()
    assert "Unused" not in found.layout and json.loads(found.layout)["columns"][0] == "slot_1"
    node = lambda on, *kids: bytes([on]) + struct.pack("<I", len(kids)) + b"".join(kids)
    args = (
        struct.pack("<Q", 2**64 - 1) + struct.pack("<I", 3) + "hé".encode()
        + struct.pack("<I", 2) + b"\0" + b"\x01" + (-(2**127)).to_bytes(16, "little", signed=True)
        + b"\x01\x07" + node(1) + node(0, node(1))
    )
    df = spark.createDataFrame(
        [(1, program, bytes(found.disc) + args), (2, program, bytes(found.disc) + args[:9]), (3, program, b"nomatch!" + args)],
        "id int, program_id string, payload binary",
    )
    matched = decode.match_discriminator(df, layouts).select("id", "payload", "layout")
    got = {r.id: r for r in decode.decode_layouts(matched).collect()}
    assert set(got) == {1, 2}
    assert json.loads(got[1].args) == {
        "slot_1": str(2**64 - 1), "s": "hé", "v": [None, str(-(2**127))],
        "e": {"B": {"0": 7, "1": {"on": True, "kids": []}}}, "t": {"on": False, "kids": [{"on": True, "kids": []}]},
    }
    assert got[2].args is None and got[2].error == "payload too short"


# --- IDL -------------------------------------------------------------------------------

def test_column_names_are_unique_and_keep_first_uses(spark):
    rnd = random.Random(3)
    pool = ["slot", "Slot", "slot_1", "x", "X", "x_1", "X_2", "padding", "signer"]
    cases = [[rnd.choice(pool) for _ in range(rnd.randint(0, 12))] for _ in range(80)] + [["padding"] * 50]
    reserved = tuple(n for n, _ in K.IX_ENVELOPE)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, names array<string>")
    for i, got in rows(df.select("i", idl.resolve_names(F.col("names"), reserved))):
        assert len(got) == len(cases[i])
        taken = list(map(str.lower, reserved))
        assert len({*taken, *map(str.lower, got)}) == len(taken) + len(got)
        for name, column in zip(cases[i], got, strict=True):
            if name.lower() not in taken:
                assert column == name
            else:
                number = int(column.removeprefix(f"{name}_"))
                assert all(f"{name}_{n}".lower() in taken for n in range(1, number))
            taken.append(column.lower())


def documents(spark, *bodies):
    rows_ = [(f"/idl/{i}.json", b if isinstance(b, str) else json.dumps(b), dt.datetime(2024, 1, 1 + i)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows_, "path string, text string, modified timestamp")


def test_tuple_structs_are_accepted_and_bad_documents_kept_apart(spark):
    good = {
        "address": "A" * 40,
        "instructions": [{"name": "go", "args": [{"name": "p", "type": {"defined": "Pair"}}]}],
        "types": [{"name": "Pair", "type": {"kind": "struct", "fields": ["u8", {"array": ["u8", 2]}]}}],
    }
    short = {"address": "short", "instructions": []}
    kept, rejected = idl.split_documents(documents(spark, good, "{broken", short, "[1]"))
    assert rows(kept, "program_id") == [("A" * 40,)]
    assert dict(rows(rejected, "path", "reason")) == {
        "/idl/1.json": "not_a_document", "/idl/2.json": "short_program_id", "/idl/3.json": "not_a_document"
    }
    layout = idl.layouts(kept).first().layout
    value, _ = decode.compile_layout(layout)(b"12345678" + bytes([7, 8, 9]), 8)
    assert value == {"p": {"0": 7, "1": [8, 9]}}


def test_repeated_documents_do_not_multiply_rows(spark):
    def body(*names):
        return {"address": "A" * 40, "instructions": [{"name": n, "args": []} for n in names]}

    newest, others = idl.newest_documents(idl.parse_documents(documents(spark, body("a"), body("a", "b"), body("a", "b", "c"))))
    assert sorted(rows(idl.layouts(newest), "instruction")) == [("a",), ("b",), ("c",)]
    assert others.count() == 2


def test_wrong_layouts_and_counts_end_in_an_error(spark):
    bad = json.dumps({"columns": ["x"], "fields": ['{"array":["u8","N"]}'], "types": []})
    empty = json.dumps({"columns": ["x"], "fields": ['{"vec":{"defined":"E"}}'], "types": [{"name": "E", "type": {"kind": "struct", "fields": []}}]})
    payload = b"12345678" + b"\xff" * 8
    df = spark.createDataFrame([(1, payload, bad), (2, payload, empty), (3, payload, "no json")], "i int, payload binary, layout string")
    got = rows(decode.decode_layouts(df).orderBy("i"), "i", "args", "error")
    assert [g[:2] for g in got] == [(1, None), (2, None), (3, None)] and all(g[2] for g in got)


def test_pages_behind_a_cursor_return_every_row_once(spark):
    rnd = random.Random(9)
    full = [(rnd.choice([None, 1, 2, 3]), rnd.choice("abc"), i) for i in range(40)]
    log = spark.createDataFrame(full, "slot long, signature string, ix_index int")
    seen, page = [], paging.page_by_slot(log, 7).data.collect()
    while page:
        seen += [tuple(r) for r in page]
        last = page[-1]
        page = paging.page_after(log, last.slot, last.signature, 7, ix_index=last.ix_index).collect()
    assert len(seen) == len(full) and set(seen) == set(full)
    assert [s is None for s, _, _ in seen] == sorted(s is None for s, _, _ in seen)


def test_ttl_accepts_one_of_repeated_rows_and_leaves_defects_to_the_quarantine(spark):
    day = dt.datetime(2024, 1, 1)
    data = [("a", day, 1, "p"), ("a", day, 1, "q"), ("a", None, 2, "r"), (None, day, 3, "s"), ("a", day + dt.timedelta(days=3), 4, "t")]
    df = spark.createDataFrame(data, "k string, ts timestamp, id long, payload string")
    good, rejected = ingest.split_quarantine(df, dedup.ttl_checks(["k"], "ts"))
    assert sorted(rows(rejected, "payload", "reason")) == [("r", "missing_ts"), ("s", "missing_k")]
    for split, run in ((True, 10), (False, 10), (True, 0), (False, 1)):
        kept = rows(dedup.ttl_dedup(df, ["k"], "ts", "id", split=split, run=run), "payload")
        assert len(kept) == 2 and ("t",) in kept


def test_gaps_across_buckets(spark):
    slots = [0, 5, 99_999, 100_000, 350_000, 10**9, 10**12, 2**62, None]
    df = spark.createDataFrame([(s,) for s in slots], "slot long")
    known = sorted(s for s in slots if s is not None)
    expected = {(a, b) for a, b in zip(known, known[1:], strict=False) if b - a > 100}
    assert {(a, b) for a, b, _ in rows(monitor.slot_gaps(df))} == expected


@pytest.mark.parametrize(
    "text, spark_name, base",
    [
        ("u32", "BIGINT", "u32"),
        ('{"vec":{"option":{"array":["u8",4]}}}', "ARRAY<ARRAY<INT>>", "u8"),
        ('{"option":{"defined":"Foo"}}', "VARIANT", "Foo"),
        ('{"hashMap":["u8","u8"]}', "VARIANT", '{"hashMap":["u8","u8"]}'),
        ('{"vec":' * 9 + '"bool"' + "}" * 9, "ARRAY<" * 9 + "BOOLEAN" + ">" * 9, "bool"),
    ],
)
def test_type_unwrapping(spark, text, spark_name, base):
    df = spark.createDataFrame([(text,)], "t string")
    assert rows(df.select(idl.spark_type(F.col("t")), idl.unwrap_type(F.col("t")))) == [(spark_name, base)]


# --- keyed writes ----------------------------------------------------------------------

def accepted(times, ttl):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= ttl:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("split, run", [(True, 10**6), (False, 10**6), (True, 0), (False, 0), (True, 100)])
def test_ttl_against_brute_force(spark, split, run):
    """The pass over short periods, the transfer functions of long ones and both, one key holding most rows."""
    rnd = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    day = dt.timedelta(hours=24)
    data = [("hot", start + dt.timedelta(seconds=rnd.randrange(40 * 86400))) for _ in range(600)]
    data += [(f"k{i % 7}", start + dt.timedelta(hours=rnd.randrange(120))) for i in range(60)]
    data += [("edge", start), ("edge", start + day), ("edge", start + day * 2 - dt.timedelta(microseconds=1))]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(data)], "k string, ts timestamp, id bigint")
    got = {}
    for k, t in rows(dedup.ttl_dedup(df, ["k"], "ts", "id", split=split, run=run), "k", "ts"):
        got.setdefault(k, []).append(t)
    for key in {k for k, _ in data}:
        assert sorted(got[key]) == accepted({t for k, t in data if k == key}, day), key


def test_ttl_of_evenly_spaced_times(spark):
    """Paths from different entries never meet here, and every cell has equal times."""
    start = dt.datetime(2024, 1, 1, 5)
    times = [start + dt.timedelta(seconds=7 * n) for n in range(400)]
    df = spark.createDataFrame([("hot", t, i) for i, t in enumerate([*times, *times])], "k string, ts timestamp, id bigint")
    for ttl in (7, 8, 100, 10_000):
        got = rows(dedup.ttl_dedup(df, ["k"], "ts", "id", ttl_seconds=ttl, run=0), "ts", "id")
        assert sorted(got) == [(t, times.index(t)) for t in accepted(set(times), dt.timedelta(seconds=ttl))]


def test_insert_ignore_is_idempotent(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 5, "only")], "k string, n int, v string")
    once = dedup.insert_ignore(df, ["k"], ["n"])
    assert sorted(rows(once)) == [("a", 1, "first"), ("b", 5, "only")]
    assert dedup.insert_new(dedup.insert_ignore(df, ["k"], ["n"]), once, ["k"]).count() == 0


def test_hot_key_is_limited_before_the_exchange(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS n")
    for plan_of in (dedup.insert_ignore(df, ["k"], ["n"]), paging.page_per_group(df, ["k"], [F.col("n").desc()], 5)):
        plan = plan_of._jdf.queryExecution().executedPlan().toString()
        # The plan is printed top down: the partial limit stands below the exchange.
        assert plan.count("WindowGroupLimit") == 2
        assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")


# --- extractors ------------------------------------------------------------------------

TX = "signature string, slot bigint, timestamp bigint, feePayer string, description string, instructions array<struct<programId:string,name:string,data:string,accounts:array<string>>>, feed_partition bigint, feed_offset bigint"


def transactions(spark):
    lend = lambda name, data=None: (LENDING, name, data, None)
    data = [
        ("TEST_SIG_AGENTIC_001", 12345678, 1, "p", "User swapped 1 SOL for 200 USDC on Jupiter", None, 0, 0),
        ("TEST_SIG_LENDING_001", None, 1, "", None, [lend("LiquidateObligationAndRedeemReserve")], 0, 1),
        ("TWO_IN_ONE", 7, 1, "x", "", [lend("liquidateA", '{"repaidAmount":5}'), lend("LIQUIDATEb", "text")], 0, 2),
        ("TEST_SIG_ZK_001", 999999, 1, "p", None, [(K.PROOF_PROGRAM, "n", "stub", [])], 0, 3),
        ("TEST_SIG_NFT_001", 1, 1, "p", None, [(K.ASSET_PROGRAM, "CreateAndMint", None, None)], 0, 4),
        ("EMPTY", 1, 1, "p", None, [], 0, 5),
        (None, 1, 1, "p", "no signature", [lend("liquidate")], 0, 6),
    ]
    return normalise(spark.createDataFrame(data, TX))


def test_extractors_on_mock_transactions(spark):
    tables = extract.default_registry().extract(transactions(spark))
    assert rows(tables["narratives"], "narrative") == [
        ("Transaction TEST_SIG: User swapped 1 SOL for 200 USDC on Jupiter at slot 12345678",)
    ]
    assert sorted(rows(tables["liquidations"], "signature", "liquidator", "repaid_amount")) == [
        ("TEST_SIG_LENDING_001", "Unknown", "0"), ("TWO_IN_ONE", "x", "5"),
    ]
    assert rows(tables["proof_logs"], "signature", "slot", "state_root", "verification_status") == [
        ("TEST_SIG_ZK_001", 999999, "extracted_root_stub", "PENDING")
    ]
    assert ingest.explode_instructions(transactions(spark)).count() == 6
    good, bad = ingest.split_quarantine(transactions(spark), ingest.missing_key_checks("signature"))
    assert good.count() == 6 and rows(bad, "reason") == [("missing_signature",)]


def test_heartbeat_extractor(spark):
    import base64

    body = HB + b"\x01" * 32 + struct.pack("<I", 3)
    data = [("s", 1, 1, None, None, [("prog", None, base64.b64encode(body).decode(), ["a", "b", "n"])] * 2, 0, 0)]
    got = extract.heartbeats(normalise(spark.createDataFrame(data, TX)), "prog")
    assert rows(got, "node_pubkey", "shard_count", "status") == [("n", 3, "ONLINE")] * 2


def test_pushed_batches(spark, tmp_path):
    good = json.dumps([{"signature": "a", "slot": 1}, {"signature": "b", "instructions": [{"data": {"repaidAmount": 4}}]}])
    df = spark.createDataFrame([(good,), ('{"signature":"c"}',), ("oops",)], "value string")
    got = parse_batches(df)
    assert sorted(rows(got, "signature")) == [("a",), ("b",)]
    assert rows(got.filter("signature = 'b'").selectExpr("instructions[0].data")) == [('{"repaidAmount":4}',)]
    (tmp_path / "f.json").write_text(good)
    assert read_json(spark, str(tmp_path)).count() == 2


def test_document_views_put_their_text_together_once(spark, sf_dir):
    """One text per part, the one that the SQL makes by replacing marks, and no search of it."""
    docs = v_idl(spark, sf_dir)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(f"{_PART_PATH} AS path", f"{_PART_TEXT} AS text")
    assert docs.exceptAll(parts).count() == parts.exceptAll(docs).count() == 0
    assert "@KEY@" not in docs._jdf.queryExecution().optimizedPlan().toString()


def test_pushed_transactions_are_judged_once(spark):
    """The test of the numbers is not copied into the filter on its result, and finds what it always found."""
    elements = {
        '{"signature":"a","slot":1,"timestamp":2}': (None, 1),
        '{"signature":"b","slot":null,"description":"\\"slot\\""}': (None, None),
        '{"signature":"c","slot":"5"}': (None, None),
        '{"signature":"d","slot":"x"}': ("bad_slot", None),
        '{"signature":"e","slot":"x","slot":7}': ("bad_slot", None),
        '{"signature":"f","slot":7,"slot":"x"}': (None, 7),
        '{"signature":"g","s\\u006cot":1.5}': ("bad_slot", None),
        '{"signature":"h","slot":9223372036854775808}': ("bad_slot", None),
        '{"signature":"i","slot":3,"timestamp":1.5}': ("bad_timestamp", None),
        '{"signature":"j","slot":"x","timestamp":{}}': ("bad_slot", None),
        '[{"slot":"x"}]': ("no_object", None),
        "null": ("no_object", None),
    }
    df = spark.createDataFrame([(n, f"[{e}]") for n, e in enumerate(elements)], "n int, value string")
    judged = judge_batches(df)
    assert [tuple(r) for r in judged.orderBy("n").select("reason", "slot").collect()] == list(elements.values())
    kept = parse_batches(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in kept.splitlines() if "Filter" in line and "get_json_object" in line]


# --- state, monitors, pages ------------------------------------------------------------

def test_stale_boundary(spark):
    at = dt.datetime(2024, 1, 1, 0, 10)
    data = [("exact", "ONLINE", dt.datetime(2024, 1, 1)), ("old", "ONLINE", dt.datetime(2023, 12, 31, 23, 59, 59))]
    df = spark.createDataFrame(data, "node_pubkey string, status string, last_heartbeat timestamp")
    swept = state.stale_sweep(df, F.lit(at).cast("timestamp"))
    assert dict(rows(swept, "node_pubkey", "status")) == {"exact": "ONLINE", "old": "OFFLINE"}


def test_lag_and_gap_bands(spark):
    df = spark.createDataFrame([(1000 - lag,) for lag in (-5, 0, 49, 50, 500, 501)], "last_slot bigint")
    got = rows(monitor.lag_status(df, F.lit(1000).cast("bigint")), "desync", "band")
    assert got == [(0, "ok"), (0, "ok"), (49, "ok"), (50, "warn"), (500, "warn"), (501, "critical")]
    slots = spark.createDataFrame([(s,) for s in (1, 101, 202, 202, 999_999, 1_000_000, None)], "slot bigint")
    for bucket in (monitor.GAP_BUCKET, 7):
        assert sorted(rows(monitor.slot_gaps(slots, bucket=bucket))) == [(101, 202, 101), (202, 999_999, 999_797)]
    head = F.lit(500).cast("bigint")
    cursors = spark.createDataFrame([("k", "0"), ("k", "400"), ("k", "399")], "key string, value string")
    assert rows(monitor.cursor_audit(cursors, head), "gap", "gap_detected", "baseline") == [
        (0, False, 500), (100, False, 400), (101, True, 399),
    ]


def test_cursor_never_moves_back(spark):
    df = spark.createDataFrame([(5, dt.datetime(2024, 1, 1))], "slot bigint, ts timestamp")
    assert aggregates.advance_cursor(df, 9).first().value == "9"
    assert aggregates.advance_cursor(df.limit(0), 0).first().value == "0"
    assert aggregates.latest_slot(df.limit(0)).first().last_slot == 0


def log_frame(spark):
    return spark.createDataFrame(
        [(f"s{i}", i // 2, "P", "swap", "Alice" if i % 3 else "Bob") for i in range(30)],
        "signature string, slot bigint, program_id string, instruction string, signer string",
    )


def test_log_page_and_key_set_page_agree(spark):
    log = log_frame(spark)
    hostile = {"signer": "Alice", "1=1; DROP TABLE ix_swap; --": "boom"}
    first = paging.instruction_log(log, "P", "SWAP", hostile, 10)
    got = first.envelope(programId="P")
    assert got["count"] == 10 and {r["signer"] for r in got["data"]} == {"Alice"}
    last = got["data"][-1]
    behind = paging.page_after(log.filter("signer = 'Alice'"), last["slot"], last["signature"], 10)
    second = paging.instruction_log(log, "P", "swap", {"signer": "Alice"}, 10, 10)
    assert rows(behind, "signature") == rows(second.data, "signature")
    assert paging.instruction_log(log, "P", "swap", {}, 10, 1000).data.count() == 0
    assert paging.instruction_log(log, "P", "swap", {}, 0).data.count() == 0
    assert rows(paging.lookup(log, "signature", "s3"), "slot") == [(1,)]
    assert paging.lookup(log, "signature", "nope").count() == 0


def test_log_layout_prunes_partitions(spark, tmp_path):
    write_log(log_frame(spark), f"{tmp_path}/log", mode="overwrite")
    stored = spark.read.parquet(f"{tmp_path}/log")
    wanted = paging.instruction_log(stored, "P", "swap", {"signer": "Bob"}).data
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(program_id" in plan and "EqualTo(signer,Bob)" in plan
    assert "TakeOrderedAndProject" in plan


def test_stats_report_idle_instructions(spark):
    catalog = spark.createDataFrame([("P", "swap"), ("P", "idle")], "program_id string, instruction string")
    got = aggregates.program_stats(log_frame(spark).withColumn("ts", F.current_timestamp()), catalog)
    assert set(rows(got)) == {("P", "idle", 0), ("P", "swap", 30), ("P", None, 30)}


# --- plans -----------------------------------------------------------------------------

def _plan(df, which):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_layouts_are_not_broadcast(spark):
    """Their estimated size is that of the files below, so a broadcast could be of any size."""
    layouts = spark.createDataFrame(
        [("P", bytearray(8), "note", "ix_note", '{"columns":["a"],"fields":["u8"],"types":[]}')],
        "program_id string, disc binary, instruction string, table_name string, layout string",
    )
    call = base58.encode(bytes(8) + b"\x05")
    ix = spark.createDataFrame(
        [("s", 1, None, None, 0, 0, "P", 0, call)],
        "signature string, slot bigint, ts timestamp, fee_payer string, feed_partition bigint, feed_offset bigint, "
        "program_id string, ix_index int, data string",
    )
    decoded = universal.decode_calls(ix, layouts)
    joins = [line for line in _plan(decoded, "sparkPlan").splitlines() if "Join" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)
    assert rows(decoded, "args", "error") == [('{"a":5}', None)]


def _call_rows(spark, found):
    return spark.createDataFrame(
        [(s, 1, None, None, 0, i, p, 0, data) for i, (s, p, data) in enumerate(found)],
        "signature string, slot bigint, ts timestamp, fee_payer string, feed_partition bigint, feed_offset bigint, "
        "program_id string, ix_index int, data string",
    )


def _two_layouts(spark):
    layout = '{"columns":["a"],"fields":["u8"],"types":[]}'
    return spark.createDataFrame(
        [("P", bytearray(8), "note", "ix_note", layout), ("P", bytearray(b"abcdefgh"), "swap", "ix_swap", layout)]
        + [("P", None, "none", "ix_none", layout), ("Q", bytearray(b""), "empty", "ix_empty", layout)],
        "program_id string, disc binary, instruction string, table_name string, layout string",
    )


def test_unread_payloads_of_known_programs_keep_their_error(spark):
    """One row for a payload that can't be read, however many layouts its program has; none for other programs."""
    good, other = base58.encode(bytes(8) + b"\x05"), base58.encode(b"12345678\x05")
    found = [("good", "P", good), ("bad", "P", "0"), ("none", "P", None), ("other", "P", other), ("empty", "P", "")]
    found += [("far", "R", good), ("far bad", "R", "0"), ("null", None, "0"), ("opened", "Q", ""), ("bad", "Q", "l")]
    decoded = universal.decode_calls(_call_rows(spark, found), _two_layouts(spark))
    assert sorted(rows(decoded, "signature", "program_id", F.coalesce("table_name", F.lit("-")), "error"), key=str) == [
        ("bad", "P", "-", "bad payload text"),
        ("bad", "Q", "-", "bad payload text"),
        ("good", "P", "ix_note", None),
        ("none", "P", "-", "bad payload text"),
        ("opened", "Q", "ix_empty", "payload too short"),
    ]


def test_calls_are_exchanged_once_to_be_decoded(spark):
    decoded = universal.decode_calls(_call_rows(spark, [("s", "P", "11111111")]), _two_layouts(spark))
    lines = _plan(decoded, "executedPlan").splitlines()
    at = next(i for i, line in enumerate(lines) if "Scan ExistingRDD[signature" in line)
    depth, above = 10**6, []
    for line in lines[at::-1]:
        inside = len(line) - len(line.lstrip(" :+-"))
        if inside < depth:
            depth = inside
            above.append(line)
    assert sum("Exchange" in line for line in above) == 1


def test_base58_arrays_match_the_single_values():
    rng = random.Random(5)
    values = [None, b"", b"\0", b"\0" * 40, b"\xff" * 512, b"\xff" * 513, b"\0\1" * 300]
    values += [bytes(rng.choice([0, 255, rng.randrange(256)]) for _ in range(rng.randrange(130))) for _ in range(500)]
    texts = [None if v is None else base58.encode(v) for v in values]
    assert base58.encode_array(pa.array(values, pa.binary())).to_pylist() == texts
    assert base58.decode_array(pa.array(texts)).to_pylist() == values
    assert base58.decode_array(pa.array(texts)[3:9]).to_pylist() == values[3:9]
    odd = ["0", "l", "\u00e9", "1" * 700, "z" * 512, "z" * 513 + "0", *("1z0"[i % 3] * i for i in range(40))]
    assert base58.decode_array(pa.array(odd)).to_pylist() == list(base58.decode_series(pd.Series(odd, dtype=object)))
    assert base58.decode_array(pa.array([], pa.string())).to_pylist() == []


def test_replay_looks_up_programs_and_payloads_late(spark, tmp_path):
    """Programs meet the newest signatures only, and no payload is made where signatures are asked for."""
    ix = spark.createDataFrame(
        [("P", "a", 1), ("P", "b", 3), ("P", "b", 2), ("P", "c", 2), ("R", "a", 9)], "program_id string, signature string, slot bigint"
    )
    listed = spark.createDataFrame([("P",), ("S",)], "program_id string")
    again = replay.recent_per_program(ix, ix, 2, listed)
    assert sorted(rows(again, "signature", "slot")) == [("b", 2), ("b", 3), ("c", 2)]
    columns = {"l_orderkey": 1, "l_partkey": 41, "l_suppkey": 3, "l_linenumber": 1}
    line = spark.range(1).selectExpr(
        *(f"cast({v} AS bigint) AS {k}" for k, v in columns.items()),
        "'R' AS l_returnflag", "'O' AS l_linestatus", "TIMESTAMP_NTZ '2020-01-01 00:00:00' AS l_shipdate",
    )
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert "ArrowEvalPython" not in _plan(replay.recent_signatures(v_note(spark, str(tmp_path))), "executedPlan")


def test_a_stored_feed_is_made_once(spark):
    """Every module reads the stored feed; what makes the feed is in no module's plan."""
    made = F.udf(lambda text: text, "string").asNondeterministic()
    tx = transactions(spark).withColumn("description", made("description"))
    plain, kept = extract.default_registry().extract(tx), extract.default_registry().extract(tx, store=True)
    for name, found in kept.items():
        assert sorted(rows(found), key=str) == sorted(rows(plain[name]), key=str)
        assert "EvalPython" not in _plan(found, "executedPlan")


def test_documents_are_spread(spark, tmp_path):
    """A table of one row group gives documents in as many tasks as a shuffle has."""
    spark.range(40).selectExpr("id AS p_partkey", "'X' AS p_type", "1 AS p_size", "'n' AS p_name").coalesce(
        1
    ).write.parquet(f"{tmp_path}/part.parquet")
    documents = v_idl(spark, str(tmp_path))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert documents.rdd.getNumPartitions() == wanted > 1
    assert len({r[0] for r in rows(documents, F.spark_partition_id())}) > 1


def test_free_names_are_not_folded(spark):
    """Names come out as they are where none is taken; null and repeated names go by the rule."""
    df = spark.createDataFrame(
        [(0, ["a", "B"]), (1, ["a", "A"]), (2, ["slot"]), (3, []), (4, None), (5, ["a", None])], "i int, names array<string>"
    )
    found = dict(rows(df.select("i", idl.resolve_names(F.col("names"), ("slot",)))))
    assert found == {0: ["a", "B"], 1: ["a", "A_1"], 2: ["slot_1"], 3: [], 4: None, 5: ["a", None]}


def test_little_endian_hex_is_made_once(spark):
    """All widths of positive, negative, edge and null numbers; one text is made of a number."""
    numbers = [0, 1, -1, 255, 256, (1 << 63) - 1, -(1 << 63), 0x0123456789ABCDEF, -0x0123456789ABCDEF, None]
    widths = (1, 2, 4, 8)
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").selectExpr("n", *[le_hex("n", w) for w in widths])
    for n, *found in rows(df):
        whole = None if n is None else (n % (1 << 64)).to_bytes(8, "little")
        assert found == [whole and whole[:w].hex().upper() for w in widths]
    assert all(le_hex("n", w).count("hex(") == 1 for w in widths)


def test_replay_extracts_before_it_joins(spark):
    """The exchange holds extracted rows of listed signatures, each once, not whole transactions."""
    call = [(LENDING, "liquidate", '{"repaidAmount":1}', ["x"])]
    tx = spark.createDataFrame(
        [("a", 1, None, "f", "d", 0, 0, call), ("b", 1, None, "f", "d", 0, 1, call), (None, 1, None, "f", "d", 0, 2, call)],
        "signature string, slot bigint, ts timestamp, fee_payer string, description string, feed_partition bigint, "
        "feed_offset bigint, instructions array<struct<programId:string,name:string,data:string,accounts:array<string>>>",
    )
    listed = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "signature string")
    found = extract.LIQUIDATIONS.rows(tx, lambda got: replay.by_signature(got, listed))
    assert rows(found, "signature", "repaid_amount") == [("a", "1")]
    optimized = _plan(found, "optimizedPlan")
    assert optimized.index("Join") < optimized.index("Generate")
