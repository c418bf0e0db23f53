"""Streams with availableNow against their batch forms."""

import base64
import datetime as dt
import glob
import hashlib
import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ixlake.operators import dedup, extract, monitor
from ixlake.operators.state import shard_lock_state, stale_sweep
from ixlake.sources.documents import stream_documents
from ixlake.sources.transactions import read_feed, read_json, stream_feed, stream_json
from ixlake.streaming.catalog import CatalogReload, current_catalog
from ixlake.streaming.gaps import GapAudit, current_gaps
from ixlake.streaming.heartbeat import presence_changes
from ixlake.operators.universal import catalog_layouts, universal_module
from ixlake.streaming.ingest import BatchIngest, current_cursor, read_if_written, start_log, start_modules
from ixlake.streaming.ttl import ttl_dedup_exact, ttl_dedup_watermark
from ixlake.constants import LENDING_PROGRAMS, PROOF_PROGRAM

SAVE = LENDING_PROGRAMS[1]


def tx(signature, slot, description=None, program=None, name="LiquidateX", **extra):
    out = {"signature": signature, "slot": slot, "timestamp": 1_700_000_000_000 + slot}
    if description is not None:
        out["description"] = description
    if program:
        out["instructions"] = [{"programId": program, "name": name, **extra}]
    return out


BATCHES = [
    [
        tx("A" * 10, 5, "moved", SAVE, data={"repaidAmount": 12}),
        tx("B" * 10, 9, "", PROOF_PROGRAM),
        tx("A" * 10, 5, "moved", SAVE, data={"repaidAmount": 12}),
    ],
    [tx("A" * 10, 5, "moved", SAVE), tx("C" * 10, 3, "late")],
]


def feed(tmp_path, batches=BATCHES):
    folder = tmp_path / "feed"
    folder.mkdir()
    for i, batch in enumerate(batches):
        file = folder / f"{i}.json"
        file.write_text(json.dumps(batch))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_modules_stream_equals_batch(spark, tmp_path):
    two = tx("D" * 10, 4, "two", SAVE, data={"repaidAmount": 1})
    two["instructions"].append({"programId": LENDING_PROGRAMS[0], "name": "LiquidateY", "data": {"repaidAmount": 2}})
    path = feed(tmp_path, [*BATCHES, [two, {"slot": 1, "timestamp": 5, "description": "no signature"}]])
    registry = extract.default_registry()
    stream = stream_json(spark, path, files_per_trigger=1)
    for query in start_modules(stream, registry, f"{tmp_path}/t", f"{tmp_path}/c"):
        query.awaitTermination()
    batch = registry.extract(read_json(spark, path))
    for module in registry:
        written = spark.read.parquet(f"{tmp_path}/t/{module.id}")
        assert values(written, *module.columns) == values(batch[module.id], *module.columns), module.id
    rejected = spark.read.parquet(f"{tmp_path}/t/rejected/narratives").collect()
    assert [r.reason for r in rejected] == ["missing_signature"] and '"slot":1' in rejected[0].row
    # A backfill into the same tables adds only what is new, and all is read together.
    (tmp_path / "feed" / "9.json").write_text(json.dumps([tx("C" * 10, 3, "late"), tx("E" * 10, 7, "new")]))
    again = stream_json(spark, path)
    BatchIngest(registry, f"{tmp_path}/t", run="backfill").start(again, f"{tmp_path}/b").awaitTermination()
    found = [s for (s,) in values(spark.read.parquet(f"{tmp_path}/t/narratives"), "signature")]
    assert found == ["A" * 10, "C" * 10, "D" * 10, "E" * 10]


def test_batch_ingest_first_write_cursor_and_replay(spark, tmp_path):
    path = feed(tmp_path)
    sink = BatchIngest(extract.default_registry(), f"{tmp_path}/t")
    source = stream_json(spark, path, files_per_trigger=1)
    sink.start(source, f"{tmp_path}/c").awaitTermination()
    liquidations = spark.read.parquet(f"{tmp_path}/t/liquidations")
    assert values(liquidations, "signature", "repaid_amount") == [("A" * 10, "12")]
    assert current_cursor(spark, f"{tmp_path}/t") == 9
    # A backfill of the same input adds nothing.
    first = values(spark.read.parquet(f"{tmp_path}/t/narratives"), "signature", "narrative")
    BatchIngest(sink.registry, f"{tmp_path}/t", run="backfill").start(source, f"{tmp_path}/c2").awaitTermination()
    assert values(spark.read.parquet(f"{tmp_path}/t/narratives"), "signature", "narrative") == first
    assert values(spark.read.parquet(f"{tmp_path}/t/liquidations"), "signature") == [("A" * 10,)]


def test_failed_module_writes_its_batch_on_restart(spark, tmp_path):
    def broken(tx):
        return tx.select(F.raise_error(F.lit("boom")).cast("string").alias("signature"), *extract.ARRIVAL)

    def module(transform):
        return extract.Extractor("late", "signature string", ("signature",), ("slot",), transform)

    def ingest(transform):
        registry = extract.Registry().register(module(transform)).register(extract.NARRATIVES).register(extract.NARRATIVES)
        assert len(registry) == 2
        return BatchIngest(registry, f"{tmp_path}/t").start(stream_json(spark, path), f"{tmp_path}/c")

    path = feed(tmp_path)
    with pytest.raises(StreamingQueryException):
        ingest(broken).awaitTermination()
    # The other module has written; the cursor has not moved.
    assert spark.read.parquet(f"{tmp_path}/t/narratives").count() == 2
    assert current_cursor(spark, f"{tmp_path}/t") == 0
    ingest(lambda tx: tx).awaitTermination()
    assert [s for (s,) in values(spark.read.parquet(f"{tmp_path}/t/late"), "signature")] == ["A" * 10, "B" * 10, "C" * 10]
    assert spark.read.parquet(f"{tmp_path}/t/narratives").count() == 2
    assert current_cursor(spark, f"{tmp_path}/t") == 9


def test_only_a_missing_table_reads_as_none(spark, tmp_path):
    assert read_if_written(spark, f"{tmp_path}/nothing") is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("this is no parquet file")
    with pytest.raises(Exception, match="CANNOT_READ_FILE_FOOTER"):
        read_if_written(spark, f"{tmp_path}/bad")


def test_reloaded_catalog_decodes_a_new_program(spark, tmp_path):
    program = "Q" * 40
    document = {"name": "q", "address": program, "instructions": [{"name": "go", "args": [{"name": "n", "type": "u8"}]}]}
    docs = tmp_path / "idl"
    docs.mkdir()
    sink = CatalogReload(f"{tmp_path}/catalog")
    empty = spark.createDataFrame([], "program_id string, instruction string, table_name string, disc binary, layout string")

    def layouts():
        found = current_catalog(spark, f"{tmp_path}/catalog")
        return empty if found is None else found.select(*empty.columns)

    payload = hashlib.sha256(b"global:go").digest()[:8] + bytes([9])
    call = [{"signature": "S" * 10, "slot": 1, "timestamp": 5, "instructions": [{"programId": program, "data": base64.b64encode(payload).decode()}]}]
    later = [dict(call[0], signature="T" * 10)]
    path = feed(tmp_path, [call])
    module = universal_module(layouts, "base64")

    def ingest():
        (query,) = start_modules(stream_json(spark, path), extract.Registry().register(module), f"{tmp_path}/t", f"{tmp_path}/c")
        query.awaitTermination()

    ingest()
    (docs / "q.json").write_text(json.dumps(document))
    sink.start(stream_documents(spark, str(docs)), f"{tmp_path}/d").awaitTermination()
    (tmp_path / "feed" / "5.json").write_text(json.dumps(later))
    ingest()
    rows = spark.read.parquet(f"{tmp_path}/t/instructions").select("signature", "table_name", "args").collect()
    assert [tuple(r) for r in rows] == [("T" * 10, "ix_go", '{"n":9}')]


def hours(*offsets):
    start = dt.datetime(2024, 1, 1)
    return [start + dt.timedelta(hours=h) for h in offsets]


def stream_of(spark, tmp_path, rows, schema, name="in"):
    """One file, one micro-batch per row group of ``rows``."""
    folder = f"{tmp_path}/{name}"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/p{i}")
        for file in glob.glob(f"{folder}/p{i}/*.parquet"):
            os.utime(file, (1_700_000_000 + i,) * 2)
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
        .parquet(f"{folder}/p*")
    )


def run(stream, path, checkpoint, mode="append"):
    (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path).awaitTermination()
    )


def test_exact_ttl_stream_equals_batch_fold(spark, tmp_path):
    schema = "k string, ts timestamp, id bigint"
    times = hours(0, 1, 20, 24, 24.5, 47.9, 48, 100)
    rows = [("a", t, i) for i, t in enumerate(times)] + [("b", times[2], 50)]
    stream = stream_of(spark, tmp_path, [rows], schema)
    run(ttl_dedup_exact(stream, ["k"], "ts", "id"), f"{tmp_path}/o", f"{tmp_path}/c")
    batch = dedup.ttl_dedup(spark.createDataFrame(rows, schema), ["k"], "ts", "id")
    got = values(spark.read.parquet(f"{tmp_path}/o"), "k", "ts", "id")
    assert got == values(batch, "k", "ts", "id")
    assert [i for _, _, i in got] == [0, 3, 6, 7, 50]


def test_ttl_state_lasts_over_micro_batches(spark, tmp_path):
    schema = "k string, ts timestamp, id bigint"
    t = hours(0, 23, 25, 26)
    stream = stream_of(spark, tmp_path, [[("a", t[0], 0)], [("a", t[1], 1), ("a", t[2], 2)], [("a", t[3], 3)]], schema)
    run(ttl_dedup_exact(stream, ["k"], "ts", "id"), f"{tmp_path}/o", f"{tmp_path}/c")
    assert values(spark.read.parquet(f"{tmp_path}/o"), "id") == [(0,), (2,)]


def test_watermark_ttl_drops_repeats(spark, tmp_path):
    schema = "k string, ts timestamp, id bigint"
    t = hours(0, 1, 2)
    stream = stream_of(spark, tmp_path, [[("a", t[0], 0), ("a", t[1], 1), ("b", t[2], 2)]], schema)
    run(ttl_dedup_watermark(stream, ["k"], "ts"), f"{tmp_path}/o", f"{tmp_path}/c")
    assert values(spark.read.parquet(f"{tmp_path}/o"), "k") == [("a",), ("b",)]


def test_presence_timer_matches_batch_sweep(spark, tmp_path):
    schema = "merkle_root string, node_pubkey string, shard_count bigint, ts timestamp"
    base = dt.datetime(2024, 1, 1)
    at = lambda m: base + dt.timedelta(minutes=m)
    parts = [
        [("r", "quiet", 1, at(0)), ("r", "alive", 2, at(0))],
        [("r", "alive", 9, at(8))],
        [("r", "alive", 9, at(15))],
        [("r", "alive", 9, at(15))],
    ]
    changes = presence_changes(stream_of(spark, tmp_path, parts, schema))
    latest = {}

    def keep(batch, _):
        for row in batch.collect():
            latest[row.node_pubkey] = (row.shard_count, row.status, row.last_heartbeat)

    (
        changes.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    )
    rows = spark.createDataFrame(sum(parts, []), schema).withColumn("status", F.lit("ONLINE"))
    swept = stale_sweep(shard_lock_state(rows, ["ts", "shard_count"]), F.lit(at(15)).cast("timestamp"))
    expected = {r.node_pubkey: (r.shard_count, r.status, r.last_heartbeat) for r in swept.collect()}
    assert latest == expected
    assert latest["quiet"][1] == "OFFLINE" and latest["alive"][:2] == (2, "ONLINE")


def test_heartbeat_log_appends_everything(spark, tmp_path):
    schema = "merkle_root string, ts timestamp"
    rows = [("r", hours(0)[0])] * 2
    start_log(stream_of(spark, tmp_path, [rows, rows], schema), f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == 4


def test_catalog_reload_replaces_a_changed_document(spark, tmp_path):
    docs = tmp_path / "idl"
    docs.mkdir()
    program = "P" * 40

    def write(name, *instructions):
        body = {"name": "x", "address": program, "instructions": [{"name": i, "args": []} for i in instructions]}
        (docs / name).write_text(json.dumps(body))
        os.utime(docs / name, (1_700_000_000 + len(instructions),) * 2)

    write("one.json", "alpha")
    sink = CatalogReload(f"{tmp_path}/catalog")
    sink.start(stream_documents(spark, str(docs)), f"{tmp_path}/c").awaitTermination()
    assert values(current_catalog(spark, f"{tmp_path}/catalog"), "instruction") == [("alpha",)]
    write("two.json", "alpha", "beta")
    sink.start(stream_documents(spark, str(docs)), f"{tmp_path}/c").awaitTermination()
    assert values(current_catalog(spark, f"{tmp_path}/catalog"), "instruction") == [("alpha",), ("beta",)]


def test_universal_module_keeps_repeated_calls_of_a_transaction(spark):
    program = "Q" * 40
    disc = hashlib.sha256(b"global:go").digest()[:8]
    document = {"name": "q", "address": program, "instructions": [{"name": "go", "args": [{"name": "n", "type": "u8"}]}]}
    documents = spark.createDataFrame([("q.json", json.dumps(document))], "path string, text string")
    calls = [(program, None, base64.b64encode(disc + bytes([n])).decode(), []) for n in (9, 9, 7)]
    tx = spark.createDataFrame(
        [("S" * 10, 1, None, None, None, 0, k, calls) for k in (1, 2)],  # the transaction comes twice
        "signature string, slot bigint, ts timestamp_ntz, fee_payer string, description string, feed_partition int, "
        "feed_offset int, instructions array<struct<programId: string, name: string, data: string, accounts: array<string>>>",
    )
    layouts = catalog_layouts(documents)
    rows = universal_module(layouts, "base64").rows(tx).select("ix_index", "args").collect()
    assert sorted(map(tuple, rows)) == [(0, '{"n":9}'), (1, '{"n":9}'), (2, '{"n":7}')]
    first = universal_module(layouts, "base64", first_per_signature=True).rows(tx).select("ix_index", "args").collect()
    assert [tuple(r) for r in first] == [(0, '{"n":9}')]


def test_file_feed_keeps_order_and_quarantines(spark, tmp_path):
    """A truncated file, wrong elements and numbers come out with a reason; a file's own order decides."""
    same = [tx("S" * 10, 7, text) for text in ("first", "second", "third")]
    mixed = [tx("G" * 10, 3, "good"), {**tx("X" * 10, 1), "slot": "x"}, {**tx("Y" * 10, 1), "timestamp": 1.5}, 5, None]
    path = feed(tmp_path, [same, mixed, []])
    (tmp_path / "feed" / "broken.json").write_text(json.dumps([tx("T" * 10, 1, "t"), tx("U" * 10, 2)])[:-20])
    (tmp_path / "feed" / "object.json").write_text(json.dumps(tx("V" * 10, 1)))
    kept, rejected = read_feed(spark, path)
    assert values(kept, "signature", "description") == [
        ("G" * 10, "good"), *[("S" * 10, d) for d in ("first", "second", "third")]
    ]
    reasons = ["bad_slot", "bad_timestamp", "broken_json", "no_object", "no_object", "not_an_array"]
    assert [r for (r,) in values(rejected, "reason")] == reasons
    assert all(r.text and r.file for r in rejected.collect() if r.reason != "no_object")
    sink = BatchIngest(extract.default_registry(), f"{tmp_path}/t")
    sink.start(stream_feed(spark, path, files_per_trigger=2), f"{tmp_path}/c").awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/t/rejected/feed")
    assert [r for (r,) in values(stored, "reason")] == reasons
    narratives = values(spark.read.parquet(f"{tmp_path}/t/narratives"), "signature", "narrative")
    assert [s for s, _ in narratives] == ["G" * 10, "S" * 10] and ": first at slot 7" in narratives[1][1]


def test_line_feed_quarantines_single_lines(spark, tmp_path):
    lines = [json.dumps(tx("L" * 10, 1, "one")), "{broken", "", json.dumps({**tx("M" * 10, 2), "slot": 2.5}), "[1]"]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(lines))
    kept, rejected = read_feed(spark, f"{tmp_path}/lines", lines=True)
    assert values(kept, "signature") == [("L" * 10,)]
    assert [r for (r,) in values(rejected, "reason")] == ["bad_slot", "broken_json", "no_object"]


def test_gap_audit_on_a_stream_equals_the_batch(spark, tmp_path):
    """Slots in any order, late ones included, over several buckets and restarts."""
    rnd = random.Random(8)
    slots = [rnd.randrange(400) * 10 for _ in range(60)] + [5000 + 3 * n for n in range(50)] + [10**7, 2**40, None]
    rnd.shuffle(slots)
    path = feed(tmp_path, [[tx(f"s{n}", s) for n, s in enumerate(slots[k::6]) if s is not None] + [{"signature": "none"}] for k in range(6)])
    for rounds in (1, 2):
        audit = GapAudit(f"{tmp_path}/runs")
        audit.start(stream_json(spark, path, 1), f"{tmp_path}/c", threshold=20, bucket=1000).awaitTermination()
        batch = monitor.slot_gaps(read_json(spark, path), threshold=20, bucket=1000)
        found = values(current_gaps(spark, f"{tmp_path}/runs", 20, 1000), "gap_start", "gap_end", "gap")
        assert found == values(batch, "gap_start", "gap_end", "gap") and found
        if rounds == 1:
            start, end, _ = found[0]
            late = [tx("late", start + 1), tx("later", (start + end) // 2), tx("later", (start + end) // 2)]
            (tmp_path / "feed" / "late.json").write_text(json.dumps(late))
    assert current_gaps(spark, f"{tmp_path}/nothing") is None
