"""Roll-ups kept up to date against those of the whole log, after every batch."""

import datetime as dt
import random

import pytest

from ixlake.operators import aggregates
from ixlake.streaming.rollups import CallRollup, HeartbeatRollups, Partials, merge_calls

BEATS = "merkle_root string, node_pubkey string, shard_count long, status string, ts timestamp_ntz"


def beats(seed, n=80):
    draw = random.Random(seed)
    return [
        (
            draw.choice(["r1", "r2", "r3", "r4", None]),
            draw.choice(["n1", "n2", "n3", None]),
            draw.choice([1, 2, 3, None]),
            draw.choice(["ONLINE", "OFFLINE", None]),
            dt.datetime(2024, 1, 1) + dt.timedelta(minutes=draw.randrange(1000)),
        )
        for _ in range(n)
    ]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_heartbeat_rollups_equal_the_whole_log(spark, tmp_path):
    rollups = HeartbeatRollups(str(tmp_path), fold_every=2)
    batches = [beats(0, 3), beats(1), [], [(None, None, None, None, None)], beats(2)]
    for n, batch in enumerate(batches):
        rollups(spark.createDataFrame(batch, BEATS), n)
        log = spark.createDataFrame([r for b in batches[: n + 1] for r in b], BEATS)
        assert rows(rollups.node_availability(spark)) == rows(aggregates.node_availability(log))
        assert rows(rollups.active_shard_map(spark)) == rows(aggregates.active_shard_map(log))
    assert rollups.nodes.folded(spark) == 3
    # A batch that runs again, whole or after a loss between its tables, changes nothing.
    rollups(spark.createDataFrame(batches[4], BEATS), 4)
    assert rows(rollups.node_availability(spark)) == rows(aggregates.node_availability(log))
    assert rows(rollups.active_shard_map(spark)) == rows(aggregates.active_shard_map(log))


def test_heartbeat_rollups_on_a_stream(spark, tmp_path):
    feed = str(tmp_path / "feed")
    rollups = HeartbeatRollups(str(tmp_path / "tables"), fold_every=2)
    for seed in range(4):
        spark.createDataFrame(beats(seed, 30), BEATS).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(BEATS).parquet(feed)
        rollups.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    log = spark.read.parquet(feed)
    assert rows(rollups.node_availability(spark)) == rows(aggregates.node_availability(log))
    assert rows(rollups.active_shard_map(spark)) == rows(aggregates.active_shard_map(log))


def test_call_rollup(spark, tmp_path):
    catalog = spark.createDataFrame([("p", "buy"), ("p", "sell"), ("q", "list"), ("q", "list")], "program_id string, instruction string")
    rollup = CallRollup(str(tmp_path), fold_every=1)
    with pytest.raises(ValueError):
        rollup.program_stats(catalog)
    calls = [[("p", "Buy"), ("p", "buy"), ("z", "other")], [], [("q", "LIST"), ("p", None), (None, "buy")]]
    for n, batch in enumerate(calls):
        rollup(spark.createDataFrame(batch, "program_id string, instruction string"), n)
    log = spark.createDataFrame([r for b in calls for r in b], "program_id string, instruction string")
    assert rows(rollup.program_stats(catalog)) == rows(aggregates.program_stats(log, catalog))


def test_a_lost_fold_is_not_read(spark, tmp_path):
    table = Partials(str(tmp_path / "t"))
    part = spark.createDataFrame([("p", "buy", 2)], "program_id string, instruction string, calls long")
    assert table.read(spark) is None
    for n in range(3):
        table.put(part, n)
    part.write.parquet(f"{table.path}/base/upto=1")  # written, but not marked as complete
    assert rows(merge_calls(table.read(spark))) == [("p", "buy", 6)]
    table.fold(spark, 1, merge_calls)
    table.fold(spark, 0, merge_calls)
    assert table.folded(spark) == 1 and rows(merge_calls(table.read(spark))) == [("p", "buy", 6)]
    assert rows(table.read(spark, 2)) == [("p", "buy", 4)]
    with pytest.raises(ValueError):
        table.read(spark, 1)
