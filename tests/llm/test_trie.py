"""The prefix trie against a plain one in memory."""

import hashlib
import random
import re
import zlib

import pytest

from ixlake.llm import trie
from ixlake.llm.trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, first int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows, tie=lambda role, text: (role, text)):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [(r, x) for _, _, r, x in sorted(own[c], key=lambda t: (t[0], t[1], *tie(t[2], t[3])))]
    members = {(): []}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        first = own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])
        path = (*first[:h], *own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    if not own:
        return []
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = []
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [totals[k] for k in kids.get(path, [])]
        totals[path] = (
            sum(b[0] for b in below) or 1,
            (len(members[path]) - 1) * words + sum(b[1] for b in below),
        )
        ends = ",".join(str(c) for c in sorted(c for c, last in members[path] if last))
        out.append((
            min(c for c, _ in members[path]), len(path), min(c for c, _ in members[path[:-1]]) if path else None,
            len(members[path]), len(kids.get(path, [])), *totals[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def found(spark, rows):
    return sorted(map(tuple, conversation_trie(make(spark, rows)).collect()), key=str)


def test_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    assert sorted(map(tuple, conversation_trie(table).collect()), key=str) == sorted(brute(rows), key=str)


def test_deep_and_shared_paths(spark):
    """Several bands and levels, with many members on one path."""
    draw = random.Random(1)
    rows = []
    for c in range(120):
        for turn in range(draw.choice([0, 1, 3, 9, 17, 70, 150])):
            fork = turn // 40 * (c % 3) + (c if turn > 60 else 0)
            rows.append((c, turn, "user" if turn % 2 else None, f"turn {turn} of {fork} " * (turn % 3)))
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_cells_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CELL", 16)
    rows = [(c, turn, "user", f"text {turn if turn < 90 else c} {turn}") for c in (20, 40, 41, 60) for turn in range(c * 2)]
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_many_turns_with_one_number(spark, monkeypatch):
    """Ties go by a hash, so only what does not depend on their order is compared."""
    monkeypatch.setattr(trie, "CROWDED", 8)
    rows = [(20, None, "user", f"tie {n % 40}") for n in range(60)] + [(20, 3, "user", "later"), (20, 2, "user", "sooner")]
    got = found(spark, rows)
    assert len(got) == 63 and [r for r in got if r[4] == 0][0][1] == 62
    again = found(spark, rows[::-1])
    assert got == again
    with_plain_windows = pytest.MonkeyPatch()
    with with_plain_windows.context() as m:
        m.setattr(trie, "CROWDED", 10**6)
        assert found(spark, rows) == got


def test_edges(spark):
    long_text = "word " * 200_000
    rows = [
        (None, 1, "user", "nobody"), (None, None, None, None),
        (1, None, None, None), (1, 5, None, ""), (1, 5, "", None),
        (2, 1, "user", long_text), (2, 2, "user", " \t "), (3, 1, "user", long_text),
        (0, 1, "user", "a b"), (0, 2, "user", "c"), (0, 0, "user", "zero"),
        (-7, 1, "user", "below zero"), (-20, 1, "user", "lent"), (-21, 1, "user", "x"), (47, 3, "user", "no donor"),
    ]
    assert found(spark, rows) == sorted(brute(rows), key=str)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "nobody")]) == []


def test_ends_are_streamed_over_chunks(spark):
    ids = [c * 700 for c in range(40)]
    rows = [(c * 20, 1, "user", "all the same") for c in ids]
    assert found(spark, rows) == sorted(brute(rows), key=str)
