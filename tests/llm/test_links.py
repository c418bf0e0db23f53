"""Near copies, near lines and near vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ixlake.llm import covertree, links
from ixlake.llm.covertree import near_vectors
from ixlake.llm.lines import Segments, _plain_distance, banded_distances, dedup_lines, letter_marks, neighbour_marks, normal_line
from ixlake.llm.links import components, connect, shared_postings
from ixlake.llm.minhash import match_threshold, near_duplicates, without_duplicates


class Sets:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("held", [250_000, 20])
def test_components_on_chains_stars_and_rings(spark, held):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(300, 300), (5, 5)]
    random.Random(2).shuffle(edges)
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), held).collect()}
    expected = Sets(range(400))
    for a, b in edges:
        expected.join(a, b)
    assert out == {x: expected.root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("seed", "few_keys"), [(1, False), (2, False), (2, True), (3, True)])
def test_connect_finds_every_component_of_a_crowded_key(spark, seed, few_keys):
    rng = random.Random(seed)
    ids = list(range(60))
    group = {i: rng.randrange(12) for i in ids}
    rows = [(k, i, True) for k in range(3) for i in ids if rng.random() < 0.9]
    keys = {k: {i for q, i, _ in rows if q == k} for k in range(3)}
    linked = spark.createDataFrame(list(group.items()), "id long, g long")

    def verify(pairs):
        return (
            pairs.join(linked.withColumnsRenamed({"id": "a", "g": "ga"}), "a")
            .join(linked.withColumnsRenamed({"id": "b", "g": "gb"}), "b")
            .where("ga = gb")
            .select("a", "b")
        )

    out = {r["node"]: r["component"] for r in connect(shared_postings(spark.createDataFrame(rows, "key long, id long, post boolean")), verify, few_keys=few_keys).collect()}
    expected = Sets(ids)
    for i in ids:
        for j in ids[:i]:
            if group[i] == group[j] and any({i, j} <= own for own in keys.values()):
                expected.join(i, j)
    assert {i: out.get(i, i) for i in ids} == {i: expected.root(i) for i in ids}


def test_pair_is_made_once_at_the_first_key_that_links_it(spark):
    # Key 1 links nobody, keys 2 and 3 both link the two.
    rows = [(1, 1, False), (1, 2, False), (2, 1, True), (2, 2, False), (3, 1, True), (3, 2, True)]
    labelled = spark.createDataFrame([(*r, r[1]) for r in rows], "key long, id long, post boolean, label long")
    assert [tuple(r) for r in links._every(labelled, None, True).collect()] == [(1, 2)]


@pytest.mark.parametrize("limit", [1, 2])
def test_own_segments_are_posted_once(limit):
    rng = random.Random(limit)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 60))) for _ in range(200)]
    segments = Segments(lines, limit)
    index, probes, others = (
        [tuple(x) for x in zip(*map(np.ndarray.tolist, found), strict=True)]
        for found in (segments.index(), segments.probes(), segments.probes(own=False))
    )
    assert set(index) | set(others) == set(probes)
    assert len(index) + len(others) == len(probes)


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_near(rows, width, percent):
    sets = {d: shingles(t, width) for d, t in rows}
    out = Sets(sets)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y:
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.join(a, b)
    return {d: (len(sets[d]), out.root(d)) for d in ids}


def near_family(seed, copies, base=60):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
    out = []
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(make_docs, all_docs, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in all_docs.collect()]
    rows += [(10_000 + 100 * f + i, t) for f in range(4) for i, t in enumerate(near_family(f, 25))]
    rows += [(20_000, None), (20_001, ""), (20_002, "one"), (20_003, "ONE"), (20_004, "two words"), (20_005, "a b\tc d\ne f " * 3000)]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows), width, percent).collect()}
    assert out == brute_near(rows, width, percent)
    assert out[20_003] == (1, 20_002) and out[20_000] == (0, 20_000)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_alike_documents_without_links(make_docs, monkeypatch, width, percent):
    """Families about the threshold apart, with near copies of some members, split until nothing is open."""
    monkeypatch.setattr(links, "OPEN_SHARE", 0.0)
    met, splits = [], []
    saved, split = links.saved, links._split

    def counted(df, name="step"):
        out = saved(df, name)
        if name == "pairs":
            met.append(out.count())
        return out

    monkeypatch.setattr(links, "saved", counted)
    monkeypatch.setattr(links, "_split", lambda *given: splits.append(1) or split(*given))
    rng = random.Random(width)
    texts = []
    for base in (90, 140):
        words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
        for _ in range(60):
            own = list(words)
            for at in rng.sample(range(base), rng.randint(base // 45, base // 22)):
                own[at] = f"x{rng.randrange(10**6)}"
            own = own[rng.randrange(3) : base - rng.randrange(3)]
            texts.append(" ".join(own))
            if rng.random() < 0.2:
                own[rng.randrange(len(own))] = "y"
                texts.append(" ".join(own))
    rows = list(enumerate(texts))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows), width, percent).collect()}
    assert out == brute_near(rows, width, percent)
    assert splits and sum(met) < len(texts) ** 2 / 8


@pytest.mark.parametrize("shift", [0, 3])
def test_pairs_of_a_family_go_by_their_marks(make_docs, monkeypatch, shift):
    """Documents alike to each other, of which the marks leave the few pairs that may be linked: none is split."""
    met, splits = [], []
    saved, split = links.saved, links._split

    def counted(df, name="step"):
        out = saved(df, name)
        if name == "pairs":
            met.append(out.count())
        return out

    monkeypatch.setattr(links, "saved", counted)
    monkeypatch.setattr(links, "_split", lambda *given: splits.append(1) or split(*given))
    rng = random.Random(shift)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(70):
        own = list(words)
        for at in rng.sample(range(40), 4):
            own[3 * at] = f"x{rng.randrange(30)}"
        texts.append(" ".join(own[shift:]))
    texts += [t + " y" for t in texts[::10]]
    # Every shingle is held by two documents.
    rows = list(enumerate(texts)) + [(1000 + i, f"{t} " + "z " * 90 + f"q{i}") for i, t in enumerate(texts)]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows), 3, 85).collect()}
    assert out == brute_near(rows, 3, 85)
    assert not splits and sum(met) < 600


def test_near_duplicates_edges(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "q r s t u v"), (None, None)]
    docs = make_docs(rows).selectExpr("*", "1 AS set_id", "2 AS kept", "3 AS label")
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()), key=str)
    assert out == sorted(
        [(None, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (None, None, True)], key=str
    )
    left = without_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect() if r["doc_id"] == 3) == [("3", "a b c d e f")]


def test_match_threshold_keeps_pairs():
    assert match_threshold(20, 85) == 8 and match_threshold(20, 100) == 20


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_distances_and_segments(limit):
    rng = random.Random(limit)
    first, second = [], []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 25)))
        b = list(a)
        for _ in range(rng.randint(0, limit + 2)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        first.append(a)
        second.append("".join(b))
    exact = np.array([_plain_distance(a, b) for a, b in zip(first, second, strict=True)])
    assert (np.minimum(banded_distances(first, second, limit), limit + 1) == np.minimum(exact, limit + 1)).all()
    for marked, most in ((letter_marks, 2 * limit), (neighbour_marks, 4 * limit)):
        marks = [[int(m) >> p & 15 for p in range(0, 64, 4)] for m in marked(first + second).view(np.uint64)]
        for i, d in enumerate(exact):
            apart = [abs(x - y) for x, y in zip(marks[i], marks[len(first) + i], strict=True)]
            assert d > limit or sum(min(x, 16 - x) for x in apart) <= most
    lines = sorted({x for x in first + second if len(x) > limit})
    segments, where = Segments(lines, limit), {x: i for i, x in enumerate(lines)}
    index = {}
    for key, line in zip(*map(np.ndarray.tolist, segments.index()), strict=True):
        index.setdefault(key, set()).add(line)
    met = {frozenset((x, line)) for key, line in zip(*map(np.ndarray.tolist, segments.probes()), strict=True) for x in index.get(key, ())}
    for a, b, d in zip(first, second, exact, strict=True):
        if d <= limit and a in where and b in where:
            assert frozenset((where[a], where[b])) in met


def brute_lines(rows, limit=2):
    """doc_id -> what remains; rows have distinct ids."""
    places = [
        (d, at, normal_line(x)) for d, t in sorted(rows) for at, x in enumerate((t or "").split("\n")) if normal_line(x)
    ]
    distinct = sorted({x for _, _, x in places})
    groups = Sets(distinct)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            shorter = min(len(a), len(b))
            edits = 0 if shorter < 8 else 1 if shorter < 32 else limit
            if abs(len(a) - len(b)) <= edits and _plain_distance(a, b) <= edits:
                groups.join(a, b)
    gone, seen = set(), set()
    for d, at, x in places:
        if groups.root(x) in seen:
            gone.add((d, at))
        seen.add(groups.root(x))
    return {
        d: None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (d, at) not in gone) for d, t in rows
    }


def test_line_dedup_matches_brute_force(make_docs):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(5, 60))) for _ in range(40)]
    pool += [p[: k] + rng.choice("xyz") + p[k + rng.randint(0, 1) :] for p in pool for k in (3, len(p) // 2)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "the same long line of text, once more and more"), (104, "x" * 100_000)]
    rows += [(200 + i, f"the same long line of text, once more and mor{i % 10}") for i in range(40)]
    out = dedup_lines(make_docs(rows)).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute_lines(rows)
    for r in out:
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_line_dedup_edges(make_docs):
    assert dedup_lines(make_docs([])).count() == 0
    line = "a line that is long enough to count"
    docs = make_docs([(None, line), (1, line), (1, line), (2, f"{line}\nshort\nshort")]).selectExpr("*", "1 AS line", "2 AS places")
    out = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in dedup_lines(docs).collect()), key=str)
    assert out == sorted([(None, line, 0), (1, "", 1), (1, "", 1), (2, "short", 2)], key=str)
    twice = dedup_lines(make_docs([(1, line), (1, line)])).collect()
    assert [r["text"] for r in twice] == [line, line]


def test_short_lines_are_repeats_too(make_docs):
    """Menu lines as a whole, and lines of every length class a letter apart, across the borders of the classes."""
    pairs = [("abcdefg", "abcdefx"), ("abcdefgh", "abcdefgx"), ("abcdefg", "abcdefgh"), ("b" * 31, "b" * 32), ("c" * 30 + "d", "c" * 32)]
    pairs += [("e" * 31 + "f", "e" * 31 + "fgh"), ("share this page now ok", "share this pagf now ok"), ("i" * 7, "i" * 9)]
    rows = [(i, "Read more\n" + one) for i, (one, _) in enumerate(pairs)]
    rows += [(100 + i, f"{other}\nRead more\n\n \n") for i, (_, other) in enumerate(pairs)]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(make_docs(rows)).collect()}
    assert out == brute_lines(rows)
    assert sum("Read more" in t for t in out.values()) == 1
    assert "share" in out[6] and "share" not in out[106]


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows, cosine=0.93):
    usable = {
        i: np.array(v, float) for i, v, label in rows
        if v is not None and len(v) and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
    }
    labels, links, groups = {i: x for i, _, x in rows}, {i: 0 for i, _, _ in rows}, Sets([i for i, _, _ in rows])
    for a in usable:
        for b in usable:
            x, y = usable[a], usable[b]
            if a < b and labels[a] == labels[b] and len(x) == len(y):
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    links[a], links[b] = links[a] + 1, links[b] + 1
                    groups.join(a, b)
    return {i: (links[i], groups.root(i), groups.root(i) == i) for i in links}


@pytest.mark.parametrize("leaf", [2048, 30])
def test_near_vectors_match_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(covertree, "LEAF", leaf)
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for centre in rng.normal(size=(12, 8)):
        for _ in range(25):
            v = centre + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.6])
            rows.append((i, np.float32(v).tolist(), i % 2))
            i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(40)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] * 8, [1.0, 2.0], [1e-30] * 8, [1e30] * 8]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, rows[0][1], None)]
    out = near_vectors(spark.createDataFrame(rows, VECTORS))
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()} == brute_vectors(rows)


def test_near_vectors_edges(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, None, 1)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("pid", F.lit(1)).withColumn("node", F.lit("x"))
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame).collect()), key=str)
    assert out == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True)], key=str)


def test_vectors_that_are_all_one_place(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 20)
    rows = [(i, [1.0 + i * 1e-7, 2.0], 1) for i in range(100)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["component_id"] for r in out} == {0} and {r["n_links"] for r in out} == {99}
