"""Targets by water filling, and words taken near them."""

import random
from collections import Counter

import numpy as np
from ixlake.llm.mixing import fit_counts, mix_documents


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def checked(docs, tolerance):
    rows = mix_documents(docs).collect()
    source = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _, _ in source)
    sizes, taken, target = Counter(), Counter(), {}
    for _, text, s in source:
        sizes[s] += len((text or "").encode().split())
    for r in rows:
        assert r["taken"] in {r["size"] * k for k in range(4)}
        assert r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    expected = brute_targets(sizes)
    for s in target:
        assert abs(target[s] - expected[s]) < 1e-6 * max(1, expected[s])
        assert abs(taken[s] - target[s]) <= tolerance
    again = mix_documents(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_documents(all_docs):
    checked(all_docs, 60)


def test_small_sources(make_docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["a", "b", "c", "d", None])) for i in range(500)]
    checked(make_docs(rows), 3)


def test_hot_length(make_docs):
    rows = [(i, "w " * 10, "a" if i % 3 else "b") for i in range(1200)]
    checked(make_docs(rows), 10)


def test_edges(make_docs):
    assert mix_documents(make_docs([])).count() == 0
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, " \t\n", "a")]
    assert [r["taken"] for r in mix_documents(make_docs(rows)).collect()] == [0] * 4
    docs = make_docs([(1, "a b c d", "x")]).selectExpr("*", "1 AS size", "2 AS cell", "3 AS target")
    assert [r["size"] for r in mix_documents(docs).collect()] == [2]


def test_fit_counts_reaches_the_budget_where_it_can():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 60, 12))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(1, (lengths * counts).sum() + 1))
        chosen = fit_counts(lengths, counts, budget)
        assert (chosen <= counts).all() and (chosen >= 0).all()
        assert abs(budget - int((chosen * lengths).sum())) <= 60


def test_fit_counts_on_large_budgets():
    lengths = np.arange(1, 3000)
    counts = np.full(len(lengths), 1_000_000)
    budget = 1_234_567_890_123
    assert int((fit_counts(lengths, counts, budget) * lengths).sum()) == budget
