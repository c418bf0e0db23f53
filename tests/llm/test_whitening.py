"""Whitening against exact sums and numpy's own eigenvalues."""

from fractions import Fraction

import numpy as np
import pytest

from ixlake.llm.whitening import eigen, one_sided_jacobi, pivoted_cholesky, whiten_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n long, place int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, 7) for i, v in rows], SCHEMA)


def expected(rows, size):
    """Whole numbers, covariance and deviations in exact arithmetic."""
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == size and None not in v]
    kept = [(i, v) for i, v in kept if np.isfinite(v).all()]
    whole = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in kept]
    n = len(whole)
    sums = [sum(x) for x in zip(*whole, strict=True)]
    apart = [[n * x - s for x, s in zip(row, sums, strict=True)] for row in whole]
    matrix = np.array([[float(Fraction(sum(r[i] * r[j] for r in apart), n**3)) for j in range(size)] for i in range(size)])
    return [i for i, _ in kept], whole, sums, matrix, [sum(a * a for a in r) for r in apart]


def check(result, rows, size, components=8):
    ids, whole, sums, matrix, deviations = expected(rows, size)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    n, count = len(ids), min(components, size)
    found = {}
    for r in result:
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(result) == n * count and set(found) == set(ids)
    centred = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(row, sums, strict=True)] for row in whole])
    white = centred @ vectors[:, :count] / np.sqrt(values[:count])
    got = np.array([[found[i][k]["whitened"] for k in range(1, count + 1)] for i in ids])
    sign = np.sign((white * got).sum(axis=0))
    assert np.allclose(got * sign, white, atol=1e-7)
    for i, d in zip(ids, deviations, strict=True):
        assert {int(r["deviation"]) for r in found[i].values()} == {d} and found[i][1]["n"] == n
        assert [found[i][k]["explained"] for k in range(1, count + 1)] == pytest.approx(
            (values[:count] / matrix.trace()).tolist(), rel=1e-9
        )
    assert len({r["identity_error"] for r in result}) == 1 and result[0]["identity_error"] < 1e-9


def test_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    check(whiten_vectors(table).collect(), rows, len(rows[0][1]))


def test_invalid_rows_are_left_out(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=3).tolist()) for i in range(40)]
    rows += [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 0.0, 0.0])]
    rows += [(54, []), (55, [1.0, 2.0])]
    check(whiten_vectors(make(spark, rows), 2).collect(), rows, 3, 2)


def test_repeated_and_null_ids_are_rows(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=2).tolist()) for i in range(10)]
    result = whiten_vectors(make(spark, rows + rows[:1] + [(None, [0.5, 0.5])] * 2)).collect()
    assert len(result) == 2 * 13
    assert sum(r["vec_id"] is None for r in result) == 4 and {r["n"] for r in result} == {13}


def test_very_large_entries_stay_exact(spark):
    rows = [(i, [3e38 / (i + 1), float(i)]) for i in range(5)]
    with_small = [(i, [1e12 + 1e9 * i, 1e12 - 3e9 * (i % 3)]) for i in range(9)]
    check(whiten_vectors(make(spark, with_small)).collect(), with_small, 2)
    with pytest.raises(Exception, match="(?i)overflow|cast|decimal|malformed|range"):
        whiten_vectors(make(spark, rows)).collect()


def test_low_rank_has_fewer_components(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)]
    result = whiten_vectors(make(spark, rows)).collect()
    assert {r["component"] for r in result} == {1} and len(result) == 6
    assert result[0]["explained"] == pytest.approx(1.0)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = whiten_vectors(make(spark, rows))
        assert out.collect() == []
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_factor_and_rotations():
    random = np.random.default_rng(5)
    half = random.normal(size=(9, 5))
    matrix = half @ half.T
    factor, order = pivoted_cholesky(matrix)
    assert factor.shape == (9, 5) and np.allclose(np.triu(factor[:5], 1), 0)
    assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)])
    turned = one_sided_jacobi(factor)
    inner = turned.T @ turned
    assert np.allclose(inner, np.diag(inner.diagonal()), atol=1e-10 * inner.max())
    values, columns = eigen(matrix)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:5])
    assert np.allclose(matrix @ columns, columns * values)
