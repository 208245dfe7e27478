"""Whitening against numpy's eigenvectors of the whole covariance, and the Lanczos steps on matrices of many kinds."""

import math
from fractions import Fraction

import numpy as np
import pytest

from cairn import ship
from cairn.llm.whitening import _Centred, _whole, block_lanczos, fit_whitening, whitened

SCHEMA = "vec_id long, embedding array<float>, component int, n long, whitened double, x string, key string"
SF = "/root/testdata/sf0.01"


def table(spark, vectors, first=0, parts=3):
    ship(spark)
    return spark.createDataFrame([(i + first, v, 9, 9, 9.0, "x", "k") for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def exact(vectors):
    """(whole numbers, distinct ones, their sums) of the rows that stay."""
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in rows})
    return rows, distinct, [sum(c) for c in zip(*distinct, strict=True)]


def check(spark, vectors, got):
    rows, distinct, sums = exact(vectors)
    n = len(distinct)
    x = np.array(distinct, float)
    centred = x - np.array([float(Fraction(s, n)) for s in sums])
    values, w = np.linalg.eigh(centred.T @ centred / n)
    values, w = values[::-1], w[:, ::-1]
    found = int(min(4, (values > 1e-12 * values.sum()).sum()))
    assert len(got) == found * len(rows)
    sign = {}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for i, v in rows:
        for c in range(1, found + 1):
            r = by[i, c]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            want = (np.array(v) - np.array(sums) / n) @ w[:, c - 1] / math.sqrt(values[c - 1])
            if abs(want) > 1e-3:
                sign.setdefault(c, math.copysign(1, want * r["whitened"]))
            assert r["whitened"] * sign.get(c, 1) == pytest.approx(want, rel=1e-7, abs=1e-7)
            assert r["identity_error"] < 1e-9


def vectors(n=600, d=24, seed=3):
    random = np.random.default_rng(seed)
    x = random.standard_normal((n, d)) @ np.diag(np.linspace(0.2, 2, d)) @ random.standard_normal((d, d))
    return x.astype(np.float32).tolist()


def test_rows_copies_nulls_and_clashing_columns(spark):
    v = vectors()
    v += [v[0]] * 400 + [None, [], [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [*v[5][:-1], None], [-0.0] * 24, [0.0] * 24, [0.001] * 24]
    got = whitened(table(spark, v))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(spark, v, got.collect())


def test_repeated_and_null_ids(spark):
    t = table(spark, vectors(50, 6))
    rows = whitened(t.union(t).unionByName(t.selectExpr("null as vec_id", *t.columns[1:]))).collect()
    assert len(rows) == 4 * 150 and sum(r["vec_id"] is None for r in rows) == 200
    once = {(r["vec_id"], r["component"], r["whitened"]) for r in whitened(t).collect()}
    assert {(r["vec_id"], r["component"]) for r in rows if r["vec_id"] is not None} == {x[:2] for x in once}


def test_few_directions(spark):
    check(spark, [[float(i), 2.0 * i, 1.0] for i in range(20)], whitened(table(spark, [[float(i), 2.0 * i, 1.0] for i in range(20)])).collect())
    check(spark, [[float(i * i)] for i in range(9)], whitened(table(spark, [[float(i * i)] for i in range(9)])).collect())


@pytest.mark.parametrize("some", [[], [None, []], [[1.0, 2.0]] * 5])
def test_no_component(spark, some):
    got = whitened(table(spark, some, parts=1))
    assert got.collect() == [] and "whitened" in got.columns


def test_large_numbers_stay_exact(spark):
    v = [[3.0e9 + 7 * i, -2.0e9 + i * i] for i in range(200)]
    ship(spark)
    t = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    check(spark, v, whitened(t).collect())
    v = [[1.0e13 + i, 1.0] for i in range(50)]
    rows = whitened(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()
    _, distinct, sums = exact(v)
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: sum((50 * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in enumerate(distinct)}


def test_different_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="from 1 to 2"):
        whitened(table(spark, [[1.0], [1.0, 2.0]]))


def test_given_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = {r["vec_id"]: r["embedding"] for r in e.collect()}
    order = sorted(v)
    assert order == list(range(len(order)))
    check(spark, [v[i] for i in order], whitened(e).collect())


def test_passes_over_the_data_converge_early(spark):
    """With a fast fall of the eigenvalues a few passes do, and the operator is the covariance."""
    random = np.random.default_rng(5)
    d = 120
    x = (random.standard_normal((2000, d)) * 0.5 ** np.minimum(np.arange(d), 40) * 50).tolist()
    model = fit_whitening(_whole(table(spark, x), "vec_id", "embedding"), 3, 6)
    assert model.passes < 12 and model.residual <= 1e-13 * model.values[0]
    fit = _whole(table(spark, [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25]]), "vec_id", "embedding").select("x")
    rows = np.array([[256, 512], [768, -256], [128, 64]], float)
    centred = rows - rows.mean(axis=0)
    assert np.allclose(_Centred(fit, 3, [1152, 320]).times(np.eye(2)), centred.T @ centred / 3)


@pytest.mark.parametrize(("d", "k", "block", "most", "rank"), [(64, 4, 16, 512, 64), (64, 4, 4, 20, 64), (3, 4, 16, 512, 3), (200, 4, 8, 40, 200), (300, 4, 8, 60, 10), (1, 4, 16, 512, 1), (90, 4, 8, 64, 2)])
def test_breakdowns_and_new_starts(d, k, block, most, rank):
    random = np.random.default_rng(d + rank)
    x = random.standard_normal((1000, rank)) @ random.standard_normal((rank, d))
    v = x.T @ x / 1000
    values, vectors, residual = block_lanczos(lambda q: v @ q, d, k, block, most)
    true = np.linalg.eigvalsh(v)[::-1][: min(k, d)]
    assert np.allclose(values, true, atol=1e-12 * true[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(true)), atol=1e-12)
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * true[0] and residual <= 1e-12 * true[0]


def test_equal_eigenvalues_and_zero():
    values, vectors, _ = block_lanczos(lambda q: 2 * q, 30, 4, 6, 40)
    assert np.allclose(values, 2) and np.allclose(vectors.T @ vectors, np.eye(4))
    assert np.allclose(block_lanczos(lambda q: 0 * q, 30, 4, 6, 40)[0], 0)
