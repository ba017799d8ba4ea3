"""Whitening against a plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctriage.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def check_eigen(matrix):
    values, vectors = whitening.eigen(matrix)
    scale = np.linalg.norm(matrix) or 1.0
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() <= 1e-13 * scale
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() <= 1e-13


def test_eigen_of_many_kinds():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    for spectrum in (np.arange(24.0), np.ones(24), np.r_[np.ones(12), np.full(12, 2.0)], 2.0 ** -np.arange(24), np.r_[1 + 1e-13 * np.arange(12), np.arange(12) + 3.0], np.r_[5.0, np.zeros(23)]):
        check_eigen((m := (q * spectrum) @ q.T) / 2 + m.T / 2)
    for size in (1, 2, 3, 17, 64):
        x = rng.normal(size=(200, size)) * np.linspace(1, 9, size)
        check_eigen(x.T @ x / 200)
    check_eigen(np.zeros((4, 4)))
    check_eigen(np.ones((9, 9)))
    check_eigen(np.array([[2.0, 1.0], [1.0, 2.0]]))


def test_polar_factor_is_the_sign():
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(10, 10)))[0]
    d = np.array([3, 1e-9, 1, 7, 2, -1e-12, -4, -1, -2, -100.0])
    sign = whitening.polar_factor((q * d) @ q.T)
    assert np.abs(sign @ sign - np.eye(10)).max() < 1e-12 and round(np.trace(sign)) == 0


def brute(vectors):
    """n, and by row (deviation, whitened but for its sign, explained) of rows that are all finite."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    y = (n * u - sums) / n
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:16], w[:, ::-1][:, :16]
    return n, ((n * x - sums) ** 2).sum(axis=1), (n * x - sums) / n @ w / np.sqrt(e), e / np.trace(v)


def test_whole_table(spark):
    vectors = queries.table(spark, SF, "embeddings").select("vec_id", "embedding").toPandas()
    got = queries.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, explained = brute(vectors["embedding"].tolist())
    order = np.argsort(vectors["vec_id"].to_numpy())
    table = got["whitened"].to_numpy().reshape(len(vectors), 16)
    assert (got["n"] == n).all() and (got["deviation"].to_numpy().reshape(-1, 16) == deviation[order][:, None]).all()
    assert np.abs(np.abs(table) - np.abs(whitened[order])).max() < 1e-9
    signs = np.sign((table * whitened[order]).sum(axis=0))
    assert np.abs(table - signs * whitened[order]).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 16), explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert got.dtypes["deviation"] == "int64"


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.0, -2.0], [0.25, 3.0, 1.0], [7.0, -1.0, 0.0], [1.0, 1.0, 1.0]]
    rows = list(enumerate(good)) + [(9, None), (10, [1.0, None, 2.0]), (11, [nan, 1.0, 1.0]), (12, [inf, 0.0, 0.0]), (13, []), (0, good[0]), (None, good[1])]
    rows += [(20, [1.0, 5.0]), (21, [2.0, 5.0]), (22, [4.0, 5.0]), (30, [3.0] * 5), (31, [3.0] * 5)]
    clash = {c: F.lit(1) for c in ("id", "x", "size", "n", "component", "whitened")}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(clash)
    got = whitening.whiten(df).toPandas()
    three = got[got["n"] == 4]
    assert sorted(three["vec_id"].fillna(-1)) == sorted([-1] * 3 + [0] * 6 + [1] * 3 + [2] * 3 + [3] * 3)
    n, deviation, whitened, _ = brute(good)
    one = three[three["vec_id"] == 2].sort_values("component")
    assert np.abs(np.abs(one["whitened"]) - np.abs(whitened[2])).max() < 1e-9 and int(one["deviation"].iloc[0]) == deviation[2]
    # Three vectors of two entries, one without variance, have one component; equal vectors have none.
    assert sorted(got[got["n"] == 3]["vec_id"]) == [20, 21, 22] and set(got["vec_id"].dropna()) == {0, 1, 2, 3, 20, 21, 22}


def test_large_entries(spark):
    """Deviations beyond 64 bits are exact decimals, and NULL in the query's form; what is no 62-bit integer is left out."""
    rows = [(0, [2.0**40, 1.0]), (1, [-(2.0**40), 2.0]), (2, [3.0, 9.0]), (3, [1e300, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows[:3]]
    sums = [sum(v[i] for v in x) for i in range(2)]
    want = {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert set(got["vec_id"]) == {0, 1, 2} and {int(i): int(d) for i, d in zip(got["vec_id"], got["deviation"])} == want
    assert max(want.values()) > 1 << 64


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])]):
        found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert found.collect() == [] and found.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_numerators_are_exact_beyond_64_bits():
    centre = whitening.Centre(10**13, np.array([10**19, 3], object))
    assert centre.numerators(np.array([[1_000_001, 0]])).tolist() == [[10**13, -3]]


def test_too_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_DIMENSIONS", 2)
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"))
