"""Top-k search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctriage.llm import covertree


def _brute(rows, is_query, k=5):
    """Every row by itself: equal ones and those that share an id are candidates for each other, and queries each."""
    clean = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(clean):
        if is_query(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(clean) if m != n and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def _found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = covertree.top_k(df, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(900, 1100)]  # one very common vector
    rows += [(1100, None), (1110, [None] * 8), (1120, [math.nan] * 8), (1130, [math.inf] * 8), (None, rows[0][1]), (1140, [0.0] * 8), rows[3]]
    want = _brute(rows, lambda q: q % 10 == 0)
    assert _found(spark, rows) == want
    assert _found(spark, rows, data_block=150, query_block=20) == want


def test_repeated_rows_and_ids(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [0.5])]
    assert _found(spark, rows) == [(0, 1, 1, 131072), (0, 2, 1, 131072), (0, 3, 2, 32768)] == _brute(rows, lambda q: q % 10 == 0)
    rng = random.Random(9)
    rows = [(rng.randrange(30), [float(rng.randrange(-3, 4)), float(rng.randrange(-3, 4))]) for _ in range(300)] + [(10, [2.0, 2.0])] * 40
    assert _found(spark, rows) == _brute(rows, lambda q: q % 10 == 0)
    assert _found(spark, rows, data_block=20, query_block=5) == _brute(rows, lambda q: q % 10 == 0)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 2**20 for _ in range(16)]) for i in range(60)]
    want = _brute(rows, lambda q: q % 10 == 0)
    assert max(abs(r[3]) for r in want) > 2**53 and _found(spark, rows) == want
    with pytest.raises(Exception, match="64 bits"):
        _found(spark, [(i, [2.0**40, 2.0**39 + i]) for i in range(20)])
    assert _found(spark, [(10, [1e300]), (11, [1.0]), (12, [2.0])]) == []


def test_products_are_exact_at_every_size():
    rng = np.random.default_rng(1)
    for size in (10, 2**20, 2**27, 2**30):
        a, b = rng.integers(-size, size, (5, 7)), rng.integers(-size, size, (6, 7))
        assert covertree.products(a, b).tolist() == (a.astype(object) @ b.astype(object).T).tolist()


def test_few_rows_and_mixed_sizes(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(10, [1.0, 2.0])]) == []
    rows = [(10, [1.0, 2.0]), (11, [0.5, -1.0]), (12, [1.0]), (20, [3.0]), (30, [])]
    assert _found(spark, rows) == _brute(rows, lambda q: q % 10 == 0)
    assert _found(spark, [(11, [1.0])]) == []


def test_tree_covers_its_rows():
    rng = np.random.default_rng(4)
    rows = rng.integers(-100, 100, (2000, 5))
    tree = covertree.CoverTree(rows, leaf=10)
    for node, members in enumerate(tree.members):
        far = np.sqrt(((rows[members] - rows[tree.centre[node]]) ** 2).sum(axis=1))
        assert far.max() <= tree.radius[node]
        if tree.below[node]:
            assert sorted(np.concatenate([tree.members[n] for n in tree.below[node]])) == sorted(members)


def test_pruning_leaves_pairs_out():
    rng = random.Random(5)
    rows = np.array([[rng.gauss(0, 1) + 40 * (i % 4 == a) for a in range(4)] for i in range(4000)]) * 256
    rows = rows.astype(np.int64)
    calls = []
    original = covertree.Best.add
    covertree.Best.add = lambda self, m, s, i: (calls.append(s.size), original(self, m, s, i))[1]
    try:
        best = covertree.search(covertree.CoverTree(rows[:200]), np.arange(200), covertree.CoverTree(rows), np.arange(4000), 5, np.full(200, covertree._NONE))
    finally:
        covertree.Best.add = original
    assert sum(calls) < 0.6 * 200 * 4000
    scores = rows[:200] @ rows.T
    scores[np.arange(200), np.arange(200)] = covertree._NONE
    assert (best.scores == np.sort(scores, axis=1)[:, ::-1][:, :5]).all()


def test_blocks_meet_without_copies_for_each_other(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = covertree.top_k(df, F.col("vec_id") % 10 == 0, data_block=20, query_block=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # A broadcast, or a shuffle of a row for every pair of blocks, is blocks of data times all queries.
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "explode(sequence(0" not in plan
    assert sorted(map(tuple, found.collect())) == _brute(rows, lambda q: q % 10 == 0)


def test_best_over_blocks_keeps_ties_in_order():
    kept = covertree._Kept(0, np.array([5, 6]), np.array([1, 1]), np.array([0, 0]), 2)
    at = lambda *pairs: tuple(np.array(x) for x in zip(*pairs))
    kept.add(at((0, 0), (0, 1)), np.array([9, 7]), np.array([30, 10]), np.array([1, 2]), np.array([1, 4]))
    kept.add(at((0, 0), (1, 0)), np.array([9, -3]), np.array([20, 8]), np.array([3, 4]), np.array([2, 1]))
    kept.add(at((0, 0),), np.array([7]), np.array([1]), np.array([5]), np.array([1]))
    out = kept.batch().to_pydict()
    assert [*zip(out["query_id"], out["vec_id"], out["score"], out["times"])] == [(5, 20, 9, 2), (5, 30, 9, 1), (6, 8, -3, 1)]
