"""Ranked search against a plain computation."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctriage.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for (i, _), c, n in zip(docs, counts, sizes):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * n * n_docs) // total)))
            if score > 0:
                rows.append((score, i))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, rank, i, score) for rank, (score, i) in enumerate(rows[:k], 1)]
    return sorted(out, key=repr)


def result(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    clash = {c: F.lit("x") for c in ("query", "doc", "task", "rank", "score", "item", "term")}
    return sorted((tuple(r) for r in lexical.search(d.withColumns(clash), q.withColumns(clash), **options).collect()), key=repr)


DOCS = [(i, t) for i, t in enumerate(["red fox", "Red fox RED", "the fox, the hound", "", None, "blau-grün 42", "fox " * 3000, "§§ grün", "red", "red", "the the the"])]
ITEMS = [(1, "red fox"), (2, "RED red red"), (3, "grün 42 missing"), (4, ""), (5, None), (6, "absent"), (7, "the"), (1, "the red")]


@pytest.mark.parametrize("tile", [{}, {"tile_items": 2, "tile_entries": 3}])
def test_small_tables(spark, tile):
    assert result(spark, DOCS, ITEMS, k=4, **tile) == brute(DOCS, ITEMS, 4)


def test_ties_go_by_id_whatever_the_blocks(spark):
    docs = [(i, "same words here") for i in range(3000, 0, -1)] + [(None, "same words here")] * 3 + [(9, "same words here")] + [(i, "others") for i in range(4000, 9000)]
    want = brute(docs, [(1, "words")], 20)
    assert result(spark, docs, [(1, "words")]) == want and [r[2] for r in sorted(want, key=lambda r: r[1])][8:10] == [9, 9]


def test_repeated_items_and_null_ids(spark):
    items = [(1, "fox")] * 3 + [(None, "fox")]
    assert result(spark, DOCS, items, k=2) == brute(DOCS, items, 2)


def test_empty_tables(spark):
    assert result(spark, [], ITEMS) == [] and result(spark, DOCS, []) == [] and result(spark, [(1, ""), (2, None)], ITEMS) == []


def test_slabs_stay_below_their_bound_and_lose_nothing():
    rng = np.random.default_rng(1)
    entries = [(int(i), int(c), int(rng.integers(1, 90))) for i in range(6) for c in rng.permutation(30)[:20]]
    entries.append((2, 31, 1000))  # larger than a slab by itself
    cut = lexical.slabs(entries, 6, most=100, columns=7)
    whole = np.zeros((6, 32))
    for slab in cut:
        m = slab.matrix(6)
        assert m.sum(axis=1).max() <= 100 and len(slab.columns) <= 7
        whole[:, slab.columns] += m
    want = np.zeros((6, 32))
    for i, c, v in entries:
        want[i, c] += v
    assert (whole == want).all()


def test_sums_beyond_two_to_the_53_are_exact(spark):
    docs = [(1, "w"), (2, "w w"), (3, "x")]
    items = [(1, "w " * 300_000)]
    small = lexical.SLAB_SUM
    assert small * 10**6 < 2**53
    entries = [(0, 0, small * 3 + 1)]
    cut = lexical.slabs(entries, 1)
    assert len(cut) == 4 and sum(int((s.matrix(1) @ np.full((1, 1), 999_999.0))[0, 0]) for s in cut) == (small * 3 + 1) * 999_999
    assert result(spark, docs, items) == brute(docs, items, 20)
