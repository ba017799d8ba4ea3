"""SimHash links, components and deduplication against brute force."""

import hashlib
import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from doctriage.llm import simhash
from doctriage.llm.graph import components


def _groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def _fingerprint(text, words):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 30, 200]))) for _ in range(60)]
    for t in list(texts[:40]):
        words = t.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts += [" ".join(words), t.upper(), t]
    return texts + [None, "", "   \n\t ", "one", "x " * 30_000]


def test_components_equal_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "other", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, id int")
    got = {r.doc_id: r for r in simhash.near_copies(docs, words=4, distance=4).collect()}
    prints = [_fingerprint(t, 4) for t in texts]
    assert [int(got[i].fp) % 2**64 for i in range(len(texts))] == prints
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = _groups(near, range(len(texts)))
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(texts) - 40


def test_links_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(40)]
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in near})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = [
        {(r.node, r.root) for r in components(simhash.links(nodes, 4, tile)).collect()} for tile in (3, 4096)
    ]
    assert found[0] == found[1]
    pairs = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) % 2**64).bit_count() <= 4]
    want = _groups(pairs, fps)
    linked = {x for p in pairs for x in p}
    assert {n for n, _ in found[0]} == linked
    assert {n: r for n, r in found[0]} == {n: want[n] for n in linked}


def test_segments_leave_at_most_one_difference():
    for distance in range(2, 12):
        cuts = simhash.segments(distance)
        assert sum(w for _, w in cuts) == 64 and 2 * len(cuts) > distance


def test_null_ids_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or -1) for r in simhash.near_copies(docs).collect())
    assert got == [(False, 7, 7), (False, 7, 7), (True, 0, -1), (True, 0, 7)]
    empty = docs.where("false")
    assert simhash.near_copies(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0


def _kept(rows, words=4, distance=4):
    """(id, text) of the rows that stay: the first of each group by id, NULL last; rows that share an id go by their text's digest."""
    prints = [_fingerprint(t, words) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= distance]
    first = {}
    for n, group in _groups(near, range(len(rows))).items():
        i, t = rows[n]
        place = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest()[:15])
        if group not in first or place < first[group][0]:
            first[group] = place, rows[n]
    return sorted(((i, t or "") for _, (i, t) in first.values()), key=repr)


def test_deduplicated_equals_brute_force(spark):
    texts = _texts()
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[9]), (None, texts[5]), (None, "by itself " * 9), (None, "by itself " * 9)]
    clash = ["id", "tag", "fp", "root", "first", "gone", "key", "open", "may", "row", "i", "t", "n", "a.b"]
    docs = spark.createDataFrame([(i, t, *[str(i)] * len(clash)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clash))
    kept = simhash.deduplicated(docs.repartition(3))
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(((r["doc_id"], r["text"] or "") for r in found), key=repr) == _kept(rows)
    assert all(r["gone"] == str(r["doc_id"]) == r["a.b"] for r in found)


def test_hot_copies_and_repeated_rows(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    hot = " ".join(rng.choices(words, k=60))
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(30)] + [(100 + i, hot) for i in range(3000)] + [(7, "again and again")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()), key=repr)
    assert got == _kept(rows[:31] + [rows[-1]])


def test_texts_beyond_the_distance_stay(spark):
    one = " ".join(f"a{i}" for i in range(100))
    half = " ".join(f"a{i}" for i in range(50)) + " " + " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, one), (2, half)], "doc_id long, text string")
    assert simhash.deduplicated(docs).count() == 2


def test_chain_of_links_is_one_component(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    star = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(star).where("root <> 0").count() == 0
