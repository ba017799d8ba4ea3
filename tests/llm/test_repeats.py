"""Repeated byte strings against brute force."""

import random
from collections import Counter

import numpy as np

from doctriage.llm import repeats


def _brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(d, gone) if not g), sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))))
    return out


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(n))


def _check(spark, texts, length=400, gram=256):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, place string")
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, length=length, gram=gram).collect()}
    want = _brute(texts, length)
    assert [(bytes(got[i].kept), len(got[i].spans)) for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    return want


def test_passages_of_all_lengths_and_places(spark):
    rng = random.Random(1)
    shared = [_words(rng, k) for k in (60, 80, 95, 110, 130, 400)]
    texts = [_words(rng, rng.randint(1, 200)) for _ in range(40)]
    for _ in range(60):
        parts = [_words(rng, rng.randint(0, 60)), rng.choice(shared), _words(rng, rng.randint(0, 60))]
        if rng.random() < 0.3:
            parts.insert(1, rng.choice(shared)[rng.randint(0, 50) :])
        texts.append("".join(parts))
    texts += [texts[3], texts[45], None, "", "a", "ab" * 900, "line\n" * 500, "x" * 399, "y" * 400, "z" * 401]
    want = _check(spark, texts)
    assert sum(n for _, n in want) > 40


def test_exactly_the_length(spark):
    rng = random.Random(2)
    core = _words(rng, 400)[:400]
    core = core.encode()[:400].decode("utf-8", "ignore").ljust(400, "q")[:400]
    cores = [core.encode("ascii", "ignore").decode().ljust(400, "q"), core.encode("ascii", "ignore").decode().ljust(400, "q")[:399]]
    for c in cores:
        texts = [f"{i}{_words(rng, i)}<{c}>{_words(rng, 30 - i)}{i}" for i in range(6)]
        _check(spark, texts)


def test_many_copies_and_no_rows(spark):
    rng = random.Random(4)
    text = _words(rng, 300)
    _check(spark, [text] * 50 + [text + " tail", "head " + text])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(6)
    one, two = _words(rng, 200), _words(rng, 200)
    docs = spark.createDataFrame([(None, one), (None, one), (4, two), (4, one)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, len(r.kept)) for r in repeats.remove_repeats(docs).collect())
    assert got == [(0, 0), (0, 0), (4, 0), (4, len(two.encode()))]


def test_long_texts_are_cut_in_blocks(monkeypatch):
    rng = random.Random(8)
    data = _words(rng, 3000).encode()
    whole = repeats.anchors(data)
    monkeypatch.setattr(repeats, "_BLOCK", 1500)
    parts = repeats.anchors(data)
    expand = lambda found: [p for p, a, b in zip(*found[:3]) for _ in range(int(a), int(b) + 1)]
    assert expand(whole) == expand(parts)


def test_multikey_order_sorts():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, k, 30_000) for k in (2, 3, 5000)]
    order = repeats.multikey_order(columns)
    rows = list(zip(*(c[order].tolist() for c in columns)))
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(30_000))
    same = [np.zeros(20_000, np.int64)] * 3
    assert sorted(repeats.multikey_order(same).tolist()) == list(range(20_000))


def test_copies_of_a_row_are_searched_once(spark):
    """Rows equal in id and text, beside one that shares most of it: places and windows are those of two texts, however many copies."""
    import random

    rng = random.Random(6)
    shared = "".join(rng.choices("abcdefgh ", k=3000))
    copy = shared + "".join(rng.choices("abcdefgh ", k=600))
    rows = [(1, copy)] * 3000 + [(2, "x" + shared + "y"), (None, copy), (3, "short")] + [(4, "short")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    assert all(len(r.kept) == 0 and r.n_bytes == 3600 for r in got if r.doc_id in (None, 1))
    assert [bytes(r.kept) for r in got if r.doc_id == 2] == [b"xy"]
    assert sum(bytes(r.kept) == b"short" for r in got) == 51
