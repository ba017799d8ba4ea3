"""Benchmark items in documents, against brute force."""

import random

from doctriage.llm import contamination
from doctriage.llm.common import PLAIN


def _shingles(text, words=5):
    parts = (text or "").encode().translate(PLAIN).split()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def _brute(docs, items, least=0.8):
    out = set()
    for d, text in docs:
        size = len((text or "").encode().translate(PLAIN).split())
        for i, item in items:
            # An item of fewer words than a shingle is looked for among shingles of as many words.
            words = min(5, max(1, len((item or "").encode().translate(PLAIN).split())))
            have, want = _shingles(text, words) if size >= words else set(), _shingles(item, words)
            n = len(have & want)
            if want and n >= least * len(want) - 1e-9:
                out.add((d, i, n, len(want)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 6, 12, 40, 300])))) for i in range(40)] + [(90, None), (91, " .. "), (92, "W1, w2! W3 w4 w5 w6")]
    items.append((93, items[3][1]))
    docs = []
    for d in range(150):
        parts = rng.choices(words, k=rng.choice([0, 3, 50, 3000]))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1] or ""
            piece = item.split()
            for _ in range(rng.randint(0, 2)):
                if piece:
                    piece[rng.randrange(len(piece))] = rng.choice(words)
            at = rng.randint(0, len(parts))
            parts[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in piece[: rng.randint(0, len(piece))] if rng.random() < 0.99]
        docs.append((d, " ".join(parts)))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    d = spark.createDataFrame([(*x, "a") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = _brute(docs, items)
    for block in (4 << 20, 200):
        got = contamination.find_contained(d, i, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id, r.found, r.shingles) for r in got} == want and len(got) == len(want)
    clean = contamination.without_contained(d, i)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({x for x, _ in docs} - {x for x, *_ in want})


def test_short_items_inside_long_texts(spark):
    d = spark.createDataFrame([(1, "One two three four five six seven"), (2, "four, five"), (3, "five four " * 500), (4, "four")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "three four five"), (2, "FOUR five"), (3, "five"), (4, "four five"), (5, "six five four three two")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in contamination.find_contained(d, i).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (2, 4), (3, 2), (3, 3), (3, 4)]
    assert [r.doc_id for r in contamination.without_contained(d, i).collect()] == [4]


def test_columns_of_any_name_pass(spark):
    names = ["digest", "hit", "maybe", "row", "doc", "body", "item_id", "__hit", "a.b"]
    d = spark.createDataFrame([(1, "a b c d e f g", *names), (2, "clean", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    i = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    kept = contamination.without_contained(d, i).collect()
    assert [tuple(r) for r in kept] == [(2, "clean", *names)]


def test_empty_tables_and_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f g"), (1, "other words")], "doc_id long, text string")
    i = spark.createDataFrame([(None, "a b c d e f g")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contamination.find_contained(d, i).collect()] == [(None, None)]
    assert [r.doc_id for r in contamination.without_contained(d, i).collect()] == [1]
    assert contamination.find_contained(d.where("false"), i).count() == 0
    assert contamination.find_contained(d, i.where("false")).count() == 0
    assert contamination.without_contained(d, i.where("false")).count() == 2


def test_rows_of_one_id_are_decided_each(spark):
    bad, clean = "some words a b c d e f g", "nothing of the kind in here at all"
    rows = [(None, bad, 1), (None, clean, 2), (None, None, 3), (7, bad, 4), (7, clean, 5), (7, clean, 6), (8, bad, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int")
    i = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    kept = contamination.without_contained(d, i)
    assert kept.columns == d.columns
    assert sorted(r.n for r in kept.collect()) == [2, 3, 5, 6]
