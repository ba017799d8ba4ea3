"""Repeated passages against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctriage.llm import passages, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """(id, words, removed, kept) of each row; rows in the order that counts."""
    seen, out = set(), []
    for i, text in rows:
        words = WORD.findall((text or "").encode())
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone[s : s + length] = True
            seen.add(window)
        out.append((i, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def result(docs, **options):
    found = passages.remove_passages(docs, **options)
    return sorted(((r[0], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_whole_table(spark):
    docs = queries.table(spark, SF, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = brute(rows, 20)
    assert result(docs) == want and sum(r[2] > 0 for r in want) > 10


def test_query_columns(spark):
    got = {r["doc_id"]: r for r in queries.op11_passages(spark, SF).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect())
    import hashlib

    for i, n, removed, kept in brute(rows, 20):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, removed, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    words = [chr(97 + i) * (i % 3 + 1) for i in range(4 if seed else 40)]
    passage = [[rng.choice(words) for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = []
        while len(text) < rng.randrange(0, 120):
            text += rng.choice(passage) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(1, 12))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(docs, length=12, gram=5) == brute(rows, 12)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    twenty = " ".join(f"x{i}" for i in range(20))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, twenty), (5, twenty + " end"), (6, "few words"), (6, "few words"),
        (7, long), (8, "y " * 50), (9, " ".join(["a"] * 30)), (10, "z" * 600 + " " + twenty),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "tag", "digest", "first", "maybe", "found", "times")})
    assert result(docs) == in_order(brute(rows, 20))


def test_repeated_rows_and_ids(spark):
    """Of equal rows one is the first; rows of one id follow each other by their text's digest; NULL ids are last."""
    text = " ".join(f"x{i}" for i in range(25))
    docs = spark.createDataFrame([(5, text)] * 2500 + [(None, text)] * 2 + [(3, text), (4, "a " + text)], "doc_id long, text string")
    got = result(docs)
    assert [r[:3] for r in got] == [(3, 25, 0), (4, 26, 25)] + [(5, 25, 25)] * 2500 + [(None, 25, 25)] * 2
    docs = spark.createDataFrame([(5, text)] * 3, "doc_id long, text string")
    assert [r[2] for r in result(docs)] == [0, 25, 25]
    docs = spark.createDataFrame([(5, text), (5, text + " tail")], "doc_id long, text string")
    assert sorted(r[2] for r in result(docs)) == [0, 25]


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


def test_factors_name_their_source(spark):
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["new", *a[2:], *b[:25], "end"]))]
    found = passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    factors = [tuple(f) for f in found.where("doc_id = 3").first()["factors"]]
    assert factors == [(1, 29, 1, 2), (29, 54, 2, 0)]


def test_parse_goes_on_in_the_same_source_only():
    def at(first, more, source, source_first):
        return {"first": first, "more": more, "source_id": source, "source_tag": 0, "source_first": source_first}

    found = [at(0, 2, 7, 10), at(3, 0, 7, 13), at(4, 1, 8, 0), at(4, 1, 8, 0)]
    assert passages.parse(found, 5) == [
        {"start": 0, "end": 8, "source_id": 7, "source_start": 10}, {"start": 4, "end": 10, "source_id": 8, "source_start": 0},
    ]


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        passages.remove_passages(spark.createDataFrame([], "doc_id long, text string"), length=4, gram=8)
