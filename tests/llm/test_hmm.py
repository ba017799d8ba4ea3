"""The language model: exact base scores, exact recursions, proper probabilities."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from doctriage.llm import hmm


def _model(rng, k, m):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, m))))


def _paths(model, seq):
    k = len(model.start)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[b, s]
        yield path, p


def test_recursions_equal_sums_over_paths():
    rng = np.random.default_rng(1)
    model = _model(rng, 3, 5)
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 4)]
    got = hmm.log_likelihoods(model, sequences)
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for seq, g in zip(sequences, got):
        weighed = list(_paths(model, seq))
        total = sum(p for _, p in weighed)
        assert abs(math.log10(total) - g) < 1e-9
        for path, p in weighed:
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for s, x in zip(path, seq):
                emits[s, x] += p / total
    for want, found in zip((starts, moves, emits), hmm.expected_counts(model, sequences, 5)):
        assert np.allclose(want, found)


def test_pieces_with_context_count_what_the_whole_does(spark):
    """Moves across cuts are counted, each once, and nothing of the context; with enough context the counts are those of whole sequences."""
    rng = np.random.default_rng(3)
    model = _model(rng, 3, 6)
    sequences = [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 90, 40, 133, 41)]
    whole = hmm.expected_counts(model, sequences, 6)
    pieces = hmm._segments([s.tobytes() for s in sequences], 20, 15)
    got = hmm.expected_counts(model, [s for s, _ in pieces], 6, [c for _, c in pieces])
    for want, found in zip(whole, got):
        assert np.allclose(want, found, atol=1e-3)
    assert abs(got[1].sum() - sum(len(s) - 1 for s in sequences)) < 1e-6 and abs(got[2].sum() - sum(map(len, sequences))) < 1e-6


def test_states_begin_with_all_rows(spark):
    """Leaning counts add up to all symbols of all rows, whatever the tasks, and copies of a text stay in one state."""
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 30, n).astype(np.uint16).tobytes() for n in (1, 5, 80, 300)] * 7
    df = spark.createDataFrame([(r,) for r in rows], "symbols binary")
    sums = [hmm._summed(df.repartition(n), hmm._leanings(30, 4, 29), 4, 30) for n in (1, 5)]
    assert np.array_equal(sums[0][2], sums[1][2])
    assert np.array_equal(sums[0][2].sum(axis=0), np.bincount(np.concatenate([np.frombuffer(r, np.uint16) for r in rows]), minlength=30))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    sequences = [np.repeat(rng.integers(0, 3) * 3, 1) + rng.integers(0, 3, 60) for _ in range(40)]
    model, unigram, before = _model(rng, 3, 9), np.full(9, 1 / 9), -1e9
    for _ in range(8):
        now = hmm.log_likelihoods(model, sequences).sum()
        assert now > before - 1e-6
        before = now
        model = hmm.reestimated(*hmm.expected_counts(model, sequences, 9), unigram, weight=1e-6)


TEXTS = [None, "", "The the THE end", "é É x", "new word\tnew\n\nword"] + [
    " ".join(random.Random(i).choices(["a", "b", "c"] if i % 2 else ["x", "y", "z", f"rare{i}"], k=3 + i)) for i in range(60)
] + ["a b c " * 4000]


def test_base_scores_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b", 2), (8, TEXTS[8], 1)], "doc_id long, text string, score int")
    got = hmm.score(docs, head=6, classes=4, states=2, passes=2).collect()
    rows = [(i, t) for i, t, _ in docs.collect()]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in lower(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (-1 if i is None else i, held(i), len(lower(t)), sum(counts[w] > 0 for w in lower(t)), n,
         round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lower(t)), 6))
        for i, t in rows
    )
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_no_training_rows_and_no_rows(spark):
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(only, "some words")], "doc_id long, text string")
    row = hmm.score(docs).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert row.base_score == 0 and math.isfinite(row.score)
    assert hmm.score(docs.where("false")).count() == 0


def test_words_of_a_class_share_its_probability():
    counts = {b"aaa": 5, b"bbb": 2, b"ccc": 1}
    total = sum(c + 0.1 for c in counts.values()) + 0.1  # and what is unknown
    assert abs(total - (sum(counts.values()) + 0.1 * (len(counts) + 1))) < 1e-12
