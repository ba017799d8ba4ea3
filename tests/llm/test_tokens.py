"""Token counts and packing against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from doctriage.llm import packing, tokens

STRANGE = [
    None, "", " ", "\n\n", "a", " a", "a ", "  a  b\n\n c\t", "don't we'll I'M", "x<|endoftext|>y", "<|startoftext|> <|ENDOFTEXT|>",
    "no break thin space　wide", "é É ǅ ß İ Σας ΣΑΣ", "tabs\t\tand\r\nlines\x0b\x0c", "\x1cunits\x1f", "1234567890 12a3b",
    "!!!... ?!", "emoji 👩‍👩‍👧 ok", "z" * 3000, "word " * 3000, "السلام عليكم", "日本語 テスト。", "a\x85b",
]


def _random_texts():
    rng = random.Random(2)
    alphabet = "abcXYZ éßñ  \n\t'.,!?0123-_<|>é"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 400))) for _ in range(200)]


def test_counts_equal_the_library(spark, tmp_path):
    texts = STRANGE + _random_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        got = {r.doc_id: r for r in tokens.count_tokens(docs, path, cache=str(tmp_path / name)).collect()}
        if name.endswith(".json"):
            tokenizer = Tokenizer.from_file(path)
            want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            want = [len(model.encode(t or "")) for t in texts]
        assert [got[i].n_tokens for i in range(len(texts))] == want
        assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]


def test_the_cache_is_used_and_appended_to(spark, tmp_path):
    cache, path = str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (3, None), (None, "x")], "doc_id long, text string")
    assert tokens.count_tokens(docs, path, cache=cache).count() == 5
    table = spark.read.parquet(cache)
    assert table.count() == 3
    # A stored count is taken over, even a wrong one: nothing is encoded twice.
    version, digest = table.where("n_tokens = 2").select("version", "digest").first()
    more = spark.createDataFrame([(version, digest, -5)], tokens.CACHE_SCHEMA)
    more.write.mode("append").partitionBy("version").parquet(cache)
    got = tokens.count_tokens(docs.union(spark.createDataFrame([(9, "new text")], docs.schema)), path, cache=cache).collect()
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2, 9)} == {1: -5, 2: -5, 9: 2}
    assert spark.read.parquet(cache).where("n_tokens > 0").count() == 3
    assert tokens.count_tokens(docs.where("false"), path, cache=cache).count() == 0


def _cost(places, penalty, cuts, length):
    pen = dict(zip(places.tolist(), penalty.tolist()))
    total = 0.0
    for a, b in zip(cuts, cuts[1:]):
        n = b - a
        total += pen[b] + packing.SEQUENCE_COST + (0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else length - n)
    return total


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(30):
        length = 512
        places = np.array([0, *np.cumsum([rng.randint(1, 200) for _ in range(25)])])
        penalty = np.array([0.0, *(rng.choice([0.0, 8.0, 64.0]) for _ in range(25))])
        cuts = packing.best_cuts(places, penalty, length)
        best = {0: 0.0}
        for j in range(1, len(places)):
            options = []
            for i in range(j):
                n = int(places[j] - places[i])
                if n <= length:
                    free = n & (n - 1) == 0 and n >= packing.LEAST_POWER
                    options.append(best[i] + (0 if free else length - n) + penalty[j] + packing.SEQUENCE_COST)
            best[j] = min(options)
        assert cuts[0] == 0 and cuts[-1] == places[-1] and max(np.diff(cuts)) <= length
        assert abs(_cost(places, penalty, cuts, length) - best[len(places) - 1]) < 1e-6


def test_pieces_rebuild_every_document(spark, monkeypatch):
    texts = STRANGE + _random_texts() + ["One sentence here. And one more! " * 300, "unbroken " * 5000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "again", 0)] * 2, "doc_id long, text string, length int")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs.repartition(3), path).collect()
    tokenizer = Tokenizer.from_file(path)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for i, whole in ids.items():
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]
        assert sum(p.length for p in pieces) == len(whole) == pieces[0].doc_tokens
        for p in pieces:
            part = np.array(whole[p.start : p.start + p.length], "<u4")
            assert zlib.crc32(part.tobytes()) == p.ids_crc32
    assert sum(r.length for r in rows if r.doc_id is None) == 2 * len([*tokenizer.encode("again", add_special_tokens=False).ids, 1])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = []
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        lengths.append(sum(n for _, n in parts))
    assert max(lengths) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert padding < 0.2 * sum(lengths)  # three partitions, each with a last sequence
    assert packing.pack(docs.where("false"), path).count() == 0


def test_plain_words_have_the_library_s_ids():
    """Words that go to the model by themselves, in all letters that may: the ids are those of the whole library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = packing.encoder(path), Tokenizer.from_file(path)
    letters = "".join(map(chr, words.plain))
    assert set("abcdefghijklmnopqrstuvwxyz") <= set(letters) and len(letters) > 40
    rng = random.Random(3)
    some = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(4000)] + ["".join(rng.choices("aeinrstäéñ", k=9)) for _ in range(500)]
    some += ["straße", "œuvre", "naïve", "ﬁn", "e\u0301a", "a\u0308", "ǆ", "x" * 300]
    got = words._encode(some)
    for w, raw in zip(some, got):
        assert np.frombuffer(raw, np.uint32).tolist() == library.encode(w, add_special_tokens=False).ids, w
    assert not packing.encoder(public_tokenizers.path("byte_bpe_50k.json")).plain
