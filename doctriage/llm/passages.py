"""Repeated passages by relative Lempel-Ziv parsing against all earlier documents.

The reference of a document is everything before it: earlier documents and its own earlier words.  It is
held as an index of blocks.  A block is the stretch of words that some consecutive windows (of
``length`` words) cover that share an anchor, the gram of least hash in each of them; equal windows have equal
anchors, so equal passages are cut into equal blocks wherever they stand.  The index has every block
of the corpus under the digest of its words, with the first place it stands at.

1. Every document looks up its blocks.  Blocks found at an earlier place, one after the other at the same
   distance, make up a factor as long as the text goes on like its source.
2. A factor ends inside a block that is not in the reference as a whole, though another block has the same
   anchor.  At these boundaries the parse goes on by single words: windows of such blocks are
   looked up in an index of windows, and lengthen the factors they join or make factors of their own.
3. Factors are at least ``length`` words long; the words under them go.

A text that occurs several times is parsed once: whatever its later copies hold has its source in the first.
Indexes are aggregates, combined before they are shuffled, so neither a hot passage nor a hot text
gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from doctriage.llm.common import byte_texts, forget, longs, ship, slices, stored
from doctriage.llm.membership import bits_of, hit, may_hold, places, test_of
from doctriage.llm.rolling import BASES, FIRST, Rolling, mixed

LENGTH = 20
GRAM = 8
#: Words from here on are hashed on their own; shorter ones, which is nearly all, together.
_LONG_WORD = 512
#: Words that are worked on at a time; places in a block fit in 20 bits.
_BLOCK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

FACTORS = "array<struct<start: long, end: long, source_id: {}, source_start: long>>"


class _Words(Rolling):
    """Hashes of stretches of words from the hashes of the words."""

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mixed(data ^ np.uint64(self.base)) * up[: len(data)], out=out[1:])
        return out


_ONE, _TWO = (_Words(b) for b in BASES)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in bytes."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    hashes = FIRST.of(FIRST.prefixes(np.frombuffer(text, np.uint8)), starts, ends)
    hashes = mixed(hashes ^ (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= _LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return hashes


def blocks(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, first window, last window, anchor's hash) of every run of windows that share an anchor.

    The anchor is the leftmost gram of least hash, so it depends on the window's words alone.
    """
    found = []
    step = _BLOCK - length
    for base in range(0, max(len(words) - length + 1, 0), step):
        grams = _ONE.all_of(_ONE.prefixes(words[base : base + _BLOCK - 1]), gram)
        least = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have < width:
            by = min(have, width - have)
            least = np.minimum(least[:-by], least[by:])
            have += by
        at = (least[:step] & np.uint64(0xFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        found.append((at[new] + base, new + base, np.append(new[1:], len(at)) - 1 + base, grams[at[new]]))
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def _without(part: pa.RecordBatch, copies) -> pa.RecordBatch:
    """The rows that are certainly no copies, by the places in columns 3 and 4."""
    if copies is None:
        return part
    return part.filter(pa.array(~hit(copies.value, longs(part.column(3)), longs(part.column(4)))))


def _emit_blocks(length: int, gram: int, copies=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            part = _without(part, copies)
            rows, taken = [], []
            for i, text in enumerate(byte_texts(part.column(2))):
                words = word_hashes(text, *word_bounds(text))
                at, first, last, grams = blocks(words, length, gram)
                if not len(at):
                    continue
                shape = ((at - first) << 8 | (last - first)).astype(np.uint64)
                digest = _TWO.of(_TWO.prefixes(words), first, last + length) ^ mixed(shape + np.uint64(1))
                rows.append((grams.view(np.int64), digest.view(np.int64), first, (last - first).astype(np.int32)))
                taken += [i] * len(at)
            if rows:
                who = pa.array(taken, pa.int64())
                columns = [pa.array(np.concatenate(c)) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*columns, part.column(0).take(who), part.column(1).take(who)], ["anchor", "digest", "first", "more", "id", "tag"])

    return run


def _emit_windows(length: int):
    """Of each text, the windows of the given blocks under a digest of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            rows, taken = [], []
            for i, (text, places) in enumerate(zip(byte_texts(part.column(2)), part.column(3).to_pylist())):
                words = word_hashes(text, *word_bounds(text))
                starts = np.concatenate([np.arange(p["first"], p["first"] + p["more"] + 1) for p in places])
                rows.append([*(h.of(h.prefixes(words), starts, starts + length).view(np.int64) for h in (_ONE, _TWO)), starts])
                taken += [i] * len(starts)
            if rows:
                who = pa.array(taken, pa.int64())
                columns = [pa.array(np.concatenate(c)) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*columns, part.column(0).take(who), part.column(1).take(who)], ["one", "two", "first", "id", "tag"])

    return run


def parse(found: list[dict], length: int) -> list[dict]:
    """Greedy factors from stretches of windows with an earlier place.

    ``found`` has (first, more, source_id, source_tag, source_first): windows first to first + more stand at source_first and
    on.  A factor takes in the next stretch as long as it goes on in the same source; a stretch that
    does not begins another factor.
    """
    factors: list[dict] = []
    for f in sorted(found, key=lambda f: (f["first"], -f["more"])):
        end, source = f["first"] + f["more"] + length, (f["source_id"], f["source_tag"], f["source_first"] - f["first"])
        last = factors[-1] if factors else None
        if last and end <= last["end"]:
            continue
        if last and source == last["source"] and f["first"] <= last["end"] - length + 1:
            last["end"] = end
        else:
            factors.append({"start": f["first"], "end": end, "source": source})
    return [{"start": f["start"], "end": f["end"], "source_id": f["source"][0], "source_start": f["start"] + f["source"][2]} for f in factors]


def covered(factors: list[dict]) -> list[tuple[int, int]]:
    """The words under the factors, as runs [start, end)."""
    runs: list[tuple[int, int]] = []
    for f in sorted(factors, key=lambda f: f["start"]):
        if runs and f["start"] <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], f["end"])
        else:
            runs.append((f["start"], f["end"]))
    return runs


def _kept(text: bytes, factors: list[dict], words: tuple[np.ndarray, np.ndarray]) -> tuple[int, bytes]:
    starts, ends = words
    stay = np.ones(len(starts), bool)
    for a, b in covered(factors):
        stay[a:b] = False
    return int(len(stay) - stay.sum()), b" ".join(text[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist()))


_RESULT = ["id", "n_words", "n_removed", "factors", "kept", "times"]


def _cut_whole(listed, copies, kind: pa.DataType):
    """Results of the rows that certainly have no entry and are no copies: nothing goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            part = _without(part, copies)
            part = part.filter(pa.array(~hit(listed.value, longs(part.column(5)), longs(part.column(6)))))
            counts, kept = [], []
            for text in byte_texts(part.column(2)):
                words = word_bounds(text)
                counts.append(len(words[0]))
                kept.append(_kept(text, [], words)[1])
            n = len(counts)
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array([0] * n, pa.int64()), pa.array([[]] * n, kind), pa.array(kept, pa.binary()), pa.array([1] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, _RESULT)

    return run


def _cut(length: int, kind: pa.DataType):
    """Results of rows (id, text, found, copy_of, times); a later copy of a text is one factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            rows, sources = [], part.column(3).to_pylist()
            for text, found, copy_of in zip(byte_texts(part.column(1)), part.column(2).to_pylist(), sources):
                words = word_bounds(text)
                n = len(words[0])
                if copy_of is not None:
                    factors = [{"start": 0, "end": n, "source_id": copy_of["id"], "source_start": 0}] if n >= length else []
                else:
                    factors = parse(found or [], length)
                rows.append((n, factors, *_kept(text, factors, words)))
            counts, factors, removed, kept = ([r[i] for r in rows] for i in range(4))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(factors, kind), pa.array(kept, pa.binary()), part.column(4)]
            yield pa.RecordBatch.from_arrays(columns, _RESULT)

    return run


def _place(first: str = "first") -> Column:
    """What orders places: documents by id (NULLs last) and tag, then words."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "tag", F.col(first).alias("first"))


def _found(places: DataFrame, index: DataFrame, keys: list[str], more: Column) -> DataFrame:
    """Places that the index has an earlier one for."""
    joined = places.join(index, keys)
    return joined.where(_place() != F.col("source")).select(
        "id", "tag", "first", more.alias("more"),
        F.col("source.id").alias("source_id"), F.col("source.tag").alias("source_tag"), F.col("source.first").alias("source_first"),
    )


_COPY, _OWN = ("copy_a", "copy_b"), ("own_a", "own_b")


class _Texts:
    """Distinct texts (id, tag, text): rows that no filter takes for copies, and the stored first rows of texts that occur again."""

    def __init__(self, rows: DataFrame, copies, firsts: DataFrame):
        self.rows, self.copies, self.firsts = rows, copies, firsts.select("id", "tag", "text")

    def map(self, function, schema: str) -> DataFrame:
        """``function(copies)`` over the rows; for the first rows, which are none, without a filter."""
        own = places(F.xxhash64("id", "tag"), _OWN)
        rows = self.rows.select("id", "tag", "text", *places(F.xxhash64("digest"), _COPY), *own)
        firsts = self.firsts.select("id", "tag", "text", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), *own)
        return rows.mapInArrow(function(self.copies), schema).unionByName(firsts.mapInArrow(function(None), schema))

    def that(self, test: Column) -> DataFrame:
        """(id, tag, text) of the texts that a test of (id, tag) lets pass; only its keys go through Python."""
        rows = self.rows.where(test & ~test_of(self.copies)(F.xxhash64("digest")))
        return rows.select("id", "tag", "text").unionByName(self.firsts.where(test))


def _parsed(texts: _Texts, length: int, gram: int, kind: str) -> DataFrame:
    """(i, t, found): by document, the stretches of windows that stand at an earlier place."""
    place = f"id {kind}, tag long"
    all_blocks = texts.map(lambda copies: _emit_blocks(length, gram, copies), f"anchor long, digest long, first long, more int, {place}")
    all_blocks = stored(all_blocks, "passage-blocks")
    # Anchors that stand once need no index; of the others, whether all their blocks are the same.
    again = all_blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("digest") != F.max("digest")).alias("mixed"))
    again = stored(again.where("n > 1").select("anchor", "mixed"), "passage-anchors")
    near = stored(all_blocks.where(may_hold(again.select("anchor"))(F.col("anchor"))).join(again, "anchor"), "passage-near")
    forget(all_blocks)
    index = near.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("source"), F.max("more").alias("more"), F.max("mixed").alias("mixed"))
    index = stored(index, "passage-index")
    whole = _found(near.drop("mixed"), index.where("n > 1").select("anchor", "digest", "source"), ["anchor", "digest"], F.col("more"))

    # Blocks at the boundaries of factors: only the first of equal ones, the others are whole factors.
    ends = index.where("mixed").select(F.col("source.id").alias("i"), F.col("source.tag").alias("t"), F.struct(F.col("source.first").alias("first"), "more").alias("block"))
    ends = stored(ends.groupBy("i", "t").agg(F.collect_list("block").alias("blocks")), "passage-ends")
    some = texts.that(may_hold(ends.select(F.xxhash64("i", "t").alias("key")))(F.xxhash64("id", "tag")))
    holding = some.join(ends, some.id.eqNullSafe(ends.i) & (some.tag == ends.t)).select("id", "tag", "text", "blocks")
    windows = stored(holding.mapInArrow(_emit_windows(length), f"one long, two long, first long, {place}"), "passage-windows")
    first = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("source")).where("n > 1").select("one", "two", "source")
    single = _found(windows, stored(first, "passage-window-index"), ["one", "two"], F.lit(0))

    stretches = whole.unionByName(single).groupBy(F.col("id").alias("i"), F.col("tag").alias("t"))
    found = stretches.agg(F.collect_list(F.struct("first", "more", "source_id", "source_tag", "source_first")).alias("found"))
    found = stored(found, "passage-found")
    for table in (near, index, ends, windows):
        forget(table)
    return found


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: id_col, n_words, n_removed, factors (start, end, source_id, source_start, in words), kept (the other words, one blank between, UTF-8).

    A word goes if ``length`` consecutive words over it also start at an earlier place: in a document of
    smaller id, or before in the same document.  Words are runs of other bytes than blanks, tabs and line ends.  NULL texts have
    none.  NULL ids come last; rows that share an id follow each other by a digest of their text, and of
    rows equal in both one is the first.  Texts shorter than ``length`` words are kept whole.
    No rows, no result.  Other columns are not read.
    """
    if not 0 < gram <= length <= 255 + gram:
        raise ValueError("gram has to be between 1 and length, and at least length - 255")
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = dict(rows.dtypes)["id"]
    digest = F.md5(F.col("text").cast("binary"))
    tag = F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long")
    rows = rows.withColumn("digest", digest).withColumn("tag", tag)

    # Texts that occur again: the first of the rows with a text stands for all.
    copies = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("times"))
    first = copies.groupBy("digest").agg(F.sum("times").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "times")).alias("first"))
    first = stored(first.where("n > 1").select("digest", "first"), "passage-copies")
    bits = bits_of(first.select(F.xxhash64("digest").alias("key")))
    maybe = rows.where(test_of(bits)(F.xxhash64("digest")))
    doubtful = stored(maybe.join(first, "digest", "left"), "passage-doubtful")
    is_first = F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first.id"))
    # Rows equal in id and text: one is the first, whichever, and the others are copies of it.
    several = F.coalesce(F.col("first.times") > 1, F.lit(False))
    one = doubtful.where(is_first & several).dropDuplicates(["digest", "id"])
    columns = ["id", "tag", "text"]
    texts = _Texts(rows, bits, doubtful.where(is_first & ~several).select(columns).unionByName(one.select(columns)))

    found = _parsed(texts, length, gram, kind)
    listed = bits_of(found.select(F.xxhash64("i", "t").alias("key")))
    shape = to_arrow_type(T._parse_datatype_string(FACTORS.format(kind)))
    schema = f"id {kind}, n_words long, n_removed long, factors {FACTORS.format(kind)}, kept binary, times long"
    plain = texts.map(lambda copies: _cut_whole(listed, copies, shape), schema)
    no_copy, once = F.lit(None).cast(f"struct<id: {kind}>").alias("copy_of"), F.lit(1).cast("long").alias("times")
    no_list, copy_of = F.lit(None).cast(dict(found.dtypes)["found"]).alias("found"), F.struct(F.col("first.id").alias("id")).alias("copy_of")
    some = texts.that(test_of(listed)(F.xxhash64("id", "tag")))
    some = some.join(found, some.id.eqNullSafe(found.i) & (some.tag == found.t), "left").select("id", "text", "found", no_copy, once)
    later = doubtful.where(~is_first).select("id", "text", no_list, copy_of, once)
    surplus = one.select("id", "text", no_list, copy_of, (F.col("first.times") - 1).alias("times"))
    cut = plain.unionByName(some.unionByName(later).unionByName(surplus).mapInArrow(_cut(length, shape), schema))
    # Copies of a row are made of its result, in two steps, so that none of them is large.
    step = 1024
    shares = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / step)), lambda i: F.least(F.lit(step).cast("long"), F.col("times") - i * step))
    dealt = cut.withColumn("share", F.explode(shares)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share"))))
    return dealt.select(F.col("id").alias(id_col), "n_words", "n_removed", "factors", "kept")
