"""Test items inside documents, by MinHash containment with sizes told apart.

An item is contained in a document if a share of the item's shingles occurs in it.  The
MinHash sketch of an item keeps as many of its least shingle hashes as may be missing,
plus one: whatever the document lacks, one hash of the sketch is in it, so the search
loses nothing.  Items are partitioned by size, as the sketch's and the
least document's size follow from it; candidates are verified on the shingles themselves.

Items are a stated query set: they are broadcast in blocks of bounded bytes, and every
block passes over all documents, which stay where they are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.llm.common import PLAIN, byte_texts, ship, slices, stored
from doctriage.llm.membership import may_hold
from doctriage.llm.rolling import FIRST

WORDS = 5
LEAST = 0.8
#: Bytes of item texts that are broadcast at a time.
BLOCK_BYTES = 4 << 20


def word_bytes(text: bytes) -> bytes:
    """Words in lower case without ASCII punctuation, one blank between them."""
    return b" ".join(text.translate(PLAIN).split())


def shingle_bounds(joined: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles begin and end in joined words; fewer words than a shingle make one of all."""
    if not joined:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.append(0, blanks + 1)
    ends = np.append(blanks, len(joined))
    if len(starts) <= words:
        return starts[:1], ends[-1:]
    return starts[: len(starts) - words + 1], ends[words - 1 :]


def shingle_keys(joined: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, with their bounds."""
    starts, ends = shingle_bounds(joined, words)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    prefixes = FIRST.prefixes(np.frombuffer(joined, np.uint8))
    return FIRST.of(prefixes, starts, ends), starts, ends


def needed(size: int, least: float) -> int:
    return max(1, math.ceil(least * size - 1e-9))


class ItemIndex:
    """Sketches of one block of items, partitioned by the items' size (powers of two)."""

    def __init__(self, items: list[tuple[object, str | None]], words: int, least: float):
        self.words, self.least = words, least
        self.shingles: list[dict[int, bytes]] = []
        self.ids: list[object] = []
        self.holders: dict[int, list[int]] = defaultdict(list)
        # Items of fewer words than a shingle, by how many: looked for among a document's shingles of that many words.
        self.short: dict[int, dict[bytes, list[object]]] = defaultdict(lambda: defaultdict(list))
        by_size: dict[int, set[int]] = defaultdict(set)
        everything: set[int] = set()
        for item, text in items:
            joined = word_bytes((text or "").encode())
            count = joined.count(b" ") + 1 if joined else 0
            if 0 < count < words:
                self.short[count][joined].append(item)
                continue
            keys, starts, ends = shingle_keys(joined, words)
            if not len(keys):
                continue
            own = {k: joined[s:e] for k, s, e in zip(keys.tolist(), starts.tolist(), ends.tolist())}
            size = len(own)
            sketch = sorted(own)[: size - needed(size, least) + 1]
            by_size[size.bit_length()].update(sketch)
            for k in sketch:
                self.holders[k].append(len(self.ids))
            self.ids.append(item)
            self.shingles.append(own)
            everything |= own.keys()
        # (fewest shingles of a document that can hold an item of this size, sketch hashes of those items)
        self.sizes = [
            (needed(1 << (bits - 1), least), np.sort(np.fromiter(keys, np.uint64, len(keys)))) for bits, keys in by_size.items()
        ]
        self.everything = np.sort(np.fromiter(everything, np.uint64, len(everything)))
        self.short_keys = {n: np.sort(np.concatenate([shingle_keys(j, n)[0] for j in known])) for n, known in self.short.items()}
        self.bits = np.zeros(1 << 16, bool)
        for _, keys in self.sizes:
            self.bits[keys >> np.uint64(48)] = True

    def _short_items(self, joined: bytes) -> list[tuple[object, int, int]]:
        """Items of fewer words than a shingle that stand in joined words."""
        found = []
        for n, keys in self.short_keys.items():
            if joined.count(b" ") + 1 < n or not joined:
                continue
            own, starts, ends = shingle_keys(joined, n)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hits = np.flatnonzero(keys[at] == own).tolist()
            for stretch in sorted({joined[starts[h] : ends[h]] for h in hits}):
                found += [(item, 1, 1) for item in self.short[n].get(stretch, [])]
        return found

    def search(self, text: bytes) -> list[tuple[object, int, int]]:
        """(item, shingles of it found, its shingles) of all items contained in a text."""
        joined = word_bytes(text)
        short = self._short_items(joined)
        keys, starts, ends = shingle_keys(joined, self.words)
        likely = keys[self.bits[keys >> np.uint64(48)]]
        candidates: set[int] = set()
        for fewest, sketch in self.sizes:
            if len(keys) >= fewest and len(likely):
                at = np.minimum(np.searchsorted(sketch, likely), len(sketch) - 1)
                for k in np.unique(likely[sketch[at] == likely]).tolist():
                    candidates.update(self.holders[k])
        if not candidates:
            return short
        at = np.minimum(np.searchsorted(self.everything, keys), len(self.everything) - 1)
        hits = np.flatnonzero(self.everything[at] == keys)
        present = {joined[s:e] for s, e in zip(starts[hits].tolist(), ends[hits].tolist())}
        found = []
        for i in sorted(candidates):
            own = self.shingles[i].values()
            n = sum(s in present for s in own)
            if n >= needed(len(own), self.least):
                found.append((self.ids[i], n, len(own)))
        return short + found


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded bytes; an item larger than a block is a block."""
    held, size = [], 0
    for row in items.select(item_col, text_col).toLocalIterator():
        n = len((row[1] or "").encode())
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield held


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = WORDS,
    least: float = LEAST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id_col, item_col, found, shingles, containment) for every item contained in a row of ``docs``.

    Words are lower-cased (A-Z) and split at white space and ASCII punctuation; an item of fewer than ``words`` words
    is one shingle of as many words as it has, and is contained where these stand one after the other.  Items without words (empty, NULL) are in no document; documents without words hold
    nothing.  A NULL id is reported as NULL.  Repeated documents and items are reported each.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    id_kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    schema = f"id {id_kind}, item {item_kind}, found long, shingles long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for part in slices(batches, 512):
                index = index or ItemIndex(shared.value, words, least)
                out = [
                    (i, *hit) for i, text in zip(part.column(0).to_pylist(), byte_texts(part.column(1))) for hit in index.search(text)
                ]
                if out:
                    kinds = [part.schema.field(0).type, None, pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "item", "found", "shingles"])

        return run

    results = [
        rows.mapInArrow(search(spark.sparkContext.broadcast(block)), schema)
        for block in _blocks(items, item_col, item_text_col, block_bytes)
    ] or [spark.createDataFrame([], schema)]
    found = reduce(DataFrame.unionByName, results)
    return found.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "found", "shingles", (F.col("found") / F.col("shingles")).alias("containment")
    )


def without_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept.

    A row goes or stays by its own text, whatever other rows have the same id; ids, NULL or
    repeated ones too, decide nothing.  Columns of any name pass through.  Rows that a filter of fixed size tells apart are not shuffled.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("digest")
    rows = docs.select(digest, whole)
    searched = docs.select(digest.alias("doc"), F.col(text_col).alias("body"))
    hits = find_contained(searched, items, id_col="doc", text_col="body", **options).select(F.col("doc").alias("hit")).distinct()
    hits = stored(hits, "contained")
    marked = rows.withColumn("maybe", may_hold(hits.select(F.xxhash64("hit")))(F.xxhash64("digest")))
    rest = marked.where("maybe").join(hits, F.col("digest") == F.col("hit"), "left_anti").select("row")
    return marked.where("NOT maybe").select("row").unionByName(rest).select("row.*")
