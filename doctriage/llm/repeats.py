"""Repeated byte strings across documents, by sorting a sample of suffixes.

Every string of ``length`` bytes that occurs twice is removed.  A suffix array over
all bytes would shuffle hundreds of bytes for each byte of text, so suffixes are
sampled by content: of every window of ``length`` bytes, the position of the gram
(GRAM bytes) with the least hash is its anchor.  Equal windows have equal anchors at
equal offsets, so suffixes at anchors are all that need sorting, about one in 70.

1. One record per anchor: its suffix's first 8 bytes, a digest of its gram and a digest of
   its region, the bytes of all windows that it is the anchor of.  Sampled splitters range-partition the
   records by those keys in that order (ties by document, so that a hot passage fills many
   buckets); each bucket is sorted by multikey quicksort and neighbours are compared,
   also across the buckets' boundaries.
2. A gram that occurs once: none of its windows repeats.  Two equal regions: all
   their windows repeat.  What is left are the ends of repeated passages: for those
   regions, and one neighbour of each, the windows themselves are sorted in the same way, as
   8 leading bytes and a digest of 128 bits.
3. Repeated windows are joined to their documents and their union is cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctriage.llm.common import byte_texts, forget, longs, partitions, ship, slices, stored
from doctriage.llm.membership import bits_of, hit, may_hold, places, test_of
from doctriage.llm.rolling import FIRST, SECOND, mixed

LENGTH = 400
GRAM = 256
#: Text that is worked on at a time; positions in a block fit in 20 bits.
_BLOCK = 1 << 19
_SMALL = 4096


def _leads(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The 8 bytes from each start, as longs in the order of the bytes; past the end, zeros."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    eight = raw[starts[:, None] + np.arange(8)].astype(np.uint8)
    return (eight.view(">u8").reshape(-1).astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window, gram hash) of every run of windows that share an anchor."""
    found = []
    raw = np.frombuffer(data, np.uint8)
    step = _BLOCK - length
    for base in range(0, max(len(data) - length + 1, 0), step):
        block = raw[base : base + _BLOCK - 1]
        grams = FIRST.all_of(FIRST.prefixes(block), gram)
        # High bits of the hash, then the position: the least is the leftmost of the least grams.
        least = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have < width:
            by = min(have, width - have)
            least = np.minimum(least[:-by], least[by:])
            have += by
        at = (least[:step] & np.uint64(0xFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(new[1:], len(at)) - 1
        found.append((at[new] + base, new + base, last + base, grams[at[new]]))
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of records by several keys: three-way quicksort on one key at a time.

    Records equal in a key go on with the next one; parts of few records are sorted at once.
    """
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(columns):
            continue
        part = order[low:high]
        if high - low <= _SMALL:
            order[low:high] = part[np.lexsort([c[part] for c in columns[depth:][::-1]])]
            continue
        keys = columns[depth][part]
        pivot = np.sort(keys[:: max(1, len(keys) // 63)])[31]
        less, more = keys < pivot, keys > pivot
        same = ~(less | more)
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate((part[less], part[same], part[more]))
        todo += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _suffixes(length: int, gram: int, copies=None):
    """The records of texts (id, tag, text), but of those that a filter of copies hits, by the places in columns 3 and 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            if copies is not None:
                part = part.filter(pa.array(~hit(copies.value, longs(part.column(3)), longs(part.column(4)))))
            rows, taken = [], []
            tags = longs(part.column(1))
            for i, data in enumerate(byte_texts(part.column(2))):
                at, first, last, grams = anchors(data, length, gram)
                if not len(at):
                    continue
                prefixes = SECOND.prefixes(np.frombuffer(data, np.uint8))
                shape = ((at - first) << 8 | (at - last)).astype(np.uint64)
                region = SECOND.of(prefixes, first, last + length) ^ mixed(shape + np.uint64(1))
                place = at << 16 | (at - first) << 8 | (at - last)
                rows.append((_leads(data, at), grams.view(np.int64), region.view(np.int64), np.full(len(at), tags[i]), place))
                taken += [i] * len(at)
            if rows:
                columns = [pa.array(np.concatenate(c)) for c in zip(*rows)]
                ids = part.column(0).take(pa.array(taken, pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns[:3], ids, *columns[3:]], ["lead", "key", "more", "id", "tag", "place"])

    return run


def _windows(length: int):
    """Every window of the given places: its leading bytes and a digest of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            for i, (data, places) in enumerate(zip(byte_texts(part.column(2)), part.column(3))):
                places = np.sort(np.array(places.as_py(), np.int64))
                at, back, front = places >> 16, places >> 8 & 255, places & 255
                starts = np.concatenate([np.arange(a, b + 1) for a, b in zip((at - back).tolist(), (at - front).tolist())])
                raw = np.frombuffer(data, np.uint8)
                one, two = (r.of(r.prefixes(raw), starts, starts + length) for r in (FIRST, SECOND))
                n = len(starts)
                columns = [_leads(data, starts), one.view(np.int64), two.view(np.int64)]
                ids = part.column(0).take(pa.array(np.full(n, i)))
                tag = np.full(n, part.column(1)[i].as_py())
                arrays = [*map(pa.array, columns), ids, pa.array(tag), pa.array(starts)]
                yield pa.RecordBatch.from_arrays(arrays, ["lead", "key", "more", "id", "tag", "place"])

    return run


_FLAGS = ["same_prev", "same_next", "all_prev", "all_next"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket and compares neighbours; keeps records like a neighbour, and the bucket's ends."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    table = table.combine_chunks()
    keys = [table.column(c).to_numpy() for c in ("lead", "key", "more")]
    order = multikey_order(keys)
    lead, key, more = (k[order] for k in keys)
    same = (lead[1:] == lead[:-1]) & (key[1:] == key[:-1])
    every = same & (more[1:] == more[:-1])
    flags = [np.append(False, same), np.append(same, False), np.append(False, every), np.append(every, False)]
    edge = np.zeros(len(order), np.int32)
    edge[0] += 1
    edge[-1] += 2
    keep = np.flatnonzero(flags[0] | flags[1] | (edge > 0))
    out = table.take(pa.array(order[keep]))
    for name, f in zip(_FLAGS, flags):
        out = out.append_column(name, pa.array(f[keep]))
    yield from out.append_column("edge", pa.array(edge[keep])).to_batches(max_chunksize=65_536)


def sorted_neighbours(records: DataFrame, name: str) -> DataFrame:
    """Records (lead, key, more, id, tag, place) that agree with a neighbour in sorted order, and how far.

    same_*: in lead and key; all_*: in all three.  The rows of the table at each
    bucket's ends, two for each bucket, are compared across boundaries on the driver.
    """
    spark = records.sparkSession
    spread = records.repartitionByRange(partitions(records), "lead", "key", "more", "id", "tag", "place")
    schema = T.StructType(
        [*spread.schema.fields, *(T.StructField(f, T.BooleanType()) for f in _FLAGS), T.StructField("edge", T.IntegerType())]
    )
    compared = stored(
        spread.mapInArrow(_compare, schema).withColumn("bucket", F.spark_partition_id()), name
    )
    ends = [r.asDict() for r in compared.where("edge > 0").orderBy("bucket", "edge").collect()]
    for a, b in zip(ends, ends[1:]):
        if a["bucket"] != b["bucket"] and (a["lead"], a["key"]) == (b["lead"], b["key"]):
            a["same_next"] = b["same_prev"] = True
            if a["more"] == b["more"]:
                a["all_next"] = b["all_prev"] = True
    mended = spark.createDataFrame([tuple(r[c] for c in compared.columns) for r in ends], compared.schema)
    return compared.where("edge = 0").unionByName(mended).where("same_prev or same_next")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            spans, kept = [], []
            for data, ranges in zip(byte_texts(part.column(1)), part.column(2).to_pylist()):
                merged: list[dict] = []
                for first, last in sorted((r["first"], r["last"]) for r in ranges or []):
                    if merged and first <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], last + length)
                    else:
                        merged.append({"start": first, "end": last + length})
                edges = [0, *(x for m in merged for x in (m["start"], m["end"])), len(data)]
                spans.append(merged)
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [part.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "spans", "kept"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """Per row: id_col, n_bytes, spans (removed, as [start, end) in bytes), kept (the remaining bytes).

    A byte goes if a string of ``length`` bytes over it also starts elsewhere, in the same document
    or another.  Texts are UTF-8 bytes, NULL is empty; shorter texts than
    ``length`` are kept whole.  Repeated rows count as separate documents, so each removes the
    other.  A text that occurs several times is searched once, under a digest of 128 bits, which is also what
    results are joined to rows by: ids decide nothing.  No rows, no result.  Other columns are not read.
    """
    if not 0 <= length - gram <= 255:
        raise ValueError("gram has to be at most length, and at least length - 255")
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half = [F.conv(F.substring(F.md5(F.col("text").cast("binary")), at, 16), 16, -10).cast("long") for at in (1, 17)]
    rows = rows.select("row_id", half[0].alias("id"), half[1].alias("tag"), "text")
    twice = rows.groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.octet_length("text")).alias("size")).where("n > 1")
    twice = stored(twice.select("id", "tag", "size"), "repeated-texts")
    own, other = F.xxhash64("id", "tag"), F.xxhash64("i", "t").alias("key")
    # Filters of fixed size keep most texts out of the shuffles; joins and aggregates decide.
    bits = bits_of(twice.select(own.alias("key")))
    copies = test_of(bits)(own)
    again = stored(rows.where(copies).select("id", "tag", "text").dropDuplicates(["id", "tag"]), "texts-once")

    records = "lead long, key long, more long, id long, tag long, place long"
    once = rows.select("id", "tag", "text", *places(own, ("a", "b"))).mapInArrow(_suffixes(length, gram, bits), records)
    suffixes = stored(once.unionByName(again.mapInArrow(_suffixes(length, gram), records)), "suffixes")
    near = sorted_neighbours(suffixes, "suffixes-sorted")
    forget(suffixes)

    ends = near.where("(same_prev and not all_prev) or (same_next and not all_next)")
    listed = ends.groupBy(F.col("id").alias("i"), F.col("tag").alias("t")).agg(F.collect_list("place").alias("places"))
    placed = may_hold(listed.select(other))(own)
    near_text = rows.where(placed & ~copies).select("id", "tag", "text").unionByName(again.where(placed))
    holding = near_text.join(listed, (near_text.id == listed.i) & (near_text.tag == listed.t)).select("id", "tag", "text", "places")
    windows = sorted_neighbours(holding.mapInArrow(_windows(length), records), "windows-sorted")

    at = F.shiftright("place", 16)
    whole = near.where("all_prev or all_next").select(
        "id", "tag", (at - F.shiftright("place", 8).bitwiseAND(255)).alias("first"), (at - F.col("place").bitwiseAND(255)).alias("last")
    )
    single = windows.where("all_prev or all_next").select("id", "tag", F.col("place").alias("first"), F.col("place").alias("last"))
    # All of a text that occurs several times.
    every = twice.where(F.col("size") >= length).select("id", "tag", F.lit(0).cast("long").alias("first"), (F.col("size") - length).cast("long").alias("last"))
    ranges = (
        whole.unionByName(single).unionByName(every)
        .groupBy(F.col("id").alias("i"), F.col("tag").alias("t"))
        .agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    )
    ranges = stored(ranges, "ranges")
    for table in (near, windows, again):
        forget(table)
    marked = rows.withColumn("maybe", may_hold(ranges.select(other))(own))
    whole_texts = marked.where("not maybe").select("row_id", "text", F.lit(None).cast(dict(ranges.dtypes)["ranges"]).alias("ranges"))
    rest = marked.where("maybe")
    joined = rest.join(ranges, (rest.id == ranges.i) & (rest.tag == ranges.t), "left").select("row_id", "text", "ranges")
    spans = "array<struct<start: long, end: long>>"
    cut = whole_texts.unionByName(joined).mapInArrow(_cut(length), f"id {kind}, spans {spans}, kept binary")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(F.col("id").alias(id_col), (F.length("kept") + removed).alias("n_bytes"), "spans", "kept")


__all__ = ["remove_repeats", "anchors", "multikey_order"]
