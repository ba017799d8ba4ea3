"""Near copies by SimHash fingerprints, found through deletion variants.

A fingerprint has 64 bits.  Two fingerprints that differ in at most d bits are
cut into d // 2 + 1 segments; were every segment to differ twice, they would
differ more than d times, so one segment differs in at most one bit.  Every
fingerprint is therefore listed under each of its segments with one bit left
out (64 variants in all), variants are joined by equality, and what meets is
verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.llm.common import LOWER, byte_texts, longs, partitions, run_starts, ship, slices, stored, whole_runs
from doctriage.llm.graph import components
from doctriage.llm.membership import may_hold

SEED = 42
#: Rows of one variant that one task compares; longer lists are cut into tiles and tiles are paired.
TILE = 4096
_SMALL_RUN = 64


def shingle_hashes(text: bytes, words: int, table: bytes = LOWER) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; none for a text without words."""
    parts = text.translate(table).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[: len(parts) - words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes; 0 without any."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        block = hashes[start : start + (1 << 15)].astype("<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 5, table: bytes = LOWER) -> DataFrame:
    """(id, fp) per row, fp a signed long; repeated rows stay repeated, NULL texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [fingerprint(shingle_hashes(t, words, table)) for t in byte_texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs at most once."""
    n = distance // 2 + 1
    bounds = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _variants(distance: int):
    cuts = segments(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16_384):
            fps = longs(part.column(0)).astype(np.int64)
            bits = fps.view(np.uint64)
            for first, width in cuts:
                piece = (bits >> np.uint64(first)) & np.uint64((1 << width) - 1)
                for at in range(width):
                    key = _key(piece & ~np.uint64(1 << at), first + at, width)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps)], ["key", "fp"])

    return run


def _key(values: np.ndarray, which: int, width: int) -> np.ndarray:
    """One long per (variant number, left-over bits): the bits where they fit beside the number, else mixed."""
    if width <= 57:
        return ((np.uint64(which) << np.uint64(57)) | values).view(np.int64)
    mixed = (values ^ np.uint64(which)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links, those that join what was apart so far."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def _spread(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one long run: each reached node is compared with all not reached yet."""
    apart = fps
    while len(apart):
        queue, apart = [apart[0]], apart[1:]
        while queue and len(apart):
            node = queue.pop()
            near = np.bitwise_count(apart ^ node) <= distance
            if near.any():
                found, apart = apart[near], apart[~near]
                yield np.full(len(found), node), found
                queue.extend(found)


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["key", "pair"]):
            key, pair = (table.column(c).to_numpy() for c in ("key", "pair"))
            bits = table.column("fp").to_numpy().view(np.uint64)
            starts = run_starts(key, pair)
            sizes = np.diff(np.append(starts, len(key)))
            found = [np.empty((2, 0), np.uint64)]
            group = np.repeat(np.arange(len(starts)), sizes)
            short = np.repeat(sizes <= _SMALL_RUN, sizes)
            ids, b = group[short], bits[short]
            for lag in range(1, int(sizes[sizes <= _SMALL_RUN].max(initial=1))):
                same = np.flatnonzero(ids[lag:] == ids[:-lag])
                near = same[np.bitwise_count(b[same] ^ b[same + lag]) <= distance]
                found.append(np.stack((b[near], b[near + lag])))
            for s, n in zip(starts[sizes > _SMALL_RUN].tolist(), sizes[sizes > _SMALL_RUN].tolist()):
                found += [np.stack(x) for x in _spread(np.unique(bits[s : s + n]), distance)]
            a, b = np.concatenate(found, axis=1)
            left, right = _forest(a, b)
            if left:
                pairs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)]
                yield pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    return run


def links(nodes: DataFrame, distance: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all of ``nodes`` (fp, distinct) lying within ``distance`` bits, chains included.

    Not every pair within the distance is listed, but all components are.  Variants
    that list more than ``tile`` fingerprints are cut into tiles by hash, and every
    two tiles meet in a group of their own, so no task holds a whole hot variant.
    """
    ship(nodes.sparkSession)
    variants = nodes.select("fp").mapInArrow(_variants(distance), "key long, fp long")
    counts = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    # Stored first, so that Spark knows how few they are and need not shuffle all variants to find them.
    hot = stored(counts.select("key", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles")), "hot-variants")
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
    paired = (
        variants.join(hot, "key", "left")
        .withColumn("mine", mine)
        .select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("other"))
        .select(
            "key",
            (F.least("mine", "other").cast("long") * F.lit(1 << 31) + F.greatest("mine", "other")).alias("pair"),
            "fp",
        )
    )
    n = partitions(nodes)
    grouped = paired.repartition(n, "key", "pair").sortWithinPartitions("key", "pair")
    return grouped.mapInArrow(_verify(distance), "a long, b long")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = 4, table: bytes = LOWER
) -> DataFrame:
    """Every row with its fingerprint and the smallest id reachable over near fingerprints.

    Returns (id_col, fp, component_id), one row per input row.  Texts without words (empty
    and NULL ones) have fingerprint 0 and are linked like any other.  A NULL id takes part
    but never names a component unless all ids in it are NULL.  Repeated rows are kept.
    No input rows give no output rows.  Other columns of ``docs`` are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words, table), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    roots = components(links(nodes, distance))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stored(placed, "placed")
    names = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "component-names")
    named = placed.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _row_prints(words: int, table: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [fingerprint(shingle_hashes(t, words, table)) for t in byte_texts(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "tag", "fp"])

    return run


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, table: bytes = LOWER
) -> DataFrame:
    """The rows of ``docs``, all columns kept, of which one stays for each group of near copies: the one with the smallest id.

    Groups are those of ``near_copies``: whatever links of ``distance`` bits or fewer connect.  A NULL id comes last, rows that share an id
    go by a digest of their text, and of repeated rows one stays.  Texts without words, NULL ones too, are copies
    of each other.  Columns of any name pass through.  No rows, no result.

    Texts are not shuffled: filters of a fixed size tell most rows that stay from those that go, and
    a join decides on the few that they leave open.
    """
    ship(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tag = F.conv(F.left(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), F.lit(15)), 16, 10).cast("long").alias("tag")
    rows = docs.select(F.col(id_col).alias("id"), tag, F.col(text_col).alias("text"), whole)
    kind = dict(rows.dtypes)["id"]
    prints = stored(rows.select("id", "tag", "text").mapInArrow(_row_prints(words, table), f"id {kind}, tag long, fp long"), "row-prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first")
    nodes = stored(prints.groupBy("fp").agg(first, F.count(F.lit(1)).alias("n")), "print-nodes")
    roots = components(links(nodes, distance)).withColumnRenamed("node", "fp")
    placed = stored(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "print-groups")
    stays = stored(placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")), "print-firsts")
    kept = stays.select(F.col("first.id").alias("i"), F.col("first.tag").alias("t"))
    # Rows of groups of several rows; the first is among them if it is repeated.
    several = stored(placed.select("fp", "root").join(stays.where("n > 1").select("root", "first"), "root").select("fp", "first"), "print-several")
    members = prints.join(several, "fp")
    gone = members.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tag") == F.col("first.tag")))).select(F.xxhash64("id", "tag").alias("key"))
    again = prints.groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("id", "tag").alias("key"))
    key = F.xxhash64("id", "tag")
    open_rows, may_stay = may_hold(gone.unionByName(again)), may_hold(kept.select(F.xxhash64("i", "t").alias("key")))
    marked = rows.select("id", "tag", "row").withColumn("open", open_rows(key)).withColumn("may", may_stay(key))
    sure = marked.where(~F.col("open")).select("row")
    rest = marked.where("open and may")
    rest = rest.join(kept, rest.id.eqNullSafe(kept.i) & (rest.tag == kept.t), "left_semi").dropDuplicates(["id", "tag"]).select("row")
    return sure.unionByName(rest).select("row.*")


__all__ = ["near_copies", "deduplicated", "fingerprints", "fingerprint", "shingle_hashes", "links", "segments", "hex_fingerprint"]
