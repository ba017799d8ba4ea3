"""Ranked lexical search by dense blocked matrix products.

Items are cut into tiles of bounded size, each with a compact vocabulary: its own terms only, a
column each.  A tile is a matrix (items x terms) of term weights times repeats.  Documents are
turned, some hundred at a time, into a matrix (terms x documents) of impacts, and one BLAS product in
float64 scores all items of the tile against all documents of the block.  Impacts are integers
of at most 10**6 and weights are integers, so a product is exact as long as no sum exceeds 2**53:
columns are dealt into slabs whose sums stay below it, and slabs are added up as 64-bit integers.

Every task keeps the best of each item over all its blocks.  Rows equal to the worst score kept
stay in until the next cut, which goes by score and then by id, so ties never depend on
how documents lie in blocks or tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctriage.llm.common import PLAIN, byte_texts, forget, partitions, ship, slices, stored

#: Weights: floor(WEIGHT_SCALE * ln((2N + 2) / (2df + 1))).
WEIGHT_SCALE = 1000
#: A document's length factor: 100 - LENGTH_SHARE + (LENGTH_SHARE * n * N) div L.
LENGTH_SHARE = 25
#: Impacts: (IMPACT_SCALE * tf) div (TF_SCALE * tf + SATURATION * m), so at most IMPACT_SCALE / TF_SCALE.
IMPACT_SCALE, TF_SCALE, SATURATION = 1_000_000_000, 1_000, 12
#: What a float64 holds exactly, in units of the largest impact.
SLAB_SUM = (1 << 53) // (IMPACT_SCALE // TF_SCALE) - 1
#: Items and (item, term) entries of a tile: what is broadcast at a time, unless one item alone has more terms.
TILE_ITEMS, TILE_ENTRIES = 256, 1 << 15
#: Documents of a block, and columns of a slab.
BLOCK, SLAB_COLUMNS = 512, 4096


def terms(text: bytes) -> list[bytes]:
    """The terms of a text: runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(PLAIN).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Impacts of terms that occur tf times in documents of n terms; all int64."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // total
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + SATURATION * m)


@dataclass(frozen=True)
class Slab:
    """Some columns of a tile: their places in the vocabulary, and weights times repeats as (item, column, value)."""

    columns: np.ndarray
    cells: np.ndarray

    def matrix(self, items: int) -> np.ndarray:
        """Items x columns."""
        out = np.zeros((items, len(self.columns)))
        out[self.cells[:, 0], self.cells[:, 1]] = self.cells[:, 2]
        return out


def slabs(entries: list[tuple[int, int, int]], items: int, most: int = SLAB_SUM, columns: int = SLAB_COLUMNS) -> list[Slab]:
    """Deals entries (item, column, weight times repeats) into slabs in which no item's weights exceed ``most``.

    An entry that is larger by itself is dealt in portions to several slabs.
    """
    places: list[dict[int, int]] = []
    sums: list[np.ndarray] = []
    cells: list[list[tuple[int, int, int]]] = []
    by_column: dict[int, list[tuple[int, int]]] = {}
    for item, column, value in entries:
        if value > 0:
            by_column.setdefault(column, []).append((item, value))
    for column in sorted(by_column):
        rest, at = by_column[column], 0
        while rest:
            if at == len(places):
                places.append({})
                sums.append(np.zeros(items, np.int64))
                cells.append([])
            left = []
            if column in places[at] or len(places[at]) < columns:
                for item, value in rest:
                    portion = min(value, most - int(sums[at][item]))
                    if portion > 0:
                        places[at].setdefault(column, len(places[at]))
                        cells[at].append((item, places[at][column], portion))
                        sums[at][item] += portion
                    if value > portion:
                        left.append((item, value - portion))
                rest = left
            at += 1
    out = []
    for place, cell in zip(places, cells):
        if place:
            out.append(Slab(np.fromiter(place, np.int64, len(place)), np.array(cell, np.int64)))
    return out


class Best:
    """Of each item, the rows that may still be among its k best."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = [np.empty(0, np.int64) for _ in range(items)]
        self.ids: list[pa.Array | None] = [None] * items
        self.least = np.ones(items, np.int64)  # a score above 0 is what counts

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: items x rows.  Rows equal to the worst kept stay, and are cut by id."""
        for item in np.flatnonzero((scores >= self.least[:, None]).any(axis=1)).tolist():
            new = np.flatnonzero(scores[item] >= self.least[item])
            s = np.concatenate((self.scores[item], scores[item, new]))
            i = ids.take(pa.array(new))
            i = i if self.ids[item] is None else pa.concat_arrays([self.ids[item], i])
            if len(s) > self.k:
                order = pc.sort_indices(pa.table({"s": s, "i": i}), sort_keys=[("s", "descending"), ("i", "ascending")], null_placement="at_end")
                order = order.slice(0, self.k)
                s, i = s[order.to_numpy()], i.take(order)
                self.least[item] = max(1, int(s.min()))
            self.scores[item], self.ids[item] = s, i


def _counted(batches: Iterator[pa.RecordBatch], rows: int):
    """Blocks of documents: the batch, and the terms of each."""
    for part in slices(batches, rows):
        yield part, [terms(t) for t in byte_texts(part.column(part.num_columns - 1))]


def _places(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    at = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
    return at[at >= 0]


def _frequencies(vocabulary):
    """Of each task: in how many documents each column of the vocabulary occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df = np.zeros(len(known), np.int64)
        for _, block in _counted(batches, BLOCK):
            for words in block:
                df[np.unique(_places(words, known))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for _, block in _counted(batches, BLOCK):
        sizes = [len(words) for words in block]
        docs += sum(s > 0 for s in sizes)
        total += sum(sizes)
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], ["docs", "total"])


def _ranked(tile, k: int, n_docs: int, total: int):
    """Of each task: the k best rows of every item of the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cut, names = tile.value
        best, dense = Best(len(names), k), [slab.matrix(len(names)) for slab in cut]
        for part, block in _counted(batches, BLOCK):
            sizes = np.array([len(words) for words in block], np.int64)
            found = [np.unique(_places(words, vocabulary), return_counts=True) for words in block]
            rows = np.repeat(np.arange(len(block)), [len(at) for at, _ in found])
            if not len(rows):
                continue
            at = np.concatenate([f[0] for f in found])
            value = impacts(np.concatenate([f[1] for f in found]).astype(np.int64), sizes[rows], n_docs, total)
            scores = np.zeros((len(names), len(block)), np.int64)
            for slab, weights in zip(cut, dense):
                place = np.full(len(vocabulary), -1, np.int64)
                place[slab.columns] = np.arange(len(slab.columns))
                here = place[at]
                some = here >= 0
                block_of = np.zeros((len(slab.columns), len(block)))
                block_of[here[some], rows[some]] = value[some]
                scores += (weights @ block_of).astype(np.int64)
            best.add(scores, part.column(0))
        task = TaskContext.get().partitionId()
        for item, (s, i) in enumerate(zip(best.scores, best.ids)):
            if len(s):
                columns = [pa.array([names[item]] * len(s)), pa.array(np.full(len(s), task, np.int32)), i, pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "task", "doc", "score"])

    return run


def _tiles(entries: DataFrame, most_items: int, most_entries: int) -> list[str]:
    """Conditions on ``query`` that cut the items into tiles, by ranges of their digests."""
    sizes = entries.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    n_items, n_entries = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    count = max(1, -(-n_items // most_items), -(-n_entries // most_entries))
    # Twice as many as full tiles would be, so that an uneven deal stays within the bound too.
    count = count if count == 1 else 2 * count
    return [f"pmod(xxhash64(query), {count}) = {i}" for i in range(count)]


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    tile_items: int = TILE_ITEMS,
    tile_entries: int = TILE_ENTRIES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties to the smaller id.

    All documents are scored; tables of items larger than a tile are searched tile by tile, a pass over the
    documents each.  NULL and empty texts have no terms: such documents rank nowhere and don't count, such
    items have no result rows.  Repeated rows of documents are ranked one after the other, of items each
    get the rows; NULL ids come last among equal scores.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    # Items of the same text are one query; its digest stands for it.
    asked = items.select(F.col(item_id).alias("item"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("query"), F.col(text_col).alias("text"))
    texts = asked.groupBy("query").agg(F.first("text").alias("text"))
    entries = stored(texts.mapInArrow(_item_terms, "query string, term binary, n long"), "lexical-items")
    corpus = docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("text"))
    texts_only = corpus.select("text")
    n_docs, total = texts_only.mapInArrow(_lengths, "docs long, total long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    kind = dict(corpus.dtypes)["doc"]
    parts = []
    if total:
        for condition in _tiles(entries, tile_items, tile_entries):
            part = _search_tile(spark, corpus, entries.where(condition), k, n_docs, total, kind)
            parts += [part] if part is not None else []
    forget(entries)
    found = spark.createDataFrame([], f"query string, task int, doc {kind}, score long")
    for part in parts:
        found = found.unionByName(part)
    # First within groups of tasks, so that no item gathers the rows of all tasks at once.
    groups = F.pmod(F.xxhash64("task"), F.lit(max(1, math.isqrt(partitions(docs)))))
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    rank = F.row_number()
    some = found.withColumn("group", groups).withColumn("r", rank.over(Window.partitionBy("query", "group").orderBy(*order))).where(F.col("r") <= k)
    best = some.withColumn("rank", rank.over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    best = stored(best.select("query", "rank", "doc", "score"), "lexical-best")
    return asked.select("item", "query").join(best, "query").select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and repeats of each item."""
    for part in slices(batches, BLOCK):
        for query, text in zip(part.column(0), byte_texts(part.column(1))):
            counts = Counter(terms(text))
            columns = [pa.array([query.as_py()] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query", "term", "n"])


def _search_tile(spark: SparkSession, corpus: DataFrame, entries: DataFrame, k: int, n_docs: int, total: int, kind: str) -> DataFrame | None:
    """The best rows of every task for one tile, stored; None for a tile without terms."""
    tile = entries.toPandas()
    if not len(tile):
        return None
    vocabulary = {bytes(t): i for i, t in enumerate(sorted(set(map(bytes, tile["term"]))))}
    shared = spark.sparkContext.broadcast(vocabulary)
    df = corpus.select("text").mapInArrow(_frequencies(shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    shared.unpersist()
    weights = {int(t): weight(n_docs, int(n)) for t, n in zip(df["term"], df["df"])}
    names = sorted(set(tile["query"]))
    row = {name: i for i, name in enumerate(names)}
    places = [vocabulary[bytes(t)] for t in tile["term"]]
    cells = [(row[q], p, weights[p] * int(n)) for q, p, n in zip(tile["query"], places, tile["n"]) if p in weights]
    shared = spark.sparkContext.broadcast((vocabulary, slabs(cells, len(names)), names))
    found = corpus.mapInArrow(_ranked(shared, k, n_docs, total), f"query string, task int, doc {kind}, score long")
    found = stored(found, "lexical-tile")
    shared.unpersist()
    return found


#: The same as SQL, an item's documents by a join on terms.
ORACLE = """
WITH doc_terms AS (
  SELECT row, doc_id, term, count(*) AS tf FROM (
    SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
  ) GROUP BY ALL
), lengths AS (
  SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM doc_terms GROUP BY row
), corpus AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM doc_terms, corpus GROUP BY term, n_docs
), item_terms AS (
  SELECT row, item_id, term, count(*) AS repeats FROM (
    SELECT row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS row, item_id, text FROM benchmark)
  ) GROUP BY ALL
), scores AS (
  SELECT i.row AS item_row, i.item_id, d.row, d.doc_id,
         CAST(sum(i.repeats * w.w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * l.n * c.n_docs) // c.total)))) AS BIGINT) AS score
  FROM item_terms i JOIN doc_terms d USING (term) JOIN weights w USING (term) JOIN lengths l ON l.row = d.row, corpus c
  GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
