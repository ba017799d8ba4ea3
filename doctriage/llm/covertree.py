"""Exact top-k by inner product with two cover trees.

Data and queries are cut into blocks of bounded size.  Every block of data is a cover tree
(each node has a centre and a radius over all its rows), and so is every block of
queries; a pair of blocks is searched by descending both trees together.  For rows q
under a query node (centre c, radius r) and p under a data node (centre d, radius s)

    q . p  <=  c . d + s |c| + r |d| + r s

so a pair of nodes is left out if that bound is below the worst kth score of the
queries in the node.  Blocks meet in a product of partitions; a task keeps the k best of each query over all
its blocks, and only these are shuffled.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage.llm.common import partitions, ship, stored

#: Rows of a block of data and of queries.
DATA_BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Rows of a leaf.
LEAF = 64
FANOUT = 8
#: Data rows that all queries are compared with first, for a first kth score.
SEED_ROWS = 1_024
#: Blocks of queries that a task compares its data with, and of how many it holds the trees.
QUERY_BLOCKS, QUERY_TREES = 16, 8
RESULT = "query_id long, rank int, vec_id long, score long"
_NONE = np.iinfo(np.int64).min


#: Sums below this are exact in float64, whatever the order they are added up in.
_EXACT = 1 << 53


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of int64 rows: by float64 where every sum fits, by 64-bit integers beyond, and an error beyond those."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * queries.shape[1]
    if most < _EXACT:
        return np.rint(queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return queries @ rows.T
    exact = queries.astype(object) @ rows.astype(object).T
    if any(abs(x) >= 1 << 63 for x in exact.flat):
        raise OverflowError("an inner product does not fit in 64 bits")
    return exact.astype(np.int64)


def _digest(row: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(row.tobytes()) - (1 << 63)


class CoverTree:
    """Nodes over the rows of a matrix: a row as centre, the radius over all rows below.

    The children of a node are a net of its rows: every row belongs to the nearest of a few centres,
    and no two centres are nearer to each other than the farthest row is to its own.
    """

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.whole = rows.astype(np.int64)
        self.rows = rows.astype(np.float64)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.below: list[list[int]] = []
        self.members: list[np.ndarray] = []
        self.norm = np.sqrt((self.rows**2).sum(axis=1))
        self.most = int(np.abs(self.whole).max(initial=0))
        if len(rows):
            self._build(0, np.arange(len(rows)), leaf)

    def _far(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.rows[members] - self.rows[centre]) ** 2).sum(axis=1))

    def _build(self, centre: int, members: np.ndarray, leaf: int) -> int:
        todo = [(centre, members, None)]
        while todo:
            centre, members, parent = todo.pop()
            far = self._far(centre, members)
            node = len(self.centre)
            radius = float(far.max())
            self.centre.append(centre)
            self.radius.append(radius * (1 + 1e-9) + 1e-9)
            self.below.append([])
            self.members.append(members)
            if parent is not None:
                self.below[parent].append(node)
            if len(members) <= leaf or radius == 0:
                continue
            # Farthest first: centres are at least as far apart as any row is from its nearest centre.
            centres, nearest, owner = [centre], far, np.zeros(len(members), np.int64)
            while len(centres) < FANOUT and nearest.max() > 0:
                centres.append(int(members[int(nearest.argmax())]))
                d = self._far(centres[-1], members)
                owner[d < nearest] = len(centres) - 1
                nearest = np.minimum(nearest, d)
            todo += [(c, members[owner == i], node) for i, c in enumerate(centres)]
        return 0

    def is_leaf(self, node: int) -> bool:
        return not self.below[node]


class Best:
    """The k highest scores of each query so far, ties to the smaller id, with the ids and the rows' places.

    ``floor``: scores below are left out.
    """

    def __init__(self, queries: int, k: int, ids: np.ndarray, floor: np.ndarray | None = None):
        self.k, self.ids = k, ids
        self.scores = np.full((queries, k), _NONE, np.int64)
        self.places = np.full((queries, k), -1, np.int64)
        self.floor = np.full(queries, _NONE) if floor is None else floor

    def add(self, members: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        """scores: queries x rows, whole numbers, _NONE where a row is no candidate."""
        least = np.maximum(self.scores[members, -1], self.floor[members]).astype(scores.dtype)
        some = np.flatnonzero(scores >= least[:, None])
        if len(some) > 8 * self.k * len(members) and len(rows) > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
            some = np.flatnonzero(scores >= least[:, None])
        found = scores.ravel()[some].astype(np.int64)
        some, found = some[found != _NONE], found[found != _NONE]
        if not len(some):
            return
        at, row = np.divmod(some, len(rows))
        changed = np.unique(at)
        held = members[changed]
        # What was held and what is new, in one order; of each query the first k stay.
        q = np.concatenate((np.repeat(np.arange(len(held)), self.k), np.searchsorted(changed, at)))
        s, n = np.concatenate((self.scores[held].ravel(), found)), np.concatenate((self.places[held].ravel(), rows[row]))
        order = np.lexsort((self.ids[n], ~s, q))  # ~s falls as s rises, for the least long too
        first = np.searchsorted(q[order], np.arange(len(held)))[:, None] + np.arange(self.k)
        self.scores[held], self.places[held] = s[order][first], n[order][first]


#: Scores made at once, and how many cost as much as one more call for a node.
_SLAB, _CALL = 1 << 20, 10_000


def _pairs_left(queries: CoverTree, data: CoverTree, floor: np.ndarray) -> np.ndarray:
    """Whether a leaf of the queries (or a node above) and a leaf of the data may hold a score of ``floor`` or more: nodes x leaves of data.

    Both trees are descended together, all pairs of a step at once.
    """
    qc, dc = queries.rows[queries.centre], data.rows[data.centre]
    r, s = np.array(queries.radius), np.array(data.radius)
    bound = qc @ dc.T + s * queries.norm[queries.centre][:, None] + r[:, None] * data.norm[data.centre] + r[:, None] * s
    least = np.array([floor[m].min() for m in queries.members])
    near = ~(bound + 1e-6 * np.abs(bound) + 1 < least[:, None])
    q_ends, d_ends = (np.array([not n for n in t.below]) for t in (queries, data))
    leaf = np.cumsum(d_ends) - 1
    left = np.zeros((len(qc), int(d_ends.sum())), bool)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(a):
        keep = near[a, b]
        a, b = a[keep], b[keep]
        ends = q_ends[a] & d_ends[b]
        left[a[ends], leaf[b[ends]]] = True
        a, b = a[~ends], b[~ends]
        down = q_ends[a] | ~d_ends[b] & (s[b] >= r[a])  # the data's node is the one to open
        (a1, b1), (b2, a2) = _opened(a[down], b[down], data.below), _opened(b[~down], a[~down], queries.below)
        a, b = np.concatenate((a1, a2)), np.concatenate((b1, b2))
    for node in reversed(range(len(qc))):  # children come after their parents
        for n in queries.below[node]:
            left[node] |= left[n]
    return left


def _opened(kept: np.ndarray, nodes: np.ndarray, below: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with each node replaced by its children."""
    counts = np.array([len(n) for n in below])
    flat, start = np.array([c for n in below for c in n], np.int64), np.cumsum(counts) - counts
    times = counts[nodes]
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(kept, times), flat[np.repeat(start[nodes], times) + at]


def _first_floor(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """A score that k rows of the most promising leaves reach, where ``floor`` says nothing."""
    ends = [n for n in range(len(data.centre)) if data.is_leaf(n)]
    centres, sizes = data.rows[[data.centre[n] for n in ends]], np.array([len(data.members[n]) for n in ends])
    floor = floor.copy()
    for node in range(len(queries.centre)):
        members = queries.members[node]
        if queries.is_leaf(node) and (floor[members] == _NONE).any():
            order = np.argsort(-(centres @ queries.rows[queries.centre[node]]), kind="stable")
            enough = order[: int(np.searchsorted(np.cumsum(sizes[order]), 4 * k)) + 1]
            rows = np.concatenate([data.members[ends[n]] for n in enough])
            seed = [(data_ids[i], data.whole[i]) for i in rows.tolist()]
            floor[members] = np.maximum(floor[members], _seeded(queries.whole[members], query_ids[members], seed, k))
    return floor


def search(
    queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, k: int, floor: np.ndarray, times: np.ndarray | None = None
) -> Best:
    """Best k of ``data`` for each query; scores below ``floor`` (a score k rows are known to reach) are skipped.

    ``times`` says how many rows of ``data`` each stands for.  A row equal to the query in id and vector is the query itself,
    no candidate unless it stands for several.  Nodes of the queries whose leaves meet much the same rows are multiplied as one.
    """
    if not len(query_ids) or not len(data_ids):
        return Best(len(query_ids), k, data_ids)
    times = np.ones(len(data_ids), np.int64) if times is None else times
    floor = _first_floor(queries, query_ids, data, data_ids, k, floor)
    best = Best(len(query_ids), k, data_ids, floor)
    left = _pairs_left(queries, data, floor)
    ends = [m for m, n in zip(data.members, data.below) if not n]
    cost = left @ np.array([len(m) for m in ends]) * np.array([len(m) for m in queries.members]) + _CALL
    whole = np.ones(len(cost), bool)
    for node in reversed(range(len(cost))):
        if (below := queries.below[node]) and (parts := cost[below].sum()) < cost[node]:
            cost[node], whole[node] = parts, False
    # The queries themselves among the data.
    order = np.argsort(data_ids, kind="stable")
    start, stop = (np.searchsorted(data_ids[order], query_ids, side) for side in ("left", "right"))
    q_own, d_own = _opened(np.arange(len(query_ids)), np.arange(len(query_ids)), [order[i:j].tolist() for i, j in zip(start, stop)])
    own = (times[d_own] == 1) & (queries.whole[q_own] == data.whole[d_own]).all(axis=1)
    q_own, d_own = q_own[own], d_own[own]
    q_at, d_at = np.full(len(query_ids), -1), np.full(len(data_ids), -1)
    exact = queries.most * data.most * data.rows.shape[1] < _EXACT
    todo = [0]
    while todo:
        node = todo.pop()
        if not whole[node]:
            todo += queries.below[node]
            continue
        if not left[node].any():
            continue
        members, rows = queries.members[node], np.concatenate([ends[n] for n in np.flatnonzero(left[node])])
        q_at[members] = np.arange(len(members))
        q_rows, step = (queries.rows if exact else queries.whole)[members], max(1, _SLAB // len(members))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            # Below 2^53 floats are exact.
            scores = q_rows @ data.rows[some].T if exact else products(q_rows, data.whole[some])
            d_at[some] = np.arange(len(some))
            alone = (q_at[q_own] >= 0) & (d_at[d_own] >= 0)
            scores[q_at[q_own[alone]], d_at[d_own[alone]]] = _NONE
            d_at[some] = -1
            best.add(members, scores, some)
        q_at[members] = -1
    return best


def _seeded(queries: np.ndarray, query_ids: np.ndarray, seed: list[tuple], k: int) -> np.ndarray:
    """For each query a score that k of the seed's rows reach; the least possible where there are too few."""
    if len(seed) <= k or not queries.shape[1]:
        return np.full(len(query_ids), _NONE)
    scores = products(queries, np.stack([s[1] for s in seed]))
    scores[query_ids[:, None] == np.array([int(s[0]) for s in seed])[None, :]] = _NONE
    return np.partition(scores, -k, axis=1)[:, -k]


class _Kept:
    """The k best of each query of a block over all blocks of data that a task has: scores, ids, digests and times of rows."""

    def __init__(self, block: int, query_ids: np.ndarray, q_times: np.ndarray, q_digests: np.ndarray, k: int):
        self.block, self.query, self.k = block, (query_ids, q_digests, q_times), k
        self.scores = np.full((len(query_ids), k), _NONE, np.int64)
        self.rows = np.zeros((3, len(query_ids), k), np.int64)

    def add(self, at: tuple[np.ndarray, np.ndarray], scores: np.ndarray, *rows: np.ndarray) -> None:
        """``at``: query and rank of each score; ``rows``: id, digest and times of its row."""
        members = np.unique(at[0])
        if not len(members):
            return
        to = np.searchsorted(members, at[0]), at[1] + self.k
        both = np.full((len(members), 2 * self.k), _NONE, np.int64)
        both[:, : self.k], both[to] = self.scores[members], scores
        of = np.zeros((3, *both.shape), np.int64)
        of[:, :, : self.k] = self.rows[:, members]
        for i, x in enumerate(rows):
            of[i][to] = x
        first = np.lexsort((of[1], of[0], ~both), axis=1)[:, : self.k]  # ~s falls as s rises, for the least long too
        self.scores[members] = np.take_along_axis(both, first, 1)
        self.rows[:, members] = np.stack([np.take_along_axis(x, first, 1) for x in of])

    def batch(self) -> pa.RecordBatch:
        at = np.nonzero(self.scores != _NONE)
        ids, digests, times = (x[at] for x in self.rows)
        columns = [np.full(len(ids), self.block), *(x[at[0]] for x in self.query), ids, digests, times, self.scores[at]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["block", "query_id", "query_row", "query_times", "vec_id", "row", "times", "score"])


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of every component; rows with a NULL id, NULL vector, or a NULL or non-finite component are left out.

    So are rows with a component whose integer has more than 62 bits: no score of theirs could be told.
    """
    x = F.col(vector_col)
    fit = F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(
        F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale < F.lit(float(1 << 62)))), F.lit(False)
    )
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0), np.int64)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of one block as one row: ids, how often each row is there, vectors end to end, and how many components each has."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        blocks, sizes = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        for key in {*zip(blocks.tolist(), sizes.tolist())}:
            part = batch.filter(pa.array((blocks == key[0]) & (sizes == key[1])))
            held.setdefault(key, []).append((*(part.column(i).to_numpy().astype(np.int64) for i in (1, 2)), _matrix(part.column(3)).astype(np.int64)))
    for (block, size), parts in held.items():
        ids, times, rows = (np.concatenate([p[i] for p in parts]) for i in range(3))
        columns = [pa.array([block], pa.int64()), pa.array([size], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, times, rows))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "size", "ids", "times", "rows"])


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Distinct rows (id, v, times) in blocks of about ``size`` by a hash, one row for each block and number of components."""
    n = rows.count()
    blocks = max(1, -(-n // size))
    keyed = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), "id", "times", "v", F.size("v").alias("size"))
    spread = keyed.repartition(min(blocks, partitions(rows)), "block")
    return spread.mapInArrow(_to_blocks, "block long, size int, ids binary, times binary, rows binary")


def _some(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows, spread over all by a hash; no task sends more than its share."""
    share = n / max(rows.count(), n)
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(n)


def _best(k: int) -> Column:
    """The k best (score, id, row's vector, times); rows equal in all are one."""
    return F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id", "row", "times"))), 1, k).alias("best")


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query over all other rows, ties to the smaller id.

    Queries are the rows for which ``is_query``, an expression over the id column, holds.  Every block of
    queries meets every block of data.  Only vectors of as many components are compared.  Every row counts: rows
    that share an id or are equal are candidates each, for each other too, and queries each.  Equal rows
    are searched once and told apart by their number.  Scores are exact; one that doesn't fit in 64 bits is an error.
    No rows, no queries or a single row: no result rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(integer_vectors(vectors, id_col, vector_col).groupBy("id", "v").agg(F.count(F.lit(1)).alias("times")), "vectors")
    asked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    data = stored(_blocks(rows, data_block), "data-blocks")
    queries = stored(_blocks(asked, query_block), "query-blocks")
    seed = [(np.array(r["id"]), np.array(r["v"], np.int64)) for r in _some(rows, SEED_ROWS).collect()]
    shared = spark.sparkContext.broadcast(seed)  # SEED_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every pair of blocks in a task, and the best of each query over all of them."""
        data_key, tree, digests = None, None, {}
        asked: OrderedDict[tuple, tuple[CoverTree, np.ndarray]] = OrderedDict()
        best: dict[tuple, _Kept] = {}
        for batch in batches:
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                query_ids, data_ids, q_times, times = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "ids", "q_times", "times"))
                q, d = (np.frombuffer(r[c], np.int64).reshape(len(i), -1) for c, i in (("q_rows", query_ids), ("rows", data_ids)))
                if data_key != (r["block"], r["size"]):
                    data_key, tree, digests = (r["block"], r["size"]), CoverTree(d), {}
                key = (r["q_block"], r["size"])
                if key not in asked:
                    asked[key] = CoverTree(q), _seeded(q, query_ids, [s for s in shared.value if len(s[1]) == r["size"]], k)
                    if len(asked) > QUERY_TREES:
                        asked.popitem(last=False)
                queries_tree, floor = asked[key]
                asked.move_to_end(key)
                if key not in best:
                    best[key] = _Kept(r["block"], query_ids.copy(), q_times.copy(), np.array([_digest(x) for x in q], np.int64), k)
                found = search(queries_tree, query_ids, tree, data_ids, k, np.maximum(floor, best[key].scores[:, -1]), times)
                at = np.nonzero(found.scores != _NONE)
                place = found.places[at]
                digests.update((p, _digest(d[p])) for p in {*place.tolist()} - digests.keys())
                # What is equal to the query in id and vector stands for the others.
                own = (data_ids[place] == query_ids[at[0]]) & (d[place] == q[at[0]]).all(axis=1)
                best[key].add(at, found.scores[at], data_ids[place], np.array([digests[p] for p in place.tolist()], np.int64), times[place] - own)
        for held in best.values():
            yield held.batch()

    n_data, n_queries = (t.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] for t in (data, queries))
    if n_data < 0 or n_queries < 0:
        return spark.createDataFrame([], RESULT)
    # Every block of queries meets every block of data where the data is read: neither is shuffled for it, copied or sent to the driver.
    # A task holds QUERY_BLOCKS blocks of queries.
    some_queries = queries.repartition(-(-(n_queries + 1) // QUERY_BLOCKS), "block").select(
        F.col("block").alias("q_block"), F.col("size").alias("q_size"), F.col("ids").alias("q_ids"), F.col("times").alias("q_times"), F.col("rows").alias("q_rows")
    )
    pairs = data.join(some_queries.hint("shuffle_replicate_nl"), F.col("size") == F.col("q_size"))
    columns = ["block", "q_block", "size", "ids", "times", "rows", "q_ids", "q_times", "q_rows"]
    names = "block long, query_id long, query_row long, query_times long, vec_id long, row long, times long, score long"
    found = pairs.select(*columns).mapInArrow(run, names)
    # Blocks first by groups, so that no query gathers the results of all blocks at once.
    groups, keys = max(1, math.isqrt(n_data + 1)), ["query_id", "query_row", "query_times"]
    some = found.groupBy(*keys, F.pmod("block", F.lit(groups)).alias("g")).agg(_best(k))
    some = some.select(*keys, F.explode("best").alias("b")).select(*keys, (-F.col("b.s")).alias("score"), "b.vec_id", "b.row", "b.times")
    ranked = some.groupBy(*keys).agg(_best(k))
    # A row that is there several times takes as many ranks, k at most; a query that is, gets as many results.
    whole = F.flatten(F.transform("best", lambda b: F.array_repeat(b, F.least(b["times"], F.lit(k)).cast("int"))))
    each = ranked.withColumn("best", F.slice(whole, 1, k)).select("query_id", "query_times", F.posexplode("best").alias("at", "b"))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("query_times"))))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


#: The same by brute force, for vec_id % 50 = 0 and k = 5.
ORACLE = """
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors d ON q.row <> d.row AND len(q.v) = len(d.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
