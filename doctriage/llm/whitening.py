"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Entries become integers first, so counts, sums and deviations are exact.  The covariance of the distinct
vectors is summed up by Spark, centred before anything is multiplied.  Its eigenvectors come from
polar decompositions: the polar factor of V - s I is the sign of that matrix, so (factor + I) / 2 projects
onto the components above s.  The projector splits the space into two invariant subspaces, V is compressed onto
each, and both are split in the same way until single components are left.  The polar factor is found by
the QR-based dynamically weighted Halley iteration (QDWH), which takes about six steps
whatever the condition.  Mean and components, all that rows need, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.llm.common import forget, partitions, ship, stored

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Dimensions of a vector at most: the driver holds one matrix of that size squared.
MAX_DIMENSIONS = 4096
_EPS = float(np.finfo(np.float64).eps)
_STEPS = 60


# -- the eigenproblem --------------------------------------------------------
def _halley_weights(low: float) -> tuple[float, float, float]:
    """Weights of one step for singular values in [low, 1]."""
    low = min(max(low, 1e-17), 1.0)
    d = (4 * max(0.0, 1 - low * low) / low**4) ** (1 / 3)
    root = np.sqrt(1 + d)
    a = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root)))
    b = (a - 1) ** 2 / 4
    return float(a), float(b), float(a + b - 1)


def polar_factor(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, which is its sign."""
    size = len(matrix)
    top = np.linalg.norm(matrix)
    if top == 0:
        return np.eye(size)
    x = matrix / top
    eye = np.eye(size)
    # A lower bound of the least singular value from the triangle of a QR factorisation.
    triangle = np.abs(np.diag(np.linalg.qr(x, mode="r")))
    low = max(float(triangle.min()) / np.sqrt(size) / 8, _EPS / 8)
    for _ in range(_STEPS):
        a, b, c = _halley_weights(low)
        before = x
        if c > 100:
            q = np.linalg.qr(np.vstack((np.sqrt(c) * x, eye)))[0]
            x = b / c * x + (a - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        else:
            x = b / c * x + (a - b / c) * np.linalg.solve(eye + c * (x.T @ x), x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (a + b * low * low) / (1 + c * low * low))
        if abs(1 - low) < 10 * _EPS and np.linalg.norm(x - before) <= (5 * _EPS) ** (1 / 3):
            break
    return x


def _bases(matrix: np.ndarray, shift: float, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the components above and below the shift; None if it separates nothing."""
    size = len(matrix)
    projector = (polar_factor(matrix - shift * np.eye(size)) + np.eye(size)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < size:
        return None
    # The columns of largest remaining norm span the range: pivoted orthogonalisation, twice for orthogonality.
    left, picked = projector.copy(), []
    for _ in range(rank):
        best = int((left**2).sum(axis=0).argmax())
        picked.append(best)
        v = left[:, best] / np.linalg.norm(left[:, best])
        left -= np.outer(v, v @ left)
    base = np.linalg.qr(projector[:, picked])[0]
    base = np.linalg.qr(projector @ base)[0]
    whole = np.linalg.qr(np.hstack((base, np.eye(size))))[0][:, :size]
    upper, lower = base, whole[:, rank:]
    # One round of subspace iteration with the complement's projector.
    lower = np.linalg.qr(lower - projector @ lower)[0]
    lower = np.linalg.qr(lower - upper @ (upper.T @ lower))[0]
    if np.linalg.norm(lower.T @ matrix @ upper) > 64 * size * _EPS * scale:
        return None
    return upper, lower


def _shifts(matrix: np.ndarray) -> Iterator[float]:
    """Places to cut the spectrum at: the middle of the diagonal first, then others between its bounds."""
    diagonal = np.sort(np.diag(matrix))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    # Gershgorin's bounds hold all eigenvalues; a finer net each time.
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    low, high = float((np.diag(matrix) - radius).min()), float((np.diag(matrix) + radius).max())
    for parts in (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096):
        for i in range(1, parts, 2):
            yield low + (high - low) * i / parts


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling eigenvalue.

    A block that is a multiple of the identity as far as doubles tell is one component repeated: any
    orthonormal basis of it will do.
    """
    size = len(matrix)
    scale = float(np.linalg.norm(matrix))
    values, vectors = np.empty(size), np.empty((size, size))
    done, todo = 0, [np.eye(size)]
    while todo:
        base = todo.pop()
        block = base.T @ matrix @ base
        block = (block + block.T) / 2
        width = block.shape[0]
        flat = width == 1 or np.linalg.norm(block - np.trace(block) / width * np.eye(width)) <= 4 * width * _EPS * scale
        parts = None if flat else next((p for s in _shifts(block) if (p := _bases(block, s, scale)) is not None), None)
        if parts is None and not flat:
            parts = _rotated_pair(block)
        if parts is None:
            values[done : done + width] = np.diag(block)
            vectors[:, done : done + width] = base
            done += width
            continue
        todo += [np.linalg.qr(base @ p)[0] for p in parts]
    vectors = np.linalg.qr(vectors)[0]
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _rotated_pair(block: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Two components whose eigenvalues lie closer than any shift: the rotation that makes a 2 x 2 block diagonal."""
    if len(block) != 2:
        return None
    angle = 0.5 * np.arctan2(2 * block[0, 1], block[0, 0] - block[1, 1])
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c], [s]]), np.array([[-s], [c]])


# -- sums --------------------------------------------------------------------
def integer_entries(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x): floor(scale * c) + offset of every entry; rows whose vector is NULL or has NULL or non-finite entries go.

    So do rows with an entry that has over 62 bits as an integer.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale < F.lit(float(1 << 62))))
    whole = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(offset))
    return vectors.where(v.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _by_size(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch with vectors of one length."""
    sizes = np.diff(batch.column(at).offsets.to_numpy()) if batch.num_rows else np.empty(0, np.int64)
    for size in np.unique(sizes).tolist():
        yield size, batch.filter(pa.array(sizes == size))


@dataclass(frozen=True)
class Centre:
    """Of the distinct vectors of one length: how many, and the sums of each entry."""

    n: int
    sums: np.ndarray

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; Python integers where 64 bits don't hold them."""
        widest = int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in self.sums), default=0) // max(self.n, 1) + 1
        if widest * self.n * 2 < 1 << 62:
            return x * np.int64(self.n) - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task: how many vectors of each length, and the sums of their entries, written out as they may exceed 64 bits."""
    counts: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, part in _by_size(batch, 0):
            x = _matrix(part.column(0), size)
            fits = len(x) * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62
            own = (x if fits else x.astype(object)).sum(axis=0)
            counts[size] = counts.get(size, 0) + len(x)
            sums[size] = sums.get(size, 0) + own.astype(object)
    for size, total in sums.items():
        n = len(total)
        columns = [pa.array(np.full(n, size, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, counts[size])), pa.array([str(v) for v in total])]
        yield pa.RecordBatch.from_arrays(columns, ["size", "at", "n", "total"])


def _centres(distinct: DataFrame) -> dict[int, Centre]:
    """Counts and sums by length; one row for each length and entry comes to the driver."""
    sums = (
        distinct.select("x").mapInArrow(_partial_sums, "size int, at int, n long, total string")
        .groupBy("size", "at")
        .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .orderBy("size", "at")
        .collect()
    )
    out: dict[int, Centre] = {}
    for size in sorted({r["size"] for r in sums}):
        rows = [r for r in sums if r["size"] == size]
        out[size] = Centre(rows[0]["n"], np.array([int(r["total"]) for r in rows], object))
    return out


def _summed_products(form):
    """Partial sums of products: of each length, one row for each row of the matrix.

    ``form(size, x)`` gives the rows whose products are summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, part in _by_size(batch, 0):
                if (y := form(size, _matrix(part.column(0), size))) is not None:
                    totals[size] = totals.get(size, 0) + y.T @ y
        for size, total in totals.items():
            columns = [pa.array(np.full(len(total), size, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["size", "row", "sums"])

    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            totals[r["size"], r["row"]] = totals.get((r["size"], r["row"]), 0) + np.frombuffer(r["sums"])
    keys = sorted(totals)
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([totals[k].tobytes() for k in keys], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["size", "row", "sums"])


def _products(distinct: DataFrame, form) -> dict[int, np.ndarray]:
    """Sums of products by length.  Tasks' matrices meet row by row, each row in a task of its own."""
    schema = "size int, row int, sums binary"
    parts = distinct.select("x").mapInArrow(_summed_products(form), schema)
    # In two steps, as each of many tasks may send a matrix.
    some = parts.repartition(partitions(distinct), "size", "row", F.pmod(F.spark_partition_id(), F.lit(32))).mapInArrow(_add_rows, schema)
    rows = some.repartition(partitions(distinct), "size", "row").mapInArrow(_add_rows, schema).collect()
    out: dict[int, np.ndarray] = {}
    for size in {r["size"] for r in rows}:
        out[size] = np.stack([np.frombuffer(r["sums"]) for r in sorted((r for r in rows if r["size"] == size), key=lambda r: r["row"])])
    return out


# -- the operator ------------------------------------------------------------
@dataclass(frozen=True)
class Whitening:
    """Centre, eigenvalues and components (as columns over the roots of the eigenvalues) of one length."""

    centre: Centre
    values: np.ndarray
    explained: np.ndarray
    transform: np.ndarray
    identity_error: float = float("nan")

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.transform


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for the vectors of each length in ``distinct`` (x), which has each vector once."""
    centres = _centres(distinct)
    if too_long := [s for s in centres if s > MAX_DIMENSIONS]:
        raise ValueError(f"vectors have {MAX_DIMENSIONS} entries at most, not {too_long[0]}")
    covariances = _products(distinct, lambda size, x: centres[size].centred(x) if size in centres else None)
    models: dict[int, Whitening] = {}
    for size, centre in centres.items():
        covariance = covariances[size] / centre.n
        covariance = (covariance + covariance.T) / 2
        total = float(np.trace(covariance))
        values, vectors = eigen(covariance)
        # A direction without variance, but for rounding, has no whitened form.
        kept = [i for i in range(min(components, size)) if values[i] > size * _EPS * total]
        values, vectors = values[kept], vectors[:, kept]
        models[size] = Whitening(centre, values, values / total if kept else values, vectors / np.sqrt(values))
    models = {s: m for s, m in models.items() if len(m.values)}
    squares = _products(distinct, lambda size, x: models[size].whitened(x) if size in models else None)
    return {
        s: Whitening(m.centre, m.values, m.explained, m.transform, float(np.abs(squares[s] / m.centre.n - np.eye(len(m.values))).max()))
        for s, m in models.items()
    }


def _applied(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch, 1):
                model = models.value.get(size)
                if model is None:
                    continue
                x = _matrix(part.column(1), size)
                away = model.centre.numerators(x)
                if size * int(np.abs(away).max(initial=0)) ** 2 >= 1 << 63:
                    away = away.astype(object)
                deviation = [str(d) for d in (away * away).sum(axis=1).tolist()]
                white = model.whitened(x)
                k, rows = white.shape[1], len(x)
                numbers = np.repeat(np.arange(rows), k)
                columns = [
                    part.column(0).take(pa.array(numbers)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.centre.n)),
                    pa.array(deviation).take(pa.array(numbers)),
                    pa.array(white.reshape(-1)),
                    pa.array(np.tile(model.explained, rows)),
                    pa.array(np.full(rows * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    The fit is over each distinct vector of integers once; ``n`` counts them.  ``deviation``, a
    decimal(38, 0), is the sum of (n * x - S) ** 2 over the entries, exact (NULL beyond 38 digits).  ``identity_error`` is the largest
    absolute entry of the fit list's whitened covariance minus the identity, measured in a pass of its own.
    Vectors that are NULL or hold NULL or non-finite entries, or entries whose integers have over 62 bits, have no rows; vectors of another length are
    whitened among their like.  Directions without variance are no components: of a table of equal or empty
    vectors, or an empty one, nothing is returned.  Repeated rows and NULL ids are kept.  Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    ship(spark)
    rows = integer_entries(vectors, id_col, vector_col)
    kind = dict(rows.dtypes)["id"]
    distinct = stored(rows.select("x").where(F.size("x") > 0).distinct(), "distinct-vectors")
    models = fit(distinct, components)
    forget(distinct)
    schema = f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    if not models:
        found = spark.createDataFrame([], schema)
    else:
        found = rows.mapInArrow(_applied(spark.sparkContext.broadcast(models)), schema)
    exact: Column = F.expr("try_cast(deviation AS DECIMAL(38, 0))")
    return found.withColumn("deviation", exact).withColumnRenamed("id", id_col)
