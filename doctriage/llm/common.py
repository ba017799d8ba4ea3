"""Shared pieces: stored tables, byte forms of texts, runs of equal keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: A-Z to a-z, everything else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower case, and every ASCII character but letters and digits a blank.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once for each application; Spark distributes the file."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="doctriage-modules-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="doctriage-llm-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a result to the shared folder and reads it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(column: str | Column = "text") -> Column:
    """The text, NULL as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions(df: DataFrame, least: int = 1) -> int:
    """Partitions for a shuffle: the session's setting, which the user sizes for the input."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def byte_texts(column: pa.Array) -> list[bytes]:
    """Strings as UTF-8 bytes without decoding them; NULL as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that Python objects of few texts live at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that rows with equal keys are never cut apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(batch.column(k)[0] != held[-1].column(k)[held[-1].num_rows - 1] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            same &= longs(batch.column(k)) == v.as_py()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted arrays."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
