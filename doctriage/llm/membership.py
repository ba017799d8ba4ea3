"""Filters of fixed size for large sets of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from doctriage.llm.common import ship

#: The filter's size in bits whatever the set's size: 8 MB, what is broadcast at most.
BITS = 1 << 26


#: Words of 64 bits that one task puts together.
_SLICE = 1 << 16


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of the filter that have bits set, as bytes."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        which, word, bits = (batch.column(i).to_numpy() for i in range(3))
        for s in np.unique(which).tolist():
            found.setdefault(s, np.zeros(_SLICE, np.int64))[word[which == s]] = bits[which == s]
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["slice", "bits"])


def _places(keys: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(keys, F.lit(i)), F.lit(BITS)) for i in range(2)))


def hit(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For keys of which the places are given, whether the filter's bits at both are set."""
    found = np.ones(len(a), bool)
    for at in (a, b):
        found &= ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return found


def places(column: Column, names: tuple[str, str]) -> list[Column]:
    """The places of a key, two long columns, for ``hit`` inside a function over Arrow batches."""
    both = _places(column)
    return [both[i].alias(n) for i, n in enumerate(names)]


def bits_of(keys: DataFrame):
    """A filter over the only column of ``keys`` (long), broadcast: an array of BITS bits for ``hit``.

    The bits are set by an aggregate, of which tasks put slices together: what comes to the driver are those bytes.
    """
    ship(keys.sparkSession)
    places = keys.select(F.explode(_places(F.col(keys.columns[0]))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    dealt = words.select(F.floor(F.col("word") / _SLICE).cast("int").alias("slice"), (F.col("word") % _SLICE).cast("int").alias("word"), "bits")
    slices = dealt.repartition(BITS // 64 // _SLICE, "slice").mapInArrow(_as_bytes, "slice int, bits binary").collect()
    table = np.zeros(BITS // 64, np.uint64)
    for r in slices:
        table[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] |= np.frombuffer(r["bits"], np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def test_of(shared) -> "callable":
    """A filter from ``bits_of`` as a function from a Column (long) to a boolean Column."""

    @pandas_udf("boolean")
    def look(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(hit(shared.value, a.to_numpy(np.int64), b.to_numpy(np.int64)))

    def test(column: Column) -> Column:
        both = _places(column)
        return look(both[0], both[1])

    return test


def may_hold(keys: DataFrame) -> "callable":
    """A filter over the only column of ``keys`` (long): a function from a Column to a boolean Column.

    FALSE is certain, TRUE is not; a larger set gives more false TRUEs and a broadcast of the
    same size.
    """
    return test_of(bits_of(keys))
