"""Collision-free names for results as they arrive, with keyed state.

A file name ``X-7.pdf`` is number 7 of ``X.pdf``, and ``X.pdf`` is number 0 of itself, so every name belongs
to one base and one number, and whoever keeps the numbers of a base can't meet anybody else.  State is keyed by
base and part: numbers are dealt to parts by their remainder, and a document that asks for the bare name goes to a part
by a hash of its path.  A target that a third of all documents want is so spread over as many
tasks as there are parts.  Inside a part numbers are given in the order of arrival, the least free one first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from doctriage.functions.text import normalized_path
from doctriage.operators.rename import split_extension

#: Parts of a target: what a hot target is spread over.
PARTS = 16
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _base_and_number(target: Column) -> tuple[Column, Column]:
    """(base, number): X-7.pdf is (X.pdf, 7), anything else is number 0 of itself."""
    stem, ext = split_extension(target)
    number = F.regexp_extract(stem, r"(?s)-([1-9][0-9]{0,17})$", 1)
    base = F.concat(F.regexp_replace(stem, r"(?s)-[1-9][0-9]{0,17}$", ""), ext)
    return F.when(number != "", base).otherwise(target), F.when(number != "", number.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


class _Numbers(StatefulProcessor):
    """The numbers of one base and part: where the next free one is looked for, and those taken beyond it."""

    def __init__(self, parts: int):
        self.parts = parts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n bigint")
        self.taken = handle.getMapState("taken", "n bigint", "there boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        self.taken.updateValue((initialState["number"],), (True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        base, part = key
        start = self.next.get()
        at = start[0] if start else part
        for row in rows:
            number = row["number"]
            # Number 0 of X-1.pdf is number 1 of X.pdf, and that's for others to give.
            at = max(at, self.parts) if row["nested"] and part == 0 else at
            # A number that was asked for is given if it is free; the bare name is number 0, of part 0.
            if number % self.parts != part or number < at or self.taken.containsKey((number,)):
                while self.taken.containsKey((at,)):
                    self.taken.removeKey((at,))
                    at += self.parts
                number = at
            if number == at:
                at += self.parts
            else:
                self.taken.updateValue((number,), (True,))
            yield Row(path_in=row["path_in"], base=base, number=number)
        self.next.update((at,))


def name_stream(results: DataFrame, existing: DataFrame | None = None, parts: int = PARTS, path: str = "path_in", target: str = "target") -> DataFrame:
    """(path_in, path_out) for every arriving result that has a target; no two are equal, nor equal to a file in ``existing``.

    ``existing`` (path) is a table, read when the stream starts for the first time.  The bare name goes to the first
    document that asks for it in its part, and not at all where that part is not 0: with ``parts=1`` documents are numbered
    0, 1, 2, ... in the order of their arrival, for the price of one task for each target.  A document that asks
    for ``X-7.pdf`` when that is taken gets another number of ``X.pdf``.  Results without a target are left out.

    Needs the RocksDB state store, which this sets for the session if no store was chosen.
    """
    spark = results.sparkSession
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)

    def keyed(df: DataFrame, name: Column, spread: Column) -> DataFrame:
        base, number = _base_and_number(normalized_path(name))
        numbered = df.withColumns({"base": base, "number": number})
        part = F.when(F.col("number") > 0, F.col("number")).otherwise(spread)
        nested = _base_and_number(F.col("base"))[1] > 0
        return numbered.withColumn("part", F.pmod(part, F.lit(parts)).cast("bigint")).withColumn("nested", nested)

    asked = results.where(F.col(target).isNotNull()).select(F.col(path).alias("path_in"), F.col(target).alias("_target"))
    asked = keyed(asked, F.col("_target"), F.xxhash64("path_in")).select("base", "part", "path_in", "number", "nested")
    initial = None
    if existing is not None:
        initial = keyed(existing.select("path"), F.col("path"), F.lit(0)).select("base", "part", "number").distinct().groupBy("base", "part")
    named = asked.groupBy("base", "part").transformWithState(
        _Numbers(parts), "path_in string, base string, number bigint", "Append", "None", initial
    )
    stem, ext = split_extension(F.col("base"))
    out = F.when(F.col("number") == 0, F.col("base")).otherwise(F.concat(stem, F.lit("-"), F.col("number").cast("string"), ext))
    return named.select("path_in", out.alias("path_out"))
