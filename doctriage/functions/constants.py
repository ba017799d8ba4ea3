"""Constant arrays and maps as single expressions.

Spelled out literal by literal they would be thousands of calls into the JVM
per plan; written as one string they are split once, by constant folding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_list(words: list[str]) -> Column:
    return F.split(F.lit("\n".join(words)), "\n")


def text_map(table: dict[str, object]) -> Column:
    pairs = "\n".join(f"{k}\t{v}" for k, v in table.items())
    return F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))
