"""Where documents come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.sources.files import is_folder


def _plain_path(path: Column) -> Column:
    """Local file URIs as plain paths, others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def decoded_path(uri: Column) -> Column:
    """The path that an encoded file URI stands for: %xx is decoded, + is a plus."""
    return _plain_path(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def list_documents(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """The files of a folder as (path, length, modified); contents are not read.

    The driver's file index lists them; ``listing.list_files`` has executors do it.

    Also the table of existing files for a rename plan (``pattern='*'``).  A
    path that names one file is taken whatever its extension.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern if is_folder(spark, path) else "*")
        .load(path)
    )
    return files.select(
        _plain_path(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified")
    )


def read_text_files(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*") -> DataFrame:
    """Text files as documents (path, text, errors), one row per file."""
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern)
        .text(path)
        .select(
            decoded_path(F.col("_metadata.file_path")).alias("path"),
            F.col("value").alias("text"),
            F.lit(None).cast("string").alias("errors"),
        )
    )


def from_table(df: DataFrame, path: Column, text: str = "text", errors: str | None = None) -> DataFrame:
    """Any table as documents; only the columns named here are read."""
    return df.select(
        path.alias("path"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.col(errors) if errors else F.lit(None).cast("string")).alias("errors"),
    )


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Shuffles an input by a key if the caller asks for it.

    Files with few row groups keep most cores idle; whether a shuffle of their rows pays is
    for the caller to say, as an argument or as the session's setting ``doctriage.spread``.
    """
    asked = partitions or int(df.sparkSession.conf.get("doctriage.spread", "0"))
    return df.repartition(asked, key) if asked else df


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """An input of rows that each mean much work, texts or what texts are made from, dealt over all cores by its keys.

    A file with one row group is one task however many cores there are, and parts put together by their size
    would be few again: the session's ``spark.sql.shuffle.partitions`` (or ``doctriage.spread``) says how many.
    """
    conf = df.sparkSession.conf
    return df.repartition(int(conf.get("doctriage.spread", "0")) or int(conf.get("spark.sql.shuffle.partitions")), *keys)
