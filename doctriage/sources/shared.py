"""Intermediate results in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session may go without: its driver and executors share one
    disk, so a temporary folder will do there.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="doctriage-")
    spark.conf.set(_SETTING, folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a result that several branches of a plan read, and reads it back.

    Without it every branch would analyse all texts again.  A table in shared
    storage survives lost executors, and branches only read the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/doctriage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
