"""What is done to files and folders as such, in whatever store Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    located = spark._jvm.org.apache.hadoop.fs.Path(path)
    return located.getFileSystem(spark._jsc.hadoopConfiguration()), located


def exists(spark: SparkSession, path: str) -> bool:
    system, located = _located(spark, path)
    return system.exists(located)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, located = _located(spark, path)
    return system.getFileStatus(located).isDirectory()


def make_folder(spark: SparkSession, path: str) -> None:
    system, located = _located(spark, path)
    system.mkdirs(located)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder and what is in it; nothing happens if it isn't there."""
    system, located = _located(spark, path)
    system.delete(located, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder; the target must not be there yet."""
    system, located = _located(spark, source)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    if system.exists(goal):
        raise FileExistsError(target)
    parent = goal.getParent()
    if parent is not None:
        system.mkdirs(parent)
    if not system.rename(located, goal):
        raise OSError(f"{source} could not be renamed to {target}")
