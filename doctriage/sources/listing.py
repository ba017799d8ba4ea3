"""Listing files on the executors: a data source whose partitions are folders.

The driver looks at folders only until there are enough of them to deal out; every partition then walks its own
and hands its files on in batches.  ``corpus.list_documents`` lists with the driver's file index
instead, in any store that Spark reads; this source reaches what the executors can open: a mounted
file system, or a store that Arrow knows (s3, gs, hdfs with its native library).
"""

from __future__ import annotations

import fnmatch
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, modified timestamp"
#: Folders that the driver looks into at most before it deals out what it has found.
_LOOKS = 256
_BATCH = 10_000
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


@dataclass
class _Folder(InputPartition):
    """A folder; whether what is below it belongs to the partition too."""

    path: str
    deep: bool


class _Listing(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.pattern = options.get("pattern", "*")
        self.least = int(options.get("partitions", "32"))

    def _located(self) -> tuple[fs.FileSystem, str, str]:
        """(file system, path in it, what stands before a path in it)."""
        plain = re.sub("^file:/+", "/", self.path)
        system, inside = fs.FileSystem.from_uri(plain)
        return system, inside, plain[: -len(inside)] if plain.endswith(inside) else ""

    def partitions(self) -> list[_Folder]:
        system, root, _ = self._located()
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File or not self.recursive:
            return [_Folder(root, False)]
        # Breadth first: a folder that was looked into is a partition of its own files, one that wasn't of all below.
        todo, seen = deque([root]), []
        while todo and len(todo) < self.least and len(seen) < _LOOKS:
            folder = todo.popleft()
            seen.append(folder)
            todo += [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory and not _hidden(x)]
        return [_Folder(f, False) for f in seen] + [_Folder(f, True) for f in todo]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        system, root, prefix = self._located()
        if system.get_file_info(partition.path).type == fs.FileType.File:
            found, wanted = iter([system.get_file_info(partition.path)]), lambda name: True  # one file is taken whatever its name
        else:
            found, wanted = self._walk(system, partition), re.compile(_as_regex(self.pattern)).match
        held: list[fs.FileInfo] = []
        for info in found:
            if info.type == fs.FileType.File and wanted(info.base_name):
                held.append(info)
            if len(held) == _BATCH:
                yield _batch(held, prefix)
                held = []
        if held:
            yield _batch(held, prefix)

    def _walk(self, system: fs.FileSystem, partition: _Folder) -> Iterator[fs.FileInfo]:
        """Folder by folder, so that one folder's files are held at a time; files that start with . or _ are hidden, as in Spark."""
        todo = [partition.path]
        while todo:
            for info in system.get_file_info(fs.FileSelector(todo.pop())):
                if _hidden(info):
                    continue
                if info.type == fs.FileType.Directory and partition.deep:
                    todo.append(info.path)
                else:
                    yield info


def _hidden(info: fs.FileInfo) -> bool:
    return info.base_name.startswith((".", "_"))


def _as_regex(pattern: str) -> str:
    """A file name pattern; {a,b} is either."""
    choices = re.sub(r"\{([^{}]*)\}", lambda m: "\0" + m[1].replace(",", "\1") + "\2", pattern)
    return fnmatch.translate(choices).replace("\0", "(?:").replace("\1", "|").replace("\2", ")")


def _batch(files: list[fs.FileInfo], prefix: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([prefix + f.path for f in files]), pa.array([f.size for f in files], pa.int64()), pa.array([f.mtime for f in files], _ARROW.field("modified").type)],
        schema=_ARROW,
    )


class FolderListing(DataSource):
    """spark.read.format("folder_listing").option("recursive", True).option("pattern", "*.pdf").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Listing:
        return _Listing(self.options)


def list_files(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.[pP][dD][fF]", partitions: int = 32) -> DataFrame:
    """(path, length, modified) of a folder's files, listed by the executors; the rows of ``corpus.list_documents``, and
    empty files, which Spark's file index leaves out.

    ``recursive`` deals folders out to ``partitions`` tasks at least, where there are as many.  Contents are not read.
    """
    spark.dataSource.register(FolderListing)
    options = {"recursive": str(recursive).lower(), "pattern": pattern, "partitions": str(partitions)}
    return spark.read.format("folder_listing").options(**options).load(path)
