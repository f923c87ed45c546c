"""A folder's listing as a Spark source, in batch and as a stream of new and changed files.

    spark.dataSource.register(FolderListing)
    spark.read.format("folder_listing").option("pattern", "*.pdf").load("/mount/in")
    spark.readStream.format("folder_listing").load("/mount/in")

Rows are listings: absolute_path, length, modified_ms. The stream gives a file when it
appears and again when it changes; its offsets are times, so a micro-batch brings what
happened between two of them and a scan's cost after the listing follows the change.
The source looks at the folder as a mounted one, on the machine that plans the query;
folders in other stores go through ``files.list_folder``.
"""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

# The columns of ``files.LISTING_SCHEMA``, said again so that the source stands alone on the workers.
SCHEMA = "absolute_path string, length bigint, modified_ms bigint"
# Files changed less than this ago are left for the next micro-batch, since more may change in the same instant.
SETTLE_MS = 1000


def _entries(folder: str, pattern: str) -> Iterator[tuple[str, int, int, int]]:
    """Path, length, modification and change time in ms of the folder's own files; none for a missing folder."""
    try:
        scan = os.scandir(folder)
    except (FileNotFoundError, NotADirectoryError):
        return
    with scan:
        for entry in scan:
            if not fnmatchcase(entry.name, pattern):
                continue
            try:
                found = entry.stat()
            except FileNotFoundError:  # gone meanwhile
                continue
            if stat.S_ISREG(found.st_mode):
                modified, changed = found.st_mtime_ns // 1_000_000, found.st_ctime_ns // 1_000_000
                # A file moved in keeps its modification time; its change time is the move's.
                yield os.path.join(folder, entry.name), found.st_size, modified, max(modified, changed)


def _folder(options: dict[str, str]) -> tuple[str, str]:
    path = options.get("path")
    if not path:
        raise ValueError("load() needs a folder")
    return os.path.abspath(path.removeprefix("file:")), options.get("pattern", "*.pdf")


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = rows


class _Listing(DataSourceReader):
    """Partitions hold the listing as it was when the query was planned, so a retried task gives the same."""

    ROWS = 10_000

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        rows = sorted(row[:3] for row in _entries(*_folder(self.options)))
        return [_Part(rows[i : i + self.ROWS]) for i in range(0, len(rows), self.ROWS)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from partition.rows


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.settle_ms = int(options.get("settlems", options.get("settleMs", SETTLE_MS)))

    def initialOffset(self) -> dict:
        return {"until_ms": -1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        until = time.time_ns() // 1_000_000 - self.settle_ms
        rows = self._changed(start["until_ms"], until)
        # Without a change the offset stays, so that no empty micro-batch is made.
        return iter([row[:3] for row in rows]), {"until_ms": max([start["until_ms"], *(row[3] for row in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """Files changed in the span. One that changed again since comes with the later span."""
        return iter([row[:3] for row in self._changed(start["until_ms"], end["until_ms"])])

    def _changed(self, after: int, until: int) -> list[tuple[str, int, int, int]]:
        return [row for row in _entries(*_folder(self.options)) if after < row[3] <= until]

    def commit(self, end: dict) -> None:
        pass


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Listing(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


def read_listing(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    spark.dataSource.register(FolderListing)
    return spark.read.format(FolderListing.name()).option("pattern", pattern).load(folder)


def stream_listing(spark: SparkSession, folder: str, pattern: str = "*.pdf", settle_ms: int = SETTLE_MS) -> DataFrame:
    spark.dataSource.register(FolderListing)
    reader = spark.readStream.format(FolderListing.name()).option("pattern", pattern)
    return reader.option("settleMs", str(settle_ms)).load(folder)
