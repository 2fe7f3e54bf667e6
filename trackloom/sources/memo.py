"""Frames that are read once: a bounded number of persisted ones, by source, arguments and the state of their files."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_state(spark: SparkSession, paths: list[str]) -> tuple:
    """(path, bytes, time of change) of every file of ``paths``, contents unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", F.col("modificationTime").cast("double"))
    return tuple(sorted(map(tuple, found.collect())))  # the files of one match


class Memo:
    """Persisted frames, ``limit`` at most: the one that was asked for longest ago is released first. A frame is read
    again when one of its files has changed."""

    def __init__(self, limit: int = 1):
        if limit < 1:
            raise ValueError("limit must be at least 1")
        self.limit = limit
        self.held: OrderedDict[tuple, DataFrame] = OrderedDict()

    def get(self, spark: SparkSession, source: str, arguments: dict, read: Callable[[], DataFrame]) -> DataFrame:
        """``read()``, persisted, unless the same has been read from the same files before."""
        paths = [v for k, v in sorted(arguments.items()) if isinstance(v, str) and k in PATHS]
        key = (source, *sorted((k, str(v)) for k, v in arguments.items()), file_state(spark, paths) if paths else ())
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        for old in [k for k in self.held if k[:-1] == key[:-1]]:  # its files have changed
            self.held.pop(old).unpersist()
        self.held[key] = read().persist(StorageLevel.MEMORY_AND_DISK)
        while len(self.held) > self.limit:
            self.held.popitem(last=False)[1].unpersist()
        return self.held[key]

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()


#: Names of the sources' arguments that are paths.
PATHS = ("sf_dir", "home", "away", "xml", "text", "path", "match", "roster")
