"""Spark data source `codetree`: the files of a source tree, one row each.

Spark's own binaryFile source drops names that begin with `_` or `.`, and knows
no ignore files. The walk (names and sizes only) runs once, on the driver; files
are dealt to partitions of about `partitionBytes`, and read where those run. A
file above `maxFileSize` is listed with null content, never read. The tree must
be visible to all executors by the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Config
from ..schemas import ENTRIES
from .ignore import walk


@dataclass
class Files(InputPartition):
    files: tuple[tuple[str, str, int, int], ...]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.most = int(options.get("maxFileSize", Config().max_file_size_bytes))
        self.bytes = int(options.get("partitionBytes", 32 << 20))
        self.skip = frozenset(x for x in options.get("ignoredDirs", "").split("\0") if x)

    def partitions(self) -> list[Files]:
        found: list[Files] = []
        held: list[tuple[str, str, int, int]] = []
        size = 0
        for e in walk(self.root, self.skip):
            stat = e.stat(follow_symlinks=False)
            held.append((os.path.relpath(e.path, self.root).replace(os.sep, "/"), e.path, stat.st_size, max(0, int(stat.st_mtime))))
            size += min(stat.st_size, self.most) + 4096
            if size >= self.bytes:
                found.append(Files(tuple(held)))
                held, size = [], 0
        return [*found, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[tuple]:
        for relative, path, size, mtime in partition.files:
            content = None
            if size <= self.most:
                with open(path, "rb") as file:
                    content = file.read()
            yield relative, path, size, mtime, content


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self):
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """relative_path, path, size_bytes, mtime_seconds, content of all files under root that the configuration doesn't ignore."""
    config = config or Config()
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"failed to canonicalize {root}")
    spark.dataSource.register(TreeSource)
    return spark.read.format("codetree").option("maxFileSize", config.max_file_size_bytes).option("ignoredDirs", "\0".join(config.ignored_dirs)).load(root)
