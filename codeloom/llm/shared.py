"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where unset, an own folder if all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("codeloom.own.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("codeloom.own.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def own_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the session's file system closes."""
    path = f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    _made.append(path)
    return path


#: Folders of own_dir() that are still there.
_made: list[str] = []


def made(first: int = 0) -> list[str]:
    """Folders of own_dir(), from one on."""
    return _made[first:]


def forget(spark: SparkSession, folders: list[str], needed: DataFrame) -> None:
    """Removes folders, but for those that `needed` still reads. For a caller that knows that nothing else does."""
    used = " ".join(needed.inputFiles())
    for path in folders:
        if path in _made and path.rpartition("/")[2] not in used:
            remove(spark, path)
            _made.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The frame, written as Parquet in the shared folder (in folders of column `by`) and read back.

    It cuts the lineage: a lost executor costs the tasks of one later stage,
    not the stages before. Spark's commit protocol keeps half-written or
    repeated tasks out.
    """
    path = f"{own_dir(df.sparkSession, name)}/table"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
