"""Where intermediate tables go: the shared checkpoint folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where that is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own.setdefault("dir", tempfile.mkdtemp(prefix="turnloom-"))
    return found.rstrip("/")


_own: dict[str, str] = {}


def folder(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = folder(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    _made.append(path)
    return path


#: Folders made so far that have not been deleted, in order.
_made: list[str] = []


def made(since: int = 0) -> list[str]:
    """The folders made so far that have not been deleted, from the ``since``-th on."""
    return _made[since:]


def delete(spark: SparkSession, paths: list[str], reader: DataFrame) -> bool:
    """Delete folders, unless ``reader`` reads one of them itself."""
    names = {path.rsplit("/", 1)[1] for path in paths}
    if names and any(not names.isdisjoint(file.split("/")) for file in reader.inputFiles()):
        return False
    for path in paths:
        fs, p = folder(spark, path)
        fs.delete(p, True)
        if path in _made:
            _made.remove(path)
    return True


def written(df: DataFrame, name: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors cost no recomputation.

    ``by``: columns at the end of the rows that the table is laid out by. The table goes when the application ends,
    or before with ``discard``.
    """
    path = scratch(df.sparkSession, name)
    df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


_paths: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in tables:
        _, path = _paths.pop(id(df))
        if path in _made:
            _made.remove(path)
        fs, p = folder(df.sparkSession, path)
        fs.delete(p, True)
