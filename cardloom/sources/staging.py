"""Tables that are replaced in two phases, or partition by partition, so that a run that fails leaves the old table whole and a
run that is repeated changes nothing.

Folders are moved by the Hadoop file system of their path, from the driver; data is written and read by tasks only. A move is one step
on HDFS and on local disks; where a store copies instead, readers should look at the table between runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import table_checksum


class Folders:
    """Moves, deletions and listings of folders, in whatever file system a path belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"can't move {old} to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def children(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []


def _beside(path: str, word: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{word}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> tuple[str, tuple[int, int]]:
    """Writes ``df`` beside ``path``. Gives the folder, and rows and checksum as read again from it; what was written is counted by
    the write itself, and the folder goes if they differ or the write fails."""
    spark, folder = df.sparkSession, _beside(path, "staged")
    from pyspark.sql import Observation

    seen = Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x")).write.parquet(folder)
        said, found = (seen.get["n"], seen.get["x"]), table_checksum(spark.read.schema(df.schema).parquet(folder))
        if said != found:
            raise ValueError(f"{path}: what was staged isn't what was written: {found} for {said}")
    except Exception:
        Folders(spark, path).delete(folder)
        raise
    return folder, found


def swapped(spark: SparkSession, folder: str, path: str) -> None:
    """Puts a staged folder in the place of a table. If that fails the old table is put back."""
    fs, old = Folders(spark, path), _beside(path, "previous")
    had = fs.exists(path)
    if had:
        fs.move(path, old)
    try:
        fs.move(folder, path)
    except Exception:
        if had and not fs.exists(path):
            fs.move(old, path)
        raise
    if had:
        fs.delete(old)


def replace_table(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> tuple[int, int]:
    """Replaces the table at ``path`` by ``df``, which may be made of that table. ``check`` sees what was staged and may refuse it by
    raising. Gives rows and checksum."""
    spark = df.sparkSession
    folder, found = staged(df, path)
    try:
        if check:
            check(spark.read.schema(df.schema).parquet(folder))
        swapped(spark, folder, path)
    except Exception:
        Folders(spark, path).delete(folder)
        raise
    return found


def overwrite_partitions(df: DataFrame, path: str, by: str, keys: DataFrame | None = None) -> None:
    """Overwrites the partitions of the keys that were worked on, and no others: those ``df`` has rows of and, of ``keys`` (a column
    named ``by``), those it has none of, which are emptied. Work done twice leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if keys is None:
        return
    gone = keys.select(F.col(by).cast("string").alias(by)).distinct().join(df.select(F.col(by).cast("string").alias(by)).distinct(), by, "left_anti")
    fs = Folders(df.sparkSession, path)
    there = set(fs.children(path))
    for row in gone.toLocalIterator():  # keys that lost all of their rows; only names pass through the driver, one by one
        name = f"{by}={'__HIVE_DEFAULT_PARTITION__' if row[0] is None else row[0]}"
        if name in there:
            fs.delete(f"{path}/{name}")
