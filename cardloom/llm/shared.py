"""Helpers that several corpus operators use."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word all over this subpackage: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session that names none may only be a local one (as in tests), whose driver is its executor: it has one temporary
    folder for itself. On a cluster it is an error, since each executor would write to a disk of its own.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="cardloom-")
    return _LOCAL[sc.applicationId]


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/cardloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs one rerun of a task, never of the whole history.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return to the system what this process has freed, which allocators else keep, in the driver through all later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # C libraries other than glibc
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def row_key(df: DataFrame) -> Column:
    """A digest of 128 bits over all columns: rows that differ in any of them have different keys."""
    parts = [F.coalesce(F.concat(F.length(t := F.col(f"`{f.name}`").cast("string")).cast("string"), F.lit(":"), t), F.lit("-")) for f in df.schema.fields]
    return F.md5(F.concat_ws(",", *parts))
