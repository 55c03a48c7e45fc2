"""Readers and writers of the pipeline's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import strict_date
from ..functions.numbers import optional_flag
from ..functions.text import base_name, collapsed
from ..schemas import DECISIONS, struct_of

MANIFEST = ("card_id", "image_path", "difficulty_bucket", "deceased_name", "date_of_death")
PREDICTIONS = struct_of(
    "card_id string, image_path string, difficulty_bucket string, model_id string, gt_deceased_name string, gt_date_of_death string, pred_deceased_name string, pred_date_of_death string, "
    "normalized_gt_name string, normalized_gt_dod string, normalized_pred_name string, normalized_pred_dod string, name_match string, dod_match string, exact_match string, latency_ms string, error string, usage_json string, raw_text string"
)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decision log; blank and malformed lines are skipped."""
    return spark.read.schema(DECISIONS).option("mode", "DROPMALFORMED").json(path)


def read_manifest_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document; a missing or broken one gives no row."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # noqa: BLE001  the reader's error for a missing path has no type of its own
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation manifest. Missing columns, blank keys and dates that can't be read are errors."""
    df = spark.read.csv(path, header=True)
    if lacking := sorted(set(MANIFEST) - set(df.columns)):
        raise ValueError(f"the manifest lacks columns: {', '.join(lacking)}")
    blank = lambda c: F.coalesce(collapsed(F.col(c)), F.lit("")) == ""
    key = lambda c: F.when(blank(c), F.raise_error(F.concat(F.lit(f"a row has no {c}: "), F.coalesce(F.col("card_id"), F.lit("?")))).cast("string")).otherwise(collapsed(F.col(c)))
    return df.select(*[key(c).alias(c) for c in MANIFEST[:3]], F.coalesce(collapsed(F.col("deceased_name")), F.lit("")).alias("deceased_name"), strict_date(F.col("date_of_death")).alias("date_of_death"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as written by write_predictions: flags and numbers typed, blanks as defaults."""
    df = spark.read.schema(PREDICTIONS).csv(path, header=True, multiLine=True, escape='"')
    flag = lambda c: (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == "true").alias(c)
    typed = {"name_match", "dod_match", "exact_match"}
    return df.select(*[flag(c) if c in typed else F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) if c == "latency_ms" else F.nullif(F.col(c), F.lit("")).alias(c) if c == "error" else F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def read_adjudications(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select("card_id", "model_id", *[optional_flag(F.col(c)).alias(c) for c in ("human_name_correct", "human_dod_correct")], F.coalesce("notes", F.lit("")).alias("notes"))


def read_images(spark: SparkSession, folder: str, glob: str = "*.{jpg,jpeg,png,webp,tif,tiff}") -> DataFrame:
    """Images below a folder (card_id: the name without its ending, image_path, content), for the recognition engines. Only the files that
    a task reads are opened there."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return df.select(F.regexp_replace(base_name(F.col("path")), r"\.[A-Za-z0-9]+$", "").alias("card_id"), F.col("path").alias("image_path"), "content")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """True names and dates of images (filename, owner_name, date_of_death), trimmed, blank ones as null."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in ("filename", "owner_name", "date_of_death")])


def write_report(lines: DataFrame, path: str) -> None:
    """The lines (line_no, line) of a report as one text file in a folder, in order."""
    lines.repartition(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    out = df.select(*[F.format_string("%.3f", F.col(c)).alias(c) if c == "latency_ms" else F.col(c).cast("string").alias(c) for c in PREDICTIONS.fieldNames()])
    out.write.csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """All columns under a header, null as the empty cell."""
    df.write.csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.write.json(path, ignoreNullFields=False)


def table_checksum(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free checksum of a table."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]


def write_backup(df: DataFrame, folder: str, stamp: str) -> tuple[int, int]:
    """A snapshot of a table with its checksum beside it."""
    df.write.parquet(f"{folder}/{stamp}/data")
    found = table_checksum(df.sparkSession.read.parquet(f"{folder}/{stamp}/data"))
    df.sparkSession.createDataFrame([found], "rows long, checksum long").write.parquet(f"{folder}/{stamp}/checksum")
    return found


def read_backup(spark: SparkSession, folder: str, stamp: str) -> DataFrame:
    """A snapshot, if what it holds is what was written."""
    df, said = spark.read.parquet(f"{folder}/{stamp}/data"), spark.read.parquet(f"{folder}/{stamp}/checksum").first()
    if table_checksum(df) != (said["rows"], said["checksum"]):
        raise ValueError(f"backup {stamp} doesn't match its checksum")
    return df


def outdated(listing: DataFrame, group: str, name: str, keep: int) -> DataFrame:
    """All but the newest ``keep`` of each group, by name."""
    newest = Window.partitionBy(group).orderBy(F.desc(name))
    return listing.withColumn("place", F.row_number().over(newest)).where(F.col("place") > keep).drop("place")


def new_by_hash(incoming: DataFrame, existing: DataFrame, content: str, order: str) -> DataFrame:
    """Uploads whose content isn't known yet, one of each content."""
    hashed = incoming.withColumn("file_hash", F.sha2(F.col(content).cast("binary"), 256))
    first = hashed.groupBy("file_hash").agg(F.min(order).alias(order))
    return first.join(existing.select("file_hash").distinct(), "file_hash", "left_anti")


def allowed(df: DataFrame, path: str, endings: tuple[str, ...] = ("mp4", "mov", "avi", "mkv", "m4v")) -> DataFrame:
    return df.where(F.lower(F.regexp_extract(base_name(F.col(path)), r"\.([A-Za-z0-9]+)$", 1)).isin(*endings))


def stale(listing: DataFrame, modified: str, now: float, age: float) -> DataFrame:
    """Files that are older than ``age`` seconds, of which at least 60 count."""
    return listing.where(F.col(modified) <= now - max(60.0, age))
