"""Schemas of the persistent tables, and reading of older tables into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .params import FIELDS


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<int>": T.ArrayType(T.IntegerType()), "array<double>": T.ArrayType(T.DoubleType())}


def struct_of(text: str) -> T.StructType:
    """A schema from ``name type, name type``, without need of a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


VIDEOS = struct_of("id string, filename string, filepath string, file_hash string, status string, duration_seconds double, resolution_w int, resolution_h int, fps double, frame_count int, file_size_bytes bigint, upload_timestamp timestamp, metadata_json string")
JOBS = struct_of("id string, video_id string, job_type string, status string, progress int, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp")
CARDS = struct_of("id string, video_id string, job_id string, frame_number int, image_path string, sequence_index int, extracted_at timestamp")
RESULTS = struct_of(
    "id string, card_id string, raw_text string, raw_fields_json string, confidence_score double, word_confidences string, ocr_engine_version string, processed_at timestamp, "
    "review_status string, review_version int, reviewed_by string, reviewed_at timestamp, error_message string, " + ", ".join(f"{f} string" for f in FIELDS)
)
FRAMES = struct_of("video_id string, frame_number int, motion double, sharpness double, hash bigint")
DECISIONS = struct_of(
    "decision string, video_id string, segment_index int, sequence_index int, frame_number int, image_path string, stable_duration_frames int, selected_motion_score double, "
    "selected_sharpness double, sharpness double, needs_review boolean, extraction_confidence string, duplicate_distance int, duplicate_of_frame_number int, threshold double, reason string"
)
WORDS = struct_of("text string, confidence int, bbox array<int>, block_num int, par_num int, line_num int, word_num int")


def evolved(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones as null or their default, extra ones dropped."""
    have, defaults = set(df.columns), defaults or {}
    cols = []
    for f in schema.fields:
        col = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(col, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else col).alias(f.name))
    return df.select(cols)


#: The persistent tables by name, with defaults of columns that older ones lack.
TABLES = {"videos": (VIDEOS, {"status": "uploaded"}), "jobs": (JOBS, {"status": "queued", "progress": 0}), "cards": (CARDS, {}), "ocr_results": (RESULTS, {"review_version": 0, "review_status": "pending", "confidence_score": 0.0})}


def loaded(spark: SparkSession, folder: str | None = None, jdbc: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The persistent tables in their present schemas, also as views of their names: from Parquet folders below ``folder``, or from a
    database that Spark's JDBC source reaches with the options ``jdbc`` (url, driver, ...)."""
    out = {}
    for name, (schema, defaults) in TABLES.items():
        df = spark.read.format("jdbc").options(**jdbc, dbtable=name).load() if jdbc else spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}")
        out[name] = evolved(df, schema, defaults)
        out[name].createOrReplaceTempView(name)
    return out


def violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: empty where ``keys`` are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
