"""The card pipeline's tables as views of the test tables, in Spark and as SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import sign_bits
from ..functions.numbers import rounded

#: Models of the evaluation: name and number (fixed values of the test data).
MODELS = (("alpha", 1), ("beta", 2), ("gamma", 3))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.row_number().over(w).alias("frame_number"), rounded(F.col("value") / 6, 6).alias("motion"), k.alias("sharpness"), (F.col("event_id") * 2654435761 % 4294967296).alias("hash"), *more)


def cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("card_id"), F.col("conv_id").alias("video_id"), (F.col("turn") + 1).alias("sequence_index"), F.col("role").alias("image_path"), F.col("text").alias("raw_text"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Card and result in one row: documents with labels."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "l")
    joined = docs.join(labels, F.col("doc_id") == F.col("l"), "left")
    status = F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "corrected").otherwise("pending")
    seq = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    died = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("doc_id") % 9000).cast("int")), "yyyy-MM-dd")
    return joined.select(
        F.col("doc_id").alias("card_id"), F.col("source").alias("video_id"), seq.alias("sequence_index"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("confidence_score"),
        status.alias("review_status"), (F.col("doc_id") % 3).cast("int").alias("review_version"), F.col("text").alias("deceased_name"), died.alias("date_of_death"), F.lit(None).cast("string").alias("reviewed_by"),
    )


def videos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("filename"), F.col("c_acctbal").alias("file_size_bytes"), F.col("c_nationkey").alias("resolution_w"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("video_id"), status.alias("status"), F.col("o_orderpriority").alias("job_type"), F.col("o_orderdate").alias("created_at"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    models = spark.createDataFrame(list(MODELS), "model_id string, model_no int")
    x = table(spark, d, "labels").crossJoin(F.broadcast(models))  # three models
    name, dod = (F.col("doc_id") * 7 + F.col("model_no")) % 5 != 0, (F.col("doc_id") * 3 + F.col("model_no")) % 4 != 0
    bucket = F.when(F.col("doc_id") % 3 == 0, "easy").when(F.col("doc_id") % 3 == 1, "medium").otherwise("hard")
    error = F.when((F.col("doc_id") + F.col("model_no")) % 17 == 0, "timeout")
    return x.select(F.col("doc_id").alias("card_id"), "model_id", bucket.alias("difficulty_bucket"), name.alias("name_match"), dod.alias("dod_match"), (name & dod).alias("exact_match"), ((F.col("doc_id") * 13 + F.col("model_no") * 50) % 997).cast("double").alias("latency_ms"), error.alias("error"))


def adjudications(spark: SparkSession, d: str) -> DataFrame:
    three = lambda n: F.when(F.col("card_id") % n == 0, F.lit(None).cast("boolean")).otherwise(F.col("card_id") % 2 == 0)
    return predictions(spark, d).where("card_id % 11 = 0 and model_id <> 'gamma'").select("card_id", "model_id", three(3).alias("human_name_correct"), three(5).alias("human_dod_correct"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").cast("int").alias("segment"), sign_bits(F.col("embedding")).alias("hash"))


def page_words(text: Column) -> Column:
    """A text's words with boxes, line by line, word by word."""
    word = lambda w, y, x: F.struct(w.alias("text"), (F.length(w) * 7 % 100).cast("int").alias("confidence"), F.array(x * 60, y * 20, x * 60 + F.length(w) * 5, y * 20 + 12).alias("bbox"))
    return F.flatten(F.transform(F.split(text, "\n"), lambda line, y: F.transform(F.filter(F.split(line, " "), lambda w: w != ""), lambda w, x: word(w, y, x))))


def words(spark: SparkSession, d: str) -> DataFrame:
    """A row for each document: its words with boxes, and four boxes to match."""
    every = page_words(F.col("text"))
    k = (F.col("doc_id") % 7).cast("int")
    support = F.array(*[F.array(k * 3 + i * 60, F.lit(i % 2 * 20 + 1), k * 3 + i * 60 + 30, F.lit(i % 2 * 20 + 13)) for i in range(4)])
    return table(spark, d, "documents").select(F.col("doc_id").alias("card_id"), every.alias("words"), support.alias("support"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "rejected_blur").when(F.col("event_type") == "click", "rejected_dedup").when(F.col("event_type") == "view", "accepted").otherwise("rejected_short_stable")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("video_id"), kind.alias("decision"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("sharpness"), (F.col("value") * 2).alias("selected_sharpness"))


SQL = {
    "frames": "SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS frame_number, round(value / 6, 6) AS motion, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sharpness, event_id * 2654435761 % 4294967296 AS hash FROM events",
    "cards": "SELECT conv_id * 1000 + turn AS card_id, conv_id AS video_id, turn + 1 AS sequence_index, role AS image_path, text AS raw_text FROM conversations",
    "results": "SELECT d.doc_id AS card_id, source AS video_id, row_number() OVER (PARTITION BY source ORDER BY d.doc_id)::INT AS sequence_index, (n_chars % 1000) / 1000.0::DOUBLE AS confidence_score, CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'corrected' ELSE 'pending' END AS review_status, (d.doc_id % 3)::INT AS review_version, text AS deceased_name, strftime(DATE '1990-01-01' + (d.doc_id % 9000)::INT, '%Y-%m-%d') AS date_of_death, NULL::VARCHAR AS reviewed_by FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "videos": "SELECT c_custkey AS video_id, c_name AS filename, c_acctbal AS file_size_bytes, c_nationkey AS resolution_w FROM customer",
    "jobs": "SELECT o_orderkey AS job_id, o_custkey AS video_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderpriority AS job_type, o_orderdate AS created_at FROM orders",
    "predictions": "SELECT doc_id AS card_id, model_id, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty_bucket, (doc_id * 7 + model_no) % 5 <> 0 AS name_match, (doc_id * 3 + model_no) % 4 <> 0 AS dod_match, (doc_id * 7 + model_no) % 5 <> 0 AND (doc_id * 3 + model_no) % 4 <> 0 AS exact_match, ((doc_id * 13 + model_no * 50) % 997)::DOUBLE AS latency_ms, CASE WHEN (doc_id + model_no) % 17 = 0 THEN 'timeout' END AS error FROM labels, (VALUES ('alpha', 1), ('beta', 2), ('gamma', 3)) m(model_id, model_no)",
    "adjudications": "SELECT card_id, model_id, CASE WHEN card_id % 3 = 0 THEN NULL ELSE card_id % 2 = 0 END AS human_name_correct, CASE WHEN card_id % 5 = 0 THEN NULL ELSE card_id % 2 = 0 END AS human_dod_correct FROM predictions WHERE card_id % 11 = 0 AND model_id <> 'gamma'",
    "hashes": "SELECT label AS video_id, vec_id::INT AS segment, embedding FROM embeddings",
    "decisions": "SELECT event_id, user_id AS video_id, CASE event_type WHEN 'error' THEN 'rejected_blur' WHEN 'click' THEN 'rejected_dedup' WHEN 'view' THEN 'accepted' ELSE 'rejected_short_stable' END AS decision, CASE WHEN event_id % 2 = 0 THEN value END AS sharpness, value * 2 AS selected_sharpness FROM events",
    "words": "SELECT doc_id AS card_id, y, x, w AS text, (length(w) * 7 % 100)::INT AS confidence, x * 60 AS x1, y * 20 AS y1, x * 60 + length(w) * 5 AS x2, y * 20 + 12 AS y2, row_number() OVER (PARTITION BY doc_id ORDER BY y, x) - 1 AS word_no FROM (SELECT doc_id, y, unnest(ws) AS w, unnest(range(len(ws))) AS x FROM (SELECT doc_id, y, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS y FROM documents)))",
}


def sql(query: str, *views: str) -> str:
    """A query over the views named, each with those it needs."""
    return ("WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + " " if views else "") + query
