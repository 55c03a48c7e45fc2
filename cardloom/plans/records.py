"""Named queries of motion, dates of several forms, words with boxes, fallback values, failures and job sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, scoring, text
from ..operators import review, segmentation, words
from . import analogs as A
from .analogs import sql
from .layouts import forms

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


@query("SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding, before), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(embedding), 6) AS motion FROM (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)")
def frame_motion_arrays(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select("vec_id", "label", F.col("label").alias("video_id"), F.col("vec_id").alias("frame_number"), F.col("embedding").cast("array<double>").alias("roi"))
    return segmentation.with_motion(e, "roi").select("vec_id", "label", F.round("motion", 6).alias("motion"))


_DAY = "DATE '1970-01-01' + (doc_id % 17000)::INT"


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'about ' || doc_id ELSE strftime({_DAY}, '%Y-%m-%d') END AS iso FROM labels")
def text_date_forms(spark: SparkSession, d: str) -> DataFrame:
    """Days written in four forms, and texts that are no date and stay as they are."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("doc_id") % 17000).cast("int"))
    form = F.col("doc_id") % 5
    shown = F.when(form == 4, F.concat(F.lit("about "), F.col("doc_id")))
    for i, f in enumerate(("MMMM d, yyyy", "M/d/yyyy", "MM-dd-yy", "MMM d, yyyy")):
        shown = F.when(form == i, F.date_format(day, f)).otherwise(shown)
    return A.table(spark, d, "labels").select("doc_id", dates.any_form(shown).alias("iso"))


@query("SELECT doc_id AS card_id, CASE WHEN doc_id % 3 = 0 THEN '/static/frames/' || source || '/card_' || doc_id || '.jpg' END AS url FROM documents")
def card_image_url(spark: SparkSession, d: str) -> DataFrame:
    root = F.when(F.col("doc_id") % 3 == 0, "/data/frames/").otherwise("/data/frames-old/")
    path = F.concat(root, "source", F.lit("/card_"), "doc_id", F.lit(".jpg"))
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("card_id"), text.image_url(path, "/data/frames").alias("url"))


@query(sql("SELECT count(*) AS total, count(*) FILTER (review_status = 'flagged') AS flagged, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'corrected') AS corrected, count(*) FILTER (review_status = 'approved' AND confidence_score >= 0.85) AS auto_approved FROM results WHERE video_id = 'src3'", "results"))
def review_stats_of_video(spark: SparkSession, d: str) -> DataFrame:
    return review.status_counts(review.matching(A.results(spark, d), video_id="src3"))


@query(sql("SELECT job_id, video_id FROM jobs WHERE status = 'queued' AND job_type = '1-URGENT'", "jobs"))
def jobs_by_status_and_type(spark: SparkSession, d: str) -> DataFrame:
    return review.jobs_matching(A.jobs(spark, d), status="queued", job_type="1-URGENT").select("job_id", "video_id")


_SWEPT = "'stopped by a restart'"


@query(sql(f"SELECT job_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN {_SWEPT} END AS error_message FROM jobs", "jobs"))
def sweep_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = A.jobs(spark, d).withColumn("error_message", F.lit(None).cast("string"))
    return review.swept(jobs, _videos(spark, d), "stopped by a restart")[0].select("job_id", "status", "error_message")


@query(sql("SELECT video_id, CASE WHEN resolution_w % 2 = 1 THEN 'uploaded' WHEN video_id IN (SELECT video_id FROM jobs WHERE status = 'running') THEN 'failed' ELSE 'processing' END AS status FROM videos", "videos", "jobs"))
def sweep_videos(spark: SparkSession, d: str) -> DataFrame:
    jobs = A.jobs(spark, d).withColumn("error_message", F.lit(None).cast("string"))
    return review.swept(jobs, _videos(spark, d), "stopped by a restart")[1].select("video_id", "status")


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return A.videos(spark, d).withColumn("status", F.when(F.col("resolution_w") % 2 == 1, "uploaded").otherwise("processing"))


@query(sql("SELECT card_id, CASE WHEN card_id % 4 = 0 THEN 0.0 ELSE confidence_score END AS confidence_score, CASE WHEN card_id % 4 = 0 THEN 'flagged' ELSE review_status END AS review_status, CASE WHEN card_id % 4 <> 0 THEN deceased_name END AS deceased_name, CASE WHEN card_id % 4 <> 0 THEN date_of_death END AS date_of_death, CASE WHEN card_id % 4 = 0 THEN 'timeout' END AS error_message FROM results", "results"))
def result_failures(spark: SparkSession, d: str) -> DataFrame:
    now = A.results(spark, d).select("card_id", "confidence_score", "review_status", "deceased_name", "date_of_death").withColumn("error_message", F.lit(None).cast("string"))
    failed = A.table(spark, d, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("card_id"), F.lit("timeout").alias("error"))
    return review.with_failures(now, failed, ["deceased_name", "date_of_death"])


_OFFERED = """offers AS (SELECT p_partkey, unnest(['deceased_name', 'date_of_death', 'address', 'owner_address', 'relation', 'care_of', 'undertaker', 'grave_type', 'board_of_health_no', 'phone']) AS field,
  unnest([p_name, strftime(DATE '2021-01-01' + (p_partkey % 300)::INT, '%m/%d/%Y'), (p_partkey % 900) || ' Elm', (p_partkey % 900) || ' Elm Street', CASE WHEN p_partkey % 3 = 0 THEN 'son' ELSE strftime(DATE '2021-01-01' + (p_partkey % 300)::INT, '%B %d, %Y') END, CASE WHEN p_partkey % 2 = 0 THEN 'Relation: son' ELSE p_brand END, CASE WHEN p_partkey % 4 = 0 THEN 'Undertaker' ELSE p_brand END, CASE WHEN p_partkey % 5 = 0 THEN 'Description ' || p_type ELSE p_type END, CASE WHEN p_partkey % 6 = 0 THEN '--' ELSE p_size::VARCHAR END, CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE '10/16/2021' END]) AS offered FROM part),
read AS (SELECT *, trim(coalesce(offered, '')) AS t FROM offers),
seen AS (SELECT *, regexp_matches(t, '^([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[A-Za-z]+\\s+[0-9]{1,2},\\s*[0-9]{2,4})$') AS dated, regexp_matches(lower(t), 'date of|description|undertaker|grave fee|type of grave|relation|owner') AS labelled, field IN ('owner_address', 'address') AS placed FROM read)
SELECT p_partkey AS id, field, CASE WHEN t = '' OR field IN ('date_of_death', 'date_of_burial') THEN false WHEN placed AND (dated OR labelled OR length(t) < 8) THEN false WHEN field IN ('care_of', 'relation') AND (dated OR labelled) THEN false WHEN field IN ('type_of_grave', 'grave_type') AND starts_with(lower(t), 'description') THEN false WHEN field = 'undertaker' AND labelled THEN false WHEN field = 'board_of_health_no' AND NOT regexp_matches(t, '[0-9A-Za-z]') THEN false ELSE true END AS accepted FROM seen"""


@query("WITH " + _OFFERED)
def fallback_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Which of ten values that an engine offers for each part may fill a blank field."""
    k = F.col("p_partkey")
    day = F.date_add(F.lit("2021-01-01").cast("date"), (k % 300).cast("int"))
    offers = {
        "deceased_name": F.col("p_name"), "date_of_death": F.date_format(day, "MM/dd/yyyy"), "address": F.concat(k % 900, F.lit(" Elm")), "owner_address": F.concat(k % 900, F.lit(" Elm Street")),
        "relation": F.when(k % 3 == 0, "son").otherwise(F.date_format(day, "MMMM dd, yyyy")), "care_of": F.when(k % 2 == 0, "Relation: son").otherwise(F.col("p_brand")), "undertaker": F.when(k % 4 == 0, "Undertaker").otherwise(F.col("p_brand")),
        "grave_type": F.when(k % 5 == 0, F.concat(F.lit("Description "), "p_type")).otherwise(F.col("p_type")), "board_of_health_no": F.when(k % 6 == 0, "--").otherwise(F.col("p_size").cast("string")), "phone": F.when(k % 7 == 0, "  ").otherwise("10/16/2021"),
    }
    rows = A.table(spark, d, "part").select(k.alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("offered")) for f, v in offers.items()])).alias("o"))
    return rows.select("id", "o.field", scoring.acceptable(F.col("o.field"), F.col("o.offered")).alias("accepted"))


@query("SELECT doc_id AS card_id, CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '1970-01-01' + (doc_id % 17000)::INT, '%Y-%m-%d') END AS date_of_death FROM documents")
def words_date_of_death(spark: SparkSession, d: str) -> DataFrame:
    """Of the forms: right of the word that names the death; a word that names the burial ends what is looked at."""
    return forms(spark, d).select("card_id", words.date_of_death(F.col("words")).alias("date_of_death"))
