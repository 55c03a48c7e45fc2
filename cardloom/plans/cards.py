"""Named queries of listing, review, jobs, export and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.scoring import band, review_status
from ..operators import review
from ..schemas import evolved, struct_of
from ..sources import files
from . import analogs as A
from .analogs import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_LIST = "card_id, video_id, sequence_index, confidence_score, review_status"


@query(sql(f"SELECT {_LIST} FROM results ORDER BY confidence_score NULLS FIRST, sequence_index, card_id LIMIT 50 OFFSET 50", "results"))
def review_list_default(spark: SparkSession, d: str) -> DataFrame:
    return review.page(A.results(spark, d).select(*_LIST.split(", ")), 2, 50)


@query(sql(f"SELECT {_LIST} FROM results WHERE video_id = 'src3' ORDER BY sequence_index, card_id LIMIT 20", "results"))
def review_list_by_sequence(spark: SparkSession, d: str) -> DataFrame:
    return review.page(review.matching(A.results(spark, d), video_id="src3").select(*_LIST.split(", ")), 1, 20, by="sequence")


@query(sql(f"SELECT {_LIST} FROM results WHERE review_status IN ('flagged', 'pending')", "results"))
def review_filter_status_in(spark: SparkSession, d: str) -> DataFrame:
    return review.matching(A.results(spark, d), status_in=" Flagged, pending,,").select(*_LIST.split(", "))


@query(sql(f"SELECT {_LIST} FROM results WHERE confidence_score >= 0.25 AND confidence_score <= 0.7 AND review_status = 'approved'", "results"))
def review_filter_confidence(spark: SparkSession, d: str) -> DataFrame:
    return review.matching(A.results(spark, d), min_confidence=0.25, max_confidence=0.7, status="APPROVED").select(*_LIST.split(", "))


@query(sql("SELECT card_id, deceased_name FROM results WHERE lower(deceased_name) LIKE '%th_r%'", "results"))
def review_search_text(spark: SparkSession, d: str) -> DataFrame:
    return review.matching(A.results(spark, d), q="Th_R").select("card_id", "deceased_name")


@query(sql("SELECT card_id, date_of_death FROM results WHERE date_of_death >= '1990-06-01' AND date_of_death <= '1991-12-31'", "results"))
def review_date_range(spark: SparkSession, d: str) -> DataFrame:
    return review.matching(A.results(spark, d), died_from="1990-06-01", died_to="1991-12-31").select("card_id", "date_of_death")


@query(sql("SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 50.0) AS BIGINT), 1) AS pages FROM results WHERE review_status = 'flagged'", "results"))
def review_total_and_pages(spark: SparkSession, d: str) -> DataFrame:
    return review.page_counts(review.matching(A.results(spark, d), status="flagged"), 50)


@query(sql("SELECT count(*) AS total, count(*) FILTER (review_status = 'flagged') AS flagged, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'corrected') AS corrected, count(*) FILTER (review_status = 'approved' AND confidence_score >= 0.85) AS auto_approved FROM results", "results"))
def review_stats(spark: SparkSession, d: str) -> DataFrame:
    return review.status_counts(A.results(spark, d))


@query(sql("SELECT band, count(*) AS n FROM (SELECT CASE WHEN confidence_score >= 0.85 THEN 'auto-approved' WHEN confidence_score >= 0.7 THEN 'pending-review' ELSE 'flagged' END AS band FROM results) GROUP BY band", "results"))
def review_bands(spark: SparkSession, d: str) -> DataFrame:
    return A.results(spark, d).groupBy(band(F.col("confidence_score")).alias("band")).agg(F.count("*").alias("n"))


@query(sql("SELECT card_id, video_id, review_status, review_version, coalesce(reviewed_by, '') AS reviewed_by, date_of_death FROM results WHERE card_id = 7", "results"))
def card_detail(spark: SparkSession, d: str) -> DataFrame:
    return A.results(spark, d).where("card_id = 7").limit(1).select("card_id", "video_id", "review_status", "review_version", F.coalesce("reviewed_by", F.lit("")).alias("reviewed_by"), "date_of_death")


@query(sql("SELECT v.video_id, filename, coalesce(n, 0) AS job_count FROM videos v LEFT JOIN (SELECT video_id, count(*) AS n FROM jobs GROUP BY video_id) j ON v.video_id = j.video_id", "videos", "jobs"))
def video_card_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.with_child_counts(A.videos(spark, d).select("video_id", "filename"), A.jobs(spark, d), "video_id", "video_id", "job_count")


@query(sql("SELECT job_id, status, strftime(created_at, '%Y-%m-%d') AS created, coalesce(filename, '') AS video_name FROM jobs j LEFT JOIN videos v ON j.video_id = v.video_id ORDER BY created_at DESC, job_id LIMIT 100", "jobs", "videos"))
def jobs_with_video(spark: SparkSession, d: str) -> DataFrame:
    top = A.jobs(spark, d).orderBy(F.desc("created_at"), "job_id").limit(100)  # before the join: only what is shown meets videos
    v = A.videos(spark, d).select(F.col("video_id").alias("v"), "filename")
    return top.join(v, F.col("video_id") == F.col("v"), "left").select("job_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.coalesce("filename", F.lit("")).alias("video_name"))


@query(sql("SELECT video_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, job_id DESC) AS r FROM jobs WHERE status IN ('queued', 'running')) WHERE r = 1", "jobs"))
def job_latest_active(spark: SparkSession, d: str) -> DataFrame:
    active = A.jobs(spark, d).where(F.col("status").isin("queued", "running"))
    return review.latest_state(active, "video_id", ["created_at", "job_id"]).select("video_id", "job_id", "status")


@query("SELECT user_id AS job_id, event_type AS status, least(greatest(CAST(round(value) AS INT), 0), 100) AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def job_state_from_events(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"), numbers.clamped(F.round("value"), 0, 100).cast("int").alias("progress"))
    return review.latest_state(e, "job_id", ["ts", "event_id"]).select("job_id", "status", "progress")


@query(sql("SELECT failed, active, flagged, pending, CASE WHEN failed > 0 THEN 'check failed jobs' WHEN flagged > 0 THEN 'review flagged cards' WHEN pending > 0 THEN 'verify pending cards' WHEN active > 0 THEN 'wait for jobs' ELSE 'upload a video' END AS next_action FROM (SELECT count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('queued', 'running')) AS active FROM jobs), (SELECT count(*) FILTER (review_status = 'flagged') AS flagged, count(*) FILTER (review_status = 'pending') AS pending FROM results)", "jobs", "results"))
def dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    j = A.jobs(spark, d).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("queued", "running")).alias("active"))
    r = review.status_counts(A.results(spark, d)).select("flagged", "pending")
    action = F.when(F.col("failed") > 0, "check failed jobs").when(F.col("flagged") > 0, "review flagged cards").when(F.col("pending") > 0, "verify pending cards").when(F.col("active") > 0, "wait for jobs").otherwise("upload a video")
    return j.crossJoin(r).withColumn("next_action", action)  # one row each


@query("SELECT c.conv_id AS video_id, turn + 1 AS sequence_index, c.text AS raw_text, coalesce(u.c_name, '') AS filename FROM conversations c LEFT JOIN customer u ON c.conv_id = u.c_custkey WHERE role = 'user'")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    v = A.videos(spark, d).select(F.col("video_id").alias("v"), "filename")
    return A.cards(spark, d).where("image_path = 'user'").join(v, F.col("video_id") == F.col("v"), "left").select("video_id", "sequence_index", "raw_text", F.coalesce("filename", F.lit("")).alias("filename")).orderBy("video_id", "sequence_index")


_SLUG = "substr(coalesce(nullif(regexp_replace(regexp_replace(upper(replace(coalesce({0}, ''), 'ß', 'ss')), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'UNKNOWN'), 1, {1})"


@query(sql(f"SELECT card_id, {_SLUG.format('deceased_name', 80)} || '_' || {_SLUG.format('date_of_death', 20)} || '__card_' || printf('%03d', sequence_index) || '.jpg' AS file_name FROM results WHERE review_status IN ('approved', 'corrected')", "results"))
def export_file_names(spark: SparkSession, d: str) -> DataFrame:
    rows = review.matching(A.results(spark, d), status_in="approved,corrected")
    return rows.select("card_id", text.export_name(F.col("deceased_name"), F.col("date_of_death"), F.col("sequence_index"), F.lit(".jpg")).alias("file_name"))


@query(sql("SELECT card_id FROM results WHERE review_status = 'approved' AND card_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0)", "results"))
def export_missing_sources(spark: SparkSession, d: str) -> DataFrame:
    listing = A.table(spark, d, "labels").where("doc_id % 2 = 0").select(F.col("doc_id").alias("card_id"))
    return review.matching(A.results(spark, d), status="approved").join(listing, "card_id", "left_anti").select("card_id")


@query(sql("SELECT c.card_id, c.sequence_index, d.decision, d.sharpness FROM cards c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY event_id DESC) AS r FROM decisions) WHERE r = 1) d ON c.video_id = d.video_id", "cards", "decisions"))
def frames_preview_overlay(spark: SparkSession, d: str) -> DataFrame:
    last = review.last_of(A.decisions(spark, d).select("video_id", "event_id", "decision", "sharpness"), ["video_id"], "event_id").withColumnRenamed("video_id", "v")
    return A.cards(spark, d).join(last, F.col("video_id") == F.col("v"), "left").select("card_id", "sequence_index", "decision", "sharpness")


@query("SELECT doc_id AS card_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_cards(spark: SparkSession, d: str) -> DataFrame:
    results = A.table(spark, d, "labels").select(F.col("doc_id").alias("card_id"))
    return review.unprocessed(A.table(spark, d, "documents").select(F.col("doc_id").alias("card_id")), results)


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents WHERE doc_id % 10 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 1")
def dedup_upload_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    existing = docs.where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("file_hash"))
    return files.new_by_hash(docs.where("doc_id % 10 <> 0"), existing, "text", "doc_id")


@query(sql("SELECT video_id, decision, count(*) AS n FROM decisions GROUP BY ALL", "decisions"))
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.decisions(spark, d).groupBy("video_id", "decision").agg(F.count("*").alias("n"))


@query(sql("SELECT event_id, coalesce(sharpness, selected_sharpness) AS sharpness, (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM decisions WHERE decision = 'rejected_blur') AS pages FROM decisions WHERE decision = 'rejected_blur' ORDER BY event_id LIMIT 25 OFFSET 50", "decisions"))
def blur_queue_page(spark: SparkSession, d: str) -> DataFrame:
    blurred = A.decisions(spark, d).where("decision = 'rejected_blur'")
    rows = blurred.select("event_id", F.coalesce("sharpness", "selected_sharpness").alias("sharpness")).orderBy("event_id").offset(50).limit(25)
    return rows.crossJoin(blurred.agg(numbers.pages(F.count("*"), 25, least=0).alias("pages")))  # one page, one count


@query("SELECT o_custkey AS grp, o_orderkey AS name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r > 10")
def backup_rotation(spark: SparkSession, d: str) -> DataFrame:
    return files.outdated(A.table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("name")), "grp", "name", 10)


_UPDATES = "SELECT card_id, (review_version + CASE WHEN card_id % 5 = 0 THEN 1 ELSE 0 END)::INT AS review_version, card_id % 2 = 0 AS edited, CASE WHEN card_id % 2 = 0 THEN 'Name ' || card_id END AS deceased_name, 'u' || (card_id % 4) AS reviewed_by, card_id % 7 AS submitted_at, card_id AS update_id FROM results WHERE card_id % 3 = 0 UNION ALL SELECT card_id, review_version, false, NULL, 'late', 99, card_id + 1000000 FROM results WHERE card_id % 6 = 0"


def _updates(spark: SparkSession, d: str) -> DataFrame:
    A.results(spark, d).createOrReplaceTempView("cardloom_results")
    return spark.sql(_UPDATES.replace("FROM results", "FROM cardloom_results").replace("::INT", ""))


_JUDGED = f"updates AS ({_UPDATES}), ranked AS (SELECT u.*, r.review_version AS current_version, row_number() OVER (PARTITION BY u.card_id, u.review_version ORDER BY submitted_at, update_id) AS turn FROM updates u LEFT JOIN results r ON u.card_id = r.card_id), won AS (SELECT * FROM ranked WHERE turn = 1 AND review_version = current_version)"


@query(f"WITH results AS ({A.SQL['results']}), {_JUDGED} SELECT r.card_id, CASE WHEN w.card_id IS NULL THEN r.review_status WHEN w.edited THEN 'corrected' ELSE 'approved' END AS review_status, r.review_version + CASE WHEN w.card_id IS NULL THEN 0 ELSE 1 END AS review_version, coalesce(w.deceased_name, r.deceased_name) AS deceased_name, coalesce(w.reviewed_by, '') AS reviewed_by FROM results r LEFT JOIN won w ON r.card_id = w.card_id")
def review_updates_apply(spark: SparkSession, d: str) -> DataFrame:
    now, _ = review.apply_reviews(A.results(spark, d), _updates(spark, d))
    return now.select("card_id", "review_status", "review_version", "deceased_name", F.coalesce("reviewed_by", F.lit("")).alias("reviewed_by"))


@query(f"WITH results AS ({A.SQL['results']}), {_JUDGED} SELECT update_id, card_id, review_version, current_version FROM ranked WHERE NOT (turn = 1 AND review_version = current_version)")
def review_update_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return review.apply_reviews(A.results(spark, d), _updates(spark, d))[1]


@query(sql("SELECT card_id, CASE WHEN card_id % 9 = 0 THEN 'approved' ELSE review_status END AS review_status, review_version FROM results", "results"))
def batch_approve(spark: SparkSession, d: str) -> DataFrame:
    ids = A.table(spark, d, "documents").where("doc_id % 9 = 0").select(F.col("doc_id").alias("card_id"))
    return review.batch_approved(A.results(spark, d), ids, "x").select("card_id", "review_status", "review_version")


@query(sql("SELECT card_id, video_id FROM cards WHERE video_id NOT IN (SELECT video_id FROM videos WHERE resolution_w = 3)", "cards", "videos"))
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = A.videos(spark, d).where("resolution_w = 3")
    return review.without_parent(A.cards(spark, d), gone, "video_id", "video_id").select("card_id", "video_id")


@query(sql("SELECT card_id, review_status, 0 AS review_version, NULL::VARCHAR AS grave_fee FROM results", "results"))
def schema_evolution_fill(spark: SparkSession, d: str) -> DataFrame:
    old = A.results(spark, d).select("card_id", "review_status")
    return evolved(old, struct_of("card_id bigint, review_status string, review_version int, grave_fee string"), {"review_version": 0})


@query(sql("SELECT card_id, CASE WHEN sequence_index % 13 = 0 THEN 'flagged' WHEN confidence_score < 0.7 THEN 'flagged' WHEN confidence_score >= 0.85 THEN 'approved' ELSE 'pending' END AS status FROM results", "results"))
def status_assignment(spark: SparkSession, d: str) -> DataFrame:
    return A.results(spark, d).select("card_id", review_status(F.col("confidence_score"), forced=F.col("sequence_index") % 13 == 0).alias("status"))


@query(sql("SELECT card_id, review_status FROM results WHERE card_id % 2 = 0 UNION ALL SELECT card_id, 'fresh' FROM results WHERE card_id % 2 = 1", "results"))
def result_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = A.results(spark, d).select("card_id", "review_status")
    fresh = r.where("card_id % 2 = 1").withColumn("review_status", F.lit("fresh"))
    return review.upserted(r, fresh, ["card_id"])


@query("SELECT user_id AS client, event_id, n >= 5 AS locked FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')")
def login_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-60, 0)
    e = A.table(spark, d, "events").where("event_type = 'error'").withColumn("at", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("double"))
    return e.select(F.col("user_id").alias("client"), "event_id", (F.count("*").over(w) >= 5).alias("locked"))


@query("SELECT c_custkey AS video_id, CASE WHEN c_nationkey > 0 THEN c_nationkey || 'x' || (c_nationkey * 2) END AS resolution, floor(c_custkey / 60)::BIGINT || ':' || lpad((c_custkey % 60)::VARCHAR, 2, '0') AS duration FROM customer")
def video_projection(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("c_nationkey")
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), numbers.resolution(w, w * 2).alias("resolution"), numbers.duration_text(F.col("c_custkey")).alias("duration"))
