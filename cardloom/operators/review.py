"""Listing, searching, paging, counting and updating of reviewed cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import pages
from ..params import Review


def statuses(text: str | None) -> list[str]:
    """The statuses of a comma-separated list; empty means any."""
    return [x.strip().lower() for x in (text or "").split(",") if x.strip()]


def matching(
    cards: DataFrame, *, video_id: object = None, status: str | None = None, status_in: str | None = None, min_confidence: float | None = None,
    max_confidence: float | None = None, q: str | None = None, text: str = "deceased_name", died_from: str | None = None, died_to: str | None = None,
) -> DataFrame:
    """Rows that meet all the conditions given. In ``q`` percent and underscore are wild, a backslash stands for itself; dates compare as ISO text."""
    found: list[Column] = []
    if video_id not in (None, ""):
        found.append(F.col("video_id") == video_id)
    if status:
        found.append(F.col("review_status") == status.lower())
    if wanted := statuses(status_in):
        found.append(F.col("review_status").isin(wanted))
    if min_confidence is not None:
        found.append(F.col("confidence_score") >= min_confidence)
    if max_confidence is not None:
        found.append(F.col("confidence_score") <= max_confidence)
    if q:
        found.append(F.lower(F.col(text)).like("%" + q.lower().replace("\\", "\\\\") + "%"))
    if died_from:
        found.append(F.col("date_of_death") >= died_from)
    if died_to:
        found.append(F.col("date_of_death") <= died_to)
    return cards.where(reduce(Column.__and__, found)) if found else cards


def page(df: DataFrame, number: int, size: int, by: str = "confidence") -> DataFrame:
    """A page of a listing: worst confidence first, or in the order of the cards; ids settle ties."""
    order = ["sequence_index", "card_id"] if by == "sequence" else ["confidence_score", "sequence_index", "card_id"]
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", pages(F.col("total"), size))


def status_counts(results: DataFrame, p: Review = Review()) -> DataFrame:
    """All counts of the overview in one pass."""
    is_ = lambda s: F.col("review_status") == s
    return results.agg(
        F.count("*").alias("total"), *[F.count_if(is_(s)).alias(s) for s in ("flagged", "pending", "approved", "corrected")],
        F.count_if(is_("approved") & (F.col("confidence_score") >= p.auto_approve)).alias("auto_approved"),
    )


def with_child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 for none. Children are counted before they are joined."""
    counts = children.groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias(name))
    return parents.join(counts, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.lit(0)))


def last_of(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row with the largest position for each key: what a dict built in order would keep."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("__r"))
    return top.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def apply_reviews(current: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Optimistic updates: (next state, conflicts).

    updates: card_id, review_version, edited (boolean), deceased_name (null: unchanged), reviewed_by, submitted_at, update_id.
    An update counts if its version is the card's; of several for one version the first submitted wins, then the smallest
    id. Edits make a card corrected, none approved; its version goes up by one.
    """
    first = Window.partitionBy("card_id", "review_version").orderBy("submitted_at", "update_id")
    ranked = updates.withColumn("turn", F.row_number().over(first))
    now = current.select(F.col("card_id").alias("__id"), F.col("review_version").alias("__v"))
    judged = ranked.join(now, F.col("card_id") == F.col("__id"), "left").withColumn("won", F.coalesce((F.col("review_version") == F.col("__v")) & (F.col("turn") == 1), F.lit(False)))
    won = judged.where("won").select(F.col("card_id").alias("__id"), "edited", F.col("deceased_name").alias("__name"), F.col("reviewed_by").alias("__by"))
    out = current.join(won, F.col("card_id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    out = out.withColumn("review_status", F.when(hit & F.col("edited"), "corrected").when(hit, "approved").otherwise(F.col("review_status")))
    out = out.withColumn("deceased_name", F.coalesce("__name", "deceased_name")).withColumn("reviewed_by", F.coalesce("__by", "reviewed_by"))
    out = out.withColumn("review_version", F.col("review_version") + hit.cast("int")).select(current.columns)
    return out, judged.where("not won").select("update_id", "card_id", "review_version", F.col("__v").alias("current_version"))


def batch_approved(current: DataFrame, ids: DataFrame, by: str) -> DataFrame:
    """Listed cards approved; their versions stay, as in the single-card form they don't."""
    hit = current.join(ids.select(F.col("card_id").alias("__id")).distinct(), F.col("card_id") == F.col("__id"), "left")
    on = F.col("__id").isNotNull()
    return hit.withColumn("review_status", F.when(on, "approved").otherwise(F.col("review_status"))).withColumn("reviewed_by", F.when(on, by).otherwise(F.col("reviewed_by"))).select(current.columns)


def without_parent(children: DataFrame, gone: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Cascading delete: children whose parent isn't among those gone."""
    return children.join(gone.select(F.col(parent_key).alias("__g")).distinct(), F.col(key) == F.col("__g"), "left_anti")


def upserted(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows, and the current ones that none of them replaces."""
    return fresh.unionByName(current.join(fresh.select(keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def unprocessed(cards: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    return cards if force else cards.join(results.select("card_id").distinct(), "card_id", "left_anti")


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last state of each key from an append-only table of transitions."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def job_states(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """State of each job from its events (job_id, at, seq, kind, progress, message), an append-only table: status, progress, started_at,
    completed_at, error_message.

    Kinds are running, progress, completed and failed; others count for nothing. The last of those that set a field decides it, by
    ``at`` and then ``seq``; a job without any is queued at 0. Progress is kept from 0 to 100, and completion makes it 100.
    """
    kind, last = F.col("kind"), F.struct("at", "seq")
    of = lambda value, *kinds: F.max_by(F.when(kind.isin(*kinds), value), F.when(kind.isin(*kinds), last))
    share = F.when(kind == "completed", 100).otherwise(F.least(F.greatest(F.coalesce("progress", F.lit(0)), F.lit(0)), F.lit(100)))
    sums = events.groupBy(F.col("job_id").alias("__j")).agg(
        of(kind, "running", "completed", "failed").alias("status"), of(share, "progress", "completed").alias("progress"), of(F.col("at"), "running").alias("started_at"),
        of(F.col("at"), "completed", "failed").alias("completed_at"), of(F.col("message"), "failed").alias("error_message"),
    )
    out = jobs.select("job_id").join(sums, F.col("job_id") == F.col("__j"), "left")
    return out.select("job_id", F.coalesce("status", F.lit("queued")).alias("status"), F.coalesce("progress", F.lit(0)).cast("int").alias("progress"), "started_at", "completed_at", "error_message")


def one(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; LookupError if there is none."""
    found = rows.where(F.col(key) == F.lit(value)).limit(1)
    if found.isEmpty():
        raise LookupError(f"no row has {key} {value}")
    return found


def decision_totals(log: DataFrame, by: str) -> DataFrame:
    """Of each video: its windows, those that became candidates, and how many met each decision."""
    kinds = ("accepted", "rejected_blur", "rejected_dedup", "rejected_short_stable")
    n = {k: F.count_if(F.col("decision") == k) for k in kinds}
    return log.groupBy(by).agg(F.count("*").alias("windows"), (F.count("*") - n["rejected_short_stable"]).alias("candidates"), *[v.alias(k) for k, v in n.items()])


def with_defaults(left: DataFrame, right: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """left with columns taken from right where it has the key, else as given."""
    marked = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__v_{c}") for c in columns])
    on = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in keys])
    joined = left.join(marked, on, "left")
    return joined.select(*[c for c in left.columns if c not in columns], *[F.coalesce(F.col(f"__v_{c}"), v).alias(c) for c, v in columns.items()])


def jobs_matching(jobs: DataFrame, status: str | None = None, job_type: str | None = None) -> DataFrame:
    for name, value in (("status", status), ("job_type", job_type)):
        jobs = jobs if value is None else jobs.where(F.col(name) == value)
    return jobs


def swept(jobs: DataFrame, videos: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, videos) after a restart: running jobs have failed, and so have the videos in processing that they worked on."""
    running = F.coalesce(F.col("status") == "running", F.lit(False))
    hit = jobs.where(running).select(F.col("video_id").alias("__v")).distinct()
    out = jobs.withColumn("error_message", F.when(running, F.lit(reason)).otherwise(F.col("error_message"))).withColumn("status", F.when(running, "failed").otherwise(F.col("status")))
    marked = videos.join(hit, F.col("video_id") == F.col("__v"), "left")
    lost = F.col("__v").isNotNull() & (F.col("status") == "processing")
    return out, marked.withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).select(videos.columns)


def with_failures(current: DataFrame, failed: DataFrame, fields: list[str]) -> DataFrame:
    """Results after failed recognitions (card_id, error; one a card): no confidence, flagged, fields null, the message kept;
    cards without a result get one."""
    f = failed.select(F.col("card_id").alias("__id"), F.col("error").alias("__error"))
    out = current.join(f, F.col("card_id") == F.col("__id"), "full")
    bad = F.col("__id").isNotNull()
    new = {"card_id": F.coalesce("card_id", "__id"), "confidence_score": F.when(bad, 0.0).otherwise(F.col("confidence_score")), "review_status": F.when(bad, "flagged").otherwise(F.col("review_status")), "error_message": F.when(bad, F.col("__error")).otherwise(F.col("error_message"))}
    return out.select(*[new[c].alias(c) if c in new else F.when(~bad, F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns])
