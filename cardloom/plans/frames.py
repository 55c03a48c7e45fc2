"""Named queries of ordered frames and of words with boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.geometry import hamming, sign_bits
from ..operators import segmentation, words
from ..params import Backstop, Segmentation
from . import analogs as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The test events move much, so windows are short: these settings find some.
SHORT = Segmentation(exit_frames=3, min_frames=4, low_confidence_frames=6, candidate_motion=2.0, blur=20.0)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_V = "PARTITION BY video_id ORDER BY frame_number"
_STREAKS = f"streaks AS (SELECT *, rn - coalesce(max(CASE WHEN NOT coalesce(motion >= 12, false) THEN rn END) OVER ({_V}), 0) AS high_streak, rn - coalesce(max(CASE WHEN NOT coalesce(motion <= 6, false) THEN rn END) OVER ({_V}), 0) AS low_streak FROM (SELECT *, row_number() OVER ({_V}) AS rn FROM frames))"
_MEMBERS = f"""{_STREAKS},
events2 AS (SELECT *, CASE WHEN high_streak >= 2 THEN 'E' WHEN low_streak >= 3 THEN 'X' END AS event FROM streaks),
latched AS (SELECT *, coalesce(max(CASE WHEN event = 'E' THEN 1 ELSE 0 END) OVER ({_V}) = 1 AND last_value(event IGNORE NULLS) OVER ({_V}) = 'X', false) AS stable FROM events2),
begun AS (SELECT *, stable AND NOT coalesce(lag(stable) OVER ({_V}), false) AS begins FROM latched),
islands AS (SELECT *, sum(begins::INT) OVER ({_V}) AS island, NOT stable AND coalesce(max(begins::INT) OVER ({_V} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) = 1 AS seed, lead(motion) OVER ({_V}) AS after, max(frame_number) OVER (PARTITION BY video_id) AS last_frame FROM begun),
members AS (SELECT *, CASE WHEN seed THEN island + 1 ELSE island END AS segment FROM islands WHERE stable OR seed),
bounded AS (SELECT *, min(frame_number) OVER (PARTITION BY video_id, segment) AS first_frame, max(frame_number) OVER (PARTITION BY video_id, segment) AS final_frame FROM members),
inner_frames AS (SELECT *, CASE WHEN frame_number > first_frame AND frame_number < final_frame THEN round((motion + after) / 2, 6) END AS local_motion FROM bounded)"""
_CHOSEN = f"""{_MEMBERS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY CASE WHEN local_motion IS NULL THEN 2 WHEN local_motion <= 2 THEN 0 ELSE 1 END, CASE WHEN local_motion <= 2 THEN local_motion ELSE round(-(sharpness - 4 * local_motion), 6) END, local_motion, -sharpness, frame_number) AS r FROM inner_frames),
chosen AS (SELECT video_id, segment::BIGINT AS segment, max(first_frame) AS first_frame, max(final_frame) AS final_frame, count(*) AS frames, bool_or(frame_number = last_frame) AS eof, max(CASE WHEN r = 1 AND local_motion IS NOT NULL THEN frame_number END) AS frame_number, max(CASE WHEN r = 1 THEN local_motion END) AS local_motion, max(CASE WHEN r = 1 AND local_motion IS NOT NULL THEN sharpness END) AS sharpness, coalesce(bool_or(r = 1 AND local_motion > 2), false) AS fallback FROM ranked GROUP BY ALL)"""


def _with(rest: str, final: str) -> str:
    return f"WITH frames AS ({A.SQL['frames']}), {rest} {final}"


@query(_with(_STREAKS, "SELECT video_id, frame_number, high_streak::INT AS high_streak, low_streak::INT AS low_streak FROM streaks"))
def frame_motion_streaks(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.streaks(A.frames(spark, d), SHORT).select("video_id", "frame_number", F.col("high_streak").cast("int").alias("high_streak"), F.col("low_streak").cast("int").alias("low_streak"))


@query(_with(_CHOSEN, "SELECT video_id, segment, first_frame, final_frame, frames, eof FROM chosen"))
def frame_segments(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.candidates(A.frames(spark, d), SHORT).select("video_id", "segment", "first_frame", "final_frame", "frames", "eof")


@query(_with(_CHOSEN, "SELECT video_id, segment, frame_number, local_motion, sharpness, fallback FROM chosen"))
def frame_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.candidates(A.frames(spark, d), SHORT).select("video_id", "segment", "frame_number", "local_motion", "sharpness", "fallback")


@query(_with(_CHOSEN, "SELECT video_id, segment, CASE WHEN frames < 4 OR frame_number IS NULL THEN 'rejected_short_stable' WHEN sharpness < 20 THEN 'rejected_blur' END AS decision, frames < 6 OR eof OR fallback OR coalesce(sharpness < 20, false) AS needs_review FROM chosen"))
def frame_judgement(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.judged(segmentation.candidates(A.frames(spark, d), SHORT), SHORT).select("video_id", "segment", "decision", "needs_review")


_DECISIONS = f"""WITH RECURSIVE frames AS ({A.SQL['frames']}), {_CHOSEN},
judged AS (SELECT *, CASE WHEN frames < 4 OR frame_number IS NULL THEN 'rejected_short_stable' WHEN sharpness < 20 THEN 'rejected_blur' END AS decision, frames < 6 OR eof OR fallback OR coalesce(sharpness < 20, false) AS needs_review FROM chosen),
due AS (SELECT j.video_id, segment, hash, row_number() OVER (PARTITION BY j.video_id ORDER BY segment) AS k FROM judged j JOIN frames f ON f.video_id = j.video_id AND f.frame_number = j.frame_number WHERE decision IS NULL),
fold AS (SELECT video_id, segment, k, hash AS last, true AS ok, 1 AS n FROM due WHERE k = 1
  UNION ALL SELECT due.video_id, due.segment, due.k, CASE WHEN x.ok THEN due.hash ELSE fold.last END, x.ok, fold.n + x.ok::INT FROM fold JOIN due ON due.video_id = fold.video_id AND due.k = fold.k + 1, LATERAL (SELECT bit_count(xor(due.hash, fold.last)) >= 6 AS ok) x)
SELECT j.video_id, j.segment, coalesce(decision, CASE WHEN ok THEN 'accepted' ELSE 'rejected_dedup' END) AS decision, CASE WHEN ok THEN n END AS sequence_index, frame_number, needs_review FROM judged j LEFT JOIN fold f ON f.video_id = j.video_id AND f.segment = j.segment"""


@query(_DECISIONS)
def frame_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The whole decision log."""
    return segmentation.decisions(A.frames(spark, d), SHORT).select("video_id", "segment", "decision", "sequence_index", "frame_number", "needs_review")


@query(
    "WITH RECURSIVE b AS (SELECT label AS video_id, vec_id::INT AS segment, list_transform(embedding, lambda x: x > 0) AS h, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), "
    "f AS (SELECT video_id, segment, k, h AS last, true AS accepted, 1 AS n FROM b WHERE k = 1 UNION ALL SELECT b.video_id, b.segment, b.k, CASE WHEN x.d >= 24 THEN b.h ELSE f.last END, x.d >= 24, f.n + (x.d >= 24)::INT FROM f JOIN b ON b.video_id = f.video_id AND b.k = f.k + 1, LATERAL (SELECT len(list_filter(range(1, 65), lambda i: b.h[i] <> f.last[i])) AS d) x) "
    "SELECT video_id, segment, accepted, CASE WHEN accepted THEN n END AS sequence_index FROM f"
)
def frame_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Repeats by distance to the last accepted hash."""
    return segmentation.without_repeats(A.hashes(spark, d), "video_id", "segment", 24).select("video_id", "segment", "accepted", "sequence_index")


@query("SELECT vec_id, len(list_filter(range(1, 65), lambda i: (embedding[i] > 0) <> (i % 2 = 0)))::INT AS bits FROM embeddings")
def hash_distance(spark: SparkSession, d: str) -> DataFrame:
    """Of the signs of all 64 components from a hash of which every second bit is set."""
    return A.table(spark, d, "embeddings").select("vec_id", hamming(sign_bits(F.col("embedding")), F.lit(0x5555555555555555).cast("long")).alias("bits"))


@query()
def frame_backstop(spark: SparkSession, d: str) -> DataFrame:
    """Windows by the state machine with the backstop; tests hold it against a plain run."""
    f = A.frames(spark, d).withColumn("cells", F.array(*[(F.col("sharpness") * i % 17).cast("double") for i in range(1, 17)]))
    return segmentation.tracked(f, SHORT, Backstop(start=6, interval=2, seed=3, checks=1))


@query(_with(_CHOSEN, "SELECT video_id, segment::INT AS segment, first_frame, final_frame, frames::INT AS frames, frame_number FROM chosen"))
def frame_tracker(spark: SparkSession, d: str) -> DataFrame:
    """The state machine without the backstop finds the windows that the window functions find."""
    return segmentation.tracked(A.frames(spark, d), SHORT).select("video_id", "segment", "first_frame", "final_frame", "frames", "frame_number")


_BOXES = "boxes AS (SELECT doc_id AS card_id, i::INT AS box_no, ((doc_id % 7) * 3 + i * 60) AS bx1, (i % 2 * 20 + 1) AS by1, ((doc_id % 7) * 3 + i * 60 + 30) AS bx2, (i % 2 * 20 + 13) AS by2 FROM documents, (VALUES (0), (1), (2), (3)) t(i))"
_IOU = "greatest(least(bx2, x2) - greatest(bx1, x1), 0) * greatest(least(by2, y2) - greatest(by1, y1), 0)"


@query(f"WITH words AS ({A.SQL['words']}), {_BOXES}, scored AS (SELECT b.card_id, box_no, word_no, confidence, {_IOU} / ((bx2 - bx1) * (by2 - by1) + (x2 - x1) * (y2 - y1) - {_IOU})::DOUBLE AS iou FROM boxes b JOIN words w ON b.card_id = w.card_id AND x1 < bx2 AND y1 < by2 AND x2 > bx1 AND y2 > by1), best AS (SELECT *, row_number() OVER (PARTITION BY card_id, box_no ORDER BY iou DESC, word_no) AS r FROM scored) SELECT b.card_id, b.box_no, round(iou, 6) AS iou, word_no::INT AS word_no, confidence FROM boxes b LEFT JOIN (SELECT * FROM best WHERE r = 1 AND iou >= 0.3) m ON b.card_id = m.card_id AND b.box_no = m.box_no")
def iou_best_match(spark: SparkSession, d: str) -> DataFrame:
    return words.matched_boxes(A.words(spark, d)).withColumn("iou", F.round("iou", 6))


@query(f"WITH words AS ({A.SQL['words']}), anchor AS (SELECT card_id, arg_min(x2, word_no) AS ax2, arg_min(y1, word_no) AS ay1, arg_min(y2, word_no) AS ay2 FROM words WHERE lower(text) = 'the' GROUP BY card_id) SELECT a.card_id, coalesce(string_agg(text, ' ' ORDER BY x1, word_no), '') AS beside, count(text)::INT AS n_words FROM anchor a LEFT JOIN words w ON a.card_id = w.card_id AND x1 >= ax2 AND x1 <= 1000 AND NOT (y2 < ay1 - 6 OR y1 > ay2 + 6) GROUP BY a.card_id")
def word_band_right_of_anchor(spark: SparkSession, d: str) -> DataFrame:
    return words.beside(A.words(spark, d), "the", margin=6, xmax=1000)


@query(f"WITH words AS ({A.SQL['words']}) SELECT d.doc_id AS card_id, n.text, n.confidence FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY abs((y1 + y2) / 2.0 - 50), word_no) AS r FROM words WHERE abs((y1 + y2) / 2.0 - 50) <= 10) n ON d.doc_id = n.card_id AND r = 1")
def word_nearest_height(spark: SparkSession, d: str) -> DataFrame:
    return words.nearest_to(A.words(spark, d), 50.0, 10)


_GRAY = "g AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(abs(v::DOUBLE) * 200) % 256) AS g FROM embeddings)"
_LAPLACE = "list_transform(range(64), lambda i: g[abs(i // 8 - 1) * 8 + i % 8 + 1] + g[(7 - abs(7 - (i // 8 + 1))) * 8 + i % 8 + 1] + g[i // 8 * 8 + abs(i % 8 - 1) + 1] + g[i // 8 * 8 + (7 - abs(7 - (i % 8 + 1))) + 1] - 4 * g[i + 1])"
_SMALL = "list_transform(range(20), lambda k: round_even((list_sum(list_transform(range(8), lambda i: g[k // 5 * 16 + i + 1] * greatest(least(i + 1.0::DOUBLE, (k % 5 + 1) * 1.6::DOUBLE) - greatest(i::DOUBLE, k % 5 * 1.6::DOUBLE), 0))) / 1.6::DOUBLE + list_sum(list_transform(range(8), lambda i: g[k // 5 * 16 + 8 + i + 1] * greatest(least(i + 1.0::DOUBLE, (k % 5 + 1) * 1.6::DOUBLE) - greatest(i::DOUBLE, k % 5 * 1.6::DOUBLE), 0))) / 1.6::DOUBLE) / 2, 0))"
_HIST = "list_transform(range(16), lambda k: len(list_filter(g, lambda v: least(floor(v / 16), 15) = k))::DOUBLE)"


@query(
    f"WITH {_GRAY}, m AS (SELECT vec_id, label, list_var_pop({_LAPLACE}) AS sharp, {_SMALL} AS s, {_HIST} AS h FROM g), "
    "n AS (SELECT *, list_transform(h, lambda c: c / sqrt(list_sum(list_transform(h, lambda x: x * x)))) AS hn FROM m), p AS (SELECT *, lag(hn) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM n) "
    "SELECT vec_id, round(sharp, 6) AS sharpness, array_to_string(list_transform(range(16), lambda i: (s[i // 4 * 5 + i % 4 + 2] > s[i // 4 * 5 + i % 4 + 1])::INT), '') AS bits, "
    "CASE WHEN b IS NOT NULL THEN round(sqrt(greatest(1 - list_sum(list_transform(list_zip(hn, b), lambda x: sqrt(x[1] * x[2]))) / sqrt(list_sum(hn) * list_sum(b)), 0)), 5) END AS moved FROM p"
)
def pixel_measures(spark: SparkSession, d: str) -> DataFrame:
    """Sharpness, bits of the difference hash, and the distance of histograms from the picture before, of pictures of 8 by 8."""
    e = A.table(spark, d, "embeddings").where("embedding IS NOT NULL").withColumn("g", F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 200).cast("double") % 256))
    e = e.withColumn("px", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("g", y * 8 + 1, 8))).withColumn("h", pixels.histogram(F.col("px"), 16))
    before = F.lag("h").over(Window.partitionBy("label").orderBy("vec_id"))
    bits = F.array_join(F.transform(pixels.difference_bits(F.col("px"), 4), lambda b: b.cast("int")), "")
    return e.withColumn("b", before).select("vec_id", F.round(pixels.sharpness(F.col("px")), 6).alias("sharpness"), bits.alias("bits"), F.round(pixels.histogram_distance(F.col("h"), F.col("b")), 5).alias("moved"))
