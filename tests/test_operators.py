"""Operators, files and streams on small tables."""

import random

import pytest
from cardloom import schemas
from cardloom.operators import evaluation, review, segmentation, words
from cardloom.params import Backstop, Segmentation
from cardloom.sources import connectors, files
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sequence(seed, n=300):
    """Motion that rises and falls in runs, with values on both sides of the thresholds."""
    r, out, calm = random.Random(seed), [], True
    while len(out) < n:
        out += [round(r.uniform(0, 7) if calm else r.uniform(5, 20), 3) for _ in range(r.randint(1, 25))]
        calm = not calm
    return out[:n]


def frame_rows(spark, videos):
    return spark.createDataFrame([(v, i + 1, m, float((i * 37) % 91), (i * 2654435761 * (v + 1)) % 2**40) for v, s in enumerate(videos) for i, m in enumerate(s)], "video_id long, frame_number int, motion double, sharpness double, hash long")


def test_windows_and_state_machine_agree(spark):
    f = frame_rows(spark, [sequence(s) for s in range(12)])
    cols = ["video_id", "segment", "first_frame", "final_frame", "frames", "eof", "fallback", "frame_number", "local_motion", "sharpness"]
    for p in (Segmentation(), Segmentation(candidate_motion=0.8, exit_frames=3, min_frames=4)):
        a = sorted(map(str, segmentation.candidates(f, p).select(*[F.col(c).cast("string") for c in cols]).collect()))
        b = sorted(map(str, segmentation.tracked(f, p).select(*[F.col(c).cast("string") for c in cols]).collect()))
        assert a == b and len(a) > 10


def test_decisions_number_what_they_accept(spark):
    rows = segmentation.decisions(frame_rows(spark, [sequence(s) for s in range(6)]), Segmentation(blur=5.0)).collect()
    for v in {r["video_id"] for r in rows}:
        taken = sorted((r["segment"], r["sequence_index"]) for r in rows if r["video_id"] == v and r["decision"] == "accepted")
        assert [n for _, n in taken] == list(range(1, len(taken) + 1))
    assert {r["decision"] for r in rows} >= {"accepted", "rejected_short_stable"}
    assert all(r["needs_review"] == (r["extraction_confidence"] == "low") for r in rows)


def test_backstop_splits_a_silent_change(spark):
    still = [20.0, 20.0] + [1.0] * 60
    change = lambda i: [0.0] * 16 if i < 34 else [100.0] * 16
    df = spark.createDataFrame([(1, i, m, 60.0, change(i)) for i, m in enumerate(still)], "video_id long, frame_number int, motion double, sharpness double, cells array<double>")
    assert segmentation.tracked(df.drop("cells")).count() == 1
    assert segmentation.tracked(df, backstop=Backstop()).count() == 2
    flicker = df.withColumn("cells", F.transform("cells", lambda c: c * 0 + F.col("frame_number") % 2))
    assert segmentation.tracked(flicker, backstop=Backstop()).count() == 1


def test_updates_of_one_version_let_one_win(spark):
    now = spark.createDataFrame([(1, "pending", 0, "A", None), (2, "pending", 3, "B", None)], "card_id long, review_status string, review_version int, deceased_name string, reviewed_by string")
    ups = spark.createDataFrame([(1, 0, True, "C", "u", 5, 1), (1, 0, False, None, "v", 5, 2), (2, 1, True, "D", "u", 1, 3), (9, 0, False, None, "u", 1, 4)], "card_id long, review_version int, edited boolean, deceased_name string, reviewed_by string, submitted_at long, update_id long")
    after, lost = review.apply_reviews(now, ups)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "corrected", 1, "C", "u"), (2, "pending", 3, "B", None)]
    assert sorted(r["update_id"] for r in lost.collect()) == [2, 3, 4]


def test_listing_defaults(spark):
    assert review.statuses(" A, ,b,") == ["a", "b"] and review.statuses(None) == []
    df = spark.range(0).select(F.col("id").alias("card_id"))
    assert tuple(review.page_counts(df, 50).first()) == (0, 1)


def test_lines_come_back(spark):
    text = ["one two three", "four five", "six"]
    ws = [(w, 90, [x * 60, y * 20 + (x % 3), x * 60 + 50, y * 20 + 12 + (x % 3)]) for y, line in enumerate(text) for x, w in enumerate(line.split())]
    df = spark.createDataFrame([(1, ws)], "card_id long, words array<struct<text:string,confidence:int,bbox:array<int>>>")
    assert [r["text"] for r in words.clustered_lines(df, 8).orderBy("line_no").collect()] == text


def test_support_takes_the_last_of_equal_boxes(spark):
    ws = [("a", 10, [0, 0, 1, 1]), ("b", 30, [0, 0, 1, 1]), ("c", 50, [5, 5, 6, 6])]
    df = spark.createDataFrame([(1, ws, [[0, 0, 1, 1], [5, 5, 6, 6], [9, 9, 9, 9]])], "card_id long, words array<struct<text:string,confidence:int,bbox:array<int>>>, support array<array<int>>")
    assert words.support_confidence(df).first()["confidence"] == 40.0


def test_files(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"decision": "accepted", "video_id": "v", "frame_number": 3}\n\nnot json\n{"decision": "rejected_blur", "sharpness": 2.5}\n')
    assert sorted(r["decision"] for r in files.read_decisions(spark, str(log)).collect()) == ["accepted", "rejected_blur"]
    assert files.read_manifest_json(spark, str(tmp_path / "none.json"), T.StructType([T.StructField("video_id", T.StringType())])).count() == 0
    good = tmp_path / "m.csv"
    good.write_text("card_id,image_path,difficulty_bucket,deceased_name,date_of_death\n 1 ,a.jpg,easy,  PARKS,  10/30/2021\n")
    assert tuple(files.read_manifest_csv(spark, str(good)).first()) == ("1", "a.jpg", "easy", "PARKS", "2021-10-30")
    bad = tmp_path / "b.csv"
    bad.write_text("card_id,image_path\n1,a\n")
    with pytest.raises(ValueError, match="difficulty_bucket"):
        files.read_manifest_csv(spark, str(bad))


def test_predictions_round_trip(spark, tmp_path):
    row = {c: "x,\"y\"\nz" for c in files.PREDICTIONS.fieldNames()} | {"latency_ms": 12.34567, "name_match": True, "dod_match": False, "exact_match": False, "error": None}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'double' if c == 'latency_ms' else 'boolean' if c.endswith('_match') else 'string'}" for c in row))
    files.write_predictions(df, str(tmp_path / "p"))
    got = files.read_predictions(spark, str(tmp_path / "p")).first().asDict()
    assert got == row | {"latency_ms": 12.346}


def test_backups(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    files.write_backup(df, str(tmp_path), "s1")
    assert files.read_backup(spark, str(tmp_path), "s1").count() == 50
    spark.range(3).withColumn("x", F.col("id")).write.mode("append").parquet(str(tmp_path / "s1/data"))
    with pytest.raises(ValueError, match="checksum"):
        files.read_backup(spark, str(tmp_path), "s1")


def test_evolution_and_uniqueness(spark):
    old = spark.createDataFrame([("c1", "t", 0.5)], "card_id string, raw_text string, confidence_score double")
    new = schemas.evolved(old, schemas.RESULTS, {"review_version": 0})
    assert new.columns == schemas.RESULTS.fieldNames() and new.first()["review_version"] == 0
    assert schemas.violations(old.union(old), "card_id").count() == 1


def maker(*fails):
    """Makes engines; local, so that it travels to the workers by value."""

    class Fake:
        def __init__(self):
            self.tries = {}

        def read(self, image):
            self.tries[image] = self.tries.get(image, 0) + 1
            if image == b"slow" and self.tries[image] < 3:
                raise connectors.TransientError("busy")
            if image in fails:
                raise RuntimeError("unreadable")
            return image.decode().upper(), 0.9

    return Fake


def test_connectors_keep_errors_in_their_rows(spark):
    df = spark.createDataFrame([("1", b"ok"), ("2", b"slow"), ("3", b"bad")], "card_id string, content binary")
    got = {r["card_id"]: (r["raw_text"], r["error"]) for r in connectors.recognized(df, maker(b"bad"), backoff=0.0).collect()}
    assert got == {"1": ("OK", None), "2": ("SLOW", None), "3": (None, "unreadable")}
    again = {r["card_id"]: r["error"] for r in connectors.with_fallback(df, maker(b"bad"), maker(), backoff=0.0).collect()}
    assert again == {"1": None, "2": None, "3": None}
    out = connectors.recognized(df, maker(b"bad"), backoff=0.0).withColumn("sequence_index", F.col("card_id").cast("int"))
    assert tuple(connectors.batch_outcome(out).first()) == (2, 1, "unreadable")


def test_first_frames_without_motion_are_neither_high_nor_low(spark):
    f = spark.createDataFrame([(1, 1, None), (1, 2, 20.0), (1, 3, 20.0), (1, 4, 1.0)], "video_id long, frame_number int, motion double")
    got = [(r["high_streak"], r["low_streak"]) for r in segmentation.streaks(f).orderBy("frame_number").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (0, 1)]


def test_blurry_windows_need_review(spark):
    found = spark.createDataFrame([(1, 30, False, False, 5, 10.0), (2, 30, False, False, 5, 90.0)], "segment int, frames int, eof boolean, fallback boolean, frame_number int, sharpness double")
    got = {r["segment"]: (r["decision"], r["needs_review"]) for r in segmentation.judged(found).collect()}
    assert got == {1: ("rejected_blur", True), 2: (None, False)}


def test_the_last_opinion_counts_and_blank_errors_are_none(spark):
    p = spark.createDataFrame([("c", "m", False, False, False, 1.0, " ")], "card_id string, model_id string, name_match boolean, dod_match boolean, exact_match boolean, latency_ms double, error string")
    o = spark.createDataFrame([("c", "m", False, True), ("c", "m", True, None)], "card_id string, model_id string, human_name_correct boolean, human_dod_correct boolean").coalesce(1)
    rows = evaluation.adjudicated(p, o).collect()
    assert [(r["name_match"], r["dod_match"]) for r in rows] == [(True, False)]
    assert evaluation.summary(p, "model_id").first()["errors"] == 0


def test_dates_that_cannot_be_read_are_blank(spark):
    df = spark.createDataFrame([("a", "a", "unknown", "??", None)], "gt_deceased_name string, pred_deceased_name string, gt_date_of_death string, pred_date_of_death string, error string")
    r = evaluation.compared(df).first()
    assert (r["normalized_gt_dod"], r["normalized_pred_dod"], r["dod_match"]) == ("", "", True)


def test_a_backslash_in_a_search_stands_for_itself(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",), ("a\\xb",)], "deceased_name string")
    assert sorted(r[0] for r in review.matching(df, q="A\\_b").collect()) == ["a\\xb"]
    assert sorted(r[0] for r in review.matching(df, q="\\b").collect()) == ["a\\b"]


def test_states_of_jobs_from_events(spark):
    jobs = spark.createDataFrame([(k,) for k in range(5)], "job_id long")
    rows = [
        (0, 1, 1, "running", None, None), (0, 2, 2, "progress", 140, None), (1, 1, 1, "running", None, None), (1, 5, 2, "completed", None, None), (1, 3, 3, "progress", 40, None),
        (2, 1, 1, "running", None, None), (2, 2, 2, "failed", None, "first"), (2, 2, 3, "failed", None, "second"), (3, 1, 1, "noise", 7, None), (9, 1, 1, "running", None, None),
    ]
    events = spark.createDataFrame(rows, "job_id long, at long, seq long, kind string, progress int, message string")
    got = [tuple(r)[1:] for r in review.job_states(jobs, events).orderBy("job_id").collect()]
    assert got == [("running", 100, 1, None, None), ("completed", 100, 1, 5, None), ("failed", 0, 1, 2, "second"), ("queued", 0, None, None, None), ("queued", 0, None, None, None)]


def test_a_row_that_is_not_there_is_an_error(spark):
    assert review.one(spark.range(3), "id", 2).first()["id"] == 2
    with pytest.raises(LookupError, match="no row has id 7"):
        review.one(spark.range(3), "id", 7)


def test_tables_are_loaded_in_their_present_schemas(spark, tmp_path):
    spark.createDataFrame([("v1", "a.mp4")], "id string, filename string").write.parquet(str(tmp_path / "videos"))
    spark.createDataFrame([("j1", "v1", "running")], "id string, video_id string, status string").write.parquet(str(tmp_path / "jobs"))
    spark.createDataFrame([("c1", "v1", 1)], "id string, video_id string, sequence_index int").write.parquet(str(tmp_path / "cards"))
    spark.createDataFrame([("r1", "c1")], "id string, card_id string").write.parquet(str(tmp_path / "ocr_results"))
    spark.createDataFrame([("r2", "c2", 3)], "id string, card_id string, review_version int").write.mode("append").parquet(str(tmp_path / "ocr_results"))
    got = schemas.loaded(spark, str(tmp_path))
    assert {k: v.columns for k, v in got.items()} == {k: s.fieldNames() for k, (s, _) in schemas.TABLES.items()}
    assert [tuple(r) for r in spark.sql("SELECT r.id, r.review_version, r.review_status, v.status FROM ocr_results r LEFT JOIN cards c ON c.id = r.card_id LEFT JOIN videos v ON v.id = c.video_id ORDER BY 1").collect()] == [("r1", 0, "pending", "uploaded"), ("r2", 3, "pending", None)]


def test_images_are_read_for_engines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/card_1.JPG.jpg").write_bytes(b"one")
    (tmp_path / "card_2.png").write_bytes(b"two")
    (tmp_path / "notes.txt").write_text("no image")
    assert sorted((r["card_id"], bytes(r["content"])) for r in files.read_images(spark, str(tmp_path)).collect()) == [("card_1.JPG", b"one"), ("card_2", b"two")]
