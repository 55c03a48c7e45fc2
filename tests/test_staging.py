"""Two-phase tables, partitions, logs, outcomes and routing, each with a run that fails or is repeated."""

import json

import pytest
from cardloom.operators import outcome
from cardloom.sources import connectors, staging
from cardloom.sources.files import table_checksum
from cardloom.streaming import logs
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = spark.range(100).withColumn("v", F.col("id") * 2)
    assert staging.replace_table(first, path) == table_checksum(first)
    second = spark.read.parquet(path).where("id < 40").withColumn("v", F.lit(7).cast("long"))  # made of the table it replaces
    broken = second.withColumn("v", F.when(F.col("id") == 39, F.raise_error(F.lit("torn"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="torn"):
        staging.replace_table(broken, path)

    def refuse(df):
        raise ValueError(f"{df.count()} rows are too few")

    with pytest.raises(ValueError, match="40 rows are too few"):
        staging.replace_table(second, path, refuse)
    assert rows(spark.read.parquet(path)) == rows(first) and [p.name for p in tmp_path.iterdir()] == ["t"]
    staging.replace_table(second, path)
    assert rows(spark.read.parquet(path)) == [(i, 7) for i in range(40)] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_swap_that_fails_puts_the_old_table_back(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    staging.replace_table(spark.range(3), path)
    with pytest.raises(Exception):  # noqa: B017  the file system's own
        staging.swapped(spark, f"file://{tmp_path}/nowhere", path)
    assert spark.read.parquet(path).count() == 3


def test_partitions_of_worked_keys_only(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    all_ = spark.range(30).select((F.col("id") % 3).alias("video"), F.col("id").alias("frame"))
    staging.overwrite_partitions(all_, path, "video")
    new = spark.createDataFrame([(1, 100)], "video long, frame long")
    for _ in range(2):  # a repeated run changes nothing
        staging.overwrite_partitions(new, path, "video", spark.createDataFrame([(1,), (2,), (9,)], "video long"))
        assert rows(spark.read.parquet(path).select("video", "frame")) == [(0, i) for i in range(0, 30, 3)] + [(1, 100)]


def test_a_replayed_batch_appends_nothing(spark, tmp_path):
    path, kind = f"file://{tmp_path}/log", "decision string"
    one, two = (spark.createDataFrame([(x,)] * n, kind) for x, n in (("accepted", 3), ("rejected_blur", 2)))
    assert logs.append_batch(one, 0, path) and not logs.append_batch(one, 0, path)
    got, at = logs.log_from(spark, path, kind)
    assert got.count() == 3 and at == 0
    two.write.parquet(f"{path}/batch=1")
    (tmp_path / "log/batch=1/_SUCCESS").unlink()  # a batch that was left unfinished isn't read, and is written anew
    assert logs.log_from(spark, path, kind, at)[0].count() == 0
    assert logs.append_batch(two, 1, path)
    got, at = logs.log_from(spark, path, kind, at)
    assert [r["decision"] for r in got.collect()] == ["rejected_blur"] * 2 and at == 1
    assert logs.log_from(spark, path, kind, at)[1] == 1 and logs.log_from(spark, f"{path}x", kind)[0].count() == 0


def test_a_stream_into_a_log_with_its_progress(spark, tmp_path):
    progress = logs.Progress()
    spark.streams.addListener(progress)
    path, kind = f"file://{tmp_path}/log", "decision string"
    try:
        for n in (2, 3):
            spark.createDataFrame([("accepted",)] * n, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
            logs.appended(stream, path, f"{tmp_path}/state").queryName("to_log").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        got = progress.table(spark).collect()
    finally:
        spark.streams.removeListener(progress)
    assert logs.log_from(spark, path, kind)[0].groupBy("batch").count().orderBy("batch").collect() == [(0, 2), (1, 3)]
    assert sum(r["rows"] for r in got if r["rows"]) == 5 and sum(r["ended"] for r in got) == 2 and all(r["error"] is None for r in got)
    assert len(logs.Progress(limit=2)._rows) == 0


def results(spark, *errors):
    return spark.createDataFrame([(k + 1, e) for k, e in enumerate(errors)], "sequence_index int, error string")


@pytest.mark.parametrize("errors, said", [((None, " "), None), ((None, "b", "c"), "recognition failed for 2 of 3 cards"), (("x", "y"), "recognition failed for all 2 cards, for example: x")])
def test_a_batch_is_judged_by_the_pass_that_writes_it(spark, tmp_path, errors, said):
    df, seen = outcome.watched(results(spark, *errors))
    df.write.parquet(str(tmp_path / "out"))
    if said is None:
        assert outcome.required(seen)["cards"] == len(errors)
    else:
        with pytest.raises(outcome.BatchFailed, match=said):
            outcome.required(seen)
    rows_ = outcome.outcomes(results(spark, *errors).withColumn("video_id", F.lit("v")), "video_id").collect()
    assert [(r["message"], r["status"]) for r in rows_] == [(said, "failed" if said else "completed")]


def test_a_batch_without_cards_is_fine(spark, tmp_path):
    df, seen = outcome.watched(spark.createDataFrame([], "sequence_index int, error string"))
    df.write.parquet(str(tmp_path / "out"))
    assert outcome.required(seen)["cards"] == 0


def makers(folder):
    """Models that note when they are made; local, so that they travel to the workers by value."""
    import os
    import uuid

    def maker(name, give):
        class Fake:
            def __init__(self):
                open(f"{folder}/{name}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
                self.tries = 0
                if give is None:
                    raise RuntimeError("no key")

            def answer(self, image):
                self.tries += 1
                return give(image, self.tries)

        return Fake

    def flaky(image, n):
        if n % 2:
            raise connectors.TransientError("busy")
        return {"deceased_name": image.decode().upper(), "date_of_death": None}

    def picky(image, n):
        if image == b"b":
            raise ValueError("unreadable")
        return {"deceased_name": " x ", "date_of_death": "d", "usage": {"z": 1, "a": 2}} if image == b"a" else {"deceased_name": 5, "date_of_death": ""} if image == b"c" else "text"

    return {"flaky": maker("flaky", flaky), "picky": maker("picky", picky), "dead": maker("dead", None)}


def test_rows_go_to_the_model_they_name(spark, tmp_path):
    cards = spark.createDataFrame([(k, c.encode()) for k, c in enumerate("abcd")], "card_id long, content binary")
    models = spark.createDataFrame([(m,) for m in ("flaky", "picky", "dead", "unknown")], "model_id string")
    asked = cards.crossJoin(F.broadcast(models)).coalesce(1)  # four models
    got = {(r["model_id"], r["card_id"]): r for r in connectors.routed(asked, makers(str(tmp_path)), backoff=0.0).collect()}
    assert len(got) == 16 and all(r["latency_ms"] >= 0 for r in got.values())
    assert [got["flaky", k]["deceased_name"] for k in range(4)] == list("ABCD") and all(got["flaky", k]["error"] is None for k in range(4))
    assert got["picky", 0]["deceased_name"] == "x" and json.loads(got["picky", 0]["usage_json"]) == {"a": 2, "z": 1} and got["picky", 0]["usage_json"].startswith('{"a"')
    assert [got["picky", k]["error"] for k in (1, 2, 3)] == ["unreadable", "the answer has int where a text belongs", "the answer is str, not fields"]
    assert {got["dead", k]["error"] for k in range(4)} == {"no key"} and {got["unknown", k]["error"] for k in range(4)} == {"no model is named unknown"}
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["dead", "flaky", "picky"]  # each made once in the task
