"""Comparison of recognition models: accuracy, latency, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import normal_date
from ..functions.numbers import fixed, ratio
from ..functions.text import normal_name
from .review import last_of


def compared(rows: DataFrame) -> DataFrame:
    """Prediction records: normalized truth and prediction, and whether they match. Blank equals blank, and a date that
    can't be read is blank; an error never matches."""
    out = rows
    for side in ("gt", "pred"):
        out = out.withColumn(f"normalized_{side}_name", normal_name(F.col(f"{side}_deceased_name"))).withColumn(f"normalized_{side}_dod", F.coalesce(normal_date(F.col(f"{side}_date_of_death")), F.lit("")))
    sound = F.trim(F.coalesce("error", F.lit(""))) == ""
    out = out.withColumn("name_match", sound & (F.col("normalized_gt_name") == F.col("normalized_pred_name"))).withColumn("dod_match", sound & (F.col("normalized_gt_dod") == F.col("normalized_pred_dod")))
    return out.withColumn("exact_match", F.col("name_match") & F.col("dod_match"))


def adjudicated(predictions: DataFrame, opinions: DataFrame) -> DataFrame:
    """Predictions with a person's opinion in place of the machine's where there is one; of several on one card and
    model that of the greatest ``row`` (its place in the file); without such a column, the last read, which holds straight after a scan."""
    place = "row" if "row" in opinions.columns else F.monotonically_increasing_id().alias("row")
    last = last_of(opinions.select("card_id", "model_id", "human_name_correct", "human_dod_correct", place), ["card_id", "model_id"], "row")
    o = last.select(F.col("card_id").alias("__c"), F.col("model_id").alias("__m"), "human_name_correct", "human_dod_correct")
    out = predictions.join(o, (F.col("card_id") == F.col("__c")) & (F.col("model_id") == F.col("__m")), "left")
    out = out.withColumn("name_match", F.coalesce("human_name_correct", "name_match")).withColumn("dod_match", F.coalesce("human_dod_correct", "dod_match"))
    return out.withColumn("exact_match", F.col("name_match") & F.col("dod_match")).select(predictions.columns)


#: Ranges that a group's values are counted in before a rank is looked for.
RANGES = 256


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """by, and a column of each name in ``shares``: the value at rank share * (n - 1), interpolated between the two ranks beside it.

    Exact, and no group is ever held whole: values are counted in ranges, which a sketch of bounded size lays out; the ranges that
    hold a rank that is asked for are found from these counts; and only their values are counted one by one, equal ones as one.
    Null values don't count; groups without values are left out.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    rows = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("__v"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("__v", [i / ranges for i in range(1, ranges)], 4 * ranges).alias("__cuts"), F.count("*").alias("__n"))
    renamed = cuts.withColumnsRenamed({k: f"{k}r" for k in keys})
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{k}{other}")) for k in keys] or [F.lit(True)]
    placed = rows.join(renamed, same("r")) if keys else rows.crossJoin(F.broadcast(renamed))  # one row
    step = max(1, int(ranges**0.5))  # cuts rise: first among every ``step``-th one, then among those between two of them
    coarse = F.filter(F.transform(F.sequence(F.lit(1), F.lit((ranges - 1) // step)), lambda k: F.get("__cuts", k * step - 1)), lambda c: c < F.col("__v")) if ranges > step else F.array()
    placed = placed.withColumn("__k", F.size(coarse) * step)
    placed = placed.select(*keys, "__v", "__n", (F.col("__k") + F.size(F.filter(F.slice("__cuts", F.col("__k") + 1, F.lit(step)), lambda c: c < F.col("__v")))).alias("__range"))
    counted = placed.groupBy(*keys, "__range").agg(F.count("*").alias("__m"), F.max("__n").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__before", F.coalesce(F.sum("__m").over(order), F.lit(0)))  # at most ``ranges`` rows of a group
    rank = lambda q: F.col("__n").cast("double") * q - F.lit(q)
    asked = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(rank(q)), F.ceil(rank(q))) for q in shares.values()])))
    held = counted.withColumn("__asked", F.filter(asked, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__m")))).where(F.size("__asked") > 0)
    held = held.select(*[F.col(k).alias(f"{k}h") for k in keys], F.col("__range").alias("__rangeh"), "__before", "__asked")
    values = placed.groupBy(*keys, "__range", "__v").agg(F.count("*").alias("__m"), F.max("__n").alias("__n")).join(held, [*same("h"), F.col("__range") == F.col("__rangeh")])
    within = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("__from", F.col("__before") + F.coalesce(F.sum("__m").over(within), F.lit(0)))
    ranked = values.select(*keys, "__v", "__n", F.explode(F.filter("__asked", lambda r: (r >= F.col("__from")) & (r < F.col("__from") + F.col("__m")))).alias("__r"))
    at = lambda r: F.max(F.when(F.col("__r") == r, F.col("__v")))
    low, high, part = {}, {}, {}
    for name, q in shares.items():
        low[name], high[name], part[name] = at(F.floor(rank(q))), at(F.ceil(rank(q))), F.max(rank(q) - F.floor(rank(q)))
    return ranked.groupBy(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)]).agg(*[(low[n] * (1 - part[n]) + high[n] * part[n]).alias(n) for n in shares])


def _measures() -> list[Column]:
    n, right = F.count("*"), lambda c: F.count_if(F.col(c))
    ms, bad = F.col("latency_ms"), F.count_if(F.trim(F.coalesce("error", F.lit(""))) != "")
    return [
        n.alias("total"), right("name_match").alias("name_correct"), right("dod_match").alias("dod_correct"), right("exact_match").alias("exact_correct"),
        ratio(right("name_match"), n).alias("name_accuracy"), ratio(right("dod_match"), n).alias("dod_accuracy"), ratio(right("exact_match"), n).alias("exact_accuracy"),
        bad.alias("errors"), ratio(bad, n).alias("error_rate"), F.avg(ms).alias("latency_avg"), F.min(ms).alias("latency_min"), F.max(ms).alias("latency_max"), F.sum(ms).alias("latency_total"),
    ]


_SHARES = {"latency_p50": 0.5, "latency_p95": 0.95}


def _with_percentiles(sums: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    ranks = ranks.withColumnsRenamed({c: f"__{c}" for c in by})
    return sums.join(ranks, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").drop(*(f"__{c}" for c in by))


def summary(predictions: DataFrame, *by: str) -> DataFrame:
    """Accuracy and latency by model, or by model and bucket. Percentiles are interpolated."""
    return _with_percentiles(predictions.groupBy(*by).agg(*_measures()), percentiles(predictions, list(by), "latency_ms", _SHARES), list(by))


def report(predictions: DataFrame) -> DataFrame:
    """Models and their buckets (null: all of a model's) with all measures and each model's rank: what a report says.

    Both levels come of one pass over the predictions.
    """
    by = ["model_id", "difficulty_bucket"]
    levels = predictions.groupingSets([by[:1], by], *by).agg(*_measures(), F.grouping_id().alias("__level"))
    bucketed = percentiles(predictions, by, "latency_ms", _SHARES).withColumn("__l", F.lit(0))
    whole = percentiles(predictions, by[:1], "latency_ms", _SHARES).withColumns({"difficulty_bucket": F.lit(None).cast("string"), "__l": F.lit(1)})
    ranks = bucketed.unionByName(whole).withColumnsRenamed({c: f"__{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [(F.col("__level") > 0).cast("int") == F.col("__l")]
    out = levels.join(ranks, same, "left").withColumn("level", F.when(F.col("__level") > 0, "model").otherwise("bucket")).drop("__level", "__l", *(f"__{c}" for c in by))
    order = ranking(out.where("level = 'model'")).select(F.col("model_id").alias("__m"), "rank")
    return out.join(order, F.col("model_id").eqNullSafe(F.col("__m"))).drop("__m")


def report_lines(rows: DataFrame, title: str, generated_at: str) -> DataFrame:
    """``report``'s rows as the lines of a Markdown page: (line_no, line)."""
    pct, ms = lambda c: F.concat(fixed(F.col(c) * 100, 2), F.lit("%")), lambda c: fixed(F.col(c), 1)
    model = F.coalesce("model_id", F.lit(""))
    join = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    place = F.format_string("%09d", "rank")
    head = ["# " + title, "", "Generated: " + generated_at, "", "## Ranking", "", "| Rank | Model | Exact | Name | DoD | Errors | Avg RT (ms) | P95 RT (ms) |", "| --- | --- | ---: | ---: | ---: | ---: | ---: | ---: |"]
    between = ["", "## Per-Model Buckets", ""]
    head_lines = rows.sparkSession.createDataFrame([(f"0{i:03d}", t) for i, t in enumerate(head)] + [(f"2{i:03d}", t) for i, t in enumerate(between)], "at string, line string")
    models = rows.where("level = 'model'")
    ranked = models.select(F.concat(F.lit("1"), place).alias("at"), join(F.col("rank").cast("string"), model, pct("exact_accuracy"), pct("name_accuracy"), pct("dod_accuracy"), F.col("errors").cast("string"), ms("latency_avg"), ms("latency_p95")).alias("line"))
    overall = F.concat(
        F.lit("Overall: exact="), pct("exact_accuracy"), F.lit(", name="), pct("name_accuracy"), F.lit(", dod="), pct("dod_accuracy"), F.lit(", errors="), "errors", F.lit("/"), "total", F.lit(" ("), pct("error_rate"),
        F.lit("), roundtrip avg="), ms("latency_avg"), F.lit("ms p50="), ms("latency_p50"), F.lit("ms p95="), ms("latency_p95"), F.lit("ms"),
    )
    parts = F.array(F.concat(F.lit("### "), model), F.lit(""), overall, F.lit(""), F.lit("| Bucket | Exact | Name | DoD | Errors | Error Rate | N |"), F.lit("| --- | ---: | ---: | ---: | ---: | ---: | ---: |"), F.lit(""))
    # of each model: six lines, its buckets, a blank line; the blank one goes after the buckets by its key
    about = models.select(model.alias("m"), F.posexplode(parts).alias("i", "line")).select(F.concat(F.lit("3"), "m", F.lit("\u0001"), F.when(F.col("i") < 6, F.format_string("0%d", "i")).otherwise("2")).alias("at"), "line")
    buckets = rows.where("level = 'bucket'").select(F.concat(F.lit("3"), model, F.lit("\u00011"), F.coalesce("difficulty_bucket", F.lit(""))).alias("at"), join(F.coalesce("difficulty_bucket", F.lit("")), pct("exact_accuracy"), pct("name_accuracy"), pct("dod_accuracy"), F.col("errors").cast("string"), pct("error_rate"), F.col("total").cast("string")).alias("line"))
    every = head_lines.unionByName(ranked).unionByName(about).unionByName(buckets)
    return every.select((F.row_number().over(Window.orderBy("at")) - 1).alias("line_no"), "line")  # a line for each model and bucket


def report_json(rows: DataFrame, generated_at: str, adjudicated: bool) -> DataFrame:
    """``report``'s rows as one nested document (column ``document``): keys sorted, nulls kept, models and buckets in order."""
    kept = sorted(c for c in rows.columns if c not in ("model_id", "difficulty_bucket", "level", "rank"))
    buckets = rows.where("level = 'bucket'").groupBy(F.col("model_id").alias("__m")).agg(F.sort_array(F.collect_list(F.struct("difficulty_bucket", *kept))).alias("by_difficulty"))
    models = rows.where("level = 'model'").join(buckets, F.col("model_id").eqNullSafe(F.col("__m")), "left")
    one = F.struct(*sorted(["by_difficulty", "model_id", *kept]))
    order = F.transform(F.sort_array(F.collect_list(F.struct("rank", *sorted(["dod_accuracy", "errors", "exact_accuracy", "latency_avg", "latency_p95", "model_id", "name_accuracy"])))), lambda r: r.dropFields("rank"))
    document = models.agg(F.sort_array(F.collect_list(F.struct("model_id", one.alias("m")))).alias("ms"), order.alias("ranking"))
    body = F.struct(F.lit(adjudicated).alias("adjudication_applied"), F.lit(generated_at).alias("generated_at"), F.transform("ms", lambda m: m["m"]).alias("models"), "ranking")
    return document.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def two_field_accuracy(rows: DataFrame) -> DataFrame:
    """Of cards with true and read names and dates (gt_ and pred_, compared trimmed): total, shares of right names and dates, and the
    share of cards that have no date and for which none was read."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    name, date = said("gt_deceased_name") == said("pred_deceased_name"), said("gt_date_of_death") == said("pred_date_of_death")
    blank, n = (said("gt_date_of_death") == "") & date, F.count("*")
    return rows.agg(n.alias("total"), ratio(F.count_if(name), n).alias("name_accuracy"), ratio(F.count_if(date), n).alias("dod_accuracy"), ratio(F.count_if(blank), n).alias("dod_blank_ok_rate"))


def summary_levels(predictions: DataFrame) -> DataFrame:
    """Both levels of grouping in one pass; the bucket is null on the level of models."""
    return predictions.groupingSets([["model_id"], ["model_id", "difficulty_bucket"]], "model_id", "difficulty_bucket").agg(F.count("*").alias("total"), F.count_if(F.col("exact_match")).alias("exact_correct"))


def ranking(models: DataFrame) -> DataFrame:
    """Models best first: exact, name, date accuracy, then fewer errors, lower latency, id."""
    order = [F.desc("exact_accuracy"), F.desc("name_accuracy"), F.desc("dod_accuracy"), F.asc("errors"), F.asc_nulls_last("latency_avg"), F.asc("model_id")]
    return models.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a row for each model


def to_adjudicate(predictions: DataFrame) -> DataFrame:
    return predictions.where(~F.col("exact_match"))
