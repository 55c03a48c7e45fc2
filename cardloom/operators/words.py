"""Words with boxes: matches, bands, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.dates import iso_date
from ..functions.geometry import best_match, in_band, nearest_height, right_of, within_reach
from ..functions.page import lines, texts
from ..functions.text import token


def matched_boxes(pages: DataFrame) -> DataFrame:
    """Each box of ``support`` with the page's word that covers it best, if one covers it well enough.

    The boxes and words of a page meet inside its row; nothing is joined across pages.
    """
    near = pages.select("card_id", "support", within_reach(F.col("words"), F.col("support")).alias("near"))  # one pass over a page's words
    out = near.select("card_id", "near", F.posexplode("support").alias("box_no", "box"))
    return out.withColumn("m", best_match(F.col("box"), F.col("near"))).select("card_id", "box_no", F.col("m.iou").alias("iou"), F.col("m.at").alias("word_no"), F.col("m.confidence").alias("confidence"))


def support_confidence(pages: DataFrame) -> DataFrame:
    """Mean confidence of the words whose boxes are exactly those of ``support``; the last of equal boxes counts."""
    box = F.explode("support").alias("box")
    same = F.filter("words", lambda w: w["bbox"] == F.col("box"))
    return pages.select("card_id", "words", box).withColumn("c", F.try_element_at(same, F.lit(-1))["confidence"]).groupBy("card_id").agg(F.avg("c").alias("confidence"))


def beside(pages: DataFrame, label: str, margin: int = 6, xmax: int = 1_000_000) -> DataFrame:
    """card_id and the words right of the first word that is ``label``, in its band of heights, joined by spaces."""
    anchor = F.try_element_at(F.filter("words", lambda w: F.lower(w["text"]) == label), F.lit(1))
    out = pages.withColumn("anchor", anchor).where("anchor is not null")
    found = right_of(F.col("words"), F.col("anchor.bbox"), margin, xmax)
    return out.select("card_id", F.array_join(F.transform(found, lambda w: w["text"]), " ").alias("beside"), F.size(found).alias("n_words"))


def nearest_to(pages: DataFrame, y: float, most: int) -> DataFrame:
    w = nearest_height(F.col("words"), F.lit(y), most)
    return pages.select("card_id", w["text"].alias("text"), w["confidence"].alias("confidence"))


def clustered_lines(pages: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """(card_id, line_no, text): words by height, each joining the first line whose mean height is near enough."""
    return pages.select("card_id", F.posexplode(texts(lines(F.col("words"), tolerance))).alias("line_no", "text"))


def date_of_death(words: Column, slack: int = 18, gap: int = 4) -> Column:
    """ISO date from a page's words: those right of the surest word that names the death, in its band of heights, up to a word
    that names burial or birth. Of equally sure words one that is ``death`` itself behind an ``of`` counts before one that is it, and
    that before one that only holds it, as a name may; then the first."""

    def read(anchor: Column) -> Column:
        right = F.filter(in_band(words, anchor[1] - slack, anchor[3] + slack), lambda w: w["bbox"][0] >= anchor[2] + gap)
        other = lambda w: token(w["text"]).rlike("burial|birth|^dob$")
        end = lambda r: F.array_position(F.transform(r, other), F.lit(True)).cast("int")
        near = let(right, lambda r: F.slice(r, 1, F.when(end(r) > 0, end(r) - 1).otherwise(F.size(r))))
        return iso_date(F.array_join(F.transform(near, lambda w: w["text"]), " "))

    def placed(w: Column, i: Column) -> Column:
        behind = F.when(i > 0, token(F.get(words, i - 1)["text"])) == "of"
        own = F.when(token(w["text"]) != "death", 0).when(F.coalesce(behind, F.lit(False)), 2).otherwise(1)
        return F.when(F.contains(token(w["text"]), F.lit("death")), F.struct(w["confidence"].alias("c"), own.alias("own"), (-i).alias("i"), w["bbox"].alias("bbox")))

    surest = F.array_max(F.transform(words, placed))  # skips nulls
    return let(surest["bbox"], read)
