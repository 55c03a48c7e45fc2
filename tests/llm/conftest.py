import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with every oddity: nulls, empty and long texts, repeated rows and ids, a null id, and a column with a clashing name."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "one", "en", "a"), (4, "one", None, "a"), (4, "one", None, "a"), (5, "  \n\t ", "en", None),
        (6, "long word list " * 6000, "en", "a"), (7, "a b c\nd e f " + "é😀 ", "fr", "b"), (None, "no id at all", "fr", "b"), (9, "one two three four five six seven", "en", "b"),
        (10, "one two three four five six seven", "en", "b"),
    ]
    df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCS)
    return df.withColumn("path", F.lit(1)).withColumn("key", F.lit("x")).withColumn("rep", F.lit(2.5))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
