"""A corpus pipeline of five operators: toxic documents go, one of each near-duplicate group stays, personal data is
blanked, sources are mixed to their weights, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import mixing, near_dedup, packing, pii, toxicity
from cardloom.llm.queries import tokenizer_file
from cardloom.llm.shared import fold, give_back, table, table_path

#: Folds of labels, of which the first is never learnt from.
FOLDS = 5
#: Words of a shingle, and percent of similarity, of near duplicates.
SHINGLE, SIMILAR = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half. A null or empty text is no reason to go; equal rows go or stay together; an empty table gives an empty one."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), FOLDS) != 0)
    model, read = toxicity.fitted(docs, labels)
    out = toxicity.flagged(read, model, "__toxic").where("__toxic = 0").drop("__toxic")
    del model
    give_back()
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, told apart by whole rows: that of the smallest id, on ties of ids the first by the rest of the row; of
    rows equal in all columns one. Documents without words stay; an empty table gives an empty one."""
    return near_dedup.one_of_each(docs, SHINGLE, SIMILAR)


def blank_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets, and n_chars to match."""
    out = pii.blanked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; documents that it doesn't take go. Documents without words
    aren't taken; equal rows are taken together; a source's words may thus miss its target by half of a document for each document at most;
    an empty table gives an empty one."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of at most 1024 tokens. Null texts are the end token alone; repeated rows are packed
    each; equal lengths keep their order; an empty table gives no pieces."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), limit=1024, end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", blank_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The scores of stage one and the token ids of stage five are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = table_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
