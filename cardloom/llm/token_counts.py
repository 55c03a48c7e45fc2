"""Token counts with a digest cache.

Each text is known by the digest of its normalised content and the digest of the tokenizer file. Stored counts are
joined to these; only distinct texts without a stored count are encoded, and their counts are appended to the cache.

Normalisation must not change a count, so it only maps null to the empty text: byte-level vocabularies tell apart
everything else.

Cases: texts of any length are encoded whole; null texts count as empty (0 tokens); null ids, repeated ids and repeated rows each keep their own row; an
empty table gives an empty result and appends nothing; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .tokenizer import encoder, version_digest

CACHE_SCHEMA = "content_digest binary, version string, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``cache_path`` is a folder of Parquet files with CACHE_SCHEMA, made on first use; it may be kept and shared between runs, as
    runs that append a count twice append the same. Digests come first: only if some aren't stored are texts looked at again,
    and only texts with such digests cross the network, of copies that one task holds the first; a digest with a
    third of all rows is therefore met by a partial aggregate, and its light rows by a join that adaptive execution splits.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("content_digest")
    light = cut(docs.select(F.col(id_col).alias("doc_id"), digest, F.octet_length(text).cast("long").alias("n_bytes")), "count-digests")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)  # so that the folder can be read
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).select("content_digest")
    wanted = cut(light.select("content_digest").distinct().join(stored, "content_digest", "left_anti"), "count-misses")
    missing = docs.select(digest, text.alias("text")).join(wanted, "content_digest", "left_semi").dropDuplicates(["content_digest"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(tokenizer_path).ids
        for b in batches:
            yield pd.DataFrame({"content_digest": b["content_digest"], "version": version, "n_tokens": [len(ids(t)) for t in b["text"]]})

    if not wanted.isEmpty():
        missing.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return light.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
