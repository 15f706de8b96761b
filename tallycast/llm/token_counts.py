"""Token counts from a digest cache.

The cache is an append-only table (content, tokenizer, n_tokens): digests of the content and of
the tokenizer's version. A run joins the digests of its texts to the cache, encodes each
distinct missing text once, appends the counts, and joins them back to every row. What is kept of
the cache is as large as the run's own distinct texts, and a small batch is broadcast to the scan
of the cache, which then is not shuffled.

Normalisation must not change a count, so only null becomes the empty text. Defined cases: null
and empty texts count 0 tokens; a text of any length is encoded whole; repeated rows and equal
texts are counted once and reported each; null ids are passed through; an empty table gives no
rows and appends nothing; other columns are ignored; a cache that two runs filled at once may hold a
key twice and is read as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm.content import digest, one_text_each
from tallycast.llm.shared import scratch_path, small_batches, stage
from tallycast.llm.tokens import BYTE_BPE, encoder, version

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``, empty if nothing was ever appended."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def encode_counts(texts: DataFrame, name: str) -> DataFrame:
    """(content, text) to (content, n_tokens)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for batch in batches:
            n = [len(enc.ids(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())],
                                             names=["content", "n_tokens"])
    return texts.mapInArrow(count, "content string, n_tokens long")


def token_counts(docs: DataFrame, cache_path: str, name: str = BYTE_BPE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``content`` (digest), ``n_tokens``.

    Encodes and appends what the cache lacks before it returns. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("body"),
                        digest(F.col(text_col)).alias("content"))
    tokenizer = version(name)
    asked = stage(keyed.select("content").distinct(), "asked")
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == tokenizer)
    hits = stage(known.join(asked, "content", "left_semi")
                 .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "hits")
    missing = stage(asked.join(hits, "content", "left_anti"), "misses")
    counted = stage(encode_counts(one_text_each(keyed, missing, "content", "body"), name), "counted")
    counted.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode(
        "append").parquet(cache_path)

    # one staged table, since Spark splits a crowded key only in a join of two plain shuffles
    counts = stage(hits.unionByName(counted), "counts")
    rows = docs.select(F.col(id_col).alias(id_col),
                       F.octet_length(text).cast("long").alias("n_bytes"),
                       digest(F.col(text_col)).alias("content"))
    # one row per text on the right; a text with many rows is split by the adaptive skew join
    return rows.join(counts, "content", "left").select(id_col, "n_bytes", "content", "n_tokens")


def report(docs: DataFrame, limit: int = 512) -> DataFrame:
    """Counts of all rows, starting from an empty cache in the shared folder."""
    counted = token_counts(docs, scratch_path(docs.sparkSession, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
