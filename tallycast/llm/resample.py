"""Resampling of documents towards a target collection by hashed word runs.

Every text is an array of buckets: the runs of one to three consecutive words, hashed. Counts of
both collections give each bucket a gain, an array of fixed length that travels with the scoring
tasks; a document's weight is the sum of the gains at its buckets, and seeded Gumbel noise makes
the highest scores a draw without replacement in proportion to the exponential of the weights.

Ranks come from parallel sorting by regular sampling. Each task sorts its scores and writes them
as a run; every ``step``-th key of every run is a sample, and every so many samples make a
splitter, so a segment exceeds its share by at most one step per run, whatever the scores are.
Rows learn their segment from the splitters, prefix sums of the segments' counts give each
segment the rank it begins with, and only segments that begin within the draw are exchanged and
merged. The rest of the table is told apart by the last drawn key and never moves.

The driver sees one number per bucket, at most ``SAMPLES`` + one sample per run, one count per
segment, and the last drawn key.

Defined cases: a null or empty text, or one without words, has no features and weight 0; a text
of any length is read whole; scores that tie are ordered by the smaller id, a null id first, and
rows that share score and id by their place in the table, so a draw has exactly its size; a null
id draws the noise of the empty string; without target words every gain follows from the source
alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.shared import small_batches, stage

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 10_000
LONGEST = 3  # words of a feature
SEED = 42
MIN_WORDS = 20
SHARE = (5, 100)
SAMPLES = 50_000
# segments for each shuffle partition, so that hashing them over tasks evens out
SEGMENTS_PER_TASK = 4
_PLACE = (1 << 33) - 1  # monotonically_increasing_id: place within its partition


def features(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of every feature; the CRC of a run continues that of the
    run one word shorter."""
    words = WORD.findall(text.lower())
    spaced = [b" " + w for w in words]
    codes = last = list(map(crc32, words))
    for n in range(1, LONGEST):
        last = list(map(crc32, spaced[n:], last))
        codes = codes + last
    return len(words), np.array(codes, np.int64) % buckets


def _body(text_col: str):
    return F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body")


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows: an array of ``buckets`` numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(features(text, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])],
                                         names=["bucket", "n"])

    small_batches(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    counted = texts.select(_body(text_col)).mapInArrow(count, "bucket long, n long")
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to source, rounded down."""
    size = len(source)
    all_source, all_target = int(source.sum()) + size, int(target.sum()) + size
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int = SEED):
    """Thousandths of a Gumbel variate that depends on seed and id alone, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
           seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight and score of every row."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(words, len(found), int(gain[found].sum())) for words, found in (
                features(text, len(gain)) for text in batch.column(1).to_pylist())]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                             names=["id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [
        T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    weighed = docs.select(F.col(f"`{id_col}`").alias("id"), _body(text_col)).mapInArrow(weigh, schema)
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def _key(score, doc_id, row) -> tuple:
    """Python's counterpart of the order by score downwards, id (null first) and row."""
    return -score, doc_id is not None, doc_id if doc_id is not None else 0, row


def top_ranks(rows: DataFrame, wanted: int, total: int) -> DataFrame:
    """The ``wanted`` first of ``total`` rows (id, score, row and others) with their ``rank``."""
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("row").asc()]
    runs = stage(rows.sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))), "runs")

    step = max(1, total // SAMPLES)
    samples = sorted(_key(*r) for r in runs.where(F.col("place") % step == step // 2)
                     .select("score", "id", "row").collect())
    segments = SEGMENTS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = [samples[i * len(samples) // segments] for i in range(1, segments)] if samples else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("score", "id", "row")))
            found = pa.array([bisect_right(splitters, _key(*k)) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, found],
                                             names=[*batch.schema.names, "segment"])

    runs = runs.drop("place")
    dealt = runs.mapInArrow(place, T.StructType([*runs.schema.fields,
                                                 T.StructField("segment", T.IntegerType())]))
    counts = dict(dealt.groupBy("segment").count().collect())
    begins, before = [], 0
    for segment in range(len(splitters) + 1):
        if before >= wanted:
            break
        begins.append((segment, before))
        before += counts.get(segment, 0)
    offsets = spark.createDataFrame(begins, "segment int, before long")
    inside = Window.partitionBy("segment").orderBy(*order)
    return (dealt.where(F.col("segment") <= begins[-1][0])
            .withColumn("place", F.row_number().over(inside))
            .join(F.broadcast(offsets), "segment")
            .withColumn("rank", F.col("before") + F.col("place"))
            .where(F.col("rank") <= wanted).select(*runs.columns, "rank"))


def draw(rows: DataFrame, min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """``scored`` rows with ``rank``: 1, 2, 3... for the drawn share of the rows that have at
    least ``min_words`` words, null for all others."""
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= min_words
    total = rows.where(able).count()
    wanted = share[0] * total // share[1]
    if not wanted:
        return rows.drop("row").withColumn("rank", F.lit(None).cast("long"))
    first = stage(top_ranks(rows.where(able), wanted, total), "drawn")
    last = first.where(F.col("rank") == wanted).first()
    after = F.struct((-F.col("score")).alias("a"), F.col("id").alias("b"), F.col("row").alias("c")) > (
        F.struct(F.lit(-last["score"]).cast("long").alias("a"),
                 F.lit(last["id"]).cast(rows.schema["id"].dataType).alias("b"),
                 F.lit(last["row"]).cast("long").alias("c")))
    rest = rows.where(~able | after).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).drop("row")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", buckets: int = BUCKETS, seed: int = SEED,
             min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every row of ``docs``."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets))
    return draw(scored(docs, gain, id_col, text_col, seed), min_words, share)


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight",
                                         "score", "rank")


# The CRC of a feature walks its bytes, two hexadecimal digits at a time.
_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
_SQL_RUNS = """SELECT {key}, unnest(list_concat(w,
    list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM {table}"""
SQL = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
items AS (SELECT 0 AS doc_id, {_SQL_WORDS} AS w FROM benchmark),
own AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM ({_SQL_RUNS.format(key="doc_id", table="docs")}) GROUP BY doc_id, f),
aim AS MATERIALIZED (SELECT f, count(*) AS n FROM ({_SQL_RUNS.format(key="doc_id", table="items")}) GROUP BY f),
names AS MATERIALIZED (SELECT f, row_number() OVER () AS k, hex(encode(f)) AS h FROM (SELECT f FROM own UNION SELECT f FROM aim)),
bytes AS MATERIALIZED (SELECT CAST(range AS BIGINT) AS b, list_reduce(list_prepend(CAST(range AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)),
sums AS (
  SELECT k, h, CAST(1 AS BIGINT) AS pos, CAST(4294967295 AS BIGINT) AS c FROM names
  UNION ALL
  SELECT k, h, pos + 2, xor(c >> 8, v) FROM sums JOIN bytes
    ON b = xor(c & 255, CAST('0x' || substr(h, pos, 2) AS BIGINT)) WHERE pos < len(h)),
buckets AS MATERIALIZED (SELECT f, xor(c, 4294967295) % {BUCKETS} AS bucket FROM sums JOIN names USING (k) WHERE pos > len(sums.h)),
s AS (SELECT bucket, sum(n) AS s FROM own JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM aim JOIN buckets USING (f) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM own JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {SHARE[0]} * n // {SHARE[1]} THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
