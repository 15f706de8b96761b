"""Repeated lines, dropped by per-document bitmaps; built-in column functions only.

Lines become (hash, document, position) rows. They are ordered by hash with a secondary sort
by document, the keeping one first, and position; windows stream over that order and mark every
row that is not in the keeping document of a line found in enough documents. The marks come
back as a sparse bitmap per document, which is applied where the text is.

A line that a third of all documents hold is not gathered in one task: a first pass streams over
(hash, salt), where a row behind ``min_docs`` other documents of its own salt is already
decided and goes no further, so at most ``min_docs`` documents of each salt reach the second
pass, which is range-partitioned by hash.

Defined cases: a null or empty text is one empty line; lines shorter than ``min_chars`` and
texts without lines to drop stay as they are; the largest id keeps a line, a null id is the
smallest; rows with the same id are one document for counting, and each keeps or drops its own
lines; a text of any length is split whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.shared import ascii_lower, stage

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
BITS = 64


def line_key(line):
    """Stripped of white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _row(doc, text):
    """Tells rows with one id apart by their text."""
    return F.xxhash64(doc, text)


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int, salts: int) -> DataFrame:
    """doc, row, pos of every line to drop, from doc and body."""
    lines = (docs.select("doc", _row("doc", "body").alias("row"),
                         F.posexplode(F.split("body", "\n", -1)))
             .withColumn("key", line_key(F.col("col")))
             .where(F.char_length("key") >= min_chars)
             .select("doc", "row", "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit(3), "key").alias("h2"),
                     F.pmod(F.xxhash64("doc"), F.lit(salts)).alias("salt")))
    newest_first = F.col("doc").desc_nulls_last()
    local = Window.partitionBy("salt", "h1", "h2").orderBy(newest_first)
    # staged, since both passes below read it
    ranked = stage(lines.withColumn("seen", F.dense_rank().over(local)).drop("salt"), "lines")
    decided = ranked.where(F.col("seen") > min_docs)

    ranged = (ranked.where(F.col("seen") <= min_docs).repartitionByRange("h1", "h2")
              .sortWithinPartitions("h1", "h2", newest_first, "pos"))
    whole = Window.partitionBy("h1", "h2")
    marked = (ranged.withColumn("rank", F.dense_rank().over(whole.orderBy(newest_first)))
              .withColumn("docs", F.max("rank").over(whole))
              .where((F.col("rank") > 1) & (F.col("docs") >= min_docs)))
    return decided.select("doc", "row", "pos").unionByName(marked.select("doc", "row", "pos"))


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
            id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """doc, row, ``dropped`` array<struct<word,bits>>: bit i of word w is line 64w + i.

    Only words with a dropped line are listed and only rows with such a word, so a row without
    an entry keeps all its lines.
    """
    salts = salts or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.col(id_col).alias("doc"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    words = dropped_positions(source, min_chars, min_docs, salts).groupBy(
        "doc", "row", F.floor(F.col("pos") / BITS).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("bits"))
    return words.groupBy("doc", "row").agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``original`` (a struct of its other columns), n_lines,
    n_dropped and ``kept``, the text without the dropped lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
                       .alias("original"), text.alias("body"), _row(F.col(id_col), text).alias("row"))
    right = marks.select(F.col("doc").alias("marked"), F.col("row").alias("marked_row"), "dropped")
    joined = left.join(right, F.col(f"original.{id_col}").eqNullSafe(F.col("marked"))
                       & (F.col("row") == F.col("marked_row")), "left")
    # word by word, so that a word's bits are looked up once for its lines
    kept = F.expr(f"""
        flatten(transform(
          transform(sequence(0, (size(lines) - 1) div {BITS}), w -> struct(w AS word,
            coalesce(try_element_at(map_from_entries(dropped), cast(w AS INT)), 0L) AS bits)),
          x -> filter(slice(lines, cast(x.word * {BITS} + 1 AS INT), {BITS}),
            (line, i) -> (shiftrightunsigned(x.bits, i) & 1L) = 0L)))""")
    whole = F.col("dropped").isNull()
    return (joined.withColumn("lines", F.split("body", "\n", -1))
            .withColumn("rest", F.when(~whole, kept))
            .select("original", F.size("lines").cast("long").alias("n_lines"),
                    F.when(whole, F.lit(0)).otherwise(F.size("lines") - F.size("rest"))
                    .cast("long").alias("n_dropped"),
                    F.when(whole, F.col("body")).otherwise(F.concat_ws("\n", "rest")).alias("kept")))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``apply_bitmaps`` of the ``bitmaps`` of ``docs``."""
    marks = bitmaps(docs, min_chars, min_docs, id_col, text_col)
    return apply_bitmaps(docs, marks, id_col, text_col)


def report(docs: DataFrame) -> DataFrame:
    done = dedup(docs.select("doc_id", "text"))
    return done.select("original.doc_id", "n_lines", "n_dropped",
                       F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, coalesce(k.doc_id <> c.keeper, false) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
