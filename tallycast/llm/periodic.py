"""Runs of repeated words in a text, found from its suffixes.

The words of a text are numbered and its suffixes sorted by prefix doubling, which ends as soon as
all suffixes differ. Neighbouring suffixes with their longest common prefix (LCP) are the edges of
a spanning forest: taken by decreasing LCP, they unite classes of positions in a union-find whose
classes are kept in text order. When a union at LCP l makes positions i < j neighbours in their
class, l is exactly their common length, and l >= j - i says that the words from i on repeat with
period j - i up to j + l. No position between them shares l words, so the period is the smallest
one; and the stretch is maximal if the word before i differs from the one before j. Each run is
thus met once, at the pair of its first word and the word a period later.

A run of period q and length n is asked for if n >= max(min_length, exponent * q), so only pairs
with l >= (exponent - 1) * (j - i) seed one, and unions below the least such l are left out: texts
without a repeat of that many words end with the sort.

Texts are independent of each other, so tasks are those of the scan. Memory in a task is one batch
and, for one text at a time, about 4 bytes a word for each doubling of its longest repeat.

Defined cases: a null, empty or blank text has no words, no runs and the digests of empty strings;
a text of any length is read whole; equal lengths are ordered by start, then period; repeated rows
are answered each; a null id plants nothing; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.shared import small_batches

MIN_LENGTH = 6
EXPONENT = 4
BLOCK = 1024  # positions of a block of an ordered set


class Positions:
    """A set of positions in order, in blocks of bounded size."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, position: int):
        self.blocks, self.heads, self.size = [[position]], [position], 1

    def __iter__(self):
        return (p for block in self.blocks for p in block)

    def insert(self, position: int) -> tuple[int | None, int | None]:
        """Add a position; returns the ones before and after it."""
        at = max(bisect_left(self.heads, position) - 1, 0)
        block = self.blocks[at]
        k = bisect_left(block, position)
        before = block[k - 1] if k else None
        if k < len(block):
            after = block[k]
        else:
            after = self.heads[at + 1] if at + 1 < len(self.heads) else None
        block.insert(k, position)
        self.heads[at] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[at:at + 1] = [block[:half], block[half:]]
            self.heads[at:at + 1] = [block[0], block[half]]
        return before, after


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in suffix order, and the ranks of all windows of 1, 2, 4, ... words.

    Windows that reach beyond the end count as filled up with a smallest word.
    """
    n = len(codes)
    levels = [codes.astype(np.int32)]
    width = 1
    while True:
        now = levels[-1].astype(np.int64)
        second = np.zeros(n, np.int64)
        second[:n - width] = now[width:] + 1 if width < n else 0
        pair = now * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if rank[order[-1]] == n - 1:
            return order, levels
        levels.append(rank)
        width *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common length of each suffix and the next one in suffix order."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        inside = np.flatnonzero(np.maximum(a, b) + width <= n)
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        out[same] += width
        a[same] += width
        b[same] += width
    return out


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH,
              exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(codes)
    if n < max(min_length, exponent):
        return []
    least = min(max(min_length - q, (exponent - 1) * q) for q in range(1, min_length + 1))
    order, levels = suffix_order(codes)
    if 1 << len(levels) <= least:  # windows of that many words all differ
        return []
    lcp = common_prefixes(order, levels)
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    words, parent, sets, runs = codes.tolist(), {}, {}, []

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def seed(i: int, j: int, length: int) -> None:
        if (exponent - 1) * (j - i) <= length and j - i + length >= min_length and (
                i == 0 or words[i - 1] != words[j - 1]):
            runs.append((i, j - i + length, j - i))

    for x, y, length in zip(order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist()):
        x, y = find(x), find(y)
        large, small = sets.setdefault(x, Positions(x)), sets.setdefault(y, Positions(y))
        if large.size < small.size:
            x, y, large, small = y, x, small, large
        moved = list(small)
        for last, p, then in zip([None, *moved], moved, [*moved[1:], n]):
            before, after = large.insert(p)
            # two of the smaller class next to each other were neighbours before
            if before != last:
                seed(before, p, length)
            if after is not None and after < then:
                seed(p, after, length)
        parent[y] = x
        del sets[y]
    return sorted(runs)


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The report's words: for one id in ten the text goes on periodically from some word."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH, exponent: int = EXPONENT, change=None) -> DataFrame:
    """One row per row of ``docs``: id, ``runs`` (array of start, length, period, by start, then
    period) and ``collapsed``, the words outside the repeats of all runs joined by one space.

    ``change(words, id)`` may give other words than those of the text.
    """
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                if change is not None:
                    words = change(words, doc_id)
                numbers: dict[bytes, int] = {}
                codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words),
                                    np.int64, len(words))
                runs = find_runs(codes, min_length, exponent)
                if runs:
                    words = [words[i] for i in np.flatnonzero(collapsed(len(words), runs))]
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, run_type), pa.array(left, pa.binary())],
                names=["id", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType),
        T.StructField("runs", T.ArrayType(T.StructType([
            T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
        T.StructField("collapsed", T.BinaryType())])
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body")).mapInArrow(
        search, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def report(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, change=planted)
    longest = F.expr("""array_max(transform(runs, r ->
        struct(r.length AS length, -r.start AS s, -r.period AS p)))""")
    listed = F.expr(r"""array_join(transform(runs, r ->
        concat(r.start, ',', r.length, ',', r.period, '\n')), '')""")
    return found.withColumn("top", longest).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# A run of period q and length n is an island of n - q - 4 places at which five words repeat q later.
SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
bytes AS MATERIALIZED (SELECT CAST(range AS BIGINT) AS b, list_reduce(list_prepend(CAST(range AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)),
sums AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS t, 1 AS pos, CAST(4294967295 AS BIGINT) AS c FROM split
  UNION ALL
  SELECT doc_id, t, pos + 1, xor(c >> 8, v) FROM sums JOIN bytes ON b = xor(c & 255, ascii(substr(t, pos, 1))) WHERE pos <= len(t)),
plan AS (
  SELECT doc_id, w, n, h, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS parts
  FROM (SELECT split.doc_id, w, len(w) AS n, xor(c, 4294967295) AS h FROM split JOIN sums USING (doc_id) WHERE pos > len(t))),
words AS MATERIALIZED (
  SELECT doc_id, n, i, w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END + 1] AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM plan)),
grams AS MATERIALIZED (
  SELECT doc_id, n, i, hash(x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND b.i > a.i
  WHERE a.n >= 6 AND 4 * (b.i - a.i) <= a.n AND b.i + 5 <= a.n),
isles AS MATERIALIZED (
  SELECT doc_id, q, min(i) AS s, count(*) + q + 4 AS size
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs) GROUP BY doc_id, q, isle),
runs AS MATERIALIZED (
  SELECT * FROM isles r WHERE size >= greatest(6, 4 * q) AND NOT EXISTS (
    SELECT 1 FROM isles d WHERE d.doc_id = r.doc_id AND d.q < r.q AND d.s <= r.s AND d.s + d.size >= r.s + r.size)),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
         arg_min(struct_pack(s := s, size := size, q := q), (-size, s, q)) AS top FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.size AS BIGINT) AS length,
       CAST(top.q AS BIGINT) AS period, CAST(1000 * top.size // top.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM split LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""
