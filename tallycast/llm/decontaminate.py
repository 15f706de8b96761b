"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Questions and answers are normalised to words (A-Z in lower case, everything in ASCII that is no
letter or digit separates) and cut into windows of consecutive words. All windows form one
automaton; each text is normalised once and scanned once, and a match is mapped back through
its words to characters of the original. The scan knows windows by number only. Which items a
window belongs to stays a table: windows with the same items share a set, and the sets that a
text met are joined to their items afterwards, so an instruction that a third of all items begin
with is neither shipped with the automaton nor gathered per window.

The automaton is built once per worker. It is shipped to the tasks while the windows have a checked
total size; the windows of a larger test set are cut into parts of that size, and every text is
scanned by each part's automaton in a pass of its own, whose findings are written before the next
part is read, so neither the driver nor a worker ever holds more than one part.

Defined cases: null and empty texts have no words; a text of any length is read whole; an item with
fewer words than a window is one window, an item without words none; equal windows count for all
their items; repeated rows are reported each; null ids are passed through; an empty table gives
no rows, an empty test set no hit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.shared import ascii_lower, carried, small_batches, stage

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Windows held by one automaton, in characters; about 60 bytes of memory each.
AUTOMATON_CHARS = 2_000_000
HIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# every byte of a separator becomes a space, A-Z lower case; bytes of other characters stay
_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else
    b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normalised(text: str) -> str:
    """Words between single spaces, a space at both ends, one character per UTF-8 byte."""
    return " " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
                           ).decode("latin-1") + " "


def windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item, window); a window is its words joined by spaces."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))),
                                 F.lit(WORD), F.lit(0))
    cut = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (cut.where(F.size("w") > 0)
            .select("item", F.explode(F.transform(starts, lambda i: F.concat_ws(
                " ", F.slice("w", i, size)))).alias("window")).distinct())


def item_sets(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, number, set) and (set, item): windows of the same items share a set.

    A set is known by the number of its items and two sums of their hashes, so no window gathers
    its items; one window of each set lends it the items.
    """
    named = stage(pairs.groupBy("window").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("h"),
        F.sum(F.xxhash64(F.lit(7), "item").cast("decimal(38,0)")).alias("h2")).select(
        "window", F.monotonically_increasing_id().alias("number"),
        F.xxhash64("n", "h", "h2").alias("set")), "windows")
    lender = named.groupBy("set").agg(F.min("window").alias("window"))
    return named, stage(pairs.join(lender, "window").select("set", "item"), "item-sets")


def automaton(patterns: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Of (number, window), windows as bytes with a space at both ends."""
    machine = ahocorasick.Automaton()
    for number, p in patterns:
        key = " " + p.encode("utf-8").decode("latin-1") + " "
        machine.add_word(key, (number, len(key)))
    if patterns:
        machine.make_automaton()
    return machine


# the automaton of the newest part this worker has scanned with
_HELD: dict[str, ahocorasick.Automaton] = {}


def _held(name: str, patterns) -> ahocorasick.Automaton:
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = automaton(patterns.value)
    return _HELD[name]


def matches(machine: ahocorasick.Automaton, text: str) -> tuple[int, list[tuple[int, int, int]]]:
    """Words of the text, and (window, first word, one after the last) of every occurrence."""
    plain = normalised(text)
    if len(plain) == 2:
        return 0, []
    n_words = plain.count(" ") - 1
    found = [(end, i, size) for end, (i, size) in machine.iter(plain)] if len(machine) else []
    if not found:
        return n_words, []
    spaces = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 0x20)
    ends = np.searchsorted(spaces, [e for e, _, _ in found])
    starts = np.searchsorted(spaces, [e - size + 1 for e, _, size in found])
    return n_words, [(i, a, b) for (_, i, _), a, b in zip(found, starts.tolist(), ends.tolist())]


def _one(machine, text: str) -> tuple[int, list[int], list[int], list[dict]]:
    """Words, numbers of the words hit, windows met, and places of the occurrences."""
    n_words, found = matches(machine, text)
    if not found:
        return n_words, [], [], []
    edges = np.zeros(n_words + 1, np.int64)
    for _, a, b in found:
        edges[a] += 1
        edges[b] -= 1
    places = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    return (n_words, np.flatnonzero(np.cumsum(edges[:-1])).tolist(), sorted({i for i, _, _ in found}),
            [{"start": places[a][0], "end": places[b - 1][1]} for a, b in sorted({f[1:] for f in found})])


def _pass(docs: DataFrame, part: DataFrame, keep: list[str], text_col: str):
    """original, row (digest of the text), n_words, words (numbers of the words hit), windows and hits
    under one automaton; and the broadcast. ``part`` holds windows of a checked total size."""
    listed = [(r["number"], r["window"]) for r in part.select("number", "window").orderBy("window").collect()]
    name = hashlib.sha256("\n".join(f"{i} {w}" for i, w in listed).encode()).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(listed)
    source, texts_of = carried(docs, keep, text_col)
    schema = T.StructType([
        source.schema["original"], T.StructField("row", T.BinaryType()),
        T.StructField("n_words", T.LongType()), T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("windows", T.ArrayType(T.LongType())), T.StructField("hits", T.ArrayType(HIT))])
    hit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _held(name, shipped)
        for batch in batches:
            texts = texts_of(batch)
            out = list(zip(*[_one(machine, text) for text in texts])) or [[]] * 4
            rows = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    for t in texts]
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), hit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.binary()), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                names=["original", "row", "n_words", "words", "windows", "hits"])

    return source.mapInArrow(scan, schema), shipped


def scan(docs: DataFrame, named: DataFrame, keep: list[str] | None = None, text_col: str = "text",
         automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``original`` (a struct of its columns ``keep``, default all), ``row``
    (digest of the text), ``n_words``, ``n_hit`` (words inside any occurrence), ``windows`` (numbers) and
    ``hits`` array<struct<start,end>> in code points, by place."""
    small_batches(docs.sparkSession)
    keep = keep or docs.columns
    chars = named.agg(F.sum(F.length("window"))).first()[0] or 0
    parts = max(1, -(-chars // automaton_chars))
    if parts == 1:
        found, _ = _pass(docs, named, keep, text_col)
    else:
        merged = None
        for k in range(parts):
            own = named.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k)
            some, shipped = _pass(docs, own, docs.columns[:1], text_col)
            some = stage(some.where(F.size("words") > 0).select("row", "words", "windows", "hits"), "findings")
            shipped.destroy()
            merged = some if merged is None else merged.unionByName(some)
        # equal texts have equal findings: a text counts once in each part
        found, _ = _pass(docs, named.where(F.lit(False)), keep, text_col)
        once = merged.dropDuplicates(["row", "windows"]).groupBy("row").agg(*[
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
            for c in ("words", "windows", "hits")])
        none = {c: F.coalesce(F.col(f"m.{c}"), F.col(f"f.{c}")).alias(c) for c in ("words", "windows", "hits")}
        found = found.alias("f").join(once.alias("m"), F.col("f.row") == F.col("m.row"), "left").select(
            "f.original", "f.row", "f.n_words", *none.values())
    return found.select("original", "row", "n_words", F.size("words").cast("long").alias("n_hit"), "windows", "hits")


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep: list[str] | None = None,
         text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``scan`` with ``items`` (ids of all items met, sorted as strings) in place of window numbers."""
    pairs = stage(windows(benchmark, size, item_col, item_text_col), "window-items")
    named, sets = item_sets(pairs)
    found = stage(scan(docs, named, keep, text_col, automaton_chars), "scanned")
    met = found.where("n_hit > 0").select("row", F.explode("windows").alias("number")).distinct()
    # a text's sets first, then their items; equal texts share the answer, which is staged so that a
    # text with many copies is split in the join
    items = stage(met.join(named.select("number", "set"), "number").select("row", "set").distinct().join(
        sets, "set").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")), "items")
    hit = found.where("n_hit > 0").join(items, "row").select("original", "n_words", "n_hit", "items", "hits")
    clean = found.where("n_hit = 0").select(
        "original", "n_words", "n_hit", F.array().cast("array<string>").alias("items"), "hits")
    return hit.unionByName(clean)


def hit_rows(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``original`` and ``n_hit`` of every row, without looking up the items."""
    pairs = windows(benchmark, size, item_col, item_text_col)
    named = stage(pairs.select("window").distinct().withColumn(
        "number", F.monotonically_increasing_id()), "windows")
    return scan(docs, named, None, text_col).select("original", "n_hit")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs, benchmark, keep=["doc_id"])
    return found.select("original.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""
WITH docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size,
         unnest(list_transform(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1),
           lambda i: array_to_string(w[i:i + {WINDOW} - 1], ' '))) AS win
  FROM items WHERE len(w) > 0),
places AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w
  FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
met AS (
  SELECT p.doc_id, p.i, p.size, item FROM (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM places) p
  JOIN windows USING (win, size)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM met)) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)"""
