"""Languages of mixed texts: scripts narrow the candidates, a Viterbi path labels spans.

A word is a run of letters. Its script admits the languages whose training text uses that
script; each admitted language scores it by the log probability of its letter trigrams, with
word boundaries. The path over all words with a penalty for every change of language labels
spans; the language with most letters is the document's. Its score is the share of all letters that
lie in its words of known scripts, times its probability against the other languages given those
words, so words that fit several languages, or none, make a low score.

Most texts hold one language. If no stretch gains more than half a penalty in another one, no
path with a change can beat the constant path, so the path is walked only for the others.

Training counts trigrams of a bounded sample of labelled rows (``max_train``, smallest hashes of
the id). Defined cases: null texts and texts without letters are ``und`` with score 0; a word
of a script that no training text used does not count for any language; equal totals go to the
first language by name; very long texts are read whole, in pieces cut between words; without
any training row every text is ``und``; repeated rows are answered each; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.shared import small_batches

MAX_TRAIN = 20_000
BUCKETS = 1 << 16
PENALTY = 25.0
SMOOTHING = 0.2
PIECE_CHARS = 400_000
SCRIPT_SHARE = 1e-3  # of a language's letters, for a script to count as its own
UNKNOWN = "und"

# First code point of each range and its script.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai",
           "georgian", "hangul", "ethiopic", "kana", "han", "other")
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "kana"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB10, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0x20000, "han"),
)
TOP = 0x110000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point below TOP: its script (0 for what is no letter), its lower case."""
    script = np.zeros(TOP + 1, np.uint8)
    lower = np.arange(TOP + 1, dtype=np.uint32)
    bounds = [*RANGES, (0x40000, "other"), (TOP, "other")]
    for (a, name), (b, _) in zip(bounds, bounds[1:]):
        number = SCRIPTS.index(name)
        for code in range(a, b):
            c = chr(code)
            if c.isalpha():
                script[code] = number
                if len(low := c.lower()) == 1:
                    lower[code] = ord(low)
    return script, lower


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[int, str]]:
    """Offset and text of pieces, cut at a space where there is one."""
    at = 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            space = text.rfind(" ", at + 1, stop)
            stop = space if space > 0 else stop
        yield at, text[at:stop]
        at = stop


def words(text: str):
    """Starts, ends and scripts of the words; bucket of the trigram that ends at each letter, the
    word of each letter, and the bucket that closes each word."""
    script_of, lower_of = tables()
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), TOP)
    script = script_of[codes]
    letter = script > 0
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) == 0:
        return starts, ends, script[:0], codes[:0], codes[:0], codes[:0]
    chars = np.where(letter, lower_of[codes], 0).astype(np.uint64)
    padded = np.concatenate([np.zeros(2, np.uint64), chars, np.zeros(1, np.uint64)])
    # a letter before the boundary belongs to another word
    one, two = padded[1:-1], padded[:-2] * (padded[1:-1] > 0)
    mixed = (two * np.uint64(0x9E3779B97F4A7C15) + one * np.uint64(0xC2B2AE3D27D4EB4F)
             + padded[2:] * np.uint64(0x165667B19E3779F9))
    bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48))
    inside = np.flatnonzero(letter)
    first = np.searchsorted(inside, starts)
    return starts, ends, script[starts], bucket[inside], first, bucket[ends]


class Model:
    """Log probabilities of trigrams by language, and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(0, keepdims=True)
        logs = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS))
        self.table = (logs - logs.max(1, keepdims=True, initial=-np.inf)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        admitted = share >= SCRIPT_SHARE
        # a script that no language uses says nothing
        self.barred = np.where(admitted | ~admitted.any(1, keepdims=True), 0, -PENALTY * 4
                               ).astype(np.float32)
        self.known = admitted.any(1).astype(np.float32)

    def scores(self, text: str):
        """Starts, ends, (words, languages) scores, and which words are of a known script."""
        starts, ends, script, letters, first, close = words(text)
        if len(starts) == 0:
            return starts, ends, np.zeros((0, len(self.langs)), np.float32), starts > 0
        own = np.add.reduceat(self.table[letters], first, axis=0) + self.table[close]
        known = self.known[script]
        return starts, ends, own * known[:, None] + self.barred[script], known > 0

    def label(self, text: str) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, score and spans (start, end, language) in code points."""
        if not text or not self.langs:
            return UNKNOWN, 0.0, []
        parts = [(at, *self.scores(piece)) for at, piece in pieces(text)]
        starts = np.concatenate([p[0] + p[1] for p in parts])
        ends = np.concatenate([p[0] + p[2] for p in parts])
        if len(starts) == 0:
            return UNKNOWN, 0.0, []
        scores, known = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        path = best_path(scores)
        letters = np.bincount(path, ends - starts, len(self.langs))
        best = int(letters.argmax())
        own = path == best
        sure = (ends - starts)[known & own].sum() / letters.sum()
        rivals = scores[own].sum(0, dtype=np.float64)
        sure = sure / np.exp(np.minimum(rivals - rivals[best], 700)).sum()
        cut = np.flatnonzero(np.diff(path)) + 1
        spans = [(int(starts[a]), int(ends[b - 1]), self.langs[path[a]])
                 for a, b in zip([0, *cut], [*cut, len(path)])]
        return self.langs[best], float(sure), spans


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language of every word: most score less a penalty for each change."""
    sums = np.vstack([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
    best = int(sums[-1].argmax())
    gain = sums - sums[:, [best]]
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(len(scores), best)
    n = scores.shape[1]
    value = scores[0].tolist()
    back = []
    for row in scores[1:].tolist():
        top = max(range(n), key=value.__getitem__)
        jump = value[top] - penalty
        back.append([i if value[i] >= jump else top for i in range(n)])
        value = [(v if v >= jump else jump) + s for v, s in zip(value, row)]
    at = max(range(n), key=value.__getitem__)
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return np.array(path[::-1])


def train(docs: DataFrame, usable, max_train: int = MAX_TRAIN, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram and script counts by language over labelled rows where ``usable`` holds.

    Rows are taken by hash of their id, at a share sized from their count, so about ``max_train``
    of them at any size of the table.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = min(1.0, max_train / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1 << 24))
                        <= int(share * (1 << 24)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tri: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tri.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS)))
                for _, piece in pieces(text):
                    starts, ends, script, letters, _, close = words(piece)
                    own[:BUCKETS] += np.bincount(letters.astype(np.int64), minlength=BUCKETS)
                    own[:BUCKETS] += np.bincount(close.astype(np.int64), minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(script, ends - starts, len(SCRIPTS))
        for lang, own in tri.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(own[at])],
                names=["lang", "feature", "n"])

    counted = (sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
               .mapInArrow(count, "lang string, feature int, n double")
               .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counted["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    table[counted["feature"], counted["lang"].map(place).astype(int)] = counted["n"]
    return Model(langs, table[:BUCKETS], table[BUCKETS:])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` and ``spans``
    array<struct<start,end,lang>>. Other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.IntegerType()),
                         T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.label(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found]),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in f[2]] for f in found],
                          kind)], names=[id_col, "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(
        run, schema)


def held_out(id_col: str = "doc_id", modulus: int = 5):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == 0, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    model = train(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
