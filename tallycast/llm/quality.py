"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are character and word statistics of the line itself and
of the lines before and after it; two states with a transition matrix make a chain per document.
Forward-backward gives each line the marginal of being good, and the marginals, weighted by line
length, are the document's share of good text. A logistic curve fitted on the training documents
turns that share into a probability.

Training documents are labelled, lines are not, and a document may mix both kinds. So line labels are
learnt: every line begins with the label of its document, the chain is fitted by the exact
likelihood (full-batch gradient steps), and then lines that the chain holds to be of the other kind
change their label, as long as at least ``AGREE`` of the document's length keeps it; this repeats
``RELABEL`` times. What the chain learns about neighbouring lines thus comes from documents that do
change from good to bad.

The sample is bounded: ``max_train`` labelled documents (smallest hashes of their id, so that it does
not depend on partitioning), of each at most ``TRAIN_LINES`` consecutive lines, beginning at a line
drawn by hash. Tasks make the features, so the driver sees at most ``max_train`` x ``TRAIN_LINES`` rows of
``N_FEATURES`` single-precision numbers (60 MB) and no text; the curve is fitted on the shares of the
same documents, whole, which tasks compute too.

Defined cases: a null or empty text is one empty line and gets a score; long texts are read whole,
and so are their lines; rows with equal text have equal scores; ties of line labels keep the
document's; a table without usable labels gives every text 0.5; an empty table gives no rows;
labels, ids and all other columns never enter a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.shared import carried, small_batches, stage

MAX_TRAIN = 3_000
TRAIN_LINES = 96  # consecutive lines of a document that the chain learns from
STEPS = 60
RELABEL = 2
AGREE = 0.34  # of a document's length that keeps the document's label
RATE = 0.1
DECAY = 1e-3
THRESHOLD = 0.7
BAD, GOOD = 0, 1

# Character classes by rule; index into the counts of a line.
CLASSES = ("lower", "upper", "digit", "space", "sentence", "quote", "symbol", "other")
_SENTENCE, _QUOTE = ".,;:?", "'\"()-"


def _class_table() -> np.ndarray:
    """Class of every code point up to U+024F; anything later is ``other``."""
    out = np.full(0x251, CLASSES.index("other"), np.int8)
    for code in range(0x250):
        c = chr(code)
        name = ("lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit()
                else "space" if c.isspace() else "sentence" if c in _SENTENCE
                else "quote" if c in _QUOTE else "symbol" if code < 0x80 else "other")
        out[code] = CLASSES.index(name)
    return out


CLASS_OF = _class_table()
N_OWN = 17
N_FEATURES = 1 + 3 * N_OWN


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) with a constant, the line's own and its neighbours'; and line lengths."""
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = CLASS_OF[np.minimum(codes, 0x250)]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    counts = np.zeros((len(lines), len(CLASSES)))
    full = lengths > 0
    if full.any():
        inside = codes != 10
        row = np.repeat(np.arange(len(lines)), lengths)
        counts = np.bincount(row * len(CLASSES) + kinds[inside],
                             minlength=counts.size).reshape(counts.shape).astype(float)
    # a character that repeats the one before it and is no letter, digit or space
    again = np.zeros(len(codes) + 1)
    if len(codes) > 1:
        hard = (kinds >= CLASSES.index("sentence")) & (kinds < CLASSES.index("other"))
        again[2:] = np.cumsum((codes[1:] == codes[:-1]) & hard[1:])
    repeats = again[np.minimum(starts + lengths, len(codes))] - again[np.minimum(starts, len(codes))]
    words = [line.split() for line in lines]
    n_words = np.fromiter(map(len, words), float, len(lines))
    kinds_of = np.fromiter((len(set(w)) for w in words), float, len(lines))
    short = np.fromiter((sum(len(x) < 4 for x in w) for w in words), float, len(lines))
    echoes = np.fromiter((sum(map(eq, w, islice(w, 1, None))) for w in words), float, len(lines))
    size = np.maximum(lengths, 1)[:, None]
    per_word = np.maximum(n_words, 1)
    own = np.column_stack([
        counts / size,
        np.log1p(lengths) / 8, np.log1p(n_words) / 6, kinds_of / per_word, short / per_word,
        np.minimum(lengths / per_word, 40) / 40, repeats / size[:, 0],
        counts[:, CLASSES.index("symbol")] / per_word,
        (lengths == 0).astype(float), echoes / per_word,
    ])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.column_stack([np.ones(len(lines)), own, before, after]), lengths


class Model:
    """Weights of the chain and of the curve over the document's share of good text."""

    def __init__(self, weights: np.ndarray, first: np.ndarray, moves: np.ndarray,
                 curve: tuple[float, float]):
        self.weights, self.first, self.moves, self.curve = weights, first, moves, curve

    def line_marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability of each line being good: forward-backward on the log odds of the states."""
        own = (features @ (self.weights[:, GOOD] - self.weights[:, BAD])).tolist()
        (bb, bg), (gb, gg) = np.exp(self.moves).tolist()
        n, exp, log = len(own), math.exp, math.log
        forward, backward = [0.0] * n, [0.0] * n
        at = float(self.first[GOOD] - self.first[BAD]) + own[0]
        forward[0] = at
        for t in range(1, n):
            r = exp(min(max(at, -50.0), 50.0))
            at = forward[t] = own[t] + log((bg + gg * r) / (bb + gb * r))
        at = 0.0
        for t in range(n - 2, -1, -1):
            r = exp(min(max(at + own[t + 1], -50.0), 50.0))
            at = backward[t] = log((gb + gg * r) / (bb + bg * r))
        odds = np.clip(np.add(forward, backward), -50, 50)
        return 1 / (1 + np.exp(-odds))

    def share(self, text: str) -> float:
        features, lengths = line_features(text)
        weight = lengths + 1.0
        return float(self.line_marginals(features) @ weight / weight.sum())

    def score(self, text: str) -> float:
        slope, offset = self.curve
        return float(1 / (1 + np.exp(np.clip(-(slope * self.share(text) + offset), -60, 60))))


def _groups(docs: list[np.ndarray]):
    """Documents of like length, padded together: (numbers, features, mask)."""
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    start = 0
    while start < len(order):
        longest = max(8, int(len(docs[order[start]]) * 1.5))
        stop = start + 1
        while stop < len(order) and len(docs[order[stop]]) <= longest:
            stop += 1
        numbers = order[start:stop]
        size = max(len(docs[i]) for i in numbers)
        features = np.zeros((len(numbers), size, N_FEATURES), np.float32)
        mask = np.zeros((len(numbers), size))
        for k, i in enumerate(numbers):
            features[k, :len(docs[i])] = docs[i]
            mask[k, :len(docs[i])] = 1
        yield numbers, features, mask
        start = stop


def _chains(scores, first, moves, mask):
    """Forward and backward log sums of padded documents; a padded line changes nothing."""
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + first
    for t in range(1, scores.shape[1]):
        step = forward[:, t - 1, :, None] + moves
        new = scores[:, t] + np.logaddexp(step[:, 0], step[:, 1])
        forward[:, t] = np.where(mask[:, t, None] > 0, new, forward[:, t - 1])
    for t in range(scores.shape[1] - 2, -1, -1):
        step = (backward[:, t + 1] + scores[:, t + 1])[:, None, :] + moves
        new = np.logaddexp(step[:, :, 0], step[:, :, 1])
        backward[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
    return forward, backward


def fit(docs: list[np.ndarray], lengths: list[np.ndarray], labels: list[int],
        steps: int = STEPS, relabel: int = RELABEL) -> Model:
    """The chain, by maximum likelihood with a Gaussian prior, from the features and lengths of the
    lines of labelled documents. The curve is left flat."""
    weights, first, moves = np.zeros((N_FEATURES, 2)), np.zeros(2), np.zeros((2, 2))
    model = Model(weights, first, moves, (0.0, 0.0))
    if len(set(labels)) < 2:
        return model
    groups = list(_groups(docs))
    total = len(docs)
    gold_of = [np.full(len(d), label) for d, label in zip(docs, labels)]
    for turn in range(relabel + 1):
        if turn:
            gold_of = [_relabelled(model.line_marginals(d), size, label)
                       for d, size, label in zip(docs, lengths, labels)]
        gold = []
        for numbers, _, mask in groups:
            one = np.zeros((*mask.shape, 2))
            for k, i in enumerate(numbers):
                one[k, np.arange(len(gold_of[i])), gold_of[i]] = 1
            gold.append(one)
        params = [weights, first, moves]
        speed = [np.zeros_like(p) for p in params]
        scale = [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            grads = [DECAY * p for p in params]
            for (_, features, mask), seen in zip(groups, gold):
                for g, own in zip(grads, _gradient(features, mask, seen, weights, first, moves, total)):
                    g += own
            for p, g, m, v in zip(params, grads, speed, scale):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def _gradient(features, mask, gold, weights, first, moves, total):
    """Of the negative log likelihood of the line labels ``gold``, for a group of documents."""
    scores = (features @ weights) * mask[:, :, None]
    forward, backward = _chains(scores, first, moves, mask)
    marginal = forward + backward
    marginal = np.exp(marginal - np.logaddexp.reduce(marginal, 2)[..., None])
    # a document counts once, however many lines it has
    each = mask / mask.sum(1)[:, None] / total
    off = (marginal - gold) * each[:, :, None]
    between = np.zeros((2, 2))
    if features.shape[1] > 1:
        joint = forward[:, :-1, :, None] + moves + (scores + backward)[:, 1:, None, :]
        flat = joint.reshape(*joint.shape[:2], 4)
        pair = np.exp(joint - np.logaddexp.reduce(flat, 2)[..., None, None])
        seen = gold[:, :-1, :, None] * gold[:, 1:, None, :]
        between = ((pair - seen) * each[:, 1:, None, None]).sum((0, 1))
    return features.reshape(-1, N_FEATURES).T @ off.reshape(-1, 2), off[:, 0].sum(0), between


def _relabelled(marginals: np.ndarray, lengths: np.ndarray, label: int) -> np.ndarray:
    """Labels of a document's lines: those the chain gives them, except for the lines that agree most
    with the document's label and make up ``AGREE`` of its length."""
    agree = marginals if label == GOOD else 1 - marginals
    size = lengths + 1.0
    order = np.argsort(-agree, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    out = np.where(agree >= 0.5, label, 1 - label)
    out[order[before < AGREE * size.sum()]] = label
    return out


def _curve(shares: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the share, by Newton steps with a small prior."""
    x = np.column_stack([shares, np.ones(len(shares))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(-(x @ w), -60, 60)))
        grad = x.T @ (p - labels) + 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame, usable, max_train: int, id_col: str, text_col: str,
            label_col: str) -> DataFrame:
    """place, label and body of the training documents.

    A wider cut by hash, sized from the count of labels, comes first, so that the exact cut to
    ``max_train`` rows never orders more than a few samples; it orders hashes, not texts.
    """
    marked = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).alias("label"))
    share = min(1.0, 3 * max_train / max(1, marked.count()))

    def near(c):
        return F.pmod(F.xxhash64(F.lit(11), c), F.lit(1 << 20)) <= int(share * (1 << 20))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(near(F.col(id_col))).select(F.col(id_col).alias("id"), text.alias("body"))
    hashed = rows.select("id", F.xxhash64("body").alias("row")).distinct().join(marked.where(near(F.col("id"))), "id")
    chosen = stage(hashed.select("id", "row", "label", F.xxhash64(F.lit(11), "id").alias("place"))
                   .orderBy("place", "row").limit(max_train), "chosen")
    # repeated rows are one training document
    return rows.withColumn("row", F.xxhash64("body")).join(chosen, ["id", "row"]).groupBy("id", "row").agg(
        F.first("place").alias("place"), F.first("label").cast("int").alias("label"), F.first("body").alias("body"))


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and lengths of at most ``TRAIN_LINES`` lines of each document."""
    for batch in batches:
        features, lengths = [], []
        for place, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            x, size = line_features(text)
            start = place % (len(x) - TRAIN_LINES + 1) if len(x) > TRAIN_LINES else 0
            features.append(x[start:start + TRAIN_LINES].astype(np.float32).tobytes())
            lengths.append(size[start:start + TRAIN_LINES].astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(features, pa.binary()), pa.array(lengths, pa.binary())],
            names=["place", "label", "features", "lengths"])


def train(docs: DataFrame, labels: DataFrame, usable, max_train: int = MAX_TRAIN,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled documents where ``usable`` (a condition on the id column) holds."""
    small_batches(docs.sparkSession, 32)
    sample = stage(_sample(docs, labels, usable, max_train, id_col, text_col, label_col), "sample").select(
        "place", "label", "body")
    rows = sample.mapInArrow(_training_lines, "place long, label int, features binary, lengths binary").collect()
    rows.sort(key=lambda r: (r["place"], r["features"]))
    found = [r["label"] for r in rows]
    model = fit([np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows],
                [np.frombuffer(r["lengths"], np.int64) for r in rows], found)
    if len(set(found)) < 2:
        return model
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([shipped.value.share(t) for t in batch.column(2).to_pylist()], pa.float64())],
                names=["place", "label", "share"])

    seen = sorted(sample.mapInArrow(shares, "place long, label int, share double").collect())
    model.curve = _curve(np.array([r["share"] for r in seen]), np.array([r["label"] for r in seen], float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``original``, a struct of its columns ``keep`` (all), and
    ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    source, texts = carried(docs, keep or docs.columns, text_col)
    schema = T.StructType([source.schema["original"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shipped.value.score(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())],
                                             names=["original", "score"])
    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", remainder: int = 2, modulus: int = 4):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, ~held_out())
    scored = score(docs, model, keep=["doc_id"]).select("original.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
