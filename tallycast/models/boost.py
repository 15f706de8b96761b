"""Gradient boosting with Poisson loss, distributed, for one model or one per cluster.

Round: mu = exp(f); a tree is fitted to the gradient y - mu with weight mu; each leaf gets
sum(y - mu) / (sum(mu) + l2); f grows by the learning rate times its leaf. With held rows the rounds
of a model end when their error has stopped falling, and the trees up to its minimum stay.

Rows are binned once, by edges common to all models, and stacked into blocks of bounded size. All
models advance together in steps of ``checkpoint_every`` rounds, each step a table of blocks with
their scores and a log of the trees in the shared folder: a lost executor costs at most a step, and
a fit that was interrupted goes on after its last step. A model whose rows fill one block needs no
exchange, so its block grows all trees of a step in one task. A larger one is grown level by level:
tasks add up the histograms of their blocks, those are exchanged by node and range of features and
summed, and only the best split of each range reaches the driver.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from math import ceil, log, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.functions.nulls import clamp_nonneg
from tallycast.models.design import Design
from tallycast.models.recursion import collect_steps
from tallycast.models.trees import Tree, best_splits, grow, histograms
from tallycast.operators.sampling import holdout_by
from tallycast.session import discard, exists, scratch_path

TREE_SCHEMA = (
    "round int, node int, feature int, threshold double, left_levels array<double>, "
    "left int, right int, value double"
)

# Bins (one byte each) of a block, and features whose histograms are exchanged together.
BLOCK_CELLS = 1 << 23
RANGE = 64
_NUMBERS = 10_000  # accuracy of the quantiles


@dataclass(frozen=True)
class BoostParams:
    """Defaults are the settings of the forecasting task."""

    learning_rate: float = 0.075
    num_leaves: int = 128
    min_rows_per_leaf: int = 100
    l2: float = 0.1
    row_sample: float = 0.75
    rounds: int = 1200
    seed: int = 777
    checkpoint_every: int = 20
    max_bins: int = 64
    patience: int = 50  # rounds without a smaller validation error before the fit ends

    @property
    def depth(self) -> int:
        return ceil(log2(self.num_leaves))


@dataclass
class BoostModel:
    """Base score and trees; ``trees`` is a list of node tables, one per round. ``rmse`` is the
    validation error and ``deviance`` the training loss after each round; the trees after the
    smallest validation error are left out."""

    base: float
    design: Design
    params: BoostParams
    trees: list[list[tuple]] = field(default_factory=list)
    deviance: list[float] = field(default_factory=list)
    rmse: list[float] = field(default_factory=list)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r, *node) for r, tree in enumerate(self.trees) for node in tree]
        return spark.createDataFrame(rows, TREE_SCHEMA)

    def scorer(self) -> "TreeScorer":
        return TreeScorer(self.base, self.trees)


class TreeScorer:
    """Vectorised evaluation of the fitted trees on a numpy matrix."""

    def __init__(self, base: float, trees: list[list[tuple]]):
        self.base = base
        self.trees = [self._arrays(t) for t in trees]

    @staticmethod
    def _arrays(tree: list[tuple]) -> tuple:
        """Node columns; row n of ``member`` tells which codes go left at nominal node n."""
        feature, threshold, levels, left, right, value = map(list, list(zip(*tree))[1:])
        nominal = np.array([bool(v) for v in levels])
        codes = max([0, *(int(c) for v in levels if v for c in v)])
        member = np.zeros((len(tree), codes + 1), bool)
        for n, v in enumerate(levels):
            member[n, [int(c) for c in v or ()]] = True
        return (np.array(feature), np.array(threshold), nominal, member, np.array(left),
                np.array(right), np.array(value))

    def log_mean(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, threshold, nominal, member, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            top = member.shape[1] - 1
            while (inner := feature[at] >= 0).any():
                v = x[rows, np.maximum(feature[at], 0)]
                code = np.clip(v, 0, top).astype(int)
                go_left = np.where(nominal[at], member[at, code] & (v <= top), v <= threshold[at])
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            f += value[at]
        return f


def _externals(design: Design) -> Column:
    """Numeric columns, their missing-value indicators, and factor codes.

    A missing numeric value becomes 0 with an indicator column of its own.
    """
    numeric = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in design.numeric]
    missing = [F.col(c).isNull().cast("double") for c in design.numeric]
    return F.concat(F.array(*numeric, *missing).cast("array<double>"),
                    design.codes().cast("array<double>"))


def _plain_features(design: Design) -> Column:
    return F.concat(design.lag_array(), _externals(design))


# -- bins ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Binning:
    """How feature values become bins: edges of the lags (common to all), edges of each numeric
    feature after them, and the number of codes of each factor at the end."""

    n_lags: int
    lag_edges: tuple[float, ...]
    edges: tuple[tuple[float, ...], ...]
    codes: tuple[int, ...]

    @property
    def size(self) -> int:
        """Bins of a feature, at least two so that there is a place to cut."""
        return max([2, len(self.lag_edges) + 1, *[len(e) + 1 for e in self.edges], *self.codes])

    @property
    def n_features(self) -> int:
        return self.n_lags + len(self.edges) + len(self.codes)

    @property
    def nominal(self) -> np.ndarray:
        return np.arange(self.n_features) >= self.n_features - len(self.codes)

    @property
    def dtype(self) -> type:
        return np.uint8 if self.size <= 256 else np.uint16

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of the rows of ``x``: value v has bin b if edge b is the first not below v."""
        out = np.empty(x.shape, self.dtype)
        out[:, :self.n_lags] = np.searchsorted(self.lag_edges, x[:, :self.n_lags])
        for j, edges in enumerate(self.edges, self.n_lags):
            out[:, j] = np.searchsorted(edges, x[:, j])
        out[:, self.n_features - len(self.codes):] = x[:, self.n_features - len(self.codes):]
        return out

    def table(self, tree: Tree, rate: float, l2: float) -> list[tuple]:
        """(node, feature, threshold, left levels, left, right, value) of every node."""
        all_edges = [*[self.lag_edges] * self.n_lags, *self.edges]
        rows = []
        for node, (value, feature) in enumerate(zip(tree.values(rate, l2).tolist(), tree.feature)):
            threshold, levels = 0.0, None
            if feature >= len(all_edges):
                threshold = float("-inf")
                levels = np.flatnonzero(tree.goes_left[node]).astype(float).tolist()
            elif feature >= 0:
                # the last bin has no upper edge
                last = int(np.flatnonzero(tree.goes_left[node])[-1])
                threshold = all_edges[feature][last] if last < len(all_edges[feature]) else float("inf")
            rows.append((node, feature, threshold, levels, tree.left[node], tree.right[node], value))
        return rows


def binning(rows: DataFrame, design: Design, max_bins: int) -> Binning:
    """Edges at quantiles. Lags are earlier values of ``y``, so those of y serve them all: 0 and
    quantiles of the positive values."""
    at = [i / (max_bins - 1) for i in range(1, max_bins - 1)]

    def quantiles(c: Column) -> Column:
        return F.percentile_approx(c.cast("double"), at, _NUMBERS)

    asked = [quantiles(F.when(F.col("y") > 0, F.col("y"))).alias("y"),
             *[quantiles(F.coalesce(F.col(c), F.lit(0.0))).alias(f"n{i}") for i, c in enumerate(design.numeric)]]
    found = rows.agg(*asked).first() if design.n_lags or design.numeric else None
    lag_edges = tuple(sorted({0.0, *(found["y"] or [])})) if design.n_lags else ()
    edges = [tuple(sorted(set(found[f"n{i}"] or [0.0]))) for i in range(len(design.numeric))]
    codes = tuple(len(design.shown_levels(f)) + 1 for f in design.factors)
    return Binning(design.n_lags, lag_edges, (*edges, *[(0.0,)] * len(edges)), codes)


_BLOCK = ("cluster int, block int, n int, bins binary, y binary, row binary, held binary, "
          "f binary, log string")


def make_blocks(rows: DataFrame, how: Binning, bases: dict[int, float],
                blocks: dict[int, int]) -> DataFrame:
    """Blocks of bins from rows (cluster, row, y, held, x), dealt by the hash ``row`` over the
    number of ``blocks`` of their cluster and ordered by it."""
    width, dtype = how.n_features, how.dtype

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            binned = how.bins(x)
            cluster, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "row"))
            share = np.array([blocks[c] for c in cluster.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cluster"), pa.array((row % share).astype(np.int32)), batch.column("row"),
                 batch.column("y"), batch.column("held"), pa.array([r.tobytes() for r in binned], pa.binary())],
                names=["cluster", "block", "row", "y", "held", "bins"])

    def stack(table: pa.Table) -> pa.Table:
        row, y, held = (table.column(c).to_numpy() for c in ("row", "y", "held"))
        joined = np.frombuffer(b"".join(table.column("bins").to_pylist()), dtype).reshape(-1, width)
        order = np.lexsort((y, row))
        cluster = table.column("cluster")[0].as_py()
        cells = [np.ascontiguousarray(joined[order].T), y[order], row[order], held[order].astype(bool),
                 np.full(len(y), bases[cluster])]
        return pa.table({
            "cluster": pa.array([cluster], pa.int32()),
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "n": pa.array([len(y)], pa.int32()),
            **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("bins", "y", "row", "held", "f"), cells)},
            "log": pa.array([None], pa.string())})

    binned = rows.select("cluster", "row", "y", "held", "x").mapInArrow(
        bin_rows, "cluster int, block int, row long, y double, held boolean, bins binary")
    return binned.groupBy("cluster", "block").applyInArrow(stack, _BLOCK)


class Block:
    """The arrays of one block."""

    def __init__(self, batch: pa.RecordBatch, i: int, how: Binning):
        def read(column: str, dtype: type) -> np.ndarray:
            return np.frombuffer(batch.column(column)[i].as_py(), dtype)

        self.cluster = batch.column("cluster")[i].as_py()
        self.bins = read("bins", how.dtype).reshape(how.n_features, -1)
        self.y, self.row, self.held = read("y", np.float64), read("row", np.int64), read("held", bool)
        self.f = read("f", np.float64).copy()

    def drawn(self, params: BoostParams, round_: int) -> np.ndarray:
        """Training rows of a round, by a hash of the row and the round."""
        with np.errstate(over="ignore"):
            z = self.row.astype(np.uint64) + np.uint64(params.seed + round_) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        return ~self.held & ((z >> np.uint64(11)).astype(np.float64) < params.row_sample * 2.0 ** 53)

    def errors(self) -> list[float]:
        """Loss and number of training rows, squared error and number of held rows."""
        mean, train = np.exp(self.f), ~self.held
        return [float((mean - self.y * self.f)[train].sum()), int(train.sum()),
                float(((self.y - mean)[self.held] ** 2).sum()), int(self.held.sum())]


# -- steps --------------------------------------------------------------------------


@dataclass
class _Fit:
    """One model while it grows."""

    base: float
    trees: list[list[tuple]] = field(default_factory=list)
    deviance: list[float] = field(default_factory=list)
    rmse: list[float] = field(default_factory=list)

    def record(self, errors: list[float]) -> None:
        loss, n, squared, held = errors
        self.deviance.append(loss / n)
        if held:
            self.rmse.append(sqrt(squared / held))

    @property
    def best(self) -> int:
        return min(range(len(self.rmse)), key=self.rmse.__getitem__) if self.rmse else -1

    def ended(self, params: BoostParams) -> bool:
        done = len(self.deviance)
        return done >= params.rounds or bool(self.rmse) and done - 1 - self.best >= params.patience


def _alone(how: Binning, params: BoostParams, fits: dict[int, _Fit]):
    """Advance models that are one block each by a step, in their tasks."""
    def advance(block: Block) -> list[dict]:
        past, log_ = fits[block.cluster], []
        fit = _Fit(past.base, [], list(past.deviance), list(past.rmse))
        while len(log_) < params.checkpoint_every and not fit.ended(params):
            mean = np.exp(block.f)
            tree, at = grow(block.bins, block.y - mean, mean, block.drawn(params, len(fit.deviance)),
                            how.nominal, how.size, params.depth, params.l2, params.min_rows_per_leaf)
            block.f += tree.values(params.learning_rate, params.l2)[at]
            errors = block.errors()
            fit.record(errors)
            log_.append({"tree": how.table(tree, params.learning_rate, params.l2), "errors": errors})
        return log_

    return advance


def _rewritten(blocks: DataFrame, how: Binning, change) -> DataFrame:
    """The blocks with the scores and the log that ``change(block)`` leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, how)
                logged = change(block)
                one = batch.slice(i, 1)
                columns = {c: one.column(c) for c in one.schema.names}
                columns["f"] = pa.array([block.f.tobytes()], pa.binary())
                columns["log"] = pa.array([json.dumps(logged)], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.mapInArrow(run, _BLOCK)


class _Levels:
    """Growth of models that have several blocks, all of them level by level at once."""

    def __init__(self, blocks: DataFrame, how: Binning, params: BoostParams, first_round: int):
        self.blocks, self.how, self.params, self.first = blocks, how, params, first_round
        # trees grown since the blocks were written, by cluster
        self.pending: dict[int, list[Tree]] = defaultdict(list)

    def scoring(self):
        """Brings the scores of a block up to date, in a task."""
        pending, rate, l2 = dict(self.pending), self.params.learning_rate, self.params.l2

        def scored(block: Block) -> Block:
            for tree in pending.get(block.cluster, ()):
                block.f += tree.values(rate, l2)[tree.descend(block.bins)]
            return block

        return scored

    def splits(self, alive: list[int], growing: dict[int, Tree], slots: dict[int, list[int]],
               round_: int) -> dict[tuple[int, int], tuple]:
        """(cluster, node) to (best split or None, totals) of the nodes in ``slots``."""
        how, params, scored = self.how, self.params, self.scoring()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    block = scored(Block(batch, i, how))
                    nodes, mean = slots[block.cluster], np.exp(block.f)
                    slot = np.full(len(growing[block.cluster].feature), -1)
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[growing[block.cluster].descend(block.bins)]
                    at = np.where(block.drawn(params, round_), at, -1)
                    hist = histograms(block.bins, at, block.y - mean, mean, len(nodes), how.size)
                    sums[block.cluster] = hist + sums.get(block.cluster, 0.0)
            for cluster, hist in sums.items():
                for node, part in zip(slots[cluster], hist):
                    starts = range(0, how.n_features, RANGE)
                    yield pa.RecordBatch.from_pydict({
                        "cluster": pa.array([cluster] * len(starts), pa.int32()),
                        "node": pa.array([node] * len(starts), pa.int32()),
                        "first": pa.array(list(starts), pa.int32()),
                        "hist": pa.array([part[a:a + RANGE].tobytes() for a in starts], pa.binary())})

        def best(table: pa.Table) -> pa.Table:
            first = table.column("first")[0].as_py()
            # a fixed order of the addends gives the same sums again
            parts = sorted(table.column("hist").to_pylist())
            hist = np.sum([np.frombuffer(p) for p in parts], axis=0).reshape(1, -1, how.size, 3)
            nominal = how.nominal[first:first + RANGE]
            split, = best_splits(hist, nominal, params.l2, params.min_rows_per_leaf)
            found = None if split is None else json.dumps([
                split.gain, first + split.feature, np.flatnonzero(split.goes_left).tolist(),
                split.left.tolist(), split.right.tolist()])
            return pa.table({**{c: table.column(c).slice(0, 1) for c in ("cluster", "node", "first")},
                             "total": pa.array([hist[0, 0].sum(axis=0).tolist()], pa.list_(pa.float64())),
                             "split": pa.array([found], pa.string())})

        counted = self.blocks.where(F.col("cluster").isin(alive)).mapInArrow(
            count, "cluster int, node int, first int, hist binary")
        rows = counted.groupBy("cluster", "node", "first").applyInArrow(
            best, "cluster int, node int, first int, total array<double>, split string").collect()
        out: dict[tuple[int, int], tuple] = {}
        for r in sorted(rows, key=lambda r: r["first"]):
            total, old = out.get((r["cluster"], r["node"]), (tuple(r["total"]), None))
            new = json.loads(r["split"]) if r["split"] else None
            better = new if old is None or new is not None and new[0] > old[0] else old
            out[r["cluster"], r["node"]] = total, better
        return out

    def grow(self, alive: list[int], round_: int) -> dict[int, Tree]:
        growing = {c: Tree() for c in alive}
        for tree in growing.values():
            tree.add((0.0, 0.0, 0.0))
        open_ = {c: [0] for c in alive}
        for level in range(self.params.depth):
            asked = [c for c in alive if open_[c]]
            if not asked:
                break
            found = self.splits(asked, growing, open_, round_)
            for c in asked:
                tree, nodes = growing[c], []
                for node in open_[c]:
                    total, split = found[c, node]
                    tree.sums[node] = total
                    if split is not None:
                        _, feature, codes, left, right = split
                        goes_left = np.zeros(self.how.size, bool)
                        goes_left[codes] = True
                        nodes += tree.split(node, feature, goes_left, left, right)
                open_[c] = [n for n in nodes if tree.sums[n][2] >= 2 * self.params.min_rows_per_leaf]
        return growing

    def errors(self, alive: list[int]) -> dict[int, list[float]]:
        how, scored = self.how, self.scoring()

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = scored(Block(batch, i, how))
                    yield pa.RecordBatch.from_pydict({
                        "cluster": pa.array([block.cluster], pa.int32()),
                        **{c: pa.array([float(v)]) for c, v in zip("abcd", block.errors())}})

        sums = [F.sum(c).alias(c) for c in "abcd"]
        measured = self.blocks.where(F.col("cluster").isin(alive)).mapInArrow(
            measure, "cluster int, a double, b double, c double, d double")
        return {r["cluster"]: [r["a"], int(r["b"]), r["c"], int(r["d"])]
                for r in measured.groupBy("cluster").agg(*sums).collect()}

    def advance(self, fits: dict[int, _Fit], alive: list[int]) -> DataFrame:
        """A step of all models; the blocks with their new scores, the log at block 0."""
        p, how, logs = self.params, self.how, defaultdict(list)
        fits = {c: _Fit(fits[c].base, [], list(fits[c].deviance), list(fits[c].rmse)) for c in alive}
        every = list(alive)
        for k in range(p.checkpoint_every):
            alive = [c for c in alive if not fits[c].ended(p)]
            if not alive:
                break
            grown = self.grow(alive, self.first + k)
            for c, tree in grown.items():
                self.pending[c].append(tree)
            for c, errors in self.errors(alive).items():
                fits[c].record(errors)
                logs[c].append({"tree": how.table(grown[c], p.learning_rate, p.l2), "errors": errors})

        scored, logs = self.scoring(), dict(logs)

        def finish(block: Block) -> list[dict]:
            scored(block)
            return logs[block.cluster]

        return _rewritten(self.blocks.where(F.col("cluster").isin(every)), how, finish)


def _fit(rows: DataFrame, design: Design, params: BoostParams, state: str | None) -> dict[int, _Fit]:
    """Models of all clusters with a positive mean, from rows (cluster, row, y, held, x and the
    numeric columns). ``state`` names a folder that keeps the steps; a fit that finds some goes on."""
    spark = rows.sparkSession
    root = state or scratch_path(spark, "boosting")
    # written once for the means, the edges and the bins
    prepared = f"{root}/rows"
    if not exists(spark, f"{prepared}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(prepared)
    rows = spark.read.parquet(prepared)
    bases, sizes = _summary(rows)
    fits = {c: _Fit(base) for c, base in bases.items()}

    def place(what: str, step: int) -> str:
        return f"{root}/{what}-{step}"

    def logged(step: int) -> None:
        for r in spark.read.parquet(place("log", step)).collect():
            for entry in json.loads(r["log"]):
                fits[r["cluster"]].trees.append([tuple(n) for n in entry["tree"]])
                fits[r["cluster"]].record(entry["errors"])

    meta = f"{root}/bins"
    if exists(spark, f"{meta}/_SUCCESS"):
        kept = json.loads(spark.read.text(meta).first()[0])
        how = Binning(kept["n_lags"], tuple(kept["lag_edges"]), tuple(map(tuple, kept["edges"])),
                      tuple(kept["codes"]))
    else:
        how = binning(rows, design, params.max_bins)
        spark.createDataFrame([(json.dumps(asdict(how)),)], "value string").coalesce(1).write.mode(
            "overwrite").text(meta)
    per_block = max(1, BLOCK_CELLS // how.n_features)
    blocks = {c: -(-n // per_block) for c, n in sizes.items()}
    if not exists(spark, f"{place('blocks', 0)}/_SUCCESS") and not exists(spark, f"{place('log', 1)}/_SUCCESS"):
        known = rows.where(F.col("cluster").isin(list(bases)))
        make_blocks(known, how, bases, blocks).write.mode("overwrite").option(
            "compression", "none").parquet(place("blocks", 0))
    step = 0
    while exists(spark, f"{place('log', step + 1)}/_SUCCESS"):
        step += 1
        logged(step)

    while alive := [c for c, fit in fits.items() if not fit.ended(params)]:
        now = spark.read.schema(_BLOCK).parquet(place("blocks", step)).where(F.col("cluster").isin(alive))
        single = [c for c in alive if blocks[c] == 1]
        many = [c for c in alive if blocks[c] > 1]
        moved = []
        if single:
            moved.append(_rewritten(now.where(F.col("cluster").isin(single)), how,
                                    _alone(how, params, {c: fits[c] for c in single})))
        if many:
            own = now.where(F.col("cluster").isin(many))
            moved.append(_Levels(own, how, params, step * params.checkpoint_every).advance(fits, many))
        table = moved[0].unionByName(moved[1]) if len(moved) == 2 else moved[0]
        table.write.mode("overwrite").option("compression", "none").parquet(place("blocks", step + 1))
        written = spark.read.schema(_BLOCK).parquet(place("blocks", step + 1))
        written.groupBy("cluster").agg(F.min_by("log", "block").alias("log")).coalesce(1).write.mode(
            "overwrite").parquet(place("log", step + 1))
        discard(spark, place("blocks", step))
        step += 1
        logged(step)
    if state is None:
        discard(spark, root)
    return fits


def _prepared(rows: DataFrame, design: Design, cluster: Column, held: Column, key: tuple[str, ...]) -> DataFrame:
    """The columns a fit reads."""
    return rows.select(
        cluster.cast("int").alias("cluster"), F.xxhash64(*key).alias("row"),
        F.col("y").cast("double").alias("y"), held.alias("held"), _plain_features(design).alias("x"),
        *[F.col(c).cast("double").alias(c) for c in design.numeric])


def _summary(rows: DataFrame) -> tuple[dict[int, float], dict[int, int]]:
    """Base score and rows of the clusters with a positive mean."""
    found = rows.groupBy("cluster").agg(
        F.avg(F.when(~F.col("held"), F.col("y"))).alias("mean"), F.count("*").alias("n")).collect()
    found = sorted((r for r in found if r["mean"] and r["mean"] > 0), key=lambda r: r["cluster"])
    return {r["cluster"]: log(r["mean"]) for r in found}, {r["cluster"]: r["n"] for r in found}


def _model(fit: _Fit, design: Design, params: BoostParams) -> BoostModel:
    keep = fit.best + 1 if fit.rmse else len(fit.trees)
    return BoostModel(fit.base, design, params, fit.trees[:keep], fit.deviance, fit.rmse)


def fit_boosted_poisson(rows: DataFrame, design: Design, params: BoostParams = BoostParams(),
                        key: tuple[str, ...] = ("id", "d"), validation: DataFrame | None = None,
                        state: str | None = None) -> BoostModel:
    """Boosted trees for counts (y >= 0) on lags, numeric columns and factors.

    Rows are drawn each round by a hash of their key, so a recomputed task draws the same rows
    again. With ``validation`` rows their RMSE is followed; the fit ends after ``patience``
    rounds without improvement and keeps the trees up to the best round. ``state`` names a
    folder for the fit's steps; a fit that was interrupted there is continued.
    """
    marked = rows.withColumn("held", F.lit(False))
    if validation is not None:
        marked = marked.unionByName(validation.withColumn("held", F.lit(True)))
    fits = _fit(_prepared(marked, design, F.lit(0), F.col("held"), key), design, params, state)
    if not fits:
        raise ValueError("boosting needs a positive mean")
    return _model(fits[0], design, params)


def fit_boosted_by_cluster(rows: DataFrame, design: Design, by: str = "cluster_id",
                           params: BoostParams = BoostParams(), holdout_rows: int = 0,
                           state: str | None = None) -> dict:
    """One model per cluster with a positive mean; all grow together (see the module).

    ``holdout_rows`` sets aside that many rows of each cluster, at most a fifth of them, whose
    error ends its fit. ``state`` as in ``fit_boosted_poisson``.
    """
    names = sorted(r[0] for r in rows.select(by).distinct().collect() if r[0] is not None)
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(by))
    if holdout_rows:
        rows = holdout_by(rows, by, holdout_rows, params.seed, ["id", "d"], share=5)
    else:
        rows = rows.withColumn("held", F.lit(False))
    prepared = _prepared(rows.where(F.col(by).isNotNull()), design, number, F.col("held"), ("id", "d"))
    fits = _fit(prepared, design, params, state)
    return {names[c - 1]: _model(fit, design, params) for c, fit in fits.items()}


def predict_boosted(rows: DataFrame, model: BoostModel) -> DataFrame:
    """Add the predicted mean as ``prediction``."""
    scorer = model.scorer()

    @F.pandas_udf("double")
    def mean(features: pd.Series) -> pd.Series:
        return pd.Series(np.exp(scorer.log_mean(np.vstack(features.to_numpy()))))

    return rows.withColumn("prediction", mean(_plain_features(model.design)))


def forecast_boosted(origin: DataFrame, days: DataFrame, models: "BoostModel | dict",
                     scaled: bool = False, by: str | None = None) -> DataFrame:
    """Recursive forecasts -> (id, h, yhat); all steps of all series in one pass.

    ``models`` is one model, or one per value of ``by``; they share a design. A task takes
    batches of series, one row each with lags and the future features, and steps those of one
    model together through numpy. An all-zero series is forecast 0; one without enough lags or
    without a model keeps its steps with a null value.
    """
    fitted = models if isinstance(models, dict) else {None: models}
    spark = origin.sparkSession
    if not fitted:
        raise ValueError("no model was fitted")
    design = next(iter(fitted.values())).design
    scorers = spark.sparkContext.broadcast({k: m.scorer() for k, m in fitted.items()})
    n_lags = design.n_lags
    group = F.col(by) if by else F.lit(None).cast("int")
    steps = collect_steps(origin, days, {"x": _externals(design)}).select(
        "id", group.alias("group"), "lags", "mean", F.col("future.x").alias("future"))
    zero = (F.col("mean") == 0) if scaled else F.lit(False)
    able = F.col("lags").isNotNull() & ~F.exists("lags", lambda v: v.isNull()) & ~zero
    if by:
        able = able & F.coalesce(group.isin(list(fitted)), F.lit(False))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby("group", dropna=False):
                scorer = scorers.value[key if by else None]
                lags = np.vstack(part["lags"].to_numpy())
                future = np.stack([np.vstack(f) for f in part["future"]])
                for h in range(future.shape[1]):
                    yhat = np.exp(scorer.log_mean(np.hstack([lags, future[:, h, :]])))
                    lags = np.hstack([yhat[:, None], lags[:, :n_lags - 1]])
                    out = yhat * part["mean"].to_numpy() if scaled else yhat
                    yield pd.DataFrame({"id": part["id"], "h": h + 1, "yhat": out})

    ready = F.coalesce(able, F.lit(False))
    done = steps.where(ready).mapInPandas(walk, "id string, h int, yhat double")
    value = F.when(F.coalesce(zero, F.lit(False)), F.lit(0.0))
    rest = steps.where(~ready).select(
        "id", F.explode(F.sequence(F.lit(1), F.size("future"))).alias("h"), value.alias("yhat"))
    return done.unionByName(rest).withColumn("yhat", clamp_nonneg("yhat"))


def save_boosted(model: BoostModel, spark: SparkSession, path: str) -> None:
    """Trees as parquet, base score, parameters and design beside them."""
    model.to_table(spark).write.mode("overwrite").parquet(f"{path}/trees")
    meta = {"base": model.base, "params": asdict(model.params), "design": asdict(model.design)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")


def load_boosted(spark: SparkSession, path: str) -> BoostModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    lists = {k: tuple(meta["design"][k]) for k in ("numeric", "aliased")}
    design = Design(**{**meta["design"], **lists})
    model = BoostModel(meta["base"], design, BoostParams(**meta["params"]))
    rows = spark.read.parquet(f"{path}/trees").orderBy("round", "node").collect()
    for row in rows:
        if row["round"] == len(model.trees):
            model.trees.append([])
        model.trees[-1].append(tuple(row)[1:])
    return model
