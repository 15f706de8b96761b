"""Near-duplicate vectors through an inverted multi-index.

Vectors are compared within a label and a length. Equal vectors are one entry that remembers how many
it stands for. Each half of a vector has a codebook of its own; the pairs of codewords are the cells
of a product grid, and every entry lies in the cell of its nearest codewords.

A query walks the cells in multi-sequence order: each half sorts its codewords by what it costs a
linked vector to lie there, and pairs come out by the sum of both costs. To lie at codeword c, a
linked vector must be displaced over the boundary between c and the query's own codeword; the cost
is that distance squared, in units of the spread that displacements have in this direction. Spread
and stop are taken from the data, per length of vectors: a bounded sample of queries is compared
with every vector, their true neighbours give displacements, and pairs of sampled vectors give
further ones of just the threshold's length. A walk stops as soon as the next cell costs more than
what the target share of these displacements needed. So the walk adapts to data that fill few of
their dimensions, where displacements are large along few directions.

Cells lie in chunks of bounded size, row by row of the grid, and a large cell is dealt to chunks of its
own. A query is shipped once to every chunk that holds a cell of its walk, with the list of these
cells, so what is shipped depends on chunks and not on the number of cells. In a chunk a query is
compared with the entries of its cells only, in double precision. Tasks return a count per entry and
the links that join something new within the chunk, not all pairs.

A pair counts for both ends if either end's walk finds it: it is counted for the query, and for the
indexed entry too if that one's own walk does not pass the query's cell.

Defined cases: vectors with null label, null id, null or non-finite components, no component or norm
zero are linked with nothing; vectors of different length never meet; repeated rows (id, label and
vector) are one vector, and different vectors under one id are separate vectors of one node, whose
counts add up; ties do not occur, a pair is linked or not; an empty table gives no rows; other columns
are ignored; codebooks come from at most ``sample`` vectors of a length (smallest hashes).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.graph import components
from tallycast.llm.shared import small_batches, stage

THRESHOLD = 0.93
TARGET_RECALL = 0.9999
SAMPLE = 20_000
SAMPLE_VALUES = 4_000_000  # numbers of the sample, whatever the length of a vector
PROBES = 256  # queries whose true neighbours are looked up, per length
PAIRS = 4_096  # of their neighbours that calibrate a grid
PAIRS_OF_TASK = 256  # of them that a task passes on
CELL = 256  # vectors of a cell that the size of the codebooks aims at, in the largest label
PER_CODE = 16  # sampled vectors a codeword needs
CHUNK = 4_096  # entries that a task holds


def _codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from spread seeds: each next seed is the point farthest from the others."""
    centres = [x[0]]
    far = ((x - x[0]) ** 2).sum(1)
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = _squares(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


class Grid:
    """Two codebooks for vectors of one length, and the walk from a vector over their product."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books, self.limit = (first, second), math.inf
        self.gaps = [np.sqrt(_squares(c, c)) for c in self.books]
        self.spreads = [np.ones_like(g) for g in self.gaps]
        self.width = len(second)

    def _halves(self, x: np.ndarray):
        half = self.books[0].shape[1]
        return x[:, :half], x[:, half:]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Home cell of each row."""
        a, b = (_squares(part, book).argmin(1) for part, book in zip(self._halves(x), self.books))
        return a * self.width + b

    def costs(self, x: np.ndarray) -> list[np.ndarray]:
        """(rows, codewords) of each half: squared distance to the boundary, in units of spread."""
        out = []
        for part, book, gap, spread in zip(self._halves(x), self.books, self.gaps, self.spreads):
            d = _squares(part, book)
            own = d.argmin(1)
            away = (d - d.min(1)[:, None]) / (2 * np.maximum(gap[own], 1e-12))
            cost = (away / spread[own]) ** 2
            cost[np.arange(len(x)), own] = 0
            out.append(cost)
        return out

    def calibrate(self, x: np.ndarray, moves: np.ndarray, target: float) -> None:
        """Spread and stop from displacements ``moves`` of linked vectors that start at ``x``."""
        for i, (part, book, gap) in enumerate(zip(self._halves(moves), self.books, self.gaps)):
            cov = part.T @ part / len(part)
            cross = book @ cov @ book.T
            own = np.diag(cross)
            along = own[:, None] + own[None, :] - 2 * cross
            self.spreads[i] = np.sqrt(np.maximum(along, 0)) / np.maximum(gap, 1e-12) + 1e-9
        cells = self.codes(x + moves)
        a, b = self.costs(x)
        rows = np.arange(len(x))
        needed = a[rows, cells // self.width] + b[rows, cells % self.width]
        self.limit = float(np.quantile(needed, target, method="higher"))

    def walk(self, x: np.ndarray) -> list[np.ndarray]:
        """The cells of each row's walk in multi-sequence order, its home first."""
        visits = []
        for a, b in zip(*self.costs(x)):
            p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            # for each codeword of the first half, how far the second sequence goes before the stop
            far = np.searchsorted(b[q], self.limit - a[p], side="right")
            far = far[a[p] <= self.limit]
            i = np.repeat(np.arange(len(far)), far)
            j = np.arange(far.sum()) - np.repeat(np.cumsum(far) - far, far)
            order = np.argsort(a[p[i]] + b[q[j]], kind="stable")
            visits.append((p[i] * self.width + q[j])[order])
        return visits


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, dim, unit (the vector over its norm) and a 128-bit hash of label and unit, for the
    vectors that can have links."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound)
    # scaled by the largest component first, so that no square overflows or vanishes
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("top", top).where(F.col("top") > 0).withColumn(
        "w", F.transform("v", lambda e: e / F.col("top")))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, e: s + e * e))
    rows = rows.withColumn("norm", norm).select(
        "id", "label", F.size("v").alias("dim"),
        F.transform("w", lambda e: e / F.col("norm") + 0.0).alias("unit"))
    return rows.withColumns({"h1": F.xxhash64("label", "unit"), "h2": F.xxhash64(F.lit(3), "unit", "label")})


def fit_grids(entries: DataFrame, threshold: float, target: float, sample: int, cell: int) -> dict[int, Grid]:
    """A calibrated grid for each length of vectors among the ``entries``.

    The driver sees at most ``sample`` vectors and ``PAIRS`` displacements of a length.
    """
    counts = entries.groupBy("dim", "label").count().groupBy("dim").agg(
        F.max("count").alias("largest"), F.sum("count").alias("n")).collect()
    place = F.xxhash64(F.lit(9), "node")
    grids, taken = {}, {}
    for dim, largest, n in sorted(counts):
        wanted = min(sample, max(256, SAMPLE_VALUES // dim))
        share = min(1.0, 2 * wanted / n)
        near = entries.where((F.col("dim") == dim) & (F.pmod(place, F.lit(1 << 20)) <= int(share * (1 << 20))))
        rows = near.select("node", "label", "unit", place.alias("p")).orderBy("p").limit(wanted).collect()
        x = np.array([r["unit"] for r in rows])
        k = int(min(max(2, math.sqrt(largest / cell)), max(2, len(x) // PER_CODE)))
        half = (dim + 1) // 2
        second = _codebook(x[:, half:], k) if dim > 1 else np.zeros((1, 0))
        grids[dim], taken[dim] = Grid(_codebook(x[:, :half], k), second), (rows, x)
    found = _neighbours(entries, taken, threshold)
    for dim, grid in grids.items():
        rows, x = taken[dim]
        starts, moves = found.get(dim, (x[:0], x[:0]))
        more_starts, more_moves = _random_moves([r["label"] for r in rows], x, threshold)
        starts, moves = np.vstack([starts, more_starts]), np.vstack([moves, more_moves])
        if len(moves):
            grid.calibrate(starts, moves, target)
    return grids


def _random_moves(labels: list, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Displacements to unit vectors at just the threshold, towards other sampled vectors of the
    same label (of any label where there is none): the directions in which the data extend."""
    rng = np.random.default_rng(4)
    by_label: dict = {}
    for i, label in enumerate(labels):
        by_label.setdefault(label, []).append(i)
    at = rng.integers(0, len(x), PAIRS // 2)
    to = np.array([own[int(rng.integers(0, len(own)))] if len(own := by_label[labels[i]]) > 1
                   else int(rng.integers(0, len(x))) for i in at.tolist()])
    start, aim = x[at], x[to]
    # the part of the aim across the start, so that the angle is just the threshold's
    across = aim - (aim * start).sum(1)[:, None] * start
    size = np.sqrt((across ** 2).sum(1))
    some = size > 1e-6
    start, across = start[some], across[some] / size[some, None]
    return start, threshold * start + math.sqrt(1 - threshold ** 2) * across - start


def _neighbours(entries: DataFrame, taken: dict, threshold: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, starts and displacements of true neighbours of the first ``PROBES`` sampled
    vectors, found by comparing these with every entry; at most ``PAIRS``, those with the smallest
    hashes, and ``PAIRS_OF_TASK`` from a task."""
    probes = {dim: ([r["label"] for r in rows[:PROBES]], np.array([r["node"] for r in rows[:PROBES]]), x[:PROBES])
              for dim, (rows, x) in taken.items()}
    shipped = entries.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            node, label, dims = (batch.column(c).to_pylist() for c in ("node", "label", "dim"))
            for dim in set(dims):
                rows = [i for i, d in enumerate(dims) if d == dim]
                y = _lists(batch.column("unit"), rows, dim)
                labels, nodes, x = shipped.value[dim]
                near = (y @ x.T >= threshold) & (np.array([node[i] for i in rows])[:, None] != nodes[None, :])
                own = kept.setdefault(dim, [])
                for i, j in zip(*(c.tolist() for c in np.nonzero(near))):
                    if label[rows[i]] == labels[j]:
                        place = hash((node[rows[i]], j)) * 0x9E3779B97F4A7C15 % (1 << 61)
                        own.append((place, j, y[i] - x[j]))
                kept[dim] = sorted(own, key=lambda m: m[:2])[:PAIRS_OF_TASK]
        rows = [(dim, p, j, move.tolist()) for dim, own in kept.items() for p, j, move in own]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)],
                                         names=["dim", "place", "probe", "move"])

    met = entries.select("node", "label", "dim", "unit").mapInArrow(
        run, "dim int, place long, probe int, move array<double>")
    first = F.row_number().over(Window.partitionBy("dim").orderBy("place", "probe"))
    rows = met.withColumn("i", first).where(F.col("i") <= PAIRS).collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r["dim"], []).append((r["probe"], r["move"]))
    return {dim: (probes[dim][2][[p for p, _ in own]], np.array([m for _, m in own]))
            for dim, own in found.items()}


def _lists(column: pa.Array, rows: list[int], dim: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _place(entries: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """Adds the home cell and the walk, as the visited ``groups`` of grid rows with their cells.

    ``parts`` says into how many groups the grid rows of a label are cut.
    """
    shipped = entries.sparkSession.sparkContext.broadcast(grids)
    schema = T.StructType([
        entries.schema["node"], entries.schema["label"], entries.schema["dim"], entries.schema["n"],
        T.StructField("x", T.BinaryType()), T.StructField("home", T.IntegerType()),
        T.StructField("home_group", T.IntegerType()),
        T.StructField("walk", T.ArrayType(T.StructType([
            T.StructField("group", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])))])
    walk_type = pa.list_(pa.struct([("group", pa.int32()), ("cells", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dims, parts = batch.num_rows, batch.column("dim").to_pylist(), batch.column("parts").to_pylist()
            x, home, group, walk = [None] * n, [0] * n, [0] * n, [None] * n
            for dim in set(dims):
                rows = [i for i, d in enumerate(dims) if d == dim]
                own, grid = _lists(batch.column("unit"), rows, dim), shipped.value[dim]
                height = len(grid.books[0])
                for i, v, cells in zip(rows, own, grid.walk(own)):
                    groups = cells // grid.width * parts[i] // height
                    x[i], home[i], group[i] = v.tobytes(), int(cells[0]), int(groups[0])
                    walk[i] = [{"group": g, "cells": cells[groups == g].tolist()} for g in dict.fromkeys(groups.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "label", "dim", "n")), pa.array(x, pa.binary()),
                 pa.array(home, pa.int32()), pa.array(group, pa.int32()), pa.array(walk, walk_type)],
                names=["node", "label", "dim", "n", "x", "home", "home_group", "walk"])

    sizes = entries.groupBy("label", "dim").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    return entries.join(sizes, ["label", "dim"]).select(
        "node", "label", "dim", "n", "unit", "parts").mapInArrow(run, schema)


def _chunks(placed: DataFrame) -> DataFrame:
    """label, dim, group, cell, chunk, deals: the chunk of each cell; a cell of over ``CHUNK`` entries has
    a chunk of its own, dealt into ``deals`` parts."""
    cells = placed.groupBy("label", "dim", F.col("home_group").alias("group"), F.col("home").alias("cell")).count()
    upto = Window.partitionBy("label", "dim", "group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    small = F.when(F.col("count") <= CHUNK, F.col("count")).otherwise(0)
    before = F.coalesce(F.sum(small).over(upto), F.lit(0))
    return cells.select(
        "label", "dim", "group", "cell",
        F.when(F.col("count") <= CHUNK, F.floor(before / CHUNK)).otherwise(-1 - F.col("cell")).cast("int").alias("chunk"),
        F.ceil(F.col("count") / CHUNK).cast("int").alias("deals"))


class _Chunk:
    """The entries of a chunk, by cell; queries are compared with those of the cells they visit."""

    def __init__(self, nodes: list[int], n: list[int], x: np.ndarray, cells: list[int],
                 walks: list[list[int]], threshold: float):
        order = np.argsort(np.array(cells), kind="stable")
        self.node, self.n, self.x = np.array(nodes)[order], np.array(n)[order], x[order]
        own = np.array(cells)[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        self.cells = {int(own[a]): slice(a, b) for a, b in zip(starts, [*starts[1:], len(own)])}
        self.walks = [set(walks[i]) for i in order.tolist()]
        self.threshold = threshold
        self.count = np.zeros(len(own), np.int64)
        self.root = np.arange(len(own))
        self._finds: dict[int, np.ndarray] = {}

    def finds(self, cell: int) -> np.ndarray:
        """Which entries walk past ``cell`` themselves."""
        if cell not in self._finds:
            self._finds[cell] = np.array([cell in w for w in self.walks])
        return self._finds[cell]

    def meet(self, nodes: list[int], n: list[int], x: np.ndarray, homes: list[int],
             visits: list[list[int]], out: list) -> None:
        callers: dict[int, list[int]] = {}
        for q, cells in enumerate(visits):
            for c in cells:
                if c in self.cells:
                    callers.setdefault(c, []).append(q)
        hits: dict[int, list[np.ndarray]] = {}
        for cell, queries in callers.items():
            part = self.cells[cell]
            near = x[queries] @ self.x[part].T >= self.threshold
            for r in np.flatnonzero(near.any(1)).tolist():
                hits.setdefault(queries[r], []).append(np.flatnonzero(near[r]) + part.start)
        for q, found in hits.items():
            hit = np.concatenate(found)
            hit = hit[self.node[hit] != nodes[q]]
            if len(hit) == 0:
                continue
            out.append((nodes[q], None, int(self.n[hit].sum())))
            self.count[hit] += n[q] * ~self.finds(homes[q])[hit]
            roots, first = np.unique(self.root[hit], return_index=True)
            out += [(nodes[q], int(self.node[hit[f]]), 0) for f in first]
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]

    def counts(self) -> list:
        return [(int(self.node[i]), None, int(self.count[i])) for i in np.flatnonzero(self.count)]


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """node, other, n: a count for node (other null) or a link (n = 0)."""
    keys = ["label", "dim", "group", "chunk", "deal"]
    columns = [*keys, "role", "node", "n", "x", "home", "cells"]
    dealt = rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out):
            a, b, n = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)],
                                              names=["node", "other", "n"])

        key, held, chunk = None, [], None
        for batch in batches:
            values = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            # groups, and in a group the entries before the queries
            marks = list(zip(*(values[c] for c in (*keys, "role"))))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            out: list = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *group, role = marks[a]
                if group != key:
                    out += chunk.counts() if chunk else []
                    key, held, chunk = group, [[], [], [], [], []], None
                part = [values[c][a:b] for c in ("node", "n", "x", "home", "cells")]
                if role == 0:
                    for have, new in zip(held, part):
                        have.extend(new)
                    continue
                if not held[0]:
                    continue
                if chunk is None:
                    chunk = _Chunk(held[0], held[1], _matrix(held[2]), held[3], held[4], threshold)
                chunk.meet(part[0], part[1], _matrix(part[2]), part[3], part[4], out)
            if out:
                yield batch_of(out)
        if chunk and (out := chunk.counts()):
            yield batch_of(out)

    return dealt.mapInArrow(run, "node long, other long, n long")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL,
                    sample: int = SAMPLE, cell: int = CELL, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component (smallest id reachable over links,
    itself included) and kept."""
    small_batches(vectors.sparkSession)
    everything = vectors.select(F.col(id_col).alias("id"))
    usable = stage(_usable(vectors, id_col, vector_col, label_col), "units")
    if usable.limit(1).count() == 0:
        return everything.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"),
                                 F.lit(True).alias("kept"))
    same = ["h1", "h2"]
    members = stage(usable.select("id", *same).distinct(), "members")
    sizes = members.groupBy(*same).agg(F.count("*").alias("n"))
    entries = stage(usable.groupBy(*same).agg(
        F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit")
    ).join(sizes, same).withColumn("node", F.monotonically_increasing_id()), "entries")
    grids = fit_grids(entries, threshold, target, sample, cell)
    placed = stage(_place(entries, grids), "placed")

    chunks = stage(_chunks(placed), "chunks")
    at = ["label", "dim", "group"]
    own = chunks.withColumnsRenamed({"cell": "home", "group": "home_group"})
    indexed = placed.join(own, ["label", "dim", "home_group", "home"]).select(
        "label", "dim", F.col("home_group").alias("group"), "chunk",
        F.pmod(F.xxhash64("node"), F.col("deals")).cast("int").alias("deal"),
        F.lit(0).alias("role"), "node", "n", "x", "home",
        F.flatten(F.col("walk.cells")).alias("cells"))
    # a group of cells lies in few chunks: the cells of each, and into how many parts it is dealt
    held = chunks.groupBy(*at, "chunk").agg(F.collect_set("cell").alias("of_chunk"), F.max("deals").alias("deals"))
    calls = placed.select("label", "dim", "node", "n", "x", "home", F.explode("walk").alias("w")).select(
        "label", "dim", F.col("w.group").alias("group"), "node", "n", "x", "home", F.col("w.cells").alias("cells"))
    queries = calls.join(held, at).withColumn("cells", F.array_intersect("cells", "of_chunk")).where(
        F.size("cells") > 0).select(
        *at, "chunk", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"),
        F.lit(1).alias("role"), "node", "n", "x", "home", "cells")
    found = stage(_compare(indexed.unionByName(queries), threshold), "found")

    links = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    keyed = stage(members.join(entries.select(*same, "node", "n"), same).select("id", "node", "n"), "keyed")
    # vectors under one id are one node
    least = keyed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top")
    bound = keyed.join(least, "id").where("node > a").select("a", F.col("node").alias("b"))
    labels = components(links.unionByName(bound))
    grouped = keyed.join(labels, "node", "left").select("id", "node", "n", F.coalesce("label", "node").alias("label"))
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("links"))
    smallest = grouped.groupBy("label").agg(F.min("id").alias("component"))
    known = stage(grouped.join(counts, "node", "left").join(smallest, "label").groupBy("id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.min("component").alias("component")), "known")
    joined = everything.join(known, "id", "left")
    component = F.coalesce("component", "id")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                         component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def report(vectors: DataFrame) -> DataFrame:
    found = near_duplicates(vectors)
    return found.select(F.col("id").alias("vec_id"), "n_links",
                        F.col("component").alias("component_id"), "kept")


SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id,
       component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON a = e.vec_id LEFT JOIN least ON node = e.vec_id"""
