"""Near duplicates from an LSH forest of MinHash labels.

A document is the set of its word shingles. Equal sets form one class, so exact copies meet
nothing but their class. A class has one label per tree, a short sequence of MinHash values; the
labels of a tree in sorted order are one signature order of the forest. All orders are sorted in
one range exchange of narrow rows. The candidates of a class are its neighbours in each order, those
with the longest common prefix first: they are taken going away from the class until ``NEIGHBOURS``
are found or the common prefix is shorter than ``START`` values, where similar classes hardly ever
part. So the depth down to which a tree is searched adapts to each region: a crowded one is
searched at its full depth only, a thin one down to ``START``. Candidates are confirmed on the full
sets, unless one bit of each value already tells them apart.

That connects nearly all members of a group. A second round loses nothing: classes that share a prefix
of ``START`` values with more classes than the neighbours covered are a region, and of each region
that still holds several components, the classes outside its largest one are compared with all
others. First with signatures: a block of a region holds signatures in one task, and the classes
outside the main component visit all blocks; pairs that share a prefix in several trees are compared in
the first of these only. Only classes that agree enough with another one take their full sets into the
same kind of visit, bounded in classes and in shingles, where links between components are found.

Visits grow with the square of a region of unlike classes, so a region that asks for more than
``VISITS`` of them is cut finer before. The classes of all such regions rank their shingles from rare
to frequent; sets that reach the threshold share one among the rarest of each, so only classes that
meet at one of these compare signatures. What meets nowhere, as texts that have only frequent
shingles in common, costs the sort of its shingles. Classes that agree enough are grouped by the
chains they form, so a set goes out once however many shingles it met others at.

Pairs whose signatures agree in less than the threshold less ``SLACK`` are not confirmed. With 96
values a pair at the threshold agrees that little with a probability under 1e-6.

Defined cases: null and empty texts have no shingle and are linked with nothing; a text with fewer
words than a shingle is one shingle; a text of any length is read whole; repeated rows share their
class; labels that tie are ordered by a hash of the class; rows with a null id take part, but never
give a component its id unless all its ids are null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.graph import components
from tallycast.llm.shared import batches_of, small_batches, stage

TREES, DEPTH, START = 16, 6, 3
NEIGHBOURS = 4  # going away from a class in one direction of an order
REGION = 2048  # full sets of a block at most
SIGNED = 8192  # signatures of a block
BLOCK_SHINGLES = 2_000_000  # of the sets that a task holds
VISITS = 1 << 26  # pairs of signatures of a region, beyond which its classes meet at rare shingles
SLACK = 0.2
BROADCAST_CLASSES = 100_000  # (key, id) rows, about 100 bytes each, that may be broadcast
PIECE = 1 << 20
NARROW = 8192  # rows of a batch of numbers

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_A = _RANDOM.integers(0, 1 << 64, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 64, TREES * DEPTH, dtype=np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(raw: bytes) -> np.ndarray:
    """Hash of every word of one piece: prefix sums of a polynomial, moved back to the word."""
    b = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[b]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(12, int(len(b)).bit_length())
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[:len(b)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    hashes, at = [], 0
    while at < len(raw):
        stop = at + PIECE
        # a word is never cut: the piece grows to the next space
        while stop < len(raw) and not _SPACE[raw[stop]]:
            stop += 1
        hashes.append(_word_hashes(raw[at:stop]))
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if len(h) == 0:
        return h
    size = min(words, len(h))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        s = _mix(s * _STEP + h[i:len(h) - size + 1 + i])
    return np.unique(s)


def signature(s: np.ndarray) -> bytes:
    """MinHash values of all trees, each cut to 16 bits of a hash of the minimum."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    rows = max(1, 400_000 // len(_A))
    with np.errstate(over="ignore"):
        for i in range(0, len(s), rows):
            part = s[i:i + rows]
            np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(1), out=low)
    return (_mix(low) >> np.uint64(48)).astype("<u2").tobytes()


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc, row (hash of the text), n (shingles), key (of the set, null if empty) and sig, one row
    per row of ``docs``."""
    schema = T.StructType([
        T.StructField("doc", docs.schema[id_col].dataType), T.StructField("row", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("key", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text or "", words)
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.binary())], names=["doc", "row", "n", "key", "sig"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"),
                       F.xxhash64(text_col).alias("row")).mapInArrow(run, schema)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


_ORDER = "region long, rest long, number long, n long, bits long, more_bits long"


def orders(classes: DataFrame) -> DataFrame:
    """One narrow row per class and tree, in the order of each tree's labels: region (the tree and the
    first ``START`` values of its label), rest (the others), number (a hash of the class key), n, and
    one bit of each value of the signature.

    Only numbers are exchanged. Classes whose numbers collide are merely compared as well.
    """
    def joined(values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape[:-1], np.int64)
        for i in range(values.shape[-1]):
            out = (out << 16) | values[..., i]
        return out

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(n, TREES, DEPTH)
            tree = np.arange(TREES, dtype=np.int64) << (16 * START)
            bits = np.zeros((n, 16), np.uint8)
            packed = np.packbits((sig & 1).astype(np.uint8).reshape(n, -1), axis=1)
            bits[:, :packed.shape[1]] = packed
            bits = bits.view(np.int64)
            number, size = batch.column("number").to_numpy(), batch.column("n").to_numpy()
            columns = [joined(sig[:, :, :START]) | tree, joined(sig[:, :, START:]),
                       *(np.repeat(c[:, None], TREES, 1) for c in (number, size, bits[:, 0], bits[:, 1]))]
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in columns],
                                             names=["region", "rest", "number", "n", "bits", "more_bits"])

    at = ["region", "rest", "number"]
    rows = classes.select(F.xxhash64("key").alias("number"), "n", "sig").mapInArrow(expand, _ORDER)
    return rows.repartitionByRange(*at).sortWithinPartitions(*at)


def _forest(threshold: float, neighbours: int):
    """Neighbour pairs (a, b), and members (region, a) of regions that may hold more pairs.

    A stream over sorted labels. Common prefixes only shrink going away from a row, so the rows just
    before it are its neighbours by longest common prefix. The last ones are kept for the next
    batch, and the last row waits for its successor. What lies across the edge of a partition is
    left to the second round, so regions at an edge are always passed on.
    """
    share = (1 - threshold) / 2  # of the bits that differ at the threshold
    most = int(TREES * DEPTH * share + 6 * np.sqrt(TREES * DEPTH * share * (1 - share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(batch):
            region, number, size, bits, more = (
                batch.column(c).to_numpy() for c in ("region", "number", "n", "bits", "more_bits"))
            return [region, number, size, np.column_stack([bits, more]).view(np.uint64)]

        def pairs(region, number, size, bits, new: int):
            """Of rows from ``new`` on with the rows before them."""
            a, b = [], []
            for k in range(1, neighbours + 1):
                i = np.arange(max(new, k), len(region))
                i = i[region[i] == region[i - k]]
                small, large = np.minimum(size[i], size[i - k]), np.maximum(size[i], size[i - k])
                i = i[(small >= threshold * large) & (number[i] != number[i - k])]
                apart = np.bitwise_count(bits[i] ^ bits[i - k]).sum(1)
                i = i[apart <= most]
                a.append(number[i])
                b.append(number[i - k])
            return np.concatenate(a), np.concatenate(b)

        def out(region, a, b, edge):
            return pa.RecordBatch.from_arrays([
                pa.array(region, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                pa.array(edge, pa.bool_())], names=["region", "a", "b", "edge"])

        held, first = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            now, new = columns(batch), 0
            first = int(now[0][0]) if first is None else first
            if held is not None:
                new = len(held[0])
                now = [np.concatenate([x, y]) for x, y in zip(held, now)]
            a, b = pairs(*now, new)
            if len(a):
                none = [None] * len(a)
                yield out(none, np.minimum(a, b), np.maximum(a, b), none)
            # all rows but the last one have their successor now
            region, number = now[0], now[1]
            i = np.arange(max(new - 1, 0), len(region) - 1)
            edge = region[i] == first
            shared = (region[i] == region[i + 1]) | ((i > 0) & (region[i] == region[np.maximum(i - 1, 0)]))
            i, edge = i[shared | edge], edge[shared | edge]
            if len(i):
                yield out(region[i], number[i], [None] * len(i), edge)
            held = [c[-max(neighbours, 2):] for c in now]
        if held is not None:
            yield out(held[0][-1:], held[1][-1:], [None], [True])
    return run


_PAIR = "a binary, b binary"


def _pairs(found: set) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()),
                                       pa.array([b for _, b in found], pa.binary())], names=["a", "b"])


def _survivors(floor: float, ratio: float, once: bool = True):
    """Keys of a region whose signature agrees enough with that of a class in another component.

    ``once``: regions are prefixes in trees, and a pair that shares several counts in the first one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block = None, None, None

        def fresh():
            return [[], [], [], []]

        def done(marks):
            hit = np.flatnonzero(marks)
            return [(place[0], block[0][i]) for i in hit.tolist()]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()),
                                               pa.array([k for _, k in found], pa.binary())], names=["region", "key"])

        names = ("region", "block", "role", "key", "comp", "n", "sig")
        for batch in batches:
            found = []
            columns = {c: batch.column(c).to_pylist() for c in names}
            for *group, role, key, comp, n, sig in zip(*(columns[c] for c in names)):
                if group != place:
                    if block is not None:
                        found += done(block[4])
                    place, held, block = group, fresh(), None
                if role == 0:
                    for have, new in zip(held, (key, comp, n, sig)):
                        have.append(new)
                    continue
                if not held[0]:
                    continue
                if block is None:
                    comps = {c: i for i, c in enumerate(dict.fromkeys(held[1]))}
                    block = (held[0], np.array([comps[c] for c in held[1]]), np.array(held[2]),
                             np.frombuffer(b"".join(held[3]), "<u2").reshape(len(held[0]), -1),
                             np.zeros(len(held[0]), bool), comps)
                keys, own, sizes, sigs, marks, comps = block
                one = np.frombuffer(sig, "<u2")
                near = (own != comps.get(comp, -1)) & (np.minimum(sizes, n) >= ratio * np.maximum(sizes, n))
                at = np.flatnonzero(near)
                equal = sigs[at] == one
                agree = equal.mean(1) >= floor
                at, equal = at[agree], equal[agree]
                if once and len(at):
                    # a pair belongs to the first tree in which it shares a prefix
                    starts = equal.reshape(len(at), TREES, DEPTH)[:, :, :START].all(2)
                    at = at[starts.argmax(1) == group[0] >> (16 * START)]
                if len(at):
                    marks[at] = True
                    found.append((group[0], key))
            if found:
                yield batch_of(found)
        if block is not None and (found := done(block[4])):
            yield batch_of(found)
    return run


class _Sets:
    """The full sets of a block; others are compared with all of them at once."""

    def __init__(self, keys: list, comps: list, sets: list[bytes]):
        self.keys, self.comps = keys, comps
        parts = [np.frombuffer(x, np.uint64) for x in sets]
        self.sizes = np.array([len(x) for x in parts])
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        self.owners = np.repeat(np.arange(len(parts)), self.sizes)[order]
        self.values, self.starts = np.unique(every[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(every))

    def similar(self, raw: bytes, percent: int) -> np.ndarray:
        """Numbers of the sets that reach the threshold with the given one."""
        x = np.frombuffer(raw, np.uint64)
        at = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        at = at[self.values[at] == x]
        if len(at) == 0:
            return at
        size = self.ends[at] - self.starts[at]
        jump = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        shared = np.bincount(self.owners[jump + np.arange(len(jump))], minlength=len(self.keys))
        return np.flatnonzero(100 * shared >= percent * (len(x) + self.sizes - shared))


def _bridges(threshold: float):
    """Links between different components: of each visitor to every component it reaches."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block, root = None, ([], [], []), None, {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for batch in batches:
            found = set()
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for *group, role, key, comp, members in zip(*(columns[c] for c in (
                    "region", "block", "role", "key", "comp", "members"))):
                if group != place:
                    place, held, block, root = group, ([], [], []), None, {}
                if role == 0:
                    for have, new in zip(held, (key, comp, members)):
                        have.append(new)
                    continue
                if not held[0]:
                    continue
                block = block or _Sets(*held)
                for y in block.similar(members, percent).tolist():
                    a, b = find(comp), find(block.comps[y])
                    if a != b:
                        root[b] = a
                        found.add(_pair(key, block.keys[y]))
            yield _pairs(found)
    return run


def _pair(a, b):
    return (a, b) if a < b else (b, a)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """key, members (sorted 64-bit hashes) for the classes in ``wanted`` (key, doc), staged.

    A counted, small ``wanted`` goes to the texts; otherwise texts are shuffled by id.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("doc"))).select("key", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text or "", words)
                if len(s) and _key(s) == key:  # rows that share their id may differ in text
                    keys.append(key)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                                             names=["key", "members"])

    found = texts.mapInArrow(run, "key binary, members binary")
    return stage(found.groupBy("key").agg(F.first("members").alias("members")), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets reach the threshold: 100 x intersection >= 100 t x union."""
    percent = round(100 * threshold)
    left = sets.select(F.col("key").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("members").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            found = set()
            for i in range(len(a)):
                p, q = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                shared = len(p) + len(q) - len(np.union1d(p, q))
                if 100 * shared >= percent * (len(p) + len(q) - shared):
                    found.add((a[i], b[i]))
            yield _pairs(found)

    return both.mapInArrow(run, _PAIR)


def find_links(docs: DataFrame, classes: DataFrame, words: int, threshold: float, region: int,
               id_col: str, text_col: str, neighbours: int | None = None) -> DataFrame | None:
    """(node, label) of the classes that have a link."""
    floor, ratio, neighbours = threshold - SLACK, threshold, neighbours or NEIGHBOURS
    numbered = classes.select(F.xxhash64("key").alias("number"), "key", "doc", "n", "sig")
    with batches_of(docs.sparkSession, NARROW):
        walked = stage(orders(classes).mapInArrow(
            _forest(threshold, neighbours), "region long, a long, b long, edge boolean"), "forest")
    near = walked.where("b IS NOT NULL").select("a", "b").distinct()
    keys = numbered.select("number", "key")
    pairs = stage(near.join(keys.withColumnsRenamed({"number": "a", "key": "key_a"}), "a")
                  .join(keys.withColumnsRenamed({"number": "b", "key": "key_b"}), "b")
                  .select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
                  .where("a < b").distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = stage(wanted.join(classes.select("key", "doc"), "key"), "wanted")
    links = stage(confirm(pairs, full_sets(docs, wanted, words, id_col, text_col), threshold), "links")
    labels = components(links)

    # second round: regions with more classes than the neighbours covered, and several components
    members = walked.where("region IS NOT NULL").groupBy("region", F.col("a").alias("number")).agg(
        F.max("edge").alias("edge"))
    sizes = members.groupBy("region").agg(F.count("*").alias("size"), F.max("edge").alias("edge"))
    # staged, as other small sides below, so that a crowded region is split in the join
    crowded = stage(sizes.where((F.col("size") > 1) & (F.col("edge") | (F.col("size") > neighbours + 1)))
                    .select("region"), "crowded")
    placed = stage(members.select("region", "number").join(crowded, "region")
                   .join(keys, "number").join(labels.withColumnRenamed("node", "key"), "key", "left")
                   .select("region", "key", F.coalesce("label", "key").alias("comp")), "regions")
    open_ = stage(_open(placed), "open")
    many = F.col("visits") > VISITS
    signed = numbered.select("key", "n", "sig")
    alike = stage(_agreeing(open_.where(~many), signed, floor, ratio), "alike")
    more = []
    if alike.limit(1).count():
        wanted = stage(alike.select("key").distinct().join(classes.select("key", "doc"), "key"), "wanted")
        sets = full_sets(docs, wanted, words, id_col, text_col)
        more.append(_links_between(open_.join(alike, ["region", "key"]), sets, threshold, region))
    pool = stage(open_.where(many).select("key", "comp").distinct(), "pool")
    if pool.limit(1).count():
        wanted = stage(pool.select("key").join(classes.select("key", "doc"), "key"), "wanted")
        sets = full_sets(docs, wanted, words, id_col, text_col)
        met = stage(_open(stage(_meetings(sets, threshold), "meetings").join(pool, "key")), "open")
        alike = stage(_agreeing(met, signed, floor, ratio, once=False), "alike")
        heads = alike.groupBy("region").agg(F.min("key").alias("a"))
        chains = stage(alike.join(heads, "region").select("a", F.col("key").alias("b")).where(
            "a < b").distinct(), "chains")
        if chains.limit(1).count():
            placed = components(chains).select(F.xxhash64("label").alias("region"),
                                               F.col("node").alias("key")).join(pool, "key")
            more.append(_links_between(stage(_open(placed), "open"), sets, threshold, region))
    for found in more:
        links = links.unionByName(found)
    if links.limit(1).count() == 0:
        return None
    return components(links) if more else labels


def _open(placed: DataFrame) -> DataFrame:
    """Rows (region, key, comp) of the regions that hold several components, with the region's size, the
    ``visits`` of its classes outside the largest component, and whether a row is one of these."""
    share = placed.groupBy("region", "comp").agg(F.count("*").alias("n"))
    split = stage(share.groupBy("region").agg(
        F.count("*").alias("comps"), F.sum("n").alias("size"),
        F.max(F.struct("n", "comp")).alias("main")).where("comps > 1"), "split")
    return placed.join(split, "region").select(
        "region", "size", ((F.col("size") - F.col("main.n")) * F.col("size")).alias("visits"),
        "key", "comp", (F.col("comp") != F.col("main.comp")).alias("minor"))


def _agreeing(open_: DataFrame, signed: DataFrame, floor: float, ratio: float,
              once: bool = True) -> DataFrame:
    """(region, key) of classes whose signature agrees enough with one of another component."""
    return _visits(open_.join(signed, "key"), F.ceil(F.col("size") / SIGNED),
                   ["key", "comp", "n", "sig"]).mapInArrow(
        _survivors(floor, ratio, once), "region long, key binary").distinct()


def _links_between(open_: DataFrame, sets: DataFrame, threshold: float, region: int) -> DataFrame:
    """Links between components of the same region, found on full sets."""
    left = open_.select("region", "key", "comp", "minor").join(sets, "key")
    # shingles of a region decide its blocks
    weight = stage(left.groupBy("region").agg(
        F.count("*").alias("size"), F.sum(F.octet_length("members") / 8).alias("shingles")), "weight")
    many = F.greatest(F.col("size") / region, F.col("shingles") / BLOCK_SHINGLES)
    return stage(_visits(left.join(weight, "region"), F.ceil(many), ["key", "comp", "members"]).mapInArrow(
        _bridges(threshold), _PAIR), "links")


def _meetings(sets: DataFrame, threshold: float) -> DataFrame:
    """(region, key): the shingles at which a class may meet a similar one.

    With t the threshold, sets of n shingles share at least t n with any that reach it. In one order
    of all shingles, their first common one is among the first n - t n + 1 of each. The order goes by
    count; shingles of one class come first and only use up places.
    """
    percent = round(100 * threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "members"))):
                s = np.frombuffer(raw, np.int64)
                first = len(s) - -(-percent * len(s) // 100) + 1
                for i in range(0, len(s), NARROW):
                    part = s[i:i + NARROW]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(part), pa.binary()), pa.array(part),
                         pa.array(np.full(len(part), len(s) - first))],
                        names=["key", "region", "rest"])

    rows = stage(sets.mapInArrow(spread, "key binary, region long, rest long"), "shingles")
    counts = stage(rows.groupBy("region").agg(F.count("*").alias("count")).where("count > 1"), "counts")
    # counted from the frequent end, so shingles of one class need not be there
    from_end = Window.partitionBy("key").orderBy(F.col("count").desc(), F.col("region").desc())
    return rows.join(counts, "region").withColumn("place", F.row_number().over(from_end)).where(
        F.col("place") > F.col("rest")).select("region", "key")


def _visits(rows: DataFrame, blocks, carry: list[str]) -> DataFrame:
    """Rows of a region dealt to its ``blocks`` by key (role 0), and once more to every block for the
    rows outside its main component (role 1); sorted by block."""
    cut = rows.withColumn("blocks", blocks.cast("int"))
    residents = cut.select("region", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"),
                           F.lit(0).alias("role"), *carry)
    visitors = cut.where("minor").select(
        "region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("role"), *carry)
    return residents.unionByName(visitors).repartition("region", "block").sortWithinPartitions(
        "region", "block", "role", "key")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, region: int = REGION,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc, row (hash of the text), n_shingles, group (null without
    shingles), component (smallest id reachable over links, null only if all ids are) and kept
    (the row that gives the component its id)."""
    small_batches(docs.sparkSession)
    rows = stage(sketch(docs, words, id_col, text_col), "sketch")
    classes = stage(rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    labels = find_links(docs, classes, words, threshold, region, id_col, text_col)
    if labels is None:
        named = classes.select("key", F.col("key").alias("group"), F.col("doc").alias("component"))
    else:
        of_class = classes.select("key", "doc").join(
            labels.withColumnRenamed("node", "key"), "key", "left").select(
            "key", "doc", F.coalesce("label", "key").alias("group"))
        least = of_class.groupBy("group").agg(F.min("doc").alias("component"))
        named = stage(of_class.join(least, "group").select("key", "group", "component"), "named")
    # a class that a third of all rows belong to is split by the adaptive skew join
    joined = rows.select("doc", "row", "n", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc")).otherwise(F.col("component"))
    return joined.select("doc", "row", F.col("n").alias("n_shingles"), "group",
                         component.alias("component"), F.col("doc").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that with the smallest id; rows without shingles stay."""
    found = stage(near_duplicates(docs, words, threshold, id_col=id_col, text_col=text_col).where(
        "kept").select("doc", "row", "group"), "kept")
    picked = found.where(F.col("group").isNotNull()).groupBy("group").agg(
        F.min(F.struct("doc", "row")).alias("p")).select("p.doc", "p.row")
    alone = found.where(F.col("group").isNull()).select("doc", "row").distinct()
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("original"),
                       F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    stay = left.join(picked.unionByName(alone), F.col("id").eqNullSafe(F.col("doc"))
                     & (F.col("hash") == F.col("row")), "left_semi")
    repeated = found.where(F.col("group").isNotNull()).groupBy("doc", "row").count().where("count > 1")
    if repeated.limit(1).count():
        # whole rows were repeated: number them and keep the first
        again = Window.partitionBy("id", "hash").orderBy(F.lit(0))
        some = stage(repeated.select("doc", "row"), "repeated")
        on = F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("row"))
        once = stay.join(some, on, "left_semi").withColumn("n", F.row_number().over(again)).where("n = 1")
        stay = stay.join(some, on, "left_anti").unionByName(once.drop("n"))
    return stay.select("original.*")


def report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, words=2)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles",
                        F.col("component").alias("component_id"), "kept")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || chr(10) || w[i + 1]))
    END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id,
       r.component_id = s.doc_id AS kept
FROM sets s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r
  ON r.node = s.doc_id"""
