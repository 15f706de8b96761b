"""Bounded-space packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows. A document's ids are cut into full windows
and a rest; the rest goes best-fit into the open window it fills most. When none has room, the
fullest is emitted, filled up by the head of the rest unless that head would be a sliver. The
windows still open when a partition ends are its leftovers; they meet in groups of a fixed number
of partitions and are merged, pieces being cut, until one window per group is not full.

Memory in a task is the open windows; leftovers of a group are at most
``group`` x ``open_windows`` windows. Defined cases: a null or empty text is its end id alone;
a null document id is kept; repeated rows are packed each; of windows that fill equally the first
opened is taken; an empty table gives no piece; other columns are ignored; a document of any
length is cut, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.shared import contiguous, small_batches, stage
from tallycast.llm.tokens import BYTE_BPE, encoder

WINDOW = 1024
OPEN_WINDOWS = 32
MIN_HEAD = 8  # a cut leaves no piece shorter than this
GROUP = 32  # partitions whose leftovers are merged together
END_ID = 0
# ids of windows: 2**33 per partition
_PER_PARTITION = 33

PIECE = ["doc", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open"]


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, size: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:size], self.total),
                Piece(self.doc, self.start + size, self.ids[size:], self.total))


class Window:
    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece.ids)


class Packer:
    """Best-fit over a bounded number of open windows; ``emit`` takes a closed one."""

    def __init__(self, size: int, open_windows: int, emit: Callable[[Window], None]):
        self.size, self.limit, self.emit, self.open = size, open_windows, emit, []

    def place(self, doc, ids: np.ndarray) -> None:
        piece = Piece(doc, 0, ids, len(ids))
        while len(piece.ids) >= self.size:
            full = Window()
            if len(piece.ids) == self.size:
                full.add(piece)
                self.emit(full)
                return
            head, piece = piece.cut(self.size)
            full.add(head)
            self.emit(full)
        while True:
            need = len(piece.ids)
            best = max((w for w in self.open if self.size - w.used >= need),
                       key=lambda w: w.used, default=None)
            if best is None and len(self.open) < self.limit:
                best = Window()
                self.open.append(best)
            if best is not None:
                best.add(piece)
                if best.used == self.size:
                    self.open.remove(best)
                    self.emit(best)
                return
            fullest = max(self.open, key=lambda w: w.used)
            self.open.remove(fullest)
            room = self.size - fullest.used
            if room >= MIN_HEAD and need - room >= MIN_HEAD:
                head, piece = piece.cut(room)
                fullest.add(head)
            self.emit(fullest)


def merge(pieces: list[Piece], size: int) -> list[Window]:
    """Consecutive windows, all full but the last."""
    windows = [Window()]
    for piece in pieces:
        while len(piece.ids) > (room := size - windows[-1].used):
            if room:
                head, piece = piece.cut(room)
                windows[-1].add(head)
            windows.append(Window())
        windows[-1].add(piece)
    return [w for w in windows if w.used]


class _Rows:
    """Collects finished windows as Arrow rows."""

    def __init__(self, id_type: pa.DataType, open_: bool):
        self.id_type, self.open, self.columns = id_type, open_, [[] for _ in range(7)]

    def add(self, window: Window, sequence: int) -> None:
        offset = 0
        for p in window.pieces:
            for column, v in zip(self.columns, (
                    p.doc, p.start, len(p.ids), p.total, sequence, offset,
                    p.ids.astype("<u4").tobytes())):
                column.append(v)
            offset += len(p.ids)

    def batch(self) -> pa.RecordBatch:
        kinds = [self.id_type, *[pa.int64()] * 5, pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(self.columns, kinds)]
        arrays.append(pa.array([self.open] * len(arrays[0]), pa.bool_()))
        self.columns = [[] for _ in range(7)]
        return pa.RecordBatch.from_arrays(arrays, names=PIECE)


def _schema(id_type: T.DataType) -> T.StructType:
    kinds = [id_type, *[T.LongType()] * 5, T.BinaryType(), T.BooleanType()]
    return T.StructType([T.StructField(n, k) for n, k in zip(PIECE, kinds)])


def pack(docs: DataFrame, name: str = BYTE_BPE, window: int = WINDOW,
         open_windows: int = OPEN_WINDOWS, group: int = GROUP,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    Every id of every document, its end id included, lies in exactly one piece; the offsets of
    a sequence have no gap and start at 0; a sequence has at most ``window`` ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType
    schema = _schema(id_type)
    source = docs.select(F.col(id_col).alias("doc"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        sequence = TaskContext.get().partitionId() << _PER_PARTITION
        kind = pa.int64()
        closed: list[Window] = []
        packer = Packer(window, open_windows, closed.append)
        for batch in batches:
            kind = batch.schema.field(0).type
            rows = _Rows(kind, False)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.place(doc, np.append(enc.ids(text), END_ID).astype(np.uint32))
                for w in closed:
                    rows.add(w, sequence)
                    sequence += 1
                closed.clear()
            yield rows.batch()
        rows = _Rows(kind, True)
        for w in packer.open:
            rows.add(w, sequence)
            sequence += 1
        yield rows.batch()

    # the shared folder holds the placement: both branches below read it, nothing is packed twice
    placed = stage(source.mapInArrow(pack_partition, schema), "packed")

    def merge_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in contiguous(batches, ["meeting"]):
            ids = t.column("sequence_id").to_pylist()
            pieces = [
                Piece(doc, start, np.frombuffer(raw, "<u4"), total)
                for doc, start, raw, total in zip(*(t.column(c).to_pylist() for c in (
                    "doc", "start", "ids", "doc_tokens")))
            ]
            rows = _Rows(t.schema.field("doc").type, False)
            # merging never makes more windows than there were: their ids are taken over
            for w, sequence in zip(merge(pieces, window), sorted(set(ids)), strict=False):
                rows.add(w, sequence)
            yield rows.batch()

    leftovers = placed.where("open").withColumn(
        "meeting", F.floor(F.shiftright("sequence_id", _PER_PARTITION) / group))
    merged = leftovers.repartition("meeting").sortWithinPartitions(
        "meeting", "sequence_id", "offset").mapInArrow(merge_group, schema)
    return placed.where(~F.col("open")).unionByName(merged).drop("open")


def report(docs: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids instead of the ids."""
    return pack(docs).select(
        F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")
