"""Helpers of the text operators: table access, staging, batch sizes, contiguous groups."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.session import scratch_path, ship_package, stage

__all__ = ["table", "stage", "scratch_path", "small_batches", "batches_of", "contiguous", "ship_package",
           "carried", "ascii_lower", "vocabulary"]

# Rows of one Arrow batch. Whole texts travel in a batch, so the default of 10,000 rows
# would put hundreds of MB into a Python worker.
BATCH_ROWS = 256

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch for this session (never raises the setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for jobs on narrow rows that run within the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(col):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, UPPER.lower())


def carried(docs: DataFrame, keep: list[str], text_col: str):
    """Rows for an Arrow pass that keeps columns, and what reads the texts of a batch.

    ``original`` is a struct of the kept columns, so their names clash with nothing; the text
    travels once, inside it or beside it.
    """
    original = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("original")
    if text_col in keep:
        return docs.select(original), lambda batch: [
            t or "" for t in batch.column(0).field(text_col).to_pylist()]
    return docs.select(original, F.col(f"`{text_col}`").alias("body")), lambda batch: [
        t or "" for t in batch.column(1).to_pylist()]


def contiguous(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of one key each, from batches sorted by ``keys``.

    Holds one group at a time, so callers bound the size of a group before.
    """
    import numpy as np

    pending: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        columns = [t.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        cuts = np.flatnonzero([a != b for a, b in zip(rows, rows[1:])]) + 1
        starts = [0, *cuts.tolist(), len(rows)]
        for a, b in zip(starts, starts[1:]):
            if pending and rows[a] != last:
                yield pa.concat_tables(pending)
                pending = []
            pending.append(t.slice(a, b - a))
            last = rows[a]
    if pending:
        yield pa.concat_tables(pending)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
