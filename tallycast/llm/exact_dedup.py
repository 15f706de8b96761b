"""Exact duplicates by sorting contents.

Texts are range-partitioned by splitters that Spark samples from (head, hash, id, row) and sorted
within partitions by (head, hash, whole text, id), externally where a partition exceeds memory.
Equal texts are then neighbours, and a stream over each partition compares every text with the one
before it in full. The splitters hold the first ``HEAD`` characters only, so no whole text reaches
the driver; since id and row are part of them, copies of one text that make up a third of the table
spread over as many partitions as their size asks for.

A run of equal texts that lies within one batch of a partition is decided on the spot. The rows of
other runs are joined with their run's totals: narrow rows, at most a partition's rows per run.
A run at either end of its partition may go on in the next one: these runs, two per partition,
bring their whole text and are added up over equal texts.

Defined cases: a null text counts as empty and empty texts are equal; a text of any length is
compared whole; a null id is smaller than any other; of rows that share text and id, one is kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.shared import small_batches, stage

HEAD = 32
_PER_PARTITION = 33  # bits of a run's number within its partition


def unchanged(text: Column) -> Column:
    return text


class _Run:
    """The run of equal texts a stream is in."""

    def __init__(self, number: int, text: bytes, top, edge: bool):
        self.number, self.text, self.top, self.edge, self.size = number, text, top, edge, 0

    def record(self) -> tuple:
        return (None, None, self.number, self.size, self.top,
                hashlib.sha256(self.text).hexdigest(), self.text if self.edge else None)


def _neighbours(schema: pa.Schema):
    """Batches of (id, body) in content order to decided rows, open rows and open runs."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(records: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*records), schema)], schema=schema)

        number = (TaskContext.get().partitionId() << _PER_PARTITION) - 1
        run = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, body = batch.column(0).to_pylist(), batch.column(1)
            new = np.ones(batch.num_rows, bool)
            new[0] = run is None or body[0].as_py() != run.text
            new[1:] = pc.not_equal(body.slice(1), body.slice(0, len(body) - 1)).to_numpy(False)
            cuts = np.unique([0, *np.flatnonzero(new), len(ids)]).tolist()
            records = []
            for a, b in zip(cuts, cuts[1:]):
                if new[a]:
                    first = run is None
                    if not first:
                        if run.size:  # its rows went out open
                            records.append(run.record())
                    number += 1
                    run = _Run(number, body[a].as_py(), ids[a], first)
                if new[a] and b < len(ids) and not run.edge:
                    digest = hashlib.sha256(run.text).hexdigest()
                    records += [(i, k == 0, None, b - a, run.top, digest, None)
                                for k, i in enumerate(ids[a:b])]
                else:
                    records += [(i, bool(new[a]) and k == 0, run.number, None, None, None, None)
                                for k, i in enumerate(ids[a:b])]
                    run.size += b - a
            yield out(records)
        if run is not None:
            run.edge = True
            yield out([run.record()])
    return stream


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
           normalise: Callable[[Column], Column] = unchanged) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and text_sha256 (of the
    normalised text). ``keep``: whether the ``smallest`` or the ``largest`` id of a group stays."""
    small_batches(docs.sparkSession)
    named = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("body"),
        F.monotonically_increasing_id().alias("row"))
    by_id = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_first()
    content = [F.left(F.col("body"), F.lit(HEAD)), F.xxhash64("body")]
    ordered = (named.repartitionByRange(*content, by_id, "row")
               .sortWithinPartitions(*content, "body", by_id)
               .select("id", F.col("body").cast("binary").alias("body")))

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("first", T.BooleanType()),
        T.StructField("run", T.LongType()), T.StructField("size", T.LongType()),
        T.StructField("top", id_type), T.StructField("sha", T.StringType()),
        T.StructField("edge", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    seen = stage(ordered.mapInArrow(_neighbours(to_arrow_schema(schema)), schema), "content-runs")
    in_run, totalled = F.col("run").isNotNull(), F.col("size").isNotNull()
    decided = seen.where(~in_run).select(
        "id", F.col("top").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("first").alias("kept"), F.col("sha").alias("text_sha256"))

    runs = seen.where(in_run & totalled)
    inner = runs.where(F.col("edge").isNull()).select(
        "run", "size", "sha", F.struct("run", "top").alias("start"))
    over = Window.partitionBy("edge")
    outer = runs.where(F.col("edge").isNotNull()).select(
        "run", F.sum("size").over(over).alias("size"), "sha",
        F.min(F.struct("run", "top")).over(over).alias("start"))
    opened = seen.where(in_run & ~totalled).select("id", "first", "run").join(
        inner.unionByName(outer), "run")
    return decided.unionByName(opened.select(
        "id", F.col("start.top").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("first") & (F.col("run") == F.col("start.run"))).alias("kept"),
        F.col("sha").alias("text_sha256")))


def report(docs: DataFrame) -> DataFrame:
    return groups(docs, keep="largest").withColumnRenamed("id", "doc_id")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
WINDOW same AS (PARTITION BY body)"""
