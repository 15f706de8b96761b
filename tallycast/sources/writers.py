"""Sinks. Each result is written by one job; partitions replace appended files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tallycast.session import exists

# Spark's readers skip names that begin with an underscore.
_MANIFEST = "_finished"


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Overwrite ``path``; CSV gets a header."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_forecasts(df: DataFrame, path: str, by: str = "cluster_id") -> None:
    """Write forecasts partitioned by ``by``, replacing only the partitions in ``df``.

    Running it once per cluster (or model) fills the target piece by piece; running it
    again for one piece replaces that piece and leaves the others.
    """
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(by).parquet(path)
    )


def finished_pieces(spark: SparkSession, path: str) -> set[str]:
    """Keys whose rows are complete at ``path``, by its manifest."""
    manifest = f"{path}/{_MANIFEST}"
    if not exists(spark, manifest):
        return set()
    return {r["piece"] for r in spark.read.schema("piece string").parquet(manifest).collect()}


def write_missing(spark: SparkSession, path: str, pieces: Iterable, make: Callable[[list], DataFrame],
                  by: str = "cluster_id", at_once: int = 8) -> list:
    """Write the rows of all ``pieces`` (values of ``by``) that are not finished yet.

    ``make(pieces)`` gives the rows of some pieces; ``at_once`` of them are written by one job and
    then entered in a manifest beside the data. A run that was interrupted leaves its finished
    pieces as they are; the next one makes only what is missing and replaces what an unfinished
    job may have left of it. Returns the pieces made by this run. The manifest has one short row
    per piece and is hidden from readers of ``path``.
    """
    done = finished_pieces(spark, path)
    missing = [p for p in pieces if str(p) not in done]
    for start in range(0, len(missing), at_once):
        some = missing[start:start + at_once]
        write_forecasts(make(some), path, by)
        spark.createDataFrame([(str(p),) for p in some], "piece string").coalesce(1).write.mode(
            "append").parquet(f"{path}/{_MANIFEST}")
    return missing


def write_score_inputs(root: str, period: str, **tables: DataFrame) -> None:
    """Store the scorer's inputs for one period (see ``load_score_inputs``)."""
    from pyspark.sql import functions as F

    for name, df in tables.items():
        write_forecasts(df.withColumn("period", F.lit(period)), f"{root}/{name}", by="period")
