"""Registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallycast.llm import (
    decontaminate,
    exact_dedup,
    lang_id,
    line_dedup,
    near_dup,
    packing,
    periodic,
    pii,
    quality,
    resample,
    secret_scan,
    token_counts,
    vectors,
)
from tallycast.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


@_register("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@_register("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"))


@_register("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"))


@_register("op4_minhash", near_dup.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(table(spark, sf_dir, "documents"))


@_register("op5_lang_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.report(table(spark, sf_dir, "documents"))


@_register("op6_line_dedup", line_dedup.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


@_register("op7_embedding_dedup", vectors.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.report(table(spark, sf_dir, "embeddings"))


@_register("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register("op9_decontamination", decontaminate.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "benchmark"))


@_register("op10_secret_scan", secret_scan.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


@_register("op11_resampling", resample.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register("op12_exact_dedup", exact_dedup.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


@_register("op13_periodic_runs", periodic.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))
