"""From documents to packed sequences: five stages, each written before the next one reads it.

Every stage but the last returns the columns of its input, whatever they are, so extra columns
survive. Null and empty texts are scored like any other text and never crash a stage; texts of any
length are read whole; repeated rows are separate rows for every stage but the third, which keeps one
of them; ties there go to the smallest id; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm import decontaminate, line_dedup, near_dup, packing, quality
from tallycast.llm.shared import ship_package, stage, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose score reaches the threshold.

    The model learns from the labelled documents of the source table outside the held-out part.
    """
    ship_package(spark)
    source, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(source, labels, ~quality.held_out())
    scored = quality.score(docs, model)
    return scored.where(F.col("score") >= quality.THRESHOLD).select("original.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: texts without repeated lines; ``n_chars`` follows the text."""
    done = line_dedup.dedup(docs)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col(f"original.`{c}`")).alias(c) for c in docs.columns])


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near duplicates, the one with the smallest id.

    Shingles of five words, similarity 0.8. Of rows that share that id one stays.
    """
    ship_package(spark)
    return near_dup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents without a benchmark passage."""
    ship_package(spark)
    found = decontaminate.hit_rows(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.col("n_hit") == 0).select("original.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents that are left, in sequences of at most 1024 ids."""
    ship_package(spark)
    return packing.report(docs)


STAGES = [
    ("quality", keep_good),
    ("line dedup", drop_lines),
    ("near duplicates", keep_first),
    ("decontamination", drop_benchmark),
    ("packing", packed),
]
# a random field, MinHash and a tokenizer are beyond SQL; tests/llm compares the stages by force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
