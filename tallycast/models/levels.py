"""Factors with very many levels: level tables in place of literals, sparse vectors in place of rows
of zeros.

``Design`` lists its levels in the plan, which suits calendars and departments. A factor of items or
customers has as many levels as the data; here they stay a table (factor, level, code) that is
joined like any other, broadcast by Spark if it is small, and a row is a sparse vector with one
entry per factor.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.operators.ordering import with_position
from tallycast.session import stage


def level_table(df: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, level, code): the distinct values of each factor as text, numbered from 0 in sorted
    order. Numbers come from a range-partitioned sort; no level passes the driver. Nulls are none."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level"))
                      for f in factors])
    found = df.select(F.explode(pairs).alias("p")).select("p.*").where("level is not null").distinct()
    placed = with_position(found, [F.col("factor"), F.col("level")])
    first = placed.groupBy("factor").agg(F.min("position").alias("first"))
    return stage(placed.join(first, "factor").select(
        "factor", "level", (F.col("position") - F.col("first")).alias("code")), "levels")


def level_counts(levels: DataFrame) -> dict[str, int]:
    """Levels of each factor: one row per factor."""
    return {r["factor"]: r["count"] for r in levels.groupBy("factor").count().collect()}


def with_codes(rows: DataFrame, levels: DataFrame, factors: list[str]) -> DataFrame:
    """Columns ``<factor>_code``; a value that is no level, or null, has no code (null)."""
    for f in factors:
        own = levels.where(F.col("factor") == f).select(
            F.col("level").alias("_level"), F.col("code").alias(f"{f}_code"))
        rows = rows.join(own, F.col(f).cast("string") == F.col("_level"), "left").drop("_level")
    return rows


def sparse_features(rows: DataFrame, levels: DataFrame, factors: list[str],
                    numeric: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """``rows`` with ``features``: the numeric columns, then one block per factor with a one at the
    row's code (all zeros if it has none). Also the first column of each block."""
    numeric, counts = numeric or [], level_counts(levels)
    coded = with_codes(rows, levels, factors)
    for f in factors:
        # the size travels as metadata, so the encoder need not scan the rows for it
        coded = coded.withColumn(f"{f}_code", F.coalesce(F.col(f"{f}_code"), F.lit(counts.get(f, 0)))
                                 .cast("double")
                                 .alias(f"{f}_code", metadata={"ml_attr": {
                                     "type": "nominal", "num_vals": counts.get(f, 0) + 1}}))
    shown = [f"{f}_shown" for f in factors]
    # the last code stands for rows without a level; it is the one left out
    encoder = OneHotEncoder(inputCols=[f"{f}_code" for f in factors], outputCols=shown, dropLast=True)
    encoded = encoder.fit(coded).transform(coded)
    out = VectorAssembler(inputCols=[*numeric, *shown], outputCol="features").transform(encoded)
    first, at = {}, len(numeric)
    for f in factors:
        first[f], at = at, at + counts.get(f, 0)
    return out.drop(*shown, *[f"{f}_code" for f in factors]), first


def fit_sparse_linear(rows: DataFrame, levels: DataFrame, factors: list[str],
                      numeric: list[str] | None = None, ridge: float = 0.0, intercept: bool = False,
                      max_iter: int = 200, tol: float = 1e-10) -> DataFrame:
    """Least squares over sparse rows by L-BFGS -> (factor, level, beta); numeric columns and the
    intercept come with a null level. Tasks sum gradients as long as the design, nothing squared."""
    data, first = sparse_features(rows, levels, factors, numeric)
    model = LinearRegression(labelCol="y", solver="l-bfgs", regParam=ridge, elasticNetParam=0.0,
                             fitIntercept=intercept, standardization=False, maxIter=max_iter,
                             tol=tol).fit(data.select("y", "features"))
    spark, beta = rows.sparkSession, model.coefficients.toArray().tolist()
    columns = spark.createDataFrame(list(enumerate(beta)), "column long, beta double")
    starts = F.coalesce(*[F.when(F.col("factor") == f, F.lit(a)) for f, a in first.items()])
    named = levels.withColumn("column", F.col("code") + starts).join(columns, "column") \
        .select("factor", "level", "beta")
    others = [(n, None, b) for n, b in zip(numeric or [], beta)]
    others += [("intercept", None, model.intercept)] if intercept else []
    if not others:
        return named
    return named.unionByName(spark.createDataFrame(others, "factor string, level string, beta double"))
