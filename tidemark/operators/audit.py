"""Distributions of candidate measures, and checks of one report against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import known

QUANTILES = (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))
ELEVATIONS = (0, 2, 5, 10, 20)


def raw_and_clean(points: DataFrame) -> DataFrame:
    """Every point in subset 'raw', and in 'clean' where it was kept."""
    both = F.when(F.col("retained_after_cleanup") == 1, F.array(F.lit("raw"), F.lit("clean"))).otherwise(F.array(F.lit("raw")))
    return points.withColumn("subset", F.explode(both))


def describe(points: DataFrame, measures: list[str], keys: list[str]) -> DataFrame:
    """Per key and measure: count, extremes, mean and exact interpolated quantiles of the finite values; a group without any has count 0."""
    stack = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in measures)
    long = points.select(*keys, F.expr(f"stack({len(measures)}, {stack}) AS (measure, v)")).withColumn("v", known(F.col("v")))
    marks = [F.percentile("v", q).alias(n) for n, q in QUANTILES]
    return long.groupBy(*keys, "measure").agg(F.count("v").alias("count"), F.min("v").alias("min"), *marks, F.max("v").alias("max"), F.avg("v").alias("mean"))


def elevation_counts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points at or below each elevation, without elevation, and with falling VV."""
    z = F.col("dsm_elevation_m")
    return points.groupBy(*keys).agg(F.count("*").alias("pixels"), *[F.count_if(z <= e).alias(f"le_{e}") for e in ELEVATIONS], F.count_if(z.isNull()).alias("missing"), F.count_if(F.col("delta_vv_db") < 0).alias("vv_decrease"))


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys at which two reports disagree or only one speaks; none expected."""
    left, right = a.select(*keys, F.col(value).alias("left_value")), b.select(*keys, F.col(value).alias("right_value"))
    return left.join(right, keys, "full").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
