"""Raster summaries, domain rules and area summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite, known

from . import polygons


def raster_summary(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    """Per raster: valid cells, cells that are NaN or infinite, extremes and plain mean."""
    v = known(F.col("value").cast("double"), *([] if nodata is None else [nodata]))
    return cells.withColumn("v", v).groupBy("raster_id").agg(F.count("v").alias("valid_aoi_pixels"), F.count_if(~finite(F.col("value").cast("double"))).alias("not_finite"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))


#: Domains by the prefix of a raster's name.
DOMAINS = {"occurrence": (0, 100), "seasonality": (0, 12)}


def domain_failures(summary: DataFrame, domains: dict[str, tuple[float, float]] = DOMAINS) -> DataFrame:
    """Rasters without a valid cell, with cells that are not finite, or beyond the domain of their name's prefix; a row per broken rule."""
    outside = F.lit(False)
    for prefix, (low, high) in domains.items():
        outside = outside | (F.col("raster_id").startswith(prefix) & ((F.col("min") < low) | (F.col("max") > high)))
    rules = F.array(F.when(F.col("valid_aoi_pixels") == 0, F.lit("empty")), F.when(F.col("not_finite") > 0, F.lit("not finite")), F.when(outside, F.lit("domain")))
    return summary.select("raster_id", F.explode(F.array_compact(rules)).alias("failure"))


def missing_days(layers: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """(keys, days): series that do not have every day from the first to the last (column ``day``), with the number that they have."""
    there = layers.filter(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).groupBy(*keys).agg(F.count_distinct("day").alias("days"))
    every = layers.select(*keys).distinct().join(there, keys, "left").withColumn("days", F.coalesce("days", F.lit(0)))
    return every.filter(F.col("days") < F.datediff(F.to_date(F.lit(last)), F.to_date(F.lit(first))) + 1)


def named_area(layers: DataFrame, name: str) -> DataFrame:
    """The one feature of a name, whatever its case; none or several is an error when the row is read."""
    found = layers.filter(F.lower("shape_name") == name.lower())
    n = found.agg(F.count("*").alias("__n"))
    checked = found.crossJoin(F.broadcast(n))  # one row
    return checked.filter(F.assert_true(F.col("__n") == 1, F.lit(f"not exactly one feature is named {name}")).isNull()).drop("__n")


def districts_summary(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: number of districts, sorted names and total area."""
    return assigned.groupBy(*keys).agg(F.count("*").alias("districts"), F.array_join(F.sort_array(F.collect_list("shape_name")), ",").alias("names"), F.sum("area").alias("area"))


def area_summary(districts: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Per state: bounds, number, sorted names and total area of its districts, and the share of the state that they cover together.

    Districts (key, shape_name, geometry) and states (key, geometry) are polygons
    on one plane.
    """
    edges = polygons.edges_of(districts, [key, "shape_name"])
    size = polygons.areas(edges, key, "shape_name")
    bounds = polygons.bounds(edges, key)
    covered = polygons.union_coverage(edges, polygons.edges_of(states, [key]), key, "shape_name")
    return districts_summary(size, [key]).join(bounds, key).join(covered, key)


def assigned_districts(overlaps: DataFrame, least: float = 0.5) -> DataFrame:
    """Districts of which more than ``least`` of their own area lies in the state."""
    return overlaps.withColumn("fraction", F.col("overlap") / F.col("area")).filter(F.col("fraction") > least)
