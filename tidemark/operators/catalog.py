"""Scene catalogs: inventory, comparable pairs, ranking and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import EVENT_END, EVENT_START, days_between, event_period

from . import polygons

KEYS = ("platform", "path_number", "flight_direction", "polarization", "beam_mode", "processing_level")


def inventory(scenes: DataFrame, start: str = EVENT_START, end: str = EVENT_END) -> DataFrame:
    """The inventory columns of a scene table, in order of acquisition; a missing digest becomes empty."""
    return scenes.select(*inventory_columns(start, end)).orderBy("acquisition_utc", "scene_id")


def inventory_columns(start: str = EVENT_START, end: str = EVENT_END) -> list[Column]:
    return [
        F.col("scene_name").alias("scene_id"),
        F.col("start_time").alias("acquisition_utc"),
        event_period(F.col("start_time"), start, end).alias("period"),
        F.col("orbit").alias("absolute_orbit"),
        F.col("path_number").alias("relative_orbit"),
        F.col("flight_direction").alias("pass_direction"),
        F.col("polarization"),
        F.col("processing_level").alias("product"),
        F.col("beam_mode").alias("mode"),
        F.lit(10).alias("pixel_spacing_m"),
        F.lit("20 x 22 (IW GRD high resolution)").alias("nominal_resolution_m"),
        F.col("bytes"),
        F.col("url"),
        F.coalesce("md5sum", F.lit("")).alias("md5"),
    ]


def exact_footprints(scenes: DataFrame, areas: DataFrame, least: float = 1e-9) -> DataFrame:
    """Scenes whose footprint shares area with their area of interest; touching is not enough.

    Both tables hold polygons in ``geometry`` on one plane; ``areas`` has one per
    aoi_id.  Boxes are compared first, and only scenes whose boxes meet are measured.
    """
    box, own = F.col("__box"), F.col("__own")
    met = scenes.select("aoi_id", "scene_name", polygons.box_of("geometry").alias("__own"), polygons.flat_edges("geometry").alias("edges")).join(areas.select("aoi_id", polygons.box_of("geometry").alias("__box")), "aoi_id")
    met = met.filter((own["west"] < box["east"]) & (box["west"] < own["east"]) & (own["south"] < box["north"]) & (box["south"] < own["north"]))
    found = polygons.clipped(met.select("aoi_id", "scene_name", "edges"), areas.select("aoi_id", polygons.flat_edges("geometry").alias("edges")), "aoi_id")
    return scenes.join(found.filter(F.col("clip_area") > least).select("aoi_id", "scene_name"), ["aoi_id", "scene_name"], "left_semi")


def comparable_pairs(scenes: DataFrame, start: str = EVENT_START, end: str = EVENT_END) -> DataFrame:
    """Every before scene with every later one of the same key, nulls being equal to nulls."""
    timed = scenes.withColumn("period", event_period(F.col("start_time"), start, end))
    before = timed.filter("period = 'before'").select([F.col(c).alias(f"{c}_before") for c in timed.columns])
    after = timed.filter("period != 'before'").select([F.col(c).alias(f"{c}_after") for c in timed.columns])
    on = F.col("aoi_id_before") == F.col("aoi_id_after")
    for k in KEYS:
        on = on & F.col(f"{k}_before").eqNullSafe(F.col(f"{k}_after"))
    pairs = before.join(after, on)
    return pairs.withColumn("baseline_days", days_between(F.col("start_time_before"), F.col("start_time_after"))).withColumn("after_days_from_event_start", days_between(F.to_timestamp(F.lit(start)), F.col("start_time_after")))


def clipped_scenes(scenes: DataFrame, areas: DataFrame, least: float = 0.01) -> DataFrame:
    """Scenes with their ``footprint`` as edges, ``edges``, what of it lies in the area of interest, the ``box`` of that, and ``area_size``; those that cover less than the share ``least`` go.

    Each footprint is cut once.  Boxes bound the share first.
    """
    area = areas.select("aoi_id", polygons.box_of("geometry").alias("area_box"), polygons.flat_edges("geometry").alias("edges"))
    whole = polygons.overlaps(area, ["aoi_id"], ["edges"]).withColumnRenamed("overlap", "area_size")
    boxed = scenes.withColumn("box", polygons.box_of("geometry")).withColumn("edges", polygons.flat_edges("geometry")).withColumn("footprint", F.col("edges")).drop("geometry")
    near = boxed.join(area.drop("edges").join(whole, "aoi_id"), "aoi_id").filter(_reach("box", "area_box") >= least * F.col("area_size"))
    cut = polygons.clipped(near.drop("box", "area_box"), area.select("aoi_id", "edges"), "aoi_id").filter(F.col("clip_area") >= least * F.col("area_size") * (1 - 1e-9))
    ends = lambda c: F.concat(F.col("edges")[f"{c}1"], F.col("edges")[f"{c}2"])
    box = F.struct(*[f(ends(c)).alias(n) for n, f, c in (("west", F.array_min, "x"), ("south", F.array_min, "y"), ("east", F.array_max, "x"), ("north", F.array_max, "y"))])
    return cut.withColumn("box", box)


def _reach(*boxes: str) -> Column:
    """Area that boxes have in common."""
    wide = F.least(*[F.col(b)["east"] for b in boxes]) - F.greatest(*[F.col(b)["west"] for b in boxes])
    high = F.least(*[F.col(b)["north"] for b in boxes]) - F.greatest(*[F.col(b)["south"] for b in boxes])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(0.0)


def covered_pairs(scenes: DataFrame, areas: DataFrame, start: str = EVENT_START, end: str = EVENT_END, least: float = 0.01) -> DataFrame:
    """Comparable pairs with ``common_aoi_fraction``, the share of the area of interest that both footprints cover; pairs under ``least`` go.

    Footprints and areas are polygons in ``geometry`` on one plane (see
    ``polygons.projected``).  Footprints are cut to their area first, so a pair
    carries the cut shape of one and the footprint of the other and not the area; boxes bound the share, and this
    is a condition of the join, so that only pairs that may count are made and
    measured.  The share is rounded to 12 digits, so that errors of rounding
    decide no rank.
    """
    pairs = comparable_pairs(clipped_scenes(scenes, areas, least), start, end).filter(_reach("box_before", "box_after") >= least * F.col("area_size_before") * (1 - 1e-9))
    names = ["aoi_id_before", "scene_name_before", "scene_name_after"]
    measured = polygons.overlaps(pairs, [*names, "area_size_before", *_RANKED], ["edges_before", "footprint_after"])
    fraction = F.round(F.col("overlap") / F.col("area_size_before"), 12)
    return measured.withColumn("common_aoi_fraction", fraction).filter(F.col("common_aoi_fraction") >= least).withColumnRenamed("area_size_before", "area_size").drop("overlap")


#: What of a pair is carried through the measuring of its coverage.
_RANKED = ["period_after", "baseline_days", "after_days_from_event_start"]


def _order(wide: float) -> list[Column]:
    """Broad coverage first, then the earliest observation, the shortest baseline, the largest coverage, and names."""
    return [(F.col("common_aoi_fraction") < wide).alias("narrow"), F.col("after_days_from_event_start"), F.col("baseline_days"), (-F.col("common_aoi_fraction")).alias("less"), F.col("scene_name_before"), F.col("scene_name_after")]


def ranked(pairs: DataFrame, wide: float = 0.8) -> DataFrame:
    """Rank per area, the best pair being 1; see ``_order``."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("aoi_id_before").orderBy(*_order(wide))))


def best(pairs: DataFrame, wide: float = 0.8) -> DataFrame:
    """The pair of rank 1 of every area, without sorting the others."""
    first = pairs.groupBy("aoi_id_before").agg(F.min_by(F.struct(*pairs.columns), F.struct(*_order(wide))).alias("p"))
    return first.select("p.*")


def unobserved(best_pairs: DataFrame) -> DataFrame:
    """Per area: what the pair's footprints cover together, and what of the area they do not."""
    size = F.col("area_size")
    return best_pairs.select(F.col("aoi_id_before").alias("aoi_id"), (size * F.col("common_aoi_fraction")).alias("pair_coverage"), (size * (1 - F.col("common_aoi_fraction"))).alias("not_observed_by_pair"))


def unobserved_shapes(best_pairs: DataFrame, scenes: DataFrame, areas: DataFrame) -> DataFrame:
    """Per area the polygons ``pair_coverage``, what both footprints of its pair cover, and ``not_observed_by_pair``, the rest."""
    edges = lambda df, name: df.withColumn(name, polygons.flat_edges("geometry"))
    found = best_pairs.select(F.col("aoi_id_before").alias("aoi_id"), "scene_name_before", "scene_name_after")
    for side in ("before", "after"):
        own = edges(scenes, f"edges_{side}").select("aoi_id", F.col("scene_name").alias(f"scene_name_{side}"), f"edges_{side}")
        found = found.join(own, ["aoi_id", f"scene_name_{side}"])
    met = found.join(edges(areas, "area_edges").select("aoi_id", "area_edges"), "aoi_id")
    return polygons.outlines(met, ["aoi_id"], "area_edges", ["edges_before", "edges_after"]).select("aoi_id", F.col("covered").alias("pair_coverage"), F.col("open").alias("not_observed_by_pair"))


def selected_bytes(chosen: DataFrame, scenes: DataFrame) -> DataFrame:
    """Download size of the selected pair of every area."""
    names = chosen.select(F.col("aoi_id_before").alias("aoi_id"), F.explode(F.array("scene_name_before", "scene_name_after")).alias("scene_name"))
    return names.join(scenes.select("aoi_id", "scene_name", "bytes"), ["aoi_id", "scene_name"]).groupBy("aoi_id").agg(F.sum("bytes").alias("total_download_bytes"))
