"""Patches: zonal statistics, polygon outlines and the round trip back to pixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import hectares, square_kilometres, square_metres
from tidemark.sources.shared import settled, spread, stored

MEASURES = ("june_vh_db", "june_vv_db", "july_vh_db", "july_vv_db", "delta_vh_db", "delta_vv_db", "dsm_elevation_m", "slope")


#: Patches up to this many pixels have their medians taken by one task; the values of larger ones are counted in so many buckets each round.
ONE_TASK, BUCKETS = 1_000_000, 4096
#: Up to this many order statistics of large patches go to every task.
BROADCAST_WANTED = 100_000


def zonal(points: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Per patch: pixels, areas, medians of every measure (null if none), known slopes and share of falling VV.

    Medians are exact at any size: patches of more than ``one_task`` pixels take
    theirs by ``order_statistics``, so no task holds one.
    """
    keys = ["pair_id", "patch_id"]
    points = stored(points.select(*keys, *MEASURES))
    counts = points.groupBy(*keys).agg(F.count("*").alias("pixels"), F.count("slope").alias("slope_known_pixels"), (100.0 * F.avg((F.col("delta_vv_db") < 0).cast("double"))).alias("vv_decrease_pct"))
    middle = lambda df: df.groupBy(*keys).agg(*[F.median(m).alias(f"{m}_median") for m in MEASURES])
    large = counts.filter(F.col("pixels") > one_task).select(*keys)
    if large.limit(1).count() == 0:
        medians = middle(points)
    else:
        large = settled(large)  # fewer than the pixels by ``one_task``
        medians = middle(points.join(large, keys, "left_anti")).unionByName(_large_medians(points.join(large, keys, "left_semi"), keys, one_task))
    out = counts.join(medians, keys)
    return out.withColumns({"area_m2": square_metres(F.col("pixels")), "area_ha": hectares(F.col("pixels")), "status": F.lit("unreviewed")})


def _large_medians(points: DataFrame, keys: list[str], one_task: int) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in MEASURES])).alias("e")
    values = points.select(*keys, each).select(*keys, "e.*")
    held = settled(values.filter("v IS NOT NULL").groupBy(*keys, "measure").agg(F.count("*").alias("n")))
    places = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    found = order_statistics(values, held.select(*keys, "measure", F.explode(places).alias("place")), [*keys, "measure"], one_task)
    met = found.groupBy(*keys, "measure").agg(F.avg("v").alias("median"))
    # a patch without any known value still has its row
    return points.select(*keys).distinct().join(met, keys, "left").groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"{m}_median") for m in MEASURES])


def order_statistics(values: DataFrame, wanted: DataFrame, keys: list[str], one_task: int = ONE_TASK, buckets: int = BUCKETS) -> DataFrame:
    """(keys, place, v): the value at every wanted place (from 0) in the ascending order of its group's known values.

    Each round counts the values between bounds in equal buckets, with sums inside
    tasks, and goes on with the bucket that holds the place, whose own extremes are
    the next bounds; what at most ``one_task`` values are left of is sorted.
    """
    known = values.filter("v IS NOT NULL").select(*keys, "v")
    bounds = known.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    state = stored(wanted.join(bounds, keys).withColumn("rest", F.col("place")))

    def between(some: DataFrame) -> DataFrame:
        few = F.broadcast(some) if some.count() <= BROADCAST_WANTED else some
        return known.join(few, keys).filter(F.col("v").between(F.col("low"), F.col("high")))

    out = []
    while True:
        out.append(state.filter("low = high").select(*keys, "place", F.col("low").alias("v")))
        state = stored(state.filter("low < high"))
        small = state.filter(F.col("n") <= one_task)
        ordered = between(small).groupBy(*keys, "place", "rest").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        out.append(ordered.select(*keys, "place", F.get("vs", F.col("rest").cast("int")).alias("v")))
        state = stored(state.filter(F.col("n") > one_task))
        if state.limit(1).count() == 0:
            break
        share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
        sums = between(state).groupBy(*keys, "place", "rest", F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        past = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        state = stored(sums.withColumn("past", past).filter("past <= rest AND rest < past + n").select(*keys, "place", "low", "high", "n", (F.col("rest") - F.col("past")).alias("rest")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def boundary_edges(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Directed cell edges (x1, y1) to (x2, y2) around every label, shared ones cancelled; the inside lies on the right (y down)."""
    r, c = F.col("row"), F.col("col")
    sides = F.array(*[F.struct((c + a).alias("x1"), (r + b).alias("y1"), (c + d).alias("x2"), (r + e).alias("y2")) for a, b, d, e in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))])
    edges = labels.select(*keys, F.explode(sides).alias("e")).select(*keys, "e.*")
    low = [F.least("x1", "x2").alias("lx"), F.least("y1", "y2").alias("ly"), F.greatest("x1", "x2").alias("hx"), F.greatest("y1", "y2").alias("hy")]
    once = edges.select(*keys, *low, "x1", "y1", "x2", "y2").groupBy(*keys, "lx", "ly", "hx", "hy").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("x1", "y1", "x2", "y2")])
    return once.filter("n = 1").select(*keys, "x1", "y1", "x2", "y2")


def _trace(edges: pd.DataFrame) -> list[list[tuple[int, int]]]:
    """Closed rings of one label.  At a corner where two rings touch, the turn that keeps them apart is taken."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x1, y1, x2, y2 in sorted(zip(edges["x1"], edges["y1"], edges["x2"], edges["y2"], strict=True)):
        after.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    while after:
        start = at = min(after)
        ring, came = [start], None
        while True:
            ways = after[at]
            if came is not None and len(ways) > 1:
                # the right turn stays with the same cell
                right = (at[0] - came[1], at[1] + came[0])
                way = right if right in ways else ways[0]
            else:
                way = ways[0]
            ways.remove(way)
            if not ways:
                del after[at]
            came, at = (way[0] - at[0], way[1] - at[1]), way
            if at == start:
                break
            ring.append(at)
        corners = [p for k, p in enumerate(ring) if (p[0] - ring[k - 1][0]) * (ring[(k + 1) % len(ring)][1] - p[1]) != (p[1] - ring[k - 1][1]) * (ring[(k + 1) % len(ring)][0] - p[0])]
        rings.append(corners)
    return rings


def outlines(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, points, signed_area): rings of every label in pixel units, outer ones positive, holes negative.

    Only the boundary reaches the tracing; its size is a patch's perimeter.
    """
    # tracing takes long for what few bytes its edges are
    edges = spread(boundary_edges(labels, keys), *keys)
    types = dict(edges.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, ring in enumerate(_trace(group)):
            closed = [*ring, ring[0]]
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(closed, closed[1:], strict=False)) / 2
            rows.append([*(group[c].iloc[0] for c in keys), k, [{"x": float(x), "y": float(y)} for x, y in closed], float(area)])
        return pd.DataFrame(rows, columns=[*keys, "ring", "points", "signed_area"])

    fields = ", ".join(f"{c} {types[c]}" for c in keys)
    return edges.groupBy(*keys).applyInPandas(run, f"{fields}, ring int, points array<struct<x:double,y:double>>, signed_area double")


def ring_edges(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Edge table of traced rings, for rasterising and areas by even-odd rule."""
    steps = rings.withColumn("seq", F.explode(F.sequence(F.lit(1), F.size("points") - 1)))
    a, b = F.element_at("points", F.col("seq")), F.element_at("points", F.col("seq") + 1)
    return steps.select(*keys, F.lit(0).alias("part"), "ring", "seq", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def well_known_text(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wkt): the boundary as a MULTILINESTRING in ring order."""
    text = F.concat(F.lit("("), F.array_join(F.transform("points", lambda p: F.concat(p["x"].cast("int").cast("string"), F.lit(" "), p["y"].cast("int").cast("string"))), ", "), F.lit(")"))
    listed = rings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ring", text.alias("t")))).alias("l"))
    return listed.select(*keys, F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform("l", lambda s: s["t"]), ", "), F.lit(")")).alias("wkt"))


def round_trip_misses(labels: DataFrame, filled: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels that only one of labels and re-rasterised outlines has; none expected."""
    a, b = labels.select(*keys, "row", "col", F.lit(1).alias("a")), filled.select(*keys, "row", "col", F.lit(1).alias("b"))
    return a.join(b, [*keys, "row", "col"], "full").filter("a IS NULL OR b IS NULL")


def summary(patches: DataFrame) -> DataFrame:
    """Per pair: patches, total area and smallest and largest patch."""
    return patches.groupBy("pair_id").agg(F.count("*").alias("patches"), F.sum(square_kilometres(F.col("pixels"))).alias("total_km2"), F.min("pixels").alias("smallest"), F.max("pixels").alias("largest"))
