import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import audit, backscatter, candidates, components, patches, polygons, resample, terrain

VALUES = "pair_id int, row int, col int, vh_before float, vv_before float, vh_after float, vv_after float, inside boolean"


def cells(spark, points, pair=1):
    return spark.createDataFrame([(pair, r, c) for r, c in points], "pair_id int, row int, col int")


def test_event_periods_are_half_open(spark):
    rows = spark.createDataFrame([("2024-07-02T22:59:59Z",), ("2024-07-02T23:00:00Z",), ("2024-07-04T23:00:00Z",), (None,)], "t string")
    got = [r[0] for r in rows.select(scalar.event_period(F.to_timestamp("t"))).collect()]
    assert got == ["before", "during", "after", None]


def test_change_in_decibels(spark):
    rows = [(1, 0, 0, 1.0, 0.1, 10.0, 1.0, True), (1, 0, 1, 10.0, 1.0, 1.0, 0.1, True)]
    got = backscatter.prepared(spark.createDataFrame(rows, VALUES), F.col("inside")).orderBy("col").collect()
    assert [round(r.vh_change, 4) for r in got] == [10.0, -10.0]
    assert [round(r.vv_change, 4) for r in got] == [10.0, -10.0]


def test_support_is_common_to_dates_and_bands(spark):
    good = (1.0, 1.0, 1.0, 1.0)
    rows = [(1, 0, k, *v, i) for k, (v, i) in enumerate([((0.0, 1.0, 1.0, 1.0), True), ((1.0, -0.01, 1.0, 1.0), True), ((1.0, 1.0, math.nan, 1.0), True), ((1.0, 1.0, 1.0, -9999.0), True), (good, False), (good, True)])]
    got = backscatter.prepared(spark.createDataFrame(rows, VALUES), F.col("inside")).orderBy("col").collect()
    assert [r.support for r in got] == [False] * 5 + [True]
    assert [r.common_mask for r in got] == [1, 1, 0, 0, 255, 1]
    assert all(r.vh_change is None and r.vv_change is None for r in got[:5])


def test_threshold_bounds(spark):
    rows = zip([-20.0, -21.0, -25.0, -20.0, -20.0], [-23.0, -24.0, -28.0, -23.0, -22.0], [True, True, True, False, True], strict=True)
    df = spark.createDataFrame([(k, b, a, a - b, v) for k, (b, a, v) in enumerate(rows)], "k int, b float, a float, d float, v boolean")
    got = df.orderBy("k").select(candidates.candidate(F.col("b"), F.col("a"), F.col("d"), F.col("v"), -21, -3)).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]


def shape():
    block = {(r, c) for r in range(2, 7) for c in range(2, 7)} - {(4, 4)}
    return block | {(7, 7), (15, 15)}


@pytest.mark.parametrize("tile", [4, 16, 512])
def test_cleanup_drops_islands_and_fills_nothing(spark, tile):
    labels = components.labelled(cells(spark, shape()), tile)
    kept = {(r.row, r.col) for r in components.without_small(labels, 9).collect()}
    assert kept == shape() - {(15, 15)} and len(kept) == 25
    assert {r.label for r in labels.collect()} == {2 * components.WIDTH + 2, 15 * components.WIDTH + 15}


def test_components_and_ranks(spark):
    labels = components.labelled(cells(spark, [(5, 5), (1, 1), (0, 0)]), 2)
    got = {(r.row, r.col): r.label for r in labels.collect()}
    assert got[0, 0] == got[1, 1] != got[5, 5]
    ranks = components.ranked(components.component_sizes(labels)).orderBy("component_id").collect()
    assert [(r.patch_id, r.pixels) for r in ranks] == [("C0001", 2), ("C0002", 1)]


def test_empty_component_input(spark):
    assert components.labelled(cells(spark, []), 8).count() == 0


def test_plane_slope(spark):
    z = [(1, r, c, 30.0 * c) for r in range(7) for c in range(7)]
    plane = spark.createDataFrame(z, "pair_id int, row int, col int, elevation float")
    got = {(r.row, r.col): r.slope for r in terrain.horn_slope(plane).collect()}
    assert all((v is None) == (r in (0, 6) or c in (0, 6)) for (r, c), v in got.items())
    assert abs(got[3, 3] - 45) < 1e-9
    holed = plane.withColumn("elevation", F.when((F.col("row") == 3) & (F.col("col") == 3), None).otherwise(F.col("elevation")))
    gone = {(r.row, r.col) for r in terrain.horn_slope(holed).filter("slope IS NULL").collect()}
    assert {(r, c) for r in (2, 3, 4) for c in (2, 3, 4)} <= gone and (1, 1) not in gone


def test_outlines_keep_holes_and_touching_rings(spark):
    ring = {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    both = spark.createDataFrame([(1, r, c) for r, c in ring] + [(2, 0, 5), (2, 1, 6)], "pair_id int, row int, col int")
    rings = patches.outlines(both, ["pair_id"])
    got = {(r.pair_id, r.signed_area) for r in rings.collect()}
    assert got == {(1, 9.0), (1, -1.0), (2, 1.0)}
    edges = patches.ring_edges(rings, ["pair_id"])
    back = polygons.inside_pixels(polygons.spans(edges, both, ("pair_id",)), ("pair_id",))
    assert patches.round_trip_misses(both, back, ["pair_id"]).count() == 0
    text = {r.pair_id: r.wkt for r in patches.well_known_text(rings, ["pair_id"]).collect()}
    assert text[1].startswith("MULTILINESTRING ((")


def test_bilinear_shares_out_missing_neighbours(spark):
    src = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (1, 1, 5.0)], "row int, col int, v double")
    at = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.5), (3, 9.5, 9.5)], "k int, x double, y double")
    got = {r.k: r.v for r in resample.bilinear(at, src, F.col("x"), F.col("y"), "v", ["k"]).collect()}
    assert got[1] == pytest.approx(3.0) and got[2] == pytest.approx(1.0) and got[3] is None


def test_pairs_are_not_mixed(spark):
    src = spark.createDataFrame([(p, r, c, 100.0 * p) for p in (1, 2) for r in (0, 1) for c in (0, 1)], "pair_id int, row int, col int, v double")
    at = spark.createDataFrame([(1, 0), (2, 0)], "pair_id int, k int")
    one = F.lit(1.0)
    assert {r.pair_id: r.v for r in resample.bilinear(at, src, one, one, "v", ["pair_id", "k"], keys=["pair_id"]).collect()} == {1: 100.0, 2: 200.0}
    got = resample.nearest(at, src, one, one, "v", keys=["pair_id"]).collect()
    assert sorted((r.pair_id, r.v) for r in got) == [(1, 100.0), (2, 200.0)]


def test_reprojected_plane(spark):
    step = 1 / 3600
    src = spark.createDataFrame([(1, r, c, float(c)) for r in range(12) for c in range(12)], "pair_id int, row int, col int, z double")
    grid = resample.projected_grid(src, ["pair_id"], 3.25, 6.75, step).collect()[0]
    assert (grid.width, grid.height) == (13, 13) and grid.x0 == pytest.approx(527633.6, abs=40)
    rows = resample.reprojected(src, "z", ["pair_id"], 3.25, 6.75, step).collect()
    assert len(rows) == 13 * 13
    known = [r for r in rows if r.z is not None]
    # one column is 30.9 m times the cosine of the latitude wide
    assert len(known) > 130 and all(abs(r.z - (30 * (r.col + 0.5) / 30.71 - 0.5)) < 0.35 for r in known if 1 < r.z < 10)


def test_ranks_run_through_bands_of_rows(spark):
    labels = [(p, r * components.WIDTH + c, 1) for p in (1, 2) for r in (3, 511, 512, 1030) for c in (0, 7)]
    got = components.ranked(spark.createDataFrame(labels, "pair_id int, label long, pixels int")).orderBy("pair_id", "label").collect()
    assert [r.component_id for r in got] == [*range(1, 9)] * 2 and got[-1].patch_id == "C0008"


def test_layers_are_joined_by_pixel(spark):
    layer = lambda rows: spark.createDataFrame(rows, "pair_id int, row int, col int, vh float, vv float")
    mask = spark.createDataFrame([(1, 0, 0, 1)], "pair_id int, row int, col int, pair_mask int")
    got = backscatter.aligned(layer([(1, 0, 0, 1.0, 2.0), (2, 0, 0, 3.0, 4.0)]), layer([(1, 0, 0, 5.0, 6.0), (1, 9, 9, 7.0, 8.0)]), mask).orderBy("pair_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 1.0, 2.0, 5.0, 6.0, 1), (2, 0, 0, 3.0, 4.0, None, None, None)]


def test_describe_skips_nan_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", math.nan), ("b", None)], "g string, m double")
    got = {r.g: r for r in audit.describe(df, ["m"], ["g"]).collect()}
    assert (got["a"]["count"], got["a"].median, got["a"].mean) == (2, 1.5, 1.5)
    assert got["b"]["count"] == 0 and got["b"].median is None


def test_histogram_ends(spark):
    df = spark.createDataFrame([(1, v) for v in (-30.0, 30.0, 30.1, -30.1, 0.0)], "k int, v double")
    got = {r.bin: r.n for r in backscatter.histogram(df, ["k"], "v").filter("n > 0").collect()}
    assert got == {0: 1, 119: 1, 120: 1, -1: 1, 60: 1}
