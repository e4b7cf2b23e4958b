import json
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, integrity, polygons, projection, qa, water
from tidemark.sources import shared, tables

SCENE = "aoi_id string, scene_name string, start_time timestamp, platform string, path_number int, flight_direction string, polarization string, beam_mode string, processing_level string, geometry array<array<array<struct<x:double,y:double>>>>, bytes long"
AREAS = "aoi_id string, geometry array<array<array<struct<x:double,y:double>>>>"


def box(west, south, east, north, slant=0.0):
    return [[[(float(x), float(y)) for x, y in ((west, south), (east, south), (east + slant, north), (west + slant, north))]]]


def scene(name, day, shape=(3.0, 6.0, 4.0, 7.0), path=95, way="DESCENDING", pol="VV+VH"):
    return ("a", name, datetime.fromisoformat(day).replace(tzinfo=timezone.utc), "S1A", path, way, pol, "IW", "GRD_HD", shape if isinstance(shape, list) else box(*shape), 10)


def ranked(spark, scenes):
    s = spark.createDataFrame(scenes, SCENE)
    area = spark.createDataFrame([("a", box(3.0, 6.0, 4.0, 7.0))], AREAS)
    pairs = catalog.covered_pairs(s, area)
    out = catalog.ranked(pairs).orderBy("rank").collect()
    assert [tuple(r) for r in catalog.best(pairs).collect()] == [tuple(r)[:-1] for r in out[:1]]
    return out


def test_orbit_and_pass_must_match(spark):
    assert not ranked(spark, [scene("b", "2024-06-21T05:30:18"), scene("x", "2024-07-03T05:30:17", path=103), scene("y", "2024-07-03T05:30:17", way="ASCENDING")])


def test_event_day_beats_a_little_coverage(spark):
    got = ranked(spark, [scene("b", "2024-06-21T05:30:18"), scene("late", "2024-07-15T05:30:17"), scene("early", "2024-07-03T05:30:17", (3.001, 6.0, 4.0, 7.0))])
    assert [r.scene_name_after for r in got] == ["early", "late"] and got[0].common_aoi_fraction < 1
    assert got[0].baseline_days == pytest.approx(11.999988425925926) and got[0].after_days_from_event_start == pytest.approx(0.2710300925925926)


def test_disjoint_footprints_and_null_keys(spark):
    assert not ranked(spark, [scene("b", "2024-06-21T05:30:18", (3.0, 6.0, 3.3, 7.0)), scene("x", "2024-07-03T05:30:17", (3.7, 6.0, 4.0, 7.0))])
    assert len(ranked(spark, [scene("b", "2024-06-21T05:30:18", pol=None), scene("x", "2024-07-03T05:30:17", pol=None), scene("y", "2024-07-03T05:30:17")])) == 1


def test_slanted_footprints_cover_less_than_their_boxes(spark):
    got = ranked(spark, [scene("b", "2024-06-21T05:30:18", box(2.5, 6.0, 3.5, 7.0, 0.5)), scene("x", "2024-07-03T05:30:17", box(3.5, 6.0, 4.5, 7.0, -0.5)), scene("y", "2024-07-03T05:30:19", box(2.0, 5.0, 5.0, 8.0))])
    # x leaves the triangle right of its left edge; its common part with b is a rhomb cut in half
    want = {"x": polygons.strip_area([np.array([[*a, *b] for a, b in zip(r, r[1:] + r[:1], strict=True)]) for r in (box(2.5, 6.0, 3.5, 7.0, 0.5)[0][0], box(3.5, 6.0, 4.5, 7.0, -0.5)[0][0], box(3.0, 6.0, 4.0, 7.0)[0][0])]), "y": 0.75}
    assert {r.scene_name_after: r.common_aoi_fraction for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    rest = catalog.unobserved(catalog.best(catalog.covered_pairs(spark.createDataFrame([scene("b", "2024-06-21T05:30:18", box(2.5, 6.0, 3.5, 7.0, 0.5)), scene("y", "2024-07-03T05:30:19")], SCENE), spark.createDataFrame([("a", box(3.0, 6.0, 4.0, 7.0))], AREAS)))).collect()[0]
    assert rest.pair_coverage == pytest.approx(0.75) and rest.not_observed_by_pair == pytest.approx(0.25)


def test_touching_footprints_are_left_out(spark):
    s = spark.createDataFrame([scene("touch", "2024-07-03T05:30:17", (4.0, 6.0, 5.0, 7.0)), scene("in", "2024-07-03T05:30:17", (3.9, 6.9, 5.0, 7.5)), scene("slanted", "2024-07-03T05:30:17", box(4.2, 5.0, 5.0, 8.0, -0.1))], SCENE)
    area = spark.createDataFrame([("a", box(3.0, 6.0, 4.0, 7.0))], AREAS)
    assert {r.scene_name for r in catalog.exact_footprints(s, area).collect()} == {"in"}


def test_projected_polygons(spark):
    shape = spark.createDataFrame([("a", box(3.0, 0.0, 3.1, 0.1))], AREAS)
    got = shape.select(polygons.projected("geometry").alias("geometry")).select(polygons.box_of("geometry").alias("b")).select("b.*").collect()[0]
    assert got.west == pytest.approx(500000, abs=1e-6) and got.south == pytest.approx(0, abs=1e-6)
    assert got.east == pytest.approx(511127.5, abs=1) and got.north == pytest.approx(11053.1, abs=1)


def test_boxes_meet_once(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *p, *(p + rng.uniform(0.1, 4, 2))) for k, p in enumerate(rng.uniform(-10, 10, (40, 2)))]
    rows = [(k, *map(float, r)) for k, *r in rows]
    a = spark.createDataFrame(rows, "k int, west double, south double, east double, north double")
    b = a.select([F.col(c).alias(f"{c}_b") for c in a.columns])
    got = sorted((r.k, r.k_b) for r in polygons.touching_boxes(a, b, 1.5).collect())
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4])


def test_crossing_edges_of_a_star(spark):
    rng = np.random.default_rng(8)
    ring = [tuple(map(float, p)) for p in rng.uniform(0, 10, (30, 2))]
    e = polygons.edge_table(spark, {"star": [[ring]]})
    got = {(r.n.seq, r.n_b.seq) for r in polygons.self_intersections(e, "poly_id").collect()}
    sides = list(zip(ring, ring[1:] + ring[:1], strict=True))
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    want = {(i, j) for i, (a, b) in enumerate(sides) for j, (c, d) in enumerate(sides) if i < j and turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0}
    assert got == want and want


def test_xml_fields(spark):
    xml = "<?xml version='1.0'?><s:a xmlns:s='u'><s:pass> UP\n</s:pass><x><pass>DOWN</pass><pass/></x><mode>  </mode></s:a>"
    got = {r.name: r["values"] for r in integrity.xml_fields(spark.createDataFrame([(1, xml), (2, None)], "k int, xml string"), ["pass", "mode", "orbit"], ["k"]).collect()}
    assert got == {"pass": ["UP", "DOWN"]}


def test_union_coverage_and_missing_days(spark):
    d = spark.createDataFrame([("s", "b", box(0, 0, 2, 2)), ("s", "a", box(1, 0, 3, 2)), ("t", "c", box(9, 9, 10, 10))], "state string, shape_name string, geometry array<array<array<struct<x:double,y:double>>>>")
    states = spark.createDataFrame([("s", box(0, 0, 4, 2)), ("t", box(0, 0, 1, 1))], "state string, geometry array<array<array<struct<x:double,y:double>>>>")
    got = {r.state: r for r in qa.area_summary(d, states, "state").collect()}
    assert (got["s"].districts, got["s"].names, got["s"].area, got["s"].east) == (2, "a,b", 8.0, 3.0)
    assert got["s"].union_coverage == pytest.approx(0.75) and got["t"].union_coverage == pytest.approx(0)
    days = spark.createDataFrame([("x", f"2024-06-{k}") for k in range(21, 26)] + [("y", "2024-06-21"), ("y", "2024-06-21")], "k string, d string").select("k", F.to_date("d").alias("day"))
    assert [tuple(r) for r in qa.missing_days(days, ["k"], "2024-06-21", "2024-06-25").collect()] == [("y", 1)]


def test_boundaries_of_several_parts(spark, tmp_path):
    part = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]]
    shapes = {"one": ("Polygon", part), "two": ("MultiPolygon", [part, part])}
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"shapeName": n}, "geometry": {"type": t, "coordinates": c}} for n, (t, c) in shapes.items()]}
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=1))
    got = {r.shape_name: r.geometry for r in tables.read_boundaries(spark, str(tmp_path / "b.json")).collect()}
    assert [len(got["one"]), len(got["two"])] == [1, 2] and got["two"][1][0][1].x == 2.0
    doc["features"][0]["geometry"] = {"type": "Point", "coordinates": [1.0, 2.0]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="no polygon: Point"):
        tables.read_boundaries(spark, str(tmp_path / "p.json")).collect()


def test_several_machines_need_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_scene_file_round_trip(spark, tmp_path):
    ring = [[3.0, 6.0], [4.0, 6.5], [4.0, 7.0], [3.0, 6.0]]
    one = {"type": "Feature", "properties": {"sceneName": "s", "startTime": "2024-07-03T05:30:17Z", "pathNumber": 95, "bytes": 7}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    (tmp_path / "s.json").write_text(json.dumps({"type": "FeatureCollection", "features": [one]}, indent=1))
    got = tables.read_scenes(spark, str(tmp_path / "s.json")).collect()
    assert (got[0].scene_name, got[0].west, got[0].north, len(got[0].geometry[0][0])) == ("s", 3.0, 7.0, 4)


def test_csv_round_trip_and_no_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3.0, 4.0, 1, *[None] * 7)], tables.POINTS)
    tables.write_csv(df, str(tmp_path / "p"))
    assert tables.read_csv(spark, str(tmp_path / "p"), tables.POINTS).collect() == df.collect()
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_csv(df, str(tmp_path / "p"))


def test_pixel_layers_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, r, 0) for r in range(40)], "pair_id int, row int, col int")
    tables.write_pixels(df, str(tmp_path / "px"), 8)
    got = tables.read_pixels(spark, str(tmp_path / "px"), (9, 17), 8)
    assert sorted(r.row for r in got.collect()) == list(range(9, 18))
    assert "tile_row" in got._jdf.queryExecution().executedPlan().toString()


def test_file_inventory_and_report(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"abc")
    got = tables.file_inventory(spark, str(tmp_path / "f")).collect()[0]
    assert (got.bytes, got.md5) == (3, "900150983cd24fb0d6963f7d28e17f72")
    doc = tables.report({"x": spark.range(2)}).collect()
    assert json.loads(doc[0].rows) == [{"id": 0}, {"id": 1}]


def test_projection_meets_known_points(spark):
    x, y = projection.to_utm(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(3.0, 0.0), (0.0, 0.0), (6.0, 0.0), (3.0, 45.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert rows[0].x == pytest.approx(500000) and rows[0].y == pytest.approx(0, abs=1e-6)
    # the zone's edges at the equator, and the meridian's length to 45 degrees times the scale
    assert rows[1].x == pytest.approx(166021.443, abs=0.01) and rows[2].x == pytest.approx(833978.557, abs=0.01)
    assert rows[3].y == pytest.approx(4984944.378 * 0.9996, abs=0.01)


def test_strip_areas():
    edges = lambda ring: np.array([[*a, *b] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)], float)
    square, moved = edges([(0, 0), (4, 0), (4, 4), (0, 4)]), edges([(2, 1), (6, 1), (6, 3), (2, 3)])
    triangle = edges([(0, 0), (4, 0), (0, 4)])
    holed = np.concatenate([square, edges([(1, 1), (2, 1), (2, 2), (1, 2)])])
    assert polygons.strip_area([square, moved]) == pytest.approx(4)
    assert polygons.strip_area([square, moved], union=True) == pytest.approx(20)
    assert polygons.strip_area([triangle, triangle]) == pytest.approx(8)
    assert polygons.strip_area([holed, square]) == pytest.approx(15)
    assert polygons.strip_area([square, edges([(9, 9), (10, 9), (10, 10)])]) == 0


def test_bow_tie_is_found(spark):
    e = polygons.edge_table(spark, {"tie": [[[(0, 0), (2, 2), (2, 0), (0, 2)]]], "box": [[[(0, 0), (2, 0), (2, 2), (0, 2)]]]})
    assert {r.poly_id for r in polygons.self_intersections(e, "poly_id").collect()} == {"tie"}


def test_named_area_must_be_one(spark):
    df = spark.createDataFrame([("Oyo",), ("OYO",), ("Ogun",)], "shape_name string")
    assert qa.named_area(df, "ogun").count() == 1
    with pytest.raises(Exception, match="not exactly one"):
        qa.named_area(df, "oyo").collect()


def test_repeated_patch_is_an_error(spark):
    p = spark.createDataFrame([(1, "C0001"), (1, "C0001")], "pair_id int, patch_id string")
    w = spark.createDataFrame([(1, "C0001", 5)], "pair_id int, patch_id string, pixels int")
    with pytest.raises(Exception, match="repeated patch_id"):
        water.joined_once(p, w).collect()


def test_latest_manifest_entry_wins(spark):
    old = spark.createDataFrame([("p", "x", 1), ("q", "x", 5)], "path string, sha256 string, recorded_utc int")
    new = spark.createDataFrame([("p", "y", 2), ("q", "y", 4)], "path string, sha256 string, recorded_utc int")
    assert {r.path: r.sha256 for r in integrity.upsert(old, new).collect()} == {"p": "y", "q": "x"}
