"""The plane sweep against closed forms and Monte Carlo membership, and what rests on it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, polygons, qa, sweep


def edges(points):
    p = np.array(points, float)
    return np.concatenate([p, np.roll(p, -1, 0)], axis=1)


def box(w, s, e, n):
    return edges([(w, s), (e, s), (e, n), (w, n)])


def jagged(n, seed, x=0.0, y=0.0, r=5.0):
    rng = np.random.default_rng(seed)
    a, far = np.sort(rng.random(n)) * 2 * np.pi, r * (1 + 0.2 * rng.standard_normal(n).clip(-2, 2))
    return edges(np.stack([x + far * np.cos(a), y + far * np.sin(a)], axis=1))


def inside(shape, x, y):
    low, high = np.minimum(shape[:, 1], shape[:, 3]), np.maximum(shape[:, 1], shape[:, 3])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = shape[:, 0] + (y[:, None] - shape[:, 1]) * (shape[:, 2] - shape[:, 0]) / (shape[:, 3] - shape[:, 1])
    return (((low <= y[:, None]) & (y[:, None] < high) & (at <= x[:, None])).sum(1) % 2) == 1


def stacked(groups):
    flat = [(g, k, s) for g, shapes in enumerate(groups) for k, s in enumerate(shapes)]
    return np.concatenate([s for *_, s in flat]), np.repeat([g for g, *_ in flat], [len(s) for *_, s in flat]), np.repeat([k for _, k, _ in flat], [len(s) for *_, s in flat])


RULES = {"common": (sweep.common(3), lambda a, b, c: a & b & c), "any": (sweep.any_of, lambda a, b, c: a | b | c), "covered": (sweep.covered_part, lambda a, b, c: a & (b | c)), "open": (sweep.uncovered_part, lambda a, b, c: a & ~(b | c))}


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("active", [sweep.ACTIVE, 50])
def test_regions_hold_the_points_that_the_rule_names(name, active, monkeypatch):
    monkeypatch.setattr(sweep, "ACTIVE", active)
    rule, said = RULES[name]
    groups = [[jagged(40, 1), jagged(30, 2, 1, 1), box(-2, -3, 3, 4)], [box(0, 0, 2, 2), box(0, 0, 2, 2), box(1, 1, 4, 4)], [jagged(25, 3), jagged(25, 3), jagged(200, 4, 2)]]
    group, parts = sweep.regions(*stacked(groups), rule)
    rng = np.random.default_rng(9)
    x, y = rng.uniform(-8, 8, 4000), rng.uniform(-8, 8, 4000)
    sizes = sweep.areas(*stacked(groups), rule, 3)
    for g, shapes in enumerate(groups):
        own = parts[group == g]
        y0, y1, a0, a1, b0, b1 = own.T
        share = (y[:, None] - y0) / (y1 - y0)
        held = ((y0 <= y[:, None]) & (y[:, None] < y1) & (a0 + share * (a1 - a0) <= x[:, None]) & (x[:, None] < b0 + share * (b1 - b0))).sum(1)
        assert (held == said(*(inside(s, x, y) for s in shapes))).all()
        assert ((y1 - y0) * (b0 - a0 + b1 - a1) / 2).sum() == pytest.approx(sizes[g])


def test_many_edges_are_swept_by_their_strips():
    ring = jagged(5000, 5)
    got = polygons.strip_area([ring, box(-2, -2, 2, 2)])
    assert got == pytest.approx(16)
    assert polygons.strip_area([ring]) == pytest.approx(abs((ring[:, 0] * ring[:, 3] - ring[:, 2] * ring[:, 1]).sum()) / 2)


def ring_of(shape):
    return [[[{"x": float(x), "y": float(y)} for x, y in shape[:, :2]]]]


SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def test_footprints_are_clipped_by_an_area_of_many_vertices(spark, monkeypatch):
    monkeypatch.setattr(polygons, "CLIPPED_WITH", 3)
    area = jagged(2000, 6)
    prints = {f"s{k}": box(k - 4, -2 + k / 4, k, 3) for k in range(8)}
    scenes = spark.createDataFrame([("a", n, ring_of(s)) for n, s in prints.items()] + [("b", "s0", ring_of(prints["s0"])), ("c", "s1", ring_of(prints["s1"]))], f"aoi_id string, scene_name string, geometry {SHAPE}")
    areas = spark.createDataFrame([("a", ring_of(area)), ("b", ring_of(box(90, 90, 91, 91)))], f"aoi_id string, geometry {SHAPE}")
    flat = lambda df: df.withColumn("edges", polygons.flat_edges("geometry"))
    got = polygons.clipped(flat(scenes).drop("geometry"), flat(areas).drop("geometry"), "aoi_id")
    sizes = {(r.aoi_id, r.scene_name): r.clip_area for r in got.collect()}
    assert len(sizes) == 9 and sizes["b", "s0"] == 0
    for name, shape in prints.items():
        assert sizes["a", name] == pytest.approx(polygons.strip_area([shape, area]))
    pair = got.filter("scene_name = 's4'").select("aoi_id", "edges").join(flat(scenes).filter("scene_name = 's6'").select("aoi_id", F.col("edges").alias("other")), "aoi_id")
    both = polygons.overlaps(pair, ["aoi_id"], ["edges", "other"]).first().overlap
    assert both == pytest.approx(polygons.strip_area([prints["s4"], prints["s6"], area]))


def test_shapes_that_a_pair_covers_and_leaves_open(spark):
    area = jagged(60, 7)
    one, two = box(-4, -4, 2, 4), box(-2, -3, 5, 3)
    best = spark.createDataFrame([("a", "x", "y")], "aoi_id_before string, scene_name_before string, scene_name_after string")
    scenes = spark.createDataFrame([("a", "x", ring_of(one)), ("a", "y", ring_of(two))], f"aoi_id string, scene_name string, geometry {SHAPE}")
    areas = spark.createDataFrame([("a", ring_of(area))], f"aoi_id string, geometry {SHAPE}")
    shapes = catalog.unobserved_shapes(best, scenes, areas)
    size = {c: polygons.areas(polygons.edges_of(shapes, ["aoi_id"], c), "aoi_id").first().area for c in ("pair_coverage", "not_observed_by_pair")}
    assert size["pair_coverage"] == pytest.approx(polygons.strip_area([area, one, two]))
    assert sum(size.values()) == pytest.approx(polygons.strip_area([area]))


@pytest.mark.parametrize("edges_of_a_band", [polygons.BAND_EDGES, 7, 1])
def test_bands_of_a_state_are_measured_apart(spark, edges_of_a_band, monkeypatch):
    monkeypatch.setattr(polygons, "BAND_EDGES", edges_of_a_band)
    rng = np.random.default_rng(8)
    state, parts = jagged(80, 8), [jagged(12, 20 + k, *rng.uniform(-4, 4, 2), 1.5) for k in range(15)]
    districts = spark.createDataFrame([("s", f"d{k}", ring_of(p)) for k, p in enumerate(parts)], f"state string, shape_name string, geometry {SHAPE}")
    states = spark.createDataFrame([("s", ring_of(state)), ("t", ring_of(box(0, 0, 1, 1)))], f"state string, geometry {SHAPE}")
    got = qa.area_summary(districts, states, "state").collect()
    every = stacked([[state, *parts]])
    want = sweep.areas(*every, sweep.covered_part, 1)[0] / polygons.strip_area([state])
    assert len(got) == 1 and got[0].union_coverage == pytest.approx(want) and got[0].districts == 15
    assert want == pytest.approx((polygons.strip_area(parts, union=True) + polygons.strip_area([state]) - polygons.strip_area([state, *parts], union=True)) / polygons.strip_area([state]))
