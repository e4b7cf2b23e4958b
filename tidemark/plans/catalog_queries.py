"""Queries over scene catalogs, geometry, manifests and rasters, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import event_period, known
from tidemark.operators import backscatter, catalog, grid, integrity, polygons, projection, qa, resample
from tidemark.sources import tables
from tidemark.sources.shared import spread, stored

from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}
START, END = "2024-01-15T00:00:00+01:00", "2024-01-17T00:00:00+01:00"
SQL_START, SQL_END = "TIMESTAMP '2024-01-14 23:00:00'", "TIMESTAMP '2024-01-16 23:00:00'"
#: The area of interest, and a smaller one: west, south, east, north.
AREA, STRIP = (2.0, 3.0, 12.0, 11.0), (9.5, 2.0, 10.5, 10.0)
#: Footprints are slanted by so much east for each unit north, ascending ones to the right, others to the left.
SLANT = 0.25


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _scene_columns(div: str) -> list[str]:
    return [
        "user_id AS aoi_id",
        "event_id AS k",
        "ts AS start_time",
        "'S1A' AS platform",
        "CAST(event_id % 5 AS INT) AS path_number",
        "CASE WHEN event_type IN ('click', 'view') THEN 'ASCENDING' ELSE 'DESCENDING' END AS flight_direction",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'VV+VH' END AS polarization",
        "'IW' AS beam_mode",
        "'GRD_HD' AS processing_level",
        f"CAST(event_id {div} 10 AS INT) AS orbit",
        "event_id * 1000 AS bytes",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS md5sum",
        "CAST(event_id % 9 AS DOUBLE) AS west",
        "CAST(event_id % 4 AS DOUBLE) AS south",
        f"CASE WHEN event_type IN ('click', 'view') THEN {SLANT} ELSE -{SLANT} END AS slant",
    ]


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes from events: one area per user, slanted footprints of 6 by 8 units."""
    ev = fx.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    ev = spread(ev, "user_id", "event_id")  # a row group of short rows makes many footprints
    named = ev.selectExpr(*_scene_columns("div")).withColumn("scene_name", F.format_string("S%07d", "k")).withColumn("url", F.concat(F.lit("https://example.org/"), "scene_name"))
    slant = F.col("slant").cast("double")
    corner = lambda x, y: F.struct((F.col("west") + x + slant * y).alias("x"), (F.col("south") + y).cast("double").alias("y"))
    return named.withColumn("geometry", F.array(F.array(F.array(corner(0.0, 0), corner(6.0, 0), corner(6.0, 8), corner(0.0, 8))))).drop("k", "west", "south", "slant")


def box(west: float, south: float, east: float, north: float) -> Column:
    """A box as polygon column."""
    return F.array(F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((west, south), (east, south), (east, north), (west, north))])))


def areas(spark: SparkSession, sf_dir: str, bounds: tuple = AREA) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("aoi_id")).distinct().withColumn("geometry", box(*bounds))


_SCENES = f"sc AS (SELECT *, printf('S%07d', k) AS scene_name, 'https://example.org/' || printf('S%07d', k) AS url FROM (SELECT {', '.join(_scene_columns('//'))} FROM events))"
_PERIOD = f"CASE WHEN start_time < {SQL_START} THEN 'before' WHEN start_time < {SQL_END} THEN 'during' ELSE 'after' END"
_DAYS = lambda a, b: f"(epoch_us({b}) - epoch_us({a})) / 86400000000::DOUBLE"
def _swept(low: str, high: str, y0: str, y1: str, slant: str, west: float, east: float) -> str:
    """Area between the slanted lines x = low + slant * y and x = high + slant * y inside [west, east], from y0 to y1: an integral of clamped lines."""

    def integral(x: str) -> str:
        return f"(CASE WHEN {x} <= {west} THEN {west} * ({x}) WHEN {x} < {east} THEN (({x}) * ({x}) + {west * west}) / 2 ELSE {east} * ({x}) + {(west * west - east * east) / 2} END)"

    at = lambda c, y: integral(f"{c} + {slant} * {y}")
    whole = f"(({at(high, y1)} - {at(high, y0)}) - ({at(low, y1)} - {at(low, y0)})) / {slant}"
    return f"CASE WHEN {high} > {low} AND {y1} > {y0} THEN {whole} ELSE 0 END::DOUBLE"


_W, _S, _E, _N = AREA
_PAIRS = f"""{_SCENES}, tm AS (SELECT *, slant::DOUBLE AS sl, west - slant::DOUBLE * south AS foot, {_PERIOD} AS period FROM sc),
cm AS (SELECT b.aoi_id, b.scene_name AS before, a.scene_name AS after, a.period, {_DAYS('b.start_time', 'a.start_time')} AS baseline_days, {_DAYS(SQL_START, 'a.start_time')} AS after_days, a.sl,
  greatest(a.foot, b.foot) AS low, least(a.foot, b.foot) + 6 AS high, greatest(a.south, b.south, {_S}) AS y0, least(a.south + 8, b.south + 8, {_N}) AS y1
  FROM tm b JOIN tm a ON a.aoi_id = b.aoi_id AND b.period = 'before' AND a.period <> 'before' AND a.path_number = b.path_number AND a.flight_direction = b.flight_direction AND a.polarization IS NOT DISTINCT FROM b.polarization),
pr AS (SELECT aoi_id, before, after, period, baseline_days, after_days, round({_swept('low', 'high', 'y0', 'y1', 'sl', _W, _E)} / {(_E - _W) * (_N - _S)}, 12) AS fraction FROM cm),
rk AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY fraction < 0.8, after_days, baseline_days, fraction DESC, before, after)::INT AS rank FROM pr WHERE fraction >= 0.01)"""


def covered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.covered_pairs(scenes(spark, sf_dir), areas(spark, sf_dir), START, END)


def _told(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("aoi_id_before").alias("aoi_id"), F.col("scene_name_before").alias("before"), F.col("scene_name_after").alias("after"), F.col("period_after").alias("period"), F.round("baseline_days", 9).alias("baseline_days"), F.round("after_days_from_event_start", 9).alias("after_days"), F.round("common_aoi_fraction", 9).alias("fraction"), "rank")


@query(f"WITH {_SCENES} SELECT scene_name AS scene_id, start_time AS acquisition_utc, {_PERIOD} AS period, orbit AS absolute_orbit, path_number AS relative_orbit, flight_direction AS pass_direction, polarization, processing_level AS product, beam_mode AS mode, 10 AS pixel_spacing_m, '20 x 22 (IW GRD high resolution)' AS nominal_resolution_m, bytes, url, coalesce(md5sum, '') AS md5 FROM sc")
def s03_f01_t03_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene inventory with event periods."""
    return catalog.inventory(scenes(spark, sf_dir), START, END)


@query(f"WITH {_SCENES} SELECT scene_name FROM (SELECT *, west - slant::DOUBLE * south AS foot, slant::DOUBLE AS sl, greatest(south, {STRIP[1]}) AS y0, least(south + 8, {STRIP[3]}) AS y1 FROM sc) WHERE {_swept('foot', '(foot + 6)', 'y0', 'y1', 'sl', STRIP[0], STRIP[2])} > 1e-9")
def f03_exact_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes whose slanted footprint shares area with a strip."""
    return catalog.exact_footprints(scenes(spark, sf_dir), areas(spark, sf_dir, STRIP)).select("scene_name")


_TOLD = "aoi_id, before, after, period, round(baseline_days, 9) AS baseline_days, round(after_days, 9) AS after_days, round(fraction, 9) AS fraction, rank"


@query(f"WITH {_PAIRS} SELECT {_TOLD} FROM rk")
def j01_t01_c02_ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable pairs, ranked per area."""
    return _told(catalog.ranked(covered_pairs(spark, sf_dir)))


@query(f"WITH {_PAIRS} SELECT {_TOLD} FROM rk WHERE rank <= 5")
def t02_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best pairs of every area."""
    return _told(catalog.ranked(covered_pairs(spark, sf_dir)).filter("rank <= 5"))


@query(f"WITH {_PAIRS} SELECT aoi_id, sum(bytes)::BIGINT AS total_download_bytes FROM (SELECT aoi_id, unnest([before, after]) AS scene_name FROM rk WHERE rank = 1) JOIN sc USING (aoi_id, scene_name) GROUP BY aoi_id")
def j09_t02_selected_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download size of each area's best pair."""
    return catalog.selected_bytes(catalog.best(covered_pairs(spark, sf_dir)), scenes(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT aoi_id, round({(_E - _W) * (_N - _S)} * fraction, 6)::DOUBLE AS pair_coverage, round({(_E - _W) * (_N - _S)} * (1 - fraction), 6)::DOUBLE AS not_observed_by_pair FROM rk WHERE rank = 1")
def g09_unobserved_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each area's best pair covers, and what it does not."""
    out = catalog.unobserved(catalog.best(covered_pairs(spark, sf_dir)))
    return out.select("aoi_id", F.round("pair_coverage", 6).alias("pair_coverage"), F.round("not_observed_by_pair", 6).alias("not_observed_by_pair"))


@query(
    f"WITH {_PAIRS}, bs AS (SELECT aoi_id, fraction, low, high, y0, y1, cm.sl FROM rk JOIN cm USING (aoi_id, before, after) WHERE rank = 1), "
    f"px AS (SELECT r + 0.5::DOUBLE AS y, c + 0.5::DOUBLE AS x FROM (SELECT unnest(range({int(_S)}, {int(_N)})) AS r), (SELECT unnest(range({int(_W)}, {int(_E)})) AS c)) "
    f"SELECT aoi_id, round({(_E - _W) * (_N - _S)} * fraction, 6)::DOUBLE AS covered_area, round({(_E - _W) * (_N - _S)} * (1 - fraction), 6)::DOUBLE AS open_area, (SELECT count(*) FROM px WHERE y >= y0 AND y < y1 AND x >= low + sl * y AND x < high + sl * y) AS covered_pixels, "
    f"{int((_E - _W) * (_N - _S))} - (SELECT count(*) FROM px WHERE y >= y0 AND y < y1 AND x >= low + sl * y AND x < high + sl * y) AS open_pixels FROM bs"
)
def g09_unobserved_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons that each area's best pair covers and leaves open: their areas, and the unit pixels whose centre they hold."""
    # read for both polygons' areas and pixels; measured once
    shapes = stored(catalog.unobserved_shapes(catalog.best(covered_pairs(spark, sf_dir)), scenes(spark, sf_dir), areas(spark, sf_dir)))
    rows = spark.range(int(_S), int(_N)).select(F.col("id").cast("int").alias("row"))
    out = shapes.select("aoi_id")
    for name, column in (("covered", "pair_coverage"), ("open", "not_observed_by_pair")):
        edges = polygons.edges_of(shapes, ["aoi_id"], column)
        held = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["c1"] - s["c0"] + 1)
        pixels = polygons.spans(edges, rows, ("aoi_id",)).groupBy("aoi_id").agg(F.sum(held).alias(f"{name}_pixels"))
        size = polygons.areas(edges, "aoi_id").select("aoi_id", F.round("area", 6).alias(f"{name}_area"))
        out = out.join(size, "aoi_id", "left").join(pixels, "aoi_id", "left")
    zero = {f"{n}_{what}": F.coalesce(f"{n}_{what}", F.lit(0)) for n in ("covered", "open") for what in ("area", "pixels")}
    return out.withColumns(zero)


@query("SELECT s_suppkey AS poly_id, (s_suppkey % 17)::DOUBLE AS west, (s_suppkey % 5)::DOUBLE AS south, (s_suppkey % 17 + 3)::DOUBLE AS east, (s_suppkey % 5 + 2)::DOUBLE AS north, 6.0::DOUBLE AS area FROM supplier")
def g04_g05_bounds_and_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and areas of footprint polygons."""
    e = polygons.edges_of(boxes(spark, sf_dir), ["poly_id"])
    return polygons.bounds(e, "poly_id").join(polygons.areas(e, "poly_id"), "poly_id")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, s = F.col("s_suppkey") % 17, F.col("s_suppkey") % 5
    pts = [F.struct((w + a).cast("double").alias("x"), (s + b).cast("double").alias("y")) for a, b in ((0, 0), (3, 0), (3, 2), (0, 2))]
    return fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("poly_id"), F.array(F.array(F.array(*pts))).alias("geometry"))


@query(
    "WITH b AS (SELECT s_suppkey AS id, s_suppkey % 17 AS w, s_suppkey % 5 AS s FROM supplier), p AS (SELECT 7.0::DOUBLE AS w, 1.5::DOUBLE AS s, 12.5::DOUBLE AS e, 4.25::DOUBLE AS n) "
    "SELECT id AS poly_id, round((least(b.w + 3, p.e) - greatest(b.w, p.w)) * (least(b.s + 2, p.n) - greatest(b.s, p.s)), 9) AS overlap FROM b, p WHERE b.w < p.e AND p.w < b.w + 3 AND b.s < p.n AND p.s < b.s + 2"
)
def g06_polygon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common area of every footprint with a region, after a box join."""
    e = polygons.edges_of(boxes(spark, sf_dir), ["poly_id"])
    region = polygons.edge_table(spark, {"region": [[[(7.0, 1.5), (12.5, 1.5), (12.5, 4.25), (7.0, 4.25)]]]})
    near = polygons.touching_boxes(polygons.bounds(e, "poly_id"), polygons.bounds(region, "poly_id").select(F.col("poly_id").alias("region"), *[F.col(c).alias(f"{c}_b") for c in ("west", "south", "east", "north")]), 3.0)
    pairs = near.select("poly_id", "region").join(polygons.edge_lists(e, "poly_id", "a"), "poly_id").join(polygons.edge_lists(region, "poly_id", "b").withColumnRenamed("poly_id", "region"), "region")
    return polygons.overlaps(pairs, ["poly_id"], ["a", "b"]).withColumn("overlap", F.round("overlap", 9))


@query("WITH b AS (SELECT s_suppkey AS id, s_suppkey % 17 AS w FROM supplier) SELECT id AS poly_id, round((least(w + 3, 9.2::DOUBLE) - greatest(w, -1.0)) / 3, 9) AS fraction FROM b WHERE (least(w + 3, 9.2::DOUBLE) - greatest(w, -1.0)) / 3 > 0.5")
def g08_district_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts of which more than half lies in the state."""
    e = polygons.edges_of(boxes(spark, sf_dir), ["poly_id"])
    state = polygons.edge_table(spark, {"state": [[[(-1.0, -1.0), (9.2, -1.0), (9.2, 50.0), (-1.0, 50.0)]]]}).drop("poly_id")
    whole = state.agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("b"))
    pairs = polygons.edge_lists(e, "poly_id", "a").crossJoin(F.broadcast(whole))  # one row
    found = polygons.overlaps(pairs, ["poly_id"], ["a", "b"]).join(polygons.areas(e, "poly_id"), "poly_id")
    return qa.assigned_districts(found).select("poly_id", F.round("fraction", 9).alias("fraction"))


@query(f"WITH {fx.SQL} SELECT pair_id, row, col FROM P WHERE inside AND footprint")
def g09_g10_inside_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the area that the footprint covers, from scanline spans."""
    raw = fx.raw_pixels(spark, sf_dir).select("pair_id", "row", "col").withColumn("r", F.col("row") % fx.PERIOD)
    for name, rings in (("area", fx.AREA), ("footprint", fx.FOOTPRINT)):
        inside = polygons.inside_pixels(fx.shape_spans(raw, name, rings)).select(F.col("row").alias("r"), "col")
        raw = raw.join(inside, ["r", "col"], "left_semi")
    return raw.select("pair_id", "row", "col")


@query("SELECT s_suppkey AS poly_id, 1::BIGINT AS rings, CASE WHEN s_suppkey % 6 = 2 THEN 2 ELSE 4 END::BIGINT AS edges, true AS finite, s_suppkey % 6 <> 2 AS enough_points, s_suppkey % 6 <> 2 AS has_area, s_suppkey % 6 = 1 AS crossed FROM supplier")
def g11_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that shapes break, some of which cross themselves or have no area."""
    e = polygons.edges_of(odd_shapes(spark, sf_dir), ["poly_id"])
    crossed = polygons.self_intersections(e, "poly_id").select("poly_id").distinct().withColumn("crossed", F.lit(True))
    return polygons.validity(e, "poly_id").join(crossed, "poly_id", "left").withColumn("crossed", F.coalesce("crossed", F.lit(False)))


def odd_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes, but a sixth of them twisted and a sixth without area."""
    k, w, s = F.col("s_suppkey"), F.col("s_suppkey") % 17, F.col("s_suppkey") % 5
    ring = lambda *points: F.array(F.array(F.array(*[F.struct((w + a).cast("double").alias("x"), (s + b).cast("double").alias("y")) for a, b in points])))
    shape = F.when(k % 6 == 1, ring((0, 0), (3, 2), (3, 0), (0, 1))).when(k % 6 == 2, ring((0, 0), (3, 2))).otherwise(ring((0, 0), (3, 0), (3, 2), (0, 2)))
    return fx.table(spark, sf_dir, "supplier").select(k.alias("poly_id"), shape.alias("geometry"))


@query("SELECT s_suppkey AS k, floor((s_suppkey % 17 + 0.25::DOUBLE - 1.5) / 0.75)::BIGINT AS col_off, (ceil((s_suppkey % 17 + 3.25::DOUBLE - 1.5) / 0.75) - floor((s_suppkey % 17 + 0.25::DOUBLE - 1.5) / 0.75))::BIGINT AS width, floor((20 - (s_suppkey % 5 + 2.25::DOUBLE)) / 0.5)::BIGINT AS row_off, (ceil((20 - (s_suppkey % 5 + 0.25::DOUBLE)) / 0.5) - floor((20 - (s_suppkey % 5 + 2.25::DOUBLE)) / 0.5))::BIGINT AS height FROM supplier")
def g03_g07_aligned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows snapped outward to the grid."""
    w, s = F.col("s_suppkey") % 17 + 0.25, F.col("s_suppkey") % 5 + 0.25
    b = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), w.alias("west"), s.alias("south"), (w + 3).alias("east"), (s + 2).alias("north"), F.lit(1.5).alias("x0"), F.lit(20.0).alias("y0"), F.lit(0.75).alias("dx"), F.lit(-0.5).alias("dy"))
    return grid.aligned_window(b).select("k", "col_off", "width", "row_off", "height")


def _utm_sql() -> str:
    """Easting and northing by a power series in longitude, another method than the operator's."""
    a, e2 = projection.SEMI_MAJOR, projection.FLATTENING * (2 - projection.FLATTENING)
    arc = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256 - 175 * e2**4 / 16384, 3 / 8 * (e2 + e2**2 / 4 + 15 * e2**3 / 128 - 455 * e2**4 / 4096), 15 / 256 * (e2**2 + 3 * e2**3 / 4 - 77 * e2**4 / 128), 35 / 3072 * (e2**3 - 41 * e2**4 / 32))
    return f"""p AS (SELECT c_custkey AS k, 2.0::DOUBLE + (c_custkey % 40) / 20.0::DOUBLE AS lon, 5.0::DOUBLE + (c_custkey % 37) / 10.0::DOUBLE AS lat FROM customer),
q AS (SELECT *, radians(lat) AS f, tan(radians(lat)) * tan(radians(lat)) AS t, {e2 / (1 - e2)!r}::DOUBLE * cos(radians(lat)) * cos(radians(lat)) AS c, radians(lon - 3) * cos(radians(lat)) AS v, {a!r}::DOUBLE / sqrt(1 - {e2!r}::DOUBLE * sin(radians(lat)) * sin(radians(lat))) AS n FROM p),
m AS (SELECT *, {a!r}::DOUBLE * ({arc[0]!r}::DOUBLE * f - {arc[1]!r}::DOUBLE * sin(2 * f) + {arc[2]!r}::DOUBLE * sin(4 * f) - {arc[3]!r}::DOUBLE * sin(6 * f)) AS arc, {e2 / (1 - e2)!r}::DOUBLE AS ep FROM q)
SELECT k, round(500000 + 0.9996::DOUBLE * n * (v + (1 - t + c) * v ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * v ** 5 / 120), 0) AS easting,
  round(0.9996::DOUBLE * (arc + n * tan(f) * (v * v / 2 + (5 - t + 9 * c + 4 * c * c) * v ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * v ** 6 / 720)), 0) AS northing, round(lon, 9) AS lon, round(lat, 9) AS lat FROM m"""


@query(f"WITH {_utm_sql()}")
def g01_g02_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected coordinates, to the metre, and what the inverse makes of them."""
    lon, lat = F.lit(2.0) + (F.col("c_custkey") % 40) / F.lit(20.0), F.lit(5.0) + (F.col("c_custkey") % 37) / F.lit(10.0)
    base = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), lon.alias("lon"), lat.alias("lat"))
    x, y = projection.to_utm(F.col("lon"), F.col("lat"))
    there = base.select("k", x.alias("x"), y.alias("y"))
    lon2, lat2 = projection.to_lonlat(F.col("x"), F.col("y"))
    return there.select("k", F.round("x", 0).alias("easting"), F.round("y", 0).alias("northing"), F.round(lon2, 9).alias("lon"), F.round(lat2, 9).alias("lat"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = integrity.digests(files(spark, sf_dir)).withColumn("k", F.col("path").cast("long"))
    broken = F.when(F.col("k") % 50 == 0, F.lit("0")).otherwise(F.col("sha256"))
    old = d.filter("k % 77 != 0").select("path", "bytes", broken.alias("sha256"), F.lit(1).alias("recorded_utc"))
    new = d.filter("k % 33 = 0").select("path", "bytes", "sha256", F.lit(2).alias("recorded_utc"))
    return integrity.upsert(old, new)


_FILES = "f AS (SELECT doc_id AS k, doc_id::VARCHAR AS path, strlen(coalesce(text, '')) AS bytes, sha256(coalesce(text, '')) AS sha, md5(coalesce(text, '')) AS md5 FROM documents), mf AS (SELECT k, path, bytes, CASE WHEN k % 33 = 0 THEN sha WHEN k % 50 = 0 THEN '0' ELSE sha END AS sha256, CASE WHEN k % 33 = 0 THEN 2 ELSE 1 END AS recorded_utc FROM f WHERE k % 77 <> 0 OR k % 33 = 0)"


@query(f"WITH {_FILES} SELECT path, bytes, sha AS sha256, md5 FROM f")
def s11_c05_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digests of files."""
    return integrity.digests(files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path, bytes, sha256, recorded_utc FROM mf")
def u03_manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir)


@query(f"WITH {_FILES} SELECT mf.path, 'sha256' AS failure FROM mf JOIN f USING (k) WHERE mf.sha256 <> f.sha AND k % 10 <> 0 UNION ALL SELECT mf.path, CASE WHEN k % 20 = 0 THEN 'missing' ELSE 'sha256' END FROM mf JOIN f USING (k) WHERE k % 20 = 0 OR (mf.sha256 <> f.sha AND k % 10 = 0)")
def j07_manifest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries whose file is missing or differs."""
    there = integrity.digests(files(spark, sf_dir)).filter(F.col("path").cast("long") % 20 != 0)
    return integrity.failures(manifest(spark, sf_dir), there)


@query(f"WITH {_FILES} SELECT path FROM f WHERE k NOT IN (SELECT k FROM mf)")
def j08_missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.missing_assets(files(spark, sf_dir).select("path"), manifest(spark, sf_dir))


@query("SELECT c_nationkey AS product, list_sort(list_distinct(list(CASE WHEN c_custkey % 29 = 0 THEN 'other' WHEN c_custkey % 2 = 0 THEN 'Sigma0_VH' ELSE 'Sigma0_VV' END))) = ['Sigma0_VH', 'Sigma0_VV'] AND bool_and(c_custkey % 31 <> 0) AND bool_and(c_custkey % 37 <> 0) AS ok FROM customer GROUP BY ALL")
def f11_band_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    bands = fx.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("product"), F.when(k % 29 == 0, "other").when(k % 2 == 0, "Sigma0_VH").otherwise("Sigma0_VV").alias("band"), k.alias("band_index"), (k % 31 != 0).alias("nodata_used"), F.when(k % 37 == 0, F.lit(None)).otherwise(0).alias("nodata"))
    return integrity.band_metadata_failures(bands).select("product", "ok")


_ARCHIVES = f"""{_SCENES}, ar AS (SELECT scene_name AS scene_id, bytes + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS bytes, CASE WHEN k % 17 = 0 THEN 'x' ELSE md5sum END AS md5, path_number + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS relative_orbit, lower(flight_direction) AS pass_direction,
CASE WHEN k % 23 = 0 THEN 'EW' ELSE 'IW' END AS mode, k % 29 <> 0 AS dual, bytes AS c_bytes, md5sum AS c_md5, path_number AS c_orbit FROM sc)"""


@query(f"WITH {_ARCHIVES} SELECT scene_id, unnest(list_filter([CASE WHEN bytes <> c_bytes THEN 'bytes' END, CASE WHEN md5 IS DISTINCT FROM c_md5 THEN 'md5' END, CASE WHEN relative_orbit <> c_orbit THEN 'relative_orbit' END, CASE WHEN mode <> 'IW' THEN 'mode' END, CASE WHEN NOT dual THEN 'polarizations' END], lambda x: x IS NOT NULL)) AS rule FROM ar")
def f12_archive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that archives break against the catalog."""
    s = scenes(spark, sf_dir).withColumn("k", F.substring("scene_name", 2, 7).cast("long"))
    cat = s.select(F.col("scene_name").alias("scene_id"), "bytes", F.col("md5sum").alias("md5"), F.col("path_number").alias("relative_orbit"), F.col("flight_direction").alias("pass_direction"), F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"))
    k = F.col("k")
    arc = s.select(
        F.col("scene_name").alias("scene_id"),
        (F.col("bytes") + F.when(k % 13 == 0, 1).otherwise(0)).alias("bytes"),
        F.when(k % 17 == 0, "x").otherwise(F.col("md5sum")).alias("md5"),
        (F.col("path_number") + F.when(k % 19 == 0, 1).otherwise(0)).alias("relative_orbit"),
        F.lower("flight_direction").alias("pass_direction"),
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("start_time"),
        F.when(k % 23 == 0, "EW").otherwise("IW").alias("mode"),
        F.when(k % 29 == 0, F.array(F.lit("VV"))).otherwise(F.array(F.lit("VV"), F.lit("VH"))).alias("polarizations"),
    )
    return integrity.archive_failures(arc, cat)


_KINDS = ["/measurement/s1a-vv-1.tiff", "/measurement/s1a-vh-1.tiff", "/annotation/s1a-vv-1.xml", "/annotation/calibration/calibration-s1a-vh-1.xml", "/annotation/calibration/noise-s1a-vv-1.xml", "/manifest.safe", "/preview/icon.png"]


@query(
    "WITH m AS (SELECT l_orderkey % 50 AS archive, l_partkey % 7 AS k FROM lineitem) SELECT archive, kind, count(*) FILTER (k IN (0, 2, 4)) AS vv, count(*) FILTER (k IN (1, 3)) AS vh, count(*) FILTER (k IN (5, 6)) AS \"none\" FROM (SELECT *, ['measurement', 'measurement', 'annotation', 'calibration', 'noise', 'manifest', 'other'][k + 1] AS kind FROM m) GROUP BY ALL"
)
def f13_member_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members by kind and polarization."""
    names = F.array(*map(F.lit, _KINDS))
    m = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("archive"), F.concat(F.lit("S1.SAFE"), F.element_at(names, (F.col("l_partkey") % 7 + 1).cast("int"))).alias("member"))
    return integrity.member_counts(m)


_RASTERS = "r AS (SELECT ['occurrence_', 'seasonality_', 'rain_'][p_partkey % 3 + 1] || p_brand || '_' || p_size % 10 AS raster_id, CASE WHEN p_partkey % 3 = 1 THEN p_size % 10 + (p_partkey % 40) // 10 ELSE p_size * 2 + CASE WHEN p_partkey % 50 = 3 THEN 30 ELSE 0 END END::DOUBLE AS v, p_size % 10 = 7 OR p_partkey % 11 = 0 AS gone, p_partkey % 97 = 5 AS nan FROM part)"


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of many rasters of three kinds, with nodata marks, some only nodata, and NaN."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.element_at(F.array(F.lit("occurrence_"), F.lit("seasonality_"), F.lit("rain_")), (k % 3 + 1).cast("int")), F.col("p_brand"), F.lit("_"), (size % 10).cast("string"))
    value = F.when(k % 3 == 1, size % 10 + F.floor((k % 40) / 10)).otherwise(size * 2 + F.when(k % 50 == 3, 30).otherwise(0)).cast("double")
    marked = F.when((size % 10 == 7) | (k % 11 == 0), F.lit(-9999.0)).when(k % 97 == 5, F.lit(float("nan"))).otherwise(value)
    return fx.table(spark, sf_dir, "part").select(name.alias("raster_id"), marked.alias("value"))


@query(f"WITH {_RASTERS} SELECT raster_id, count(*) FILTER (NOT gone AND NOT nan) AS valid_aoi_pixels, count(*) FILTER (nan AND NOT gone) AS not_finite, min(v) FILTER (NOT gone AND NOT nan) AS min, max(v) FILTER (NOT gone AND NOT nan) AS max, round(avg(v) FILTER (NOT gone AND NOT nan), 6) AS mean FROM r GROUP BY ALL")
def m20_raster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.raster_summary(rasters(spark, sf_dir), -9999.0).withColumn("mean", F.round("mean", 6))


@query(
    f"WITH {_RASTERS}, s AS (SELECT raster_id, count(*) FILTER (NOT gone AND NOT nan) AS n, count(*) FILTER (nan AND NOT gone) AS odd, max(v) FILTER (NOT gone AND NOT nan) AS high FROM r GROUP BY ALL) "
    "SELECT raster_id, 'empty' AS failure FROM s WHERE n = 0 UNION ALL SELECT raster_id, 'not finite' FROM s WHERE odd > 0 UNION ALL SELECT raster_id, 'domain' FROM s WHERE high > CASE WHEN raster_id LIKE 'occ%' THEN 100 WHEN raster_id LIKE 'sea%' THEN 12 END"
)
def m21_domain_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters that are empty, have cells that are no numbers, or exceed the domain of their kind."""
    return qa.domain_failures(qa.raster_summary(rasters(spark, sf_dir), -9999.0))


@query("WITH d AS (SELECT user_id, count(DISTINCT ts::DATE) FILTER (ts::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-26') AS days FROM events GROUP BY ALL) SELECT user_id, days FROM d WHERE days < 25")
def m21_rain_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that lack one of the 25 days."""
    return qa.missing_days(fx.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id"], "2024-01-02", "2024-01-26")


_CELLS = "u AS (SELECT DISTINCT state, x + dx AS x, y + dy AS y FROM d, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy))"


@query(
    f"WITH d AS (SELECT s_nationkey AS state, s_name AS shape_name, s_suppkey % 11 AS x, (s_suppkey // 11) % 7 AS y FROM supplier), {_CELLS} "
    "SELECT state, count(*) AS districts, array_to_string(list_sort(list(shape_name)), ',') AS names, 4.0::DOUBLE * count(*) AS area, min(x)::DOUBLE AS west, min(y)::DOUBLE AS south, max(x) + 2.0::DOUBLE AS east, max(y) + 2.0::DOUBLE AS north, round(any_value(n) / 40.0::DOUBLE, 9) AS union_coverage "
    "FROM d JOIN (SELECT state, count(*) FILTER (x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 5) AS n FROM u GROUP BY ALL) USING (state) GROUP BY state"
)
def m22_area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, number, names and area of the districts of every state, and what they cover of it together."""
    x, y = F.col("s_suppkey") % 11, F.floor(F.col("s_suppkey") / 11) % 7
    ring = F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in ((0, 0), (2, 0), (2, 2), (0, 2))])
    districts = fx.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("state"), F.col("s_name").alias("shape_name"), F.array(F.array(ring)).alias("geometry"))
    states = districts.select("state").distinct().withColumn("geometry", box(1, 1, 9, 6))
    out = qa.area_summary(districts, states, "state")
    return out.withColumn("area", F.round("area", 6)).withColumn("union_coverage", F.round("union_coverage", 9))


@query("SELECT * FROM region WHERE lower(r_name) = 'africa'")
def f02_named_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one feature of a name, whatever its case."""
    r = fx.table(spark, sf_dir, "region").withColumn("shape_name", F.col("r_name"))
    return qa.named_area(r, "AfRiCa").drop("shape_name")


@query("SELECT s_nationkey AS pair_id, count(DISTINCT s_suppkey % 2) = 1 AS same_grid, bool_and(s_suppkey % 7 <> 0) AS spacing, bool_and(s_suppkey % 11 <> 0) AS unrotated, bool_and(s_suppkey % 13 <> 0) AS two_bands FROM supplier GROUP BY ALL")
def f10_grid_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    # the spacing's sign does not matter, so a wrong one is given by a wrong height only
    g = fx.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pair_id"), F.lit(32631).alias("epsg"), (k % 2).cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("dx"), F.lit(-10.0).alias("dy"), F.lit(9).alias("width"), F.lit(9).alias("height"), F.when(k % 11 == 0, 1.0).otherwise(0.0).alias("rot_x"), F.lit(0.0).alias("rot_y"), F.when(k % 13 == 0, 1).otherwise(2).alias("bands"), (k % 7 == 0).alias("odd"))
    checked = grid.compatibility(g.drop("odd"))
    spacing = grid.compatibility(g.withColumn("dx", F.when(F.col("odd"), 20.0).otherwise(10.0))).select("pair_id", "spacing")
    return checked.drop("spacing").join(spacing, "pair_id")


@query(f"WITH {fx.SQL} SELECT pair_id, row - 3 AS row, col - 5 AS col FROM P WHERE vh_before IS NOT NULL AND row >= 3 AND col >= 5 AND vh_before <> 0 AND ((row + col) % 11 = 0 OR (row + col) % 11 = 1)")
def f17_reference_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values aligned by a shift of the grid that differ from the source at the shifted index: those spoilt here and no other."""
    source = backscatter.without_nodata(fx.raw_pixels(spark, sf_dir))
    grid = source.select("pair_id", (F.col("row") - 3).alias("row"), (F.col("col") - 5).alias("col")).filter("row >= 0 AND col >= 0")
    aligned = resample.nearest(grid, source, F.col("col") + 5.5, F.col("row") + 3.5, "vh_before", keys=["pair_id"])
    spoilt = F.when((F.col("row") + F.col("col") + 8) % 11 == 0, F.col("vh_before") * 1.001).when((F.col("row") + F.col("col") + 8) % 11 == 1, F.col("vh_before") * 0.9999).otherwise(F.col("vh_before"))
    aligned = aligned.withColumn("vh_before", spoilt.cast("float"))
    return integrity.changed_samples(aligned, source, "vh_before", 3, 5, ["pair_id"]).select("pair_id", "row", "col")


@query(f"WITH {fx.SQL} SELECT pair_id, row, col FROM P WHERE row >= 2 AND row < 9 AND col >= 4 AND col < 100 AND inside")
def s12_window_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the area inside a window."""
    raw = fx.raw_pixels(spark, sf_dir).select("pair_id", "row", "col")
    window = raw.select("pair_id").distinct().withColumns({"row_off": F.lit(2), "col_off": F.lit(4), "height": F.lit(7), "width": F.lit(96)})
    return fx.flagged(grid.crop(raw, window, ["pair_id"])).filter("inside").select("pair_id", "row", "col")


@query(f"WITH {fx.SQL}, {{j}} SELECT pair_id, row, col, round(vh_before::DOUBLE, 6) AS vh_before, round(vv_before::DOUBLE, 6) AS vv_before, round(vh_after::DOUBLE, 6) AS vh_after, round(vv_after::DOUBLE, 6) AS vv_after, coalesce(pair_mask, 255) AS pair_mask, coalesce(occurrence, 255) AS occurrence FROM j".replace("{j}", "j AS (SELECT raw.pair_id, raw.row, raw.col, CASE WHEN isfinite(vh_before) THEN vh_before END AS vh_before, vv_before, vh_after, vv_after, CASE WHEN (raw.row + raw.col) % 4 <> 0 THEN ((raw.row + raw.col) % 4 > 1)::INT END AS pair_mask, occurrence FROM raw LEFT JOIN w0 ON wrow = row // 3 AND wcol = col // 3)"))
def j02_aligned_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before, after, mask and water layers, each a table of its own, joined by pixel."""
    raw = fx.raw_pixels(spark, sf_dir)
    before = raw.select("pair_id", "row", "col", F.col("vh_before").alias("vh"), F.col("vv_before").alias("vv"))
    after = raw.filter("vh_after IS NOT NULL").select("pair_id", "row", "col", F.col("vh_after").alias("vh"), F.col("vv_after").alias("vv"))
    mask = raw.filter((F.col("row") + F.col("col")) % 4 != 0).select("pair_id", "row", "col", ((F.col("row") + F.col("col")) % 4 > 1).cast("int").alias("pair_mask"))
    water = fx.water_cells(spark, sf_dir).select(F.col("wrow").alias("row"), F.col("wcol").alias("col"), "occurrence")
    joined = resample.nearest(backscatter.aligned(before, after, mask), water, (F.col("col") + 0.5) / fx.WATER_SCALE, (F.col("row") + 0.5) / fx.WATER_SCALE, "occurrence")
    clean = joined.withColumns({"vh_before": known(F.col("vh_before")), "pair_mask": F.coalesce("pair_mask", F.lit(255)), "occurrence": F.coalesce("occurrence", F.lit(255))})
    return clean.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in backscatter.VALUES})


_XML = [("startTime", "strftime(ts, '%Y-%m-%dT%H:%M:%S')"), ("mode", "'IW'"), ("relativeOrbitNumber", "(event_id % 5)::VARCHAR"), ("pass", "CASE WHEN event_id % 3 <> 0 THEN event_type END"), ("transmitterReceiverPolarisation", "'VV' || CASE WHEN event_id % 2 = 0 THEN ',VH' ELSE '' END")]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT event_id, '{n}' AS name, {v} AS texts FROM events" for n, v in _XML) + ") WHERE texts IS NOT NULL")
def c06_xml_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of scene manifests in XML, by name."""
    k = F.col("event_id")
    element = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    xml = F.concat(
        F.lit("<?xml version='1.0'?><x:XFDU xmlns:x='urn:x' xmlns:safe='urn:s'><meta>"),
        element("safe:startTime", F.concat(F.lit("\n "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "))),
        element("safe:orbit", F.concat(element("safe:relativeOrbitNumber", (k % 5).cast("string")), element("pass", F.when(k % 3 == 0, F.lit("  ")).otherwise(F.col("event_type"))))),
        element("safe:mode", F.lit("IW")),
        element("transmitterReceiverPolarisation", F.lit("VV")),
        F.when(k % 2 == 0, element("safe:transmitterReceiverPolarisation", F.lit("VH"))).otherwise(F.lit("")),
        F.lit("<other>mode</other></meta></x:XFDU>"),
    )
    events = spread(fx.table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "event_id")  # a row group of short rows makes many documents
    found = integrity.xml_fields(events.select("event_id", xml.alias("xml")), [n for n, _ in _XML], ["event_id"])
    return found.select("event_id", "name", F.array_join("values", ",").alias("texts"))


@query("SELECT s_suppkey AS k, printf('DEM_%s%02d_00_%s%03d_00', 'N', lat, 'E', lon) AS tile FROM (SELECT s_suppkey, unnest(range((s_suppkey % 5)::BIGINT, (s_suppkey % 5 + 3)::BIGINT)) AS lat, s_suppkey % 17 AS w FROM supplier), (SELECT unnest(range(0, 4)) AS d), LATERAL (SELECT w + d AS lon)")
def s13_dem_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-degree tiles that cover bounds."""
    w, s = F.col("s_suppkey") % 17 + 0.25, F.col("s_suppkey") % 5 + 0.25
    b = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), w.alias("west"), s.alias("south"), (w + 3).alias("east"), (s + 2).alias("north"))
    return tables.dem_tiles(b, "k")


@query(f"SELECT row, col, arg_min(value, t) AS value FROM (SELECT (c_custkey // 100)::INT AS row, (c_custkey % 70)::INT AS col, c_custkey AS t, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS value FROM customer) WHERE value IS NOT NULL GROUP BY ALL")
def s14_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tile with a value wins."""
    t = fx.table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey div 100 AS INT) AS row", "CAST(c_custkey % 70 AS INT) AS col", "c_custkey AS tile_order", "CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS value")
    return tables.mosaic(t)


@query("SELECT strftime(day, '%Y%m%d') AS layer, count(*) AS scenes FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-25', INTERVAL 1 DAY))::DATE AS day) JOIN events ON ts::DATE = day GROUP BY ALL")
def s15_daily_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily layers and the scenes of each day."""
    days = tables.daily_layers(spark, "2024-01-01", "2024-01-25")
    ev = fx.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    return ev.join(days, "day").groupBy("layer").agg(F.count("*").alias("scenes"))


@query(f"SELECT CASE WHEN ts < {SQL_START} THEN 'before' WHEN ts < {SQL_END} THEN 'during' ELSE 'after' END AS period, count(*) AS n FROM events GROUP BY ALL")
def f01_event_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").groupBy(event_period(F.col("ts"), START, END).alias("period")).agg(F.count("*").alias("n"))
