"""Queries over candidate points, terrain, patches and historical water, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audit, candidates, components, patches, polygons, projection, resample, terrain, water
from tidemark.sources.shared import stored

from . import fixtures as fx
from .pixel_queries import LABELS_SQL, rounded

QUERIES: dict = {}
ORACLES: dict = {}
LEAST = 9


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {fx.SQL}, {LABELS_SQL}, {_POINTS_SQL} {sql}" if not sql.startswith("WITH") else sql
        return f

    return keep


_CORNER = " UNION ALL ".join(
    f"SELECT t.pair_id, t.row, t.col, {'fx' if dc else '(1 - fx)'} * {'fy' if dr else '(1 - fy)'} AS w, elevation::DOUBLE AS v FROM t JOIN dem ON dem.pair_id = t.pair_id AND dem.row = r0 + {dr} AND dem.col = c0 + {dc} WHERE elevation IS NOT NULL" for dr in (0, 1) for dc in (0, 1)
)
_GX = " + ".join(f"{c * (2 - abs(r))} * n{r + 1}{c + 1}.elevation::DOUBLE" for r in (-1, 0, 1) for c in (-1, 0, 1))
_GY = " + ".join(f"{r * (2 - abs(c))} * n{r + 1}{c + 1}.elevation::DOUBLE" for r in (-1, 0, 1) for c in (-1, 0, 1))
_NEAR = " ".join(f"LEFT JOIN dem n{r + 1}{c + 1} ON n{r + 1}{c + 1}.pair_id = d.pair_id AND n{r + 1}{c + 1}.row = d.row + {r} AND n{r + 1}{c + 1}.col = d.col + {c}" for r in (-1, 0, 1) for c in (-1, 0, 1))
_POINTS_SQL = f"""t AS (SELECT pair_id, row, col, floor((col + 0.5::DOUBLE) / 4 - 0.5)::INT AS c0, floor((row + 0.5::DOUBLE) / 4 - 0.5)::INT AS r0, (col + 0.5::DOUBLE) / 4 - 0.5 - floor((col + 0.5::DOUBLE) / 4 - 0.5) AS fx, (row + 0.5::DOUBLE) / 4 - 0.5 - floor((row + 0.5::DOUBLE) / 4 - 0.5) AS fy FROM cand),
bil AS (SELECT pair_id, row, col, sum(w * v) / sum(w) AS z FROM ({_CORNER}) GROUP BY pair_id, row, col HAVING sum(w) > 0),
slo AS (SELECT d.pair_id, d.row, d.col, degrees(atan(sqrt((({_GX}) / 240) * (({_GX}) / 240) + (({_GY}) / 240) * (({_GY}) / 240)))) AS slope FROM dem d {_NEAR}),
siz AS (SELECT pair_id, label, count(*) AS pixels, printf('C%04d', row_number() OVER (PARTITION BY pair_id ORDER BY label)) AS any_id FROM lab GROUP BY pair_id, label),
big AS (SELECT pair_id, label, pixels, printf('C%04d', row_number() OVER (PARTITION BY pair_id ORDER BY label)) AS patch_id FROM siz WHERE pixels >= {LEAST}),
pts AS MATERIALIZED (SELECT P.pair_id, P.row, P.col, lab.label, (siz.pixels >= {LEAST})::INT AS retained_after_cleanup, big.patch_id, vh_before_db AS june_vh_db, vv_before_db AS june_vv_db, vh_after_db AS july_vh_db, vv_after_db AS july_vv_db, vh_change AS delta_vh_db, vv_change AS delta_vv_db, z AS dsm_elevation_m, slope, occurrence
  FROM lab JOIN P USING (pair_id, row, col) JOIN siz USING (pair_id, label) LEFT JOIN big ON big.pair_id = lab.pair_id AND big.label = lab.label LEFT JOIN bil ON bil.pair_id = P.pair_id AND bil.row = P.row AND bil.col = P.col LEFT JOIN slo ON slo.pair_id = P.pair_id AND slo.row = P.row // 4 AND slo.col = P.col // 4),
pat AS (SELECT * FROM pts WHERE patch_id IS NOT NULL)"""


def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.horn_slope(fx.dem_cells(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate points with cleanup flag, patch, band values, elevation, slope and occurrence."""
    chosen = candidates.selected(fx.pixels(spark, sf_dir))
    # labelled with all columns and stored; sizes and names are few rows and join once
    lab = stored(components.labelled(chosen, 64, [c for c in chosen.columns if c not in ("pair_id", "row", "col")]))
    sized = components.component_sizes(lab)
    named = components.ranked(sized.filter(F.col("pixels") >= LEAST)).select("pair_id", "label", "patch_id")
    base = lab.join(sized.join(named, ["pair_id", "label"], "left"), ["pair_id", "label"])
    at = ((F.col("col") + 0.5) / fx.DEM_SCALE, (F.col("row") + 0.5) / fx.DEM_SCALE)
    high = resample.bilinear(base, fx.dem_cells(spark, sf_dir), *at, "elevation", ["pair_id", "row", "col"], [c for c in base.columns if c not in ("pair_id", "row", "col")], ["pair_id"])
    out = resample.nearest(high, slopes(spark, sf_dir), *at, "slope", keys=["pair_id"])
    names = {"vh_before_db": "june_vh_db", "vv_before_db": "june_vv_db", "vh_after_db": "july_vh_db", "vv_after_db": "july_vv_db", "vh_change": "delta_vh_db", "vv_change": "delta_vv_db", "elevation": "dsm_elevation_m"}
    return out.select("pair_id", "row", "col", "label", (F.col("pixels") >= LEAST).cast("int").alias("retained_after_cleanup"), "patch_id", *[F.col(a).alias(b) for a, b in names.items()], "slope", "occurrence")


def patch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter("patch_id IS NOT NULL")


@query("SELECT pair_id, row, col, round(slope, 5) AS slope FROM slo")
def w01_horn_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slopes(spark, sf_dir).withColumn("slope", F.round("slope", 5))


@query("SELECT pair_id, row, col, round(dsm_elevation_m, 5) AS elevation, round(slope, 5) AS slope FROM pts")
def r02_r05_terrain_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear elevation and nearest slope at candidates."""
    return points(spark, sf_dir).select("pair_id", "row", "col", F.round("dsm_elevation_m", 5).alias("elevation"), F.round("slope", 5).alias("slope"))


@query("SELECT P.pair_id, P.row, P.col, coalesce(w0.occurrence, 255) AS occurrence FROM P LEFT JOIN w0 ON wrow = row // 3 AND wcol = col // 3")
def r01_nearest_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest resampling of the coarse water raster, 255 where unknown."""
    cells = fx.water_cells(spark, sf_dir).selectExpr("wrow AS row", "wcol AS col", "occurrence")
    base = fx.raw_pixels(spark, sf_dir).select("pair_id", "row", "col")
    return resample.nearest(base, cells, (F.col("col") + 0.5) / fx.WATER_SCALE, (F.col("row") + 0.5) / fx.WATER_SCALE, "occurrence", F.lit(255))


_SHIFT = " UNION ALL ".join(
    f"SELECT s.pair_id, s.row, s.col, {'0.3::DOUBLE' if dc else '0.7::DOUBLE'} * {'0.6::DOUBLE' if dr else '0.4::DOUBLE'} AS w, b.vh_after::DOUBLE AS v FROM P s JOIN P b ON b.pair_id = s.pair_id AND b.row = s.row + {dr} AND b.col = s.col + {dc} WHERE b.vh_after IS NOT NULL" for dr in (0, 1) for dc in (0, 1)
)


@query(f"SELECT s.pair_id, s.row, s.col, round(z, 6) AS vh_after FROM P s LEFT JOIN (SELECT pair_id, row, col, sum(w * v) / sum(w) AS z FROM ({_SHIFT}) GROUP BY pair_id, row, col) USING (pair_id, row, col)")
def r02_bilinear_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampling by a fraction of a pixel, missing neighbours left out."""
    p = fx.pixels(spark, sf_dir).select("pair_id", "row", "col", "vh_after")
    moved = resample.bilinear(p, p, F.col("col") + F.lit(0.5) + F.lit(0.3), F.col("row") + F.lit(0.5) + F.lit(0.6), "vh_after", ["pair_id", "row", "col"], keys=["pair_id"])
    return moved.withColumn("vh_after", F.round("vh_after", 6))


_SUBSETS = "(SELECT *, 'raw' AS subset FROM pts UNION ALL SELECT *, 'clean' FROM pts WHERE retained_after_cleanup = 1)"
_MEASURED = ["june_vh_db", "june_vv_db", "july_vh_db", "july_vv_db", "delta_vh_db", "delta_vv_db", "dsm_elevation_m"]


@query(
    "SELECT pair_id, subset, measure, count(v) AS count, "
    + ", ".join(f"round({x}, 5) AS {n}" for n, x in [("min", "min(v)"), *((n, f"quantile_cont(v, {q})") for n, q in audit.QUANTILES), ("max", "max(v)"), ("mean", "avg(v)")])
    + " FROM ("
    + " UNION ALL ".join(f"SELECT pair_id, subset, '{m}' AS measure, {m}::DOUBLE AS v FROM {_SUBSETS}" for m in _MEASURED)
    + ") GROUP BY ALL"
)
def m11_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of raw and clean candidates."""
    d = audit.describe(audit.raw_and_clean(points(spark, sf_dir)), _MEASURED, ["pair_id", "subset"])
    return d.withColumns({c: F.round(c, 5) for c in ("min", "max", "mean", *(n for n, _ in audit.QUANTILES))})


@query(
    "SELECT pair_id, subset, count(*) AS pixels, " + ", ".join(f"count(*) FILTER (dsm_elevation_m <= {e}) AS le_{e}" for e in audit.ELEVATIONS) + f", count(*) FILTER (dsm_elevation_m IS NULL) AS missing, count(*) FILTER (delta_vv_db < 0) AS vv_decrease FROM {_SUBSETS} GROUP BY ALL"
)
def m14_elevation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.elevation_counts(audit.raw_and_clean(points(spark, sf_dir)), ["pair_id", "subset"])


@query(
    "SELECT pair_id, subset, count(*) AS pixels, count(*) FILTER (slope IS NULL) AS unknown, round(median(slope), 5) AS median_slope, "
    + ", ".join(f"count(*) FILTER (slope <= {n}) AS kept_{n}, round(count(*) FILTER (slope <= {n}) * 0.0001::DOUBLE, 6) AS km2_{n}" for n in terrain.SLOPE_LIMITS)
    + f" FROM {_SUBSETS} GROUP BY ALL"
)
def m15_slope_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = terrain.slope_sensitivity(points(spark, sf_dir)).withColumn("median_slope", F.round("median_slope", 5))
    return rounded(s, *(f"km2_{n}" for n in terrain.SLOPE_LIMITS))


@query(
    "SELECT pair_id, patch_id, count(*) AS pixels, round(count(*) * 100.0::DOUBLE, 6) AS area_m2, round(count(*) * 0.01::DOUBLE, 6) AS area_ha, 'unreviewed' AS status, "
    + ", ".join(f"round(median({m}::DOUBLE), 5) AS {m}_median" for m in patches.MEASURES)
    + ", count(slope) AS slope_known_pixels, round(100 * avg((delta_vv_db < 0)::INT::DOUBLE), 6) AS vv_decrease_pct FROM pat GROUP BY ALL"
)
def m12_zonal_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zonal medians and rates per patch."""
    z = patches.zonal(patch_points(spark, sf_dir)).withColumns({f"{m}_median": F.round(f"{m}_median", 5) for m in patches.MEASURES})
    return rounded(z, "area_m2", "area_ha", "vv_decrease_pct")


@query("SELECT pair_id, count(*) AS patches, round(sum(n * 0.0001::DOUBLE), 6) AS total_km2, min(n) AS smallest, max(n) AS largest FROM (SELECT pair_id, patch_id, count(*) AS n FROM pat GROUP BY ALL) GROUP BY pair_id")
def m19_patch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patches.summary(patch_points(spark, sf_dir).groupBy("pair_id", "patch_id").agg(F.count("*").alias("pixels"))), "total_km2")


def _patch_edges_sql() -> str:
    sides = [(0, 0, 1, 0, -1, 0), (1, 0, 1, 1, 0, 1), (1, 1, 0, 1, 1, 0), (0, 1, 0, 0, 0, -1)]
    return " UNION ALL ".join(f"SELECT a.pair_id, a.patch_id, a.col + {x1} AS x1, a.row + {y1} AS y1, a.col + {x2} AS x2, a.row + {y2} AS y2 FROM pat a LEFT JOIN pat b ON b.pair_id = a.pair_id AND b.patch_id = a.patch_id AND b.row = a.row + {dr} AND b.col = a.col + {dc} WHERE b.row IS NULL" for x1, y1, x2, y2, dr, dc in sides)


@query(f"SELECT * FROM ({_patch_edges_sql()})")
def g12_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell edges around every patch, shared ones cancelled."""
    return patches.boundary_edges(patch_points(spark, sf_dir), ["pair_id", "patch_id"])


@query("SELECT pair_id, patch_id, count(*)::DOUBLE AS area FROM pat GROUP BY ALL")
def g05_g12_outline_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the traced outlines: the number of pixels."""
    rings = patches.outlines(patch_points(spark, sf_dir).select("pair_id", "patch_id", "row", "col"), ["pair_id", "patch_id"])
    return rings.groupBy("pair_id", "patch_id").agg(F.sum("signed_area").alias("area"))


@query("SELECT pair_id, patch_id, row, col FROM pat WHERE col % 7 = 0")
def g13_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels lost or won by tracing and rasterising again: none but those taken from the labels afterwards."""
    pts = patch_points(spark, sf_dir).select("pair_id", "patch_id", "row", "col")
    edges = patches.ring_edges(patches.outlines(pts, ["pair_id", "patch_id"]), ["pair_id", "patch_id"])
    filled = polygons.inside_pixels(polygons.spans(edges, pts, ("pair_id", "patch_id")), ("pair_id", "patch_id"))
    return patches.round_trip_misses(pts.filter("col % 7 != 0"), filled, ["pair_id", "patch_id"]).select("pair_id", "patch_id", "row", "col")


_WATER = (
    "SELECT pair_id, patch_id, count(*) AS pixels, min(occ) AS occ_min, median(occ)::DOUBLE AS occ_median, max(occ) AS occ_max, count(occ) AS water_known_pixels, "
    + ", ".join(f"count(*) FILTER (occ >= {n}) AS occ_ge{n}_pixels, round(100.0::DOUBLE * count(*) FILTER (occ >= {n}) / count(*), 6) AS occ_ge{n}_pct" for n in water.CUTOFFS)
    + ", CASE WHEN 100.0::DOUBLE * count(*) FILTER (occ >= 50) / count(*) >= 50 THEN 'majority' WHEN count(*) FILTER (occ >= 1) > 0 THEN 'some' ELSE 'none' END AS water_review_flag FROM (SELECT *, CASE WHEN occurrence BETWEEN 0 AND 100 THEN occurrence END AS occ FROM pat) GROUP BY ALL"
)


def water_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(water.per_patch(patch_points(spark, sf_dir)), *(f"occ_ge{n}_pct" for n in water.CUTOFFS), "occ_median")


@query(_WATER)
def m13_f15_j05_patch_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical water per patch with review flags."""
    return water_summary(spark, sf_dir)


@query(f"SELECT * FROM ({_WATER}) WHERE patch_id = 'C0003'")
def f14_single_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = water.single_patch(patch_points(spark, sf_dir), "C0003")
    return rounded(w, *(f"occ_ge{n}_pct" for n in water.CUTOFFS), "occ_median")


@query("SELECT o.pair_id, o.occurrence::INT AS occurrence, count(pat.row) AS n FROM (SELECT pair_id, unnest(range(0, 101)) AS occurrence FROM (SELECT DISTINCT pair_id FROM pat)) o LEFT JOIN pat ON pat.pair_id = o.pair_id AND pat.occurrence = o.occurrence GROUP BY ALL")
def m16_occurrence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water.occurrence_histogram(patch_points(spark, sf_dir), ["pair_id"])


@query(
    "SELECT pair_id, cutoff, sum(hit)::BIGINT AS excluded_pixels, sum(pixels - hit)::BIGINT AS retained_pixels, count(*) FILTER (hit > 0) AS patches_any, count(*) FILTER (100.0::DOUBLE * hit / pixels >= 50) AS patches_half, count(*) FILTER (hit = pixels) AS patches_full, round(sum(hit) * 0.0001::DOUBLE, 6) AS excluded_km2, round(sum(pixels - hit) * 0.0001::DOUBLE, 6) AS retained_km2 FROM ("
    "SELECT pair_id, patch_id, c AS cutoff, count(*) AS pixels, count(*) FILTER (occurrence BETWEEN c AND 100) AS hit FROM pat, (SELECT unnest([1, 10, 25, 50, 75, 90]) AS c) GROUP BY ALL) GROUP BY pair_id, cutoff"
)
def m17_exclusion_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(water.exclusion_sensitivity(water_summary(spark, sf_dir)), "excluded_km2", "retained_km2")


@query(f"SELECT pair_id, water_review_flag, count(*) AS patches FROM ({_WATER}) GROUP BY ALL")
def m18_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water.flag_counts(water_summary(spark, sf_dir))


@query(f"SELECT w.pair_id, w.patch_id, round(w.pixels * 0.01::DOUBLE, 6) AS area_ha, w.water_review_flag FROM ({_WATER}) w")
def j06_patches_with_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one join of patches and their water summary."""
    pts = patch_points(spark, sf_dir)
    joined = water.joined_once(rounded(patches.zonal(pts), "area_ha"), water.per_patch(pts))
    return joined.select("pair_id", "patch_id", "area_ha", "water_review_flag")


@query("SELECT pair_id, row, col FROM pts WHERE row % 6 = 1 OR col % 9 = 2 OR (col % 9 = 3 AND NOT july_vh_db + 0.5::DOUBLE <= -21)")
def f18_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that break their own rule: none but those changed here, in the date before, the change, or both dates alike."""
    before, after, delta = F.col("june_vh_db"), F.col("july_vh_db"), F.col("delta_vh_db")
    spoilt = points(spark, sf_dir).withColumn("june_vh_db", F.when(F.col("row") % 6 == 1, F.lit(-21.0).cast("float")).otherwise(before))
    spoilt = spoilt.withColumn("delta_vh_db", F.when(F.col("col") % 9 == 2, (delta + 0.01).cast("float")).otherwise(delta))
    both = F.col("col") % 9 == 3
    spoilt = spoilt.withColumns({c: F.when(both, (F.col(c) + 0.5).cast("float")).otherwise(F.col(c)) for c in ("june_vh_db", "july_vh_db")})
    return candidates.rule_violations(spoilt).select("pair_id", "row", "col")


@query("SELECT pair_id, count(*) FILTER (col % 50 <> 0) AS left_value, count(*) AS right_value FROM pts GROUP BY pair_id HAVING count(*) FILTER (col % 50 = 0) > 0")
def m23_report_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate counts of the point table, of which some columns are left out here, against the sensitivity table."""
    counted = points(spark, sf_dir).filter("col % 50 != 0").groupBy("pair_id").agg(F.count("*").alias("n"))
    t, d = candidates.CHOSEN
    told = candidates.sensitivity(fx.pixels(spark, sf_dir)).filter((F.col("july_vh_max_db") == t) & (F.col("delta_vh_max_db") == d)).select("pair_id", F.col("retained_pixels").alias("n"))
    return audit.differences(counted, told, ["pair_id"], "n")


#: The terrain cells once more as a geographic raster: corner and width of its cells, in degrees.
LON0, LAT0, STEP = 3.25, 6.75, 1 / 3600


#: Upper left corner of the 10 m pixel grid that lies over it.
X0, Y0 = 527640.0, 746110.0


def _number(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def _inverse_sql(source: str, end: str) -> str:
    """From xi0 and eta0 of a table to source columns (sx, sy) in units of the geographic cells: the table c4 and its steps."""
    e = _number(projection.ECCENTRICITY)
    xi = "xi0" + "".join(f" - {_number(b)} * sin({2 * k} * xi0) * cosh({2 * k} * eta0)" for k, b in enumerate(projection.BETA, 1))
    eta = "eta0" + "".join(f" - {_number(b)} * cos({2 * k} * xi0) * sinh({2 * k} * eta0)" for k, b in enumerate(projection.BETA, 1))
    psi = "target"
    for _ in range(5):
        psi = f"(target + {e} * atanh({e} * tanh({psi})))"
    return f"""{end}2 AS (SELECT *, {xi} AS xi, {eta} AS eta FROM {source}),
{end}3 AS (SELECT *, asinh(sin(xi) / sqrt(sinh(eta) * sinh(eta) + cos(xi) * cos(xi))) AS target FROM {end}2),
{end}4 AS (SELECT *, (3 + degrees(atan2(sinh(eta), cos(xi))) - {_number(LON0)}) / {_number(STEP)} AS sx, ({_number(LAT0)} - degrees(atan(sinh({psi})))) / {_number(STEP)} AS sy FROM {end}3)"""


def _bilinear_sql(source: str, where: str) -> str:
    """(pair_id, row, col, z) of the cells around (sx, sy)."""
    return f"""SELECT b.pair_id, b.row, b.col, sum(w * elevation) / sum(w) AS z FROM (SELECT *, (CASE dc WHEN 1 THEN sx - 0.5 - floor(sx - 0.5) ELSE 1 - (sx - 0.5 - floor(sx - 0.5)) END) * (CASE dr WHEN 1 THEN sy - 0.5 - floor(sy - 0.5) ELSE 1 - (sy - 0.5 - floor(sy - 0.5)) END) AS w,
  (floor(sy - 0.5) + dr)::INT AS sr, (floor(sx - 0.5) + dc)::INT AS sc FROM {source}, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc) WHERE {where}) b
  JOIN dem ON dem.pair_id = b.pair_id AND dem.row = sr AND dem.col = sc WHERE elevation IS NOT NULL GROUP BY ALL HAVING sum(w) > 0"""


def _projection_sql() -> str:
    """Target grids and the source places of their cells, step by step."""
    e, n = _number(projection.ECCENTRICITY), _number(projection.SCALE * projection.RADIUS)
    forward_x = "eta0" + "".join(f" + {_number(a)} * cos({2 * k} * xi0) * sinh({2 * k} * eta0)" for k, a in enumerate(projection.ALPHA, 1))
    forward_y = "xi0" + "".join(f" + {_number(a)} * sin({2 * k} * xi0) * cosh({2 * k} * eta0)" for k, a in enumerate(projection.ALPHA, 1))
    x, y = f"500000 + {n} * ({forward_x})", f"{n} * ({forward_y})"
    return f"""bd AS (SELECT pair_id, min(row) AS r0, max(row) + 1 AS r1, min(col) AS c0, max(col) + 1 AS c1 FROM dem GROUP BY pair_id),
ed AS (SELECT pair_id, r0, r1, c0, c1, {_number(LON0)} + (c0 + (c1 - c0) * i / 2.0::DOUBLE) * {_number(STEP)} AS lon, {_number(LAT0)} - (r0 + (r1 - r0) * j / 2.0::DOUBLE) * {_number(STEP)} AS lat FROM bd, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)),
f1 AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t, radians(lon - 3) AS lam FROM ed),
f2 AS (SELECT *, atan2(t, cos(lam)) AS xi0, atanh(sin(lam) / sqrt(1 + t * t)) AS eta0 FROM f1),
gr AS (SELECT pair_id, any_value(r0) AS r0, any_value(r1) AS r1, any_value(c0) AS c0, any_value(c1) AS c1, min({x}) AS x0, max({y}) AS y0, max({x}) AS x1, min({y}) AS y1 FROM f2 GROUP BY pair_id),
ce AS (SELECT *, (500000 - x0 - (col + 0.5::DOUBLE) * 30) / -{n} AS eta0, (y0 - (row + 0.5::DOUBLE) * 30) / {n} AS xi0 FROM (SELECT *, unnest(range(0, ceil((x1 - x0) / 30)::BIGINT)) AS col FROM (SELECT *, unnest(range(0, ceil((y0 - y1) / 30)::BIGINT)) AS row FROM gr))),
{_inverse_sql("ce", "c")},
c6 AS ({_bilinear_sql("c4", "sx >= c0 AND sx < c1 AND sy >= r0 AND sy < r1")})"""


@query(f"WITH {fx.SQL}, {_projection_sql()} SELECT c4.pair_id, c4.row::INT AS row, c4.col::INT AS col, round(z, 3) AS elevation FROM c4 LEFT JOIN c6 USING (pair_id, row, col)")
def r04_projected_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain on the 30 m grid of its UTM zone, bilinear from a geographic raster."""
    out = resample.reprojected(fx.dem_cells(spark, sf_dir), "elevation", ["pair_id"], LON0, LAT0, STEP)
    return out.withColumn("elevation", F.round("elevation", 3))


_CHOSEN = f"ch AS (SELECT pair_id, row, col, ({_number(X0 - 500000)} + (col + 0.5::DOUBLE) * 10) / {_number(projection.SCALE * projection.RADIUS)} AS eta0, ({_number(Y0)} - (row + 0.5::DOUBLE) * 10) / {_number(projection.SCALE * projection.RADIUS)} AS xi0 FROM P WHERE eligible AND {fx.rule_sql(*candidates.CHOSEN)})"


@query(f"WITH {fx.SQL}, {_CHOSEN}, {_inverse_sql('ch', 'i')}, i6 AS ({_bilinear_sql('i4', 'true')}) SELECT i4.pair_id, i4.row, i4.col, round(z, 3) AS elevation FROM i4 LEFT JOIN i6 USING (pair_id, row, col)")
def r03_projected_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation of a geographic raster at the candidates of a projected 10 m grid."""
    chosen = candidates.selected(fx.pixels(spark, sf_dir)).select("pair_id", "row", "col")
    out = resample.sampled(chosen, fx.dem_cells(spark, sf_dir), "elevation", ["pair_id", "row", "col"], ["pair_id"], X0, Y0, 10.0, LON0, LAT0, STEP)
    return out.withColumn("elevation", F.round("elevation", 3))
