"""Pixel grids, rasters, catalogs and manifests derived from the star schema.

``SQL`` holds the same derivation as common table expressions for DuckDB, built
from the same constants, so that every query can be held against plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backscatter, candidates, polygons
from tidemark.sources.shared import spread

WIDTH = 125
WATER_SCALE, WATER_WIDTH = 3, 50
DEM_SCALE, DEM_WIDTH = 4, 50
#: The area and the footprint repeat after so many rows, so that they grow with the grid.
PERIOD = 4000

#: Rings in pixel units (x = column, y = row): a concave area with a hole, and a slanted footprint.
AREA = [
    [(3.2, -5.0), (120.7, -5.0), (120.7, 5000.0), (62.3, 5000.0), (55.1, 4.4), (48.9, 5000.0), (3.2, 5000.0)],
    [(80.5, 2.5), (95.5, 2.5), (95.5, 9.5), (80.5, 9.5)],
]
FOOTPRINT = [[(12.3, -3.0), (112.2, -1.0), (104.4, 5000.0), (6.1, 4000.0)]]

_BANDS = {
    "vh_before": "(20 + ((r{d}7)*31 + (c{d}9)*17) % 23 * 3 + p % 11) / CAST(4000 AS DOUBLE)",
    "vv_before": "(60 + ((r{d}3)*7 + (c{d}4)*19) % 29 * 5 + p % 13) / CAST(4000 AS DOUBLE)",
    "vh_after": "(10 + ((r{d}8)*13 + (c{d}10)*29) % 19 * 4 + q % 17) / CAST(4000 AS DOUBLE)",
    "vv_after": "(60 + ((r{d}4)*11 + (c{d}3)*23) % 31 * 5 + n * 3) / CAST(4000 AS DOUBLE)",
}
_ODD = "CASE WHEN k % 97 = 0 THEN 0 WHEN k % 101 = 0 THEN CAST(-0.01 AS DOUBLE) WHEN k % 103 = 0 THEN -9999 WHEN k % 107 = 0 THEN CAST('NaN' AS DOUBLE) ELSE {x} END"


def _bands(div: str) -> dict[str, str]:
    out = {}
    for name, text in _BANDS.items():
        x = text.replace("{d}", div)
        out[name] = f"CAST({_ODD.format(x=x) if name == 'vh_before' else x} AS FLOAT)"
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, row, col, four bands) of two pairs on one grid, with zeros, negatives, nodata marks, NaN and missing rows."""
    late = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("q"), F.count("*").alias("n"))
    # a row group of short rows makes many pixels
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("p")), "o_orderkey")
    keyed = orders.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr("o_orderkey AS k", f"o_orderkey div {2 * WIDTH} AS r", f"(o_orderkey div 2) % {WIDTH} AS c", "p", "q", "n")
    return keyed.selectExpr("CAST(1 + k % 2 AS INT) AS pair_id", "CAST(r AS INT) AS row", "CAST(c AS INT) AS col", *(f"{x} AS {n}" for n, x in _bands(" div ").items()))


def water_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(f"CAST(p_partkey div {WATER_WIDTH} AS INT) AS wrow", f"CAST(p_partkey % {WATER_WIDTH} AS INT) AS wcol", "CASE WHEN p_partkey % 61 = 0 THEN 255 ELSE p_size * 2 END AS occurrence")


def dem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("CAST(1 + c_custkey % 2 AS INT) AS pair_id", f"CAST(c_custkey div {2 * DEM_WIDTH} AS INT) AS row", f"CAST((c_custkey div 2) % {DEM_WIDTH} AS INT) AS col", "CASE WHEN c_custkey % 83 = 0 THEN NULL ELSE CAST(floor(c_acctbal) / CAST(100 AS DOUBLE) AS FLOAT) END AS elevation")


def shape_spans(raw: DataFrame, name: str, rings: list) -> DataFrame:
    """Spans of a shape in the rows of one period."""
    rows = raw.select((F.col("row") % PERIOD).alias("row")).distinct()
    return polygons.spans(polygons.edge_table(raw.sparkSession, {name: [rings]}), rows)


def flagged(raw: DataFrame) -> DataFrame:
    """Add the flags ``inside`` (the area) and ``footprint``."""
    out = raw.withColumn("__row", F.col("row")).withColumn("row", F.col("row") % PERIOD)
    for flag, name, rings in (("inside", "area", AREA), ("footprint", "footprint", FOOTPRINT)):
        out = polygons.flag_inside(out, shape_spans(raw, name, rings), flag, bounded=True)  # PERIOD rows at most
    return out.drop("row").withColumnRenamed("__row", "row")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bands with area and footprint flags, decibels, change, water occurrence and eligibility."""
    done = backscatter.prepared(flagged(raw_pixels(spark, sf_dir)), F.col("inside"))
    wet = done.withColumn("wrow", F.floor(F.col("row") / WATER_SCALE).cast("int")).withColumn("wcol", F.floor(F.col("col") / WATER_SCALE).cast("int")).join(water_cells(spark, sf_dir), ["wrow", "wcol"], "left").drop("wrow", "wcol")
    wet = wet.withColumn("coverage", backscatter.coverage_code(F.col("common_mask"), F.col("footprint"))).withColumn("water", F.coalesce(backscatter.water_class(F.col("occurrence")), F.lit("unknown")))
    return candidates.with_eligibility(wet)


def _edges_sql(rings: list) -> str:
    rows = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            rows.append(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return "(VALUES " + ", ".join(rows) + ") AS e(x1, y1, x2, y2)"


def inside_sql(rings: list, x: str, y: str) -> str:
    return f"(SELECT count(*) % 2 = 1 FROM {_edges_sql(rings)} WHERE least(y1, y2) <= {y} AND {y} < greatest(y1, y2) AND x1 + ({y} - y1) * (x2 - x1) / (y2 - y1) <= {x})"


def _pixels_sql() -> str:
    names = list(_BANDS)
    raw = ", ".join(f"{x} AS {n}" for n, x in _bands("//").items())
    clean = ", ".join(f"CASE WHEN isfinite({n}) AND {n} <> -9999 THEN {n} END AS {n}" for n in names)
    every = " AND ".join(f"{n} IS NOT NULL" for n in names)
    positive = " AND ".join(f"coalesce({n} > 0, false)" for n in names)
    db = ", ".join(f"CASE WHEN support THEN (10 * log10({n}::DOUBLE))::FLOAT END AS {n}_db" for n in names)
    return f"""li AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1),
k0 AS (SELECT o_orderkey AS k, o_orderkey // {2 * WIDTH} AS r, (o_orderkey // 2) % {WIDTH} AS c, floor(o_totalprice)::BIGINT AS p, q, n FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
raw AS (SELECT (1 + k % 2)::INT AS pair_id, r::INT AS row, c::INT AS col, {raw} FROM k0),
k1 AS (SELECT pair_id, row, col, {clean}, {inside_sql(AREA, "(col + 0.5::DOUBLE)", f"(row % {PERIOD} + 0.5::DOUBLE)")} AS inside, {inside_sql(FOOTPRINT, "(col + 0.5::DOUBLE)", f"(row % {PERIOD} + 0.5::DOUBLE)")} AS footprint FROM raw),
k2 AS (SELECT *, CASE WHEN NOT inside THEN 255 WHEN {every} THEN 1 ELSE 0 END AS common_mask FROM k1),
k3 AS (SELECT *, common_mask = 1 AND {positive} AS support FROM k2),
k4 AS (SELECT *, {db} FROM k3),
w0 AS (SELECT (p_partkey // {WATER_WIDTH})::INT AS wrow, (p_partkey % {WATER_WIDTH})::INT AS wcol, CASE WHEN p_partkey % 61 = 0 THEN 255 ELSE p_size * 2 END AS occurrence FROM part),
dem AS (SELECT (1 + c_custkey % 2)::INT AS pair_id, (c_custkey // {2 * DEM_WIDTH})::INT AS row, ((c_custkey // 2) % {DEM_WIDTH})::INT AS col, CASE WHEN c_custkey % 83 = 0 THEN NULL ELSE (floor(c_acctbal) / 100::DOUBLE)::FLOAT END AS elevation FROM customer),
k5 AS (SELECT k4.*, (vh_after_db - vh_before_db)::FLOAT AS vh_change, (vv_after_db - vv_before_db)::FLOAT AS vv_change, occurrence,
  coalesce(occurrence BETWEEN 0 AND 100, false) AS water_known FROM k4 LEFT JOIN w0 ON wrow = row // {WATER_SCALE} AND wcol = col // {WATER_SCALE}),
P AS (SELECT *, support AND water_known AND occurrence < 90 AS eligible,
  CASE WHEN common_mask = 255 THEN 255 WHEN footprint AND common_mask = 1 THEN 1 WHEN footprint THEN 2 WHEN common_mask = 0 THEN 3 ELSE 4 END AS coverage,
  CASE WHEN water_known AND occurrence >= 90 THEN 'ge90' WHEN water_known THEN 'lt90' ELSE 'unknown' END AS water FROM k5)"""


SQL = _pixels_sql()


def rule_sql(dark: int, drop: int) -> str:
    return f"coalesce(support AND vh_before_db > {dark} AND vh_after_db <= {dark} AND vh_change <= {drop}, false)"
