"""Queries that write files and read them back, with their SQL.

Every run writes to fresh paths in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import candidates, catalog, patches, polygons, projection
from tidemark.sources import tables
from tidemark.sources.shared import fresh_path

from . import catalog_queries as cq
from . import fixtures as fx
from . import patch_queries as pq
from . import pixel_queries as px

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query("SELECT s_name AS shape_name, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS parts, CASE WHEN s_suppkey % 3 = 0 THEN 7 WHEN s_suppkey % 3 = 1 THEN 5 ELSE 6 END::DOUBLE AS area, (s_suppkey % 17)::DOUBLE AS west, (s_suppkey % 17 + CASE WHEN s_suppkey % 3 = 0 THEN 9 ELSE 3 END)::DOUBLE AS east FROM supplier")
def s01_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of one or several parts, some with a hole, through feature collections, one for each nation."""
    k = F.col("s_suppkey")
    point = lambda a, b: F.format_string("[%d.0,%d.0]", k % 17 + a, k % 5 + b)
    ring = lambda *points: F.concat(F.lit("["), F.concat_ws(",", *[point(*p) for p in (*points, points[0])]), F.lit("]"))
    one = ring((0, 0), (3, 0), (3, 2), (0, 2))
    holed = F.concat(F.lit("["), one, F.lit(","), ring((1, 0), (2, 0), (2, 1), (1, 1)), F.lit("]"))
    plain = F.concat(F.lit("["), one, F.lit("]"))
    two = F.concat(F.lit("["), plain, F.lit(",["), ring((8, 0), (9, 0), (9, 1), (8, 1)), F.lit("]]"))
    kind = F.when(k % 3 == 0, "MultiPolygon").otherwise("Polygon")
    coordinates = F.when(k % 3 == 0, two).when(k % 3 == 1, holed).otherwise(plain)
    path = fresh_path(spark, "boundaries")
    features = fx.table(spark, sf_dir, "supplier").select("s_nationkey", F.struct(F.col("s_name").alias("shapeName")).alias("properties"), kind.alias("kind"), coordinates.alias("coordinates"))
    tables.write_documents(tables.feature_collections(features, ["s_nationkey"]), path)
    shapes = tables.read_boundaries(spark, path)
    areas = polygons.areas(polygons.edges_of(shapes, ["shape_name"]), "shape_name")
    box = polygons.box_of("geometry")
    return shapes.select("shape_name", F.size("geometry").alias("parts"), box["west"].alias("west"), box["east"].alias("east")).join(areas, "shape_name")


@query(f"WITH {cq._SCENES} SELECT scene_name, start_time, path_number, polarization, bytes, coalesce(md5sum, '') AS md5, round(least(west, west + slant::DOUBLE * 8), 9) AS west, south, round(greatest(west, west + slant::DOUBLE * 8) + 6, 9) AS east, south + 8 AS north FROM sc")
def s02_scene_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes through search results, one file for each area."""
    s = cq.scenes(spark, sf_dir)
    names = {"scene_name": "sceneName", "path_number": "pathNumber", "flight_direction": "flightDirection", "beam_mode": "beamModeType", "processing_level": "processingLevel"}
    fields = ["platform", "polarization", "orbit", "bytes", "md5sum", "url"]
    when = F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("startTime")
    properties = F.struct(*[F.col(a).alias(b) for a, b in names.items()], *fields, when)
    ring = F.element_at(F.element_at("geometry", 1), 1)
    closed = F.concat(ring, F.slice(ring, 1, 1))
    coordinates = F.to_json(F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))))
    path = fresh_path(spark, "scenes")
    tables.write_documents(tables.feature_collections(s.select("aoi_id", properties.alias("properties"), F.lit("Polygon").alias("kind"), coordinates.alias("coordinates")), ["aoi_id"]), path)
    # the inventory and the boxes come from one reading of the files
    read = tables.read_scenes(spark, path).select(*catalog.inventory_columns(), "west", "south", "east", "north")
    return read.select(F.col("scene_id").alias("scene_name"), F.col("acquisition_utc").alias("start_time"), F.col("relative_orbit").alias("path_number"), "polarization", "bytes", "md5", *[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")])


@query(f"WITH {fx.SQL} SELECT pair_id, row, col, common_mask, support, round(vh_change::DOUBLE, 5) AS vh_change FROM P WHERE row BETWEEN 3 AND 70")
def s04_s05_pixel_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel layers stored by pair and tile row, of which a range of rows is read."""
    path = fresh_path(spark, "pixels")
    tables.write_pixels(fx.pixels(spark, sf_dir).select("pair_id", "row", "col", "common_mask", "support", "vh_change"), path, 16)
    return tables.read_pixels(spark, path, (3, 70), 16).withColumn("vh_change", F.round(F.col("vh_change").cast("double"), 5))


@query(px.ORACLES["m07_threshold_sensitivity"])
def s06_s10_sensitivity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensitivity tables through their CSV files, a folder for each pair, which a second write must not replace."""
    told = px.rounded(candidates.sensitivity(fx.pixels(spark, sf_dir)), "retained_area_km2", "percent_eligible")
    path = fresh_path(spark, "sensitivity")
    tables.write_csv(told, path, ["pair_id"])
    try:
        tables.write_csv(told.limit(0), path, ["pair_id"])
    except Exception as error:
        if "exists" not in str(error).lower():
            raise
    return tables.read_csv(spark, path, f"{tables.SENSITIVITY}, pair_id int")


_MEASURES = ["june_vh_db", "june_vv_db", "july_vh_db", "july_vv_db", "delta_vh_db", "delta_vv_db", "dsm_elevation_m"]


_PLACES = pq._inverse_sql(f"(SELECT *, ({pq._number(pq.X0 - 500000)} + (col + 0.5::DOUBLE) * 10) / {pq._number(projection.SCALE * projection.RADIUS)} AS eta0, ({pq._number(pq.Y0)} - (row + 0.5::DOUBLE) * 10) / {pq._number(projection.SCALE * projection.RADIUS)} AS xi0 FROM pts)", "i")


@query(
    pq.ORACLES["w01_horn_slope"].replace(
        "SELECT pair_id, row, col, round(slope, 5) AS slope FROM slo",
        f", {_PLACES} SELECT pair_id, row, col AS column, round({pq._number(pq.LON0)} + sx * {pq._number(pq.STEP)}, 8) AS longitude, round({pq._number(pq.LAT0)} - sy * {pq._number(pq.STEP)}, 8) AS latitude, retained_after_cleanup, " + ", ".join(f"round({m}::DOUBLE, 4) AS {m}" for m in _MEASURES) + " FROM i4",
    )
)
def s07_point_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate points of all pairs with their places on the earth, through CSV files, a folder for each pair; what is missing comes back as null."""
    fields = [f.split()[0] for f in tables.POINTS.split(", ")]
    lon, lat = projection.to_lonlat(pq.X0 + (F.col("col") + 0.5) * 10.0, pq.Y0 - (F.col("row") + 0.5) * 10.0)
    out = pq.points(spark, sf_dir).withColumns({"longitude": lon, "latitude": lat, "column": F.col("col"), **{m: F.col(m).cast("double") for m in _MEASURES}}).select("pair_id", *fields)
    path = fresh_path(spark, "points")
    tables.write_csv(out, path, ["pair_id"])
    read = tables.read_csv(spark, path, f"{tables.POINTS}, pair_id int")
    return read.select("pair_id", "row", "column", *[F.round(c, 8).alias(c) for c in ("longitude", "latitude")], "retained_after_cleanup", *[F.round(m, 4).alias(m) for m in _MEASURES])


@query("SELECT s_nationkey AS nation, count(*) AS files, sum(strlen(said))::BIGINT AS bytes, string_agg(sha256(said), ',' ORDER BY sha256(said)) AS sha256, string_agg(md5(said), ',' ORDER BY md5(said)) AS md5 FROM (SELECT s_nationkey, s_name || chr(10) || repeat(s_name || ' ', 1 + s_suppkey % 40) || chr(10) AS said FROM supplier) GROUP BY s_nationkey")
def s11_file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of files written here, one for each supplier in a folder of its nation; the larger half is hashed in pieces."""
    said = F.concat("s_name", F.lit("\n"), F.repeat(F.concat("s_name", F.lit(" ")), 1 + F.col("s_suppkey") % 40))
    path = fresh_path(spark, "files")
    tables.write_documents(fx.table(spark, sf_dir, "supplier").select("s_nationkey", said.alias("value")), path, ["s_nationkey"])
    found = tables.file_inventory(spark, path, 500).withColumn("nation", F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",").alias(c)
    return found.filter(F.col("path").endswith(".txt")).groupBy("nation").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), joined("sha256"), joined("md5"))


@query(pq.ORACLES["w01_horn_slope"].replace("SELECT pair_id, row, col, round(slope, 5) AS slope FROM slo", "SELECT pair_id, patch_id, count(*) AS pixels, round(count(*) * 0.01::DOUBLE, 6) AS area_ha, count(*)::DOUBLE AS outlined FROM pat GROUP BY ALL"))
def s08_u04_patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with their outlines as Parquet, and their attributes alone as CSV; both are read and joined."""
    keys = ["pair_id", "patch_id"]
    points = pq.patch_points(spark, sf_dir)
    rings = patches.outlines(points.select(*keys, "row", "col"), keys)
    shapes = rings.groupBy(*keys).agg(F.array(F.collect_list("points")).alias("geometry"), F.sum("signed_area").alias("signed")).join(patches.well_known_text(rings, keys), keys)
    path = fresh_path(spark, "patches")
    tables.write_patches(px.rounded(patches.zonal(points), "area_ha").join(shapes, keys).select(*keys, "pixels", "area_ha", "geometry", "wkt", "signed"), path)
    attributes = tables.read_csv(spark, f"{path}/csv", "pair_id int, patch_id string, pixels bigint, area_ha double, signed double")
    outlined = spark.read.parquet(f"{path}/parquet").filter(F.col("wkt").startswith("MULTILINESTRING")).select(*keys, F.aggregate(polygons.flat_edges("geometry"), F.lit(0.0), lambda a, e: a + (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2).alias("outlined"))
    return attributes.drop("signed").join(outlined, keys)


@query(px.ORACLES["m08_eligibility_totals"].replace("SELECT pair_id, count(*) FILTER (support) AS support, count(*) FILTER (eligible) AS eligible,", "SELECT pair_id, 'totals' AS section, count(*) FILTER (support) AS support, count(*) FILTER (eligible) AS eligible,", 1))
def s09_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals as a section of a JSON report, read back from the file."""
    path = fresh_path(spark, "report")
    tables.report({"totals": candidates.eligibility_totals(fx.pixels(spark, sf_dir))}).write.mode("errorifexists").json(path)
    rows = spark.read.schema("section string, rows string").json(path)
    entry = F.explode(F.from_json("rows", "array<struct<pair_id:int,support:bigint,eligible:bigint,water:bigint,unknown:bigint>>")).alias("r")
    return rows.select("section", entry).select("section", "r.*")
