"""Catalogs, pixel layers, reports and inventories in and out of files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import day_layer, dem_tile

from .shared import spread

RINGS = "array<array<array<double>>>"
SCENE_FIELDS = (
    "sceneName string, startTime string, stopTime string, platform string, pathNumber int, flightDirection string, polarization string, beamModeType string, "
    "processingLevel string, frameNumber int, orbit int, bytes bigint, md5sum string, url string"
)
FEATURES = f"type string, features array<struct<type:string,properties:struct<{', '.join(f.strip().replace(' ', ':', 1) for f in SCENE_FIELDS.split(','))}>,geometry:struct<type:string,coordinates:{RINGS}>>>"
LAYERS = "type string, features array<struct<properties:struct<shapeName:string>,geometry:struct<type:string,coordinates:string>>>"
POINTS = "row int, column int, longitude double, latitude double, retained_after_cleanup int, june_vh_db double, june_vv_db double, july_vh_db double, july_vv_db double, delta_vh_db double, delta_vv_db double, dsm_elevation_m double"
SENSITIVITY = "july_vh_max_db int, june_vh_min_exclusive_db int, delta_vh_max_db int, raw_pixels bigint, water_ge90_pixels bigint, water_unknown_pixels bigint, retained_pixels bigint, vv_decrease_pixels bigint, retained_area_km2 double, percent_eligible double"


def _geometry(coordinates: str):
    """One part of rings of {x, y} points."""
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.array(F.transform(F.col(coordinates), ring))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(shape_name, geometry) of boundary feature collections; a Polygon has one part, a MultiPolygon as many as it lists.

    Any other kind of geometry is an error when the row is read.
    """
    features = spark.read.option("multiLine", True).schema(LAYERS).json(path).select(F.explode("features").alias("f"))
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, RINGS))).when(kind == "MultiPolygon", F.from_json(text, f"array<{RINGS}>"))
    parts = F.coalesce(parts, F.raise_error(F.concat(F.lit("no polygon: "), F.coalesce(kind, F.lit("null")))).cast(f"array<{RINGS}>"))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return features.select(F.col("f.properties.shapeName").alias("shape_name"), F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, point))).alias("geometry"))


def feature_collections(features: DataFrame, keys: list[str]) -> DataFrame:
    """(value): one feature collection as JSON text per key, from columns ``properties``, ``kind`` and ``coordinates`` (JSON text).

    Keys should bound what one file holds.
    """
    one = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json("properties"), F.lit(',"geometry":{"type":"'), F.col("kind"), F.lit('","coordinates":'), F.col("coordinates"), F.lit("}}"))
    return features.groupBy(*keys).agg(F.array_join(F.collect_list(one), ",").alias("f")).select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}")).alias("value"))


def write_documents(texts: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One file for each text of column ``value``, in a folder for each value of ``by``; an existing output is an error.

    Texts are dealt over all tasks, which write them through Arrow's file systems: for small
    files Spark's writer takes longer to make, mark and move each than to write it.  A task's texts
    are in order, so a second attempt writes the same files, and each gets its name when it is
    whole.  Spark's writer serves file systems that Arrow does not know.
    """
    by = by or []
    try:
        store, folder = _store(path)
    except (pa.ArrowException, OSError, ImportError):
        spread(texts, "value").write.mode("errorifexists").option("maxRecordsPerFile", 1).partitionBy(*by).text(path)
        return
    if store.get_file_info(folder).type != fs.FileType.NotFound:
        raise FileExistsError(f"path already exists: {path}")
    store.create_dir(folder)
    told = texts.select(*[F.col(c).cast("string").alias(c) for c in by], F.col("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        task, made, n = TaskContext.get(), set(), 0
        for part in batches:
            for *values, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                place = "/".join([folder, *(f"{_escaped(c)}={_escaped(v)}" for c, v in zip(by, values, strict=True))])
                if place not in made:
                    store.create_dir(place)
                    made.add(place)
                name, draft = f"{place}/part-{task.partitionId():05d}-{n:06d}.txt", f"{place}/.part-{task.taskAttemptId()}-{n}"
                with store.open_output_stream(draft) as stream:
                    stream.write((text or "").encode() + b"\n")
                store.move(draft, name)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["files"])

    spread(told, *told.columns).sortWithinPartitions(*told.columns).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _escaped(value: str | None) -> str:
    """A name or value as Spark writes it in the name of a folder."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and its name there."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/"))


def read_scenes(spark: SparkSession, path: str, aoi_id: str = "aoi") -> DataFrame:
    """A scene per row, with the footprint's rings and its bounding box."""
    f = spark.read.option("multiLine", True).schema(FEATURES).json(path).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("c"))
    points = F.flatten("c")
    box = {"west": F.array_min(F.transform(points, lambda p: p[0])), "south": F.array_min(F.transform(points, lambda p: p[1])), "east": F.array_max(F.transform(points, lambda p: p[0])), "north": F.array_max(F.transform(points, lambda p: p[1]))}
    names = {"sceneName": "scene_name", "pathNumber": "path_number", "flightDirection": "flight_direction", "beamModeType": "beam_mode", "processingLevel": "processing_level", "frameNumber": "frame_number", "stopTime": "stop_time"}
    return f.withColumns(box).withColumn("geometry", _geometry("c")).withColumn("start_time", F.to_timestamp("startTime")).withColumn("aoi_id", F.lit(aoi_id)).drop("c", "startTime").withColumnsRenamed(names)


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV with header, nulls as empty fields, in a folder for each value of ``by``; an existing output is an error."""
    df.write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").partitionBy(*(by or [])).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("nullValue", "").schema(schema).csv(path)


def write_pixels(pixels: DataFrame, path: str, tile: int = 512) -> None:
    """Pixel layers partitioned by pair and tile row; an existing output is an error."""
    placed = pixels.withColumn("tile_row", F.floor(F.col("row") / tile)).repartition("pair_id", "tile_row")
    placed.sortWithinPartitions("pair_id", "tile_row", "row", "col").write.mode("errorifexists").partitionBy("pair_id", "tile_row").parquet(path)


def read_pixels(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, tile: int = 512) -> DataFrame:
    """Pixel layers; a range of rows prunes partitions and row groups."""
    df = spark.read.parquet(path)
    if rows:
        df = df.filter(F.col("tile_row").between(rows[0] // tile, rows[1] // tile) & F.col("row").between(*rows))
    return df.drop("tile_row")


def write_patches(patches: DataFrame, path: str) -> None:
    """Patches with geometry as Parquet and attributes alone as CSV."""
    patches.write.mode("errorifexists").parquet(f"{path}/parquet")
    write_csv(patches.drop("geometry", "wkt"), f"{path}/csv")


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per section: its rows in the order of their text.  Sections are reports, not pixels."""
    out = None
    for name, df in sections.items():
        doc = df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("]")).alias("rows")).select(F.lit(name).alias("section"), "rows")
        out = doc if out is None else out.unionByName(doc)
    return out


#: Files up to this size are hashed by Spark's functions, larger ones piece by piece.
WHOLE_BYTES, PIECE_BYTES = 256 << 20, 8 << 20


def file_inventory(spark: SparkSession, path: str, whole: int = WHOLE_BYTES) -> DataFrame:
    """(path, bytes, sha256, md5) of all files below a path, of any size.

    Listing reads no content.  Files of up to ``whole`` bytes are read as
    binaries; larger ones are opened by the tasks through Arrow's file systems and hashed in
    pieces of ``PIECE_BYTES``, so no task holds one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.filter(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    large = files.filter(F.col("length") > whole).select("path", F.col("length").alias("bytes"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [_digests(p) for p in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], ["path", "bytes", "sha256", "md5"])

    # a path is a short row, whatever its file's size
    pieces = spread(large, "path").mapInArrow(hashed, "path string, bytes long, sha256 string, md5 string")
    return small.unionByName(pieces)


def _digests(path: str) -> tuple[str, str]:
    """SHA-256 and MD5 of a file, read in pieces."""
    store, name = _store(path)
    sha, md5 = hashlib.sha256(), hashlib.md5()
    with store.open_input_stream(name, buffer_size=0) as stream:
        while piece := stream.read(PIECE_BYTES):
            sha.update(piece)
            md5.update(piece)
    return sha.hexdigest(), md5.hexdigest()


def dem_tiles(bounds: DataFrame, *keys: str) -> DataFrame:
    """Names of the one-degree tiles that cover bounds (west, south, east, north)."""
    lat = bounds.select(*keys, "west", "east", F.explode(F.sequence(F.floor("south"), F.ceil("north") - 1)).alias("lat"))
    return lat.select(*keys, "lat", F.explode(F.sequence(F.floor("west"), F.ceil("east") - 1)).alias("lon")).select(*keys, dem_tile(F.col("lat"), F.col("lon")).alias("tile"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """(row, col, value) of overlapping tiles: the first tile in order with a value wins."""
    order = Window.partitionBy("row", "col").orderBy("tile_order")
    return tiles.filter(F.col("value").isNotNull()).withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("row", "col", "value")


def daily_layers(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Names of the daily layers from the first to the last day, both included."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 day"))).alias("day"))
    return days.select("day", day_layer(F.col("day")).alias("layer"))
