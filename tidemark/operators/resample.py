"""Nearest and bilinear resampling of cell tables, and their reprojection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import with_halo
from .projection import to_lonlat, to_utm

#: Cells on a side of the tiles in which targets look up their neighbours.
TILE = 128


def nearest(targets: DataFrame, cells: DataFrame, x: Column, y: Column, value: str, missing: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Value of the source cell that contains each target; ``x`` and ``y`` are source column and row units.

    ``missing`` replaces values that are absent.
    """
    keys = keys or []
    at = targets.withColumn("__row", F.floor(y).cast("int")).withColumn("__col", F.floor(x).cast("int"))
    source = cells.select(*keys, F.col("row").alias("__row"), F.col("col").alias("__col"), F.col(value))
    out = at.join(source, [*keys, "__row", "__col"], "left").drop("__row", "__col")
    return out if missing is None else out.withColumn(value, F.coalesce(F.col(value), missing))


def bilinear(targets: DataFrame, cells: DataFrame, x: Column, y: Column, value: str, key: list[str], carry: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Distance-weighted mean of the known cells among the four around each target; null if none is known.

    ``x`` and ``y`` are source units with cell centres at halves, null for a target
    without a place; weights of missing cells are shared out among the others.
    ``key`` names the target row; ``keys``, a part of it, the columns in which target
    and cells must agree, as the pair where each has cells of its own.

    Targets and cells meet in square tiles of ``TILE`` cells, which have the next
    row and column too, so that each travels once but for the borders.  A tile's
    targets, of which there are as many as grids finer than the cells have pixels in it, are one task's work.
    """
    carry, keys = carry or [], keys or []
    base = targets.select(*key, *carry, (x - 0.5).alias("__px"), (y - 0.5).alias("__py"))
    schema = targets.select(*key, *carry).schema.add(value, "double")
    there = base.filter("__px IS NOT NULL AND __py IS NOT NULL").withColumn("__tr", F.floor(F.floor("__py") / TILE)).withColumn("__tc", F.floor(F.floor("__px") / TILE))
    source = with_halo(cells.filter(F.col(value).isNotNull()).select(*keys, "row", "col", F.col(value).cast("double").alias("__v")), TILE, 0, 1)
    # new names, as targets and cells may be one table
    source = source.select(*[F.col(c).alias(f"__s_{c}") for c in (*keys, "__tr", "__tc", "row", "col")], F.col("__v").alias("__s_v"))

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        told = left.select([*key, *carry])
        if left.num_rows == 0 or right.num_rows == 0:
            return told.append_column(value, pa.nulls(left.num_rows, pa.float64()))
        low, west = (left.column(c)[0].as_py() * TILE for c in ("__tr", "__tc"))
        grid, known = np.zeros((TILE + 1, TILE + 1)), np.zeros((TILE + 1, TILE + 1))
        at = (right.column("__s_row").to_numpy().astype(np.int64) - low, right.column("__s_col").to_numpy().astype(np.int64) - west)
        grid[at], known[at] = right.column("__s_v").to_numpy(), 1.0
        px, py = (left.column(c).to_numpy() for c in ("__px", "__py"))
        c0, r0 = np.floor(px), np.floor(py)
        fx, fy = px - c0, py - r0
        r, c = r0.astype(np.int64) - low, c0.astype(np.int64) - west
        total, weight = np.zeros(len(px)), np.zeros(len(px))
        for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)):
            w = (fx if dc else 1 - fx) * (fy if dr else 1 - fy) * known[r + dr, c + dc]
            total += w * grid[r + dr, c + dc]
            weight += w
        some = weight > 0
        return told.append_column(value, pa.array(total / np.where(some, weight, 1), mask=~some))

    met = there.groupBy(*keys, "__tr", "__tc").cogroup(source.groupBy(*[f"__s_{c}" for c in (*keys, "__tr", "__tc")])).applyInArrow(looked_up, schema)
    nowhere = base.filter("__px IS NULL OR __py IS NULL").select(*key, *carry, F.lit(None).cast("double").alias(value))
    return met.unionByName(nowhere)


def sampled(points: DataFrame, cells: DataFrame, value: str, key: list[str], keys: list[str], x0: float, y0: float, spacing: float, lon0: float, lat0: float, step: float, zone: int = 31) -> DataFrame:
    """(key, value): geographic cells at the pixel centres of a projected grid, bilinear.

    Only the given pixels (row, col) of the grid with upper left corner (``x0``,
    ``y0``) are looked up, so the cells far from them never travel beyond the join.
    """
    lon, lat = to_lonlat(x0 + (F.col("col") + 0.5) * spacing, y0 - (F.col("row") + 0.5) * spacing, zone)
    placed = points.select(*key, ((lon - lon0) / step).alias("__x"), ((lat0 - lat) / step).alias("__y"))
    return bilinear(placed, cells, F.col("__x"), F.col("__y"), value, key, keys=keys)


def projected_grid(cells: DataFrame, keys: list[str], lon0: float, lat0: float, step: float, spacing: float = 30.0, zone: int = 31) -> DataFrame:
    """Per key the bounds of the cells (r0 to r1, c0 to c1) and the north-up grid (x0, y0, width, height) of ``spacing`` metres that covers geographic cells.

    ``lon0`` and ``lat0`` are the upper left corner of cell (0, 0) and ``step`` is
    its width in degrees.  The extent is that of the projected corners and edge
    centres of the cells' bounds.
    """
    rows = cells.groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    west, east = lon0 + F.col("c0") * step, lon0 + (F.col("c1") + 1) * step
    north, south = lat0 - F.col("r0") * step, lat0 - (F.col("r1") + 1) * step
    middle = [(lon, lat) for lon in (west, (west + east) / 2, east) for lat in (south, (south + north) / 2, north)]
    points = [to_utm(lon, lat, zone) for lon, lat in middle]
    out = rows.select(*keys, "r0", "r1", "c0", "c1", F.least(*[x for x, _ in points]).alias("x0"), F.greatest(*[y for _, y in points]).alias("y0"), F.greatest(*[x for x, _ in points]).alias("x1"), F.least(*[y for _, y in points]).alias("y1"))
    return out.select(*keys, "r0", "r1", "c0", "c1", "x0", "y0", F.ceil((F.col("x1") - F.col("x0")) / spacing).cast("int").alias("width"), F.ceil((F.col("y0") - F.col("y1")) / spacing).cast("int").alias("height"))


def reprojected(cells: DataFrame, value: str, keys: list[str], lon0: float, lat0: float, step: float, spacing: float = 30.0, zone: int = 31) -> DataFrame:
    """(keys, row, col, value): geographic cells on their projected grid, bilinear; null outside the cells' bounds and where no known cell is near.

    Target rows are made by Spark from the grid's size, one row of cells at a
    time, and find their four source cells through the inverse projection.
    """
    grid = projected_grid(cells, keys, lon0, lat0, step, spacing, zone)
    rows = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    # spread the rows before they multiply
    rows = rows.repartition(*keys, "row").withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    lon, lat = to_lonlat(F.col("x0") + (F.col("col") + 0.5) * spacing, F.col("y0") - (F.col("row") + 0.5) * spacing, zone)
    placed = rows.withColumn("__x", (lon - lon0) / step).withColumn("__y", (lat0 - lat) / step)
    there = (F.col("__x") >= F.col("c0")) & (F.col("__x") < F.col("c1") + 1) & (F.col("__y") >= F.col("r0")) & (F.col("__y") < F.col("r1") + 1)
    at = lambda c: F.when(there, F.col(c))
    return bilinear(placed.select(*keys, "row", "col", at("__x").alias("__x"), at("__y").alias("__y")), cells, F.col("__x"), F.col("__y"), value, [*keys, "row", "col"], keys=keys)
