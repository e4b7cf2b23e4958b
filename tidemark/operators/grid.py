"""North-up grids: pixel centres, indices, windows and compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centre_x(col: Column, x0: Column, dx: Column) -> Column:
    return x0 + (col + 0.5) * dx


def centre_y(row: Column, y0: Column, dy: Column) -> Column:
    """``dy`` is negative on north-up grids."""
    return y0 + (row + 0.5) * dy


def index(value: Column, origin: Column, step: Column) -> Column:
    """Row or column that contains a coordinate."""
    return F.floor((value - origin) / step).cast("int")


def aligned_window(boxes: DataFrame) -> DataFrame:
    """Add the window that snaps bounds outward to the grid: needs west, south, east, north, x0, y0, dx, dy."""
    left, top = F.floor((F.col("west") - F.col("x0")) / F.col("dx")), F.floor((F.col("north") - F.col("y0")) / F.col("dy"))
    right, bottom = F.ceil((F.col("east") - F.col("x0")) / F.col("dx")), F.ceil((F.col("south") - F.col("y0")) / F.col("dy"))
    return boxes.withColumns({"col_off": left, "row_off": top, "width": right - left, "height": bottom - top})


def crop(cells: DataFrame, window: DataFrame, keys: list[str]) -> DataFrame:
    """Cells inside a window (row_off, col_off, height, width per key); cells outside the raster simply do not exist."""
    joined = cells.join(window.select(*keys, "row_off", "col_off", "height", "width"), keys)
    inside = (F.col("row") >= F.col("row_off")) & (F.col("row") < F.col("row_off") + F.col("height")) & (F.col("col") >= F.col("col_off")) & (F.col("col") < F.col("col_off") + F.col("width"))
    return joined.filter(inside).drop("row_off", "col_off", "height", "width")


def compatibility(grids: DataFrame, step: float = 10.0) -> DataFrame:
    """Per pair: one grid for all layers, the expected spacing, no rotation, two bands."""
    shape = F.struct("epsg", "x0", "y0", "dx", "dy", "width", "height")
    return grids.groupBy("pair_id").agg(
        (F.count_distinct(shape) == 1).alias("same_grid"),
        F.every((F.abs(F.col("dx")) == step) & (F.abs(F.col("dy")) == step)).alias("spacing"),
        F.every((F.col("rot_x") == 0) & (F.col("rot_y") == 0)).alias("unrotated"),
        F.every(F.col("bands") == 2).alias("two_bands"),
    )


def with_halo(cells: DataFrame, tile: int, before: int, after: int) -> DataFrame:
    """Cells (row, col, ...) in square tiles (``__tr``, ``__tc``), and once more in every tile that they border; ``__own`` marks their own tile.

    A tile gets the cells from ``before`` (0 or less) to ``after`` rows and columns beyond its own.
    """

    def tiles(c: str) -> Column:
        first, last = F.floor((F.col(c) - after) / tile), F.floor((F.col(c) - before) / tile)
        return F.sequence(first, last)

    placed = cells.withColumn("__tr", F.explode(tiles("row"))).withColumn("__tc", F.explode(tiles("col")))
    return placed.withColumn("__own", (F.col("__tr") == F.floor(F.col("row") / tile)) & (F.col("__tc") == F.floor(F.col("col") / tile)))
