"""Slope from elevation cells, and its use on candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import square_kilometres

from .grid import with_halo

SLOPE_LIMITS = (2, 5, 10)
#: Cells on a side of the tiles in which slopes are computed.
TILE = 256


def horn_slope(cells: DataFrame, spacing: float = 30.0, value: str = "elevation", keys: tuple[str, ...] = ("pair_id",), tile: int = TILE) -> DataFrame:
    """(keys, row, col, slope) in degrees, by Horn's weights; null where any of the nine cells is missing.

    Cells are dealt into tiles, those on a border into the tiles beyond it too, and
    a tile is one array: each cell travels once, but for the borders.
    """
    schema = cells.select(*keys, "row", "col").schema.add("slope", "double")
    dealt = with_halo(cells.select(*keys, "row", "col", F.col(value).cast("double").alias("z")), tile, -1, 1)

    def slopes(rows: pa.Table) -> pa.Table:
        row, col = (rows.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        at = (row - rows.column("__tr")[0].as_py() * tile + 1, col - rows.column("__tc")[0].as_py() * tile + 1)
        known = rows.column("z").is_valid().to_numpy()
        z, there = np.zeros((tile + 2, tile + 2)), np.zeros((tile + 2, tile + 2), bool)
        z[at], there[at] = rows.column("z").fill_null(0.0).to_numpy(), known
        side = lambda r, c: z[1 + r : tile + 1 + r, 1 + c : tile + 1 + c]
        gx = sum(c * (2 - abs(r)) * side(r, c) for r in (-1, 0, 1) for c in (-1, 1)) / (8 * spacing)
        gy = sum(r * (2 - abs(c)) * side(r, c) for r in (-1, 1) for c in (-1, 0, 1)) / (8 * spacing)
        whole = np.all([there[1 + r : tile + 1 + r, 1 + c : tile + 1 + c] for r in (-1, 0, 1) for c in (-1, 0, 1)], axis=0)
        own = np.flatnonzero(rows.column("__own").to_numpy(zero_copy_only=False))
        place = (at[0][own] - 1, at[1][own] - 1)
        found = pa.array(np.degrees(np.arctan(np.hypot(gx, gy)))[place], mask=~whole[place])
        return rows.select([*keys, "row", "col"]).take(pa.array(own)).append_column("slope", found)

    return dealt.groupBy(*keys, "__tr", "__tc").applyInArrow(slopes, schema)


def slope_sensitivity(points: DataFrame, limits: tuple[int, ...] = SLOPE_LIMITS) -> DataFrame:
    """Raw and clean candidates: pixels, unknown slope, median, and how many stay at or below each limit.

    Unknown slope is counted apart and never counts as steep.
    """
    counts = [F.count_if(F.col("slope") <= n).alias(f"kept_{n}") for n in limits]
    groups = points.select("pair_id", "slope", F.explode(F.when(F.col("retained_after_cleanup") == 1, F.array(F.lit("raw"), F.lit("clean"))).otherwise(F.array(F.lit("raw")))).alias("subset"))
    out = groups.groupBy("pair_id", "subset").agg(F.count("*").alias("pixels"), F.count_if(F.col("slope").isNull()).alias("unknown"), F.median("slope").alias("median_slope"), *counts)
    return out.withColumns({f"km2_{n}": square_kilometres(F.col(f"kept_{n}")) for n in limits})
