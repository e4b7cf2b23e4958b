"""Eight-connected components of pixel sets, over any number of tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import patch_name

from tidemark.sources.shared import settled, spread

from .graph import components

TILE = 512
#: A pixel's number: its row times this, plus its column.
WIDTH = 1 << 31


def _label_tile(cells: pd.DataFrame) -> pd.DataFrame:
    """Smallest pixel number of each pixel's component inside one tile, by rounds of minima over the eight neighbours."""
    row, col = cells["row"].to_numpy(), cells["col"].to_numpy()
    own = row.astype(np.int64) * WIDTH + col
    order = np.argsort(own)
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    grid = np.full((row.max() - row.min() + 3, col.max() - col.min() + 3), -1)
    at = (row - row.min() + 1, col - col.min() + 1)
    grid[at] = place
    ends = []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = grid[at[0] + dr, at[1] + dc]
        ends.append(np.stack([place[other >= 0], other[other >= 0]]))
    a, b = np.concatenate(ends, axis=1)
    label = np.arange(len(own))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for target in (label[a], label[b], a, b):
            np.minimum.at(new, target, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return cells.assign(local=own[order][label][place])


def labelled(cells: DataFrame, tile: int = TILE, carry: list[str] | None = None) -> DataFrame:
    """(pair_id, row, col, label), and the ``carry`` columns: the label is the smallest pixel number (row * WIDTH + col) of the component.

    Tiles are labelled by one task each; neighbours across a seam join tile
    labels, and only those labels are iterated on.
    """
    carry = carry or []
    keyed = cells.select("pair_id", "row", "col", *carry).withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))
    fields = ", ".join(f"{c} {t}" for c, t in keyed.dtypes)
    # read for both sides of the seams and for the result; labelled once
    local = settled(spread(keyed, "pair_id", "tr", "tc").groupBy("pair_id", "tr", "tc").applyInPandas(_label_tile, f"{fields}, local long"))
    border = local.drop(*carry).filter((F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1))
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    asked = border.withColumn("step", F.explode(steps)).select("pair_id", (F.col("row") + F.col("step.dr")).alias("row"), (F.col("col") + F.col("step.dc")).alias("col"), F.col("local").alias("from"), F.col("tr").alias("ftr"), F.col("tc").alias("ftc"))
    seams = asked.join(border, ["pair_id", "row", "col"]).filter((F.col("tr") != F.col("ftr")) | (F.col("tc") != F.col("ftc")))
    node = lambda c: F.struct("pair_id", F.col(c).alias("local"))
    joined = components(seams.select(node("from").alias("a"), node("local").alias("b")).distinct())
    renamed = joined.select(F.col("node.pair_id").alias("pair_id"), F.col("node.local").alias("local"), F.col("component.local").alias("merged"))
    return local.join(renamed, ["pair_id", "local"], "left").select("pair_id", "row", "col", *carry, F.coalesce("merged", "local").alias("label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """Pixels and first pixel of every component."""
    return labels.groupBy("pair_id", "label").agg(F.count("*").alias("pixels"))


def without_small(labels: DataFrame, least: int) -> DataFrame:
    """The pixels of components of at least ``least`` pixels; nothing is filled."""
    big = component_sizes(labels).filter(F.col("pixels") >= least).drop("pixels")
    return labels.join(big, ["pair_id", "label"], "left_semi")


def ranked(sizes: DataFrame) -> DataFrame:
    """Number components 1, 2, ... per pair in scan order of their first pixel, and name them.

    Numbers run inside bands of ``TILE`` pixel rows and start from what the bands
    above hold, so that no task numbers a whole pair.
    """
    banded = sizes.withColumn("__band", F.floor(F.col("label") / (WIDTH * TILE)))
    above = Window.partitionBy("pair_id").orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    starts = banded.groupBy("pair_id", "__band").agg(F.count("*").alias("__n")).select("pair_id", "__band", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("pair_id", "__band").orderBy("label")
    numbered = banded.withColumn("__k", F.row_number().over(inside)).join(starts, ["pair_id", "__band"])
    out = numbered.withColumn("component_id", (F.col("__before") + F.col("__k")).cast("int")).drop("__band", "__before", "__k")
    return out.withColumn("patch_id", patch_name(F.col("component_id")))
