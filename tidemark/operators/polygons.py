"""Polygons as edge tables: bounds, areas, centre-rule rasterising, overlaps and checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sweep
from .projection import to_utm

Ring = list[tuple[float, float]]


def edge_table(spark: SparkSession, shapes: dict[str, list[list[Ring]]]) -> DataFrame:
    """(poly_id, part, ring, seq, x1, y1, x2, y2) of literal shapes: parts of rings of points; rings close themselves."""
    rows = []
    for name, parts in shapes.items():
        for i, rings in enumerate(parts):
            for j, ring in enumerate(rings):
                closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
                rows += [f"({i}, {j}, {k}, " + ", ".join(f"double('{float(x)!r}')" for x in (*a, *b)) + f", :{name})" for k, (a, b) in enumerate(zip(closed, closed[1:], strict=False))]
    # literal rows: known to the optimizer, and no Python data source
    return spark.sql(f"SELECT poly_id, part, ring, seq, x1, y1, x2, y2 FROM VALUES {', '.join(rows)} AS t(part, ring, seq, x1, y1, x2, y2, poly_id)", {n: n for n in shapes})


def edges_of(shapes: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """Edges of a polygon column (parts of rings of points {x, y}); an unclosed ring is closed."""
    rings = shapes.select(*keys, F.posexplode(geometry).alias("part", "rings")).select(*keys, "part", F.posexplode("rings").alias("ring", "points"))
    closed = F.when(F.element_at("points", 1) == F.element_at("points", -1), F.col("points")).otherwise(F.concat("points", F.slice("points", 1, 1)))
    steps = rings.withColumn("points", closed).withColumn("seq", F.explode(F.sequence(F.lit(1), F.size("points") - 1)))
    a, b = F.element_at("points", F.col("seq")), F.element_at("points", F.col("seq") + 1)
    return steps.select(*keys, "part", "ring", (F.col("seq") - 1).alias("seq"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def flat_edges(geometry: str) -> Column:
    """All edges of a polygon column in one array of {x1, y1, x2, y2}; unclosed rings are closed."""

    def ring(points: Column) -> Column:
        after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
        return F.arrays_zip(points["x"], points["y"], after["x"], after["y"]).cast(_EDGES)

    # whole arrays, as a function of every point takes several times as long
    edges = F.flatten(F.transform(F.flatten(F.col(geometry)), lambda r: F.coalesce(ring(r), F.array().cast(_EDGES))))
    # a closed ring's last point is its first one, which adds an edge without length
    return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


_EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def projected(geometry: str, zone: int = 31) -> Column:
    """A polygon column in longitude and latitude, in metres of a UTM zone."""

    def point(p: Column) -> Column:
        x, y = to_utm(p["x"], p["y"], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(F.col(geometry), lambda part: F.transform(part, lambda ring: F.transform(ring, point)))


def box_of(geometry: str) -> Column:
    """Bounds {west, south, east, north} of a polygon column."""
    points = F.flatten(F.flatten(F.col(geometry)))
    xs, ys = points["x"], points["y"]
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def bounds(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.groupBy(*keys).agg(F.min("x1").alias("west"), F.min("y1").alias("south"), F.max("x1").alias("east"), F.max("y1").alias("north"))


def areas(edges: DataFrame, *keys: str) -> DataFrame:
    """Area per shape: the outer ring (number 0) of each part less its other rings, whatever their direction."""
    ring = edges.groupBy(*keys, "part", "ring").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("a"))
    return ring.groupBy(*keys).agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def spans(edges: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("poly_id",)) -> DataFrame:
    """Per shape and grid row the column spans [c0, c1] whose pixel centres lie inside.

    ``rows`` limits the grid rows (a column ``row``).  An edge counts where
    min(y) <= centre < max(y); crossings pair up in order, left-closed.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    limits = rows.agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    clipped = edges.crossJoin(F.broadcast(limits))  # one row
    first, last = F.greatest(F.ceil(low - 0.5), F.col("r0")), F.least(F.ceil(high - 0.5) - 1, F.col("r1"))
    hits = clipped.withColumn("first", first).withColumn("last", last).filter("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    y = F.col("row") + 0.5
    hits = hits.select(*keys, F.col("row").cast("int").alias("row"), (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    crossings = hits.groupBy(*keys, "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pair = F.transform(F.sequence(F.lit(1), F.floor(F.size("xs") / 2)), lambda i: F.struct(F.ceil(F.element_at("xs", (2 * i - 1).cast("int")) - 0.5).alias("c0"), (F.ceil(F.element_at("xs", (2 * i).cast("int")) - 0.5) - 1).alias("c1")))
    return crossings.filter(F.size("xs") >= 2).select(*keys, "row", F.filter(pair, lambda s: s["c0"] <= s["c1"]).alias("spans"))


def flag_inside(pixels: DataFrame, shape_spans: DataFrame, name: str, bounded: bool = False) -> DataFrame:
    """Boolean column: the pixel's centre lies in any of the shapes.  One span list per row meets the pixels; nothing is exploded.

    ``bounded`` says that a parameter bounds the rows that have spans; then the
    lists are broadcast and the pixels stay where they are.
    """
    per_row = shape_spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("__spans"))
    per_row = F.broadcast(per_row) if bounded else per_row
    inside = F.exists("__spans", lambda s: F.col("col").between(s["c0"], s["c1"]))
    return pixels.join(per_row, "row", "left").withColumn(name, F.coalesce(inside, F.lit(False))).drop("__spans")


def inside_pixels(shape_spans: DataFrame, keys: tuple[str, ...] = ("poly_id",)) -> DataFrame:
    """(keys, row, col) of all pixels inside."""
    runs = shape_spans.select(*keys, "row", F.explode("spans").alias("s"))
    return runs.select(*keys, "row", F.explode(F.sequence("s.c0", "s.c1")).alias("col")).withColumn("col", F.col("col").cast("int")).distinct()


def strip_area(shapes: list[np.ndarray], union: bool = False) -> float:
    """Area of the intersection (or union) of even-odd shapes, edge arrays (n, 4)."""
    if not shapes or not union and any(len(s) == 0 for s in shapes):
        return 0.0
    number = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
    return float(sweep.areas(np.concatenate(shapes), np.zeros(len(number), np.int64), number, sweep.any_of if union else sweep.common(len(shapes)), 1)[0])


def _edge_arrays(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """An (n, 4) array per row of a list column of edges; none for null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.if_else(pc.is_null(column), pa.scalar([], column.type), column)
    flat = column.flatten()
    values = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in ("x1", "y1", "x2", "y2")], axis=1) if len(flat) else np.zeros((0, 4))
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(column) else []


def _batched(rows: pa.RecordBatch, columns: list[int], limit: int = 200_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, edges, row of each edge, column of each edge) of runs of rows with about ``limit`` edges in all."""
    shapes = [_edge_arrays(rows.column(k)) for k in columns]
    size = np.cumsum([sum(len(s[i]) for s in shapes) for i in range(rows.num_rows)])
    at = 0
    while at < rows.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        own = [s[i] for i in range(at, end) for s in shapes]
        counts = [len(x) for x in own]
        yield at, end - at, np.concatenate(own), np.repeat(np.repeat(np.arange(end - at), len(shapes)), counts), np.repeat(np.tile(np.arange(len(shapes)), end - at), counts)
        at = end


def overlaps(pairs: DataFrame, keys: list[str], edge_lists: list[str]) -> DataFrame:
    """``pairs`` keys with ``overlap``: the common area of the polygons in the given edge-array columns; a batch is swept as a whole."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at, n, edges, row, shape in _batched(rows, list(range(len(keys), len(keys) + len(edge_lists)))):
                found = pa.array(sweep.areas(edges, row, shape, sweep.common(len(edge_lists)), n))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in rows.columns[: len(keys)]), found], [*keys, "overlap"])

    return pairs.select(*keys, *edge_lists).mapInArrow(measure, pairs.select(*keys).schema.add("overlap", "double"))


def _sides(trapezoids: np.ndarray) -> np.ndarray:
    """Left and right edges of trapezoids."""
    y0, y1, left0, left1, right0, right1 = trapezoids.T
    return np.stack([np.stack([left0, y0, left1, y1], axis=1), np.stack([right0, y0, right1, y1], axis=1)], axis=1).reshape(-1, 4)


def _edge_lists(edges: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """An edge-array column from edges in order of their rows."""
    items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(edges[:, k])) for k in range(4)], ["x1", "y1", "x2", "y2"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), items)


#: A whole travels once for so many of the shapes that are clipped by it.
CLIPPED_WITH = 1000


def clipped(shapes: DataFrame, wholes: DataFrame, key: str, edges: str = "edges") -> DataFrame:
    """``shapes`` with ``edges`` cut to the whole of the same key, and ``clip_area``; both tables have edge arrays.

    Rows of a key are dealt into salts of about ``CLIPPED_WITH``; the whole
    goes first to every salt, and the shapes stream past it, so it is on no shape's row.
    Shapes without a whole go.
    """
    others = [c for c in shapes.columns if c != edges]
    dealt = shapes.join(wholes.select(key), key, "left_semi").groupBy(key).agg(F.ceil(F.count("*") / CLIPPED_WITH).cast("int").alias("__salts"))
    row = F.struct(*[F.col(c) for c in others])
    own = shapes.join(dealt, key).select(F.col(key).alias("k"), F.pmod(F.xxhash64(row), F.col("__salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col(edges).alias("edges"), row.alias("row"))
    first = wholes.join(dealt, key).select(F.col(key).alias("k"), F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col(edges).alias("edges"), F.lit(None).cast(own.schema["row"].dataType).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4))
        for part in batches:
            kinds, lists = part.column(2).to_numpy(zero_copy_only=False), _edge_arrays(part.column(3))
            # shapes of all wholes are swept together; those before the first whole belong to the one held
            wholes = [held, *(lists[i] for i in np.flatnonzero(kinds == 0))]
            place, of = np.flatnonzero(kinds == 1), np.cumsum(kinds == 0)[kinds == 1]
            held = wholes[-1].copy()
            size = np.cumsum([len(lists[i]) + len(wholes[j]) for i, j in zip(place, of, strict=True)])
            at = 0
            while at < len(place):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 200_000, "right")))
                inner, around = [lists[i] for i in place[at:end]], [wholes[j] for j in of[at:end]]
                counts = [len(x) for x in (*inner, *around)]
                row = np.tile(np.arange(end - at), 2)
                group, parts = sweep.regions(np.concatenate([*inner, *around]), np.repeat(row, counts), np.repeat(np.repeat([1, 0], end - at), counts), sweep.common(2))
                order = np.argsort(group, kind="stable")
                group, parts = group[order], parts[order]
                share = np.bincount(group, (parts[:, 1] - parts[:, 0]) * (parts[:, 4] - parts[:, 2] + parts[:, 5] - parts[:, 3]) / 2, end - at)
                got = _edge_lists(_sides(parts), np.repeat(group, 2), end - at)
                yield pa.RecordBatch.from_arrays([part.column(4).take(pa.array(place[at:end])), got, pa.array(share.astype(float))], ["row", "edges", "clip_area"])
                at = end

    schema = T.StructType([T.StructField("row", own.schema["row"].dataType), T.StructField("edges", own.schema["edges"].dataType), T.StructField("clip_area", T.DoubleType())])
    met = first.unionByName(own).repartition("k", "salt").sortWithinPartitions("k", "salt", "kind").select("k", "salt", "kind", "edges", "row")
    out = met.mapInArrow(run, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in others], F.col("edges").alias(edges), "clip_area")


_SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def outlines(groups: DataFrame, keys: list[str], whole: str, others: list[str]) -> DataFrame:
    """``keys`` with two polygon columns: ``covered``, what all of ``others`` cover of ``whole``, and ``open``, the rest of it.

    All are edge-array columns; the polygons have a part for each trapezoid between two edges.
    """

    def both(s: sweep.Strips) -> np.ndarray:
        return s.depth() >= 1 + len(others)

    def rest(s: sweep.Strips) -> np.ndarray:
        return (s.depth(s.shape == 0) >= 1) & (s.depth() < 1 + len(others))

    def shaped(edges: np.ndarray, row: np.ndarray, shape: np.ndarray, rule: sweep.Rule, n: int) -> pa.Array:
        group, parts = sweep.regions(edges, row, shape, rule)
        order = np.argsort(group, kind="stable")
        group, (y0, y1, a0, a1, b0, b1) = group[order], parts[order].T
        points = pa.StructArray.from_arrays([pa.array(np.stack([a0, b0, b1, a1], axis=1).reshape(-1)), pa.array(np.stack([y0, y0, y1, y1], axis=1).reshape(-1))], ["x", "y"])
        rings = pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1, dtype=np.int32) * 4), points)
        polygons = pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1, dtype=np.int32)), rings)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(n + 1)).astype(np.int32)), polygons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at, n, edges, row, shape in _batched(rows, list(range(len(keys), len(keys) + 1 + len(others)))):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in rows.columns[: len(keys)]), *(shaped(edges, row, shape, rule, n) for rule in (both, rest))], [*keys, "covered", "open"])

    chosen = groups.select(*keys, whole, *others)
    told = chosen.select(*keys, F.lit(None).cast(_SHAPE).alias("covered"), F.lit(None).cast(_SHAPE).alias("open"))
    return chosen.mapInArrow(run, told.schema)


#: Edges of parts and whole for which a level band is made.
BAND_EDGES = 2000


def union_coverage(parts: DataFrame, wholes: DataFrame, key: str, part: str) -> DataFrame:
    """(key, union_coverage): the share of every whole that its parts cover together.

    Both are edge tables; parts are even-odd shapes named by ``part``.  A whole is
    cut into level bands, more of them the more edges it and its parts have, and
    edges are cut at the bands, so that a task sees one band's pieces only.
    """
    size = wholes.groupBy(key).agg(F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high"), F.count("*").alias("n"))
    more = parts.groupBy(key).agg(F.count("*").alias("m"))
    count = F.ceil((F.col("n") + F.coalesce("m", F.lit(0))) / BAND_EDGES)
    limits = size.join(more, key, "left").select(key, "low", ((F.col("high") - F.col("low")) / count).alias("step"), count.alias("bands")).filter("step > 0")
    named = parts.select(key, F.col(part).cast("string").alias("part"), F.lit(1).alias("kind"), "x1", "y1", "x2", "y2").unionByName(wholes.select(key, F.lit("").alias("part"), F.lit(0).alias("kind"), "x1", "y1", "x2", "y2"))
    bottom, top = F.least("y1", "y2"), F.greatest("y1", "y2")
    band_of = lambda y: F.greatest(F.lit(0), F.least(F.floor((y - F.col("low")) / F.col("step")), F.col("bands") - 1))
    edge = F.col("low") + F.col("band") * F.col("step")
    at = lambda y: F.when(y == F.col("y1"), F.col("x1")).when(y == F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    cut = named.join(limits, key).filter(bottom < top).withColumn("band", F.explode(F.sequence(band_of(bottom), band_of(top))))
    # the last band's upper end is that of the whole, whatever rounding makes of it
    upper = F.when(F.col("band") < F.col("bands") - 1, F.col("low") + (F.col("band") + 1) * F.col("step")).otherwise(F.lit(float("inf")))
    cut = cut.withColumn("ya", F.greatest(bottom, edge)).withColumn("yb", F.least(top, upper)).filter("ya < yb")
    cut = cut.select(key, "band", "kind", "part", at(F.col("ya")).alias("x1"), F.col("ya").alias("y1"), at(F.col("yb")).alias("x2"), F.col("yb").alias("y2"))

    def measure(rows: pa.Table) -> pa.Table:
        edges = np.stack([rows.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
        kind = rows.column("kind").to_numpy()
        shape = np.where(kind == 0, 0, 1 + np.unique(rows.column("part").to_pylist(), return_inverse=True)[1])
        one = np.zeros(len(edges), np.int64)
        found = [sweep.areas(edges, one, shape, rule, 1) for rule in (sweep.covered_part, lambda s: s.depth(s.shape == 0) >= 1)]
        return rows.slice(0, 1).select([key]).append_column("covered", pa.array(found[0])).append_column("area", pa.array(found[1]))

    bands = cut.groupBy(key, "band").applyInArrow(measure, parts.select(key).schema.add("covered", "double").add("area", "double"))
    return bands.groupBy(key).agg((F.sum("covered") / F.nullif(F.sum("area"), F.lit(0.0))).alias("union_coverage"))


def edge_lists(edges: DataFrame, key: str, name: str) -> DataFrame:
    """All edges of a shape in one array: shapes are small beside pixels."""
    return edges.groupBy(key).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias(name))


def touching_boxes(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Join of two bounds tables (names of the second suffixed _b by the caller) where the boxes share area.

    Boxes are dealt into square cells and meet there; a pair counts in the first
    cell that both have.  Cells about as large as a box serve best.
    """

    def dealt(boxes: DataFrame, end: str) -> DataFrame:
        low = {c: F.floor(F.col(f"{n}{end}") / cell) for c, n in (("x", "west"), ("y", "south"))}
        high = {c: F.floor(F.col(f"{n}{end}") / cell) for c, n in (("x", "east"), ("y", "north"))}
        out = boxes.withColumns({f"__{c}0{end}": v for c, v in low.items()})
        for c in low:
            out = out.withColumn(f"__{c}", F.explode(F.sequence(low[c], high[c])))
        return out

    met = dealt(a, "").join(dealt(b, "_b"), ["__x", "__y"])
    first = (F.col("__x") == F.greatest("__x0", "__x0_b")) & (F.col("__y") == F.greatest("__y0", "__y0_b"))
    share = (F.col("west") < F.col("east_b")) & (F.col("west_b") < F.col("east")) & (F.col("south") < F.col("north_b")) & (F.col("south_b") < F.col("north"))
    return met.filter(first & share).drop("__x", "__y", "__x0", "__y0", "__x0_b", "__y0_b")


def validity(edges: DataFrame, *keys: str) -> DataFrame:
    """Per shape: rings, edges, whether all points are finite, rings have three points or more and area is positive."""
    ring = edges.groupBy(*keys, "part", "ring").agg(F.count("*").alias("n"), F.every(~F.isnan("x1") & ~F.isnan("y1") & (F.abs("x1") < float("inf")) & (F.abs("y1") < float("inf"))).alias("finite"), F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))).alias("twice"))
    return ring.groupBy(*keys).agg(F.count("*").alias("rings"), F.sum("n").alias("edges"), F.every("finite").alias("finite"), F.every(F.col("n") >= 3).alias("enough_points"), F.every(F.col("twice") > 0).alias("has_area"))


def self_intersections(edges: DataFrame, *keys: str) -> DataFrame:
    """Pairs of edges of one shape that properly cross; none in a valid shape.

    Edges are dealt into as many level strips as their shape has edges to the
    power of a half, so that far ones never meet.
    """
    size = edges.groupBy(*keys).agg(F.min(F.least("y1", "y2")).alias("__low"), F.max(F.greatest("y1", "y2")).alias("__high"), F.ceil(F.sqrt(F.count("*"))).alias("__strips"))
    known = edges.join(size, list(keys))

    def strip(y: Column) -> Column:
        share = F.when(F.col("__high") > F.col("__low"), (y - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.0)
        return F.least(F.floor(share * F.col("__strips")), F.col("__strips") - 1)

    a = known.withColumn("n", F.struct("part", "ring", "seq")).withColumn("first", strip(F.least("y1", "y2"))).withColumn("strip", F.explode(F.sequence("first", strip(F.greatest("y1", "y2")))))
    a = a.select(*keys, "n", "first", "strip", "x1", "y1", "x2", "y2")
    b = a.select(*keys, "strip", *[F.col(c).alias(f"{c}_b") for c in ("n", "first", "x1", "y1", "x2", "y2")])

    def side(px, py, qx, qy, rx, ry):
        return (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))

    boxes = (F.least("x1", "x2") < F.greatest("x1_b", "x2_b")) & (F.least("x1_b", "x2_b") < F.greatest("x1", "x2")) & (F.least("y1", "y2") < F.greatest("y1_b", "y2_b")) & (F.least("y1_b", "y2_b") < F.greatest("y1", "y2"))
    ab = side("x1", "y1", "x2", "y2", "x1_b", "y1_b") * side("x1", "y1", "x2", "y2", "x2_b", "y2_b")
    ba = side("x1_b", "y1_b", "x2_b", "y2_b", "x1", "y1") * side("x1_b", "y1_b", "x2_b", "y2_b", "x2", "y2")
    once = F.col("strip") == F.greatest("first", "first_b")
    return a.join(b, [*keys, "strip"]).filter((F.col("n") < F.col("n_b")) & once & boxes & (ab < 0) & (ba < 0)).select(*keys, "n", "n_b")
