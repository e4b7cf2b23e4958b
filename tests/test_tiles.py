"""Tiles with halos against one array, and files hashed in pieces."""

import hashlib
import math
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resample, terrain
from tidemark.sources import tables


def raster(spark, rows=23, cols=31, missing=0.08):
    rng = np.random.default_rng(2)
    z = np.round(rng.normal(100, 30, (rows, cols)), 2)
    gone = rng.random((rows, cols)) < missing
    cells = [(1, r - 5, c - 7, None if gone[r, c] else float(z[r, c])) for r in range(rows) for c in range(cols)]
    return z, gone, spark.createDataFrame(cells, "pair_id int, row int, col int, elevation double")


@pytest.mark.parametrize("tile", [1, 4, 256])
def test_slopes_do_not_depend_on_tiles(spark, tile):
    z, gone, cells = raster(spark)
    got = {(r.row + 5, r.col + 7): r.slope for r in terrain.horn_slope(cells, tile=tile).collect()}
    assert len(got) == z.size
    for (r, c), slope in got.items():
        inner = 0 < r < z.shape[0] - 1 and 0 < c < z.shape[1] - 1
        if not inner or gone[r - 1 : r + 2, c - 1 : c + 2].any():
            assert slope is None
            continue
        n = z[r - 1 : r + 2, c - 1 : c + 2]
        gx = ((n[0, 2] + 2 * n[1, 2] + n[2, 2]) - (n[0, 0] + 2 * n[1, 0] + n[2, 0])) / 240
        gy = ((n[2, 0] + 2 * n[2, 1] + n[2, 2]) - (n[0, 0] + 2 * n[0, 1] + n[0, 2])) / 240
        assert slope == pytest.approx(math.degrees(math.atan(math.hypot(gx, gy))))


@pytest.mark.parametrize("tile", [1, 3, 128])
def test_bilinear_values_do_not_depend_on_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(resample, "TILE", tile)
    z, gone, cells = raster(spark)
    rng = np.random.default_rng(3)
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-10, 28, 400), rng.uniform(-8, 22, 400)))] + [(400, None, 1.0), (401, 2.0, None), (402, 1e7, 1e7)]
    targets = spark.createDataFrame([(1, *p) for p in places], "pair_id int, k int, x double, y double")
    got = {r.k: r.elevation for r in resample.bilinear(targets, cells, F.col("x"), F.col("y"), "elevation", ["pair_id", "k"], keys=["pair_id"]).collect()}
    assert len(got) == len(places)
    for k, x, y in places:
        total = weight = 0.0
        if x is not None and y is not None:
            c0, r0 = math.floor(x - 0.5), math.floor(y - 0.5)
            for r, c in ((r0, c0), (r0, c0 + 1), (r0 + 1, c0), (r0 + 1, c0 + 1)):
                i, j = r + 5, c + 7
                if 0 <= i < z.shape[0] and 0 <= j < z.shape[1] and not gone[i, j]:
                    w = (1 - abs(x - 0.5 - c)) * (1 - abs(y - 0.5 - r))
                    total, weight = total + w * z[i, j], weight + w
        assert got[k] == (pytest.approx(total / weight) if weight else None)


def test_borders_alone_travel_twice(spark):
    from tidemark.operators.grid import with_halo

    cells = spark.range(256 * 256).select((F.col("id") / 256).cast("int").alias("row"), (F.col("id") % 256).cast("int").alias("col"))
    dealt = with_halo(cells, 128, -1, 1)
    assert dealt.count() < 1.07 * 256 * 256 and dealt.filter("__own").count() == 256 * 256


def test_a_file_beyond_two_gibibytes_is_hashed_in_pieces(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "large one.bin", "wb") as f:
        f.truncate(size)
        f.seek(size - 4)
        f.write(b"tail")
    (tmp_path / "small").mkdir()
    (tmp_path / "small" / "ü.txt").write_bytes(b"some text")
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    got = {r.path.rsplit("/", 1)[-1]: r for r in tables.file_inventory(spark, str(tmp_path)).collect()}
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss - before < 1 << 20  # kilobytes
    sha, zeros, left = hashlib.sha256(), bytes(1 << 20), size - 4
    while left:
        sha.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    sha.update(b"tail")
    large = next(r for r in got.values() if r.bytes == size)
    other = next(r for r in got.values() if r.bytes == 9)
    assert large.sha256 == sha.hexdigest() and other.sha256 == hashlib.sha256(b"some text").hexdigest()
    pieces = {r.bytes: (r.sha256, r.md5) for r in tables.file_inventory(spark, str(tmp_path / "small"), 0).collect()}
    assert pieces == {9: (other.sha256, hashlib.md5(b"some text").hexdigest())}
