"""Medians of patches of any size against numpy."""

import numpy as np
import pytest

from tidemark.operators import patches


def points(spark):
    rng = np.random.default_rng(4)
    rows = []
    for patch, n in (("C0001", 900), ("C0002", 60), ("C0003", 7), ("C0004", 1), ("C0005", 200)):
        for k in range(n):
            v = rng.normal(-20, 3, len(patches.MEASURES)).round(3)
            values = [None if rng.random() < 0.1 or patch == "C0005" and j == 7 else -20.0 if patch == "C0005" and j == 0 and k % 3 else float(x) for j, x in enumerate(v)]
            rows.append((1, patch, *values))
    rows.append((1, "C0001", *[1e9] * len(patches.MEASURES)))  # far from all others
    return rows, spark.createDataFrame(rows, "pair_id int, patch_id string, " + ", ".join(f"{m} double" for m in patches.MEASURES))


@pytest.mark.parametrize("one_task, buckets", [(10**6, 4096), (50, 4), (5, 64)])
def test_medians_are_exact_at_any_size(spark, one_task, buckets, monkeypatch):
    monkeypatch.setattr(patches.order_statistics, "__defaults__", (one_task, buckets))
    rows, df = points(spark)
    got = {r.patch_id: r for r in patches.zonal(df, one_task).collect()}
    assert len(got) == 5
    for patch, row in got.items():
        own = [r[2:] for r in rows if r[1] == patch]
        assert row.pixels == len(own)
        for j, m in enumerate(patches.MEASURES):
            held = [v[j] for v in own if v[j] is not None]
            assert row[f"{m}_median"] == (pytest.approx(float(np.median(held)), abs=1e-12) if held else None)


def test_places_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    v = np.r_[np.round(rng.normal(0, 1, 5000), 2), [np.finfo(float).max / 4] * 3]
    values = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0), ("b", None)], "k string, v double")
    wanted = spark.createDataFrame([("a", p) for p in (0, 1, 2500, 4999, 5002)] + [("b", 0)], "k string, place long")
    got = {(r.k, r.place): r.v for r in patches.order_statistics(values, wanted, ["k"], 20, 8).collect()}
    assert got == {**{("a", p): float(np.sort(v)[p]) for p in (0, 1, 2500, 4999, 5002)}, ("b", 0): 1.0}
