"""Connected components against union and find, and their rounds on long chains."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph


def chain(spark, n, kind):
    ids = list(range(n))
    if kind == "random":
        random.Random(1).shuffle(ids)
    if kind == "bits":
        width = (n - 1).bit_length()
        ids = [int(format(i, f"0{width}b")[::-1], 2) for i in range(n)]
    return spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")


def smallest(edges):
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, x)
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "bits"])
def test_a_chain_is_contracted_in_few_rounds(spark, kind):
    n, left, rounds, sizes = 5_000, chain(spark, 5_000, kind), 0, []
    while (size := left.count()) > 200:
        sizes.append(size)
        _, left = graph.contracted(left)
        rounds += 1
    # each round leaves little more than half of a path, in whatever order it is numbered
    assert rounds <= 7 and sizes[0] == n - 1 and all(b < 0.7 * a for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("one_task", [0, 40, 10**6])
def test_components_are_the_same_by_rounds_and_in_one_task(spark, one_task):
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(500, 500)]
    df, want = spark.createDataFrame(edges, "a long, b long"), smallest(edges)
    assert {r.node: r.component for r in graph.components(df, one_task).collect()} == want
    pair = df.select(*[F.struct(F.lit(1).alias("pair_id"), F.col(c).alias("local")).alias(c) for c in "ab"])
    assert {r.node.local: r.component.local for r in graph.components(pair, one_task).collect()} == want


def test_hubs_and_empty_tables(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(i, 0) for i in range(1, 50)], "a long, b long")
    got = graph.components(star, 10)
    assert got.count() == 3000 and got.filter("component != 0").count() == 0
    assert graph.components(star.limit(0), 0).count() == 0


def test_a_bit_reversed_chain_ends(spark):
    got = graph.components(chain(spark, 64, "bits"), 0)
    assert got.count() == 64 and got.filter("component != 0").count() == 0
