"""Sharding, mixing, packing, the pipeline and the SQL of the registered queries."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, packing, queries, sharding
from tests.llm.test_text_operators import DOCS, EDGE, WORD, components, docs, measures, passage, removed
from tests.test_oracles import SF, canonical


def test_shards_are_even_and_gapless(spark):
    texts = [*EDGE, *(passage(30 + k % 50, k) for k in range(600))]
    got = sharding.shard_documents(docs(spark, texts), 6).collect()
    assert len(got) == len(texts)
    loads, places = Counter(), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) <= 1.02 * max(min(loads.values()), sum(loads.values()) / 6)
    assert sharding.shard_documents(docs(spark, []), 6).count() == 0
    assert sharding.shard_documents(docs(spark, ["a", "a", None, None], [1, 1, None, None]), 6).count() == 4
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    named = docs(spark, ["a", "b" * 300_000]).withColumn("slot", F.lit("mine")).withColumn("size", F.lit(0))
    assert {r.size for r in sharding.shard_documents(named, 6).collect()} == {17, 300_016}


@pytest.mark.parametrize("heavy", [{}, {7: 900_000}, {3: 90_000, 9: 90_000, 12: 80_000}])
def test_maps_are_edited_not_dealt_anew(heavy):
    weights = {s: 50 + s * s % 997 for s in range(1024)} | heavy
    first = sharding.first_map(None, 8, 1024)
    second = sharding.rebalanced(first, weights, 8)
    loads = Counter()
    for s, w in weights.items():
        loads[second[s]] += w
    alone = sum(w for w in heavy.values() if w > sum(weights.values()) / 8)
    even = (sum(weights.values()) - alone) / (8 - bool(alone))
    assert sorted(loads.values())[-2] <= 1.01 * even and min(loads.values()) >= 0.99 * even
    assert sum(first[s] != second[s] for s in first) < 400
    grown = {s: w + w * (s % 5) // 50 for s, w in weights.items()}
    third = sharding.rebalanced(second, grown, 8)
    assert sum(second[s] != third[s] for s in second) < 150
    again = sharding.rebalanced(second, weights, 8)
    assert sum(second[s] != again[s] for s in second) < 40

def test_map_versions(spark, tmp_path):
    first = sharding.first_map(spark, 3, 12)
    second = sharding.rebalanced(first, {0: 100, 3: 90, 6: 80, 1: 5}, 3)
    moved = {s for s in first if first[s] != second[s]}
    assert moved and moved <= {0, 3, 6, 1}
    sharding.save_map(spark, first, 1, str(tmp_path))
    sharding.save_map(spark, second, 2, str(tmp_path))
    assert sharding.load_map(spark, str(tmp_path), 1) == first and sharding.load_map(spark, str(tmp_path), 2) == second
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(spark, second, 2, str(tmp_path))


def test_rows_follow_the_stored_map(spark, tmp_path):
    df, path = docs(spark, [passage(30 + k % 50, k) for k in range(300)]), str(tmp_path / "maps")
    for versions in ([1, 2], [1, 2, 3]):
        got = sharding.shard_documents(df, 6, map_path=path).collect()
        stored = sharding.load_map(spark, path, versions[-1])
        assert {r[0] for r in spark.read.parquet(path).select("version").distinct().collect()} == set(versions)
        assert {r.map_version for r in got} == {versions[-1]} and all(stored[r.virtual_slot] == r.shard for r in got)
    assert {r.map_version for r in sharding.shard_documents(df, 6).collect()} == {2}


def mixed_rows(spark, n=400):
    rows = [(k, passage(5 + k * 7 % 90, k), "en", None if k % 7 == 0 else f"s{k % 3}", 0) for k in range(n)]
    return spark.createDataFrame([*rows, (None, None, None, None, None), (None, "x y", "en", "s1", 3)], DOCS)


def test_mix_comes_near_its_targets(spark):
    df = mixed_rows(spark)
    got = mixing.mix(df).collect()
    assert len(got) == df.count() and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.copies <= 2
        by[r.source].append(r)
    targets = {s: rows[0].target for s, rows in by.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for s, rows in by.items():
        assert targets[s] <= 2 * rows[0].source_size + 1e-6
        assert sum(r.copies * r.size for r in rows) == pytest.approx(targets[s], abs=8)
    assert mixing.mix(df.limit(0)).count() == 0


def test_weights_make_documents_unequally_likely(spark):
    df = mixed_rows(spark, 900).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    rows = mixing.mix(df.filter("source = 's1'").unionByName(df.filter("source = 's2'")), share_percent=60, weight_col="w").collect()
    rate = lambda odd: sum(r.copies for r in rows if r.doc_id is not None and r.doc_id % 2 == odd) / sum(1 for r in rows if r.doc_id is not None and r.doc_id % 2 == odd)
    assert rate(0) > 1.5 * rate(1)


def test_rates_meet_targets_under_the_ceiling(spark):
    rows = [(s, w, n, t) for s, classes, t in (("a", {1.0: 50, 3.0: 50}, 190.0), ("b", {1.0: 10, 2.0: 10}, 3.0), ("c", {0.5: 7}, 14.0)) for w, n in classes.items()]
    got = {r.source: r.rate for r in mixing._rates(spark.createDataFrame([(s, w, n, t) for s, w, n, t in rows], "source string, weight double, words long, target double"), 2).collect()}
    for source in "abc":
        own = [(w, n, t) for s, w, n, t in rows if s == source]
        assert sum(n * min(got[source] * w, 2) for w, n, _ in own) == pytest.approx(own[0][2])
    kept = spark.createDataFrame([(x,) for x in (0.0, -1.0, 1.0, 1.9, 2.1, 5.9, 1e300, float("inf"), float("nan"))], "w double").select(mixing.rounded_weight(F.col("w"))).collect()
    assert [r[0] for r in kept][:6] == [0.0, 0.0, 1.0, 1.75, 2.0, 5.0] and kept[6][0] > 7e299 and kept[7][0] == 0.0


def test_mix_fills_by_rank_around_a_very_long_document(spark):
    rows = [(k, passage(5 + k % 40, k), "en", "s", 0) for k in range(400)] + [(999, " ".join(["w"] * 4000), "en", "s", 0), (1000, passage(50, 5), "en", "t", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1)).withColumn("copies", F.lit("x"))
    for seed in range(3):
        got = [r for r in mixing.mix(df, seed=seed, by_length=True).collect() if r.source == "s"]
        assert sum(r.copies * r.size for r in got) == pytest.approx(got[0].target, rel=0.004)
        assert all(r.copies <= 2 for r in got)


def test_packing_holds_every_word_once(spark):
    texts = [None, "", "a", " ".join(["w"] * 9000), " ".join(["w"] * 4096), *(passage(3 + k * 13 % 700, k) for k in range(500))]
    df = docs(spark, texts)
    got = packing.best_fit(df, group_rows=100).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
        if r.bin_id is not None:
            bins[r.bin_id].append((r.bin_offset, r.length, r.capacity))
    for i, t in enumerate(texts):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(WORD.findall(t or ""))
    for held in bins.values():
        held.sort()
        size = sum(x[1] for x in held)
        assert all(x[0] == sum(y[1] for y in held[:k]) for k, x in enumerate(held))
        assert held[0][2] == min(c for c in packing.CAPACITIES if c >= size)
    assert packing.best_fit(df.limit(0)).count() == 0
    many = docs(spark, ["a b"] * 300 + ["c"], [7] * 300 + [8]).withColumn("piece", F.lit("mine"))
    once, again = (sorted(map(str, packing.best_fit(df, group_rows=100).collect())) for df in (many, many.repartition(7, F.rand(3))))
    assert len(once) == 301 and once == again
    named = packing.best_fit(docs(spark, ["a b", "a b", None]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id") % 2))).collect()
    assert sorted(r.doc_id for r in named) == ["d0", "d0", "d1"]


def test_packing_is_near_the_cheapest_on_small_sets(spark):
    def cheapest(sizes, caps):
        """Least cost over all ways to part the sizes into bins."""
        best = [float("inf")]

        def deal(rest, bins):
            cost = sum(packing.linear_cost(min(c for c in caps if c >= b)) for b in bins)
            if not rest:
                best[0] = min(best[0], cost)
                return
            for k in range(len(bins)):
                if bins[k] + rest[0] <= caps[-1]:
                    deal(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]])
            deal(rest[1:], [*bins, rest[0]])

        deal(sizes, [])
        return best[0]

    for seed in range(12):
        sizes = sorted((1 + (seed * 7919 + k * k * 31) % 4000 for k in range(7)), reverse=True)
        _, caps = packing.pack(sizes)
        assert sum(map(packing.linear_cost, caps)) <= 1.35 * cheapest(sizes, packing.CAPACITIES)


def test_joint_packing_is_no_dearer_than_one_length():
    sizes = sorted((3 + k * k * 17 % 4000 for k in range(400)), reverse=True)
    bins, caps = packing.pack(sizes)
    cost = sum(map(packing.linear_cost, caps))
    for c in packing.CAPACITIES:
        if c >= max(sizes):
            used, _ = packing._fit(sizes, lambda i, c=c: c)
            assert cost <= packing.linear_cost(c) * (max(used) + 1)
    content = Counter()
    for b, s in zip(bins, sizes, strict=True):
        content[b] += s
    assert all(content[b] <= caps[b] for b in content)


def test_pipeline_matches_brute_force(spark, tmp_path):
    shared = passage(30, 77)
    texts = [*EDGE, *(passage(60 + k, k) for k in range(60)), *(passage(60 + k, k) + " more" for k in range(0, 60, 9)), *(passage(50, 200 + k) + " " + shared + " " + passage(50, 300 + k) for k in range(6)), "% | # " * 50]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))

    good = corpus_pipeline.quality_rules(spark, df, "").orderBy("doc_id").collect()
    base_ok = {i for i, t in enumerate(texts) if (m := measures(t)) and m[0] >= 20 and 100 * m[4] <= 30 * m[0] and 100 * m[2] <= 30 * m[0]}
    assert {r.doc_id for r in good} == base_ok

    first = spark.createDataFrame(good, DOCS)
    apart = corpus_pipeline.near_dedup(spark, first, "").orderBy("doc_id").collect()
    keep = {good[i].doc_id for i, _, _, kept in components([r.text for r in good], 5, 80) if kept}
    assert {r.doc_id for r in apart} == keep

    second = spark.createDataFrame(apart, DOCS)
    cut = {r.doc_id: r for r in corpus_pipeline.span_dedup(spark, second, "").collect()}
    for r, (_, gone, _, digest) in zip(apart, removed((r.doc_id, r.text) for r in apart), strict=True):
        if gone == 0:
            assert cut[r.doc_id].text == r.text
        elif r.doc_id in cut:
            assert hashlib.sha256(cut[r.doc_id].text.encode()).hexdigest() == digest and cut[r.doc_id].n_chars == len(cut[r.doc_id].text)

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words = Counter()
    for r in out:
        words[r.doc_id] += r.length
    third = spark.createDataFrame(list(cut.values()), DOCS)
    want = Counter()
    for r in mixing.mix(third, by_length=True).collect():
        if r.copies:
            want[r.doc_id] += r.copies * r.size
    assert +words == +want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df.limit(0), "").columns == df.columns


def test_stages_keep_columns_that_clash(spark):
    rows = [(k, None if k == 3 else passage(40, k), "en", "s", 7) for k in range(6)] + [(6, passage(40, 1), "en", "s", 7)]
    clashing = ["size", "copy", "copies", "row", "null", "columns", "ord", "n_removed", "kept_text", "kept", "component", "target", "n_words"]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"mine {c}") for c in clashing})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "").collect()
        assert out and all(r[c] == f"mine {c}" for r in out for c in clashing), name
        assert all((r.text is None) == (r.doc_id == 3) for r in out), name
    cut = {r.doc_id: r for r in corpus_pipeline.span_dedup(spark, df, "").collect()}
    assert set(cut) == set(range(6)) and all(r.n_chars == 7 for r in cut.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(canonical, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
