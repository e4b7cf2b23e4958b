"""Text operators against brute force, and their defined edge cases."""

import hashlib
import itertools
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import html_text, near_dups, quality, suffix_dedup, toxicity, url_rules, version_sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def passage(n, seed):
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 100003}" for k in range(n))


EDGE = [None, "", " \n ", "one", "x" * 50_000, "a b " * 3000, "é ü ñ 中文", passage(300, 1), passage(300, 1)]


def measures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality_measures_match_brute_force(spark):
    texts = [*EDGE, "a line\nother\na line\n\n\na line", "# x | y\n" * 40, passage(40, 3) + " " + passage(40, 3)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t), i
        n, _, _, _, again = measures(t)
        assert r.base_failed == (n < 20 or 100 * again > 30 * n)
        assert not (r.base_failed and r.kept)
    assert got[7].kept and not got[5].kept


def test_quality_keeps_columns_and_empty_tables(spark):
    df = docs(spark, [passage(60, 5), "short"]).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(1))
    out = quality.keep_good(df)
    assert out.columns == df.columns and [r.kept for r in out.collect()] == ["mine"]
    assert quality.judge(df.limit(0)).count() == 0
    again = quality.judge(df.unionByName(df), ["doc_id"]).groupBy("doc_id", "n_words", "base_failed").count().collect()
    assert sorted((r.doc_id, r["count"]) for r in again) == [(0, 2), (1, 2)]


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def rule_of(host, path):
    fit = [(len(r), v, r) for v, r in RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return max(fit)[1:] if fit else ("allow", None)


@pytest.mark.parametrize("few", [True, False])
def test_url_rules_match_brute_force(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/12?x#y", "https://example.org/es", "https://example.org/es/", "http://b.com/fr/1", "http://com/de/x/y", "x://de.com/fr", "http://notexample.org/es/1", "http://q.net/a", "http://q.net/a", "http://a..org//x", "http://h.org" + "/p" * 4000, "http://" + "a." * 30_000 + "example.org/es/", "http://" + "." * 9_000 + "/"]
    df = spark.createDataFrame([(i % 5, u, "v") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.verdict, r.rule) for r in url_rules.decide(df, url_rules.rule_table(spark, RULES), ["page_id"]).collect())
    want = Counter()
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        want[(i % 5, host, path, *rule_of(host, path))] += 1
    assert got == want
    assert url_rules.decide(df.limit(0), url_rules.rule_table(spark, RULES)).count() == 0


def removed(rows):
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                mask[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, mask, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("slice_bytes", [600, 1 << 20])
def test_repeated_bytes_match_brute_force(spark, slice_bytes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    p, q = passage(60, 11), passage(40, 12)
    texts = [None, "", "z" * 99, "z" * 100, "z" * 350, p, "x " + p + " y " + q, q + p[:150] + "é" + p[20:], q, q, "ab" * 400, p[:99], p[3:103], ("中" * 40 + "é") * 6, "a" * 137 + "b" * 137 + "a" * 120]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicate(docs(spark, texts).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(enumerate(texts))


def test_windows_have_a_second_identity():
    data = np.frombuffer(passage(60, 3).encode(), np.uint8)
    starts = np.arange(len(data) - 99)
    words = suffix_dedup.window_words(np.concatenate([data, data]), np.concatenate([starts, starts + len(data)]))
    assert (words[: len(starts)] == words[len(starts) :]).all() and len(set(words.tolist())) == len(starts)
    for k in range(100):
        other = data.copy()
        other[k] ^= 1
        assert suffix_dedup.window_words(other, np.array([0]))[0] != words[0]


def test_repeated_bytes_of_named_rows(spark):
    p = passage(40, 91)
    df = docs(spark, [p, p, p[:120]]).withColumn("doc_id", F.element_at(F.array(F.lit("b"), F.lit("a"), F.lit("c")), (F.col("doc_id") + 1).cast("int")))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicate(df).collect()}
    assert got == {"a": 0, "b": len(p), "c": 120}


def test_repeated_bytes_keep_rows_and_characters(spark):
    p = "é".join(passage(40, 91).split())
    df = docs(spark, [p, "q" + p, p, None], [4, 4, None, 9]).withColumn("n_removed", F.lit("mine"))
    out = suffix_dedup.deduplicate(df, df.columns, with_text=True).collect()
    assert len(out) == 4
    # the null id comes first and keeps its text; of the others nothing or the odd letter is left
    assert sorted((r.doc_id is None, r.text or "") for r in out) == [(False, ""), (False, ""), (False, "q"), (True, p)]
    assert suffix_dedup.deduplicate(df.limit(0)).count() == 0


def components(texts, size, percent):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("crowd, unit", [(near_dups.CROWD, near_dups.UNIT), (0, 2000), (2, 100_000)])
def test_near_duplicates_match_brute_force(spark, crowd, unit, monkeypatch):
    monkeypatch.setattr(near_dups, "CROWD", crowd)
    monkeypatch.setattr(near_dups, "UNIT", unit)
    monkeypatch.setattr(near_dups, "TURNS", 1)
    base = passage(200, 21).split()
    chain = [" ".join(base[k : k + 160]) for k in range(0, 40, 8)]  # neighbours alike, ends not
    edited = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in range(0, 200, 17)]
    texts = [None, "", "one two", "One TWO", "one two three", *chain, *edited, " ".join(base).upper(), passage(200, 22), passage(200, 22)]
    got = sorted(tuple(r) for r in near_dups.near_duplicates(docs(spark, texts), size=4).collect())
    assert got == components(texts, 4, 80)


def test_near_duplicates_with_odd_ids(spark):
    t = passage(50, 31)
    df = docs(spark, [t, t, t, "", ""], [5, None, 5, None, 7])
    got = near_dups.near_duplicates(df)
    assert got.count() == 5 and got.filter("kept").count() == 3
    kept = near_dups.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert near_dups.near_duplicates(df.limit(0)).count() == 0
    named = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumn("kept", F.lit("mine")).withColumn("__ord", F.lit(1))
    assert near_dups.near_duplicates(named).filter("kept").count() == 3
    kept = near_dups.drop_near_duplicates(named.drop("__ord"))
    assert kept.columns == named.columns[:-1] and [r.kept for r in kept.collect()] == ["mine"] * 3


@pytest.mark.parametrize("unit, held", [(5000, 2), (5000, 16), (1, 3)])
def test_crowded_buckets_match_brute_force(spark, unit, held, monkeypatch):
    monkeypatch.setattr(near_dups, "CROWD", 8)
    monkeypatch.setattr(near_dups, "UNIT", unit)
    monkeypatch.setattr(near_dups, "HELD", held)
    base = passage(100, 77).split()

    def edited(k):
        out = list(base)
        for e in range(1 + k % 4):
            out[(k * 37 + e * 29) % 100] = f"e{k}x{e}"
        return " ".join(out)

    texts = [edited(k) for k in range(90)]
    got = sorted(tuple(r) for r in near_dups.near_duplicates(docs(spark, texts), size=4).collect())
    want = components(texts, 4, 80)
    assert got == want and 1 < len({c for _, _, c, _ in want}) < 60


def test_a_chain_of_near_duplicates_is_one_component(spark):
    words = passage(900, 5).split()
    texts = [" ".join(words[k : k + 80]) for k in range(0, 800, 4)]  # each like its neighbours only
    order = sorted(range(len(texts)), key=lambda k: (k * 7919) % 101)
    got = near_dups.near_duplicates(docs(spark, [texts[k] for k in order]))
    assert got.select("component_id").distinct().count() == 1 and got.filter("kept").count() == 1


def test_intersections_by_products():
    sets = [np.unique(np.array([(k * j * 7919) % (40 + k) for j in range(60)], np.uint64)) for k in range(12)]
    for width in (3, 8192):
        got = near_dups._common_counts(sets[:5], sets[5:], width)
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[5:]] for x in sets[:5]]


def test_bayesian_bounds():
    bounds = near_dups.least_matches(80, 1e-6)
    assert len(bounds) == near_dups.HASHES // near_dups.BATCH and list(bounds) == sorted(bounds)
    assert bounds[-1] < 0.8 * near_dups.HASHES


def paragraphs_of(text):
    """The distinct paragraphs, word by word: an end of line, a word that ends in . ! ? or whose hash is a multiple of 8, or 16 words since any of these end one."""
    out, now, previous = set(), [], 0
    for m in WORD.finditer(text):
        if now and "\n" in text[previous : m.start()]:
            out.add(tuple(now))
            now = []
        now.append(m[0])
        previous = m.end()
        if m[0][-1] in ".!?" or xxhash.xxh3_64_intdigest(m[0].encode()) % 8 == 0 or len(now) == 16:
            out.add(tuple(now))
            now = []
    return out | ({tuple(now)} if now else set())


def alike(t, u):
    """Shared share of the different paragraphs, from sets instead of sketches."""
    a, b = paragraphs_of(t), paragraphs_of(u)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("rows, coarse", [(version_sketch.BUCKET_ROWS, version_sketch.COARSE), (1, 4), (2, 1), (3, 2)])
def test_fingerprints_match_brute_force(spark, rows, coarse, monkeypatch):
    monkeypatch.setattr(version_sketch, "BUCKET_ROWS", rows)
    monkeypatch.setattr(version_sketch, "COARSE", coarse)
    texts = [None, "", "a", "ab", passage(90, 41) + ". " + passage(30, 42), "é\n" * 30, passage(2000, 43), passage(2000, 43), "w " * 500, passage(20_000, 44), passage(20_000, 44)[:90_000]]
    df = docs(spark, texts).withColumn("place", F.lit(1)).withColumn("near_next", F.lit("mine"))
    got = {r.doc_id: r for r in version_sketch.compare_versions(df.repartition(3)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, u = texts[i] or "", texts[j] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(alike(t, edited)) and got[i].near_next == pytest.approx(alike(t, u))
    assert got[6].fingerprint == got[7].fingerprint and got[7].near_next == 1.0
    one = version_sketch.compare_versions(docs(spark, ["only one"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert version_sketch.compare_versions(docs(spark, [])).count() == 0
    same = version_sketch.compare_versions(docs(spark, ["x", "x", "y", *map(str, range(20))], [1, 1, None, *[4] * 20])).collect()
    assert len(same) == 23 and sorted(r.doc_id or 0 for r in same) == [0, 1, 1, *[4] * 20]


def test_chains_match_enumeration(monkeypatch):
    rng = np.random.default_rng(3)
    counts = [0, 1, 5, 9, 3, 8, 0, 10]
    first = np.r_[0, np.cumsum(counts)]
    emission, change = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))

    def enumerated(e):
        marginal, pairs, total = np.zeros(len(e)), np.zeros((2, 2)), 0.0
        for states in itertools.product((0, 1), repeat=len(e)):
            w = np.exp(np.dot(e, states) + sum(change[a, b] for a, b in zip(states, states[1:], strict=False)))
            total += w
            marginal += w * np.array(states)
            for a, b in zip(states, states[1:], strict=False):
                pairs[a, b] += w
        return marginal / total, pairs / total

    want = [enumerated(emission[a:b]) for a, b in zip(first, first[1:], strict=False)]
    for stretch in (2, 3, 4, 64):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        p, pairs = toxicity._Chains(first).marginals(emission, change)
        assert np.allclose(p, np.concatenate([w[0] for w in want])) and np.allclose(pairs, sum(w[1] for w in want))


def test_scores_of_odd_texts(spark):
    clean = [passage(30, i) for i in range(60)]
    df = docs(spark, [*clean, *(f"{passage(10, i)} VILLAIN {passage(10, i + 9)}" for i in range(60, 120))])
    labels = df.select("doc_id", (F.col("doc_id") >= 60).cast("int").alias("toxic"))
    # repeated ids and labels, null labels, and texts without label
    extra = docs(spark, ["villain again", None], [3, None])
    model = toxicity.fit(df.unionByName(extra), labels.unionByName(labels.limit(5)).unionByName(labels.limit(3).withColumn("toxic", F.lit(None).cast("int"))))
    assert model.words.tolist() == toxicity.fit(extra.unionByName(df).repartition(7), labels).words.tolist()
    long = passage(60_000, 5)
    odd = docs(spark, [long, long + " villain", "villain", "villain"], [1, 2, 3, 3]).withColumn("score", F.lit("mine")).withColumn("spans", F.lit(1))
    got = toxicity.score(odd, model, odd.columns).orderBy("doc_id").collect()
    assert [r.predicted for r in got] == [0, 1, 1, 1] and got[2].score == got[3].score and got[1].spans[-1].end == len(long) + 8


def test_peeling_recovers_differences():
    a = [f"p{k}." for k in range(400)]
    left = version_sketch.paragraphs(pa.array(["\n".join(a)], pa.large_string()))
    right = version_sketch.paragraphs(pa.array(["\n".join(a[30:] + ["new."])], pa.large_string()))
    assert version_sketch.likeness(left, right, 1)[0] == pytest.approx(370 / 401)


def test_near_equal_versions_are_settled_by_their_fingerprints(monkeypatch):
    made, sketched = [], version_sketch.sketch

    def watched(row, digest, rows, cells, *more):
        made.append((rows, cells))
        return sketched(row, digest, rows, cells, *more)

    a = [f"p{k}." for k in range(3000)]
    versions = [a[:-1] + ["other."], a[2:], a + ["more."]] * 20 + [a] * 20
    texts = lambda x: version_sketch.paragraphs(pa.array(["\n".join(v) for v in x], pa.large_string()))
    left, right = texts([a] * len(versions)), texts(versions)
    monkeypatch.setattr(version_sketch, "sketch", watched)
    got = version_sketch.likeness(left, right, len(versions))
    assert [c for _, c in made] == [version_sketch.CELLS] * 2
    assert got.tolist() == pytest.approx([2999 / 3001, 2998 / 3000, 3000 / 3001] * 20 + [1.0] * 20)
    # others are sketched once more, by their estimate, and few of them again
    made.clear()
    versions = [a[k * 20 :] + [f"n{j}." for j in range(k * 11)] for k in range(3, 100)]
    left, right = texts([a] * len(versions)), texts(versions)
    got = version_sketch.likeness(left, right, len(versions))
    assert got.tolist() == pytest.approx([(3000 - k * 20) / (3000 + k * 11) for k in range(3, 100)])
    assert sum(r for r, c in made if c > version_sketch.CELLS) < 1.25 * len(versions)


def test_fingerprints_of_ids_of_any_type(spark):
    df = docs(spark, ["a. b.", "a. c.", None, "a. b."]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = {r.doc_id: r for r in version_sketch.compare_versions(df).collect()}
    whole = {r.doc_id: r for r in version_sketch.compare_versions(docs(spark, ["a. b.", "a. c.", None, "a. b."])).collect()}
    assert {k: tuple(v)[1:] for k, v in got.items()} == {f"d{k}": tuple(v)[1:] for k, v in whole.items()}
    assert version_sketch.compare_versions(df.limit(0)).count() == 0


def test_long_labelled_texts_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 2000)
    long = [f"{passage(400, i)} VILLAIN {passage(400, i + 9)}" for i in range(60)]
    df = docs(spark, long + [passage(900, 300 + i) for i in range(60)])
    labels = df.select("doc_id", (F.col("doc_id") < 60).cast("int").alias("toxic"))
    sample = toxicity.training_sample(df, labels).collect()
    assert max(len(r.text) for r in sample) == 2000 and len({r.doc_id for r in sample}) == 120
    by = {}
    for r in sample:
        by[r.doc_id] = by.get(r.doc_id, "") + r.text
    assert all(by[k] == t for k, t in enumerate(long))
    model = toxicity.fit(df, labels)
    assert [r.predicted for r in toxicity.score(docs(spark, ["the villain here", passage(20, 7)]), model).orderBy("doc_id").collect()] == [1, 0]
    assert len(toxicity.choose(df, labels, 2)) == len(toxicity.TRIED)


def test_texts_beyond_the_positions_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGEST", 400)
    assert suffix_dedup.deduplicate(docs(spark, ["x" * 399, "x" * 150])).count() == 2
    with pytest.raises(ValueError, match="400 bytes"):
        suffix_dedup.deduplicate(docs(spark, ["é" * 200, "x"]))
