"""Conversation tries, vector codes and secret scans against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_trie, secret_scan, vector_codes

# conversation tries


def trie(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [(r, t) for *_, r, t in sorted(v, key=lambda q: q[:2])] for c, v in held.items()}
    built = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = held.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, kids, saved, leaves = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1].encode()) if n else 0)
            leaves[n[:d]] += kids[n] == 0
    ends = {n: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(n)))) for n, m in members.items()}
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def dialogue():
    rnd, rows = random.Random(5), []
    for c in [*range(-6, 12), 100, 101, 103, 1000]:
        rows += [(c, k, rnd.choice(["u", "a", None]), rnd.choice(["x", "yy", "", None, "long é"])) for k in range(rnd.choice([1, 3, 9, 40, 61]))]
    return [*rows, (None, 1, "u", "t"), (7, None, "s", "first")]


@pytest.mark.parametrize("span, bits", [(conversation_trie.SPAN, conversation_trie.ID_BITS), (2, 0)])
def test_trie_matches_brute_force(spark, span, bits, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SPAN", span)
    monkeypatch.setattr(conversation_trie, "ID_BITS", bits)
    rows = dialogue()
    got = conversation_trie.prefix_trie(conversations(spark, rows).withColumn("depth", F.lit("mine")).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie(rows)


def test_trie_of_equal_conversations_and_of_none(spark):
    rows = [(c, k, "u", f"turn {k}") for c in range(3, 600, 5) for k in range(12)]
    got = conversation_trie.prefix_trie(conversations(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie(rows)
    assert conversation_trie.prefix_trie(conversations(spark, rows).limit(0)).count() == 0
    # the first turns of conversation 1 would come from 0, which is not there
    alone = [(1, 0, None, None)]
    got = conversation_trie.prefix_trie(conversations(spark, alone))
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie(alone)


def test_repeated_turns_have_one_order(spark):
    rows = [(5, 1, "u", t) for t in ("b", "a", "b", "c")] + [(5, 1, "a", "b")]
    one, two = (conversation_trie.turns(conversations(spark, r).repartition(p)).orderBy("at").collect() for r, p in ((rows, 1), (rows[::-1], 3)))
    assert one == two and [r.at for r in one] == list(range(5))


# vector codes


def codes(rows, entries=64, rounds=2, parts=16):
    kept = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1])
    values, cuts = np.array([v for _, v, _ in kept], np.int64), [k * width // parts for k in range(parts + 1)]
    cut = [values[:, a:b] for a, b in zip(cuts, cuts[1:])]
    books = [c[:entries].copy() for c in cut]
    look = lambda: [((c[:, None] - b[None]) ** 2).sum(2) for c, b in zip(cut, books)]
    for _ in range(rounds):
        for c, b, gaps in zip(cut, books, look()):
            for e in range(len(b)):
                if (own := gaps.argmin(1) == e).any():
                    b[e] = c[own].sum(0) // own.sum()
    gaps = look()
    error, by = sum(g.min(1) for g in gaps), defaultdict(int)
    for (_, _, label), e in zip(kept, error):
        by[label] += int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()
    return sorted((i, "".join(f"{g[k].argmin():02x}" for g in gaps), int(error[k]), by[label], digest) for k, (i, _, label) in enumerate(kept))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def coded(df, **more):
    out, books = vector_codes.compress(df, **more)
    return sorted(tuple(r) for r in vector_codes.with_books(out, books, "vec_id").collect())


@pytest.mark.parametrize("width, rounds", [(64, 2), (32, 4), (19, 1), (16, 0)])
def test_codes_match_brute_force(spark, width, rounds):
    rng = np.random.default_rng(width)
    base = rng.normal(0, 0.3, (12, width))
    rows = [(int(i), (base[i % 12] + rng.normal(0, 0.05, width)).astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(300)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(200)]  # one vector of very many
    rows += [(2000, None, 1), (2001, [None] * width, 2), (2002, [float("nan")] * width, 2), (2003, [float("inf")] + [0.0] * (width - 1), None)]
    df = vectors(spark, rows).withColumn("ord", F.lit("mine")).withColumn("code", F.lit(1))
    assert coded(df, entries=20, rounds=rounds) == codes(rows, 20, rounds)


def test_few_none_and_repeated_vectors(spark):
    rows = [(k, [float(k % 3) / 7] * 16, None) for k in range(5)]
    assert coded(vectors(spark, rows)) == codes(rows)
    assert coded(vectors(spark, rows).limit(0)) == [] and coded(vectors(spark, [(1, None, 1)])) == []
    twice = [(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (None, [0.25] * 16, 2)]
    got, _ = vector_codes.compress(vectors(spark, [*twice, (9, [1.0] * 8, 1)]))
    assert sorted((r.id or 0, r.error) for r in got.collect()) == [(0, 0), (1, 0), (1, 0)]
    with pytest.raises(Exception, match="reaches"):
        coded(vectors(spark, [(1, [2.0**21] * 16, 1)]))


def test_only_members_that_change_entry_move(spark, monkeypatch):
    moved, dealt = [], vector_codes._to_owners

    def watched(members, salts):
        out = dealt(members, salts)
        moved.append(out.count())
        return out

    monkeypatch.setattr(vector_codes, "_to_owners", watched)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 32).astype(np.float32).tolist(), 1) for i in range(400)]
    assert coded(vectors(spark, rows), entries=16) == codes(rows, 16)
    assert moved[0] == 400 * 16 and 0 < moved[1] < moved[0] / 2 and moved[2] < moved[1]


# secret scans

PATTERNS = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6, 2),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20, 0),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24, 0),
}


def base_spans(text):
    found = [(m.start(), k, m.end(), m[group]) for k, (pattern, fits, group) in enumerate(PATTERNS.values()) for m in pattern.finditer(text or "") if fits(m)]
    return sorted(found)


def random_like(v):
    return len(set(v)) >= 10 and len(re.findall("[0-9]+", v)) >= 3 and not v.isdigit()


def scanned(rows):
    spans = []
    for _, text, _, _ in rows:
        base = base_spans(text)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]+", text or "") if 20 <= len(m[0]) <= 128 and random_like(m[0]) and not any(a < m.end() and m.start() < b for a, _, b, _ in base)]
        spans.append(sorted(base + more))
    owners, places = defaultdict(set), defaultdict(set)
    for (_, _, source, lang), found in zip(rows, spans):
        for *_, v in found:
            owners[v].add(source), places[v].add((source, lang))
    out = []
    names = [*PATTERNS, "token"]
    for (i, *_), found in zip(rows, spans):
        live = [random_like(v) and len(owners[v]) <= 2 and len(places[v]) <= 4 for *_, v in found]
        said = [f"{names[k]}:{a}:{b}" for (a, k, b, _), alive in zip(found, live) if k < 3 or alive]
        base = [f"{names[k]}:{a}:{b}" for a, k, b, _ in found if k < 3]
        counts = [sum(k == n for _, k, *_ in found) for n in range(3)]
        copied = sum(random_like(v) and not alive for (_, k, _, v), alive in zip(found, live) if k < 3)
        out.append((i, *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said), sum(alive for alive in live), copied))
    return sorted(out)


def texts():
    rnd = random.Random(2)
    pick = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    hexed, mixed = "0123456789abcdef", "ABCDEFGHIJabcdefghij0123456789+/_-="
    shared, owned = pick(hexed, 40), pick(mixed, 33)
    rows = [
        None, "", "no secret here", "é" * 9 + f' Token = "{pick(hexed, 40)}" ü', "password: 12345 PASSWD='abcdef' secret=token:abcdefg", "token:K api_KEY : " + pick(mixed, 30),
        "toKen = abcdefgh ſecret = abcdefgh", "AKIA" + pick("ABCDEFGH0123", 15) + " AKIA" + pick("ABCDEFGH0123", 16) + "x AKIAKIA" + pick("ABC123", 20),
        pick(hexed, 23) + " " + pick(hexed, 24) + "g" + pick(hexed, 60), f"see {owned} and {owned}", f"see {owned}.", "1" * 60, "token=" * 400, "x" * 70_000 + " passwd = " + pick(mixed, 64) + "\n" * 500,
        "secret" + " " * 5000 + "=" + " " * 5000 + "abcdefghijkl", "a" * 25 + pick(mixed, 140), '{"api_key":"' + pick(mixed, 20) + '"}', "token == abcdefgh token = = abcdefgh",
    ]
    rows += [f"example key {shared} or {pick(mixed, 40)}" for _ in range(30)]
    return [(i, t, None if i % 11 == 0 else f"s{i % 7}", None if i % 5 == 0 else f"l{i % 2}") for i, t in enumerate(rows)]


def test_secrets_match_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = secret_scan.findings(df, F.col("source"), F.struct("source", "lang"))
    assert sorted(tuple(r) for r in secret_scan.summary(found, ["doc_id"]).collect()) == scanned(rows)
    assert any(r[-1] for r in scanned(rows)) and any("token:" in r[5] for r in scanned(rows))
    clashing = df.withColumn("row", F.lit(1)).withColumn("found", F.lit("x")).withColumn("ord", F.lit(2)).withColumn("owner", F.lit(3))
    more = secret_scan.findings(clashing, F.col("source"), F.struct("source", "lang"))
    assert sorted(tuple(r) for r in secret_scan.summary(more, ["doc_id"]).collect()) == scanned(rows)
    assert secret_scan.findings(df.limit(0), F.col("source"), F.col("lang")).count() == 0
    assert secret_scan.findings(df.unionByName(df), F.col("source"), F.struct("source", "lang")).count() == 2 * len(rows)
