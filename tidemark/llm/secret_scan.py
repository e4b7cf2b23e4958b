"""Secrets in texts, told apart by who owns them in the whole corpus.

Every text is scanned for spans of four kinds.  The digests of what the spans
hold are counted by distinct repositories and owners over all documents: a value
that many have is a copied example, one that few have and that looks random is a
live-looking credential.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .stable import stored

#: Kinds in the order in which spans of equal starts are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "token")
BASE = KINDS[:3]
#: Case-insensitive in its key words; texts are matched lower-cased (A-Z), which moves no position.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Lengths of a free-standing token.
LEAST_TOKEN, MOST_TOKEN = 20, 128
#: A value looks random with so many different characters and runs of digits.
LEAST_CHARACTERS, LEAST_DIGIT_RUNS = 10, 3
#: A value of more owners or repositories than this is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 4

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("random", T.BooleanType())]))
_DIGITS = re.compile(rb"[0-9]+")


def _table(*ranges: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b"".join(ranges))] = True
    return out


_NUMBERS, _SMALL, _LARGE = (bytes(range(a, b + 1)) for a, b in (b"09", b"az", b"AZ"))
_HEX, _TOKEN = _table(_NUMBERS, b"abcdef"), _table(_NUMBERS, _SMALL, _LARGE, b"+/_=-")


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the maximal runs of marked bytes of the given lengths; none crosses rows."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, inside], np.r_[inside, False]
    start, end = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    fit = (end - start >= least) & (end - start <= most)
    start, end = start[fit], end[fit]
    yield from zip((np.searchsorted(offsets, start, "right") - 1).tolist(), start.tolist(), end.tolist(), strict=True)


def looks_random(value: bytes) -> bool:
    """Many different characters, letters among them, and digits in several places."""
    return len(set(value)) >= LEAST_CHARACTERS and len(_DIGITS.findall(value)) >= LEAST_DIGIT_RUNS and any(not 48 <= c <= 57 for c in value)


def _found(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, bytes]]]:
    """Per row the (start, kind, end, value) in bytes from the row's start, in order."""
    text, low = data.tobytes(), at.lower_ascii(data).tobytes()
    rows: list[list[tuple[int, int, int, bytes]]] = [[] for _ in range(len(offsets) - 1)]
    ends = offsets.tolist()
    for row, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        for m in ASSIGN.finditer(low, a, b):
            if m.end(1) - m.start(1) >= LEAST_ASSIGN:
                rows[row].append((m.start(), 0, m.end(), text[m.start(1) : m.end(1)]))
        for m in ACCESS.finditer(text, a, b):
            if m.end() - m.start() >= LEAST_ACCESS:
                rows[row].append((m.start(), 1, m.end(), m[0]))
    for row, a, b in _runs(_HEX[data], offsets, LEAST_HEX, len(data)):
        rows[row].append((a, 2, b, text[a:b]))
    base = [sorted((a, b) for a, _, b, _ in row) for row in rows]
    for row, a, b in _runs(_TOKEN[data], offsets, LEAST_TOKEN, MOST_TOKEN):
        if not any(x < b and a < y for x, y in base[row]) and looks_random(text[a:b]):
            rows[row].append((a, 3, b, text[a:b]))
    return [sorted(row) for row in rows]


def scan(docs: DataFrame, carry: list[Column], text_col: str = "text") -> DataFrame:
    """The ``carry`` columns and ``found``, all spans of each whole text in code points, with digests of what they hold."""
    source = docs.select(F.struct(*carry).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("digest", pa.binary()), ("random", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text"):
            data, offsets = at.flat(at.column(part, "text"))
            rows = _found(data, offsets)
            place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            spans = [[(int(place[a] - place[o]), k, int(place[b] - place[o]), xxhash.xxh3_128_digest(v), looks_random(v)) for a, k, b, v in row] for row, o in zip(rows, offsets.tolist(), strict=False)]
            named = [[dict(zip(("start", "kind", "end", "digest", "random"), s, strict=True)) for s in row] for row in spans]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, kind)], ["row", "found"])

    schema = T.StructType([*source.select("row").schema.fields, T.StructField("found", _SPANS)])
    return source.mapInArrow(run, schema).select("row.*", "found")


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories) of every value of (owner, repository, found), over the whole corpus.

    Null is an owner, or a repository, like any other.  Counts are summed in steps
    that combine before each shuffle, so a value in every document is no hot key.
    """
    each = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("found", lambda s: s["digest"]))).alias("digest"))
    places = each.groupBy("digest", "owner", "repository").agg(F.lit(1))
    owned = places.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return owned.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def findings(docs: DataFrame, owner: Column, repository: Column, text_col: str = "text", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Every row of ``docs`` without its text, as the struct ``row``, and ``spans``: {start, kind, end, digest, random, owners, repositories, live}.

    Positions are code points, ends exclusive, in order of start, then kind.  The
    base kinds stay whatever their owners; a free-standing token is listed only
    where it is ``live``, that is, looks random and has at most the given numbers
    of owners and repositories in the corpus.  Null and empty texts have no spans;
    repeated rows each have theirs; an empty table gives an empty result.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    carry = [F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), owner.alias("owner"), repository.alias("repository")]
    found = stored(scan(docs, carry, text_col).withColumn("ord", F.monotonically_increasing_id()))
    some = found.filter(F.size("found") > 0)
    asked = some.select("ord", F.explode("found").alias("s"))
    known = asked.join(ownership(some), F.col("s.digest") == F.col("digest"))
    live = F.col("s.random") & (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = known.select("ord", F.struct("s.start", "s.kind", "s.end", "s.digest", "s.random", "owners", "repositories", live.alias("live")).alias("s")).filter(f"s.kind < {len(BASE)} OR s.live")
    per_row = judged.groupBy("ord").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    empty = F.array().cast(f"array<{judged.schema['s'].dataType.simpleString()}>")
    told = some.select("ord", "row").join(per_row, "ord", "left").select("row", F.coalesce("spans", empty).alias("spans"))
    return told.unionByName(found.filter(F.size("found") == 0).select("row", empty.alias("spans")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame, carry: list[str]) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, all spans, and how many are live or copied."""
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        *[F.col("row")[c].alias(c) for c in carry],
        *[count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(len(BASE))],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["random"] & ~s["live"]).alias("n_copied"),
    )
