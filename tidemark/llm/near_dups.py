"""MinHash near-duplicates with sequential Bayesian verification.

Shingle sets are collapsed to distinct ones; their MinHash signatures are cut
into bands.  Banded candidates compare signature batches one after the other
and are dropped as soon as the posterior probability of a similarity above the
threshold falls below the chosen miss probability.  Survivors are confirmed on
their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components

from . import arrowtext as at
from .stable import numbered, settled, stored

#: 32 bands of 5 rows miss a pair of similarity 0.8 with a chance of 3 in a million.
BANDS, BAND_ROWS = 32, 5
HASHES = BANDS * BAND_ROWS
#: Signature values compared between two looks at the posterior.
BATCH = 32
MISS = 1e-6
#: Hubs, one per bucket and turn, of which every member is compared with the likeliest.
TURNS = 2
#: Buckets with more members than this outside their largest component are compared as blocks of signatures and sets,
#: not as rows of pairs ...
CROWD = 32
#: ... packed into rows of about so many bytes, of which a task holds ``HELD`` while others stream past.
UNIT, HELD = 4 << 20, 16
#: Up to this many ids of candidates, of eight bytes each, go to every task that reads texts.
BROADCAST_IDS = 1_000_000
BITS = ("bits0", "bits1", "bits2")

_RNG = np.random.default_rng(812)
_MUL = (_RNG.integers(0, 1 << 32, HASHES, np.uint64) | 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def _shingles(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each row, and n + 1 row offsets."""
    data, offsets = at.flat(text)
    data = at.lower_ascii(data)
    found = at.words(data, offsets)
    value = at.word_hashes(data, found)
    docs = len(offsets) - 1
    counts = found.counts
    n = len(value)
    gram = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            gram[: n - j] = gram[: n - j] * np.uint64(0x9E3779B97F4A7C15) + at.mix(value[j:] + np.uint64(j))
        gram = at.mix(gram)
    position = np.arange(n) - found.first[found.doc] if n else np.zeros(0, np.int64)
    use = position + size <= counts[found.doc] if n else np.zeros(0, bool)
    hashes, doc = gram[use], found.doc[use]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size - 1):
                more = counts[short] > j
                whole[more] = at.mix(whole[more] * np.uint64(0x9E3779B97F4A7C15) + value[found.first[short[more]] + j] + np.uint64(0x5401))
        hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(hashes):
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]
        hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(docs + 1))


def _signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, HASHES) of uint32 minima; rows must not be empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            x = low * _MUL[k]
            x += _ADD[k]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[:, k] = np.minimum.reduceat(x, offsets[:-1])
    return out


def _blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    body = np.ascontiguousarray(values).view(np.uint8).reshape(-1)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim == 2 else 1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(body)])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Set fingerprint, band keys and compact signature of every row; an empty set has none of the latter two.

    Band keys use whole hash values.  The signature keeps their low bytes, and
    ``bits`` the bit above as three longs, for a quick look inside joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text"):
            hashes, offsets = _shingles(at.column(part, "text"), size)
            counts = np.diff(offsets)
            some = np.flatnonzero(counts)
            a, b = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
            values = np.zeros((0, HASHES), np.uint32)
            if len(some):
                tight = np.r_[offsets[some], offsets[-1]]
                a[some] = np.add.reduceat(at.mix(hashes ^ np.uint64(0xA)), tight[:-1])
                b[some] = np.bitwise_xor.reduceat(at.mix(hashes ^ np.uint64(0xB)), tight[:-1])
                values = _signatures(hashes, tight)
            ends = np.r_[0, np.cumsum(counts > 0)]
            bands = np.zeros((len(values), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(BAND_ROWS):
                    bands = at.mix(bands + np.arange(BANDS, dtype=np.uint64)) ^ values[:, k::BAND_ROWS][:, :BANDS].astype(np.uint64)
                bands = at.mix(bands)
            flags = np.zeros((len(counts), 192), np.uint8)
            flags[some, :HASHES] = (values >> np.uint32(8)) & 1
            words = np.packbits(flags, axis=1).view(np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("ord")),
                    pa.array(counts, pa.int64()),
                    pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array((ends * BANDS).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64))),
                    _blobs(values.astype(np.uint8), ends).cast(pa.binary()),
                    *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(3)),
                ],
                ["ord", "n_shingles", "set_a", "set_b", "bands", "signature", *BITS],
            )

    return docs.select("ord", "text").mapInArrow(run, "ord long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary, bits0 long, bits1 long, bits2 long")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(ord, shingles): the sorted distinct 64-bit shingle hashes of each row as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text"):
            hashes, offsets = _shingles(at.column(part, "text"), size)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("ord")), _blobs(hashes, offsets).cast(pa.binary())], ["ord", "shingles"])

    return docs.select("ord", "text").mapInArrow(run, "ord long, shingles binary")


@lru_cache(maxsize=16)
def least_matches(percent: int, miss: float, batch: int = BATCH) -> tuple[int, ...]:
    """Fewest matches after each batch at which P(similarity >= percent) still exceeds ``miss``.

    The prior over similarity is uniform; the posterior after m matches in n
    values is taken on a grid.
    """
    grid = (np.arange(200_000) + 0.5) / 200_000
    upper = grid >= percent / 100
    match = grid + (1 - grid) / 256  # equal low bytes of different values included
    out = []
    for n in range(batch, HASHES + 1, batch):
        for m in range(n + 1):
            log = m * np.log(match) + (n - m) * np.log1p(-match)
            p = np.exp(log - log.max())
            if p[upper].sum() / p.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


@lru_cache(maxsize=16)
def most_flips(percent: int, miss: float) -> int:
    """Most differing bits that a pair of the given similarity has but for a chance of ``miss``."""
    p, chance, tail = (1 - percent / 100) / 2, (1 - (1 - percent / 100) / 2) ** HASHES, 0.0
    for n in range(HASHES + 1):
        tail += chance
        if 1 - tail < miss:
            return n
        chance *= (HASHES - n) / (n + 1) * p / (1 - p)
    return HASHES


def flips(other: str) -> Column:
    """Differing bits of the columns ``bits*`` and those with the suffix ``other``."""
    parts = [F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}{other}"))) for b in BITS]
    return parts[0] + parts[1] + parts[2]


def _agreeing(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, bounds: tuple[int, ...]) -> np.ndarray:
    """Places of the pairs of rows (i, j) of two signature matrices that no batch rules out."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, least in enumerate(bounds):
        span = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[i[alive], span] == right[j[alive], span]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive


def bayes_prune(pairs: DataFrame, sketch: DataFrame, percent: int, miss: float) -> DataFrame:
    """The (a, b) of ``pairs`` that no batch rules out."""
    bounds = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows == 0:
                continue
            left, right = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, HASHES) for i in (2, 3))
            rows = np.arange(part.num_rows)
            keep = pa.array(_agreeing(left, right, rows, rows, bounds))
            yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    one = sketch.select(F.col("ord").alias("a"), F.col("signature").alias("left"))
    two = sketch.select(F.col("ord").alias("b"), F.col("signature").alias("right"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets satisfy 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            good = []
            for i, (x, y) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(left), len(right)) * 100 < percent * max(len(left), len(right)):
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    good.append(i)
            keep = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    one = sets.select(F.col("ord").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("ord").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _tagged(members: DataFrame, label: DataFrame) -> DataFrame:
    return members.join(label, members["ord"] == label["node"], "left").select(*members.columns, F.coalesce("component", "ord").alias("component"))


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Add ``common``, the number of shingles that some other candidate has too, and drop rows that it leaves unlinkable.

    A row shares at most its common shingles with any other, and a union is no
    smaller than the row, so too many shingles of its own rule every link out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column(0).to_numpy(zero_copy_only=False)
            got = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
            for at_ in range(0, len(got), 200):
                some = got[at_ : at_ + 200]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some)), pa.array(np.repeat(ids[at_ : at_ + 200], [len(x) for x in some]))], ["shingle", "ord"])

    listed = sets.select("ord", "shingles").mapInArrow(run, "shingle long, ord long")
    own = listed.groupBy("shingle").agg(F.min("ord").alias("own_ord"), F.count("*").alias("n")).filter("n = 1").groupBy("own_ord").agg(F.count("*").alias("own"))
    counted = members.join(own, members["ord"] == own["own_ord"], "left").withColumn("common", F.col("n_shingles") - F.coalesce("own", F.lit(0))).drop("own_ord", "own")
    return counted.filter(100 * F.col("common") >= percent * F.col("n_shingles"))


def _alike(percent: int, miss: float) -> Column:
    """Sizes and common shingles that allow the similarity, and no more differing bits than it has but for the miss probability."""
    sizes = 100 * F.least("n_shingles", "n_shingles_b") >= percent * F.greatest("n_shingles", "n_shingles_b")
    shared = F.least("common", "common_b")
    room = 100 * shared >= percent * (F.col("n_shingles") + F.col("n_shingles_b") - shared)
    return sizes & room & (flips("_b") <= most_flips(percent, miss))


def _likeliest_hubs(members: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b): each member with the likeliest of its buckets' hubs, once for every turn.

    The hub of a bucket is its member with the smallest hash, another one each turn.
    """

    def hub(turn: int) -> Column:
        return F.min(F.struct(F.xxhash64(F.lit(turn), "ord").alias("h"), F.col("ord").alias("ord_b"), F.col("n_shingles").alias("n_shingles_b"), F.col("common").alias("common_b"), *[F.col(b).alias(f"{b}_b") for b in BITS])).alias("hub")

    picks = []
    for turn in range(TURNS):
        hubs = members.groupBy("band").agg(hub(turn)).select("band", "hub.*")
        met = members.join(hubs, "band").filter((F.col("ord") != F.col("ord_b")) & _alike(percent, miss))
        best = met.groupBy("ord").agg(F.min(F.struct(flips("_b").alias("flips"), F.col("ord_b"))).alias("m"))
        picks.append(best.select(F.col("ord").alias("a"), F.col("m.ord_b").alias("b")))
    pairs = picks[0]
    for more in picks[1:]:
        pairs = pairs.unionByName(more)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set: products of incidence matrices, ``width`` shared shingles at a time."""
    both = np.intersect1d(*(np.unique(np.concatenate(side)) for side in (left, right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(both), width):
        some = both[low : low + width]
        grids = []
        for side in (left, right):
            grid = np.zeros((len(side), len(some)), np.float32)
            for row, held in enumerate(side):
                held = held[np.searchsorted(held, some[0]) : np.searchsorted(held, some[-1], "right")]
                at_ = np.searchsorted(some, held)
                grid[row, at_[some[at_] == held]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


@dataclass
class _Unit:
    """Members of one bucket that travel as one row."""

    ord: np.ndarray
    n: np.ndarray
    common: np.ndarray
    component: np.ndarray
    signature: np.ndarray
    ends: np.ndarray
    shingles: np.ndarray

    def sets(self, rows: np.ndarray) -> list[np.ndarray]:
        return [self.shingles[self.ends[k] : self.ends[k + 1]] for k in rows.tolist()]


_LONGS = ("ord", "n", "common", "component", "ends")
_UNIT = ("ord", "n", "common", "component", "ends", "signature", "shingles")


def _packed(rows: pa.Table) -> pa.Table:
    """One row of the members of a unit, each column's values in one binary."""
    rows = rows.combine_chunks()
    sets = rows.column("shingles").to_pylist()
    longs = [*(rows.column(c).to_numpy() for c in ("ord", "n_shingles", "common", "component")), np.r_[0, np.cumsum([len(x) // 8 for x in sets])]]
    values = [*(np.ascontiguousarray(x, np.int64).tobytes() for x in longs), b"".join(rows.column("signature").to_pylist()), b"".join(sets)]
    keys = [rows.column(c).slice(0, 1) for c in ("band", "unit", "outers")]
    return pa.table([*keys, *(pa.array([v], pa.binary()) for v in values)], names=["band", "unit", "outers", *_UNIT])


def _unpacked(row: dict) -> _Unit:
    longs = {c: np.frombuffer(row[c], np.int64) for c in _LONGS}
    return _Unit(signature=np.frombuffer(row["signature"], np.uint8).reshape(-1, HASHES), shingles=np.frombuffer(row["shingles"], np.uint64), **longs)


def _unit_links(left: _Unit, right: _Unit, percent: int, bounds: tuple[int, ...], root: dict[int, int]) -> list[tuple[int, int]]:
    """Confirmed links between components of two units, as few as join them: batches first, then the full sets.

    ``root`` holds what earlier links have joined.
    """
    least, most = np.minimum(left.n[:, None], right.n), np.maximum(left.n[:, None], right.n)
    shared = np.minimum(left.common[:, None], right.common)
    able = (left.component[:, None] != right.component) & (100 * least >= percent * most) & (100 * shared >= percent * (least + most - shared))
    i, j = np.nonzero(np.triu(able, 1) if left is right else able)
    alive = np.concatenate([k + _agreeing(left.signature, right.signature, i[k : k + 65536], j[k : k + 65536], bounds) for k in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
    i, j = i[alive], j[alive]
    if len(i) == 0:
        return []
    (used_a, at_a), (used_b, at_b) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    both = _common_counts(left.sets(used_a), right.sets(used_b))[at_a, at_b]
    good = 100 * both >= percent * (left.n[i] + right.n[j] - both)
    x, y = i[good], j[good]
    _, first = np.unique(np.stack([left.component[x], right.component[y]]), axis=1, return_index=True)

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    pairs = []
    for p, q in zip(x[first].tolist(), y[first].tolist(), strict=True):
        s, t = find(int(left.component[p])), find(int(right.component[q]))
        if s != t:
            root[max(s, t)] = min(s, t)
            pairs.append((max(int(left.ord[p]), int(right.ord[q])), min(int(left.ord[p]), int(right.ord[q]))))
    return pairs


def _block_pairs(crowd: DataFrame, reps: DataFrame, full: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b): links that join the components which meet in crowded buckets.

    A bucket's members outside its largest component are dealt into units of about
    ``UNIT`` bytes by hash, and so are those inside; a unit is packed into one row
    and stored once.  ``HELD`` units of the outer members make a block, which one
    task holds; all later units of the bucket stream past it, as no pair inside the largest
    component matters.  So a member is moved once alone, and packed once for
    every block that it meets.  Pairs that are no links never become rows.
    """
    sided = crowd.withColumn("outer", F.col("component") != F.col("largest")).drop("largest")
    weight = HASHES + 40 + 8 * F.col("n_shingles")
    dealt = sided.groupBy("band").agg(*[F.greatest(F.lit(1), F.ceil(F.sum(F.when(side, weight)) / UNIT)).cast("int").alias(c) for c, side in (("outers", F.col("outer")), ("inners", ~F.col("outer")))])
    at_ = F.xxhash64(F.lit("unit"), "ord")
    unit = F.when(F.col("outer"), F.pmod(at_, F.col("outers"))).otherwise(F.col("outers") + F.pmod(at_, F.col("inners"))).cast("int")
    rows = sided.join(dealt, "band").withColumn("unit", unit).drop("inners", "outer")
    rows = rows.join(reps.select("ord", "signature"), "ord").join(full, "ord")
    fields = ", ".join(f"{c} binary" for c in _UNIT)
    units = stored(rows.groupBy("band", "unit").applyInArrow(_packed, f"band long, unit int, outers int, {fields}"))
    last = F.floor((F.col("outers") - 1) / HELD)
    fed = units.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.floor(F.col("unit") / HELD), last))))
    bounds = least_matches(percent, miss)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, root = None, [], {}
        for part in batches:
            for k in range(part.num_rows):
                row = part.slice(k, 1).to_pylist()[0]
                if (row["band"], row["block"]) != now:
                    now, held, root = (row["band"], row["block"]), [], {}
                new = _unpacked(row)
                if row["unit"] < min(row["outers"], HELD * (row["block"] + 1)):
                    held.append(new)
                pairs = [p for old in held for p in _unit_links(old, new, percent, bounds, root)]
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in (0, 1)], ["a", "b"])

    keys = ["band", "block"]
    return fed.repartition(*keys).sortWithinPartitions(*keys, "unit").mapInArrow(stream, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are lower-cased (A-Z) runs without white space; a text of fewer than
    ``size`` words is one shingle; an empty or null text has the empty set and is
    linked with nothing.  ``component_id`` is the smallest doc_id of the
    component, of any type.  Rows with equal or null ids are rows of their own, ordered by id
    (null first) and a hash of the text; exactly one row of a component is kept.
    An empty table gives an empty result; other columns are ignored.

    Every member is first compared with the likeliest hub of its buckets, once for
    each of ``TURNS`` choices of hubs, and the components of the links are found.  Then the pairs of a bucket that are
    still in different components and look alike are compared, so no link between
    banded candidates is lost, and a large group of near copies mostly costs a
    comparison per member and turn.  Buckets of more than ``CROWD`` members outside
    their largest component are
    compared as blocks of signatures and sets inside tasks: work grows with those
    members times all of the bucket, and bytes moved with the bucket times the blocks
    of ``HELD`` units that those members fill.
    Buckets of the same members count once.  Rows with too many shingles of their
    own take no part.
    """
    rows = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return _with_ids(_linked(rows, size, percent, miss), rows)


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """The rows of ``docs`` but for those that ``near_duplicates`` does not keep, with all their columns, whatever these are called.

    Rows without words are linked with nothing and stay; an empty table stays empty.
    """
    rows = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    linked = _linked(rows.select("ord", "text"), size, percent, miss)
    return rows.join(linked.filter("ord != component").select("ord"), "ord", "left_anti").select("row.*")


def _linked(rows: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """(ord, n_shingles, component) of every row of (ord, text)."""
    base = stored(sketches(rows, size))
    some = base.filter("n_shingles > 0")
    sets = some.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("ord", "bands", "signature", *BITS)).alias("m"), F.count("*").alias("copies"))
    reps = stored(sets.select("set_a", "set_b", "n_shingles", "m.*", "copies"))

    # few columns travel with all bands; the others join those rows that share one
    banded = reps.select("ord", F.explode("bands").alias("band"))
    shared = settled(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"))
    met = stored(banded.join(shared, "band"))
    who = [F.bit_xor(F.xxhash64(F.lit(k), "ord")).alias(f"who{k}") for k in (1, 2)]
    once = met.groupBy("band").agg(F.count("*").alias("n"), *who).groupBy("n", "who1", "who2").agg(F.min("band").alias("band")).select("band")
    members = stored(met.join(once, "band").join(reps.select("ord", "n_shingles", *BITS), "ord"))
    ids = members.select("ord").distinct()
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    full = stored(shingle_sets(rows.join(wanted, "ord", "left_semi"), size))

    members = stored(_linkable(members, full, percent))
    links = settled(confirm(bayes_prune(_likeliest_hubs(members, percent, miss), reps, percent, miss), full, percent))
    label = components(links)

    # what is left: pairs of one bucket in different components
    tagged = _tagged(members, label)
    held = tagged.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = held.groupBy("band").agg((F.sum("n") - F.max("n")).alias("outers"), F.max_by("component", F.struct("n", "component")).alias("largest")).filter("outers > 0")
    apart = stored(tagged.join(mixed.select("band", (F.col("outers") > CROWD).alias("crowd"), "largest"), "band"))
    joined = _block_pairs(apart.filter("crowd").select("band", "ord", "n_shingles", "common", "component", "largest"), reps, full, percent, miss)
    apart = apart.filter("NOT crowd").drop("crowd", "largest")
    other = apart.select("band", *[F.col(c).alias(f"{c}_b") for c in ("ord", "n_shingles", "common", "component", *BITS)])
    rest = apart.join(other, "band").filter((F.col("ord") > F.col("ord_b")) & (F.col("component") != F.col("component_b")) & _alike(percent, miss))
    rest = stored(rest.select(F.col("ord").alias("a"), F.col("ord_b").alias("b")).distinct())
    last = settled(confirm(bayes_prune(rest, reps, percent, miss), full, percent).unionByName(joined))
    final = components(links.unionByName(last))

    named = reps.join(final, reps["ord"] == final["node"], "left").withColumn("component", F.coalesce("component", "ord"))
    # a set of one row that is its own component needs no lookup
    named = settled(named.filter("copies > 1 OR component != ord").select("set_a", "set_b", "n_shingles", "component"))
    told = base.select("ord", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b", "n_shingles"], "left")
    return told.select("ord", "n_shingles", F.coalesce("component", "ord").alias("component"))


def _with_ids(out: DataFrame, rows: DataFrame) -> DataFrame:
    ids = rows.select(F.col("ord").alias("o"), "doc_id")
    if ids.filter(F.col("doc_id").isNull() | (F.col("doc_id").cast("string") != F.col("o").cast("string"))).limit(1).count() == 0:
        return out.select(F.col("ord").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("ord") == F.col("component")).alias("kept"))
    first = ids.select(F.col("o").alias("c"), F.col("doc_id").alias("component_id"))
    out = out.join(ids, out["ord"] == ids["o"]).join(first, F.col("component") == F.col("c"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("ord") == F.col("component")).alias("kept"))
