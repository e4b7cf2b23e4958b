"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs are digested and hashed into a few cells of counts and XOR
sums.  Subtracting two fingerprints cancels what they share; peeling cells that hold
one digest recovers the differing digests.  Where that gets stuck, strata of
small sketches over thinner and thinner samples of the digests estimate how many
differ, and both texts are sketched again with cells for these, and with four
times as many whenever peeling gets stuck again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .stable import numbered, settled

#: Cells of a fingerprint, in equal parts for each of the hash functions.
CELLS, HASHES = 12, 3
#: Strata of the estimate of a difference; the first one samples the digests whose hash ends in so many zero bits, each later one half as many.
STRATA, FIRST_ZEROS = 16, 2
#: Cells for each digest that is expected to differ.
ROOM = 2.0
#: Rows per bucket of the ordered pass, cuts at quantiles of the ids, and buckets that one task reads.
BUCKET_ROWS, COARSE, TASK_BUCKETS = 256, 512, 64
#: First rows of buckets are broadcast up to this many.
BROADCAST_BUCKETS = 200_000
#: A paragraph also ends after a word whose hash is a multiple of this, so that one long line still has parts.
CUT = 8
#: Words after which a paragraph is cut whatever they are.
LONGEST = 16

_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        have = 1
        step = np.uint64(base)
        with np.errstate(over="ignore"):
            while have < n:  # doubling: the next `have` powers are the first ones times base ** have
                more = min(have, n - have)
                out[have : have + more] = out[:more] * step
                step = step * step
                have += more
    return out


def paragraphs(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and digest of every distinct paragraph of every row, sorted.

    A paragraph ends at a line end, after a word that ends in ``. ! ?`` and after
    a word chosen by its hash.  Digests depend on the words only.
    """
    data, offsets = at.flat(text)
    found = at.words(data, offsets)
    n = len(found.start)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = at.word_hashes(data, found)
    stop = np.zeros(256, bool)
    stop[list(b".!?")] = True
    lines = np.r_[0, np.cumsum(data == 10)]
    ends = stop[data[found.end - 1]] | (value % np.uint64(CUT) == 0)
    ends[:-1] |= (lines[found.start[1:]] > lines[found.end[:-1]]) | (found.doc[1:] != found.doc[:-1])
    ends[-1] = True
    last = np.flatnonzero(ends)
    first = np.r_[0, last[:-1] + 1]
    inside = np.arange(n) - np.repeat(first, last - first + 1)
    ends |= inside % LONGEST == LONGEST - 1
    last = np.flatnonzero(ends)
    first = np.r_[0, last[:-1] + 1]
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(at.mix(value) * _powers(_MULT, n), dtype=np.uint64)]
        digest = at.mix((total[last + 1] - total[first]) * _powers(_INVERSE, n)[first] + (last - first).astype(np.uint64))
    row = found.doc[first]
    order = np.lexsort((digest, row))
    row, digest = row[order], digest[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])]
    return row[new], digest[new]


def _cells(digest: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """(HASHES, n) cell numbers, one in each part."""
    part = cells // HASHES
    return np.stack([(at.mix(digest ^ np.uint64(0xA5A5 * (j + 1) + (seed << 20))) % np.uint64(part)).astype(np.int64) + j * part for j in range(HASHES)])


def _check(digest: np.ndarray) -> np.ndarray:
    return (at.mix(digest ^ np.uint64(0xC4EC)) >> np.uint64(32)).astype(np.uint32)


def sketch(row: np.ndarray, digest: np.ndarray, rows: int, cells: int, seed: int = 0, sign: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest XORs and check XORs, each (rows * cells,)."""
    count, keys, checks = np.zeros(rows * cells, np.int32), np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint32)
    check = _check(digest)
    for at_ in _cells(digest, cells, seed):
        where = row * cells + at_
        np.add.at(count, where, np.int32(sign) if np.isscalar(sign) else sign.astype(np.int32))
        np.bitwise_xor.at(keys, where, digest)
        np.bitwise_xor.at(checks, where, check)
    return count, keys, checks


def peel(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, rows: int, cells: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests recovered on either side of every subtracted sketch, and whether it emptied.  Changes its arguments."""
    plus, minus = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    look = np.flatnonzero(np.abs(count) == 1)
    while True:
        # only cells that changed can have become pure
        look = look[np.abs(count[look]) == 1]
        pure = look[_check(keys[look]) == checks[look]]
        if len(pure) == 0:
            break
        row, key, sign = pure // cells, keys[pure], count[pure].astype(np.int64)
        # a digest alone in several cells is taken once
        order = np.lexsort((key, row))
        row, key, sign = row[order], key[order], sign[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]
        row, key, sign = row[new], key[new], sign[new]
        np.add.at(plus, row[sign > 0], 1)
        np.add.at(minus, row[sign < 0], 1)
        check = _check(key)
        touched = []
        for at_ in _cells(key, cells, seed):
            where = row * cells + at_
            np.subtract.at(count, where, sign.astype(np.int32))
            np.bitwise_xor.at(keys, where, key)
            np.bitwise_xor.at(checks, where, check)
            touched.append(where)
        look = np.unique(np.concatenate(touched))
    full = ((count != 0) | (keys != 0) | (checks != 0)).reshape(rows, cells).any(1)
    return plus, minus, ~full


def _narrow(row: np.ndarray, digest: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.full(int(wanted.max(initial=0)) + 1 if len(wanted) else 1, -1)
    place[wanted] = np.arange(len(wanted))
    ok = row < len(place)
    use = np.flatnonzero(ok)
    use = use[place[row[use]] >= 0]
    return place[row[use]], digest[use]


def _subtracted(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return left[0] - right[0], left[1] ^ right[1], left[2] ^ right[2]


def estimated(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """Digests that differ in every row, by strata: those from the thinnest sample down to the last that peels tell how many there are."""
    tables = []
    for row, digest in (left, right):
        h = at.mix(digest ^ np.uint64(0x57A7A))
        lowest = (h & (~h + np.uint64(1))).astype(np.float64)
        zeros = np.where(h == 0, 64, np.log2(np.maximum(lowest, 1))).astype(np.int64) - FIRST_ZEROS
        use = zeros >= 0
        tables.append(sketch(row[use] * STRATA + np.minimum(zeros[use], STRATA - 1), digest[use], rows * STRATA, CELLS, 1))
    plus, minus, done = (x.reshape(rows, STRATA)[:, ::-1] for x in peel(*_subtracted(*tables), rows * STRATA, CELLS, 1))
    peeled = np.cumprod(done, axis=1)  # from the thinnest on
    found, depth = ((plus + minus) * peeled).sum(1), peeled.sum(1)
    most = np.bincount(left[0], minlength=rows) + np.bincount(right[0], minlength=rows)
    guess = np.maximum(found, 1) * 2.0 ** (FIRST_ZEROS + STRATA - depth)
    return np.where(depth > 0, np.minimum(guess, most), most)


def likeness(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int, bases: tuple | None = None) -> np.ndarray:
    """Shared share of all distinct paragraphs, from the digests that peeling recovers; 1 where both have none.

    The fingerprints are subtracted first (``bases``, made here where they are not given); what
    they do not settle gets cells by ``estimated``, and four times as many
    whenever peeling gets stuck.
    """
    n_left, n_right = np.bincount(left[0], minlength=rows), np.bincount(right[0], minlength=rows)
    one, two = bases or (sketch(*left, rows, CELLS), sketch(*right, rows, CELLS))
    plus, minus, done = peel(*_subtracted(one, two), rows, CELLS)
    only = np.where(done, np.stack([plus, minus]), 0)
    steps = np.full(rows, -1)
    stuck = np.flatnonzero(~done)
    if len(stuck):
        differing = estimated(_narrow(*left, stuck), _narrow(*right, stuck), len(stuck))
        steps[stuck] = np.maximum(1, np.ceil(np.log(np.maximum(ROOM * differing / CELLS, 1)) / np.log(4)))
    while len(todo := np.flatnonzero(steps >= 0)):
        step = int(steps[todo].min())
        cells = CELLS * 4**step
        # few rows at a time where sketches are large
        todo = todo[steps[todo] == step][: max(1, 4_000_000 // cells)]
        (r1, d1), (r2, d2) = _narrow(*left, todo), _narrow(*right, todo)
        sign = np.r_[np.ones(len(r1), np.int64), -np.ones(len(r2), np.int64)]
        count, keys, checks = sketch(np.r_[r1, r2], np.r_[d1, d2], len(todo), cells, step, sign)
        plus, minus, done = peel(count, keys, checks, len(todo), cells, step)
        only[0, todo[done]], only[1, todo[done]] = plus[done], minus[done]
        steps[todo] = np.where(done, -1, step + 1)
    shared = n_left - only[0]
    either = n_left + only[1]
    return np.where(either == 0, 1.0, shared / np.maximum(either, 1))


def fingerprints(base: tuple, row: np.ndarray, rows: int) -> list[str]:
    """The base sketch of every row as text: number of digests, then counts, digest XORs and check XORs."""
    count, keys, checks = (x.reshape(rows, CELLS) for x in base)
    n = np.bincount(row, minlength=rows).astype(np.int32).reshape(rows, 1)
    body = np.concatenate([n.view(np.uint8), count.astype(np.int32).view(np.uint8), keys.view(np.uint8), checks.view(np.uint8)], axis=1)
    return [base64.b64encode(x.tobytes()).decode() for x in body]


def _compared(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    rows = len(texts)
    edited = []
    for text, after in zip(texts, following, strict=True):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    own, new, then = (paragraphs(pa.array(x, pa.large_string())) for x in (texts, edited, following))
    bases = [sketch(*x, rows, CELLS) for x in (own, new, then)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(map(len, texts), pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array(fingerprints(bases[0], own[0], rows), pa.string()),
            pa.array(fingerprints(bases[1], new[0], rows), pa.string()),
            pa.array(likeness(own, new, rows, (bases[0], bases[1]))),
            pa.array(likeness(own, then, rows, (bases[0], bases[2]))),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, each with the row after it; a bucket ends with the first row of the next one, as a guest."""
    held = None
    for part in at.slices(batches, "text"):
        bucket, guest, ids = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("bucket", "guest", "doc_id"))
        texts = at.column(part, "text").to_pylist()
        rows = list(zip(bucket, guest, ids, texts, strict=True))
        if held is not None:
            rows.insert(0, held)
        held = rows[-1]
        pairs = [(x[2], x[3], y[3]) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
        if pairs:
            yield _compared(*map(list, zip(*pairs, strict=True)))


def _bucketed(rows: DataFrame) -> DataFrame:
    """Add ``coarse`` and ``fine``: cuts of the order (place, tie) into buckets of about ``BUCKET_ROWS`` rows.

    Up to ``COARSE`` quantiles of the ids cut first, and an id that holds several
    of them gets a bucket of its own.  A bucket is then cut into equal ranges, of
    ids or, in that of a single id, of ties; their number follows its count.
    """
    count = rows.count()
    wanted = min(COARSE, -(-count // BUCKET_ROWS))
    cuts: list[int] = []
    if wanted > 1:
        found = [int(c) for c in rows.approxQuantile("place", [i / wanted for i in range(1, wanted)], 0.25 / wanted)]
        again = {c for c, after in zip(found, found[1:], strict=False) if c == after}
        cuts = sorted({*found, *(c + 1 for c in again if c < (1 << 63) - 1)})
    places = F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<bigint>")
    rows = rows.withColumn("coarse", F.size(F.filter(places, lambda c: c <= F.col("place"))))
    # at most two buckets for each cut
    spans = rows.groupBy("coarse").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.ceil(F.count("*") / BUCKET_ROWS).alias("parts")).collect()
    if not spans or max(r.parts for r in spans) == 1:
        return rows.withColumn("fine", F.lit(0).cast("long"))
    table = F.array(*[F.struct(F.lit(r.low).cast("double").alias("low"), F.lit(r.high).cast("double").alias("high"), F.lit(r.parts).cast("long").alias("parts")) for r in sorted(spans)])
    known = F.array(*[F.lit(r.coarse) for r in sorted(spans)])
    span = F.element_at(table, F.array_position(known, F.col("coarse")).cast("int"))
    share = F.when(span["high"] > span["low"], (F.col("place").cast("double") - span["low"]) / (span["high"] - span["low"])).otherwise(F.col("tie").cast("double") / 2.0**64 + 0.5)
    return rows.withColumn("fine", F.least(F.floor(share * span["parts"]), span["parts"] - 1))


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text ends, in place of its last half, with the beginning of the
    next document in descending doc_id (after the last: the first).  Null ids
    come last, equal ids in the order of a hash of the text; every row stands for
    itself and a table of one row follows itself.  Null texts are empty.  Ids that are
    no integers are numbered in their order first.  An empty table gives an empty
    result; other columns are ignored.

    Ids are cut into buckets whose number grows with the rows; every bucket is
    read in order by one task, ended by the first row of the bucket that follows.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        known = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")), name="__place")
        told = compare_versions(known.select(F.col("__place").alias("doc_id"), "text")).withColumnRenamed("doc_id", "__place")
        return told.join(known.select("__place", "doc_id"), "__place").select("doc_id", *told.columns[1:])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # ~x turns ascending into descending without overflow; null ids become the largest
    order = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).alias("place")
    rows = _bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), order, F.xxhash64(text).alias("tie"), text.alias("text")))
    bucket = ["coarse", "fine"]
    firsts = settled(rows.groupBy(*bucket).agg(F.min(F.struct("place", "tie")).alias("first")))
    # the bucket before: inside the coarse one, or the last of the coarse one before, or of all
    edges = firsts.groupBy("coarse").agg(F.max("fine").alias("last")).orderBy("coarse").collect()
    ends = {r.coarse: (edges[i - 1].coarse, edges[i - 1].last) for i, r in enumerate(edges)}
    if not ends:
        return rows.select("doc_id", "text").mapInArrow(_pairs, _RESULT)
    lead = F.element_at(F.array(*[F.struct(F.lit(c).alias("coarse"), F.lit(f).cast("long").alias("fine")) for c, f in (ends[r.coarse] for r in edges)]), F.array_position(F.array(*[F.lit(r.coarse) for r in edges]), F.col("coarse")).cast("int"))
    before = F.lag("fine").over(Window.partitionBy("coarse").orderBy("fine"))
    sent = firsts.select("first.*", F.coalesce(F.when(before.isNotNull(), F.struct("coarse", before.alias("fine"))), lead).alias("to"))
    few = sent.count() <= BROADCAST_BUCKETS
    heads = rows.select("doc_id", "place", "tie", "text").join(F.broadcast(sent) if few else sent, ["place", "tie"])
    # rows that agree in id and text are alike: one of them will do
    guests = heads.groupBy("place", "tie", "to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("to.*", F.lit(True).alias("guest"), "doc_id", "place", "tie", "text")
    both = rows.select(*bucket, F.lit(False).alias("guest"), "doc_id", "place", "tie", "text").unionByName(guests)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sent.count() // TASK_BUCKETS))
    placed = both.repartition(n, *bucket).sortWithinPartitions(*bucket, "guest", "place", "tie").select(F.struct(*bucket).alias("bucket"), "guest", "doc_id", "text")
    return placed.mapInArrow(_pairs, _RESULT)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
