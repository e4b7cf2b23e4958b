"""Repeated byte strings by bucket-pointer refinement.

Every byte position belongs to the bucket of its q-gram.  Buckets are refined by
the bucket identifiers of later offsets: the identifier at depth 2d is made of
those at depth d, here and d bytes on, until depth 100 is reached.  Identifiers
are 64-bit hashes of the bytes they stand for, so that all tasks agree on them.
Single windows are compared in two independent ones; whole runs of windows in that of their anchor and
one of all bytes that they cover.

Only few positions travel.  In each window of 100 bytes one 32-gram, chosen by
its bucket identifier alone, is the anchor; windows can only be equal if their
anchors are.  Anchors, with a bucket identifier of all the bytes their windows
cover, are shuffled first; whole runs of windows are settled there.  Where one
anchor bucket holds different surroundings, its windows are compared in blocks
of eight, keyed by the bytes that all eight share, and only where those are
mixed again one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .stable import numbered, stored

LENGTH = 100
GRAM = 32
SLICE_BYTES = 2 << 20
#: Rows of 32 bytes that one task of the settling rounds should hold, about.
TASK_ROWS = 2_000_000

#: Positions take 30 bits: texts of so many bytes are an error.
LARGEST = 1 << 30
#: Windows in a block of the second round.
BLOCK = 8
#: Row kinds: a run of repeated windows; windows that must be compared one by one; an anchor to compare; the same, of a bucket known to be mixed.
REPEATED, OPEN, ANCHOR, MIXED = 0, 1, 2, 3

_TABLE = at.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51F))
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def _deepened(first: np.ndarray, later: np.ndarray, step: np.uint64) -> np.ndarray:
    """Bucket identifiers made of those here and at a later offset."""
    x = first * step
    x ^= x >> np.uint64(29)
    x += later
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket identifier at depth 32 of every position that has 32 bytes to come."""
    bucket = _TABLE[data]
    for k, step in enumerate(_STEP):
        offset = 1 << k
        if len(bucket) <= offset:
            return np.zeros(0, np.uint64)
        bucket = _deepened(bucket[:-offset], bucket[offset:], step)
    return bucket


def window_buckets(bucket: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Bucket identifier at depth 100 of the given starts."""
    x = _deepened(bucket[start], bucket[start + GRAM], _STEP[0])
    x = _deepened(x, bucket[start + 2 * GRAM], _STEP[1])
    return _deepened(x, bucket[start + LENGTH - GRAM], _STEP[2])


def window_words(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A second identifier of the 100 bytes at the given starts, from their words of eight bytes; it shares nothing with the buckets."""
    x = np.full(len(start), 0x2545F4914F6CDD1D, np.uint64)
    if len(start):
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)
        with np.errstate(over="ignore"):
            for offset in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
                word = np.ascontiguousarray(eight[start + offset]).view(np.uint64).reshape(-1)
                x = at.mix(x * np.uint64(0x9FB21C651E98DF25) ^ word)
    return x


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` entries."""
    have, out = 1, key
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(data: np.ndarray, offsets: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, first and last window start it serves, and owning row."""
    none = np.zeros(0, np.int64)
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        return none, none, none, none
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    key = ((bucket >> bits) << bits) | np.arange(len(bucket), dtype=np.uint64)
    anchor = (_window_min(key, LENGTH - GRAM + 1)[:windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= LENGTH)
    if len(rows) == 0:
        return none, none, none, none
    change = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    low, high = offsets[rows], offsets[rows + 1] - LENGTH  # first and last window of each row
    starts = np.unique(np.concatenate([change, low, high + 1]))
    starts = starts[starts < windows]
    ends = np.r_[starts[1:] - 1, windows - 1]
    owner = np.searchsorted(low, starts, "right") - 1
    ok = (owner >= 0) & (starts <= high[np.maximum(owner, 0)])
    starts, ends, owner = starts[ok], ends[ok], owner[ok]
    return anchor[starts], starts, ends, rows[owner]


def _surroundings(bucket: np.ndarray, anchor: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bucket identifier of all bytes from the first window's start to the last one's end."""
    stop = end + LENGTH - GRAM
    x = at.mix((anchor - start).astype(np.uint64) << np.uint64(16) | (end - start).astype(np.uint64))
    for k in range((2 * LENGTH) // GRAM):
        x = _deepened(x, bucket[np.minimum(start + k * GRAM, stop)], _STEP[k % 5])
    return _deepened(x, bucket[stop], _STEP[4])


def _packed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A repeated run: first window and number of windows less one in one long."""
    return (first << np.int64(31) | (last - first)) << np.int64(2) | REPEATED


def _anchored(first: np.ndarray, last: np.ndarray, anchor: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """A short run with the distance of its anchor from its first window."""
    return (first << np.int64(31) | (anchor - first) << np.int64(8) | (last - first)) << np.int64(2) | kind


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor (meaningless for repeated runs) and kind."""
    span, kind = packed >> np.int64(2), packed & np.int64(3)
    first, rest = span >> np.int64(31), span & np.int64((1 << 31) - 1)
    return first, first + np.where(kind == REPEATED, rest, rest & np.int64(255)), first + (rest >> np.int64(8)), kind


def _in_order(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.RecordBatch]:
    ids = part.column(part.schema.get_field_index("ord")).to_numpy(zero_copy_only=False)
    order = pa.array(np.argsort(ids, kind="stable"))
    part = part.take(order)
    return ids[order.to_numpy()], at.column(part, "text"), part


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join adjoining runs of one row; sorted by row and start."""
    if len(row) == 0:
        return row, first, last
    lead = np.r_[True, (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)]
    at_ = np.flatnonzero(lead)
    return row[at_], first[at_], last[np.r_[at_[1:], len(row)] - 1]


_SCHEMA = "bucket long, around long, ord long, packed long"
_NAMES = ["bucket", "around", "ord", "packed"]


def _batch(bucket: np.ndarray, around: np.ndarray, ids: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in (bucket, around, ids, packed)], _NAMES)


def _settled_here(bucket, around, row, first, last, anchor, ids) -> Iterator[pa.RecordBatch]:
    """Rows for the shuffle, less what this slice settles; runs come in the order of rows and positions."""
    fresh = at.first_of(_deepened(bucket, around, _STEP[1]))
    again = np.flatnonzero(~fresh)
    r, a, b = _merged(row[again], first[again], last[again])
    yield _batch(at.mix(r.astype(np.uint64)), r * 0, ids[r], _packed(a, b))
    keep = np.flatnonzero(fresh)
    mixed = at.repeated(bucket[keep])
    kind = np.where(~mixed, ANCHOR, np.where(at.first_of(bucket[keep]), MIXED, OPEN))
    # a bucket that this slice knows to be mixed sends one row to its bucket and the others anywhere
    keys = np.where(kind == OPEN, at.mix(bucket[keep] ^ around[keep]), bucket[keep])
    yield _batch(keys, around[keep], ids[row[keep]], _anchored(first[keep], last[keep], anchor[keep], kind))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors and the windows they serve."""
    for part in at.slices(batches, "text", SLICE_BYTES):
        ids, text, _ = _in_order(part)
        data, offsets = at.flat(text)
        bucket = gram_buckets(data)
        anchor, first, last, row = _anchors(data, offsets, bucket)
        if len(anchor) == 0:
            continue
        around = _surroundings(bucket, anchor, first, last)
        base = offsets[row]
        yield from _settled_here(bucket[anchor], around, row, first - base, last - base, anchor - base, ids)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the open runs.  A block is bounded by the distance to the anchor, so equal windows fall into equal blocks."""
    for part in at.slices(batches, "text", SLICE_BYTES):
        ids, text, part = _in_order(part)
        data, offsets = at.flat(text)
        bucket = gram_buckets(data)
        row, packed = _lists(part, "runs")
        first, last, anchor, _ = _unpacked(packed)
        # distances anchor - window, from `far` down to `near`; block k holds those of 8k to 8k + 7
        far, near = (anchor - first) // BLOCK, (anchor - last) // BLOCK
        run, k = _spread(near, far)
        row, first, last, anchor = row[run], np.maximum(first[run], anchor[run] - BLOCK * k - BLOCK + 1), np.minimum(last[run], anchor[run] - BLOCK * k), anchor[run]
        order = np.lexsort((first, row))
        row, first, last, anchor, k = row[order], first[order], last[order], anchor[order], k[order]
        base = offsets[row]
        # the bytes that all windows of a whole block share; a block that its run cuts short covers them too
        core = base + anchor - BLOCK * k
        x = at.mix(k.astype(np.uint64) + np.uint64(0xB10C))
        stop = core + LENGTH - BLOCK + 1 - GRAM
        for j in range(LENGTH // GRAM):
            x = _deepened(x, bucket[np.minimum(core + j * GRAM, stop)], _STEP[j])
        around = _surroundings(bucket, base + anchor, base + first, base + last)
        yield from _settled_here(x, around, row, first, last, anchor, ids)


def _gathered(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))] for b in batches if b.num_rows]
    if not parts:
        return [np.zeros(0, np.int64) for _ in names]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(names))]


def _settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In one partition of buckets: later equal surroundings are repeated, first ones of mixed buckets stay open."""
    bucket, around, ids, packed = _gathered(batches, _NAMES)
    first, last, _, kind = _unpacked(packed)
    out = [(ids[kind <= OPEN], packed[kind <= OPEN])]
    pick = np.flatnonzero(kind >= ANCHOR)
    order = pick[np.lexsort((first[pick], ids[pick], around[pick], bucket[pick]))]
    if len(order):
        g, c, known = bucket[order], around[order], kind[order] == MIXED
        new_g = np.r_[True, g[1:] != g[:-1]]
        new_c = new_g | np.r_[True, c[1:] != c[:-1]]
        group = np.cumsum(new_g) - 1
        mixed = (np.bincount(group, new_c) > 1) | (np.bincount(group, known) > 0)
        later = order[~new_c]
        out.append((ids[later], _packed(first[later], last[later])))
        still = order[new_c & mixed[group]]
        out.append((ids[still], packed[still] >> np.int64(2) << np.int64(2) | OPEN))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], ["ord", "packed"])


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the run and start of every window of the runs."""
    size = last - first + 1
    run = np.repeat(np.arange(len(first)), size)
    return run, first[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)


def _lists(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Owning row and values of a list column."""
    col = part.column(part.schema.get_field_index(name)).fill_null([]) if part.num_rows else part.column(part.schema.get_field_index(name))
    sizes = np.diff(col.offsets.to_numpy())
    return np.repeat(np.arange(len(col)), sizes), col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth-100 buckets of the open windows, less what the slice settles by itself."""
    for part in at.slices(batches, "text", SLICE_BYTES):
        ids, text, part = _in_order(part)
        data, offsets = at.flat(text)
        bucket = gram_buckets(data)
        row, packed = _lists(part, "runs")
        first, last, _, _ = _unpacked(packed)
        order = np.lexsort((first, row))
        run, local = _spread(first[order], last[order])
        row = row[order][run]
        key, words = window_buckets(bucket, local + offsets[row]), window_words(data, local + offsets[row])
        fresh = at.first_of(at.mix(key ^ at.mix(words)))
        old = np.flatnonzero(~fresh)
        a, b = at.runs(local[old], row[old])
        yield _batch(at.mix(row[old][a].astype(np.uint64)), a * 0, ids[row[old][a]], _packed(local[old][a], local[old][b]))
        new = np.flatnonzero(fresh)
        yield _batch(key[new], words[new], ids[row[new]], _anchored(local[new], local[new], local[new], OPEN))


def _settle_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In one partition of depth-100 buckets: all windows but the earliest of a bucket are repeated."""
    key, words, ids, packed = _gathered(batches, _NAMES)
    first, last, _, kind = _unpacked(packed)
    done = kind == REPEATED
    pick = np.flatnonzero(~done)
    order = pick[np.lexsort((first[pick], ids[pick], words[pick], key[pick]))]
    later = order[np.r_[False, (key[order][1:] == key[order][:-1]) & (words[order][1:] == words[order][:-1])]] if len(order) else order
    later = later[np.lexsort((first[later], ids[later]))]
    r, a, b = _merged(ids[later], first[later], last[later])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[done], r])), pa.array(np.concatenate([packed[done], _packed(a, b)]))], ["ord", "packed"])


def _per_partition(df: DataFrame, settle: Callable, key: str, n: int) -> DataFrame:
    return df.repartition(n, key).mapInArrow(settle, "ord long, packed long")


def repeated_runs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, runs): per row of ``rows`` (ord, text) the packed runs of repeated window starts; and the partitioned rows."""
    # a task holds the rows of its partition: about one for every 34 bytes of text in the first round, fewer later
    size, longest = (x or 0 for x in rows.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first())
    if longest >= LARGEST:
        raise ValueError(f"a text has {longest} bytes; positions can tell {LARGEST - 1}")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (34 * TASK_ROWS))
    placed = rows.repartition(n, "ord")  # one exchange of the texts serves the joins of a query
    kind = F.col("packed").bitwiseAND(F.lit(3))

    def still_open(runs: DataFrame) -> DataFrame:
        todo = runs.filter(kind == OPEN).groupBy("ord").agg(F.collect_list("packed").alias("runs"))
        return placed.select("ord", "text").join(todo.hint("shuffle_merge"), "ord")

    anchors = stored(_per_partition(rows.select("ord", "text").mapInArrow(_anchor_rows, _SCHEMA), _settle_runs, "bucket", n))
    # read twice below from one exchange, as the texts are, so that neither is shuffled again
    blocks = _per_partition(still_open(anchors).mapInArrow(_block_rows, _SCHEMA), _settle_runs, "bucket", n)
    windows = _per_partition(still_open(blocks).mapInArrow(_open_windows, _SCHEMA), _settle_windows, "bucket", n)
    found = anchors.filter(kind == REPEATED).unionByName(blocks.filter(kind == REPEATED)).unionByName(windows)
    return found.groupBy("ord").agg(F.collect_list("packed").alias("runs")), placed


def _removed(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Mask of the bytes inside a repeated window."""
    first, last, _, _ = _unpacked(packed)
    delta = np.zeros(len(data) + 1, np.int64)
    np.add.at(delta, offsets[row] + first, 1)
    np.add.at(delta, offsets[row] + last + LENGTH, -1)
    return np.cumsum(delta[:-1]) > 0


def deduplicate(docs: DataFrame, carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of every row, beside the ``carry`` columns (doc_id by default).

    A byte is removed if a 100-byte string that covers it also starts earlier: in
    a row with a smaller doc_id, or further to the front of the same text.  Null
    texts are empty.  Rows with equal or null ids are rows of their own, null ids
    first, then by a hash of the text.  An empty table gives an empty result;
    carried columns with the name of a result are replaced.  ``with_text`` adds
    ``kept_text``: what is left, less characters of which any byte was removed.
    Equality is that of 64-bit identifiers: two independent ones for single
    windows, that of the anchor and that of all covered bytes for whole runs.  A
    text of ``LARGEST`` bytes or more is an error.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    carry = [c for c in (["doc_id"] if carry is None else carry) if c not in names]
    source = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in carry if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    rows = numbered(source)
    runs, placed = repeated_runs(rows)
    joined = placed.join(runs.hint("shuffle_merge"), "ord", "left").select("row", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text"):
            data, offsets = at.flat(at.column(part, "text"))
            row, packed = _lists(part, "runs")
            gone = _removed(data, offsets, row, packed)
            n_bytes, n_removed = np.diff(offsets), at.per_doc(gone, offsets)
            edge = np.zeros(len(data), bool)
            edge[offsets[:-1][n_bytes > 0]] = True
            opens = gone & (edge | ~np.r_[False, gone[:-1]]) if len(gone) else gone
            digests = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [part.column(0), pa.array(n_bytes), pa.array(n_removed), pa.array(at.per_doc(opens, offsets)), pa.array(digests, pa.string())]
            if with_text:
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                size = np.diff(np.r_[lead, len(data)])
                hit = np.add.reduceat(gone, lead, dtype=np.int64) > 0 if len(lead) else np.zeros(0, bool)
                whole = np.repeat(hit, size)
                columns.append(pa.array([data[a:b][~whole[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["row", *names])

    schema = joined.select("row").schema
    for n in names:
        schema = schema.add(n, "long" if n.startswith("n_") else "string")
    out = joined.mapInArrow(run, schema)
    if with_text and "text" in carry:
        return out.select(*[F.col("kept_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in carry], *names)
    return out.select("row.*", *names)
