"""Vectorised word, line and byte bookkeeping over Arrow string columns.

The helpers here run inside ``mapInArrow`` tasks.  They see one bounded slice of
a record batch at a time (``slices``), whatever the batch size of the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def space_mask(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large_string, nulls as empty strings."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_string()).fill_null("")


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a large_string array, offsets from 0."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = flat(column(batch, name))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set bytes between consecutive offsets."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return per_doc((data & 0xC0) != 0x80, offsets)


@dataclass
class Words:
    """Byte span, owning row and first word index per row of every word of a slice."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    first = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def identities(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A small integer per span, equal exactly for equal bytes.  Spans ascend and do not overlap."""
    return dictionary(data, start, end)[0]


def dictionary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Span identities and the distinct byte strings they point to."""
    if len(start) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    size = end - start
    delta = np.zeros(len(data) + 1, np.int8)
    np.add.at(delta, start[size > 0], 1)
    np.add.at(delta, end[size > 0], -1)
    body = data[np.cumsum(delta[:-1]).astype(bool)]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    coded = packed.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur at least twice."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice) == 0:
        return np.zeros(len(keys), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def first_of(keys: np.ndarray) -> np.ndarray:
    """Mask of each key's first occurrence."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        out[order[np.r_[True, ordered[1:] != ordered[:-1]]]] = True
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over ``n`` slots of those inside a run of ``width`` from any start."""
    delta = np.zeros(n + 1, np.int64)
    delta[starts] += 1
    delta[starts + width] -= 1
    return np.cumsum(delta[:n]) > 0


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    """A 64-bit hash per word that depends on its bytes only; each distinct word of the slice is hashed once."""
    ids, distinct = dictionary(data, found.start, found.end)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    return hashes[ids]


def runs(starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every maximal run of consecutive positions in one document; positions ascend per document."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.r_[True, (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(lead)
    return first, np.r_[first[1:], len(starts)] - 1
