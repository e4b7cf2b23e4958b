"""Best-fit packing into sequences of several permitted lengths.

Documents are dealt by hash into groups of bounded expected size; each group is
packed best-fit-decreasing by one task.  When nothing open fits, a new bin of
the least-cost capacity is opened; the group's packing is the cheapest over all
opening policies, and every bin is finally downsized to its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import WORD

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, in words.
OVERHEAD = 128
#: Expected documents per group.
GROUP_ROWS = 4096


def linear_cost(capacity: int) -> float:
    return OVERHEAD + capacity


def _fit(sizes: list[int], open_bin: Callable[[int], int]) -> tuple[list[int], list[int]]:
    """Best fit over descending sizes: bin of each item, capacity of each bin."""
    bins: list[int] = []
    caps: list[int] = []
    free: list[int] = []
    by_free: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        at = bisect_left(free, size)
        if at < len(free):
            left = free[at]
            chosen = by_free[left].pop()
            if not by_free[left]:
                del by_free[left], free[at]
        else:
            chosen, left = len(caps), open_bin(i)
            caps.append(left)
        bins.append(chosen)
        left -= size
        if left > 0:
            if left not in by_free:
                by_free[left] = []
                insort(free, left)
            by_free[left].append(chosen)
    return bins, caps


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = linear_cost) -> tuple[list[int], list[int]]:
    """Bin of every item and final capacity of every bin, for descending sizes of 1 to the largest capacity."""
    caps = sorted(capacities)
    after = np.concatenate([np.cumsum(np.asarray(sizes[::-1], np.int64))[::-1], [0]]).tolist()
    falling = [-s for s in sizes]

    def fixed(capacity: int) -> Callable[[int], int]:
        return lambda i: next(c for c in caps if c >= max(sizes[i], capacity))

    def cheapest(i: int) -> int:
        best = None
        for c in caps:
            if c < sizes[i]:
                continue
            room = c - sizes[i]
            later = max(i + 1, bisect_left(falling, -room))  # the items still to come that fit beside this one
            rate = cost(c) / (sizes[i] + min(room, after[later]))
            if best is None or rate < best[0]:
                best = (rate, c)
        return best[1]

    found = None
    for policy in [cheapest, *map(fixed, caps)]:
        bins, _ = _fit(sizes, policy)
        content = np.bincount(bins, sizes).astype(np.int64) if bins else np.zeros(0, np.int64)
        final = np.asarray(caps)[np.searchsorted(caps, content)].tolist()
        total = sum(map(cost, final))
        if found is None or total < found[0]:
            found = (total, bins, final)
    return found[1], found[2]


def _pack_group(rows: pd.DataFrame, capacities: tuple[int, ...], cost: Callable[[int], float]) -> pd.DataFrame:
    largest = max(capacities)
    rows = rows.sort_values(["tail", "doc_id", "key"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
    whole = (rows.n_words // largest).to_numpy(np.int64)
    tail = rows["tail"].to_numpy(np.int64)
    some = np.flatnonzero(tail > 0)
    bins, caps = pack(tail[some].tolist(), capacities, cost)
    order = np.argsort(bins, kind="stable")
    sizes = tail[some][order]
    ends = np.cumsum(sizes)
    by_bin = np.asarray(bins, np.int64)[order]
    lead = np.r_[True, by_bin[1:] != by_bin[:-1]] if len(order) else np.zeros(0, bool)
    offset = ends - sizes - np.repeat((ends - sizes)[lead], np.diff(np.r_[np.flatnonzero(lead), len(order)]))
    tails = pd.DataFrame({"row": some[order], "piece": whole[some][order], "start": whole[some][order] * largest, "length": sizes, "bin": by_bin, "bin_offset": offset, "capacity": np.asarray(caps, np.int64)[by_bin] if len(order) else sizes})
    row = np.repeat(np.arange(len(rows)), whole)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = pd.DataFrame({"row": row, "piece": piece, "start": piece * largest, "length": largest, "bin": len(caps) + np.arange(len(row)), "bin_offset": 0, "capacity": largest})
    out = pd.concat([tails, full], ignore_index=True)
    empty = np.flatnonzero(rows.n_words.to_numpy() == 0)
    out["bin_id"] = pd.array((int(rows["group"].iloc[0]) << 32) + out.pop("bin").to_numpy(np.int64), "Int64")
    if len(empty):
        out = pd.concat([out, pd.DataFrame({"row": empty, "piece": 0, "start": 0, "length": 0, "bin_offset": 0, "capacity": 0, "bin_id": pd.array([None] * len(empty), "Int64")})], ignore_index=True)
    got = rows.iloc[out.row.to_numpy()].reset_index(drop=True)
    out.insert(0, "doc_id", got.doc_id)
    out.insert(1, "n_words", got.n_words)
    return out.drop(columns="row")


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = linear_cost, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row per piece of every document: doc_id, n_words, piece, start, length, bin_offset, capacity, bin_id.

    A document longer than the largest capacity is cut; its full pieces fill bins
    of their own and the rest is packed.  Bins hold at most ``capacity`` words and
    never cross groups.  Documents without words (null or empty text) come back
    with length 0 and a null ``bin_id``.  Rows with equal or null ids are packed
    each by itself; an empty table gives an empty result.  Ids may have any type.
    Groups depend on id, word count and a hash of the text, and for rows repeated
    very often on their number among the copies, so a rerun over the same rows
    packs alike, whatever their order.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    groups = max(1, -(-docs.count() // group_rows))
    items = docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.xxhash64(text).alias("key"))
    items = _copies(items, max(1, group_rows // 4)).withColumn("tail", F.col("n_words") % max(capacities))
    items = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "key", "block"), F.lit(groups))).drop("block")
    names = ["n_words", "piece", "start", "length", "bin_offset", "capacity", "bin_id"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names)
    return items.groupBy("group").applyInPandas(lambda rows: _pack_group(rows, capacities, cost)[["doc_id", *names]], schema)


def _copies(items: DataFrame, most: int) -> DataFrame:
    """All rows again, repeated ones numbered in ``block``s of ``most``: rows that agree are counted, and the count is written out."""
    counted = items.groupBy("doc_id", "n_words", "key").agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most))))
    sized = blocks.withColumn("n", F.least(F.lit(most), F.col("n") - F.col("block") * most).cast("int"))
    return sized.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "copy")
