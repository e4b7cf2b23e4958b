"""Vectors as product codes: a codebook per part of the vector, refined by Lloyd's rounds over resident members.

A member is one part of one vector.  Members are dealt once to the owner of
(position, entry, salt) and stay there: owners sum their residents for the next
codebook, look again for each resident's nearest entry, and only members whose
entry changes go through the next shuffle, to their new owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stable import numbered, stored

POSITIONS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are counted in steps of 1 / SCALE.
SCALE = 256
#: Largest component; beyond it squared distances might not fit 64 bits.
LARGEST = 1 << 20
#: Members compared with a codebook at a time inside a task.
CHUNK = 16_384
#: Up to this many distinct labels go to every task.
BROADCAST_LABELS = 100_000

#: Entries by position: one (entries, width) integer array each.
Books = list[np.ndarray]


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and has finite components only, and none too large."""
    vector = F.col(f"`{vector_col}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.filter(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite))
    near = F.forall(vector, lambda x: F.abs(x) < LARGEST)
    return good.withColumn("__fits", F.assert_true(near, F.lit(f"a component reaches {LARGEST}"))).filter("__fits IS NULL").drop("__fits")


def bounds(width: int) -> list[tuple[int, int]]:
    """First and last component of every part; equal parts where the width allows."""
    cuts = [k * width // POSITIONS for k in range(POSITIONS + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def steps(vector: Column) -> Column:
    """Components as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest nearest entry of each row, and the squared distance, both exact."""
    entry, error = np.empty(len(values), np.int32), np.empty(len(values), np.int64)
    for k in range(0, len(values), CHUNK):
        gap = ((values[k : k + CHUNK, None, :] - book[None]) ** 2).sum(2)
        entry[k : k + CHUNK] = gap.argmin(1)
        error[k : k + CHUNK] = gap.min(1)
    return entry, error


def _nested(values: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) of the list values of the given rows; all have that width."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat[values.offsets.to_numpy()[rows][:, None] - values.offsets[0].as_py() + np.arange(width)]


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1)))


def _salts(vectors: DataFrame) -> int:
    """Salts of an entry: a position holds 1 / POSITIONS of the members, so no owner gets more than its share of all partitions."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return -(-parts // POSITIONS)


def _to_owners(members: DataFrame, salts: int) -> DataFrame:
    """The members at their owners, written there."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("ord"), F.lit(salts)).cast("int"))
    return stored(salted.repartition("position", "entry", "salt"))


_MEMBER = "ord long, position int, entry int, part array<long>"


def _deal(vectors: DataFrame, books: Books) -> DataFrame:
    """(ord, position, entry, part) of every part of (ord, steps)."""
    cuts = bounds(sum(b.shape[1] for b in books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, CHUNK):
                part = whole.slice(k, CHUNK)
                values = _nested(part.column(1), np.arange(part.num_rows), cuts[-1][1])
                for position, ((a, b), book) in enumerate(zip(cuts, books, strict=True)):
                    own = np.ascontiguousarray(values[:, a:b])
                    entry, _ = nearest(own, book)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(own), position, np.int32)), pa.array(entry), _lists(own)], ["ord", "position", "entry", "part"])

    return vectors.select("ord", "steps").mapInArrow(run, _MEMBER)


def _look(members: DataFrame, books: list[Books]) -> DataFrame:
    """Residents with ``next`` and ``error``, their nearest entry in the last codebook; those that an earlier one of ``books`` took away are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            position, entry = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            stays, after, error = np.ones(len(entry), bool), np.zeros(len(entry), np.int32), np.zeros(len(entry), np.int64)
            for p in np.unique(position):
                rows = np.flatnonzero(position == p)
                values = _nested(part.column(3), rows, books[-1][p].shape[1])
                for k, book in enumerate(books):
                    got, far = nearest(values, book[p])
                    if k + 1 < len(books):
                        stays[rows[got != entry[rows]]] = False
                after[rows], error[rows] = got, far
            keep = pa.array(np.flatnonzero(stays))
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(keep) for k in range(4)), pa.array(after[stays]), pa.array(error[stays])], ["ord", "position", "entry", "part", "next", "error"])

    return members.select("ord", "position", "entry", "part").mapInArrow(run, _MEMBER + ", next int, error long")


def _sums(residents: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, int]]:
    """Component sums and members of every used entry; owners sum first, and the result is bounded by the codebooks."""
    each = residents.select("position", "entry", F.posexplode("part").alias("k", "x"))
    rows = each.groupBy("position", "entry", "k").agg(F.sum("x").alias("total"), F.count("*").alias("n")).collect()
    out: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
    for r in sorted(rows, key=lambda r: (r["position"], r["entry"], r["k"])):
        total, _ = out.get((r["position"], r["entry"]), (np.zeros(0, np.int64), 0))
        out[r["position"], r["entry"]] = (np.append(total, r["total"]), r["n"])
    return out


def _updated(books: Books, sums: dict[tuple[int, int], tuple[np.ndarray, int]]) -> Books:
    out = [b.copy() for b in books]
    for (position, entry), (total, n) in sums.items():
        out[position][entry] = total // n  # goes down for negative sums too
    return out


def lloyd(vectors: DataFrame, first: Books, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """(ord, position, code, error) of every part of (ord, steps) under the codebooks after the given rounds, and these.

    ``arrived[j]`` holds the members that came to their owner in round j.  A member
    of it is still resident in round r if no codebook since has taken it away,
    which its owner sees by looking again; nothing is written for those that stay.
    """
    salts, books = _salts(vectors), [first]
    arrived = [_to_owners(_deal(vectors, first), salts)]
    for _ in range(rounds):
        here = [m if j == len(arrived) - 1 else _look(m, books[j + 1 :]).filter("next = entry") for j, m in enumerate(arrived)]
        residents = here[0].select("ord", "position", "entry", "part")
        for more in here[1:]:
            residents = residents.unionByName(more.select("ord", "position", "entry", "part"))
        books.append(_updated(books[-1], _sums(residents)))
        leaving = [_look(m, books[j + 1 :]).filter("next != entry") for j, m in enumerate(arrived)]
        moved = leaving[0]
        for more in leaving[1:]:
            moved = moved.unionByName(more)
        arrived.append(_to_owners(moved.select("ord", "position", F.col("next").alias("entry"), "part"), salts))
    # those that came last were looked at under the last codebook, whose entry they have
    done = [_look(m, books[j + 1 :] or books[-1:]).filter("next = entry") for j, m in enumerate(arrived)]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("ord", "position", F.col("entry").alias("code"), "error"), books[-1]


def books_text(books: Books) -> str:
    """All entries' components by part, entry and place, comma-joined."""
    return ",".join(str(x) for b in books for row in b.tolist() for x in row)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """(id, code, error, label_error) of every usable row, and the codebooks.

    ``code`` has two hex digits for each of ``POSITIONS`` parts; ``error`` is the
    squared distance in steps; ``label_error`` sums it over equal labels, nulls
    together.  Each codebook starts as that part of the ``entries`` usable rows
    with the smallest ids (of equal ids that with the smaller vector; null ids
    come last); with fewer rows it has as many entries.

    Rows whose vector is null, empty or not finite are left out, and so are rows
    of another width than the first of the usable ones has.  A width that
    ``POSITIONS`` does not divide gives parts of two widths.  Repeated rows each
    get their code; an empty table gives no rows and empty codebooks; other
    columns are ignored.  A component of ``LARGEST`` or more is an error.
    """
    good = usable(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.col(f"`{label_col}`").alias("label")), "vector")
    head = good.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector").alias("width")).limit(1).collect()
    width = head[0]["width"] if head else 0
    same = good.filter(F.size("vector") == width).withColumn("steps", steps(F.col("vector")))
    rows = same.orderBy(F.col("id").asc_nulls_last(), "vector").select("steps").limit(entries).collect()
    seeds = np.array([r["steps"] for r in rows], np.int64).reshape(len(rows), width)
    books: Books = [seeds[:, a:b] for a, b in bounds(width)]
    rows = numbered(same.select("id", "label", "steps", F.to_json(F.struct("steps", "label")).alias("order")), "id", "order").drop("order")
    if len(seeds) == 0:
        none = rows.select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, books
    parts, books = lloyd(rows, books, rounds)
    hexed = lambda p: F.lpad(F.lower(F.hex(p["code"])), 2, "0")
    # POSITIONS rows of each vector meet
    met = parts.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("position", "code"))).alias("codes"), F.sum("error").alias("error"))
    told = met.select("ord", F.array_join(F.transform("codes", hexed), "").alias("code"), "error")
    coded = stored(rows.select("id", "label", "ord").join(told, "ord").drop("ord"))
    labels = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
    return coded.join(labels, F.col("label").eqNullSafe(F.col("same"))).select("id", "code", "error", "label_error"), books


def with_books(coded: DataFrame, books: Books, id_col: str) -> DataFrame:
    """Add the digest of all codebooks."""
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
