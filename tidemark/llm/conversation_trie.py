"""A trie of conversation prefixes, by ROLLUP over columns of turn ids.

A conversation is cut into blocks of a few turns; a block has one column of turn
ids per place, and the node at which the block before it ended.  One ROLLUP over
these columns, inside that node, gives every prefix of every block at once.  A node is
known by its depth and the exclusive or of hashes of (place, turn id) on its way,
so what lies before a block is a running value and no block waits for another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stable import stored

#: Turn columns of a block.
WIDTH = 4
#: Blocks over which one task carries the running node; longer conversations carry it over such spans.
SPAN = 4096
#: Ends of a node are joined up by runs of so many conversation ids (as a power of two) before they are hashed.
ID_BITS = 12
#: Rebuilding: most turns taken from another conversation, less one, and the distance of conversations that share one.
HEADS, SHARED = 9, 5

KEY = ("depth", "a", "b")
_BITS_OF_ROW = 33  # of a monotonically increasing id, below the partition's number


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn_id, bytes): every turn with its place from 0, and 128 bits of a hash of role and text.

    Turns are in order of ``turn`` (null first), equal ones in that of the hash.
    They are sorted as a whole and numbered in runs, so one long conversation is
    spread over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("turn_id"), F.octet_length(text).cast("long").alias("bytes")
    )
    # the sort looks at its input twice; texts are hashed once
    sorted_ = stored(slim).orderBy("conv_id", F.asc_nulls_first("turn"), "turn_id").withColumn("n", F.monotonically_increasing_id())
    numbered = stored(sorted_.drop("turn").withColumn("run", F.shiftright("n", _BITS_OF_ROW)))
    runs = numbered.groupBy("conv_id", "run").agg(F.min("n").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("conv_id", "run", (F.col("first") - F.coalesce(F.sum("held").over(before), F.lit(0))).alias("start"))
    return stored(numbered.join(starts, ["conv_id", "run"]).select("conv_id", (F.col("n") - F.col("start")).alias("at"), "turn_id", "bytes"))


def rebuilt(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of every rebuilt conversation, and the ids of those that have none.

    The first h turns come from conversation c - c % 5, the others from c itself
    after its first h; h is the CRC-32 of the decimal id, modulo 9.
    """
    sizes = given.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("source"))
    there = sizes.select(F.col("conv_id").alias("source"), F.col("n").alias("there"))
    plan = stored(heads.join(there, "source", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).drop("there"))
    own = given.join(plan.filter("n > h").select("conv_id", "h", "k"), "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "turn_id", "bytes")
    lent = given.filter((F.col("conv_id") % SHARED == 0) & (F.col("at") < HEADS - 1)).withColumnRenamed("conv_id", "source")
    head = lent.join(plan.filter("k > 0").select("conv_id", "source", "k"), "source").filter("at < k").select("conv_id", "at", "turn_id", "bytes")
    return own.unionByName(head), plan.filter("k = 0 AND n <= h").select("conv_id")


def _mark(seed: int, at: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(seed), at.cast("long"), turn)


def blocks(rows: DataFrame, turnless: DataFrame) -> DataFrame:
    """One row per conversation and ``WIDTH`` turns: ids t0, t1, ..., sizes s0, s1, ..., and the node (a, b) and bytes before it."""
    at, turn = F.col("at"), F.col("turn_id")
    marked = rows.withColumn("block", F.floor(at / WIDTH)).withColumn("xa", _mark(1, at, turn)).withColumn("xb", _mark(2, at, turn))
    met = marked.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "turn_id", "bytes"))).alias("turns"), F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("bytes").alias("size"))
    none = turnless.select("conv_id", F.lit(0).cast("long").alias("block"), F.array().cast(met.schema["turns"].dataType).alias("turns"), *[F.lit(0).cast("long").alias(c) for c in ("xa", "xb", "size")])
    met = met.unionByName(none).withColumn("span", F.floor(F.col("block") / SPAN))
    running = ("xa", F.bit_xor), ("xb", F.bit_xor), ("size", F.sum)

    def carried(df: DataFrame, keys: list[str], order: str, names: dict[str, str]) -> DataFrame:
        past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({names[c]: F.coalesce(f(c).over(past), F.lit(0)) for c, f in running})

    inside = stored(carried(met, ["conv_id", "span"], "block", {"xa": "a", "xb": "b", "size": "before"}))
    # only conversations of more than one span need what their earlier spans hold
    later = inside.filter("span > 0").select("conv_id").distinct()
    spans = inside.join(later, "conv_id", "left_semi").groupBy("conv_id", "span").agg(*[f(c).alias(c) for c, f in running])
    spans = carried(spans, ["conv_id"], "span", {"xa": "a0", "xb": "b0", "size": "before0"}).select("conv_id", "span", "a0", "b0", "before0")
    added = inside.filter("span > 0").join(spans, ["conv_id", "span"])
    added = added.withColumns({"a": F.col("a").bitwiseXOR(F.col("a0")), "b": F.col("b").bitwiseXOR(F.col("b0")), "before": F.col("before") + F.col("before0")}).select(inside.columns)
    of = lambda field, k: F.get("turns", F.lit(k))[field]
    columns = [of("turn_id", k).alias(f"t{k}") for k in range(WIDTH)] + [F.coalesce(of("bytes", k), F.lit(0)).alias(f"s{k}") for k in range(WIDTH)]
    whole = inside.filter("span = 0").unionByName(added)
    return stored(whole.select("conv_id", "block", "a", "b", "before", F.size("turns").alias("held"), "xa", "xb", "size", *columns))


def _prefixes(rows: DataFrame, sums: str) -> DataFrame:
    """All prefixes of all blocks: block, a, b and before of the node before, level (turns of the block taken), t0, t1, ..., and ``sums``."""
    ids = ", ".join(f"t{k}" for k in range(WIDTH))
    rolled = rows.sparkSession.sql(
        f"SELECT block, a, b, before, {WIDTH} - bit_count(grouping_id()) AS level, {ids}, {sums} FROM {{rows}} GROUP BY block, a, b, before, ROLLUP({ids})",
        rows=rows,
    )
    # a block's prefix of no turn is the node before, which its own block has; only the root has no other
    there = F.when(F.col("level") == 0, F.col("block") == 0)
    for k in range(WIDTH):
        there = there.when(F.col("level") == k + 1, F.col(f"t{k}").isNotNull())
    return rolled.filter(there)


def _node(name: str, seed: int, less: int = 0) -> Column:
    """One half of the id of the node that is ``less`` turns above the prefix's."""
    out = F.col(name)
    for k in range(WIDTH):
        out = out.bitwiseXOR(F.when(F.col("level") - less > k, _mark(seed, F.col("block") * WIDTH + k, F.col(f"t{k}"))).otherwise(F.lit(0).cast("long")))
    return out


def _at_level(values: list[Column]) -> Column:
    out = F.when(F.col("level") == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(F.col("level") == k, v)
    return out


def _keyed(prefixes: DataFrame, values: dict[str, Column], parent: bool = False) -> DataFrame:
    depth = (F.col("block") * WIDTH + F.col("level")).cast("long")
    above = [F.when(depth > 0, _node("a", 1, 1)).alias("pa"), F.when(depth > 0, _node("b", 2, 1)).alias("pb")] if parent else []
    return prefixes.select(depth.alias("depth"), _node("a", 1).alias("a"), _node("b", 2).alias("b"), *above, *[v.alias(n) for n, v in values.items()])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of every node at which (depth, a, b, conv_id) end.

    Ids are joined up in runs, and a task hashes the runs of its nodes one after
    the other, holding one run at a time.
    """
    run = F.shiftright("conv_id", ID_BITS)
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ends.groupBy(*KEY, run.alias("run")).agg(text.alias("ids")).repartition(*KEY).sortWithinPartitions(*KEY, "run")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        out: list[tuple] = []
        for part in batches:
            for *key, ids in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])
                out = []
        if now is not None:
            out.append((*now, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])

    return texts.select(*KEY, "ids").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def trie(rows: DataFrame, turnless: DataFrame) -> DataFrame:
    """Every node of the trie of (conv_id, at, turn_id, bytes) and of conversations without turns.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Sums over subtrees are sums over members: a node is
    owned by its smallest member, and what a conversation does not own of its way is
    a beginning of it, so below a node at ``before`` bytes it saves what its unowned bytes
    exceed these.
    """
    cut = blocks(rows, turnless)
    first = _prefixes(cut, "min(conv_id) AS conv_id, count(*) AS n_convs, " + ", ".join(f"max(s{k}) AS s{k}" for k in range(WIDTH)))
    nodes = stored(_keyed(first, {"conv_id": F.col("conv_id"), "n_convs": F.col("n_convs"), "bytes": _at_level([F.lit(0).cast("long"), *[F.col(f"s{k}") for k in range(WIDTH)]])}, parent=True))
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    ways = cut.groupBy("conv_id").agg(F.sum("held").alias("depth"), F.bit_xor("xa").alias("a"), F.bit_xor("xb").alias("b"), F.sum("size").alias("size"))
    owned = nodes.groupBy("conv_id").agg(F.sum("bytes").alias("owned"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    ways = stored(ways.join(owned, "conv_id", "left").select("conv_id", *KEY, (F.col("size") - F.coalesce("owned", F.lit(0))).alias("unowned"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    saved, passed = [], "before"
    for k in range(WIDTH):
        saved.append(f"sum(greatest(0L, unowned - ({passed}))) AS v{k}")
        passed += f" + s{k}"
    second = _prefixes(cut.join(ways.select("conv_id", "unowned", "leaf"), "conv_id"), "sum(leaf) AS n_leaves, " + ", ".join(saved))
    sums = _keyed(second, {"n_leaves": F.col("n_leaves"), "saved_tokens": _at_level([F.col("v0"), *[F.col(f"v{k}") for k in range(WIDTH)]])})

    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(sums, list(KEY)).join(_end_hashes(ways.select(*KEY, "conv_id")), list(KEY), "left").join(above, ["depth", "pa", "pb"], "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see ``turns``, ``rebuilt`` and ``trie``.

    Null roles and texts are empty ones; rows without conv_id belong to no
    conversation and are left out; repeated rows are turns of their own; a table
    without conversations has no node, not even the root.  Other columns are ignored.
    """
    return trie(*rebuilt(turns(conversations)))
