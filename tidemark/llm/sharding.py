"""Sharding by fixed virtual slots under a versioned slot-to-shard map.

Records are hashed into a fixed number of virtual slots.  The map from slots to
shards is the only thing that changes: every rebalancing adds a version in
which slots move from heavy shards to light ones.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stable import fresh_path

VIRTUAL_SLOTS = 4096


def with_virtual_slot(rows: DataFrame, key_cols: list[str], slots: int = VIRTUAL_SLOTS, name: str = "virtual_slot") -> DataFrame:
    """Add the fixed slot of every row, a hash of ``key_cols`` (nulls hash like any other value)."""
    return rows.withColumn(name, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key_cols]), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame, size_col: str = "size", slot_col: str = "virtual_slot") -> DataFrame:
    """Bytes and rows per slot: at most ``slots`` rows whatever the input."""
    return rows.groupBy(F.col(slot_col).alias("virtual_slot")).agg(F.sum(size_col).alias("slot_bytes"), F.count("*").alias("slot_rows"))


def first_map(spark: SparkSession, shards: int, slots: int = VIRTUAL_SLOTS) -> dict[int, int]:
    """Version 1: slots dealt round."""
    return {s: s % shards for s in range(slots)}


def rebalanced(assignment: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """The next version: an edited map whose shards carry nearly equal bytes.

    Repeatedly the heaviest and the lightest shard are compared and the slot, or
    exchange of two slots, that narrows their gap most is moved.  Works on the
    bounded slot table only.  Slots without bytes stay where they are, and most
    others do when the bytes have changed little.  A slot heavier than a shard's
    share stands alone.
    """
    out = dict(assignment)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    load = [0] * shards
    homeless = []
    for slot, w in sorted(weights.items()):
        if w <= 0:
            continue
        shard = out.get(slot, -1)
        if 0 <= shard < shards:
            held[shard].append((w, slot))
            load[shard] += w
        else:
            homeless.append((w, slot))
    for w, slot in sorted(homeless, reverse=True):
        to = min(range(shards), key=load.__getitem__)
        out[slot] = to
        held[to].append((w, slot))
        load[to] += w
    mean = sum(load) / max(1, shards)
    # light shards get slots of heavy ones, the largest first
    spare = []
    for shard in range(shards):
        held[shard].sort()
        while load[shard] > mean and held[shard]:
            item = held[shard].pop()
            load[shard] -= item[0]
            spare.append(item)
    for w, slot in sorted(spare, reverse=True):
        to = min(range(shards), key=load.__getitem__)
        out[slot] = to
        held[to].append((w, slot))
        load[to] += w
    _evened(out, held, load, shards)
    return out


def _evened(out: dict[int, int], held: list[list[tuple[int, int]]], load: list[int], shards: int) -> None:
    """Move one slot, or exchange two, between the heaviest shard and the lightest one where that narrows their gap; changes its arguments.

    A shard that no such step makes lighter is left aside until it changes.
    """
    stuck: set[int] = set()
    for _ in range(shards * 64):
        able = [s for s in range(shards) if s not in stuck]
        if not able:
            return
        top = max(able, key=load.__getitem__)
        for low in sorted(range(shards), key=load.__getitem__):
            if load[low] >= load[top]:
                continue
            gap = load[top] - load[low]
            lights = sorted([(0, -1), *held[low]])
            weights = [v for v, _ in lights]
            best = (gap, None, None)
            for w, slot in held[top]:
                # the exchange nearest to half of the gap
                at = bisect_left(weights, w - gap / 2)
                for v, other in lights[max(0, at - 1) : at + 1]:
                    if abs(gap - 2 * (w - v)) < best[0]:
                        best = (abs(gap - 2 * (w - v)), (w, slot), (v, other))
            if best[1] is not None:
                break
        else:
            stuck.add(top)
            continue
        stuck.discard(low)
        (w, slot), (v, other) = best[1], best[2]
        out[slot] = low
        held[top].remove((w, slot))
        held[low].append((w, slot))
        if other >= 0:
            out[other] = top
            held[low].remove((v, other))
            held[top].append((v, other))
        load[top] += v - w
        load[low] += w - v


def map_table(spark: SparkSession, versions: dict[int, dict[int, int]]) -> DataFrame:
    """Versions of the map as one table (version, virtual_slot, shard)."""
    frames = []
    for version, assignment in sorted(versions.items()):
        pairs = F.from_json(F.lit(str([[s, shard] for s, shard in sorted(assignment.items())])), "array<array<int>>")
        pair = spark.range(1).select(F.explode(pairs).alias("pair"))
        frames.append(pair.select(F.lit(version).alias("version"), F.col("pair")[0].alias("virtual_slot"), F.col("pair")[1].alias("shard")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def save_map(spark: SparkSession, assignment: dict[int, int], version: int, path: str) -> None:
    """Store one version; an existing version is never overwritten."""
    map_table(spark, {version: assignment}).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Read one stored version: a row per virtual slot."""
    return {r[0]: r[1] for r in spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard").collect()}


def _stored(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def latest_version(spark: SparkSession, path: str) -> int:
    """The highest stored version."""
    return spark.read.parquet(path).agg(F.max("version")).first()[0]


def place(rows: DataFrame, assignment: dict[int, int], order_cols: list[str], slot_col: str = "virtual_slot") -> DataFrame:
    """Add ``shard`` and ``slot``, the row's place in its shard counted from 0 without gaps.

    Places follow the virtual slot, then ``order_cols`` (nulls first).  Rows that
    agree in all of them are interchangeable and get consecutive places.
    Windows span one virtual slot, never a shard.
    """
    spark = rows.sparkSession
    table = map_table(spark, {0: assignment}).drop("version").withColumnRenamed("virtual_slot", "__vs")
    counts = rows.groupBy(F.col(slot_col).alias("__vs")).agg(F.count("*").alias("__n")).join(F.broadcast(table), "__vs")
    before = Window.partitionBy("shard").orderBy("__vs").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__vs", "shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(slot_col).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order_cols])
    ranked = rows.withColumn("__rank", F.row_number().over(inside))
    # one row per virtual slot: bounded by the fixed number of slots
    placed = ranked.join(F.broadcast(starts), F.col(slot_col) == F.col("__vs"))
    return placed.withColumn("slot", (F.col("__start") + F.col("__rank") - 1).cast("long")).drop("__vs", "__start", "__rank")


def shard_documents(docs: DataFrame, shards: int, slots: int = VIRTUAL_SLOTS, assignment: dict[int, int] | None = None, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every document.

    Size is the text's UTF-8 bytes (null: none) plus 16.  The law is ``bytes``:
    the next version of the map evens out the bytes measured under version 1 (or under
    the given ``assignment``).  Both versions are stored in ``map_path``, by default
    a fresh folder of the shared one, and rows are placed by the latest version read
    back from there; a folder that holds versions gets the next one, edited from
    its latest.  Documents are hashed by id and text, so null ids
    spread; rows equal in both share a slot.  Equal texts of different ids do not
    stay together: a group of them may be larger than a shard, and the law is one
    of even bytes.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = with_virtual_slot(rows, ["doc_id", "text_crc32", "size"], slots)
    weights = {r[0]: r[1] for r in slot_bytes(rows).select("virtual_slot", "slot_bytes").collect()}  # at most `slots` rows
    spark, path = docs.sparkSession, map_path or fresh_path(docs.sparkSession, "slot-map")
    if not _stored(spark, path):
        save_map(spark, assignment or first_map(spark, shards, slots), 1, path)
    before = latest_version(spark, path)
    save_map(spark, rebalanced(load_map(spark, path, before), weights, shards), before + 1, path)
    version = latest_version(spark, path)
    placed = place(rows, load_map(spark, path, version), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
