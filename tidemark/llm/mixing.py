"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every document first gets the whole copies that its expected number of copies
makes certain.  The fraction left is its inclusion probability; documents are
ranked by random odds divided by inclusion odds, and the smallest ranks are
taken until the source's remaining words are filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stable import settled, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Ranks are first summed in this many buckets per source; only the bucket in which a source fills up is ordered row by row.
RANK_BUCKETS = 4096
#: Tables with one row per source are broadcast up to this many sources.
BROADCAST_SOURCES = 20_000


def uniform(id_col: Column, text_col: Column, seed: int) -> Column:
    """A reproducible number inside (0, 1) from 52 bits of an MD5 over id and seed, and the text where the id is null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.concat(F.lit("t:"), F.coalesce(text_col, F.lit("")))))
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: list[int], share_percent: int, ceiling: int) -> DataFrame:
    """Target words per source from (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share_percent`` of all words.  Targets stop at ``ceiling`` times the
    source's size; the excess goes to the others by weight until none is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.withColumn("w", w.cast("double")).withColumn("cap", (ceiling * F.col("source_size")).cast("double"))
    t = t.withColumn("budget", (share_percent * F.sum("source_size").over(everything)).cast("double") / 100)
    # sources reach their ceiling in the order of ceiling / weight: level = what is left over for each unit of weight once the first k have stopped
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    stopped = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(stopped), F.lit(0.0))) / F.sum("w").over(rest))
    t = t.withColumn("water", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("ratio"), F.col("level")))).over(everything)["level"])
    return t.select(*sizes.columns, F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("w"))).alias("target"))


def _on_source(rows: DataFrame, table: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Join a table of one row per source; broadcast while there are few sources."""
    named = table.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


_UNIT = ("rank", "u", "size", "weight")
#: What a pass takes: units of at most ``bound`` words up to ``last`` in the order of ranks.
_PASS = "struct<bound:double,edge:int,last:struct<rank:double,u:double,size:bigint,weight:double>>"


def length_weight(size: Column) -> Column:
    """Likelier inclusion of longer documents: 1 below 100 words, 1.5 below 500, then 2."""
    return F.when(size >= 500, 2.0).when(size >= 100, 1.5).otherwise(1.0)


def rounded_weight(weight: Column) -> Column:
    """A positive weight with three binary digits, so that a source has a bounded number of different ones; others are 0."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.when(weight > 0, weight))))
    return F.when((weight > 0) & (weight < float("inf")), F.floor(weight / power * 4) / 4 * power).otherwise(0.0)


def _rates(classes: DataFrame, ceiling: int) -> DataFrame:
    """Expected copies for each unit of weight, per source: copies stop at the ceiling, and the others share what that leaves.

    ``classes`` has a row per source and different weight with its ``words``.
    """
    by = Window.partitionBy("source").orderBy(F.col("weight").desc())
    stopped, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    t = classes.withColumn("ratio", ceiling / F.col("weight"))
    t = t.withColumn("level", (F.col("target") - F.coalesce(F.sum(ceiling * F.col("words")).over(stopped), F.lit(0)).cast("double")) / F.sum(F.col("weight") * F.col("words")).over(rest))
    return t.groupBy("source").agg(F.coalesce(F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))), F.max("ratio")).alias("rate"))


def plan(sized: DataFrame, weights: list[int], share_percent: int, ceiling: int) -> tuple[DataFrame, DataFrame, bool]:
    """One row per source: target, rate, passes and closing; the units of several rows; and whether there are few sources.

    Units are taken in the order of their ranks up to the first one that does not
    fit into what is left of the source's target.  Then those that are no larger
    than what is left are, and so on; the bound on sizes at least halves from pass
    to pass, so there are no more of these than binary digits of the largest unit, and
    they end where no unit is within the bound.  ``closing`` is the one unit left that
    narrows the gap most at the end, if any does.

    Rows of (source, u, size, weight) that agree in all four are one unit: they
    get the same decision.
    """
    units = settled(sized.groupBy("source", "u", "size", "weight").agg(F.count("*").alias("n")))
    sizes = settled(units.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size")))
    few = sizes.count() <= BROADCAST_SOURCES
    goal = targets(sizes, weights, share_percent, ceiling)
    classes = units.filter((F.col("weight") > 0) & (F.col("size") > 0)).groupBy("source", "weight").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    rates = _rates(_on_source(classes, goal.select("source", "target"), few), ceiling)
    goal = settled(_on_source(goal, rates, few, "left").withColumn("rate", F.coalesce("rate", F.lit(0.0))))
    ranked = _ranked(_on_source(units, goal, few), ceiling).withColumn("words", F.col("n") * F.col("size"))

    certain = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("words") * F.col("copies"))).alias("left"))
    ranked = ranked.filter(F.col("rank").isNotNull() & (F.col("words") > 0)).select("source", *_UNIT, "bucket", F.col("words").cast("long").alias("words"))
    # written and read again each time: a checkpoint would hand on size estimates that the joins multiply
    now = stored(certain.select("source", "left", F.lit(float("inf")).alias("bound"), F.array().cast(f"array<{_PASS}>").alias("passes")))
    now = stored(_passed(ranked, now, few))
    near = stored(_on_source(ranked, now, few).filter(~_taken(F.col("words")) & (F.col("words") < 2 * F.col("left"))).select(*ranked.columns))
    while _fitting(near, now, few).limit(1).count():
        now = stored(_passed(near, now, few))
    rest = _on_source(near, now, few).filter(~_taken(F.col("words"))).withColumn("miss", F.abs(F.col("left") - F.col("words"))).filter(F.col("miss") < F.col("left"))
    closing = rest.groupBy("source").agg(F.min(F.struct("miss", *_UNIT)).alias("c")).select("source", F.struct(*[F.col("c")[k].alias(k) for k in _UNIT]).alias("closing"))
    table = _on_source(_on_source(goal, now.select("source", "passes"), few, "left"), closing, few, "left")
    return settled(table), units.filter("n > 1"), few


def _fitting(units: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """Units that no pass has taken and that are within the next bound."""
    return _on_source(units, now, few).filter((F.col("words") <= F.col("bound")) & ~_taken(F.col("words")))


def _passed(units: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """``now`` (source, left, bound, passes) after one more pass over the open units.

    Words are summed per source and bucket of ranks first; only the bucket in which
    a source fills up is looked at unit by unit.
    """
    fit = _fitting(units, now, few)
    sums = fit.groupBy("source", "bucket").agg(F.sum("words").alias("words"), F.first("left").alias("left"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    over = F.col("upto") > F.col("left")
    edge = sums.groupBy("source").agg(F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("e"), F.max("upto").alias("all"))
    edge = stored(edge.select("source", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"), "all"))
    inside = Window.partitionBy("source").orderBy(*_UNIT).rowsBetween(Window.unboundedPreceding, 0)
    last = _on_source(fit, edge, few).filter("bucket = edge").withColumn("upto", F.col("before") + F.sum("words").over(inside)).filter(F.col("upto") <= F.col("left"))
    last = last.groupBy("source").agg(F.max(F.struct(*_UNIT)).alias("last"), F.max("upto").alias("reached"))
    cut = _on_source(edge, last, few, "left").select("source", "edge", "last", F.coalesce("reached", "before", "all").alias("words"))
    told = _on_source(now, cut, few, "left")
    passed = F.struct("bound", "edge", "last").cast(_PASS)
    left = F.col("left") - F.coalesce("words", F.lit(0))
    return told.select("source", left.alias("left"), F.least(left, F.col("bound") / 2).alias("bound"), F.when(F.col("words").isNull(), F.col("passes")).otherwise(F.concat("passes", F.array(passed))).alias("passes"))


def _ranked(rows: DataFrame, ceiling: int) -> DataFrame:
    """Certain copies, and the Pareto rank and its bucket where a fraction of a copy is left."""
    rows = rows.withColumn("expected", F.least(F.col("rate") * F.col("weight"), F.lit(float(ceiling))))
    rows = rows.withColumn("copies", F.floor("expected").cast("int"))
    p = F.col("expected") - F.col("copies")
    rows = rows.withColumn("rank", F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))
    return rows.withColumn("bucket", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * RANK_BUCKETS).cast("int"), F.when(F.col("rank").isNotNull(), F.lit(RANK_BUCKETS - 1))))


def _taken(words: Column) -> Column:
    """Whether a unit of so many words was taken by one of the passes of its source."""
    unit = F.struct(*_UNIT)
    by = lambda p: (words <= p["bound"]) & (p["edge"].isNull() | (F.col("bucket") < p["edge"]) | ((F.col("bucket") == p["edge"]) & F.coalesce(unit <= p["last"], F.lit(False))))
    return F.coalesce(F.exists("passes", by), F.lit(False))


def _words(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Add ``words``, those of all rows of the unit; the few units of several rows are looked up."""
    many = repeated.count()
    if many == 0:
        return rows.withColumn("words", F.col("size"))
    table = repeated.select(*[F.col(c).alias(f"__{c}") for c in ("source", "u", "size", "weight", "n")])
    on = F.col("source").eqNullSafe(F.col("__source")) & (F.col("u") == F.col("__u")) & (F.col("size") == F.col("__size")) & (F.col("weight") == F.col("__weight"))
    met = rows.join(F.broadcast(table) if many <= BROADCAST_SOURCES else table, on, "left")
    return met.withColumn("words", F.col("size") * F.coalesce("__n", F.lit(1))).drop(*table.columns)


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share_percent: int = 150, ceiling: int = 2, seed: int = 20240607, weight_col: str | None = None, by_length: bool = False) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and copies (0 to ``ceiling``).

    ``weight_col`` makes documents of one source unequally likely (null: 0; kept
    to three binary digits), or ``by_length`` their ``length_weight``.
    Null texts have size 0 and no copies' worth of words; the null source is a
    source of its own.  Repeated rows (equal id and size) share one decision, so
    they are taken together or not at all.  Inputs with the names of the added
    columns lose those; an empty table gives an empty result.  A run depends on
    the rows and the seed only, not on their order or partitioning.
    """
    names = ("size", "source_size", "target", "copies")
    carry = [c for c in docs.columns if c not in names]
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    weight = rounded_weight(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))) if weight_col else length_weight(size) if by_length else F.lit(1.0)
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"),
        F.col("source").alias("source"),
        size.alias("size"),
        uniform(F.col("doc_id"), text, seed).alias("u"),
        weight.alias("weight"),
    )
    table, repeated, few = plan(sized.drop("doc"), list(weights), share_percent, ceiling)
    rows = _words(_ranked(_on_source(sized, table, few), ceiling), repeated)
    closing = F.coalesce(F.struct("u", "size", "weight") == F.struct("closing.u", "closing.size", "closing.weight"), F.lit(False))
    picked = F.col("rank").isNotNull() & (F.col("size") > 0) & (_taken(F.col("words")) | closing)
    return rows.select("doc.*", "size", "source_size", "target", (F.col("copies") + F.coalesce(picked, F.lit(False)).cast("int")).alias("copies"))
