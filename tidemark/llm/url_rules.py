"""URL allow and block rules, matched with DataFrame functions only.

A URL is expanded into every host suffix joined with every path prefix, of which
some rule has the number of labels and the length.  Expressions meet the rules on a short prefix of their
SHA-256; the full digests are compared after the join, and the longest rule
that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest used as the join key.
PREFIX_DIGITS = 8
#: Rules are broadcast up to this many; beyond it both sides are shuffled.
BROADCAST_RULES = 50_000
#: Copies of each rule in the shuffled join, so that one very common expression meets it in several tasks.
SALTS = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs, rules written ``host/path``, as a table (rule, host, path, verdict)."""
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(r[: r.index("/")]).alias("host"), F.lit(r[r.index("/") :]).alias("path"), F.lit(v).alias("verdict")) for v, r in rules]
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("rule", "host", "path", "verdict")])
    return spark.range(1).select(F.inline(F.array(*rows)))


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes of the given numbers of labels joined with path prefixes of the given lengths; the work is linear in the URL."""
    dots = F.char_length(host) - F.char_length(F.translate(host, ".", ""))
    deep = F.filter(F.array(*[F.lit(n) for n in labels]).cast("array<int>"), lambda n: n <= dots + 1)
    parts = F.split(host, r"\.")
    suffixes = F.transform(deep, lambda n: F.array_join(F.slice(parts, dots + 2 - n, n), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def decide(pages: DataFrame, rules: DataFrame, carry: list[str] | None = None, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``carry`` columns plus host, path, rule and verdict of every row.

    The longest fitting rule decides; of equally long ones the one with the
    longer host, then ``block``.  Without a rule,
    and for null or malformed URLs, ``rule`` is null and the verdict is
    ``default``.  Every row is judged by itself, so repeated rows and ids stay;
    carried columns named like an output are replaced.  An empty table gives an
    empty result.
    """
    out = ("host", "path", "rule", "verdict")
    carry = [c for c in (pages.columns if carry is None else carry) if c not in out]
    # one entry per distinct number of labels and path length of a rule; the longest rule bounds them
    labels = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())
    lengths = sorted(r[0] for r in rules.select(F.char_length("path").alias("n")).distinct().collect())
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    keyed = rules.select(
        F.sha2(F.concat("host", "path"), 256).alias("__digest"),
        F.struct(F.char_length("rule").alias("size"), F.char_length("host").alias("host_size"), F.col("rule"), F.col("verdict")).alias("__hit"),
    )
    keyed = keyed.groupBy("__digest").agg(F.max("__hit").alias("__hit")).withColumn("__prefix", F.substring("__digest", 1, PREFIX_DIGITS))
    rows = pages.select(*[F.col(f"`{c}`") for c in carry], host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path")).withColumn("__row", F.monotonically_increasing_id())
    asked = rows.withColumn("__expr", F.explode_outer(_expressions(F.col("host"), F.col("path"), labels, lengths))).withColumn("__url_digest", F.sha2("__expr", 256)).drop("__expr").withColumn("__prefix", F.substring("__url_digest", 1, PREFIX_DIGITS))
    if few:
        met = asked.join(F.broadcast(keyed), "__prefix", "left")
    else:
        salted = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("__salt", F.pmod(F.col("__row"), F.lit(SALTS)).cast("int")).join(salted, ["__prefix", "__salt"], "left")
    hit = F.max(F.when(F.col("__url_digest") == F.col("__digest"), F.col("__hit"))).alias("__hit")
    # the row number makes every group one row's own expressions, so nothing is skewed and all but one row per URL is merged before the shuffle
    best = met.groupBy("__row", *[f"`{c}`" for c in carry], "host", "path").agg(hit)
    return best.select(*[F.col(f"`{c}`") for c in carry], "host", "path", F.col("__hit.rule").alias("rule"), F.coalesce(F.col("__hit.verdict"), F.lit(default)).alias("verdict"))
