"""Common support, decibel change, coverage and change statistics of pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import NODATA, change, decibel, finite, known

BANDS = ("vh", "vv")
DATES = ("before", "after")
VALUES = tuple(f"{b}_{d}" for d in DATES for b in BANDS)
#: Change histogram: bins of half a decibel from -30 to 30, the last one closed.
LOW, HIGH, STEP = -30.0, 30.0, 0.5
BINS = int((HIGH - LOW) / STEP)


def aligned(before: DataFrame, after: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ("pair_id", "row", "col")) -> DataFrame:
    """One row per pixel of the grid of ``before``, with the bands of both dates and the mask.

    ``before`` and ``after`` hold vh and vv of one date, ``mask`` pair_mask.  A
    pixel that the later date or the mask lacks has nulls there: it is unobserved,
    not dry.  All three are joined on the same keys, so they are shuffled once each
    at most, and not at all where they are stored by these keys.
    """
    one = before.select(*keys, *[F.col(b).alias(f"{b}_before") for b in BANDS])
    two = after.select(*keys, *[F.col(b).alias(f"{b}_after") for b in BANDS])
    return one.join(two, list(keys), "left").join(mask.select(*keys, "pair_mask"), list(keys), "left")


def without_nodata(pixels: DataFrame, *missing: float) -> DataFrame:
    """Null instead of NaN, infinities and the nodata marks (-9999 unless given) in all bands."""
    return pixels.withColumns({c: known(F.col(c), *(missing or (NODATA,))) for c in VALUES})


def common_mask(pixels: DataFrame, inside: Column) -> DataFrame:
    """``common_mask``: 1 where all bands of both dates are known, 0 where one is missing, 255 outside the area."""
    every = F.lit(True)
    for c in VALUES:
        every = every & F.col(c).isNotNull()
    return pixels.withColumn("common_mask", F.when(~F.coalesce(inside, F.lit(False)), 255).when(every, 1).otherwise(0))


def with_support(pixels: DataFrame) -> DataFrame:
    """``support``: known in both dates and bands and positive in all of them."""
    positive = F.col("common_mask") == 1
    for c in VALUES:
        positive = positive & F.coalesce(F.col(c) > 0, F.lit(False))
    return pixels.withColumn("support", positive)


def with_decibels(pixels: DataFrame) -> DataFrame:
    """Decibels per band and date and their change, on the common support only."""
    out = pixels.withColumns({f"{c}_db": F.when(F.col("support"), decibel(F.col(c))) for c in VALUES})
    return out.withColumns({f"{b}_change": change(F.col(f"{b}_before_db"), F.col(f"{b}_after_db")) for b in BANDS})


def prepared(pixels: DataFrame, inside: Column) -> DataFrame:
    """Nodata rule, common mask, support and change in one projection."""
    return with_decibels(with_support(common_mask(without_nodata(pixels), inside)))


def coverage_code(mask: Column, footprint: Column) -> Column:
    """1 valid inside the footprint, 2 missing inside, 3 missing outside, 4 valid outside, 255 outside the area."""
    return F.when(mask == 255, 255).when(footprint & (mask == 1), 1).when(footprint, 2).when(mask == 0, 3).otherwise(4)


def water_class(occurrence: Column) -> Column:
    """'ge90', 'lt90' or 'unknown' (anything but 0 to 100)."""
    sure = occurrence.between(0, 100)
    return F.when(sure & (occurrence >= 90), "ge90").when(sure, "lt90").otherwise("unknown")


def coverage_counts(pixels: DataFrame) -> DataFrame:
    """Per pair: pixels of the area, known per date, known in common and their fraction."""
    inside = F.col("common_mask") != 255
    per_date = {d: inside & F.col(f"vh_{d}").isNotNull() & F.col(f"vv_{d}").isNotNull() for d in DATES}
    out = pixels.groupBy("pair_id").agg(F.count_if(inside).alias("aoi"), *(F.count_if(per_date[d]).alias(f"valid_{d}") for d in DATES), F.count_if(F.col("common_mask") == 1).alias("common"))
    return out.withColumn("fraction", F.when(F.col("aoi") > 0, F.col("common") / F.col("aoi")))


def band_ranges(pixels: DataFrame) -> DataFrame:
    """Per pair, date and band: smallest and largest known value and how many are not positive."""
    stack = F.expr("stack(4, " + ", ".join(f"'{d}', '{b}', {b}_{d}" for d in DATES for b in BANDS) + ") AS (date, band, value)")
    values = pixels.filter("common_mask != 255").select("pair_id", stack).filter("value IS NOT NULL")
    return values.groupBy("pair_id", "date", "band").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value") <= 0).alias("not_positive"))


def support_counts(pixels: DataFrame) -> DataFrame:
    """Per pair: area, known in common, positive in common, excluded for not being positive."""
    out = pixels.groupBy("pair_id").agg(F.count_if(F.col("common_mask") != 255).alias("aoi"), F.count_if(F.col("common_mask") == 1).alias("common_valid"), F.count_if("support").alias("common_positive"))
    return out.withColumn("excluded_nonpositive", F.col("common_valid") - F.col("common_positive"))


def coverage_by_water(pixels: DataFrame) -> DataFrame:
    """Per pair: the 4 x 3 table of coverage codes and water classes, zero rows kept."""
    counts = pixels.filter("coverage != 255").groupBy("pair_id", "coverage", "water").agg(F.count("*").alias("n"))
    frame = pixels.select("pair_id").distinct().select("pair_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("coverage"))
    frame = frame.select("pair_id", "coverage", F.explode(F.array(*map(F.lit, ("ge90", "lt90", "unknown")))).alias("water"))
    return frame.join(counts, ["pair_id", "coverage", "water"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _long(pixels: DataFrame) -> DataFrame:
    return pixels.select("pair_id", F.expr("stack(2, 'vh', vh_change, 'vv', vv_change) AS (band, v)")).filter("v IS NOT NULL").withColumn("v", F.col("v").cast("double"))


def change_moments(pixels: DataFrame) -> DataFrame:
    """Per pair and band: count, sum, sum of squares, extremes, mean and population deviation of the change."""
    v = F.col("v")
    return _long(pixels).groupBy("pair_id", "band").agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))


def histogram(values: DataFrame, keys: list[str], value: str, low: float = LOW, high: float = HIGH, step: float = STEP) -> DataFrame:
    """Counts per key and bin, empty bins included; bin -1 is below ``low`` and the one past the last above ``high``."""
    bins = round((high - low) / step)
    v = F.col(value)
    where = F.when(v < low, -1).when(v > high, bins).otherwise(F.least(F.floor((v - low) / step), F.lit(bins - 1))).cast("int")
    counts = values.filter(v.isNotNull() & finite(v)).groupBy(*keys, where.alias("bin")).agg(F.count("*").alias("n"))
    frame = values.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(-1), F.lit(bins))))
    return frame.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def change_histogram(pixels: DataFrame) -> DataFrame:
    return histogram(_long(pixels), ["pair_id", "band"], "v")
