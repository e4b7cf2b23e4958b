"""Newly dark pixels under threshold settings, historical water and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import near, square_kilometres

#: Nine settings of darkness and drop, in dB.
SETTINGS = tuple((t, d) for t in (-18, -21, -24) for d in (-2, -3, -4))
CHOSEN = (-21, -3)
#: Smallest component sizes of the cleanup sweep, in pixels.
SIZES = (9, 25, 100)


def candidate(before: Column, after: Column, delta: Column, valid: Column, dark: float, drop: float) -> Column:
    """Brighter than ``dark`` before, at most that after, and fallen by ``drop`` or more."""
    return F.coalesce(valid & (before > dark) & (after <= dark) & (delta <= drop), F.lit(False))


def rule(dark: float, drop: float, valid: str = "support") -> Column:
    return candidate(F.col("vh_before_db"), F.col("vh_after_db"), F.col("vh_change"), F.col(valid), dark, drop)


def with_eligibility(pixels: DataFrame) -> DataFrame:
    """``water_known`` and ``eligible``: on the support, occurrence known and below 90."""
    sure = F.coalesce(F.col("occurrence").between(0, 100), F.lit(False))
    return pixels.withColumn("water_known", sure).withColumn("eligible", F.col("support") & sure & (F.col("occurrence") < 90))


def eligibility_totals(pixels: DataFrame) -> DataFrame:
    """Per pair: support = eligible + water + unknown."""
    return pixels.groupBy("pair_id").agg(
        F.count_if("support").alias("support"),
        F.count_if("eligible").alias("eligible"),
        F.count_if(F.col("support") & F.col("water_known") & (F.col("occurrence") >= 90)).alias("water"),
        F.count_if(F.col("support") & ~F.col("water_known")).alias("unknown"),
    )


def sensitivity(pixels: DataFrame, settings: tuple[tuple[int, int], ...] = SETTINGS) -> DataFrame:
    """A row per pair and setting; all settings are counted in one pass without multiplying pixels."""
    counts = [F.count_if("eligible").alias("eligible")]
    for i, (dark, drop) in enumerate(settings):
        hit = rule(dark, drop)
        counts += [
            F.count_if(hit).alias(f"raw_{i}"),
            F.count_if(hit & F.col("water_known") & (F.col("occurrence") >= 90)).alias(f"water_{i}"),
            F.count_if(hit & ~F.col("water_known")).alias(f"unknown_{i}"),
            F.count_if(hit & F.col("eligible")).alias(f"retained_{i}"),
            F.count_if(hit & F.col("eligible") & (F.col("vv_change") < 0)).alias(f"vv_{i}"),
        ]
    wide = pixels.groupBy("pair_id").agg(*counts)
    rows = ", ".join(f"{t}, {t}, {d}, raw_{i}, water_{i}, unknown_{i}, retained_{i}, vv_{i}" for i, (t, d) in enumerate(settings))
    names = "july_vh_max_db, june_vh_min_exclusive_db, delta_vh_max_db, raw_pixels, water_ge90_pixels, water_unknown_pixels, retained_pixels, vv_decrease_pixels"
    out = wide.select("pair_id", "eligible", F.expr(f"stack({len(settings)}, {rows}) AS ({names})"))
    out = out.withColumn("retained_area_km2", square_kilometres(F.col("retained_pixels")))
    return out.withColumn("percent_eligible", F.when(F.col("eligible") > 0, 100.0 * F.col("retained_pixels") / F.col("eligible"))).drop("eligible")


def with_votes(pixels: DataFrame, settings: tuple[tuple[int, int], ...] = SETTINGS) -> DataFrame:
    """``agreement``: number of settings that select an eligible pixel; 255 elsewhere."""
    votes = sum((rule(t, d).cast("int") for t, d in settings), F.lit(0))
    return pixels.withColumn("agreement", F.when(F.col("eligible"), votes).otherwise(255))


def three_state(selected: Column, eligible: Column) -> Column:
    """1 selected, 0 eligible but not selected, 255 excluded or unobserved."""
    return F.when(~F.coalesce(eligible, F.lit(False)), 255).when(F.coalesce(selected, F.lit(False)), 1).otherwise(0)


def selected(pixels: DataFrame, dark: int = CHOSEN[0], drop: int = CHOSEN[1]) -> DataFrame:
    """The eligible pixels that a setting selects."""
    return pixels.filter(F.col("eligible") & rule(dark, drop))


def cleanup_sweep(sized: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Per pair and minimum size: pixels kept, from components with ``pixels``."""
    counts = [F.sum(F.when(F.col("pixels") >= n, F.col("pixels")).otherwise(0)).alias(f"kept_{n}") for n in sizes]
    wide = sized.groupBy("pair_id").agg(*counts)
    out = wide.select("pair_id", F.expr(f"stack({len(sizes)}, " + ", ".join(f"{n}, kept_{n}" for n in sizes) + ") AS (min_pixels, retained_pixels)"))
    return out.withColumn("min_area_m2", F.col("min_pixels") * 100).withColumn("retained_area_km2", square_kilometres(F.col("retained_pixels")))


def rule_violations(points: DataFrame, dark: int = CHOSEN[0], drop: int = CHOSEN[1]) -> DataFrame:
    """Points that break the rule they were selected by, or whose change is not after less before; none expected."""
    fine = (F.col("june_vh_db") > dark) & (F.col("july_vh_db") <= dark) & (F.col("delta_vh_db") <= drop)
    fine = fine & near(F.col("delta_vh_db").cast("double"), F.col("july_vh_db").cast("double") - F.col("june_vh_db").cast("double"), 1e-5)
    return points.filter(~F.coalesce(fine, F.lit(False)))
