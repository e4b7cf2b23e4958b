"""Historical water occurrence of patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import square_kilometres

CUTOFFS = (1, 10, 25, 50, 75, 90)


def review_flag(share_50: Column, any_1: Column) -> Column:
    """'majority' from half of the pixels at 50 or more, 'some' from any at 1 or more, else 'none'."""
    return F.when(share_50 >= 50, "majority").when(any_1 > 0, "some").otherwise("none")


def per_patch(points: DataFrame) -> DataFrame:
    """Per patch: occurrence extremes and median, known pixels, pixels and percent at or above every cutoff, review flag."""
    occ = F.when(F.col("occurrence").between(0, 100), F.col("occurrence"))
    out = points.withColumn("occ", occ).groupBy("pair_id", "patch_id").agg(
        F.count("*").alias("pixels"), F.min("occ").alias("occ_min"), F.median("occ").alias("occ_median"), F.max("occ").alias("occ_max"), F.count("occ").alias("water_known_pixels"), *[F.count_if(F.col("occ") >= n).alias(f"occ_ge{n}_pixels") for n in CUTOFFS]
    )
    out = out.withColumns({f"occ_ge{n}_pct": 100.0 * F.col(f"occ_ge{n}_pixels") / F.col("pixels") for n in CUTOFFS})
    return out.withColumn("water_review_flag", review_flag(F.col("occ_ge50_pct"), F.col("occ_ge1_pixels")))


def occurrence_histogram(points: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels per known occurrence 0 to 100, zeros included."""
    counts = points.filter(F.col("occurrence").between(0, 100)).groupBy(*keys, "occurrence").agg(F.count("*").alias("n"))
    frame = points.select(*keys).distinct().withColumn("occurrence", F.explode(F.sequence(F.lit(0), F.lit(100))))
    return frame.join(counts, [*keys, "occurrence"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def exclusion_sensitivity(summary: DataFrame) -> DataFrame:
    """Per cutoff: pixels and area excluded and kept, and patches touched at all, by half and in full."""
    stack = ", ".join(f"{n}, occ_ge{n}_pixels, occ_ge{n}_pct" for n in CUTOFFS)
    long = summary.select("pair_id", "pixels", F.expr(f"stack({len(CUTOFFS)}, {stack}) AS (cutoff, hit, pct)"))
    out = long.groupBy("pair_id", "cutoff").agg(F.sum("hit").alias("excluded_pixels"), F.sum(F.col("pixels") - F.col("hit")).alias("retained_pixels"), F.count_if(F.col("hit") > 0).alias("patches_any"), F.count_if(F.col("pct") >= 50).alias("patches_half"), F.count_if(F.col("hit") == F.col("pixels")).alias("patches_full"))
    return out.withColumns({"excluded_km2": square_kilometres(F.col("excluded_pixels")), "retained_km2": square_kilometres(F.col("retained_pixels"))})


def flag_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("pair_id", "water_review_flag").agg(F.count("*").alias("patches"))


def single_patch(points: DataFrame, patch_id: str) -> DataFrame:
    """The same measures for one patch."""
    return per_patch(points.filter(F.col("patch_id") == patch_id))


def joined_once(patches: DataFrame, summary: DataFrame) -> DataFrame:
    """Patches with their water summary, one to one; a repeated key on either side is an error when the rows are read."""
    def single(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(_by_patch())
        return df.withColumn("__n", n).filter(F.coalesce(F.assert_true(F.col("__n") == 1, F.lit(f"repeated patch_id on the {side}")).isNull(), F.lit(True))).drop("__n")

    return single(patches, "left").join(single(summary, "right").drop("pixels"), ["pair_id", "patch_id"])


def _by_patch():
    from pyspark.sql import Window

    return Window.partitionBy("pair_id", "patch_id")
