"""Queries over change, thresholds, agreement and components, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backscatter, candidates, components
from tidemark.sources.shared import settled

from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {fx.SQL} {sql}" if not sql.startswith("WITH") else sql
        return f

    return keep


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


BANDS = list(backscatter.VALUES)


@query("SELECT pair_id, row, col, " + ", ".join(f"round({b}::DOUBLE, 6) AS {b}" for b in BANDS) + ", common_mask FROM P")
def f04_f05_common_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodata rule and common mask."""
    return rounded(fx.pixels(spark, sf_dir).select("pair_id", "row", "col", *BANDS, "common_mask"), *BANDS)


@query("SELECT pair_id, row, col, support, round(vh_change::DOUBLE, 5) AS vh_change, round(vv_change::DOUBLE, 5) AS vv_change FROM P")
def c01_f06_db_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decibel change on common positive support."""
    p = fx.pixels(spark, sf_dir)
    return p.select("pair_id", "row", "col", "support", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in ("vh_change", "vv_change")))


@query("SELECT pair_id, count(*) FILTER (common_mask <> 255) AS aoi, count(*) FILTER (common_mask <> 255 AND vh_before IS NOT NULL AND vv_before IS NOT NULL) AS valid_before, count(*) FILTER (common_mask <> 255 AND vh_after IS NOT NULL AND vv_after IS NOT NULL) AS valid_after, count(*) FILTER (common_mask = 1) AS common, round(count(*) FILTER (common_mask = 1) / count(*) FILTER (common_mask <> 255), 9) AS fraction FROM P GROUP BY pair_id")
def m01_coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backscatter.coverage_counts(fx.pixels(spark, sf_dir)).withColumn("fraction", F.round("fraction", 9))


@query("SELECT pair_id, date, band, round(min(v)::DOUBLE, 6) AS low, round(max(v)::DOUBLE, 6) AS high, count(*) FILTER (v <= 0) AS not_positive FROM (" + " UNION ALL ".join(f"SELECT pair_id, '{d}' AS date, '{b}' AS band, {b}_{d} AS v FROM P WHERE common_mask <> 255" for d in backscatter.DATES for b in backscatter.BANDS) + ") WHERE v IS NOT NULL GROUP BY ALL")
def m02_band_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backscatter.band_ranges(fx.pixels(spark, sf_dir)), "low", "high")


@query("SELECT pair_id, count(*) FILTER (common_mask <> 255) AS aoi, count(*) FILTER (common_mask = 1) AS common_valid, count(*) FILTER (support) AS common_positive, count(*) FILTER (common_mask = 1) - count(*) FILTER (support) AS excluded_nonpositive FROM P GROUP BY pair_id")
def m03_support_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backscatter.support_counts(fx.pixels(spark, sf_dir))


@query("SELECT f.pair_id, f.coverage, f.water, count(P.pair_id) AS n FROM (SELECT pair_id, coverage, water FROM (SELECT DISTINCT pair_id FROM P), (SELECT unnest([1, 2, 3, 4]) AS coverage), (SELECT unnest(['ge90', 'lt90', 'unknown']) AS water)) f LEFT JOIN P USING (pair_id, coverage, water) GROUP BY ALL")
def m04_f08_f09_coverage_by_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage category by water class."""
    return backscatter.coverage_by_water(fx.pixels(spark, sf_dir))


_LONG = "(SELECT pair_id, 'vh' AS band, vh_change::DOUBLE AS v FROM P UNION ALL SELECT pair_id, 'vv', vv_change::DOUBLE FROM P) WHERE v IS NOT NULL"


@query(f"SELECT pair_id, band, count(*) AS n, round(sum(v), 4) AS total, round(sum(v * v), 4) AS squares, round(min(v), 5) AS low, round(max(v), 5) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM {_LONG} GROUP BY ALL")
def m05_change_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = backscatter.change_moments(fx.pixels(spark, sf_dir))
    return m.select("pair_id", "band", "n", *(F.round(c, d).alias(c) for c, d in (("total", 4), ("squares", 4), ("low", 5), ("high", 5), ("mean", 6), ("deviation", 6))))


@query(f"SELECT pair_id, band, bin, count(v) AS n FROM (SELECT pair_id, band, bin::INT AS bin FROM (SELECT DISTINCT pair_id FROM P), (SELECT unnest(['vh', 'vv']) AS band), (SELECT unnest(range(-1, 121)) AS bin)) LEFT JOIN (SELECT pair_id, band, v, (CASE WHEN v < -30 THEN -1 WHEN v > 30 THEN 120 ELSE least(floor((v + 30) / 0.5::DOUBLE), 119) END)::INT AS bin FROM {_LONG}) USING (pair_id, band, bin) GROUP BY ALL")
def m06_change_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backscatter.change_histogram(fx.pixels(spark, sf_dir))


def _sensitivity_sql() -> str:
    parts = []
    for t, d in candidates.SETTINGS:
        hit = fx.rule_sql(t, d)
        parts.append(
            f"SELECT pair_id, {t} AS july_vh_max_db, {t} AS june_vh_min_exclusive_db, {d} AS delta_vh_max_db, count(*) FILTER ({hit}) AS raw_pixels, count(*) FILTER ({hit} AND water_known AND occurrence >= 90) AS water_ge90_pixels,"
            f" count(*) FILTER ({hit} AND NOT water_known) AS water_unknown_pixels, count(*) FILTER ({hit} AND eligible) AS retained_pixels, count(*) FILTER ({hit} AND eligible AND vv_change < 0) AS vv_decrease_pixels,"
            f" count(*) FILTER (eligible) AS el FROM P GROUP BY pair_id"
        )
    return "SELECT * EXCLUDE (el), round(retained_pixels * 0.0001::DOUBLE, 6) AS retained_area_km2, round(100.0::DOUBLE * retained_pixels / el, 6) AS percent_eligible FROM (" + " UNION ALL ".join(parts) + ")"


@query(_sensitivity_sql())
def m07_threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine settings of darkness and drop."""
    return rounded(candidates.sensitivity(fx.pixels(spark, sf_dir)), "retained_area_km2", "percent_eligible")


@query("SELECT pair_id, count(*) FILTER (support) AS support, count(*) FILTER (eligible) AS eligible, count(*) FILTER (support AND water_known AND occurrence >= 90) AS water, count(*) FILTER (support AND NOT water_known) AS unknown FROM P GROUP BY pair_id")
def m08_eligibility_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.eligibility_totals(fx.pixels(spark, sf_dir))


@query("SELECT pair_id, row, col, CASE WHEN eligible THEN " + " + ".join(f"({fx.rule_sql(t, d)})::INT" for t, d in candidates.SETTINGS) + " ELSE 255 END AS agreement FROM P")
def m09_j03_threshold_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the nine settings."""
    return candidates.with_votes(fx.pixels(spark, sf_dir)).select("pair_id", "row", "col", "agreement")


@query(f"SELECT pair_id, row, col, CASE WHEN NOT eligible THEN 255 WHEN {fx.rule_sql(*candidates.CHOSEN)} THEN 1 ELSE 0 END AS candidate FROM P")
def f07_f16_candidate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rule in three states."""
    p = fx.pixels(spark, sf_dir)
    return p.select("pair_id", "row", "col", candidates.three_state(candidates.rule(*candidates.CHOSEN), F.col("eligible")).alias("candidate"))


LABELS_SQL = f"""cand AS MATERIALIZED (SELECT pair_id, row, col, row::BIGINT * 2147483648 + col AS num FROM P WHERE eligible AND {fx.rule_sql(*candidates.CHOSEN)}),
adj AS MATERIALIZED (SELECT a.pair_id, a.num AS a, b.num AS b FROM cand a JOIN cand b ON a.pair_id = b.pair_id AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND a.num <> b.num),
reach AS (SELECT pair_id, num AS node, num AS label FROM cand UNION SELECT adj.pair_id, adj.b, reach.label FROM reach JOIN adj ON adj.pair_id = reach.pair_id AND adj.a = reach.node),
lab AS MATERIALIZED (SELECT pair_id, row, col, label FROM (SELECT *, num AS node FROM cand) JOIN (SELECT pair_id, node, min(label) AS label FROM reach GROUP BY ALL) USING (pair_id, node))"""


def with_labels(sql: str) -> str:
    return f"WITH RECURSIVE {fx.SQL}, {LABELS_SQL} {sql}"


def labels(spark: SparkSession, sf_dir: str, tile: int = 64) -> DataFrame:
    return components.labelled(candidates.selected(fx.pixels(spark, sf_dir)), tile)


@query(with_labels("SELECT pair_id, row, col, label FROM lab"))
def w02_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-connected labels."""
    return labels(spark, sf_dir)


@query(with_labels("SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY label)::INT AS component_id, printf('C%04d', row_number() OVER (PARTITION BY pair_id ORDER BY label)) AS patch_id, label, pixels FROM (SELECT pair_id, label, count(*) AS pixels FROM lab GROUP BY ALL)"))
def w03_component_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan-order numbers and sizes."""
    return components.ranked(components.component_sizes(labels(spark, sf_dir)))


@query(with_labels("SELECT pair_id, row, col, label FROM lab JOIN (SELECT pair_id, label FROM lab GROUP BY ALL HAVING count(*) >= 9) USING (pair_id, label)"))
def w04_u02_remove_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of components of nine pixels or more."""
    return components.without_small(labels(spark, sf_dir), 9)


@query(with_labels("SELECT pair_id, n AS min_pixels, n * 100 AS min_area_m2, coalesce(sum(pixels) FILTER (pixels >= n), 0)::BIGINT AS retained_pixels, round(coalesce(sum(pixels) FILTER (pixels >= n), 0) * 0.0001::DOUBLE, 6) AS retained_area_km2 FROM (SELECT pair_id, label, count(*) AS pixels FROM lab GROUP BY ALL), (SELECT unnest([9, 25, 100]) AS n) GROUP BY ALL"))
def m10_cleanup_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = candidates.cleanup_sweep(components.component_sizes(labels(spark, sf_dir)))
    return rounded(swept, "retained_area_km2")


_BIG = "(SELECT pair_id, row, col FROM lab JOIN (SELECT pair_id, label FROM lab GROUP BY ALL HAVING count(*) >= 9) USING (pair_id, label))"


@query(with_labels(f"SELECT pair_id, row, col FROM (SELECT pair_id, row, col + 1 AS col FROM {_BIG} WHERE (row + col) % 5 = 0 UNION SELECT pair_id, row, col FROM {_BIG}) EXCEPT SELECT pair_id, row, col FROM cand"))
def u01_cleaned_is_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned pixels that are no raw candidates: none of the true ones, but those planted beside them."""
    chosen = settled(candidates.selected(fx.pixels(spark, sf_dir)).select("pair_id", "row", "col"))
    clean = components.without_small(components.labelled(chosen, 64), 9).select("pair_id", "row", "col")
    planted = clean.filter((F.col("row") + F.col("col")) % 5 == 0).withColumn("col", F.col("col") + 1)
    return clean.unionByName(planted).distinct().join(chosen, ["pair_id", "row", "col"], "left_anti")
