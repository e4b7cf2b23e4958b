"""A training-corpus pipeline: quality rules, near-dedup, repeated spans, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it back for the next.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_dups, packing, quality, suffix_dedup
from tidemark.llm.stable import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null, empty and short texts go, an empty table stays empty."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more), that of the smallest id.

    Documents without words are linked with nothing and stay; rows with equal or null ids are documents of their own.
    """
    return near_dups.drop_near_duplicates(docs)


def _whole(docs: DataFrame, *names: str) -> DataFrame:
    """The given columns, and all columns as a struct, so that added columns clash with none."""
    return docs.select(*[F.col(f"`{n}`") for n in names], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that an earlier one has; ``n_chars`` follows the text.

    A document of which no word is left goes, unless nothing was removed from it: null and empty texts stay.
    """
    # the text travels once; whether it was null goes with the other columns
    others = F.struct(F.col("text").isNull().alias("null"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("columns"))
    cut = suffix_dedup.deduplicate(docs.select("doc_id", "text", others.alias("row")), ["row"], with_text=True)
    cut = cut.filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(mixing.WORD))

    def value(c: str) -> Column:
        if c == "text":
            return F.when(~F.col("row.null"), F.col("kept_text"))
        old = F.col("row.columns")[c]
        return F.when(F.col("n_removed") == 0, old).otherwise(F.char_length("kept_text").cast(docs.schema[c].dataType)) if c == "n_chars" else old

    return cut.select(*[value(c).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it, longer ones with more chance; those without words go."""
    mixed = mixing.mix(_whole(docs, "doc_id", "text", "source"), by_length=True).filter("copies > 0")
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of the permitted lengths; a document without words is one empty piece."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("span_dedup", span_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Near-duplicate components of the banded candidates, byte spans and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
