"""Intermediate results in storage that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

ColumnOrName = Column | str


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a temporary folder where it is unset on a single machine, as in local tests.

    On several machines an unset folder is an error: what one writes locally, others would miss.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables that are read several times."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder, for larger ones: compressed, and later reads choose columns."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: ColumnOrName) -> DataFrame:
    """Rows dealt over all tasks by the hash of ``by``, for steps that cost much a row: a fixed count, which is not merged again because the rows are small."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)
