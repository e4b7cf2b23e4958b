"""Stable row numbers, and the intermediate storage of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import fresh_path, settled, shared_folder, stored

__all__ = ["fresh_path", "numbered", "settled", "shared_folder", "stored"]


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "ord") -> DataFrame:
    """Add a unique long ``name`` that ascends with the id.

    Where ids are integers, unique and not null it is the id itself.  Otherwise
    rows are numbered in the order of id (null first) and a hash of the text, and
    stored, so that later reads agree.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    whole = isinstance(ids.schema["id"].dataType, T.IntegralType)
    if whole and ids.groupBy("id").count().filter("id IS NULL OR count > 1").limit(1).count() == 0:
        return docs.withColumn(name, F.col(f"`{id_col}`").cast("long"))
    ordered = docs.orderBy(F.col(f"`{id_col}`").asc_nulls_first(), F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    return stored(ordered.withColumn(name, F.monotonically_increasing_id()))
