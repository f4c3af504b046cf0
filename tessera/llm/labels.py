"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows to learn from: known 0 or 1, and one for each id (the greater of several)."""
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return of.where(F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
