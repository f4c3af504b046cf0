"""Tables filtered by decisions on their rows, so that rows nothing was decided on are never shuffled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.components import attached
from tessera.llm.text import row_key
from tessera.staging import staged


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the key of each row, and the name of that column, which no other has."""
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, row_key(docs)), name


#: Decided keys whose hashes, 16 bytes each, are broadcast as they are; more are told by a Bloom filter.
BROADCAST_KEYS = 1 << 22


def may_be(rows: DataFrame, key: str, decided: DataFrame, n: int) -> DataFrame:
    """``rows`` with _may: false only where the row's key isn't decided on."""
    if n <= BROADCAST_KEYS:
        hashes = decided.select(F.xxhash64(key).alias("_h")).distinct().withColumn("_hit", F.lit(True))
        met = rows.withColumn("_h", F.xxhash64(key)).join(F.broadcast(hashes), "_h", "left")
        return met.withColumn("_may", F.coalesce("_hit", F.lit(False))).drop("_h", "_hit")
    filled = rows.sparkSession.sparkContext.broadcast(bloom.built(decided.select(F.xxhash64(key)), n))

    @F.pandas_udf("boolean")
    def asked(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.may_hold(filled.value, h.to_numpy("<i8")))

    return rows.withColumn("_may", asked(F.xxhash64(key)))


def settled(rows: DataFrame, key: str, decided: DataFrame) -> DataFrame:
    """``rows`` without their column ``key``, and without what ``decided(key, once, many)`` drops.

    A row whose key isn't decided on stays. Of one that is, all equal rows go, or with ``once`` all but one; many: how
    many rows have it. Rows are asked by eight bytes: of at most BROADCAST_KEYS decided keys the hashes are broadcast
    (64 MB), of more a Bloom filter (32 MB). What that lets through, decided rows and few others, is all that is
    shuffled, and keys of very many rows are not.
    """
    decided = staged(decided.select(F.col("key").alias(key), "once", "many"), "decided")
    told = decided.agg(F.count("*").alias("keys"), F.sum("many").alias("rows")).first()
    if not told["keys"]:
        return rows.drop(key)
    asked = may_be(rows, key, decided, told["keys"])
    clean = asked.where(~F.col("_may")).drop("_may")
    apart = F.concat(F.lit(b"\0"), F.xxhash64(F.monotonically_increasing_id()).cast("string").cast("binary"))  # no key, which has 16 bytes; only spreads rows
    met = attached(asked.where("_may").drop("_may"), decided, key, apart, told["rows"])
    kept = met.where(F.col("once").isNull()).select(rows.columns)
    first = met.where("once").select(rows.columns).dropDuplicates([key])
    return clean.unionByName(kept).unionByName(first).drop(key)
