"""Connected components of an edge table by alternating large-star and small-star steps, and joins that bear hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.staging import staged

#: Rows of one key that may meet in a task, and keys with more rows than that which are broadcast.
HOT, BROADCAST = 10_000, 100_000


def attached(left: DataFrame, right: DataFrame, key: str, apart, rows: int) -> DataFrame:
    """``left`` with the columns of ``right`` (one row for each key; its column ``many``: how many of ``left``'s ``rows`` have it).

    Keys of many rows never come together: at most BROADCAST of them are broadcast (a key of more than rows / BROADCAST
    rows is one of fewer than BROADCAST). Their rows then take part in the join of the others under keys of their own,
    ``apart``, that match nothing. A row whose key isn't there gets nulls.
    """
    most = max(HOT, rows // BROADCAST)
    names = [c for c in right.columns if c not in (key, "many")]
    hot = right.where(F.col("many") > most).select(key, *(F.col(c).alias(f"_h_{c}") for c in names), F.lit(True).alias("_hot"))
    few = right.where(F.col("many") <= most).select(F.col(key).alias("_match"), *(F.col(c).alias(f"_c_{c}") for c in names))
    full = left.join(F.broadcast(hot), key, "left").withColumn("_at", F.when(F.col("_hot"), apart).otherwise(F.col(key)))
    full = full.join(few, F.col("_at") == F.col("_match"), "left")
    return full.select(*left.columns, *(F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in names))


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and two 64-bit hashes of a set of edges, in whatever order."""
    return tuple(edges.agg(F.count("*"), *(F.bit_xor(F.xxhash64("a", "b", F.lit(k))) for k in (0, 1))).first())


def _with_least(edges: DataFrame, least: DataFrame, degree: int, n: int) -> DataFrame:
    """``edges`` with m, the least neighbour of a; no node has more than ``degree`` edges."""
    if degree <= HOT:
        return edges.join(least, "a")
    return attached(edges, staged(least, "least"), "a", -1 - F.pmod(F.xxhash64("a", "b"), F.lit(1 << 62)), 2 * n)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``edges(a, b)``, both longs from 0; label: the least node it is linked with.

    A node with very many edges is never gathered: its least neighbour is an aggregate, and comes back to its edges by
    ``attached``, in rounds in which there is such a node.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    told = _fingerprint(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").count().agg(F.max("count")).first()[0] or 0
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("many"))
        large = _with_least(both, least, degree, told[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("many"))
        small = _with_least(large, least, degree, told[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        now = staged(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        before, told = told, _fingerprint(now)
        if before == told:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
