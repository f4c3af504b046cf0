"""Reports on matches, null models, pair probabilities and novelty, each one or two grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The buckets of novelty.
BUCKETS = ("identical_near", "remote_homolog", "no_hit")


def match_report(left: DataFrame, right: DataFrame, matched: DataFrame, key: str, length: str, gc: str, cost: str = "cost") -> DataFrame:
    """One row: how many of ``left`` were matched, what a match changes, and who was left over.

    ``matched(a, b, cost)``: keys of ``left`` and ``right``. Deltas are matched left minus matched right (means, sample
    deviation of the length); null without a match. Quantiles of the length of left rows without a match; truncation_risk:
    one of them is longer than every right row.
    """
    a = left.select(F.col(key).alias("a"), F.col(length).cast("double").alias("la"), F.col(gc).alias("ga"))
    b = right.select(F.col(key).alias("b"), F.col(length).cast("double").alias("lb"), F.col(gc).alias("gb"))
    full = a.join(matched.select("a", "b", F.col(cost).alias("cost"), F.lit(True).alias("on")), "a", "left").join(b, "b", "left")
    rest = F.when(F.col("on").isNull(), F.col("la"))
    on = lambda c: F.when(F.col("on"), F.col(c))
    told = full.agg(
        F.count("*").alias("n"), F.count_if("on").alias("n_matched"), (F.avg(on("la")) - F.avg(on("lb"))).alias("delta_length"), (F.avg(on("ga")) - F.avg(on("gb"))).alias("delta_gc"),
        (F.stddev_samp(on("la")) - F.stddev_samp(on("lb"))).alias("delta_deviation"), F.avg(on("cost")).alias("mean_cost"), *(F.percentile(rest, q).alias(f"left_q{int(100 * q)}") for q in (0.5, 0.75, 0.9, 1.0)), F.max(rest).alias("_longest"),
    )
    most = right.agg(F.max(F.col(length).cast("double")).alias("_most"))
    n = told.join(F.broadcast(most))  # one row each
    share = (F.col("n") - F.col("n_matched")) / F.greatest(F.col("n"), F.lit(1))
    risk = F.coalesce(F.col("_longest") > F.col("_most"), F.lit(False))
    return n.select(*told.columns[:-1], (F.col("n") - F.col("n_matched")).alias("n_left"), share.alias("left_share"), risk.alias("truncation_risk"))


def null_z(values: DataFrame, nulls: DataFrame, key: str, value: str, mode: str) -> DataFrame:
    """(key, z, n, mode): each value against its nulls' mean, by their population deviation (1e-6 at least), and the mode most of its nulls have.

    Of modes equally often, the least. Values that are missing, or without a null, have no z.
    """
    per = nulls.where(F.col(value).isNotNull()).groupBy(key, mode).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    # the variance of all is that within modes and that of their means
    both = per.groupBy(key).agg(n.alias("n"), mean.alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.collect_list(F.struct("n", "m")).alias("means"), F.min_by(mode, F.struct(-F.col("n"), mode)).alias("mode"))
    between = F.aggregate("means", F.lit(0.0), lambda a, x: a + x["n"] * F.pow(x["m"] - F.col("mean"), 2))
    full = values.select(key, F.col(value).alias("_x")).join(both, key, "left")
    z = (F.col("_x") - F.col("mean")) / F.greatest(F.sqrt((F.col("within") + between) / F.col("n")), F.lit(1e-6))
    return full.select(key, z.alias("z"), F.coalesce("n", F.lit(0)).alias("n"), "mode")


def positional_entropy(pairs: DataFrame, lengths: DataFrame, key: str, i: str, j: str, p: str, length: str) -> DataFrame:
    """(key, entropy): the mean over a sequence's positions of -sum p log2 p over a position's partners and over having none.

    ``pairs``: one row a pair, i and j from 1; a pair counts at both ends. ``lengths(key, length)``: positions without any pair are
    certain, so they add nothing but count. An empty sequence has 0.
    """
    both = pairs.select(key, F.explode(F.array(F.col(i), F.col(j))).alias("_at"), F.col(p).alias("_p")).where("_p > 0")
    told = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    at = both.groupBy(key, "_at").agg((F.sum(told(F.col("_p"))) + told(F.greatest(F.lit(0.0), 1 - F.sum("_p")))).alias("_h"))
    sums = at.groupBy(key).agg(F.sum("_h").alias("_h"))
    return lengths.join(sums, key, "left").select(key, F.coalesce(F.try_divide(F.coalesce("_h", F.lit(0.0)), F.col(length)), F.lit(0.0)).alias("entropy"))


def novelty(rows: DataFrame, bucket: Column, hits: dict[str, Column]) -> DataFrame:
    """(bucket, n, share, n_<tool>): rows of each bucket, absent ones too, their share of all, and how many have a hit of each tool."""
    told = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{t}") for t, c in hits.items()))
    every = rows.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    full = F.broadcast(every).join(told, "bucket", "left").na.fill(0)
    total = rows.agg(F.count("*").alias("_t"))
    return full.join(F.broadcast(total)).select("bucket", "n", F.coalesce(F.try_divide("n", "_t"), F.lit(0.0)).alias("share"), *(f"n_{t}" for t in hits))  # one row


def intensive(df: DataFrame, length: str, ratios: dict[str, str]) -> DataFrame:
    """Adds each ratio (name -> column) of a present column to the length; null where the length is 0 or missing."""
    if length not in df.columns:
        raise ValueError(f"{length} is required")
    return df.select("*", *(F.try_divide(F.col(c).cast("double"), F.nullif(F.col(length), F.lit(0))).alias(n) for n, c in ratios.items() if c in df.columns))
