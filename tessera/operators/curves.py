"""Operators on curves in long form (id, t, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rna import hill


def interpolated(df: DataFrame, key: str, t: str, value: str, at: float) -> DataFrame:
    """(key, value) at ``at`` by linear interpolation, clamped at the ends; missing points are left out."""
    known = df.where(F.col(value).isNotNull())
    point = F.struct(F.col(t).cast("double").alias("t"), F.col(value).alias("v"))
    ends = known.groupBy(key).agg(F.max(F.when(F.col(t) <= at, point)).alias("a"), F.min(F.when(F.col(t) >= at, point)).alias("b"))
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * F.coalesce(F.try_divide(F.lit(at) - F.col("a.t"), F.col("b.t") - F.col("a.t")), F.lit(0.0))
    return ends.select(key, F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(between).alias(value))


def ribbon(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, quartiles, half-width of the 95 % interval of the mean, and n."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.percentile(value, 0.25).alias("q25"),
        F.percentile(value, 0.75).alias("q75"),
        (1.96 * F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value)))).alias("ci"),
    )


def grid(spark: SparkSession, low: int, high: int) -> DataFrame:
    """(t) from low to high; a fixed small table."""
    return spark.range(low, high + 1).select(F.col("id").cast("double").alias("t"))


def evaluated(df: DataFrame, key: list[str], temps: list[float], bottom: Column, top: Column, tm: Column, n: Column) -> DataFrame:
    """The curve of each row's parameters at each temperature."""
    t = F.explode(F.array(*map(F.lit, temps))).alias("t")
    return df.select("*", t).select(*key, "t", hill(F.col("t"), bottom, top, tm, n).alias("value"))


def hill_fit(df: DataFrame, key: str, t: str, value: str, tms: list[float], slopes: list[float]) -> DataFrame:
    """(key, tm, n, bottom, top, sse, status) of the best cell of a grid of melting points and slopes.

    In a cell the curve is linear in bottom and top, so each cell's best fit is a regression on the cell's shape. Ties
    go to the lower melting point, then the lower slope. A range below 1e-6 is 'flat', with no fit.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("tm"), F.lit(b).alias("n")) for a in tms for b in slopes))).alias("c")
    known = df.where(F.col(value).isNotNull()).select(key, F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("y"))
    shape = hill(F.col("t"), F.lit(0.0), F.lit(1.0), F.col("c.tm"), F.col("c.n"))
    per = known.select(key, "t", "y", cells).withColumn("s", shape).groupBy(key, "c").agg(
        F.regr_slope("y", "s").alias("slope"), F.regr_intercept("y", "s").alias("bottom"), F.regr_syy("y", "s").alias("syy"), F.regr_sxy("y", "s").alias("sxy"), (F.max("y") - F.min("y")).alias("range")
    )
    fit = F.struct(F.round(F.col("syy") - F.coalesce(F.col("slope") * F.col("sxy"), F.lit(0.0)), 12).alias("sse"), F.col("c.tm").alias("tm"), F.col("c.n").alias("n"), "bottom", (F.col("bottom") + F.col("slope")).alias("top"))
    best = per.groupBy(key).agg(F.min(F.when(F.col("slope").isNotNull(), fit)).alias("f"), F.max("range").alias("range"))
    ok = F.col("range") >= 1e-6
    return best.select(key, *(F.when(ok, F.col(f"f.{c}")).alias(c) for c in ("tm", "n", "bottom", "top", "sse")), F.when(ok, "ok").otherwise("flat").alias("status"))


def engine_fits(df: DataFrame, key: str, t: str, engines: dict[str, str], tms: list[float], slopes: list[float]) -> DataFrame:
    """One row for each key: tm, n, bottom, top, amplitude and status of every engine's curve, with the engine's name as suffix.

    ``engines``: name -> column of the measured value. All curves are fitted in one pass over the long table.
    """
    long = df.select(F.col(key).alias("_id"), F.col(t).alias("_t"), F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.col(c).cast("double").alias("y")) for e, c in engines.items()))).alias("x"))
    fit = hill_fit(long.select(F.struct("_id", "x.e").alias("k"), "_t", F.col("x.y").alias("y")), "k", "_t", "y", tms, slopes)
    values = F.struct("tm", "n", "bottom", "top", (F.col("top") - F.col("bottom")).alias("amplitude"), "status")
    wide = fit.groupBy(F.col("k._id").alias(key)).agg(*(F.max(F.when(F.col("k.e") == e, values)).alias(f"_{e}") for e in engines))
    return wide.select(key, *(F.col(f"_{e}.{c}").alias(f"{c}_{e}") for e in engines for c in ("tm", "n", "bottom", "top", "amplitude", "status")))


def half_width(df: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """(peak_t, peak, left, right): the peak and the nearest points on either side that lie below half of it."""
    peak = df.groupBy(*by).agg(F.max_by(F.struct(F.col(t).alias("t"), F.col(value).alias("v")), F.struct(F.col(value), -F.col(t))).alias("_peak"))
    near = df.join(peak, by)
    low = F.col(value) < F.col("_peak.v") / 2
    return near.groupBy(*by).agg(
        F.first("_peak.t").alias("peak_t"),
        F.first("_peak.v").alias("peak"),
        F.max(F.when(low & (F.col(t) < F.col("_peak.t")), F.col(t))).alias("left"),
        F.min(F.when(low & (F.col(t) > F.col("_peak.t")), F.col(t))).alias("right"),
    )
