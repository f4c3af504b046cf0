"""Statistics as table operators.

Ranks, distribution functions and tests come from tables of value counts with prefix sums over ranges of values, so no
window spans a whole table. P-values are finished from a few aggregates; they are always the asymptotic ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import staged


def cumulative(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Adds cum_<value> (inclusive prefix sums by ``order`` within ``by``) and next (the following ``order``, null at the end).

    ``order`` is unique within ``by``. Rows are laid out by ranges; each range is summed on its own and gets the sum of
    the ranges before it.
    """
    laid = staged(df.repartitionByRange(*by, order).withColumn("_p", F.spark_partition_id()), "ranges")
    local = Window.partitionBy(*by, "_p").orderBy(order)
    own = laid.select("*", *(F.sum(v).over(local.rowsBetween(Window.unboundedPreceding, 0)).alias(f"cum_{v}") for v in values), F.lead(order).over(local).alias("next"))
    per = laid.groupBy(*by, "_p").agg(*(F.sum(v).alias(f"_{v}") for v in values), F.min(order).alias("_first"))
    across = Window.partitionBy(*by).orderBy("_p")  # one row for each range
    offsets = per.select(*by, "_p", *(F.coalesce(F.sum(f"_{v}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{v}") for v in values), F.lead("_first").over(across).alias("_next"))
    full = own.join(F.broadcast(offsets) if not by else offsets, [*by, "_p"])
    return full.select(*df.columns, *((F.col(f"cum_{v}") + F.col(f"_{v}")).alias(f"cum_{v}") for v in values), F.coalesce("next", "_next").alias("next"))


def side_counts(df: DataFrame, by: list[str], value: str, side: Column) -> DataFrame:
    """(by, x, n1, n0): how often each value occurs on either side of a condition; missing values are left out."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & side.isNotNull())
    return known.groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count_if(side).alias("n1"), F.count_if(~side).alias("n0"))


def two_sample(df: DataFrame, by: list[str], value: str, side: Column) -> DataFrame:
    """For each group: n1, n0, ks, w1, u, delta (Cliff), auc and the tie sum, of the values on both sides."""
    at = cumulative(side_counts(df, by, value, side), by, "x", ["n1", "n0"])
    total = at.groupBy(*by).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    full = at.join(total, by) if by else at.crossJoin(F.broadcast(total))  # one row
    gap = F.abs(F.try_divide("cum_n1", "t1") - F.try_divide("cum_n0", "t0"))
    out = full.groupBy(*by).agg(
        F.first("t1").alias("n1"),
        F.first("t0").alias("n0"),
        F.max(gap).alias("ks"),
        F.sum(gap * (F.col("next") - F.col("x"))).alias("w1"),
        F.sum(F.col("n1") * (F.col("cum_n0") - F.col("n0") / 2)).alias("u"),
        F.sum(F.pow(F.col("n1") + F.col("n0"), 3) - F.col("n1") - F.col("n0")).alias("ties"),
    )
    pairs = F.col("n1") * F.col("n0")
    return out.withColumn("auc", F.try_divide("u", pairs)).withColumn("delta", 2 * F.col("auc") - 1)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal, by a rational approximation (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of a published Chebyshev fit of the complementary error function.
    poly = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(poly - x * x)


def student_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t, by Wallace's normal approximation (relative error about 1e-3 from ten degrees of freedom on)."""
    return normal_tail((8 * df + 1) / (8 * df + 3) * F.sqrt(df * F.log1p(t * t / df)))


def with_p_values(tests: DataFrame) -> DataFrame:
    """Adds p_u (Mann-Whitney, tie-corrected, continuity 0.5) and p_ks (Kolmogorov's series), both asymptotic."""
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - n1 * n0 / 2) - 0.5, F.lit(0.0)), spread)
    lam = (F.sqrt(n1 * n0 / n) + 0.12 + 0.11 / F.sqrt(n1 * n0 / n)) * F.col("ks")
    series = sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 40)), F.lit(0.0))
    return tests.withColumn("p_u", normal_tail(z)).withColumn("p_ks", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series))).withColumn("method", F.lit("asymptotic"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the rank of a column, ties averaged; missing values have none. Rows are staged, as the column is joined on."""
    df = staged(df, "ranked")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_x")).agg(F.count("*").alias("n"))
    ranks = cumulative(counts, [], "_x", ["n"]).select("_x", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(column) == F.col("_x"), "left").drop("_x")


def spearman(df: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """(n, r): correlation of average ranks over rows that have both; withheld below ``least`` rows."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_ranks(average_ranks(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("r")).withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def ecdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, x, share): the share of the group's values up to x."""
    at = cumulative(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("x")).agg(F.count("*").alias("n")), by, "x", ["n"])
    return at.join(at.groupBy(*by).agg(F.sum("n").alias("_t")), by).select(*by, "x", (F.col("cum_n") / F.col("_t")).alias("share"))


def roc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, from the highest."""
    counts = side_counts(df, [], score, label).withColumn("x", -F.col("x"))
    at = cumulative(counts, [], "x", ["n1", "n0"])
    total = at.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    return at.crossJoin(F.broadcast(total)).select((-F.col("x")).alias("threshold"), F.try_divide("cum_n1", "t1").alias("tpr"), F.try_divide("cum_n0", "t0").alias("fpr"))


def nearest_on_line(events: DataFrame, by: str, order: str, below: str, above: str) -> DataFrame:
    """Adds low (the greatest ``below`` up to each row's place) and high (the least ``above`` from it on), within ``by``, by the order of a column; equal places see each other.

    A line of any length is cut into ranges of places. Each range is scanned on its own; a line in several ranges also
    takes over what the ranges before and after it hold, of which there is one row for each range.
    """
    laid = staged(events.repartitionByRange(by, order).withColumn("_p", F.spark_partition_id()), "ranges")
    part = Window.partitionBy("_p", by)
    so_far = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = laid.withColumn("_low", F.max(below).over(so_far(part.orderBy(order)))).withColumn("_high", F.min(above).over(so_far(part.orderBy(F.desc(order)))))
    per = laid.groupBy(by, "_p").agg(F.max(below).alias("_b"), F.min(above).alias("_a"))
    cut = per.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    line = Window.partitionBy(by).orderBy("_p")
    carried = per.join(cut, by, "left_semi").select(
        F.col(by).alias("_by"),
        F.col("_p").alias("_at"),
        F.max("_b").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_a").over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    # only the first and the last line of a range can go on beyond it
    full = own.join(F.broadcast(carried), (F.col("_by") == F.col(by)) & (F.col("_at") == F.col("_p")), "left")
    return full.select(*events.columns, F.greatest("_low", "_before").alias("low"), F.least("_high", "_after").alias("high"))


def suffix_min(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds the least ``value`` of the rows from each one on, in the order of a column; each range of rows on its own, and the least of all later ranges."""
    laid = staged(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    own = laid.withColumn("_own", F.min(value).over(Window.partitionBy("_p").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)))
    later = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    per = laid.groupBy("_p").agg(F.min(value).alias("_min")).select("_p", F.min("_min").over(later).alias("_later"))
    return own.join(F.broadcast(per), "_p").select(*df.columns, F.least("_own", "_later").alias(out))


def benjamini_hochberg(tests: DataFrame, p: str = "p", level: float = 0.05) -> DataFrame:
    """Adds q (p * m / rank, made monotone from the top, at most 1) and significant (q up to ``level``). Tests without p have neither.

    Tests are staged: p is joined on, and worked out twice it may differ in its last bits.
    """
    tests = staged(tests, "tests")
    at = cumulative(tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_x")).agg(F.count("*").alias("n")), [], "_x", ["n"])
    m = at.agg(F.sum("n").alias("_m"))
    scaled = at.crossJoin(F.broadcast(m)).select("_x", (F.col("_x") * F.col("_m") / F.col("cum_n")).alias("_s"))  # one row
    q = suffix_min(scaled, "_x", "_s", "_q").select("_x", F.least(F.lit(1.0), "_q").alias("q"))
    return tests.join(q, F.col(p) == F.col("_x"), "left").drop("_x").withColumn("significant", F.col("q") <= level)


def yates(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n, chi2): chi-square of two conditions with Yates' correction; null unless both vary."""
    n = df.agg(F.count_if(a & b).alias("p"), F.count_if(a & ~b).alias("q"), F.count_if(~a & b).alias("r"), F.count_if(~a & ~b).alias("s"))
    p, q, r, s = (F.col(c).cast("double") for c in "pqrs")
    total, margins = p + q + r + s, (p + q) * (r + s) * (p + r) * (q + s)
    gap = F.greatest(F.abs(p * s - q * r) - total / 2, F.lit(0.0))
    return n.select(total.cast("long").alias("n"), F.when(margins > 0, total * gap * gap / margins).alias("chi2"))


def distributed_index(df: DataFrame, by: list[str], seed: int, key: str, out: str) -> DataFrame:
    """Adds the row's number, from 0, within ``by`` in seeded-hash order."""
    hashed = df.withColumn("_h", F.struct(F.xxhash64(F.lit(seed), key).alias("h"), F.col(key).alias("k"))).withColumn("_one", F.lit(1))  # ties of the hash by the key
    return cumulative(hashed, by, "_h", ["_one"]).withColumn(out, F.col("cum__one") - 1).drop("_h", "_one", "cum__one", "next")
