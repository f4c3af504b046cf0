"""Joins, unions, ranks and checks on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.statistics import cumulative
from tessera.staging import staged


def best_hit(hits: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first hit of each query in the given order; a partial aggregate, so a query with very many hits is never sorted."""
    rest = [c for c in hits.columns if c != by]
    least = hits.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return least.select(by, *(F.col(f"_x.{c}").alias(c) for c in rest))


def first_per_key(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def coalesced(base: DataFrame, patch: DataFrame, keys: list[str], how: str = "full") -> DataFrame:
    """Patch a table: old values stay where they are known."""
    shared = [c for c in patch.columns if c not in keys]
    full = base.join(patch.select(*keys, *(F.col(c).alias(f"_{c}") for c in shared)), keys, how)
    kept = [F.coalesce(c, f"_{c}").alias(c) if c in shared else F.col(c) for c in base.columns if c not in keys]
    return full.select(*keys, *kept, *(F.col(f"_{c}").alias(c) for c in shared if c not in base.columns))


def merged(tables: list[DataFrame], key: str, least: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key of overlapping tables: the first known value in table order, the least for some columns."""
    ranked = [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    full = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    columns = [c for c in full.columns if c not in (key, "_rank")]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank")))
    return full.groupBy(key).agg(*((F.min(c) if c in least else first(c)).alias(c) for c in columns))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails, when run, if the right side holds a key twice or lacks one of the left side."""
    once = right.groupBy(*keys).agg(*(F.first(c).alias(c) for c in right.columns if c not in keys), F.count("*").alias("_n"))
    full = left.join(once, keys, "left")
    fault = F.when(F.col("_n").isNull(), F.raise_error(F.lit("a key has no partner"))).when(F.col("_n") > 1, F.raise_error(F.lit("a key has several partners")))
    return full.where(F.coalesce(fault.cast("string"), F.lit("")) == "").drop("_n")


def upstream_gaps(intervals: DataFrame) -> DataFrame:
    """For each (seqid, start, stop, strand): the gap before it on its own strand's side, up to the nearest interval that ends there.

    Gives gap_start and gap_stop, inclusive; an interval that overlaps the start is no neighbour. On the plus strand
    the gap runs from the greatest end below the start; on the minus strand to the least start above the stop, null
    if there is none. A contig of any length is worked on in ranges of positions.
    """
    from tessera.operators.statistics import nearest_on_line

    none = F.lit(None).cast("long")
    ends = intervals.select("seqid", F.col("stop").cast("long").alias("pos")).distinct().select("seqid", "pos", F.col("pos").alias("end"), none.alias("begin"))
    starts = intervals.select("seqid", F.col("start").cast("long").alias("pos")).distinct().select("seqid", "pos", none.alias("end"), F.col("pos").alias("begin"))
    asks = intervals.select("seqid", F.when(F.col("strand") == "+", F.col("start") - 1).otherwise(F.col("stop") + 1).cast("long").alias("pos"), "start", "stop", "strand")
    events = ends.unionByName(starts).unionByName(asks, allowMissingColumns=True)
    seen = nearest_on_line(events, "seqid", "pos", "end", "begin").where("strand is not null")
    plus = F.col("strand") == "+"
    return seen.select(
        "seqid", "start", "stop", "strand",
        F.when(plus, F.coalesce("low", F.lit(0)) + 1).otherwise(F.col("stop") + 1).alias("gap_start"),
        F.when(plus, F.col("start") - 1).otherwise(F.col("high") - 1).alias("gap_stop"),
    )


def extracted(intervals: DataFrame, contigs: DataFrame, least: int = 200, most: int = 600) -> DataFrame:
    """(seqid, strand, seq_start, seq_end, sequence, seq_length) of each interval of a contig that is long enough.

    ``intervals(seqid, a, b, strand)``: from a, before b, from 0; ``contigs(seqid, seq)``. On the minus strand the sequence is the
    reverse complement. Under ``least`` letters it is left out, of more than ``most`` the last are kept; so is one with other
    letters than A, U, G, C. The coordinates are those of what was kept, from 1, ends inclusive. An interval of a contig that
    isn't there is left out.
    """
    from tessera.functions.rna import normalized, reverse_complement

    cut = normalized(F.substring("seq", F.col("a") + 1, F.col("b") - F.col("a")))
    raw = intervals.join(contigs, "seqid").select("seqid", "strand", "a", "b", F.explode(F.array(cut)).alias("u"))
    full = raw.withColumn("u", F.when(F.col("strand") == "-", reverse_complement(F.col("u"))).otherwise(F.col("u")))
    kept = full.where((F.length("u") >= least) & F.col("u").rlike("^[AUGC]+$")).withColumn("sequence", F.right("u", F.lit(most)))
    n, plus = F.length("sequence"), F.col("strand") == "+"
    first = F.when(plus, F.col("b") - n + 1).otherwise(F.col("a") + 1)
    return kept.select("seqid", "strand", first.alias("seq_start"), (first + n - 1).alias("seq_end"), "sequence", n.alias("seq_length"))


def refreshed(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the patch's columns instead of its own of these names; rows without a patch get nulls."""
    columns = [c for c in patch.columns if c not in keys]
    return base.drop(*columns).join(patch.select(*keys, *columns), keys, "left")


def append_aligned(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows in the target's columns and order: missing ones null, new ones dropped."""
    present = set(rows.columns)
    return rows.select(*((F.col(c) if c in present else F.lit(None)).cast(t).alias(c) for c, t in target.dtypes))


def present(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def resumed(todo: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows of ``todo`` whose key isn't done yet; with ``limit``, only the first by key that are missing to ``limit`` rows in all.

    ``key`` is unique in ``todo``. Row numbers come from prefix sums over ranges of keys.
    """
    finished = done.select(key).distinct()
    left = todo.join(finished, key, "left_anti")
    if limit is None:
        return left
    room = max(limit - finished.count(), 0)
    numbered = cumulative(left.withColumn("_one", F.lit(1)), [], key, ["_one"])
    return numbered.where(F.col("cum__one") <= room).select(*left.columns)


def picked(wanted: DataFrame, source: DataFrame, key: str, position: str, first: Column) -> DataFrame:
    """The rows of ``source`` that ``wanted(key, position)`` asks for, each with its least position: sort by it for the asked order.

    Of several rows with one key the first by ``first`` counts. A wanted key that the source doesn't have is an error.
    """
    asked = wanted.groupBy(key).agg(F.min(position).alias(position))
    rows = source.groupBy(key).agg(F.min_by(F.struct(*source.columns), first).alias("_x")).select("_x.*")
    full = staged(asked.join(rows.withColumn("_there", F.lit(True)), key, "left"), "picked")
    missing = full.where("_there is null").select(key).limit(5).collect()
    if missing:
        raise ValueError(f"not in the source: {[r[0] for r in missing]}")
    return full.drop("_there")
