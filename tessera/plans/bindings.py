"""The given tables seen as sequence panels, hit tables, curves and intervals: in Spark, and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, CODE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("AUGC" * 7)[:26]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable:
    """Register a plan under its name, with the same in SQL over the named views."""

    def keep(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_views(sql, *views)
        return f

    return keep


# What thresholds are held against is rounded to nine digits: sums of doubles depend on the order of the rows in their last bits.
_SQL = {
    "seqs": f"SELECT doc_id AS record_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{CODE}') AS seq FROM documents WHERE text IS NOT NULL",
    "panel": "SELECT record_id, seq, quality AS label, source AS grp, lang, length(seq) AS len, CASE WHEN length(seq) > 0 THEN length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) ELSE 0.0 END AS gc FROM seqs JOIN documents ON doc_id = record_id JOIN labels USING (doc_id)",
    "hits_a": "SELECT l_orderkey AS query, l_partkey AS target, l_discount AS evalue, l_quantity / 50 AS ident, l_linenumber AS line FROM lineitem WHERE l_linenumber % 2 = 0",
    "hits_b": "SELECT l_orderkey AS query, l_partkey AS target, l_discount AS evalue, l_quantity / 50 AS ident, l_linenumber AS line FROM lineitem WHERE l_linenumber % 2 = 1",
    "gates": "SELECT o_orderkey AS record_id, (o_totalprice - m) / s AS z, dp FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) LEFT JOIN (SELECT l_orderkey, round(sum(l_tax) - sum(l_discount), 9) AS dp FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "best_a": "SELECT query, target, evalue, ident FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY evalue, ident DESC, target, line) AS r FROM hits_a) WHERE r = 1",
    "best_b": "SELECT query, target, evalue, ident FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY evalue, ident DESC, target, line) AS r FROM hits_b) WHERE r = 1",
    "yields": "SELECT record_id, z, dp, least(coalesce(a.evalue, 1e308), coalesce(b.evalue, 1e308)) AS e, coalesce(z <= -1, false) AS gate_z, coalesce(dp > 0, false) AS gate_dp, least(coalesce(a.evalue, 1e308), coalesce(b.evalue, 1e308)) > 1e-3 AS gate_novel FROM gates LEFT JOIN best_a a ON a.query = record_id LEFT JOIN best_b b ON b.query = record_id",
    "sweeps": "SELECT l_suppkey AS id, s_nationkey % 4 AS cohort, l_quantity AS t, round(avg(l_discount) * 10, 9) AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3",
    "engines": "SELECT l_suppkey AS id, round(avg(l_tax) * 1000, 9) AS tm_a, round(avg(l_discount) * 800, 9) AS tm_b, round(stddev_pop(l_tax) * 60, 9) AS n_a, round(stddev_pop(l_discount) * 50, 9) AS n_b, round(max(l_discount) - avg(l_discount) * 0.5, 9) AS amp, round(avg(l_tax) * 4, 9) AS leak, s_nationkey % 4 AS cohort FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, s_nationkey",
    "intervals": "SELECT o_custkey AS seqid, o_orderkey AS start, o_orderkey + CAST(floor(o_totalprice) AS BIGINT) % 40 AS stop, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders",
}
_NEEDS = {"panel": ["seqs"], "best_a": ["hits_a"], "best_b": ["hits_b"], "yields": ["gates", "hits_a", "hits_b", "best_a", "best_b"]}


def with_views(sql: str, *views: str) -> str:
    wanted = list(dict.fromkeys(v for x in views for v in [*_NEEDS.get(x, []), x]))
    sql = sql.strip()
    if not wanted:
        return sql
    recursive, more = "", ""
    if sql.upper().startswith("WITH "):
        sql = sql[5:]
        more = ", "
    if sql.upper().startswith("RECURSIVE "):
        sql, recursive = sql[10:], "RECURSIVE "
    return f"WITH {recursive}{', '.join(f'{v} AS ({_SQL[v]})' for v in wanted)}{more or ' '}{sql}"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def seqs(self) -> DataFrame:
        text = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), LETTERS, CODE)
        # a generator, so that the text is rewritten once and not in every expression that reads it
        return self.table("documents").where("text is not null").select(F.col("doc_id").alias("record_id"), F.explode(F.array(text)).alias("seq"))

    def panel(self) -> DataFrame:
        from tessera.functions.rna import gc_fraction

        docs = self.table("documents").select("doc_id", "source", "lang")
        labelled = docs.join(self.table("labels"), "doc_id").select(F.col("doc_id").alias("record_id"), F.col("quality").alias("label"), F.col("source").alias("grp"), "lang")
        return self.seqs().join(labelled, "record_id").withColumn("len", F.length("seq")).withColumn("gc", gc_fraction(F.col("seq")))

    def measured(self) -> DataFrame:
        """The panel without its sequences, staged."""
        from tessera.staging import staged

        return staged(self.panel().drop("seq"), "panel")

    def hits(self, odd: bool) -> DataFrame:
        """Two tools' hits: the lines of even and of odd number."""
        line = self.table("lineitem").where(F.col("l_linenumber") % 2 == int(odd))
        return line.select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), F.col("l_discount").alias("evalue"), (F.col("l_quantity") / 50).alias("ident"), F.col("l_linenumber").alias("line"))

    def gates(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_totalprice")
        whole = orders.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))
        change = self.table("lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_tax") - F.sum("l_discount"), 9).alias("dp"))
        z = orders.join(F.broadcast(whole)).withColumn("z", (F.col("o_totalprice") - F.col("m")) / F.col("s"))  # one row
        return z.join(change, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("record_id"), "z", "dp")

    def sweeps(self) -> DataFrame:
        line = self.table("lineitem").join(self.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        return line.groupBy(F.col("l_suppkey").alias("id"), (F.col("s_nationkey") % 4).alias("cohort"), F.col("l_quantity").alias("t")).agg(F.round(F.avg("l_discount") * 10, 9).alias("p"))

    def engines(self) -> DataFrame:
        line = self.table("lineitem").join(self.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        return line.groupBy(F.col("l_suppkey").alias("id"), (F.col("s_nationkey") % 4).alias("cohort")).agg(
            F.round(F.avg("l_tax") * 1000, 9).alias("tm_a"),
            F.round(F.avg("l_discount") * 800, 9).alias("tm_b"),
            F.round(F.stddev_pop("l_tax") * 60, 9).alias("n_a"),
            F.round(F.stddev_pop("l_discount") * 50, 9).alias("n_b"),
            F.round(F.max("l_discount") - F.avg("l_discount") * 0.5, 9).alias("amp"),
            F.round(F.avg("l_tax") * 4, 9).alias("leak"),
        )

    def intervals(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("seqid"),
            F.col("o_orderkey").alias("start"),
            (F.col("o_orderkey") + F.floor("o_totalprice") % 40).alias("stop"),
            F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        )
