"""Plans of reports: on a match, null models, entropy, novelty, intensive columns, and mined families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import gates as g
from tessera.operators import matching, reports
from tessera.operators import relations as ops
from tessera.plans import panels, sequences, tables
from tessera.plans.bindings import SQL, Views, query


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


@query(
    f"""WITH m AS ({SQL['join_greedy_match']}), x AS (SELECT p.record_id, p.len, p.gc, m.cost, q.len AS lb, q.gc AS gb FROM panel p LEFT JOIN m ON m.a = p.record_id LEFT JOIN panel q ON q.record_id = m.b WHERE p.label <> 1)
    SELECT count(*) AS n, count(cost) AS n_matched, round(avg(len) FILTER (cost IS NOT NULL) - avg(lb), 6) AS delta_length, round(avg(gc) FILTER (cost IS NOT NULL) - avg(gb), 6) AS delta_gc,
    round(stddev_samp(len) FILTER (cost IS NOT NULL) - stddev_samp(lb), 6) AS delta_deviation, round(avg(cost), 6) AS mean_cost, quantile_cont(len::DOUBLE, 0.5) FILTER (cost IS NULL) AS left_q50, quantile_cont(len::DOUBLE, 0.75) FILTER (cost IS NULL) AS left_q75,
    round(quantile_cont(len::DOUBLE, 0.9) FILTER (cost IS NULL), 6) AS left_q90, quantile_cont(len::DOUBLE, 1.0) FILTER (cost IS NULL) AS left_q100, count(*) - count(cost) AS n_left, round((count(*) - count(cost)) / count(*), 6) AS left_share,
    coalesce(max(len) FILTER (cost IS NULL) > (SELECT max(len) FROM panel WHERE label = 1), false) AS truncation_risk FROM x""",
    "panel",
)
def agg_match_deltas(v: Views) -> DataFrame:
    p = v.measured()
    got = reports.match_report(p.where(~panels.one()), p.where(panels.one()), matching.greedy(panels.edges(v, 8)), "record_id", "len", "gc")
    return _r(got, "delta_length", "delta_gc", "delta_deviation", "mean_cost", "left_q90", "left_share")


@query(
    """WITH n AS (SELECT l_suppkey AS id, avg(l_discount) AS m, stddev_pop(l_discount) AS s, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    k AS (SELECT id, mode FROM (SELECT l_suppkey AS id, l_linestatus || l_linenumber AS mode, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linestatus || l_linenumber) AS r FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2) WHERE r = 1)
    SELECT s_suppkey AS id, round((x - m) / greatest(s, 1e-6), 6) AS z, coalesce(n, 0) AS n, mode FROM supplier LEFT JOIN (SELECT l_suppkey AS id, avg(l_discount) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x ON x.id = s_suppkey LEFT JOIN n ON n.id = s_suppkey LEFT JOIN k ON k.id = s_suppkey"""
)
def agg_null_mode(v: Views) -> DataFrame:
    line = v.table("lineitem").withColumnRenamed("l_suppkey", "id")
    own = line.where("l_returnflag = 'R'").groupBy("id").agg(F.avg("l_discount").alias("x"))
    values = v.table("supplier").select(F.col("s_suppkey").alias("id")).join(own, "id", "left")
    nulls = line.where("l_returnflag <> 'R'").select("id", F.col("l_discount").alias("x"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("mode"))
    return _r(reports.null_z(values, nulls, "id", "x", "mode"), "z")


@query(
    """WITH b AS (SELECT l_orderkey AS id, unnest([l_linenumber, 8]) AS pos, l_discount * 2 AS p FROM lineitem WHERE l_discount > 0),
    h AS (SELECT id, pos, sum(-p * log2(p)) + CASE WHEN sum(p) < 1 THEN -(1 - sum(p)) * log2(1 - sum(p)) ELSE 0 END AS h FROM b GROUP BY 1, 2)
    SELECT o_orderkey AS id, round(coalesce(sum(h), 0) / 20, 5) AS entropy FROM orders LEFT JOIN h ON id = o_orderkey GROUP BY 1"""
)
def agg_positional_entropy(v: Views) -> DataFrame:
    pairs = v.table("lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.lit(8).alias("j"), (F.col("l_discount") * 2).alias("p"))
    lengths = v.table("orders").select(F.col("o_orderkey").alias("id"), F.lit(20).alias("n"))
    return reports.positional_entropy(pairs, lengths, "id", "l_linenumber", "j", "p", "n").select("id", F.round("entropy", 5).alias("entropy"))


@query(
    tables._COMBINED
    + """SELECT k.bucket, count(n.category) AS n, round(count(n.category) / (SELECT count(*) FROM n), 6) AS share, count(c.ta) AS n_a, count(c.tb) AS n_b
    FROM (VALUES ('identical_near', 'near'), ('remote_homolog', 'remote'), ('no_hit', 'none')) k(bucket, category) LEFT JOIN n USING (category) LEFT JOIN c USING (record_id) GROUP BY 1""",
    "best_a",
    "best_b",
)
def agg_novelty_report(v: Views) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in zip(("near", "remote", "none"), reports.BUCKETS, strict=True) for x in pair))
    rows = tables.combined(v)
    for odd, tool in ((False, "a"), (True, "b")):
        rows = rows.join(v.hits(odd).select(F.col("query").alias("record_id")).distinct().withColumn(f"has_{tool}", F.lit(True)), "record_id", "left")
    return _r(reports.novelty(rows, names[F.col("category")], {t: F.col(f"has_{t}") for t in "ab"}), "share")


@query(f"WITH m AS ({SQL['prj_bracket_metrics']}) SELECT record_id, round(stem / nullif(length(seq), 0), 6) AS stem_frac, round(loop / nullif(length(seq), 0), 6) AS loop_frac FROM m JOIN seqs USING (record_id)", "seqs")
def prj_intensive_columns(v: Views) -> DataFrame:
    metrics = sequences.prj_bracket_metrics(v)
    sizes = v.seqs().select("record_id", F.length("seq").alias("seq_length"))
    got = reports.intensive(metrics.join(sizes, "record_id"), "seq_length", {"stem_frac": "stem", "loop_frac": "loop", "mfe_per_nt": "mfe"})  # no mfe here, so no such column
    return _r(got.select("record_id", "stem_frac", "loop_frac"), "stem_frac", "loop_frac")


@query("SELECT query, target, evalue, score FROM (SELECT l_orderkey AS query, l_partkey AS target, l_discount AS evalue, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_extendedprice DESC, l_linenumber) AS r FROM lineitem WHERE l_linenumber % 2 = 1) WHERE r = 1")
def win_best_hit_score(v: Views) -> DataFrame:
    """Tool B's best hits: lowest e-value, then highest score, then first seen."""
    line = v.table("lineitem").where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), F.col("l_discount").alias("evalue"), F.col("l_extendedprice").alias("score"), "l_linenumber")
    return ops.best_hit(line, "query", F.col("evalue"), -F.col("score"), F.col("l_linenumber")).drop("l_linenumber")


_WORDS = [*g.HEAT_IDS, "heat shock", "thermoswitch", "riboswitch", "rose", "CIII", "leader", "tRNA", "hsp", "groel", "heatshock"]
_CLAUSES = " OR ".join(f"contains(lower(id), '{x.lower()}')" for x in g.HEAT_IDS) + " OR " + " OR ".join(f"contains(lower(description), '{x.lower()}')" for x in g.HEAT_TEXTS)


@query(
    f"""WITH f AS (SELECT p_partkey, 'x' || w[1 + p_partkey % {len(_WORDS)}] || '_' || p_name AS id, CASE WHEN p_size % 3 = 0 THEN w[1 + (p_partkey + p_size) % {len(_WORDS)}] END AS description, p_size % 4 AS significant,
    CASE p_size % 5 WHEN 0 THEN 'Eukaryota; Fungi' WHEN 1 THEN NULL ELSE 'Bacteria' END AS tax FROM part, (SELECT {_WORDS} AS w))
    SELECT p_partkey, id FROM f WHERE ({_CLAUSES}) AND significant = 1 AND tax NOT LIKE '%Eukaryota%'"""
)
def flt_heat_families(v: Views) -> DataFrame:
    """The whole text-mining predicate on families named after the parts, some of them heat-sensing."""
    w = F.array(*map(F.lit, _WORDS))
    at = lambda n: F.get(w, (n % len(_WORDS)).cast("int"))
    f = v.table("part").select(
        "p_partkey", F.concat(F.lit("x"), at(F.col("p_partkey")), F.lit("_"), "p_name").alias("id"), F.when(F.col("p_size") % 3 == 0, at(F.col("p_partkey") + F.col("p_size"))).alias("description"),
        (F.col("p_size") % 4).alias("significant"), F.when(F.col("p_size") % 5 == 0, "Eukaryota; Fungi").when(F.col("p_size") % 5 != 1, "Bacteria").alias("tax"),
    )
    none = F.lit(None).cast("string")
    return f.where(g.heat_family(none, F.col("description"), F.col("id"), F.col("significant"), F.col("tax"))).select("p_partkey", "id")
