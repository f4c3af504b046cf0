"""Plans on hit tables, gates, intervals and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import gates as g
from tessera.operators import relations as ops
from tessera.plans.bindings import Views, query

FAR = 1e308  # stands for infinity in results that are compared


def best(v: Views, odd: bool) -> DataFrame:
    return ops.best_hit(v.hits(odd), "query", F.col("evalue"), -F.col("ident"), F.col("target"), F.col("line")).select("query", "target", "evalue", "ident")


def yields(v: Views) -> DataFrame:
    """Three gates for each candidate: z at most -1, a positive change, and no close hit in either tool; order lines are read and grouped once."""
    hit = F.struct(F.col("l_discount").alias("evalue"), (-F.col("l_quantity") / 50).alias("ident"), "l_partkey", "l_linenumber")
    best = [F.min(F.when(F.col("l_linenumber") % 2 == odd, hit))["evalue"].alias(f"e{odd}") for odd in (0, 1)]
    lines = v.table("lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_tax") - F.sum("l_discount"), 9).alias("dp"), *best)
    orders = v.table("orders").select("o_orderkey", "o_totalprice")
    whole = orders.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))
    z = orders.join(F.broadcast(whole)).select(F.col("o_orderkey").alias("record_id"), ((F.col("o_totalprice") - F.col("m")) / F.col("s")).alias("z"))  # one row
    x = z.join(lines, F.col("l_orderkey") == F.col("record_id"), "left").withColumn("e", g.tightest(F.col("e0"), F.col("e1")))
    return x.select("record_id", "z", "dp", "e", g.at_most(F.col("z"), -1.0).alias("gate_z"), g.above(F.col("dp"), 0.0).alias("gate_dp"), g.above(F.col("e"), 1e-3).alias("gate_novel"))


def passes() -> Column:
    return F.col("gate_z") & F.col("gate_dp") & F.col("gate_novel")


@query(
    """SELECT count(*) AS n, count(*) FILTER (gate_z AND gate_dp AND gate_novel) AS n_pass, count(*) FILTER (gate_z) AS n_z, count(*) FILTER (gate_dp) AS n_dp, count(*) FILTER (gate_novel) AS n_novel,
    count(*) FILTER (e >= 1e308) AS n_no_hit, round(count(*) FILTER (gate_z AND gate_dp AND gate_novel) / count(*), 6) AS ratio,
    CASE WHEN count(*) FILTER (gate_z) <= least(count(*) FILTER (gate_dp), count(*) FILTER (gate_novel)) THEN 'gate_z' WHEN count(*) FILTER (gate_dp) <= count(*) FILTER (gate_novel) THEN 'gate_dp' ELSE 'gate_novel' END AS costliest FROM yields""",
    "yields",
)
def yield_summary(v: Views) -> DataFrame:
    n = yields(v).agg(
        F.count("*").alias("n"), F.count_if(passes()).alias("n_pass"), F.count_if("gate_z").alias("n_z"), F.count_if("gate_dp").alias("n_dp"), F.count_if("gate_novel").alias("n_novel"), F.count_if(F.col("e") >= FAR).alias("n_no_hit")
    )
    least = F.when(F.col("n_z") <= F.least("n_dp", "n_novel"), "gate_z").when(F.col("n_dp") <= F.col("n_novel"), "gate_dp").otherwise("gate_novel")
    return n.select("*", F.round(F.try_divide("n_pass", "n"), 6).alias("ratio"), least.alias("costliest"))


@query("SELECT record_id, round(z, 6) AS z, round(dp, 6) + 0.0 AS dp, e, gate_z AND gate_dp AND gate_novel AS passes FROM yields", "yields")
def yield_gates(v: Views) -> DataFrame:
    z = F.round("z", 6)
    z = F.when((z == 0) & (F.col("z") < 0), F.lit(-0.0)).otherwise(z)  # rounding goes by decimals here, which have no zero below zero; SQL's has
    return yields(v).select("record_id", z.alias("z"), (F.round("dp", 6) + 0.0).alias("dp"), F.least("e", F.lit(FAR)).alias("e"), passes().alias("passes"))


@query("SELECT record_id FROM yields WHERE gate_z AND gate_dp AND gate_novel", "yields")
def yield_passing(v: Views) -> DataFrame:
    """The summary's passing ids: a table, since there may be any number of them."""
    return yields(v).where(passes()).select("record_id")


@query("SELECT record_id, round(z, 6) AS z, row_number() OVER (ORDER BY round(z, 6), dp DESC, record_id) AS rank FROM yields WHERE gate_z AND gate_dp AND gate_novel ORDER BY rank LIMIT 20", "yields")
def win_ranked_passers(v: Views) -> DataFrame:
    top = yields(v).where(passes()).withColumn("z", F.round("z", 6)).orderBy("z", F.desc("dp"), "record_id").limit(20)  # a top-k report
    return top.select("record_id", "z", F.row_number().over(Window.orderBy("z", F.desc("dp"), "record_id")).alias("rank"))


@query("SELECT CAST(gate_z AS INT) + 2 * CAST(gate_dp AS INT) + 4 * CAST(gate_novel AS INT) AS flags, count(*) AS n FROM yields GROUP BY 1", "yields")
def agg_gate_membership(v: Views) -> DataFrame:
    flags = F.col("gate_z").cast("int") + 2 * F.col("gate_dp").cast("int") + 4 * F.col("gate_novel").cast("int")
    return yields(v).groupBy(flags.alias("flags")).agg(F.count("*").alias("n"))


@query("SELECT CAST(gate_z AS INT) + 2 * CAST(gate_dp AS INT) + 4 * CAST(gate_novel AS INT) AS flags, count(*) AS n FROM yields WHERE gate_z OR gate_dp OR gate_novel GROUP BY 1 ORDER BY n DESC, flags LIMIT 7", "yields")
def agg_gate_top(v: Views) -> DataFrame:
    """The seven largest exclusive intersections of gates, rows without any gate apart."""
    return agg_gate_membership(v).where("flags > 0").orderBy(F.desc("n"), "flags").limit(7)  # a top-k report


@query(
    """SELECT o_orderpriority AS cohort, 1 AS step, count(*) AS n FROM yields JOIN orders ON o_orderkey = record_id GROUP BY 1 UNION ALL SELECT o_orderpriority, 2, count(*) FILTER (gate_z) FROM yields JOIN orders ON o_orderkey = record_id GROUP BY 1
    UNION ALL SELECT o_orderpriority, 3, count(*) FILTER (gate_z AND gate_dp) FROM yields JOIN orders ON o_orderkey = record_id GROUP BY 1 UNION ALL SELECT o_orderpriority, 4, count(*) FILTER (gate_z AND gate_dp AND gate_novel) FROM yields JOIN orders ON o_orderkey = record_id GROUP BY 1""",
    "yields",
)
def agg_survival_funnel(v: Views) -> DataFrame:
    x = yields(v).join(v.table("orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("cohort")), "record_id")
    n = x.groupBy("cohort").agg(F.count("*").alias("s1"), F.count_if("gate_z").alias("s2"), F.count_if(F.col("gate_z") & F.col("gate_dp")).alias("s3"), F.count_if(passes()).alias("s4"))
    return n.select("cohort", F.expr("stack(4, 1, s1, 2, s2, 3, s3, 4, s4) as (step, n)"))


@query(
    """WITH c AS (SELECT record_id // 2500 AS chunk, count(*) AS n, count(*) FILTER (gate_z AND gate_dp AND gate_novel) AS n_pass FROM yields GROUP BY 1)
    SELECT chunk, n, n_pass, CAST(sum(n) OVER (ORDER BY chunk) AS BIGINT) AS cum_n, CAST(sum(n_pass) OVER (ORDER BY chunk) AS BIGINT) AS cum_pass, round(sum(n_pass) OVER (ORDER BY chunk) / sum(n) OVER (ORDER BY chunk), 6) AS cum_ratio FROM c""",
    "yields",
)
def agg_chunk_rollup(v: Views) -> DataFrame:
    from tessera.streaming.triage import rolled_up

    chunks = yields(v).groupBy(F.floor(F.col("record_id") / 2500).alias("chunk")).agg(F.count("*").alias("n"), F.count_if(passes()).alias("n_pass"))
    return rolled_up(chunks).withColumn("cum_ratio", F.round("cum_ratio", 6))


#: The pilot's rate of passing rows, which later chunks are compared with (a fixed value).
PILOT = 0.0605


@query(
    f"""WITH c AS (SELECT record_id // 2500 AS chunk, count(*) AS n, count(*) FILTER (gate_z AND gate_dp AND gate_novel) AS n_pass FROM yields GROUP BY 1)
    SELECT chunk, round(n_pass / n, 6) AS ratio, round(sum(n_pass) OVER (ORDER BY chunk) / sum(n) OVER (ORDER BY chunk) - {PILOT}, 6) AS delta FROM c""",
    "yields",
)
def agg_chunk_delta(v: Views) -> DataFrame:
    """Each chunk's own rate, and how far the rate up to it is from the pilot's."""
    return agg_chunk_rollup(v).select("chunk", F.round(F.col("n_pass") / F.col("n"), 6).alias("ratio"), F.round(F.col("cum_pass") / F.col("cum_n") - PILOT, 6).alias("delta"))


@query("SELECT * FROM best_a", "best_a")
def win_best_hit_a(v: Views) -> DataFrame:
    return best(v, False)


@query("SELECT * FROM best_b", "best_b")
def win_best_hit_b(v: Views) -> DataFrame:
    return best(v, True)


_COMBINED = """WITH c AS (SELECT o_orderkey AS record_id, a.target AS ta, a.evalue AS ea, a.ident AS ia, b.target AS tb, b.evalue AS eb, b.ident AS ib,
 CASE WHEN a.query IS NULL AND b.query IS NULL THEN NULL WHEN b.query IS NULL OR a.ident > b.ident OR a.ident = b.ident AND a.evalue <= b.evalue THEN 'a' ELSE 'b' END AS tool
 FROM orders LEFT JOIN best_a a ON a.query = o_orderkey LEFT JOIN best_b b ON b.query = o_orderkey),
 r AS (SELECT record_id, tool, CASE tool WHEN 'a' THEN ta WHEN 'b' THEN tb END AS target, CASE tool WHEN 'a' THEN ia WHEN 'b' THEN ib END AS ident FROM c),
 n AS (SELECT *, CASE WHEN tool IS NULL THEN 'none' WHEN ident >= 0.9 THEN 'near' ELSE 'remote' END AS category FROM r) """


def combined(v: Views) -> DataFrame:
    """The better of both tools' best hits: more identical, then the lower e-value, then tool a."""
    sides = [best(v, odd).select(F.col("query").alias("record_id"), F.struct(-F.col("ident"), F.col("evalue"), F.lit(n).alias("tool"), "target", "ident").alias(n)) for odd, n in ((False, "a"), (True, "b"))]
    x = v.table("orders").select(F.col("o_orderkey").alias("record_id")).join(sides[0], "record_id", "left").join(sides[1], "record_id", "left")
    x = x.withColumn("x", F.least("a", "b")).select("record_id", "x.tool", "x.target", "x.ident")
    return x.withColumn("category", g.novelty(F.col("ident"), F.col("tool").isNotNull()))


@query(_COMBINED + "SELECT * FROM n", "best_a", "best_b")
def win_best_of_both(v: Views) -> DataFrame:
    return combined(v)


@query(_COMBINED + "SELECT k.category, count(n.category) AS n, round(count(n.category) / (SELECT count(*) FROM n), 6) AS share FROM (VALUES ('near'), ('remote'), ('none')) k(category) LEFT JOIN n USING (category) GROUP BY 1", "best_a", "best_b")
def agg_novelty_buckets(v: Views) -> DataFrame:
    buckets = v.spark.createDataFrame([("near",), ("remote",), ("none",)], "category string")
    n = buckets.join(combined(v).groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # three rows


@query(_COMBINED + "SELECT category, record_id, ident, row_number() OVER (PARTITION BY category ORDER BY ident DESC, record_id) AS rank FROM n WHERE tool IS NOT NULL QUALIFY rank <= 20", "best_a", "best_b")
def join_report_top(v: Views) -> DataFrame:
    return ops.first_per_key(combined(v).where("tool is not null"), ["category"], F.desc("ident"), F.col("record_id"), n=20).select("category", "record_id", "ident", "rank")


@query("SELECT query, target, rank FROM (SELECT query, target, row_number() OVER (PARTITION BY query ORDER BY evalue, ident DESC, target, line) AS rank FROM hits_a) WHERE rank <= 3", "hits_a")
def win_top_k(v: Views) -> DataFrame:
    return ops.first_per_key(v.hits(False), ["query"], F.col("evalue"), F.desc("ident"), F.col("target"), F.col("line"), n=3).select("query", "target", "rank")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT query FROM hits_a WHERE evalue <= 0.01)", "hits_a")
def join_decontaminate(v: Views) -> DataFrame:
    hit = v.hits(False).where("evalue <= 0.01").select(F.col("query").alias("o_orderkey")).distinct()
    return v.table("orders").select("o_orderkey").join(hit, "o_orderkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_restrict(v: Views) -> DataFrame:
    return v.table("customer").select("c_custkey").join(v.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_resume(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", "lang").join(v.table("labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT n_name AS nation, r_name AS region, count(DISTINCT s_suppkey) AS suppliers, count(*) AS lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def join_four_way(v: Views) -> DataFrame:
    per = v.table("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"))  # one row for each supplier before the joins
    x = v.table("supplier").join(per, F.col("s_suppkey") == F.col("l_suppkey")).join(v.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(v.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return x.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("s_suppkey").alias("suppliers"), F.sum("lines").alias("lines"))


@query("SELECT DISTINCT l_returnflag, s_nationkey AS nation, n_name, r_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def join_four_way_distinct(v: Views) -> DataFrame:
    """Four tables joined and made distinct on four columns; lines are distinct before the joins, too, so that few rows meet."""
    line = v.table("lineitem").select("l_returnflag", "l_suppkey").distinct()
    x = line.join(v.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(v.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(v.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return x.select("l_returnflag", F.col("s_nationkey").alias("nation"), "n_name", "r_name").distinct()


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE r <= (SELECT count(*) * 3 // 4 FROM documents) - (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1)")
def join_resume_limited(v: Views) -> DataFrame:
    """What is left to do of three quarters of all rows, when those of quality 1 are done: the limit counts them."""
    docs = v.table("documents").select("doc_id", "lang")
    return ops.resumed(docs, v.table("labels").where("quality = 1").select("doc_id"), "doc_id", limit=docs.count() * 3 // 4)


@query("SELECT doc_id, -doc_id AS position, length(text) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_picked(v: Views) -> DataFrame:
    """Candidates by a list of ids, from the last id to the first; an id without a text would be an error."""
    wanted = v.table("labels").where("toxic = 1").select("doc_id", (-F.col("doc_id")).alias("position"))
    source = v.table("documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return ops.picked(wanted, source, "doc_id", "position", F.col("n")).select("doc_id", "position", "n")


@query("SELECT doc_id, lang, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id)")
def join_relink(v: Views) -> DataFrame:
    return ops.strict_join(v.table("labels"), v.table("documents").select("doc_id", "lang", "n_chars"), ["doc_id"]).select("doc_id", "lang", "n_chars", "quality", "toxic")


@query("SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS mark, length(d.text) AS n FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_attach(v: Views) -> DataFrame:
    x = v.table("documents").join(v.table("labels"), "doc_id", "left")
    return x.select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("mark"), F.length("text").cast("long").alias("n"))


_PATCH = "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS x FROM orders"


@query(f"WITH a AS ({_PATCH}), b AS (SELECT l_orderkey AS k, CAST(max(l_quantity) AS DOUBLE) AS x, count(*) AS lines FROM lineitem GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.x, b.x) AS x, b.lines FROM a FULL JOIN b ON a.k = b.k")
def join_backfill(v: Views) -> DataFrame:
    a = v.table("orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("x"))
    b = v.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").cast("double").alias("x"), F.count("*").alias("lines"))
    return ops.coalesced(a, b, ["k"])


@query(f"WITH a AS ({_PATCH}), b AS (SELECT l_orderkey AS k, CAST(min(l_quantity) AS DOUBLE) AS x, min(l_discount) AS e FROM lineitem GROUP BY 1), c AS (SELECT l_orderkey AS k, min(l_tax) AS e FROM lineitem GROUP BY 1) SELECT k, coalesce(a.x, b.x) AS x, least(b.e, c.e) AS e FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)")
def join_outer_merge(v: Views) -> DataFrame:
    a = v.table("orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("x"))
    line = v.table("lineitem").withColumnRenamed("l_orderkey", "k")
    return ops.merged([a, line.groupBy("k").agg(F.min("l_quantity").cast("double").alias("x"), F.min("l_discount").alias("e")), line.groupBy("k").agg(F.min("l_tax").alias("e"))], "k", least=("e",))


@query(
    """SELECT seqid, start, stop, strand, CASE strand WHEN '+' THEN coalesce((SELECT max(j.stop) FROM intervals j WHERE j.seqid = i.seqid AND j.stop <= i.start - 1), 0) + 1 ELSE stop + 1 END AS gap_start,
    CASE strand WHEN '+' THEN start - 1 ELSE (SELECT min(j.start) FROM intervals j WHERE j.seqid = i.seqid AND j.start >= i.stop + 1) - 1 END AS gap_stop FROM intervals i""",
    "intervals",
)
def join_upstream_gaps(v: Views) -> DataFrame:
    return ops.upstream_gaps(v.intervals())


@query("SELECT s.id, s.t, s.p - x.p > 0 AS rises, round(x.p, 6) AS at_37 FROM sweeps s LEFT JOIN (SELECT id, p FROM sweeps WHERE t = 37) x USING (id)", "sweeps")
def join_curve_lookup(v: Views) -> DataFrame:
    s = v.sweeps()
    x = s.where("t = 37").select("id", F.col("p").alias("x"))
    return s.join(x, "id", "left").select("id", "t", (F.col("p") - F.col("x") > 0).alias("rises"), F.round("x", 6).alias("at_37"))


@query("SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 1")
def win_prototype_picks(v: Views) -> DataFrame:
    top = ops.best_hit(v.table("customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal"), "nation", -F.col("c_acctbal"), F.col("c_custkey"))
    return top.select("nation", "c_custkey", F.lit(1).alias("rank"))


@query("SELECT cohort, id, t, rank FROM (SELECT cohort, id, t, row_number() OVER (PARTITION BY cohort ORDER BY id, t) AS rank FROM sweeps WHERE p > 0.5) WHERE rank <= 5", "sweeps")
def win_head_per_cohort(v: Views) -> DataFrame:
    return ops.first_per_key(v.sweeps().where("p > 0.5"), ["cohort"], F.col("id"), F.col("t"), n=5).select("cohort", "id", "t", "rank")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM orders) WHERE a = 1 OR b = 1")
def set_first_and_last(v: Views) -> DataFrame:
    x = v.table("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    key = F.struct("o_orderdate", "o_orderkey")
    ends = x.groupBy("o_custkey").agg(F.array_distinct(F.array(F.min_by("o_orderkey", key), F.max_by("o_orderkey", key))).alias("x"))
    return ends.select("o_custkey", F.explode("x").alias("o_orderkey"))


@query("SELECT c_custkey AS key, 1 AS label FROM customer UNION ALL SELECT s_suppkey, 0 FROM supplier")
def set_labelled_pools(v: Views) -> DataFrame:
    a, b = (v.table(t).select(F.col(k).alias("key"), F.lit(x).alias("label")) for t, k, x in (("customer", "c_custkey", 1), ("supplier", "s_suppkey", 0)))
    return a.unionByName(b)


@query("SELECT c_custkey AS key, c_acctbal AS bal, NULL::VARCHAR AS name FROM customer UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def set_outer_union(v: Views) -> DataFrame:
    a = v.table("customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(v.table("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")), allowMissingColumns=True)


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS shared, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_right")
def set_key_overlap(v: Views) -> DataFrame:
    a, b = v.table("customer").select(F.col("c_custkey").alias("k")), v.table("orders").select(F.col("o_custkey").alias("k"))
    sides = a.select("k", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select("k", F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared"), F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right"))


@query("SELECT id, 'tm_a' AS feature, round(tm_a, 6) AS value FROM engines UNION ALL SELECT id, 'tm_b', round(tm_b, 6) FROM engines UNION ALL SELECT id, 'amp', round(amp, 6) FROM engines", "engines")
def set_melted(v: Views) -> DataFrame:
    return v.engines().unpivot("id", ["tm_a", "tm_b", "amp"], "feature", "value").where("value is not null").withColumn("value", F.round("value", 6))


@query("SELECT e.l_orderkey AS id, CAST(e.l_quantity AS DOUBLE) AS x, NULL::VARCHAR AS note FROM (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) e WHERE e.l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def set_append_new(v: Views) -> DataFrame:
    master = v.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.col("o_orderpriority").alias("note"))
    rows = v.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_quantity").alias("x"), F.count("*").alias("extra"))
    return ops.append_aligned(master, rows.join(master.select("id"), "id", "left_anti"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'green') OR contains(lower(p_name), 'blue') OR contains(lower(p_type), 'brass')")
def flt_text_include(v: Views) -> DataFrame:
    return v.table("part").where(g.any_like(F.col("p_name"), ["Green", "blue"]) | g.any_like(F.col("p_type"), ["BRASS"])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_type), 'mo') OR contains(lower(p_type), 'large')) AND NOT contains(lower(p_type), 'promo') AND NOT regexp_matches(lower(p_name), 'red|hot') UNION ALL SELECT p_partkey FROM part WHERE contains(lower(p_type), 'medium') AND NOT contains(lower(p_name), 'ring')")
def flt_text_exclude(v: Views) -> DataFrame:
    kept = g.any_like(F.col("p_type"), ["Mo", "large"]) & ~g.any_like(F.col("p_type"), ["promo"]) & ~F.col("p_name").rlike("(?i)red|hot")
    other = g.any_like(F.col("p_type"), ["medium"]) & ~g.any_like(F.col("p_name"), ["ring"])
    return v.table("part").where(kept | other).select("p_partkey")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def src_attributes(v: Views) -> DataFrame:
    k = F.try_cast(F.get_json_object("props", "$.k"), "bigint") if hasattr(F, "try_cast") else F.get_json_object("props", "$.k").try_cast("bigint")
    return v.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.max(k).alias("k"))


@query("SELECT n_name AS host, count(c_custkey) AS made, 70 AS quota, greatest(70 - count(c_custkey), 0) AS remaining, coalesce(max(c_custkey), 0) + 1 AS next FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def agg_quota(v: Views) -> DataFrame:
    made = v.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("made"), F.max("c_custkey").alias("last"))
    x = v.table("nation").join(made, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("host"), F.coalesce("made", F.lit(0)).alias("made"), "last")
    return x.select("host", "made", F.lit(70).alias("quota"), F.greatest(70 - F.col("made"), F.lit(0)).alias("remaining"), (F.coalesce("last", F.lit(0)) + 1).alias("next"))


@query("""SELECT 'orders rows' AS rule, count(*) AS value, CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders UNION ALL SELECT 'orders repeated keys', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lines without order', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def agg_verification(v: Views) -> DataFrame:
    orders, line = v.table("orders"), v.table("lineitem")
    lost = line.select(F.col("l_orderkey").alias("o_orderkey")).join(orders.select("o_orderkey"), "o_orderkey", "left_anti")
    said = lambda df, rule, ok: df.agg(F.count("*").alias("value")).select(F.lit(rule).alias("rule"), "value", F.when(ok(F.col("value")), "PASS").otherwise("FAIL").alias("status"))
    none = lambda n: n == 0
    return said(orders, "orders rows", lambda n: n > 0).unionByName(said(ops.duplicated(orders, ["o_orderkey"]), "orders repeated keys", none)).unionByName(said(lost, "lines without order", none))
