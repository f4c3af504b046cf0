"""Plans for files, derived columns, reports and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import features, rna
from tessera.functions import gates as g
from tessera.operators import curves, matching, models, nearest, sequences
from tessera.operators import relations as ops
from tessera.operators import statistics as st
from tessera.plans.bindings import Views, query
from tessera.sources import readers, writers
from tessera.staging import folder, staged


def _folder(v: Views, name: str) -> str:
    return folder(v.spark, name)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


# -- files: written, and read again by the readers --------------------------------------------------------------------


@query("SELECT 'RF' || record_id % 7 AS rfam_acc, CAST(record_id AS BIGINT) AS seq_start, CAST(record_id + length(seq) AS BIGINT) AS seq_end, CAST(length(seq) AS BIGINT) AS n, md5(seq) AS digest FROM seqs WHERE length(seq) > 0", "seqs")
def src_fasta(v: Views) -> DataFrame:
    path, s = _folder(v, "fasta"), v.seqs()
    head = F.concat_ws("|", F.concat(F.lit("RF"), F.col("record_id") % 7), F.lit("id"), F.concat(F.lit("A|"), F.col("record_id")), F.concat_ws("-", "record_id", F.col("record_id") + F.length("seq")), F.lit("label=1"))
    writers.fasta(s.where(F.length("seq") > 0), path, head, "seq")
    rows = readers.fasta(v.spark, path, complete=True).withColumn("h", readers.panel_header(F.col("header")))
    return rows.select("h.rfam_acc", "h.seq_start", "h.seq_end", F.col("seq_length").cast("long").alias("n"), F.md5("sequence").alias("digest"))


@query("SELECT query, target, evalue, round(ident, 6) AS identity_frac FROM hits_a WHERE evalue <= 0.05", "hits_a")
def src_hit_table(v: Views) -> DataFrame:
    path, zero = _folder(v, "hits"), F.lit(0)
    h = v.hits(False).select(F.col("query").cast("string"), F.col("target").cast("string"), F.col("ident") * 100, *(zero.alias(f"c{i}") for i in range(7)), "evalue", F.lit(1.0).alias("bits"))
    h.write.csv(path, sep="\t")
    return readers.tabular_hits(v.spark, path, 0.05).select(F.col("query").cast("long"), F.col("target").cast("long"), "evalue", F.round("identity_frac", 6).alias("identity_frac"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def src_json_lines(v: Views) -> DataFrame:
    path = _folder(v, "json")
    v.table("conversations").write.json(path)
    return readers.json_lines(v.spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def src_csv(v: Views) -> DataFrame:
    path, n = _folder(v, "csv"), v.table("nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.csv(path, header=True)
    return readers.csv_table(v.spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint", ["n_nationkey", "n_name", "n_regionkey"])


# -- derived columns and rules ----------------------------------------------------------------------------------------


@query(
    "SELECT r_name AS region, n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 0 GROUP BY 1, 2"
)
def src_catalogue(v: Views) -> DataFrame:
    """Tables of a relational database, the largest read in ranges of its key; the filter runs in the database.

    The database is the one that ships with Spark and lives in the driver, so this plan is for a local session.
    """
    import uuid

    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    columns = {"customer": ("c_custkey", "c_nationkey", "c_acctbal"), "nation": ("n_nationkey", "n_regionkey", "n_name"), "region": ("r_regionkey", "r_name")}
    for name, of in columns.items():
        v.table(name).select(*of).write.format("jdbc").options(url=url, dbtable=name, driver=driver).save()
    t = readers.catalogue(v.spark, url, {"customer": '"c_custkey"', "nation": None, "region": None}, driver=driver)
    full = t["customer"].where("c_acctbal > 0").join(t["nation"], F.col("n_nationkey") == F.col("c_nationkey")).join(t["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    return full.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT id, round(amp / nullif(leak, 0), 6) AS per_leak, round(1 - leak, 6) AS paired FROM engines", "engines")
def prj_intensive(v: Views) -> DataFrame:
    return _rounded(v.engines().select("id", F.try_divide("amp", "leak").alias("per_leak"), (1 - F.col("leak")).alias("paired")), "per_leak", "paired")


@query("SELECT user_id, count(*) AS n, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS k, count(TRY_CAST(event_type AS DOUBLE)) AS numeric_types FROM events GROUP BY 1")
def prj_numeric(v: Views) -> DataFrame:
    k = g.number(F.get_json_object("props", "$.k"))
    return v.table("events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(k).alias("k"), F.count(g.number(F.col("event_type"))).alias("numeric_types"))


@query("SELECT query, least(coalesce(min(evalue) FILTER (line > 2), 1e308), coalesce(max(evalue), 1e308)) AS e FROM hits_a GROUP BY 1", "hits_a")
def prj_tightest(v: Views) -> DataFrame:
    e = v.hits(False).groupBy("query").agg(F.min(F.when(F.col("line") > 2, F.col("evalue"))).cast("string").alias("a"), F.max("evalue").cast("string").alias("b"))
    return e.select("query", F.least(g.tightest(F.col("a"), F.col("b")), F.lit(1e308)).alias("e"))


@query("SELECT id, concat_ws('; ', CASE WHEN tm_a > 45 THEN 'melts late' END, CASE WHEN n_a <= 1 THEN 'no switch' END, CASE WHEN leak > 0.16 THEN 'leaks' END) AS warnings FROM engines", "engines")
def flt_validation(v: Views) -> DataFrame:
    said = F.array(F.when(F.col("tm_a") > 45, "melts late"), F.when(F.col("n_a") <= 1, "no switch"), F.when(F.col("leak") > 0.16, "leaks"))
    return v.engines().select("id", F.array_join(F.array_compact(said), "; ").alias("warnings"))


@query("SELECT id, round(least(leak, 1), 6) AS bottom, round(least(leak + amp * 4.7, 1), 6) AS top FROM engines WHERE n_a * 2.2 >= 3 AND amp * 4.7 >= 0.35 AND cohort <> 0 ORDER BY amp DESC, id LIMIT 80", "engines")
def flt_strong_curves(v: Views) -> DataFrame:
    """Positives (here: all cohorts but one) with a steep, wide curve, the widest first."""
    e = v.engines().withColumn("n", F.col("n_a") * 2.2).withColumn("width", F.col("amp") * 4.7)
    top = e.where("n >= 3 and width >= 0.35 and cohort <> 0").orderBy(F.desc("amp"), "id").limit(80)  # a top-k report
    return _rounded(top.select("id", F.least("leak", F.lit(1.0)).alias("bottom"), F.least(F.col("leak") + F.col("width"), F.lit(1.0)).alias("top")), "bottom", "top")


@query("SELECT id FROM engines WHERE tm_a IS NOT NULL AND n_a IS NOT NULL", "engines")
def flt_complete(v: Views) -> DataFrame:
    e = v.engines()
    return e.dropna(subset=ops.present(e, ["tm_a", "n_a", "not_there"])).select("id")


# -- joins and unions -------------------------------------------------------------------------------------------------


@query("SELECT record_id, length(seq) AS n FROM seqs WHERE record_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", "seqs")
def join_extraction(v: Views) -> DataFrame:
    ids = v.table("labels").where("toxic = 1").select(F.col("doc_id").alias("record_id"))
    return v.seqs().join(ids, "record_id", "left_semi").select("record_id", F.length("seq").cast("long").alias("n"))


@query("SELECT record_id, right(seq, 100) AS seq, CAST(greatest(length(seq) - 100, 0) AS BIGINT) AS start, round(CASE WHEN length(seq) > 0 THEN length(regexp_replace(right(seq, 100), '[^GC]', '', 'g')) / length(right(seq, 100)) ELSE 0 END, 6) AS gc FROM seqs", "seqs")
def join_truncated(v: Views) -> DataFrame:
    cut = v.seqs().select("record_id", F.right("seq", F.lit(100)).alias("seq"), F.greatest(F.length("seq") - 100, F.lit(0)).cast("long").alias("start"))
    return _rounded(cut.withColumn("gc", rna.gc_fraction(F.col("seq"))), "gc")


@query("SELECT 'classes' AS rule, count(DISTINCT label) AS value FROM panel UNION ALL SELECT 'shared keys', count(*) FROM (SELECT record_id FROM panel WHERE label = 1 INTERSECT SELECT record_id FROM panel WHERE label = 0) UNION ALL SELECT 'repeated keys', count(*) FROM (SELECT record_id FROM panel GROUP BY 1 HAVING count(*) > 1)", "panel")
def join_recombined(v: Views) -> DataFrame:
    p = staged(v.panel().select("record_id", "label"), "panel")
    one, zero = p.where("label = 1"), p.where("label = 0")
    full = one.unionByName(zero)
    said = lambda df, rule: df.select(F.lit(rule).alias("rule"), "value")
    parts = [said(full.agg(F.countDistinct("label").alias("value")), "classes"), said(one.join(zero, "record_id", "left_semi").agg(F.count("*").alias("value")), "shared keys"), said(ops.duplicated(full, ["record_id"]).agg(F.count("*").alias("value")), "repeated keys")]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT s_suppkey, n_name, count_star() OVER (PARTITION BY n_name) AS of_nation FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def join_group_metadata(v: Views) -> DataFrame:
    nation = v.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    full = ops.strict_join(v.table("supplier").select("s_suppkey", "s_nationkey"), nation, ["s_nationkey"])
    return full.join(full.groupBy("n_name").agg(F.count("*").alias("of_nation")), "n_name").select("s_suppkey", "n_name", "of_nation")


@query(
    """WITH c AS (SELECT record_id, seq, record_id % 50 AS a, CAST(greatest(length(seq) - record_id % 37, 0) AS BIGINT) AS b, CASE WHEN record_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM seqs),
    u AS (SELECT *, CASE WHEN b > a THEN substr(seq, a + 1, b - a) ELSE '' END AS cut FROM c), r AS (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(cut, 'AUGC', 'UACG')) ELSE cut END AS x FROM u WHERE length(cut) >= 200)
    SELECT record_id AS seqid, strand, CASE WHEN strand = '+' THEN b - length(right(x, 600)) + 1 ELSE a + 1 END AS seq_start, CASE WHEN strand = '+' THEN b ELSE a + length(right(x, 600)) END AS seq_end, md5(right(x, 600)) AS digest, length(right(x, 600)) AS n FROM r""",
    "seqs",
)
def join_extracted(v: Views) -> DataFrame:
    s = v.seqs()
    at = s.select(F.col("record_id").alias("seqid"), (F.col("record_id") % 50).cast("int").alias("a"), F.greatest(F.length("seq") - F.col("record_id") % 37, F.lit(0)).cast("int").alias("b"), F.when(F.col("record_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    got = ops.extracted(at.where("b > a"), s.withColumnRenamed("record_id", "seqid"))
    return got.select("seqid", "strand", F.col("seq_start").cast("long").alias("seq_start"), F.col("seq_end").cast("long").alias("seq_end"), F.md5("sequence").alias("digest"), F.col("seq_length").cast("long").alias("n"))


@query("SELECT o_orderkey AS k, o_custkey, CAST(x AS DOUBLE) AS o_totalprice, lines FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 4) AS x, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def join_refreshed(v: Views) -> DataFrame:
    base = v.table("orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice")
    patch = v.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_quantity"), 4).cast("double").alias("o_totalprice"), F.count("*").alias("lines"))
    return ops.refreshed(base, patch, ["k"])


# -- reports ----------------------------------------------------------------------------------------------------------


@query("SELECT id, pos, round(greatest(0, least(1, 1 - sum(p))), 6) AS unpaired FROM (SELECT l_suppkey AS id, l_linenumber AS pos, l_discount / 20 AS p FROM lineitem UNION ALL SELECT l_suppkey, l_linenumber + 1, l_discount / 20 FROM lineitem) GROUP BY 1, 2")
def agg_unpaired(v: Views) -> DataFrame:
    line = v.table("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("i"), (F.col("l_discount") / 20).alias("p"))
    per = line.groupBy("id", "i").agg(F.sum("p").alias("p"))  # summed before both ends are told apart
    ends = per.select("id", F.explode(F.array(F.col("i"), F.col("i") + 1)).alias("pos"), "p")
    return _rounded(ends.groupBy("id", "pos").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sum("p"))).alias("unpaired")), "unpaired")


@query(
    """WITH m AS (SELECT l_suppkey AS id, l_quantity AS t, l_linenumber AS pos, avg(power(l_discount * 10, 3)) AS v FROM lineitem WHERE l_quantity IN (37, 43) GROUP BY 1, 2, 3),
    x AS (SELECT id, avg(v) FILTER (t = 37 AND pos BETWEEN 2 AND 3) AS sd_37, avg(v) FILTER (t = 43 AND pos BETWEEN 2 AND 3) AS sd_43, avg(v) FILTER (t = 43) AS global_43, avg(v) FILTER (t = 43 AND pos NOT BETWEEN 2 AND 3) AS scaffold_43 FROM m GROUP BY 1)
    SELECT id, round(sd_43, 6) AS sd_43, round(global_43, 6) AS global_43, round(scaffold_43, 6) AS scaffold_43, round(sd_43 - sd_37, 6) AS stroke,
    CASE WHEN global_43 <= 0.25 AND sd_43 - sd_37 >= 0.4 AND sd_43 >= 0.35 THEN 1 WHEN sd_43 <= 0.1 AND abs(sd_43 - sd_37) < 0.05 THEN 2 ELSE 3 END AS scenario FROM x"""
)
def agg_heat_map(v: Views) -> DataFrame:
    """Means over the motif's positions, over all, and over the rest; and how a rescue went: 1 ideal, 2 locked, 3 in part."""
    line = v.table("lineitem").where(F.col("l_quantity").isin(37, 43))
    m = line.groupBy(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("t"), F.col("l_linenumber").alias("pos")).agg(F.avg(F.pow(F.col("l_discount") * 10, 3)).alias("v"))
    motif = F.col("pos").between(2, 3)
    at = lambda t, where: F.avg(F.when((F.col("t") == t) & where, F.col("v")))
    x = m.groupBy("id").agg(at(37, motif).alias("sd_37"), at(43, motif).alias("sd_43"), at(43, F.lit(True)).alias("global_43"), at(43, ~motif).alias("scaffold_43"))
    x = x.withColumn("stroke", F.col("sd_43") - F.col("sd_37"))
    ideal = (F.col("global_43") <= 0.25) & (F.col("stroke") >= 0.4) & (F.col("sd_43") >= 0.35)
    kind = F.when(ideal, 1).when((F.col("sd_43") <= 0.1) & (F.abs("stroke") < 0.05), 2).otherwise(3)
    return _rounded(x.select("id", "sd_43", "global_43", "scaffold_43", "stroke", kind.alias("scenario")), "sd_43", "global_43", "scaffold_43", "stroke")


@query("SELECT cohort, count(*) AS n, round(avg(tm_a), 6) AS tm, round(avg(amp), 6) AS amp, round(median(n_a), 6) AS slope FROM engines GROUP BY 1", "engines")
def agg_cohort_table(v: Views) -> DataFrame:
    n = v.engines().groupBy("cohort").agg(F.count("*").alias("n"), F.avg("tm_a").alias("tm"), F.avg("amp").alias("amp"), F.percentile("n_a", 0.5).alias("slope"))
    return _rounded(n, "tm", "amp", "slope")


@query("WITH c AS (SELECT count(*) AS n FROM seqs GROUP BY seq) SELECT count(*) AS clusters, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, CAST(sum(n) FILTER (n >= 3) AS BIGINT) AS in_large FROM c", "seqs")
def agg_cluster_sizes(v: Views) -> DataFrame:
    c = v.seqs().groupBy(F.sha2("seq", 256).alias("d")).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum(F.when(F.col("n") >= 3, F.col("n"))).alias("in_large"))


@query("SELECT seqid, count(*) AS cds, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (stop - start < 10) AS too_short, count(*) FILTER (stop - start >= 10) AS kept FROM intervals GROUP BY 1", "intervals")
def agg_assembly_statistics(v: Views) -> DataFrame:
    short = F.col("stop") - F.col("start") < 10
    return v.intervals().groupBy("seqid").agg(F.count("*").alias("cds"), F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(short).alias("too_short"), F.count_if(~short).alias("kept"))


@query("SELECT round(avg(gc) FILTER (label = 1), 6) AS mean1, round(avg(gc) FILTER (label = 0), 6) AS mean0, round(avg(gc) FILTER (label = 1) - avg(gc) FILTER (label = 0), 6) AS gap, avg(gc) FILTER (label = 1) > avg(gc) FILTER (label = 0) AS higher FROM panel", "panel")
def agg_enrichment(v: Views) -> DataFrame:
    m = lambda c: F.avg(F.when(F.col("label") == c, F.col("gc")))
    x = v.panel().agg(m(1).alias("mean1"), m(0).alias("mean0"))
    return _rounded(x.select("mean1", "mean0", (F.col("mean1") - F.col("mean0")).alias("gap"), (F.col("mean1") > F.col("mean0")).alias("higher")), "mean1", "mean0", "gap")


# -- curves -----------------------------------------------------------------------------------------------------------


@query("SELECT cohort, t, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT cohort, t, leak + amp / (1 + power(greatest(tm_a, 1e-6) / t, greatest(n_a, 1e-6))) AS x FROM engines, (VALUES (30.0::DOUBLE), (37.0::DOUBLE), (45.0::DOUBLE)) g(t)) GROUP BY 1, 2", "engines")
def crv_parameter_ribbon(v: Views) -> DataFrame:
    x = curves.evaluated(v.engines(), ["cohort"], [30.0, 37.0, 45.0], F.col("leak"), F.col("leak") + F.col("amp"), F.col("tm_a"), F.col("n_a"))
    return _rounded(curves.ribbon(x, ["cohort", "t"], "value").select("cohort", "t", "n", "mean"), "mean")


@query("SELECT a.n_name AS a, b.n_name AS b, len(list_filter(range(1, least(length(a.n_name), length(b.n_name)) + 1), lambda i: substr(a.n_name, i, 1) <> substr(b.n_name, i, 1))) AS mismatches FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def crv_dissimilarity(v: Views) -> DataFrame:
    n = v.table("nation").select("n_regionkey", "n_name")
    pairs = n.withColumnRenamed("n_name", "a").join(n.withColumnRenamed("n_name", "b"), "n_regionkey").where("a < b")
    size = F.least(F.length("a"), F.length("b"))
    apart = F.filter(F.sequence(F.lit(1), size), lambda i: F.col("a").substr(i, F.lit(1)) != F.col("b").substr(i, F.lit(1)))
    return pairs.select("a", "b", F.size(apart).cast("long").alias("mismatches"))


@query("SELECT id, t, p FROM sweeps WHERE (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM sweeps)) >= 0 AND t BETWEEN 37 AND 42", "sweeps")
def crv_cached(v: Views) -> DataFrame:
    cached = staged(v.sweeps(), "sweeps")
    wanted = v.table("supplier").select(F.col("s_suppkey").alias("id"))
    missing = wanted.join(cached.select("id"), "id", "left_anti")
    rows = cached if missing.isEmpty() else v.sweeps()
    return rows.join(wanted, "id", "left_semi").where(F.col("t").between(37, 42)).select("id", "t", "p")


# -- audits -----------------------------------------------------------------------------------------------------------

_ENN = """WITH g AS (SELECT record_id, substr(seq, i, k) AS w, count(*) AS n FROM (SELECT record_id, seq, k, unnest(range(1, length(seq) - k + 2)) AS i FROM panel, (VALUES (2), (3)) ks(k)) GROUP BY 1, 2),
 q AS (SELECT p.record_id, p.label, coalesce(sum(n * n), 0) AS s FROM panel p LEFT JOIN g USING (record_id) GROUP BY 1, 2),
 dot AS (SELECT x.record_id AS a, y.record_id AS b, sum(x.n * y.n) AS xy FROM g x JOIN g y USING (w) GROUP BY 1, 2),
 e AS (SELECT x.record_id AS a, y.label AS other, row_number() OVER (PARTITION BY x.record_id ORDER BY x.s + y.s - 2 * coalesce(xy, 0), y.record_id) AS r FROM q x JOIN q y ON x.record_id <> y.record_id LEFT JOIN dot ON a = x.record_id AND b = y.record_id),
 most AS (SELECT label FROM panel GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1)
 SELECT record_id FROM panel WHERE label <> (SELECT label FROM most) OR record_id NOT IN (SELECT a FROM e WHERE r <= 3 AND other <> (SELECT label FROM most))"""


@query(_ENN, "panel")
def smp_edited_neighbours(v: Views) -> DataFrame:
    """Rows of the larger class go if one of their three nearest rows, by counts of 2-mers and 3-mers, isn't of it."""
    return nearest.edited(v.panel(), "record_id", "seq", "label", (2, 3)).select("record_id")


def _features(v: Views) -> DataFrame:
    s, x = v.seqs(), rna.spacing(F.col("seq"))
    wide = sequences.with_kmer_vectors(s, "seq", {2: "dinuc_", 3: "trinuc_"})
    return wide.select("*", F.length("seq").alias("seq_length"), rna.gc_fraction(F.col("seq")).alias("viennarna_gc_content"), x.alias("sd_aug_spacing"), (x < 0).cast("int").alias("sd_aug_missing")).drop("seq")


@query()
def ml_feature_matrix(v: Views) -> DataFrame:
    """The columns of the non-circular set that sequences alone give."""
    x = _features(v)
    return x.select("record_id", *features.feature_columns(x.columns, "noncircular"))


_BLOCKS = "SELECT 0 AS position, 'seq_length' AS feature, 'composition' AS block UNION ALL SELECT 1, 'viennarna_gc_content', 'composition' UNION ALL SELECT 2 + i * 4 + j, 'dinuc_' || a || b, 'dinucleotides' FROM l1, l2 UNION ALL SELECT 18 + i * 16 + j * 4 + k, 'trinuc_' || a || b || c, 'trinucleotides' FROM l1, l2, l3 UNION ALL SELECT 82, 'sd_aug_spacing', 'spacing' UNION ALL SELECT 83, 'sd_aug_missing', 'spacing'"
_LETTERS = ", ".join(f"l{n}({i}, {x}) AS (VALUES (0, 'A'), (1, 'U'), (2, 'G'), (3, 'C'))" for n, i, x in ((1, "i", "a"), (2, "j", "b"), (3, "k", "c")))


@query(f"WITH {_LETTERS} SELECT position, feature, block, (SELECT count(*) FROM panel) AS rows, 0 AS missing_1, 0 AS missing_0 FROM ({_BLOCKS})", "panel")
def ml_feature_inventory(v: Views) -> DataFrame:
    """Every feature of the non-circular set with its block and its nulls by class."""
    labelled = v.table("labels").select(F.col("doc_id").alias("record_id"), F.col("quality").alias("label"))
    return models.inventory(_features(v).join(labelled, "record_id"), "noncircular", "label")


@query()
def ml_shortcut_gate(v: Views) -> DataFrame:
    """Cross-validated AUC of each composition shortcut alone and of both, against the gate of 0.65."""
    x = staged(models.stratified_folds(v.panel().select("record_id", "label", F.col("len").cast("double").alias("len"), "gc"), "label", "record_id", 2), "folds")
    parts = []
    for name, features in {"length": ["len"], "composition": ["gc"], "both": ["len", "gc"]}.items():
        auc = models.evaluated(staged(models.out_of_fold(x, features, "label", 2, trees=10, depth=5), "scores"), "score", "label")
        parts.append(auc.select(F.lit(name).alias("features"), "auc", (F.col("auc") <= 0.65).alias("passes")))
    return reduce(DataFrame.unionByName, parts)


@query()
def ml_design_comparison(v: Views) -> DataFrame:
    """Random folds against folds that keep groups apart: how much of the AUC is only groups seen before."""
    p = staged(v.panel().select("record_id", "label", "grp", F.col("len").cast("double").alias("len"), "gc"), "panel")
    made = {"random": models.stratified_folds(p, "label", "record_id", 2), "grouped": models.group_folds(p, "grp", "label", 2)}
    parts = [models.evaluated(staged(models.out_of_fold(staged(d, "folds"), ["len", "gc"], "label", 2, trees=10, depth=5), "scores"), "score", "label").select(F.lit(n).alias("design"), "auc", "accuracy") for n, d in made.items()]
    return parts[0].unionByName(parts[1])


def _bin() -> Column:
    return g.confidence(F.col("gc"))


@query("SELECT bin, count(*) AS n, count(*) FILTER (label = 1) AS positives, round(avg(len), 6) AS mean_len FROM (SELECT *, CASE WHEN gc >= 0.8 THEN 'high' WHEN gc <= 0.2 THEN 'low' WHEN gc > 0.4 AND gc < 0.6 THEN 'mid' ELSE 'other' END AS bin FROM panel) GROUP BY 1", "panel")
def ml_confidence_report(v: Views) -> DataFrame:
    n = v.panel().groupBy(_bin().alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.avg("len").alias("mean_len"))
    return _rounded(n, "mean_len")


@query()
def sta_cohort_tests(v: Views) -> DataFrame:
    """Every feature between each cohort and the others."""
    x = v.engines().select("cohort", "tm_a", "tm_b", "n_a", "amp").unpivot("cohort", ["tm_a", "tm_b", "n_a", "amp"], "feature", "x")
    each = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return st.with_p_values(st.two_sample(each, ["other", "feature"], "x", F.col("cohort") == F.col("other")))


# -- edits, clusters and second passes --------------------------------------------------------------------------------


def _folded(v: Views) -> DataFrame:
    return v.seqs().withColumn("b", F.translate("seq", "AUGC", "().."))


@query()
def prj_clamped(v: Views) -> DataFrame:
    s = _folded(v)
    return sequences.clamped(sequences.with_pairs(s, "b"), None, "record_id", "seq").select("record_id", "edits", F.md5("clamped").alias("digest"))


@query()
def clu_representatives(v: Views) -> DataFrame:
    """Redundancy removal, longest first: no two that are kept are similar, and all others are similar to one that is."""
    s = v.seqs()
    copies = s.groupBy("seq").agg(F.min("record_id").alias("record_id"))
    return matching.first_independent(copies, sequences.similar(s, "record_id", "seq"), "record_id")


@query()
def join_escalated(v: Views) -> DataFrame:
    z = staged(matching.standardised(v.measured().select("record_id", "label", "len", "gc"), ["len", "gc"]), "standardised")
    bad, good, gates, by = z.where("label = 0"), z.where("label = 1"), {"len": 40, "gc": 0.02}, {"len": "z_len", "gc": "z_gc"}
    first = staged(matching.greedy(matching.candidates(bad, good, "record_id", gates, by, 4)), "first")
    more = matching.escalated(bad, good, first, "record_id", "len", gates, by, 4)
    return first.withColumn("phase", F.lit("first")).unionByName(more.withColumn("phase", F.lit("escalated")))


@query("SELECT label, (SELECT min(n) FROM (SELECT count(*) AS n FROM panel GROUP BY label)) AS n FROM panel GROUP BY 1", "panel")
def smp_balanced(v: Views) -> DataFrame:
    return models.balanced(v.panel().select("record_id", "label"), "label", "record_id").groupBy("label").agg(F.count("*").alias("n"))


@query()
def ml_predictions(v: Views) -> DataFrame:
    x = staged(v.panel().select("record_id", "label", F.col("len").cast("double").alias("len"), "gc"), "panel")
    path = _folder(v, "forest")
    models.forest(["len", "gc"], "label", trees=20, depth=8).fit(x).write().overwrite().save(path)
    from pyspark.ml import PipelineModel

    return models.scored(PipelineModel.load(path), x).select("record_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
