"""Plans on sequences: composition, k-mers, motifs, quality rules, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rna
from tessera.operators import sequences as ops
from tessera.plans.bindings import Views, query


def _s() -> Column:
    return F.col("seq")


_MOTIF = """CASE WHEN instr(seq, 'AGGAGG') > 0 THEN instr(seq, 'AGGAGG') - 1 WHEN instr(seq, 'AGGAG') > 0 THEN instr(seq, 'AGGAG') - 1
 WHEN instr(seq, 'AGGA') > 0 THEN instr(seq, 'AGGA') - 1 ELSE greatest(length(seq) - 10, 0) END"""
_END = """CASE WHEN instr(seq, 'AGGAGG') > 0 THEN instr(seq, 'AGGAGG') + 5 WHEN instr(seq, 'AGGAG') > 0 THEN instr(seq, 'AGGAG') + 4
 WHEN instr(seq, 'AGGA') > 0 THEN instr(seq, 'AGGA') + 3 ELSE length(seq) END"""


@query("SELECT doc_id AS record_id, replace(upper(trim(regexp_replace(text, '[^ -~]', '', 'g'), ' ')), 'T', 'U') AS seq FROM documents")
def prj_normalized(v: Views) -> DataFrame:
    return v.table("documents").select(F.col("doc_id").alias("record_id"), rna.normalized(F.regexp_replace("text", "[^ -~]", "")).alias("seq"))


@query("SELECT record_id, length(seq) AS n, round(CASE WHEN length(seq) > 0 THEN length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) ELSE 0 END, 6) AS gc FROM seqs", "seqs")
def prj_length_gc(v: Views) -> DataFrame:
    return v.seqs().select("record_id", F.length(_s()).cast("long").alias("n"), F.round(rna.gc_fraction(_s()), 6).alias("gc"))


_KMERS = """WITH t AS (SELECT record_id, k, length(seq) - k + 1 AS n, substr(seq, i, k) AS kmer FROM (SELECT record_id, seq, k, unnest(range(1, length(seq) - k + 2)) AS i FROM seqs, (VALUES (2), (3)) ks(k) WHERE length(seq) >= k))
SELECT record_id, k, kmer, count(*) AS n, round(count(*) / any_value(n), 12) AS share FROM t GROUP BY record_id, k, kmer"""


@query(_KMERS, "seqs")
def prj_kmer_frequencies(v: Views) -> DataFrame:
    return ops.kmer_table(v.seqs(), "record_id", "seq", (2, 3)).withColumn("share", F.round("share", 12))


@query(
    "WITH t AS (SELECT record_id, length(seq) - 1 AS n, substr(seq, i, 2) AS kmer FROM (SELECT record_id, seq, unnest(range(1, length(seq))) AS i FROM seqs)), c AS (SELECT record_id, kmer, count(*) / any_value(n) AS share FROM t GROUP BY 1, 2) SELECT record_id, "
    + ", ".join(f"round(coalesce(max(share) FILTER (kmer = '{a + b}'), 0), 6) AS dinuc_{a + b}" for a in rna.BASES for b in rna.BASES)
    + " FROM seqs LEFT JOIN c USING (record_id) GROUP BY record_id",
    "seqs",
)
def prj_kmer_vector(v: Views) -> DataFrame:
    wide = ops.kmer_vector(v.seqs(), "record_id", "seq", 2, "dinuc_")
    return wide.select("record_id", *(F.round(c, 6).alias(c) for c in wide.columns if c != "record_id"))


@query("SELECT kmer, count(*) AS n, count(DISTINCT record_id) AS records FROM (SELECT record_id, substr(seq, i, 4) AS kmer FROM (SELECT record_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM seqs WHERE length(seq) >= 4)) GROUP BY kmer", "seqs")
def prj_kmer_tokens(v: Views) -> DataFrame:
    tokens = ops.kmer_tokens(v.seqs(), "record_id", "seq", (4,)).groupBy("kmer", "record_id").agg(F.count("*").alias("n"))
    return tokens.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("records"))


@query(f"SELECT record_id, {_MOTIF} AS first, {_END} AS stop FROM seqs", "seqs")
def prj_motif(v: Views) -> DataFrame:
    m = rna.motif(_s())
    return v.seqs().select("record_id", m["start"].cast("long").alias("first"), m["end"].cast("long").alias("stop"))


@query(f"SELECT record_id, spacing, CASE WHEN spacing < 0 THEN 1 ELSE 0 END AS missing FROM (SELECT record_id, CASE WHEN instr(substr(seq, e + 1), 'AUG') > 0 THEN instr(substr(seq, e + 1), 'AUG') - 1 ELSE -1 END AS spacing FROM (SELECT record_id, seq, {_END} AS e FROM seqs))", "seqs")
def prj_motif_spacing(v: Views) -> DataFrame:
    x = v.seqs().select("record_id", rna.spacing(_s()).cast("long").alias("spacing"))
    return x.withColumn("missing", (F.col("spacing") < 0).cast("int"))


@query(
    f"""SELECT record_id, CASE WHEN s >= n - 10 THEN n - w WHEN e - s >= w OR e - 1 >= greatest(0, least(s, n - w)) + w THEN greatest(0, e - w) ELSE greatest(0, least(s, n - w)) END AS first, w AS n
    FROM (SELECT record_id, length(seq) AS n, least(30, length(seq)) AS w, {_MOTIF} AS s, {_END} AS e FROM seqs)""",
    "seqs",
)
def prj_window(v: Views) -> DataFrame:
    w = rna.window(_s())
    return v.seqs().select("record_id", w["start"].cast("long").alias("first"), w["length"].cast("long").alias("n"))


@query("SELECT record_id, 42 + CAST('0x' || substr(md5(CAST(record_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 AS seed FROM seqs", "seqs")
def prj_stable_seed(v: Views) -> DataFrame:
    return v.seqs().select("record_id", rna.stable_seed(F.col("record_id").cast("string")).alias("seed"))


_BRACKETS = "replace(replace(replace(translate(seq, 'A', '('), 'U', ')'), 'G', '.'), 'C', '.')"


@query(
    f"""WITH c AS (SELECT record_id, i, CASE WHEN substr(b, i, 1) = '(' THEN 1 WHEN substr(b, i, 1) = ')' THEN -1 ELSE 0 END AS d, substr(b, i, 1) AS c FROM (SELECT record_id, b, unnest(range(1, length(b) + 1)) AS i FROM (SELECT record_id, {_BRACKETS} AS b FROM seqs))),
    w AS (SELECT record_id, c, sum(d) OVER (PARTITION BY record_id ORDER BY i) AS now FROM c),
    l AS (SELECT record_id, max(length(x)) AS loop FROM (SELECT record_id, unnest(regexp_split_to_array({_BRACKETS}, '[^.]+')) AS x FROM seqs) GROUP BY 1)
    SELECT record_id, CAST(greatest(coalesce(max(now) FILTER (c = '('), 0), 0) AS BIGINT) AS stem, coalesce(any_value(loop), 0) AS loop FROM seqs LEFT JOIN w USING (record_id) LEFT JOIN l USING (record_id) GROUP BY record_id""",
    "seqs",
)
def prj_bracket_metrics(v: Views) -> DataFrame:
    m = rna.stem_and_loop(F.translate(_s(), "AUGC", "().."))
    return v.seqs().select("record_id", m["stem"].cast("long").alias("stem"), m["loop"].cast("long").alias("loop"))


_PAIRS = f"""WITH c AS (SELECT record_id, i, substr(b, i, 1) AS c FROM (SELECT record_id, b, unnest(range(1, length(b) + 1)) AS i FROM (SELECT record_id, {_BRACKETS} AS b FROM seqs)) WHERE substr(b, i, 1) <> '.'),
 d AS (SELECT *, sum(CASE WHEN c = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY record_id ORDER BY i) AS h FROM c),
 f AS (SELECT *, h - least(0, coalesce(min(h) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g FROM d),
 k AS (SELECT *, CASE WHEN c = '(' THEN g ELSE g + 1 END AS level FROM f WHERE c = '(' OR g >= 0),
 n AS (SELECT *, lead(c) OVER x AS next_c, lead(i) OVER x AS next_i FROM k WINDOW x AS (PARTITION BY record_id, level ORDER BY i)),
 p AS (SELECT record_id, i - 1 AS i, next_i - 1 AS j FROM n WHERE c = '(' AND next_c = ')') """


@query(_PAIRS + "SELECT record_id, i, j FROM p", "seqs")
def prj_base_pairs(v: Views) -> DataFrame:
    return ops.base_pairs(v.seqs().withColumn("b", F.translate(_s(), "AUGC", "()..")), "record_id", "b").select("record_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


@query("SELECT record_id, concat_ws(',', CASE WHEN contains(d, 'GAATTC') THEN 'EcoRI' END, CASE WHEN contains(d, 'GGATCC') THEN 'BamHI' END, CASE WHEN contains(d, 'CTCGAG') THEN 'XhoI' END) AS sites FROM (SELECT record_id, replace(seq, 'U', 'T') AS d FROM seqs)", "seqs")
def prj_restriction_sites(v: Views) -> DataFrame:
    return v.seqs().select("record_id", F.array_join(rna.sites(_s()), ",").alias("sites"))


@query(
    _PAIRS
    + f""", w AS (SELECT record_id, seq, {_MOTIF} AS s, {_END} AS e FROM seqs), t AS (SELECT record_id, min(i * 1000000 + j) FILTER (i >= s AND i < e OR j >= s AND j < e) AS a, min(i * 1000000 + j) AS b FROM p JOIN w USING (record_id) GROUP BY 1),
    x AS (SELECT record_id, seq, coalesce(a, b) // 1000000 AS i, coalesce(a, b) % 1000000 AS j FROM w JOIN t USING (record_id))
    SELECT record_id, i, j, substr(seq, 1, i) || translate(substr(seq, i + 1, 1), 'AUGC', 'UACG') || substr(seq, i + 2) AS broken,
    substr(seq, 1, i) || translate(substr(seq, i + 1, 1), 'AUGC', 'UACG') || substr(seq, i + 2, j - i - 1) || translate(translate(substr(seq, i + 1, 1), 'AUGC', 'UACG'), 'AUGC', 'UACG') || substr(seq, j + 2) AS rescued FROM x""",
    "seqs",
)
def prj_stem_mutations(v: Views) -> DataFrame:
    full = ops.with_pairs(v.seqs().withColumn("b", F.translate(_s(), "AUGC", "()..")), "b")
    return ops.stem_mutations(full, "record_id", "seq").select("record_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "broken", "rescued")


@query("SELECT record_id FROM seqs WHERE regexp_full_match(seq, '[AUGC]+')", "seqs")
def flt_alphabet(v: Views) -> DataFrame:
    return v.seqs().where(_s().rlike("^[AUGC]+$")).select("record_id")


_MONO = "greatest(" + ", ".join(f"length(seq) - length(replace(seq, '{b}', ''))" for b in rna.BASES) + ")"
_RULES = f"""WITH k AS (SELECT record_id, k, substr(seq, i, k) AS mer FROM (SELECT record_id, seq, k, unnest(range(1, length(seq) - k + 2)) AS i FROM seqs, (VALUES (2), (3)) ks(k) WHERE length(seq) >= k)),
 c AS (SELECT record_id, max(n) FILTER (k = 2) AS dimer, count(*) FILTER (k = 3) AS unique3 FROM (SELECT record_id, k, mer, count(*) AS n FROM k GROUP BY ALL) GROUP BY 1),
 m AS (SELECT record_id, length(seq) AS n, {_MONO} / nullif(length(seq), 0) AS mono, dimer / nullif(length(seq) - 1, 0) AS dimer, unique3 / nullif(length(seq) - 2, 0) AS uniq FROM seqs LEFT JOIN c USING (record_id)),
 r AS (SELECT record_id, mono, dimer, uniq, CASE WHEN n = 0 THEN 'empty' WHEN n < 40 OR n > 600 THEN 'length' WHEN mono >= 0.85 THEN 'mono' WHEN dimer >= 0.85 THEN 'dimer' WHEN n >= 80 AND uniq < 0.05 THEN 'unique' END AS reason FROM m) """


@query(_RULES + "SELECT record_id, reason FROM r", "seqs")
def flt_first_failure(v: Views) -> DataFrame:
    return v.seqs().select("record_id", rna.first_failure(_s()).alias("reason"))


@query(_RULES + "SELECT record_id, round(mono, 6) AS mono, round(dimer, 6) AS dimer, round(CASE WHEN uniq > 0 THEN uniq END, 6) AS uniq FROM r WHERE uniq > 0", "seqs")
def flt_complexity(v: Views) -> DataFrame:
    pairs = [a + b for a in rna.BASES for b in rna.BASES]
    x = v.seqs().where(F.length(_s()) >= 3).select("record_id", rna.top_fraction(_s(), list(rna.BASES), 1).alias("mono"), rna.top_fraction(_s(), pairs, 2).alias("dimer"), rna.unique_ratio(_s()).alias("uniq"))
    return x.select("record_id", *(F.round(c, 6).alias(c) for c in ("mono", "dimer", "uniq")))


@query(_RULES + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1", "seqs")
def agg_drop_reasons(v: Views) -> DataFrame:
    return v.seqs().groupBy(F.coalesce(rna.first_failure(_s()), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT record_id, seq, row_number() OVER (PARTITION BY seq ORDER BY record_id) AS copy FROM seqs)
    SELECT record_id, copy FROM c WHERE copy <= 2""",
    "seqs",
)
def clu_copy_cap(v: Views) -> DataFrame:
    return ops.capped_copies(v.seqs(), "record_id", "seq", 2).select("record_id", F.col("copy").cast("long").alias("copy"))


@query(
    _RULES
    + """, s AS (SELECT record_id, source AS grp, seq, length(seq) AS n FROM seqs JOIN documents ON doc_id = record_id),
    w AS (SELECT grp, count(*) AS rows, count(*) FILTER (mono >= 0.85 OR dimer >= 0.85 OR n >= 80 AND uniq < 0.05) AS repetitive FROM s LEFT JOIN r USING (record_id) GROUP BY 1),
    u AS (SELECT grp, coalesce(max(m) FILTER (n > 0), 0) AS copies FROM (SELECT grp, n, count(*) AS m FROM s GROUP BY grp, seq, n) GROUP BY 1),
    p AS (SELECT x.grp, count(*) AS near_pairs FROM s x JOIN s y ON x.grp = y.grp AND x.record_id < y.record_id AND x.n > 0 AND least(x.n, y.n) >= 0.98 * greatest(x.n, y.n)
     WHERE least(x.n, y.n) - hamming(left(x.seq, least(x.n, y.n)), left(y.seq, least(x.n, y.n))) >= 0.98 * greatest(x.n, y.n) GROUP BY 1),
    o AS (SELECT grp, rows, repetitive, copies, coalesce(near_pairs, 0) AS near_pairs, coalesce(coalesce(near_pairs, 0) * 2 / nullif(rows * (rows - 1), 0), 0) AS near_share FROM w JOIN u USING (grp) LEFT JOIN p USING (grp))
    SELECT grp, rows, repetitive, copies, near_pairs, round(near_share, 6) AS near_share, concat_ws('; ', CASE WHEN repetitive > 0 THEN 'repetitive sequences: ' || repetitive END, CASE WHEN copies >= 3 THEN 'identical copies: ' || copies END, CASE WHEN near_share > 0.2 THEN 'near-identical pairs: ' || near_pairs END) AS errors FROM o""",
    "seqs",
)
def clu_collapse_report(v: Views) -> DataFrame:
    groups = v.table("documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("grp"))
    return ops.collapse_report(v.seqs().join(groups, "record_id"), "record_id", "seq", "grp").withColumn("near_share", F.round("near_share", 6))


@query("SELECT x.record_id AS a, y.record_id AS b FROM (SELECT min(record_id) AS record_id, seq, length(seq) AS n FROM seqs GROUP BY seq) x JOIN (SELECT min(record_id) AS record_id, seq, length(seq) AS n FROM seqs GROUP BY seq) y ON x.record_id < y.record_id AND x.n > 0 AND least(x.n, y.n) >= 0.98 * greatest(x.n, y.n) WHERE least(x.n, y.n) - hamming(left(x.seq, least(x.n, y.n)), left(y.seq, least(x.n, y.n))) >= 0.98 * greatest(x.n, y.n)", "seqs")
def join_near_identical(v: Views) -> DataFrame:
    return ops.near_identical(v.seqs(), "record_id", "seq", 0.98)


@query("SELECT round(corr(a, b), 6) AS r, count(*) AS n FROM (SELECT length(seq) AS a, length(regexp_replace(seq, '[^GC]', '', 'g')) AS b FROM seqs)", "seqs")
def sta_pearson(v: Views) -> DataFrame:
    x = v.seqs().select(F.length(_s()).alias("a"), rna.count_of(_s(), "GC").alias("b"))
    return x.agg(F.round(F.corr("a", "b"), 6).alias("r"), F.count("*").alias("n"))
