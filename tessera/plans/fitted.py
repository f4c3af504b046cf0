"""Plans on fitted curves: fits of curves whose parameters the tables give, so that the parameters must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rna import gc_fraction, hill
from tessera.operators import fits
from tessera.operators import sequences as seq_ops
from tessera.plans import sequences  # noqa: F401  its SQL is a part of one here
from tessera.plans.bindings import SQL, Views, query
from tessera.plans.panels import coarse

TEMPS = [float(t) for t in range(10, 81, 2)]
#: Two curves for each supplier: (bottom, top, melting point, slope), from its order lines.
_A = {"bottom": "leak / 2", "top": "leak / 2 + 0.3 + amp", "tm": "tm_a", "n": "2 + n_a"}
_B = {"bottom": "amp / 4", "top": "0.6 + leak", "tm": "30 + tm_b / 4", "n": "5 + 2 * n_b"}


def _curve(x: dict[str, str]) -> Column:
    return hill(F.col("t"), *(F.expr(x[c]) for c in ("bottom", "top", "tm", "n")))


def _measured(v: Views) -> DataFrame:
    """(id, cohort, t, a, b, engine columns): both curves of each supplier on the grid."""
    e = v.engines().select("*", F.explode(F.array(*map(F.lit, TEMPS))).alias("t"))
    return e.withColumn("a", _curve(_A)).withColumn("b", _curve(_B))


def _r(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if c in columns else F.col(c) for c in df.columns))


@query(
    f"""SELECT id, CASE WHEN id % 10 < 2 THEN NULL ELSE round({_A['tm']}, 3) END AS tm, CASE WHEN id % 10 < 2 THEN NULL ELSE round({_A['n']}, 3) END AS n,
    CASE id % 10 WHEN 0 THEN round(leak, 4) WHEN 1 THEN NULL ELSE round({_A['bottom']}, 4) END AS bottom, CASE id % 10 WHEN 0 THEN round(leak, 4) WHEN 1 THEN NULL ELSE round({_A['top']}, 4) END AS top,
    CASE id % 10 WHEN 1 THEN NULL ELSE 0.0 END AS rmse, CASE WHEN id % 10 >= 2 THEN 1.0 END AS r2, id % 10 >= 2 AS converged, CASE id % 10 WHEN 0 THEN 'flat' WHEN 1 THEN 'non_finite' ELSE 'ok' END AS status, 36 AS points FROM engines""",
    "engines",
)
def crv_refined_fit(v: Views) -> DataFrame:
    """Bounded fits: the parameters of each curve come back; every tenth curve is flat, every other tenth lacks a point."""
    value = F.when(F.col("id") % 10 == 0, F.col("leak")).when((F.col("id") % 10 == 1) & (F.col("t") == 40), F.lit(None)).otherwise(F.col("a"))
    fit = fits.refined(_measured(v).withColumn("value", value), "id", "t", "value").drop("amplitude")
    return _r(_r(fit, 3, "tm", "n"), 4, "bottom", "top", "rmse", "r2")


@query(
    f"""SELECT id, round({_A['tm']}, 3) AS tm_a, round({_A['n']}, 3) AS n_a, round(({_A['top']}) - ({_A['bottom']}), 4) AS amplitude_a, 'ok' AS status_a,
    round({_B['tm']}, 3) AS tm_b, round({_B['n']}, 3) AS n_b, round(({_B['top']}) - ({_B['bottom']}), 4) AS amplitude_b, true AS converged_b,
    round({_A['bottom']} + (({_A['top']}) - ({_A['bottom']})) / (1 + power(({_A['tm']}) / 37.0, {_A['n']})), 5) AS at_37, round({_A['bottom']} + (({_A['top']}) - ({_A['bottom']})) / (1 + power(({_A['tm']}) / 55.0, {_A['n']})), 5) AS at_55 FROM engines""",
    "engines",
)
def crv_refined_engines(v: Views) -> DataFrame:
    """Each record's fits of both engines, and the measured values at 37 and 55 between the grid's points."""
    from tessera.operators.curves import interpolated

    m = _measured(v)
    wide = fits.refined_engines(m, "id", "t", {"a": "a", "b": "b"})
    exact = m.select("id", *v.engines().columns[2:]).dropDuplicates(["id"])
    points = exact.select("*", F.explode(F.array(F.lit(37.0), F.lit(55.0))).alias("t")).withColumn("a", _curve(_A))
    at = [interpolated(points, "id", "t", "a", x).withColumnRenamed("a", f"at_{x:.0f}") for x in (37.0, 55.0)]
    full = wide.join(at[0], "id").join(at[1], "id")
    out = full.select("id", "tm_a", "n_a", "amplitude_a", "status_a", "tm_b", "n_b", "amplitude_b", "converged_b", "at_37", "at_55")
    return _r(_r(_r(out, 3, "tm_a", "n_a", "tm_b", "n_b"), 4, "amplitude_a", "amplitude_b"), 5, "at_37", "at_55")


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'a' END AS model, id % 4 <> 3 AS exact FROM engines", "engines")
def crv_model_errors(v: Views) -> DataFrame:
    """The parameterisation whose fit errs less: one is spoilt by a zigzag, or lacks points and so has no error; of two without an error, the first."""
    m, k = _measured(v), F.col("id") % 4
    zigzag = F.when(F.floor(F.col("t") / 2) % 2 == 0, 0.05).otherwise(-0.05)
    missing = F.col("t") == 30
    a = F.when(k == 0, F.col("a") + zigzag).when(((k == 2) | (k == 3)) & missing, F.lit(None)).otherwise(F.col("a"))
    b = F.when(k == 1, F.col("b") + zigzag).when((k == 3) & missing, F.lit(None)).otherwise(F.col("b"))
    best = fits.chosen_model(m.withColumn("x", a).withColumn("y", b), "id", "t", {"a": "x", "b": "y"})
    return best.select("id", "model", (F.coalesce("rmse", F.lit(1.0)) < 1e-6).alias("exact"))


_SHAPE = "1 / (1 + power(greatest(tm_a, 1e-6) / {t}, greatest(n_a, 1e-6)))"
_ANCHOR = f"CASE id % 3 WHEN 0 THEN leak WHEN 1 THEN 0.4 - amp * {_SHAPE.format(t='37.0')} ELSE 0.0 END"


@query(
    f"""SELECT cohort, t, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.25), 6) AS iqr_lo, round(quantile_cont(x, 0.75), 6) AS iqr_hi,
    round(avg(x) - 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(*)), 6) AS ci_lo, round(avg(x) + 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(*)), 6) AS ci_hi
    FROM (SELECT cohort, t, greatest(0, least(1, {_ANCHOR} + amp * {_SHAPE.format(t='t')})) AS x FROM engines, (VALUES (20.0::DOUBLE), (30.0::DOUBLE), (37.0::DOUBLE), (45.0::DOUBLE), (60.0::DOUBLE)) g(t) WHERE id % 7 <> 0) GROUP BY 1, 2""",
    "engines",
)
def crv_reconstructed_ribbon(v: Views) -> DataFrame:
    """Curves rebuilt from parameters: anchored at the bottom, at the value at 37, or at 0; those without a melting point are left out."""
    k, none = F.col("id") % 3, F.lit(None).cast("double")
    e = v.engines().withColumn("bottom", F.when(k == 0, F.col("leak")).otherwise(none)).withColumn("p37", F.when(k == 1, F.lit(0.4)).otherwise(none)).withColumn("tm_a", F.when(F.col("id") % 7 != 0, F.col("tm_a")))
    curves = fits.reconstructed(e, ["cohort", "id"], [20.0, 30.0, 37.0, 45.0, 60.0], "tm_a", "n_a", "amp", "bottom", "p37")
    return _r(fits.parameter_ribbon(curves, "cohort", "id"), 6, "mean", "iqr_lo", "iqr_hi", "ci_lo", "ci_hi")


@query(
    f"""WITH d AS (SELECT id, t, (0.3 + amp) * ({_A['n']}) * power({_A['tm']}, {_A['n']}) * power(t, ({_A['n']}) - 1) / power(power({_A['tm']}, {_A['n']}) + power(t, {_A['n']}), 2) AS v FROM engines, (SELECT unnest(range(10, 81, 2))::DOUBLE AS t)),
    p AS (SELECT id, max(v) AS top, min_by(t, struct_pack(v := -v, t := t)) AS peak FROM d GROUP BY 1),
    w AS (SELECT id, any_value(peak) AS peak_t, coalesce(max(t) FILTER (v < top / 2 AND t < peak), min(t)) AS l, coalesce(min(t) FILTER (v < top / 2 AND t > peak), max(t)) AS r FROM d JOIN p USING (id) GROUP BY 1)
    SELECT id, peak_t, CASE WHEN r > l THEN r - l END AS width FROM w""",
    "engines",
)
def crv_derivative_width(v: Views) -> DataFrame:
    """Where each curve is steepest, and its derivative's full width at half of that."""
    slope = fits.derivative(v.engines(), ["id"], TEMPS, *(F.expr(_A[c]) for c in ("bottom", "top", "tm", "n")))
    return fits.full_width(slope, ["id"], "t", "value")


@query(
    f"""WITH m AS ({SQL['prj_stem_mutations']}), s AS (SELECT doc_id AS record_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'AUGCAUGCAUGCAUGCAUGCAUGCAU') AS seq FROM documents WHERE text IS NOT NULL),
    x AS (SELECT record_id, i, j, unnest([struct_pack(variant := 'wildtype', s := seq), struct_pack(variant := 'disrupt', s := broken), struct_pack(variant := 'rescue', s := rescued)], recursive := true) FROM m JOIN s USING (record_id))
    SELECT record_id, variant, t, floor(length(regexp_replace(s, '[^GC]', '', 'g')) / length(s) * t / 100 * 1000000 + 0.5) / 1000000 AS value, i, j FROM x, (VALUES (20.0::DOUBLE), (37.0::DOUBLE), (60.0::DOUBLE)) g(t)"""
)
def crv_variants(v: Views) -> DataFrame:
    """Melting curves of each design's wild type, broken stem and rescue; a sequence's curve is measured once, whoever bears it."""
    from tessera.staging import staged

    made = seq_ops.stem_mutations(seq_ops.with_pairs(v.seqs().withColumn("b", F.translate("seq", "AUGC", "()..")), "b"), "record_id", "seq")
    designs = staged(made.withColumnRenamed("seq", "wildtype"), "designs")
    each = designs.select(F.explode(F.array("wildtype", "broken", "rescued")).alias("seq")).distinct()
    sweeps = each.select("seq", F.explode(F.array(*map(F.lit, (20.0, 37.0, 60.0)))).alias("t")).withColumn("p", gc_fraction(F.col("seq")) * F.col("t") / 100)
    got = fits.variant_sweeps(designs, sweeps, "record_id", {"wildtype": "wildtype", "disrupt": "broken", "rescue": "rescued"}, "seq", "t", "p")
    return coarse(got.select("record_id", "variant", "t", "value", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")), "value", 6)
