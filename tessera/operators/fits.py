"""Bounded least-squares fits of melting curves, and what is read off fitted parameters.

Points are first summed up by curve and temperature (count, mean, spread), which loses nothing for least squares and
leaves at most one point for each temperature of the instrument's grid, however often it was measured. The curves of an Arrow
batch are then fitted at once, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rna import hill

#: The box of melting point and slope, how far ends may leave the measured range, the least range, and the R2 of a converged fit.
TM, SLOPE, BEYOND, LEAST_RANGE, GOOD = (5.0, 95.0), (0.1, 20.0), 0.5, 1e-6, 0.95
#: Starting melting points and slopes, steps of a fit, and points fitted at once.
STARTS, STEPS, AT_ONCE = [(a, b) for a in (15.0, 30.0, 45.0, 60.0, 75.0) for b in (1.0, 3.0, 9.0)], 300, 1 << 21


def _model(theta: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (curves x points) of parameters (bottom, top, tm, n), and their derivatives by the four."""
    bottom, top, tm, n = (theta[:, i, None] for i in range(4))
    logs = np.log(np.maximum(tm, 1e-6)) - np.log(np.maximum(t, 1e-6))
    s = 1 / (1 + np.exp(np.clip(n * logs, -700, 700)))
    slope = s * (1 - s) * (top - bottom)
    return bottom + (top - bottom) * s, np.stack([1 - s, s, -slope * n / np.maximum(tm, 1e-6), -slope * logs], axis=2)


def _started(t: np.ndarray, y: np.ndarray, w: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The best of the middle temperature with slope 2 and the STARTS, each with its best ends within the box."""
    last = (w > 0).sum(1)
    middle = np.take_along_axis(t, (last // 2)[:, None].clip(0, t.shape[1] - 1), 1)[:, 0]
    best, error = np.zeros((len(t), 4)), np.full(len(t), np.inf)
    for tm, n in [(middle, 2.0), *STARTS]:
        theta = np.stack([np.zeros(len(t)), np.ones(len(t)), np.broadcast_to(tm, len(t)), np.full(len(t), n)], axis=1)
        theta[:, 2:] = theta[:, 2:].clip(lower[:, 2:], upper[:, 2:])
        s, _ = _model(theta, t)
        total, ms, my = w.sum(1), (w * s).sum(1), (w * y).sum(1)
        spread = (w * s * s).sum(1) - ms * ms / total
        gain = ((w * s * y).sum(1) - ms * my / total) / np.maximum(spread, 1e-12)
        theta[:, 0] = ((my - gain * ms) / total).clip(lower[:, 0], upper[:, 0])
        theta[:, 1] = (theta[:, 0] + gain).clip(lower[:, 1], upper[:, 1])
        now = (w * (_model(theta, t)[0] - y) ** 2).sum(1)
        better = now < error
        best[better], error[better] = theta[better], now[better]
    return best


def fitted(t: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levenberg-Marquardt for all curves at once, projected on the box: parameters, squared errors, and whether each has settled.

    Rows are curves; ``w`` is 0 where a curve has no more points. A parameter at its bound whose descent leads out of
    the box stays there for the step.
    """
    low, high = (np.where(w > 0, y, v).min(1) if v > 0 else np.where(w > 0, y, v).max(1) for v in (np.inf, -np.inf))
    lower = np.stack([low - BEYOND, low, np.full(len(t), TM[0]), np.full(len(t), SLOPE[0])], axis=1)
    upper = np.stack([high + BEYOND, high + BEYOND, np.full(len(t), TM[1]), np.full(len(t), SLOPE[1])], axis=1)
    theta = _started(t, y, w, lower, upper)
    damp, settled = np.full(len(t), 1e-3), np.zeros(len(t), bool)
    f, j = _model(theta, t)
    error = (w * (f - y) ** 2).sum(1)
    for _ in range(STEPS):
        go = np.flatnonzero(~settled)
        if not len(go):
            break
        f, j = _model(theta[go], t[go])
        r = y[go] - f
        a = np.einsum("cp,cpi,cpk->cik", w[go], j, j)
        g = np.einsum("cp,cp,cpi->ci", w[go], r, j)
        held = ((theta[go] <= lower[go]) & (g < 0)) | ((theta[go] >= upper[go]) & (g > 0))
        g[held] = 0
        a[held] = 0
        a.transpose(0, 2, 1)[held] = 0
        diagonal = np.maximum(np.einsum("cii->ci", a), 1e-12)
        a[:, range(4), range(4)] = np.where(held, 1.0, diagonal * (1 + damp[go, None]))
        step = np.linalg.solve(a, g[:, :, None])[:, :, 0]
        new = (theta[go] + step).clip(lower[go], upper[go])
        now = (w[go] * (_model(new, t[go])[0] - y[go]) ** 2).sum(1)
        better = now < error[go]
        moved = np.abs(new - theta[go]) / np.maximum(np.abs(theta[go]), 1e-3)
        done = (better & (moved.max(1) < 1e-10)) | (damp[go] > 1e12) | (~better & (np.abs(step).max(1) < 1e-13)) | (error[go] < 1e-26)
        took = go[better]
        theta[took], error[took] = new[better], now[better]
        damp[go] = np.where(better, np.maximum(damp[go] / 4, 1e-14), damp[go] * 5)
        settled[go[done]] = True
    return theta, error, settled & np.isfinite(error)


def refined(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, points, tm, n, bottom, top, amplitude, rmse, r2, converged, status) of the best Hill curve of each key.

    Bounded as the reference's fit: ends at most BEYOND outside the measured range (the top not below it), melting point
    and slope in their box. Status: 'ok', 'flat' (a range under 1e-6: ends and amplitude as measured, rmse 0), 'non_finite' (a value
    that is null, NaN or infinite) or 'optimize_failed'. r2 is 1 where the values hardly vary about their mean; converged: ok with an r2 of
    0.95 or more. Repeated measurements at one temperature all count. An empty table gives no rows.
    """
    of = df.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("y"))
    bad = F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf")) | F.col("t").isNull() | F.isnan("t")
    point = of.groupBy("key", "t").agg(
        F.count("*").alias("w"), F.avg("y").alias("y"), F.coalesce(F.var_pop("y"), F.lit(0.0)).alias("v"), F.min("y").alias("low"), F.max("y").alias("high"), F.max(bad).alias("bad")
    )
    curve = point.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("t", "y", "w"))).alias("points"),  # one for each temperature
        F.sum("w").alias("n"), F.sum(F.col("v") * F.col("w")).alias("within"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("bad").alias("bad"),
    )
    names = ["tm", "n", "bottom", "top", "rmse", "r2", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["points", "n", "within", "low", "high", "bad"]).to_pylist()
            out: list[tuple] = [("non_finite",)] * len(rows)
            todo = []
            for i, r in enumerate(rows):
                if not r["bad"]:
                    out[i] = ("flat",)
                    if r["high"] - r["low"] >= LEAST_RANGE:
                        todo.append(i)
            longest = max((len(rows[i]["points"]) for i in todo), default=1)
            for at in range(0, len(todo), max(1, AT_ONCE // longest)):
                part = todo[at : at + max(1, AT_ONCE // longest)]
                x = np.zeros((3, len(part), max(len(rows[i]["points"]) for i in part)))
                x[0] = 1.0
                for c, i in enumerate(part):
                    p = rows[i]["points"]
                    x[:, c, : len(p)] = [[q["t"] for q in p], [q["y"] for q in p], [q["w"] for q in p]]
                theta, error, ok = fitted(*x)
                mean = (x[1] * x[2]).sum(1) / x[2].sum(1)
                total = (x[2] * (x[1] - mean[:, None]) ** 2).sum(1)
                for c, i in enumerate(part):
                    sse, sst = error[c] + rows[i]["within"], total[c] + rows[i]["within"]
                    told = (*(float(v) for v in theta[c]), float(np.sqrt(sse / rows[i]["n"])), float(1 - sse / sst) if sst > 1e-12 else 1.0)
                    out[i] = ("ok", *told) if ok[c] else ("optimize_failed",)
            columns = []
            for name in ("tm", "n", "bottom", "top", "rmse", "r2"):
                place = {"bottom": 1, "top": 2, "tm": 3, "n": 4, "rmse": 5, "r2": 6}[name]
                values = []
                for r, o in zip(rows, out, strict=True):
                    flat = {"bottom": r["low"], "top": r["high"], "rmse": 0.0}.get(name) if o[0] == "flat" else None
                    values.append(o[place] if o[0] == "ok" else flat)
                columns.append(pa.array(values, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("n"), *columns, pa.array([o[0] for o in out])], names=["key", "points", *names])

    kind = curve.schema["key"].dataType.simpleString()
    fit = curve.mapInArrow(run, f"key {kind}, points long, tm double, n double, bottom double, top double, rmse double, r2 double, status string")
    good = F.coalesce((F.col("status") == "ok") & (F.col("r2") >= GOOD), F.lit(False))
    return fit.select(F.col("key").alias(key), "points", "tm", F.col("n"), "bottom", "top", (F.col("top") - F.col("bottom")).alias("amplitude"), "rmse", "r2", good.alias("converged"), "status")


def refined_engines(df: DataFrame, key: str, t: str, engines: dict[str, str]) -> DataFrame:
    """One row for each key with every engine's refined fit, the engine's name as suffix. All curves are fitted in one pass."""
    long = df.select(F.col(key).alias("_id"), F.col(t).alias("_t"), F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.col(c).cast("double").alias("y")) for e, c in engines.items()))).alias("x"))
    fit = refined(long.select(F.struct("_id", "x.e").alias("k"), "_t", F.col("x.y").alias("y")), "k", "_t", "y")
    names = ("tm", "n", "bottom", "top", "amplitude", "rmse", "r2", "converged", "status")
    wide = fit.groupBy(F.col("k._id").alias(key)).agg(*(F.max(F.when(F.col("k.e") == e, F.struct(*names))).alias(f"_{e}") for e in engines))
    return wide.select(key, *(F.col(f"_{e}.{c}").alias(f"{c}_{e}") for e in engines for c in names))


def chosen_model(df: DataFrame, key: str, t: str, engines: dict[str, str]) -> DataFrame:
    """(key, model, rmse): the parameterisation whose fit has the lower error; no error is the highest, ties go to the first named."""
    wide = refined_engines(df, key, t, engines)
    each = F.array(*(F.struct(F.coalesce(f"rmse_{e}", F.lit(float("inf"))).alias("rmse"), F.lit(i).alias("at"), F.lit(e).alias("model")) for i, e in enumerate(engines)))
    best = F.array_min(each)
    return wide.select(key, best["model"].alias("model"), F.nullif(best["rmse"], F.lit(float("inf"))).alias("rmse"))


def reconstructed(df: DataFrame, keep: list[str], temps: list[float], tm: str, n: str, amplitude: str, bottom: str, at_37: str | None = None) -> DataFrame:
    """(keep, t, value): the curve of each row's parameters, within 0 and 1.

    Anchored at the fitted bottom, else so that it passes through the value at 37, else at 0. Null where a parameter is
    missing.
    """
    shape = lambda t: hill(t, F.lit(0.0), F.lit(1.0), F.col(tm), F.col(n))
    anchor = F.coalesce(F.col(bottom), *([F.col(at_37) - F.col(amplitude) * shape(F.lit(37.0))] if at_37 else []), F.lit(0.0))
    value = anchor + F.col(amplitude) * shape(F.col("_t"))
    grid = df.select(*df.columns, F.explode(F.array(*map(F.lit, temps))).alias("_t"))
    known = F.col(tm).isNotNull() & F.col(n).isNotNull() & F.col(amplitude).isNotNull() & ~F.isnan(value)
    return grid.select(*keep, F.col("_t").alias("t"), F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("value"))


def parameter_ribbon(curves: DataFrame, cohort: str, key: str, t: str = "t", value: str = "value") -> DataFrame:
    """(cohort, t, n, mean, iqr_lo, iqr_hi, ci_lo, ci_hi) over reconstructed curves; one with any missing point is left out as a whole."""
    missing = F.col(value).isNull() | F.isnan(value)
    whole = curves.groupBy(cohort, key).agg(F.max(missing).alias("_bad")).where(~F.col("_bad")).drop("_bad")
    mean, half = F.avg(value), 1.96 * F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))
    return curves.join(whole, [cohort, key], "left_semi").groupBy(cohort, t).agg(
        F.count(value).alias("n"), mean.alias("mean"), F.percentile(value, 0.25).alias("iqr_lo"), F.percentile(value, 0.75).alias("iqr_hi"), (mean - half).alias("ci_lo"), (mean + half).alias("ci_hi")
    )


def derivative(df: DataFrame, keep: list[str], temps: list[float], bottom: Column, top: Column, tm: Column, n: Column) -> DataFrame:
    """(keep, t, value): the curve's analytic derivative by temperature, on a grid."""
    t = F.greatest(F.col("_t"), F.lit(1e-6))
    power, at = F.pow(tm, n), F.pow(t, n)
    value = (top - bottom) * n * power * F.pow(t, n - 1) / F.pow(power + at, 2)
    grid = df.select(*df.columns, F.explode(F.array(*map(F.lit, temps))).alias("_t"))
    return grid.select(*keep, F.col("_t").alias("t"), value.alias("value"))


def full_width(df: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """(by, peak_t, width): from the highest point (the first of equals) outwards to the first point under half of it, or the grid's end; null if there are fewer than three points or no width."""
    known = F.col(value).isNotNull() & ~F.isnan(value)
    peak = df.where(known).groupBy(*by).agg(F.min_by(F.struct(F.col(t).alias("t"), F.col(value).alias("v")), F.struct(-F.col(value), F.col(t))).alias("_peak"))
    low = F.coalesce(F.col(value) < F.col("_peak.v") / 2, F.lit(True))
    ends = df.join(peak, by).groupBy(*by).agg(
        F.first("_peak.t").alias("peak_t"),
        F.count("*").alias("_n"),
        F.coalesce(F.max(F.when(low & (F.col(t) < F.col("_peak.t")), F.col(t))), F.min(t)).alias("_a"),
        F.coalesce(F.min(F.when(low & (F.col(t) > F.col("_peak.t")), F.col(t))), F.max(t)).alias("_b"),
    )
    width = F.col("_b") - F.col("_a")
    return ends.select(*by, "peak_t", F.when((F.col("_n") >= 3) & (width > 0), width).alias("width"))


def variant_sweeps(designs: DataFrame, sweeps: DataFrame, key: str, variants: dict[str, str], sequence: str, t: str, value: str) -> DataFrame:
    """(key, variant, t, value, keep...): the measured curve of each variant of a designed row, for those with a design.

    ``variants``: name -> the column of ``designs`` that holds its sequence; a row with any of them missing has no
    design. ``sweeps``: (sequence, t, value) of every sequence that was measured; a variant not among them has one row
    without a temperature. Sequences meet by their hash and their text.
    """
    whole = designs.where(" and ".join(f"`{c}` is not null" for c in variants.values()))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(c).alias("seq")) for v, c in variants.items()))).alias("x")
    keep = [c for c in designs.columns if c not in (key, *variants.values())]
    long = whole.select(key, *keep, each).select(key, *keep, "x.variant", F.col("x.seq").alias("_seq"))
    curve = sweeps.select(F.col(sequence).alias("_seq"), F.col(t).alias("t"), F.col(value).alias("value"))
    return long.join(curve, "_seq", "left").select(key, "variant", "t", "value", *keep)
