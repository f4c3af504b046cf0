"""Gates, flags, bins and scores. A gate on a missing value is false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the two checklists and weights of the score.
TIERS = {1: (1.2, 35.0, 55.0, 0.20, 0.35), 2: (1.5, 42.0, 45.0, 0.40, 0.20)}
IDEAL_TM = 43.5


def number(c: Column) -> Column:
    """Any column as a double; what isn't a number, and NaN, is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def above(c: Column, least: float) -> Column:
    return holds(number(c) > least)


def at_least(c: Column, least: float) -> Column:
    return holds(number(c) >= least)


def at_most(c: Column, most: float) -> Column:
    return holds(number(c) <= most)


def between(c: Column, low: float, high: float) -> Column:
    return holds(number(c).between(low, high))


def tightest(*evalues: Column) -> Column:
    """Least of several e-values; missing and unreadable ones are infinite."""
    far = F.lit(float("inf"))
    return F.least(*(F.coalesce(number(e), far) for e in evalues), far)


def confidence(p: Column) -> Column:
    return F.when(p >= 0.8, "high").when(p <= 0.2, "low").when((p > 0.4) & (p < 0.6), "mid").otherwise("other")


def novelty(identity: Column, hit: Column, near: float = 0.9) -> Column:
    return F.when(~holds(hit), "none").when(identity >= near, "near").otherwise("remote")


def tier_flags(steepness: Column, tm: Column, amplitude: Column, leak: Column, tier: int) -> dict[str, Column]:
    n, low, high, amp, most = TIERS[tier]
    return {"gate_nh": above(steepness, n), "gate_tm": between(tm, low, high), "gate_amp": at_least(F.abs(amplitude), amp), "gate_base": at_most(leak, most)}


def checklist(steepness: Column, tm: Column, amplitude: Column, leak: Column, bottom: Column) -> dict[str, Column]:
    return {
        "snap": above(steepness, 1.5),
        "ramp": at_most(steepness, 1.0),
        "inflection": between(tm, 42.0, 45.0),
        "range": at_least(amplitude, 0.5),
        "repression": at_most(F.coalesce(number(leak), number(bottom)), 0.2),
    }


def fragile(tm_a: Column, tm_b: Column, n_a: Column, n_b: Column) -> Column:
    """Two tools disagree: melting points more than 5 apart, or one sees a switch where the other sees a coil."""
    return holds(F.abs(tm_a - tm_b) > 5) | holds((n_a > 1.5) & (n_b <= 1.0)) | holds((n_b > 1.5) & (n_a <= 1.0))


def lead_score(steepness: Column, amplitude: Column, tm: Column, leak: Column, other_tm: Column) -> Column:
    amp = F.coalesce(F.abs(amplitude), F.lit(0.0))
    return (
        F.least(F.coalesce(steepness, F.lit(0.0)), F.lit(3.0))
        + 2 * amp
        - 0.4 * F.abs(F.coalesce(tm, F.lit(IDEAL_TM)) - IDEAL_TM)
        - 6 * F.coalesce(leak, F.lit(1.0))
        - 0.25 * F.coalesce(F.abs(tm - other_tm), F.lit(0.0))
        - 12 * F.greatest(F.lit(0.0), 0.25 - amp)
    )


def any_like(c: Column, parts: list[str]) -> Column:
    """Any of the parts occurs, whatever the case."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(p.lower())) for p in parts)), F.lit(False))


# What names a heat-sensing family, wherever it stands and whatever the case, and what rules one out.
HEAT_TYPES = ["thermoregulator", "thermometer"]
HEAT_TEXTS = ["thermoregulator", "thermometer", "thermoswitch", "heat shock", "heat-shock"]
HEAT_IDS = [
    "ROSE", "FourU", "ToxT", "AilA", "cIII", "agsA", "groES", "clpB", "shuA", "chuA", "cnfY", "cnf1", "ibpA", "IpbA", "rhlA", "lasI", "lsdI", "katA", "cysK-2", "sodB", "pepN", "trxA",
    "hsp17", "sctS", "sctT", "Cyanobacterial",
]
HEAT_NOT = ["Eukaryota"]


def heat_family(kind: Column, description: Column, name: Column, significant: Column, taxonomy: Column) -> Column:
    """A significant region of a heat-sensing family outside the excluded taxa; a missing taxonomy or significance is no."""
    said = any_like(kind, HEAT_TYPES) | any_like(description, HEAT_TEXTS) | any_like(name, HEAT_IDS)
    return said & F.coalesce(significant == 1, F.lit(False)) & taxonomy.isNotNull() & ~any_like(taxonomy, HEAT_NOT)
