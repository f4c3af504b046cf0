import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import gates
from tessera.operators import reports

PANEL = "k long, len long, gc double"


def test_match_report(spark):
    left = spark.createDataFrame([(1, 100, 0.5), (2, 200, 0.4), (3, 900, 0.6)], PANEL)
    right = spark.createDataFrame([(10, 90, 0.4), (11, 220, 0.4)], PANEL)
    m = spark.createDataFrame([(1, 10, 0.2), (2, 11, 0.4)], "a long, b long, cost double")
    r = reports.match_report(left, right, m, "k", "len", "gc").first()
    assert (r.n, r.n_matched, r.n_left, r.delta_length, r.left_q50, r.truncation_risk) == (3, 2, 1, -5.0, 900.0, True)
    assert r.delta_gc == pytest.approx(0.05) and r.mean_cost == pytest.approx(0.3) and r.delta_deviation == pytest.approx(math.sqrt(5000) - math.sqrt(8450))
    none = reports.match_report(left, right, m.limit(0), "k", "len", "gc").first()
    assert (none.n_matched, none.delta_length, none.mean_cost, none.left_share) == (0, None, None, 1.0)


def test_null_z(spark):
    values = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", None), ("d", 2.0)], "k string, x double")
    nulls = spark.createDataFrame([("a", 1.0, "mono"), ("a", 3.0, "dinuc"), ("a", 5.0, "dinuc"), ("b", 2.0, "mono"), ("b", 2.0, "dinuc"), ("c", 1.0, "mono"), ("a", None, "mono")], "k string, x double, mode string")
    got = {r.k: r for r in reports.null_z(values, nulls, "k", "x", "mode").collect()}
    assert got["a"].z == pytest.approx(2 / math.sqrt(8 / 3)) and (got["a"].n, got["a"]["mode"]) == (3, "dinuc")
    assert got["b"].z == pytest.approx(-1e6) and got["b"]["mode"] == "dinuc" and got["c"].z is None and (got["d"].z, got["d"].n, got["d"]["mode"]) == (None, 0, None)


def test_positional_entropy(spark):
    pairs = spark.createDataFrame([("a", 1, 4, 0.5), ("a", 2, 4, 0.25), ("a", 3, 5, 0.0)], "k string, i int, j int, p double")
    lengths = spark.createDataFrame([("a", 5), ("b", 3), ("c", 0)], "k string, n int")
    h = lambda *ps: sum(-p * math.log2(p) for p in ps if p > 0)
    got = {r.k: r.entropy for r in reports.positional_entropy(pairs, lengths, "k", "i", "j", "p", "n").collect()}
    assert got == {"a": pytest.approx((h(0.5, 0.5) + h(0.25, 0.75) + h(0.5, 0.25, 0.25)) / 5), "b": 0.0, "c": 0.0}


def test_novelty_fills_absent_buckets(spark):
    df = spark.createDataFrame([("no_hit", False), ("no_hit", True)], "b string, a boolean")
    got = {r.bucket: (r.n, r.share, r.n_a) for r in reports.novelty(df, F.col("b"), {"a": F.col("a")}).collect()}
    assert got == {"identical_near": (0, 0.0, 0), "remote_homolog": (0, 0.0, 0), "no_hit": (2, 1.0, 1)}
    assert {r.share for r in reports.novelty(df.limit(0), F.col("b"), {}).collect()} == {0.0}


def test_intensive_and_families(spark):
    df = spark.createDataFrame([(10, 5.0), (0, 5.0), (None, 5.0), (10, None)], "n int, x double")
    assert [r.y for r in reports.intensive(df, "n", {"y": "x", "z": "gone"}).collect()] == [0.5, None, None, None]
    with pytest.raises(ValueError, match="n is required"):
        reports.intensive(df.drop("n"), "n", {"y": "x"})
    rows = [("Cis-reg; THERMOREGULATOR", None, "x", 1, "Bacteria"), (None, "a Heat Shock element", "x", 1, "Bacteria"), (None, None, "xfouru1", 1, "Bacteria"), (None, None, "ROSE", 0, "Bacteria"), (None, None, "ROSE", 1, "eukaryota; x"), (None, None, "ROSE", 1, None), (None, "leader", "y", 1, "Bacteria")]
    f = spark.createDataFrame(rows, "t string, d string, i string, s int, x string")
    assert [r[0] for r in f.select(gates.heat_family(*map(F.col, "tdisx"))).collect()] == [True, True, True, False, False, False, False]
