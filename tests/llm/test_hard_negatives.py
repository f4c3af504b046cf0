import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives


def brute(rows, every, positives, negatives, percent):
    v = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(y is not None and math.isfinite(y) for y in x):
            w = [math.floor(256 * y) for y in x]
            key = (label, len(x), any(abs(c) >= 1 << 15 for c in w), w)
            v[i] = min(v[i], key) if i in v else key
    out = []
    for a, (la, _, _, xa) in v.items():
        if a % every:
            continue
        s = sorted((-sum(p * q for p, q in zip(xa, x, strict=True)), i, label == la) for i, (label, n, _, x) in v.items() if i != a and n == len(xa))
        for ps, p, _ in [r for r in s if r[2]][:positives]:
            hard = [(n, ns) for ns, n, same in s if not same and percent * -ps <= 100 * -ns <= 100 * -ps]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (n, ns) in enumerate(hard[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, tiles and rounds
        monkeypatch.setattr(hard_negatives, "LEAST_BYTES", 150)
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 300)
        monkeypatch.setattr(hard_negatives, "ASKED", 3)
        monkeypatch.setattr(hard_negatives, "MET", 5)
        monkeypatch.setattr(hard_negatives, "FIRST", 3)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 6)) / 3
    rows = [(i, int(rng.integers(0, 3)), (base[i % 4] + rng.normal(size=6) / 9).tolist()) for i in range(160)]
    rows += [(200 + i, i % 2, rows[3][2]) for i in range(40)]  # ties
    rows += [(300, 1, None), (310, None, [1.0] * 6), (320, 1, [0.0] * 6), (330, 1, [float("nan")] * 6), (340, 2, [1.0, None] * 3), (350, 1, [float("inf")] * 6)]
    rows += [(400, 1, [1.0, 2.0]), (401, 1, [1.0, 1.5]), (402, 2, [1.0, 1.4]), (410, 1, []), (411, 1, []), (412, 2, []), (0, 2, rows[5][2]), (7, 0, rows[7][2]), (None, 1, rows[7][2]), (-20, 0, rows[9][2])]
    rows += [(500, 5, [1e4, -3.5, 1e5]), (501, 5, [2e3, 1.0, 1e5]), (502, 6, [1e3, 1.0, 1e5])]
    df = spark.createDataFrame([(i, x, y, 1, "a") for i, x, y in rows], "vec_id long, label int, embedding array<double>, block int, data string")
    got = sorted(tuple(r) for r in hard_negatives.mined(df, every=10, positives=4, negatives=3, percent=70).collect())
    assert got == brute(rows, 10, 4, 3, 70) and len(got) > 50


def test_query_labels_equal_sql(spark):
    import duckdb

    rows = [(i, i % 10, np.random.default_rng(i).normal(size=5).astype("f4").tolist()) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    embeddings = df.toPandas()  # noqa: F841
    got = sorted(tuple(r) for r in hard_negatives.mined(df, label=hard_negatives.shifted_label()).collect())
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    assert got == sorted(con.sql(hard_negatives.SQL).fetchall()) and got


def test_empty_tables_and_wide_numbers(spark):
    df = spark.createDataFrame([(0, 1, [1e300, 1.0]), (1, 1, [1e300, 2.0]), (2, 2, [1e300, 0.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mined(df.limit(0)).count() == 0
    assert [tuple(r) for r in hard_negatives.mined(df).collect()] == [(0, 1, 1, 2, (1 << 63) - 1, (1 << 63) - 1)]
    assert hard_negatives.mined(df.where("vec_id = 0")).count() == 0
    assert hard_negatives.mined(df.withColumn("label", F.col("vec_id"))).count() == 0
