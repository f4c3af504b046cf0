import numpy as np
import pytest

from tessera.llm import neighbours


def brute(rows, k, every):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and len(x) and all(y is not None and np.isfinite(y) for y in x) and any(x):
            v[i] = min(v[i], tuple(x)) if i in v else tuple(x)

    def dot(a, b):
        s = 0.0
        for p, q in zip(a, b, strict=True):
            s += p * q
        return s

    out = []
    for q in v:
        if q % every == 0:
            near = sorted((-dot(v[q], v[i]), i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, and merging over several levels
        monkeypatch.setattr(neighbours, "BLOCK_BYTES", 160)
        monkeypatch.setattr(neighbours, "QUERY_BYTES", 200)
        monkeypatch.setattr(neighbours, "FAN", 3)
        monkeypatch.setattr(neighbours, "ROW_BYTES", 130)
        monkeypatch.setattr(neighbours, "ASKED", 2)
        monkeypatch.setattr(neighbours, "MET", 7)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [1e300] * 8), (380, [1.0, None] * 4)]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0]), (500, []), (0, rows[7][1]), (5, rows[5][1]), (None, rows[0][1]), (-20, rows[9][1]), (600, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<double>, dim string, block int")
    got = sorted(tuple(r) for r in neighbours.nearest(df, k=5, every=10).collect())
    want = brute(rows, 5, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df).count() == 0 and neighbours.nearest(df.limit(0)).count() == 0


def test_wide_vectors():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-127, 128, (3, 3000)).astype(np.int8) for _ in range(2))
    assert (neighbours.int8_product(a, b) == a.astype(int) @ b.astype(int).T).all()


def test_copies_that_no_query_needs():
    ids, v = np.array([1, 2, 3, 5, 8, 9]), np.array([[1.0, 2], [3, 4], [1, 2], [1, 2], [3, 4], [1, 2]])
    assert neighbours.needed(ids, v, 1).tolist() == [0, 1, 2, 4]


def test_queries_are_replicated_not_candidates(spark):
    """Blocks of candidates go to one task each; what grows with their number is the queries' share."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
