import random
from functools import lru_cache

import numpy as np

from pyspark.sql import functions as F

from tessera.operators import matching


def sequential(edges):
    used_a, used_b, out = set(), set(), []
    for cost, a, b in sorted((c, a, b) for a, b, c in edges):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, cost))
    return sorted(out)


def test_greedy_on_a_long_path(spark):
    n = 100_000
    # edge i joins left i // 2 + i % 2 and right i // 2, at rising cost: each waits for the one before
    path = spark.range(n).selectExpr("(id + 1) div 2 as a", "id div 2 as b", "cast(id as double) as cost")
    got = matching.greedy(path)
    assert got.count() == n // 2 and got.where("cost % 2 <> 0").isEmpty()


def test_greedy_equals_a_sequential_pass(spark):
    rng = random.Random(3)
    for case in range(3):
        edges = [(rng.randrange(12), rng.randrange(12), float(rng.randrange(4))) for _ in range(60)]
        if case:  # chains, forks and a hub
            edges = [((i + 1) // 2, i // 2, float(i)) for i in range(40)] + [(100 + i, 3, 0.5 * i) for i in range(20)] + [(200 + (i + 1) // 2, 200 + i // 2, 90.0 - i) for i in range(30 * case)]
        assert sorted(tuple(r) for r in matching.greedy(spark.createDataFrame(edges, "a long, b long, cost double")).collect()) == sequential(edges)
    assert matching.greedy(spark.createDataFrame([], "a long, b long, cost double")).count() == 0


def test_first_independent_on_a_long_path_and_at_random(spark):
    n = 3000
    nodes, edges = spark.range(n), spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    got = matching.first_independent(nodes, edges, "id")
    assert got.count() == n and got.where("kept <> (id % 2 = 0)").isEmpty()
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(160)} | {(i, i + 1) for i in range(40, 79)})
    kept = []
    for i in range(80):
        kept.append(not any(kept[a] for a, b in pairs if b == i))
    got = matching.first_independent(spark.range(80), spark.createDataFrame(pairs, "a long, b long"), "id").collect()
    assert {r.id: r.kept for r in got} == dict(enumerate(kept))


def cheapest(edges):
    """(matched, cost) of the largest, then cheapest assignment, by trying all."""
    of = {}
    for a, b, c in edges:
        of.setdefault(a, []).append((b, c))
    rows, columns = sorted(of), sorted({b for _, b, _ in edges})

    @lru_cache(None)
    def best(i, used):
        if i == len(rows):
            return (0, 0.0)
        n, c = best(i + 1, used)
        options = [(n, c)]
        for b, cost in of[rows[i]]:
            bit = 1 << columns.index(b)
            if not used & bit:
                n, c = best(i + 1, used | bit)
                options.append((n - 1, c + cost))
        return min(options)

    n, c = best(0, 0)
    return -n, c


def test_assignment_is_nearly_the_cheapest_and_certified(spark):
    rng = random.Random(9)
    crowded = [(a, b, round(rng.random(), 3)) for a in range(9) for b in range(5) if rng.random() < 0.7]  # more rows than columns
    roomy = [(100 + a, 100 + b, round(rng.random() * 9, 3)) for a in range(6) for b in range(9) if rng.random() < 0.6]
    war = [(200 + a, 200 + b, 1.0) for a in range(4) for b in range(3)] + [(300, 300, 5.0), (300, 301, 1.0), (301, 301, 1.0)]
    edges = crowded + roomy + war
    df = spark.createDataFrame(edges, "a long, b long, cost double")
    got = matching.auction(df, 0.05)
    rows = [tuple(r)[:3] for r in got.collect()]
    assert set(rows) <= set(edges) and len({r[0] for r in rows}) == len(rows) == len({r[1] for r in rows})
    want = [cheapest(e) for e in (crowded, roomy, war)]
    n = len({a for a, _, _ in edges})
    assert len(rows) == sum(w[0] for w in want) and sum(r[2] for r in rows) <= sum(w[1] for w in want) + n * 0.05
    gap = matching.assignment_gap(df, got).first()
    assert gap["rows"] == n and gap["bound"] <= gap["cost"] + 1e-9 and gap["cost"] - gap["bound"] <= n * 0.05 + 1e-9
    assert matching.auction(df.limit(0), 0.05).count() == 0


def test_assignment_settles_within_parts(spark, monkeypatch):
    rounds, two_best = [], matching._two_best
    monkeypatch.setattr(matching, "_two_best", lambda *a: rounds.append(1) or two_best(*a))
    rng = random.Random(3)
    edges = [(a, b, round(rng.random(), 3)) for a in range(60) for b in range(a // 2, a // 2 + 4)]  # more rows than columns
    df = spark.createDataFrame(edges, "a long, b long, cost double")
    gap = matching.assignment_gap(df, matching.staged(matching.auction(df.withColumn("near", F.col("a")), 0.05, place="near"), "assigned")).first()
    assert gap["cost"] - gap["bound"] <= 60 * 0.05 + 1e-9 and len(rounds) <= 16  # two a phase; rounds of single bids before
    monkeypatch.setattr(matching, "PART", 120)
    got = matching.staged(matching.auction(df.withColumn("near", F.col("a")), 0.05, place="near"), "assigned")
    parts = matching.assignment_gap(df, got).first()
    assert abs(parts["cost"] - gap["cost"]) <= 60 * 0.05 and parts["cost"] - parts["bound"] <= 60 * 0.05 + 1e-9
    assert got.count() == 33 == got.select("a").distinct().count() == got.select("b").distinct().count()


def test_nearest_by_levels_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "_CELL", 3)
    rng = np.random.default_rng(7)

    def made(n, first):
        x = np.concatenate([rng.normal(50, 2, (n, 1)) for _ in range(1)] + [rng.normal(0.5, 0.1, (n, 1))], axis=1)
        x[: n // 3] = [50.0, 0.5]  # a third at one point
        x[n // 3 : n // 2, 0] = rng.uniform(0, 400, n // 2 - n // 3)  # and some far apart
        return [(first + i, float(round(a)), float(b)) for i, (a, b) in enumerate(x)]

    left, right = made(90, 0), made(240, 1000)
    for line in (True, False):
        z = (lambda a, b: (a / 30, b * 4)) if line else (lambda a, b: (np.sin(a), b * b))
        dfs = [spark.createDataFrame([(i, a, b, *map(float, z(a, b))) for i, a, b in side], "k long, len double, gc double, zl double, zg double") for side in (left, right)]
        got = matching.candidates(*dfs, "k", {"len": 40.0, "gc": 0.2}, {"len": "zl", "gc": "zg"}, 4).collect()
        want = []
        for i, a, b in left:
            near = sorted((float(np.hypot(*(np.array(z(a, b)) - np.array(z(c, d))))), j) for j, c, d in right if abs(a - c) <= 40 and abs(b - d) <= 0.2)
            want += [(i, j) for _, j in near[:4]]
        costs = {(r.a, r.b): r.cost for r in got}
        assert len(got) == len(costs) == len(want)
        assert sorted(costs) == sorted(want)
