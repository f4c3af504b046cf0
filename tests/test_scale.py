"""Operators whose plans bear long lines, many copies and large batches, against plain versions."""

import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import models, nearest, relations


def test_gaps_on_one_contig_in_many_ranges(spark):
    rng = random.Random(6)
    rows = [("one", a, a + rng.randrange(60), rng.choice("+-")) for a in (rng.randrange(5000) for _ in range(700))] + [(f"c{i}", 10 * i, 10 * i + 5, "+-"[i % 2]) for i in range(9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the contig lies in several ranges
    try:
        got = sorted(tuple(r) for r in relations.upstream_gaps(spark.createDataFrame(rows, "seqid string, start long, stop long, strand string")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for s, a, b, strand in rows:
        if strand == "+":
            want.append((s, a, b, strand, max((y for t, _, y, _ in rows if t == s and y < a), default=0) + 1, a - 1))
        else:
            high = min((x for t, x, _, _ in rows if t == s and x > b), default=None)
            want.append((s, a, b, strand, b + 1, None if high is None else high - 1))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3]))


def test_shuffles_keep_pairs_ends_and_seeds():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, 4, n) for n in (0, 1, 2, 3, 5, 40, 400, 5000)] + [np.zeros(9, int), np.array([0, 1] * 20), np.array([2, 2, 2, 0, 1, 3, 3])]
    seeds = np.arange(len(codes))
    made, kept = models.shuffled(codes, seeds)
    for c, m, k in zip(codes, made, kept, strict=True):
        assert Counter(c.tolist()) == Counter(m.tolist()) and k == (len(c) >= 2)
        if k:
            assert Counter(zip(c, c[1:], strict=False)) == Counter(zip(m, m[1:], strict=False)) and (c[0], c[-1]) == (m[0], m[-1])
    alone, _ = models.shuffled(codes[6:7], seeds[6:7])
    assert (alone[0] == made[6]).all() and (made[6] != codes[6]).any()
    made, kept = models.shuffled(codes, seeds, tries=0)
    assert not kept.any() and all(Counter(c.tolist()) == Counter(m.tolist()) for c, m in zip(codes, made, strict=True))


def test_shuffles_are_uniform():
    s = np.array([0, 1, 0, 2, 0, 1, 1, 0])
    made, _ = models.shuffled([s] * 6000, np.arange(6000))
    n = Counter(tuple(m.tolist()) for m in made)
    assert len(n) > 5 and max(n.values()) < 1.25 * min(n.values())


def test_shuffles_keep_pairs_where_random_orders_hardly_ever_fit():
    """Only one of 5000 exits leads to the last letter; after 64 orders such a sequence lost its pairs."""
    c = np.array([0, 1] * 5000 + [2])
    made, kept = models.shuffled([c] * 4, np.arange(4))
    pairs = lambda x: np.bincount(x[:-1] * 3 + x[1:], minlength=9).tolist()
    assert kept.all() and all(pairs(m) == pairs(c) and (m[0], m[-1]) == (0, 2) for m in made)
    alone, _ = models.shuffled([c], np.array([2]))
    assert (alone[0] == made[2]).all()
    drawn = Counter(tuple(models._last_exits({0: [1, 2, 1, 2], 1: [0, 1, 0], 2: [0, 1]}, 1, i).items()) for i in range(6000))
    # trees into 1: a letter's exit to 1, or to the other letter if that has one to 1; each place alike
    assert {frozenset(t) for t in drawn} == {frozenset({(0, a), (2, b)}) for a in range(4) for b in range(2) if not (a in (1, 3) and b == 0)}
    n = Counter()
    for t, k in drawn.items():
        n[frozenset(t)] += k
    assert max(n.values()) < 1.25 * min(n.values())


def test_one_long_sequence_does_not_hold_up_a_shuffle():
    """A walk costs a sequence's own letters: steps shared by all took seconds for one sequence of many letters."""
    rng = np.random.default_rng(3)
    codes, began = [rng.integers(0, 4, n) for n in (1_000_000, 10)], time.process_time()
    made, kept = models.shuffled(codes, np.arange(2))
    assert time.process_time() - began < 4 and kept.all()
    pairs = lambda c: np.bincount(c[:-1] * 4 + c[1:], minlength=16).tolist()
    assert all(pairs(c) == pairs(m) and c[0] == m[0] and c[-1] == m[-1] for c, m in zip(codes, made, strict=True))


def test_null_model_is_the_same_however_it_is_cut(spark):
    df = spark.createDataFrame([(i, "AUGCC" * (i % 9) + "AAUGCA" * (i % 4)) for i in range(60)] + [(99, None)], "id long, seq string")
    a = {(r.key, r.shuffle): (r.sequence, r["mode"]) for r in models.null_model(df.repartition(7), "id", "seq", 3).collect()}
    b = {(r.key, r.shuffle): (r.sequence, r["mode"]) for r in models.null_model(df.coalesce(1), "id", "seq", 3).collect()}
    assert a == b and len(a) == 183 and a["99", 0] == ("", "mono") and a["17", 0] != a["17", 1]


def test_block_importance_finds_the_block_that_matters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(x > 0.5), float(x), float(rng.uniform()), float(x * 0 + rng.uniform())) for i, x in enumerate(rng.uniform(size=300))]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double")
    model = models.forest(["a", "b", "c"], "label", trees=10, depth=4).fit(df)
    got = models.block_importance(model, df, {"first": ["a"], "rest": ["b", "c"]}, "label", "id", repeats=3)
    drops = {(r.block, r.repeat): r["drop"] for r in got.collect()}
    assert len(drops) == 6 and all(drops["first", r] > 0.3 and abs(drops["rest", r]) < 0.1 for r in range(3)) and len({drops["first", r] for r in range(3)}) == 3
    shares = {r.block: r.repeats for r in models.importance_summary(got).collect()}
    assert shares == {"first": 3, "rest": 3}


def test_forest_is_grown_in_groups_whose_rows_times_trees_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(models, "GROWN", 900)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, int(x > 0.5), float(x), float(rng.uniform())) for i, x in enumerate(rng.uniform(size=300))], "id long, label int, a double, b double")
    sizes = []

    def noted():
        for n, model in models.forests(df, ["a", "b"], "label", trees=7, depth=4):
            sizes.append((n, model.stages[-1].getNumTrees))
            yield n, model

    got = models.block_importance(noted(), df, {"first": ["a"], "rest": ["b"]}, "label", "id", repeats=2).collect()
    assert sizes == [(3, 3), (3, 3), (1, 1)]
    drops = {(r.block, r.repeat): r["drop"] for r in got}
    assert len(drops) == 4 and all(drops["first", r] > 0.3 and abs(drops["rest", r]) < 0.1 for r in range(2))


def test_catalogue_reads_in_parts_and_pushes_filters(spark):
    from tessera.sources.readers import catalogue

    url = "jdbc:derby:memory:catalogue;create=true"
    regions = spark.range(1000).select(F.col("id").alias("region"), (F.col("id") % 7).alias("family"), (F.col("id") % 3 == 0).cast("int").alias("significant"))
    families = spark.createDataFrame([(i, f"name{i}") for i in range(7)], "family long, name string")
    for df, name in ((regions, "REGIONS"), (families, "FAMILIES"), (regions.limit(0), "NOTHING")):
        df.write.format("jdbc").option("url", url).option("dbtable", name).option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    got = catalogue(spark, url, {"REGIONS": '"region"', "FAMILIES": None, "NOTHING": '"region"'}, parts=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got["REGIONS"].rdd.getNumPartitions() == 4 and got["REGIONS"].count() == 1000 and got["NOTHING"].count() == 0
    some = got["REGIONS"].where("significant = 1 and region < 100").join(got["FAMILIES"], "family").groupBy("name").count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(region,100)" in plan and "EqualTo(significant,1)" in plan
    want = Counter(f"name{i % 7}" for i in range(0, 100, 3))
    assert {r["name"]: r["count"] for r in some.collect()} == want


def test_pivots_prune_packs_of_equal_length(spark, monkeypatch):
    from tessera.operators import nearest

    monkeypatch.setattr(nearest, "ROWS", 8)
    rng = random.Random(3)
    centres = ["".join(rng.choice(w) for _ in range(120)) for w in ("AAAU", "GGGC", "AUAU", "GCAA", "CCCU", "UUUG")]
    seqs = []
    for i in range(300):
        s = list(centres[i % 6])
        for _ in range(rng.randrange(6)):
            s[rng.randrange(120)] = rng.choice("AUGC")
        seqs.append((i, "".join(s), i % 2))
    df = spark.createDataFrame(seqs, "id long, seq string, label int")
    got = {r.key: [(x.d2, x.key) for x in r.near] for r in nearest.nearest_by_kmers(df, "id", "seq", "label", (2, 3), 3).collect()}
    v = np.stack([nearest.counted(s, (2, 3)) for _, s, _ in seqs]).astype(float)
    d = nearest._squares(v, v)
    for i in range(300):
        assert got[i] == [(d[i, j], j) for j in sorted((j for j in range(300) if j != i), key=lambda j: (d[i, j], j))[:3]]
    seen = {}
    monkeypatch.setattr(nearest, "_pairs", lambda packs, f=nearest._pairs: seen.setdefault("pairs", f(packs)) if seen.setdefault("packs", packs) is not None else None)
    nearest.nearest_by_kmers(df, "id", "seq", "label", (2, 3), 3)
    packs = seen["packs"].count()
    assert packs >= 25 and seen["pairs"].count() < packs**2 / 2


def test_packs_travel_in_bounded_batches(spark):
    """By default a worker would get 10000 packs at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        df = spark.createDataFrame([(i, "AUGC" * (i + 2), i % 2) for i in range(6)], "id long, s string, label int")
        assert nearest.nearest_by_kmers(df, "id", "s", "label", (2,), 1).count() == 6 and spark.conf.get(name) == str(nearest.BATCH_BYTES)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_a_forest_is_grown_and_scored_where_its_rows_are(spark, monkeypatch):
    """The drops are those of Spark's forest, whose nodes were collected; a task holds all rows as bytes and hands on sums alone."""
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(2000, 3))
    said = (x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.uniform(size=2000) > 0.75).astype(int)
    df = spark.createDataFrame([(i, int(y), *map(float, r)) for i, (y, r) in enumerate(zip(said, x, strict=True))], "id long, label int, a double, b double, c double")
    blocks = {"first": ["a"], "second": ["b"], "nothing": ["c"]}
    monkeypatch.setattr(models, "PIECE", 300)
    got = models.forest_importance(df, ["a", "b", "c"], blocks, "label", "id", repeats=2, trees=12).collect()
    again = models.forest_importance(df.repartition(5), ["a", "b", "c"], blocks, "label", "id", repeats=2, trees=12).collect()
    drops = lambda rows: {(r.block, r.repeat): r["drop"] for r in rows}
    assert drops(got) == drops(again) and len(drops(got)) == 6
    monkeypatch.setattr(models, "BINNED", 1)
    spark_own = drops(models.forest_importance(df, ["a", "b", "c"], blocks, "label", "id", repeats=2, trees=12).collect())
    assert all(abs(v - spark_own[k]) < 0.05 for k, v in drops(got).items()) and drops(got)["first", 0] > 0.3 and drops(got)["second", 1] > 0.05


def test_trees_split_as_all_cuts_tried_one_by_one_would():
    rng = np.random.default_rng(6)
    bins, weight = rng.integers(0, 9, (60, 2)).astype(np.uint8), rng.integers(0, 3, 60)
    y = ((bins[:, 0] > 4) ^ (bins[:, 1] > 6)).astype(np.uint8)
    feature, cut, left, share = models.grown(bins, y, weight, 2, 30, np.random.default_rng(1))

    def gini(of):
        n, k = weight[of].sum(), weight[of & (y == 1)].sum()
        return (k * k + (n - k) ** 2) / n if n else 0.0

    def check(node, own):
        n, k = weight[own].sum(), weight[own & (y == 1)].sum()
        assert abs(share[node] - k / n) < 1e-12
        tried = {(f, c): gini(own & (bins[:, f] <= c)) + gini(own & (bins[:, f] > c)) for f in (0, 1) for c in range(8)}
        if feature[node] < 0:
            assert k in (0, n) or max(tried.values()) <= gini(own) + 1e-9 * n
            return 1
        assert abs(tried[feature[node], cut[node]] - max(tried.values())) < 1e-9
        goes = bins[:, feature[node]] <= cut[node]
        return 1 + check(left[node], own & goes) + check(left[node] + 1, own & ~goes)

    assert check(0, weight > 0) == len(feature)
    assert (models.shares((feature, cut, left, share), bins)[weight > 0] == y[weight > 0].astype(int) * models.SHARE).all()


def test_what_was_shuffled_for_a_staged_table_is_deleted_at_once(spark):
    from tessera.staging import staged

    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    df = staged(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    until = time.monotonic() + 5
    while files() - before and time.monotonic() < until:  # executors are told, not waited for
        time.sleep(0.1)
    assert files() <= before and df.count() == 10


def test_nearest_in_groups_of_packs_equals_all_pairs(spark, monkeypatch):
    """Packs that ask are held in groups, so one that is asked travels once a group, not once for each pack that asks."""
    monkeypatch.setattr(nearest, "ROWS", 8)
    rng = np.random.default_rng(8)
    seqs = [(i, "".join(rng.choice(list("AUGC"), rng.integers(3, 60))), int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(seqs, "id long, seq string, label int")
    v = np.stack([nearest.counted(s, (2, 3)) for _, s, _ in seqs]).astype(float)
    d = nearest._squares(v, v)
    for groups, together in ((1, 3), (2, 64), (50, 64)):
        monkeypatch.setattr(nearest, "GROUPS", groups)
        monkeypatch.setattr(nearest, "TOGETHER", together)
        got = {r.key: [(x.d2, x.key) for x in r.near] for r in nearest.nearest_by_kmers(df, "id", "seq", "label", (2, 3), 3).collect()}
        for i in range(200):
            assert got[i] == [(d[i, j], j) for j in sorted((j for j in range(200) if j != i), key=lambda j: (d[i, j], j))[:3]]
