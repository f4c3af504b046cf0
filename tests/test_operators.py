import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import features, gates, rna
from tessera.operators import curves, matching, models, nearest, relations, sequences, statistics


def test_vectors(spark):
    df = spark.createDataFrame([("k", "AUGCAUGC"), ("m", "AGGAGGAAAAAAAUGCCCC"), ("s", "GGGGCCCCGGGGCCCC"), ("e", "")], "id string, seq string")
    wide = {r.id: r for r in sequences.kmer_vector(df, "id", "seq", 2, "d_").collect()}
    assert abs(wide["k"].d_AU - 2 / 7) < 1e-12 and abs(sum(wide["k"][1:]) - 1) < 1e-12 and sum(wide["e"][1:]) == 0
    got = {r.id: r.x for r in df.select("id", rna.spacing(F.col("seq")).alias("x")).collect()}
    assert got == {"k": -1, "m": 6, "s": -1, "e": -1}


def test_quality_rules(spark):
    rng = random.Random(1)
    good = "".join(rng.choice("AUGC") for _ in range(120))
    rows = [good, "AUA" * 40, "A" * 100, "AUGC", "AUGCNNN" * 10, "", None]
    got = [r.x for r in spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string").orderBy("i").select(rna.first_failure(F.col("s")).alias("x")).collect()]
    assert got == [None, "unique", "mono", "length", "alphabet", "empty", "empty"]


def test_gate_edges(spark):
    row = spark.createDataFrame([(0.0, 1.0, 41.0, -2.0, float("nan"), "x")], "dp double, nh double, tm double, z double, miss double, text string").select(
        gates.above(F.col("dp"), 0), gates.above(F.col("nh"), 1), gates.between(F.col("tm"), 42, 45), gates.at_most(F.col("z"), -2), gates.above(F.col("miss"), 0), gates.at_most(F.col("text"), 0), gates.tightest(F.col("text"), F.col("miss"))
    ).first()
    assert tuple(row) == (False, False, False, True, False, False, float("inf"))


def test_base_pairs_ignore_unmatched(spark):
    df = spark.createDataFrame([(1, "))((.))(()")], "id int, b string")
    assert sorted((r.i, r.j) for r in sequences.base_pairs(df, "id", "b").collect()) == [(2, 6), (3, 5), (8, 9)]


def test_near_identical(spark):
    rng = random.Random(2)
    rows = []
    for i in range(12):
        s = [rng.choice("AUGC") for _ in range(rng.randint(60, 400))]
        for _ in range(4):
            t = list(s)
            for _ in range(rng.randint(0, len(s) // 40)):
                t[rng.randrange(len(t))] = rng.choice("AUGC")
            rows.append((len(rows), "".join(t + [rng.choice("AUGC")] * rng.randint(0, 2))))
    got = {(r.a, r.b) for r in sequences.near_identical(spark.createDataFrame(rows, "id long, s string"), "id", "s", 0.98).collect()}
    first = {}
    for i, s in rows:
        first.setdefault(s, i)
    want = {(a, b) for (s, a), (t, b) in itertools.combinations(first.items(), 2) if sum(x == y for x, y in zip(s, t)) >= 0.98 * max(len(s), len(t))}
    assert got == {(min(p), max(p)) for p in want} and want


def test_upstream_and_checks(spark):
    df = spark.createDataFrame([("c", 10, 20, "+"), ("c", 18, 30, "-"), ("c", 40, 50, "+"), ("c", 60, 70, "-")], "seqid string, start long, stop long, strand string")
    got = {r.start: (r.gap_start, r.gap_stop) for r in relations.upstream_gaps(df).collect()}
    assert got == {10: (1, 9), 18: (31, 39), 40: (31, 39), 60: (71, None)}
    left = spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(Exception, match="no partner"):
        relations.strict_join(left, left.where("k = 1").withColumn("x", F.lit(1)), ["k"]).collect()


def test_matching_properties(spark):
    rng = random.Random(3)
    edges = [(a, b, round(rng.random(), 3)) for a in range(7) for b in range(7) if rng.random() < 0.8]
    df = spark.createDataFrame(edges, "a long, b long, cost double")
    used, want = set(), []
    for c, a, b in sorted((c, a, b) for a, b, c in edges):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            want.append((a, b, c))
    assert sorted(tuple(r) for r in matching.greedy(df).collect()) == sorted(want)
    got = matching.auction(df, 0.01).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    cost = {(a, b): c for a, b, c in edges}
    best = min((-sum((a, b) in cost for a, b in enumerate(p)), sum(cost.get((a, b), 0) for a, b in enumerate(p))) for p in itertools.permutations(range(7)))
    assert len(got) == -best[0] and sum(r.cost for r in got) <= best[1] + 7 * 0.01 + 1e-9


def test_first_independent(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4)], "a long, b long")
    assert sorted(r.id for r in matching.first_independent(nodes, edges, "id").where("kept").collect()) == [0, 2, 5]


def test_statistics(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 80), rng.integers(5, 40, 60)
    df = spark.createDataFrame([(int(x), 1) for x in a] + [(int(x), 0) for x in b], "x int, side int")
    r = statistics.with_p_values(statistics.two_sample(df, [], "x", F.col("side") == 1)).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    at = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(s), at, "right") / len(s) for s in (a, b))
    assert r.u == u and abs(r.ks - np.abs(fa - fb).max()) < 1e-12 and abs(r.w1 - (np.abs(fa - fb)[:-1] * np.diff(at)).sum()) < 1e-9 and 0 <= r.p_u < 0.05
    q = statistics.benjamini_hochberg(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")).orderBy("p").collect()
    assert [round(x.q, 6) for x in q] == [0.04, 0.053333, 0.053333, 0.5]


def test_hill_fit_recovers(spark):
    rows = [(1, float(t), 0.1 + 0.7 / (1 + (43.5 / t) ** 12)) for t in range(10, 80, 2)] + [(2, float(t), 0.3) for t in range(10, 80, 2)]
    got = {r.id: r for r in curves.hill_fit(spark.createDataFrame(rows, "id int, t double, v double"), "id", "t", "v", [40.0, 43.5, 47.0], [4.0, 12.0]).collect()}
    assert (got[1].tm, got[1].n, got[1].status) == (43.5, 12.0, "ok") and abs(got[1].bottom - 0.1) < 1e-6 and got[2].status == "flat" and got[2].tm is None



def test_folds(spark):
    df = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, f"g{i % 11}") for i in range(200)], "id long, label int, grp string")
    n = models.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    by = {}
    for r in n:
        by.setdefault(r.label, []).append(r["count"])
    assert all(len(x) == 5 and max(x) - min(x) <= 1 for x in by.values())
    assert models.group_folds(df, "grp", "label", 4).groupBy("grp").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    assert models.undersampled(df, F.col("label") == 1, "id", ratio=1).groupBy("label").count().select("count").distinct().count() == 1



def test_representatives(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(8):
        s = [rng.choice("AUGC") for _ in range(rng.randint(50, 300))]
        for _ in range(4):
            if rng.random() < 0.8:
                s[rng.randrange(len(s))] = rng.choice("AUGC")
            rows.append((len(rows), "".join(s[: len(s) - rng.randint(0, 3)])))
    df = spark.createDataFrame(rows, "id long, s string")
    mers = lambda s: {s[i : i + 9] for i in range(len(s) - 8)}
    like = lambda a, b: len(mers(a) & mers(b)) >= 0.8 * len(mers(a) | mers(b))
    first = {}
    for i, s in rows:
        first.setdefault(s, i)
    order = sorted((-len(s), i, s) for s, i in first.items())
    assert {(r.a, r.b) for r in sequences.similar(df, "id", "s").collect()} == {(x[1], y[1]) for x, y in itertools.combinations(order, 2) if like(x[2], y[2])}
    kept = []
    for _, i, s in order:
        if not any(like(s, t) for _, t in kept):
            kept.append((i, s))
    nodes = df.groupBy("s").agg(F.min("id").alias("id"))
    got = matching.first_independent(nodes, sequences.similar(df, "id", "s"), "id").where("kept").collect()
    assert sorted(r.id for r in got) == sorted(i for i, _ in kept)


def test_marks_in_common_are_counted_for_some_sets_at_a_time(monkeypatch):
    monkeypatch.setattr(sequences, "MET", 50)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 25))).astype(np.uint32) for _ in range(40)]
    want = {(i, j): n for i, j in itertools.combinations(range(40), 2) if (n := len(np.intersect1d(sets[i], sets[j]))) >= 4}
    got = [x for a, b, n in sequences._alike_marks([s.tobytes() for s in sets], 4) for x in zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)]
    assert dict(got) == want and len(got) == len(want) > 50


def test_pairs_that_meet_by_chance_stay_in_their_task(spark, monkeypatch):
    """Each pair with a signature in common was shuffled; now those that may have enough of them are, whatever the number of buckets."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("AUGC", weights=(6, 3, 1, 1), k=1200)) for _ in range(30)]
    texts += [t[:500] + "GC" + t[502:1190] for t in texts[:6]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, s string")
    want = {(str(i), str(30 + i)) for i in range(6)}
    assert {(r.a, r.b) for r in sequences.similar(df, "id", "s").collect()} == want
    one, told = [], sequences._signed
    monkeypatch.setattr(sequences, "_signed", lambda *a: one.append(a[-1]) or told(*a))
    monkeypatch.setattr(sequences, "HELD", 300)
    assert {(r.a, r.b) for r in sequences.similar(df, "id", "s").collect()} == want and one[0] > 2
    rows = pa.RecordBatch.from_pydict({"k": [str(i) for i in range(36)], "s": texts})
    signed = list(told(9, 0.8, np.empty(0, np.uint64), np.empty(0, np.int64), 1)(iter([rows])))
    table = pa.Table.from_batches(signed).sort_by("part").combine_chunks().to_batches()
    met = pa.Table.from_batches(list(sequences._met(0.8)(iter(table)))).to_pylist()
    held = {}
    for r in pa.Table.from_batches(signed).to_pylist():
        held.setdefault(r["k"], set()).update((r["part"], m) for m in np.frombuffer(r["marks"], np.uint32).tolist())
    by_chance = sum(1 for a, b in itertools.combinations(held, 2) if held[a] & held[b])
    assert want <= {(min(r["a"], r["b"], key=int), max(r["a"], r["b"], key=int)) for r in met} and len({(r["a"], r["b"]) for r in met}) < by_chance / 2


def test_signatures_meet_rarely():
    """Sequences of four letters share single k-mers with most others; on signatures only similar ones meet often enough."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("AUGC", weights=(5, 3, 1, 1), k=3000)) for _ in range(40)]
    texts += [t[:1400] + "G" + t[1401:2900] for t in texts[:10]]
    sets = [sequences.kmer_set(t, 9) for t in texts]
    told = [{int(t) for got in sequences.signatures(s, 0.8, np.empty(0, np.uint64), np.empty(0, np.int64)) for t in got} for s in sets]
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        common = told[i] & told[j]
        enough = any(sum(t % 32 == level for t in common) >= sequences.needed(level, 0.8) for level in {t % 32 for t in common})
        assert enough == (both >= 0.8 * (len(sets[i]) + len(sets[j]) - both))


def test_clamped(spark):
    df = spark.createDataFrame([(1, "AAGCAAUUGC", "((....))..")], "id int, seq string, b string")
    got = sequences.clamped(df, sequences.base_pairs(df, "id", "b"), "id", "seq", 2).first()
    assert (got.edits, got.clamped) == (4, "GGGCAACCGC")


def test_escalated(spark):
    left = spark.createDataFrame([(1, 100.0, 100.0), (2, 200.0, 200.0)], "k long, len double, z double")
    right = spark.createDataFrame([(10, 101.0, 101.0), (11, 214.0, 214.0), (12, 190.0, 190.0)], "k long, len double, z double")
    first = matching.greedy(matching.candidates(left, right, "k", {"len": 5.0}, {"len": "z"}, 3))
    more = matching.escalated(left, right, first, "k", "len", {"len": 10.0}, {"len": "z"}, 3)
    assert [tuple(r)[:2] for r in first.collect()] == [(1, 10)] and [tuple(r)[:2] for r in more.collect()] == [(2, 11)]


def test_false_discovery_by_ranges(spark):
    from tessera.operators import statistics as st

    ps = [0.001, 0.04, 0.03, 0.03, 0.5, None, 0.9, 0.041]
    got = {r.i: r for r in st.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double")).collect()}
    known = sorted(p for p in ps if p is not None)
    for i, p in enumerate(ps):
        want = None if p is None else min(min(q * len(known) / (sum(x <= q for x in known)) for q in known if q >= p), 1)
        assert (got[i].q is None and got[i].significant is None) if p is None else abs(got[i].q - want) < 1e-12 and got[i].significant == (want <= 0.05)


def test_ranks_of_values_that_differ_when_worked_out_again(spark):
    import random as rnd

    from pyspark.sql import functions as F
    from tessera.operators import statistics as st

    noisy = F.udf(lambda i: (i + 1) / 20 * (1 + rnd.random() * 1e-9), "double").asNondeterministic()
    tests = spark.range(16).select("id", noisy("id").alias("p"))  # as sums of doubles, whose rows come in any order
    assert st.benjamini_hochberg(tests).where("q is null or significant is null").isEmpty()
    assert {r.id: r["rank"] for r in st.average_ranks(tests, "p", "rank").collect()} == {i: i + 1 for i in range(16)}


def test_intervals_to_sequences(spark):
    from tessera.operators import relations as ops

    contigs = spark.createDataFrame([("c", "AAAUUUGGGCCC" * 30), ("d", "AAAN" * 90)], "seqid string, seq string")
    intervals = spark.createDataFrame([("c", 0, 360, "+"), ("c", 0, 360, "-"), ("c", 3, 40, "+"), ("d", 0, 300, "+"), ("none", 0, 300, "+")], "seqid string, a int, b int, strand string")
    got = {r.strand: r for r in ops.extracted(intervals, contigs, 200, 250).collect()}
    assert len(got) == 2 and (got["+"].seq_start, got["+"].seq_end) == (111, 360) and (got["-"].seq_start, got["-"].seq_end) == (1, 250)
    whole = "AAAUUUGGGCCC" * 30
    assert got["+"].sequence == whole[110:] and got["-"].sequence == "".join({"A": "U", "U": "A", "G": "C", "C": "G"}[x] for x in reversed(whole))[-250:]


def test_kmers_of_any_text(spark):
    from pyspark.sql import functions as F

    from tessera.functions import rna

    df = spark.createDataFrame([("AUGC",), ("A",), ("",), ("éAU",)], "s string")
    assert [r[0] for r in df.select(rna.kmers(F.col("s"), 2)).collect()] == [["AU", "UG", "GC"], [], [], ["éA", "AU"]]


def test_nearest_by_kmers(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("AUGC") for _ in range(rng.choice([0, 1, 5, 40, 41, 300]))), i % 3 % 2) for i in range(120)]
    rows += [(200 + i, rows[3][1] + "A", i % 2) for i in range(40)] + [(300, "A" * 5000, 1), (301, "AXGC", None), (302, "C" * 9000, 0)]
    df = spark.createDataFrame(rows + [(None, "AUGC", 1), (400, None, 1)], "id long, s string, y int").repartition(3)
    count = {i: nearest.counted(s, (2, 3)) for i, s, _ in rows}
    for i, s, _ in rows[:20]:
        want = Counter(s[j : j + k] for k in (2, 3) for j in range(len(s) - k + 1))
        assert sorted(count[i][count[i] > 0]) == sorted(want.values())
    monkeypatch.setattr(nearest, "ROWS", 16)
    got = {r.key: [(x.d2, x.key, x.tag) for x in r.near] for r in nearest.nearest_by_kmers(df, "id", "s", "y", (2, 3), 3).collect()}
    want = {i: sorted((float(((count[i] - count[j]) ** 2).sum()), j) for j, _, _ in rows if j != i)[:3] for i, _, _ in rows}
    assert {i: [x[:2] for x in near] for i, near in got.items()} == want
    tags = {i: y for i, _, y in rows}
    assert all(tags[x[1]] == x[2] for near in got.values() for x in near)
    most = 0 if sum(y == 0 for y in tags.values()) >= sum(y == 1 for y in tags.values()) + 2 else 1
    kept = {r.id for r in nearest.edited(df, "id", "s", "y", (2, 3)).collect()}
    assert kept == {i for i in want if tags[i] != most or all(tags[j] == most for _, j in want[i])} and len(kept) < len(rows)
    assert nearest.edited(df.where("false"), "id", "s", "y", (2, 3)).count() == 0
    assert nearest.nearest_by_kmers(df.where("id = 5"), "id", "s", "y", (2, 3), 3).first().near == []


def test_collapse_report(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("AUGC") for _ in range(100))
    edit = lambda at: base[:at] + ("A" if base[at] != "A" else "C") + base[at + 1 :]
    rows = [(1, base, "g"), (2, base, "g"), (3, edit(7), "g"), (4, edit(60), "g"), (5, "", "g"), (6, "", "g"), (7, base, "h"), (8, "A" * 50, "h"), (9, edit(3), None), (10, base, None), (11, "", "e")]
    rows += [(20 + i, "AUGC" * 30, "k") for i in range(4)]
    got = {r.g: tuple(r)[1:] for r in sequences.collapse_report(spark.createDataFrame(rows, "id long, s string, g string"), "id", "s", "g").collect()}
    assert got["g"][:4] == (6, 0, 2, 6) and got["g"][5] == "near-identical pairs: 6"
    assert got["h"] == (2, 1, 1, 0, 0.0, "repetitive sequences: 1") and got["e"] == (1, 0, 0, 0, 0.0, "")
    assert got["k"][:4] == (4, 4, 4, 6) and got["k"][5] == "repetitive sequences: 4; identical copies: 4; near-identical pairs: 6"
    assert got[None][:4] == (2, 0, 1, 1)  # no group is a group of its own


def test_feature_sets(spark):
    every = [*features.MELTING, *(c for b in features.BLOCKS.values() for c in b), *features.CIRCULAR, *features.LEGACY]
    chosen = features.feature_columns(every, "noncircular")
    assert not set(chosen) & set(features.MELTING) and "nupack_gc_content" not in chosen and len(chosen) == len(set(chosen)) == 93
    assert len(features.feature_columns(every, "circular")) == 20 and len(features.feature_columns(every, "legacy")) == 15
    assert features.feature_columns(["nupack_gc_content", "x", "seq_length"], "noncircular") == ["seq_length", "nupack_gc_content"]
    with pytest.raises(ValueError):
        features.feature_columns(every, "other")
    df = spark.createDataFrame([(1, None, 2.0), (0, 3.0, None), (1, None, 1.0)], "y int, nupack_Tm double, seq_length double")
    assert [tuple(r) for r in models.inventory(df, "circular", "y").collect()] == [(0, "nupack_Tm", "melting", 3, 2, 0)]
    assert [tuple(r) for r in models.inventory(df, "noncircular", "y").collect()] == [(0, "seq_length", "composition", 3, 0, 1)]


def test_resumed_counts_finished_rows(spark):
    todo = spark.createDataFrame([(i, f"r{i}") for i in range(10)], "id long, name string")
    done = spark.createDataFrame([(2,), (2,), (5,), (99,)], "id long")
    assert sorted(r.id for r in relations.resumed(todo, done, "id").collect()) == [0, 1, 3, 4, 6, 7, 8, 9]
    assert sorted(r.id for r in relations.resumed(todo, done, "id", limit=6).collect()) == [0, 1, 3]
    assert relations.resumed(todo, done, "id", limit=2).isEmpty()


def test_picked_keeps_order_and_misses_nothing(spark):
    source = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3), (3, "d", 4)], "id long, seq string, line int")
    wanted = spark.createDataFrame([(2, 0), (1, 1), (2, 2)], "id long, position int")
    got = relations.picked(wanted, source, "id", "position", F.col("line")).orderBy("position").collect()
    assert [(r.id, r.seq) for r in got] == [(2, "c"), (1, "a")]
    with pytest.raises(ValueError, match="7"):
        relations.picked(spark.createDataFrame([(7, 0)], "id long, position int"), source, "id", "position", F.col("line"))


def test_student_tail(spark):
    # two-sided tail probabilities from tables of Student's t
    for t, df, p in ((2.228, 10, 0.05), (2.764, 10, 0.02), (1.984, 100, 0.05), (-3.390, 100, 0.001), (0.0, 30, 1.0)):
        got = spark.range(1).select(statistics.student_tail(F.lit(t), F.lit(float(df))).alias("p")).first().p
        assert abs(got - p) < 0.02 * p


def test_importance_summary(spark):
    drops = spark.createDataFrame([("x", 0, 0.1), ("x", 1, 0.3), ("y", 0, 0.0)], "block string, repeat int, drop double")
    got = {r.block: (r.repeats, round(r["mean"], 6), round(r.deviation, 6)) for r in models.importance_summary(drops).collect()}
    assert got == {"x": (2, 0.2, 0.1), "y": (1, 0.0, 0.0)}
