import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_duplicates as nd
from tessera.llm import signature_tree
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows):
    own = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 60), doc)
    return sorted((doc, len(own[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randint(0, 900)}" for _ in range(n)]
    line, out = " ".join(text(12)), []
    for _ in range(25):
        base = text(rng.choice([3, 6, 20, 60, 300]))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = "x" + str(rng.random())
            if rng.random() < 0.5:
                base = copy  # chains
            out.append(" ".join(copy) + rng.choice(["", " ", f"\n{line}"]))
    out += ["", None, " \t\n", "A b", "a B", "one", out[4].upper(), out[9], *[f"{line} {i}" for i in range(6)], line, line]
    return [(i * 3 % 1009, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "bucket", "volume", "few"), [(1, 2048, 500_000, 12), (2, 3, 300, 1)])
def test_against_brute_force(spark, monkeypatch, seed, bucket, volume, few):
    monkeypatch.setattr(nd, "BUCKET", bucket)
    monkeypatch.setattr(nd, "VOLUME", volume)
    monkeypatch.setattr(nd, "FEW", few)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, label int")
    assert sorted(tuple(r) for r in nd.joined(df).collect()) == brute(rows)


def test_repeated_ids_and_empty(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words"), (None, None), (2, None)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in nd.joined(df).collect())
    assert got == [(0, 0, None), (1, 3, 1), (1, 3, 1), (2, 0, 2), (5, 1, 5), (5, 3, 1)]
    assert nd.joined(df.limit(0)).count() == 0


def test_kept_one(spark):
    rows = [(1, "a b c d e f g"), (4, "A b c d e f g"), (5, "x"), (5, "x"), (6, None), (7, "")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in nd.kept_one(df).collect()) == [1, 5, 6, 7]


def test_buckets_of_equal_sums_are_all_traversed(spark):
    """Members {0, 3, 5} and {0, 2, 6}: the same count, least row and sum."""
    own = np.arange(1, 40, dtype=np.uint64)
    prefix = {0: [1, 2], 3: [1], 5: [1], 2: [2], 6: [2]}
    rows = [(r, len(own), bytearray(signature_tree.signature(own)), bytearray(np.array(p, np.int64).tobytes())) for r, p in prefix.items()]
    classes = spark.createDataFrame(rows, "row long, n long, signature binary, prefix binary")
    assert {r.node: r.label for r in components(nd._candidates(classes, 80)).collect()} == dict.fromkeys(prefix, 0)


def test_traversal_loses_nothing():
    rng = np.random.default_rng(2)
    own = []
    for _ in range(90):
        base = rng.integers(0, 1 << 63, rng.choice([1, 4, 30, 31, 33, 200])).astype(np.uint64)
        own += [base, np.unique(np.concatenate([base[len(base) // 8 :], rng.integers(0, 1 << 63, len(base) // 12).astype(np.uint64)]))]
    own = [np.unique(s) for s in own]
    labels = np.arange(len(own)) // 4
    i, j = signature_tree.candidates(np.array([len(s) for s in own]), [signature_tree.signature(s) for s in own], labels)
    got = {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert len(got) == len(i)
    for a in range(len(own)):
        for b in range(a):
            both = len(np.intersect1d(own[a], own[b]))
            if 100 * both >= 80 * (len(own[a]) + len(own[b]) - both) and labels[a] != labels[b]:
                assert frozenset((a, b)) in got
    assert len(got) < 2000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (95, 96), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([90, 95, 96, 100], 90)}


def test_copies_with_a_fresh_word_each(spark):
    """Twenty copies of a text, two by two with a fresh word at one place: all link with the base, at 45 of 55."""
    base = [f"w{i}" for i in range(54)]
    least = sorted(int(x) for x in nd.shingles(" ".join(base)))[12]
    rng, rows = random.Random(8), [(0, " ".join(base))]
    fresh = {}
    for i in range(1, 11):
        for n in (i, 21 - i):
            while True:
                copy = list(base)
                copy[5 * (i - 1) + 4] = f"f{rng.random()}"
                own = set(nd.shingles(" ".join(copy)).tolist()) - set(nd.shingles(" ".join(base)).tolist())
                if all(x > least for x in own) or len(own) < 5:
                    break
                if rng.random() < 0.002:
                    break
            fresh[n] = " ".join(copy)
    rows += [(n, fresh[n]) for n in sorted(fresh)]
    rows += [(100 + i, f"a{i} b{i} c{i}") for i in range(3000)]
    got = {r.doc_id: r.component_id for r in nd.joined(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert all(got[n] == 0 for n in range(21)) and all(got[100 + i] == 100 + i for i in range(3000))


@pytest.mark.parametrize("percent", [35, 60])
def test_other_limits(spark, percent):
    rng = random.Random(percent)
    say = lambda n: [f"v{rng.randint(0, 5000)}" for _ in range(n)]
    rows = []
    for i in range(30):
        base = say(rng.choice([20, 34, 60]))
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(base + say(rng.randint(1, 60)))), (3 * i + 2, " ".join(base[: len(base) // 2] + say(9)))]
    own, want = {d: sets(t) for d, t in rows}, {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                if want[b] < want[a] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                    want[a], changed = want[b], True
    got = {r.doc_id: r.component_id for r in nd.joined(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert got == want and len(set(want.values())) < len(rows)


def test_hot_keys_are_spread(spark, monkeypatch):
    from tessera.llm import components as co

    monkeypatch.setattr(co, "HOT", 5)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(0, 60, 3)] + [(500, 501)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 0 for e in edges[:-1] for n in e}, 500: 500, 501: 500}
    rows = corpus(5) + [(2000 + i, "the same words in each of them") for i in range(30)] + [(3000 + i, None) for i in range(20)]
    assert sorted(tuple(r) for r in nd.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_kept_one_by_row(spark):
    """Null ids, repeated rows, an id with two texts, and columns that clash with the operator's own."""
    text = "one two three four five six seven"
    rows = [(None, text, "a", 1), (9, text, "a", 1), (8, text.upper(), "b", 2), (8, "quite another text of some words", "b", 2), (None, "all alone here with words", "c", 3), (None, None, "d", 4), (None, None, "e", 5), (1, "", "e", 6), (4, "x", "f", 7), (4, "x", "f", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, key int")
    got = sorted((r.doc_id or 0, r.text or "", r.key) for r in nd.kept_one(df).collect())
    assert got == sorted([(8, text.upper(), 2), (8, rows[3][1], 2), (0, rows[4][1], 3), (0, "", 4), (0, "", 5), (1, "", 6), (4, "x", 7)])
    assert nd.kept_one(df).columns == df.columns and nd.kept_one(df.limit(0)).count() == 0


def test_rows_that_differ_in_a_map_alone(spark):
    from tessera.llm.rows import keyed

    rows = [(1, "w " * 9, {"a": 1, "b": 2}), (1, "w " * 9, {"b": 2, "a": 1}), (2, None, {"a": 1}), (2, None, {"a": 2}), (2, None, {"a": 2}), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    key = [bytes(r._row) for r in keyed(df)[0].collect()]
    assert len(set(key)) == 4 and key[0] == key[1] and key[3] == key[4] and len(key[0]) == 16
    assert sorted((r.doc_id, str(r.m)) for r in nd.kept_one(df).collect() if r.text is None) == [(2, "None"), (2, "{'a': 1}"), (2, "{'a': 2}")]
    assert keyed(df.withColumn("_ROW", F.lit(1)))[1] == "_row_"


@pytest.mark.parametrize("few", [0, 1 << 22])
def test_decisions_on_hot_keys(spark, monkeypatch, few):
    from tessera.llm import components
    from tessera.llm import rows as filters
    from tessera.llm.rows import keyed, settled

    monkeypatch.setattr(components, "HOT", 3)
    monkeypatch.setattr(filters, "BROADCAST_KEYS", few)  # by a Bloom filter, and by the hashes themselves
    df = spark.createDataFrame([(i % 7 if i % 3 else 1, "x" if i % 3 else "hot") for i in range(300)], "doc_id long, text string")
    rows, key = keyed(df)
    decided = rows.groupBy(F.col(key).alias("key")).agg((F.first("text") == "hot").alias("once"), F.count("*").alias("many"), F.first("doc_id").alias("d")).where("once or d < 3")
    got = sorted((r.doc_id, r.text) for r in settled(rows, key, decided).collect())
    assert got == sorted([(1, "hot")] + [(r.doc_id, r.text) for r in df.collect() if r.text == "x" and r.doc_id >= 3])
