"""Values that lie exactly on a threshold or a tie: the last bits of sums in doubles must not decide."""

import datetime

from tessera import registry  # noqa: F401  registering
from tessera.plans import bindings, tables


def _written(spark, folder, **rows):
    schemas = {
        "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string",
        "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp",
        "supplier": "s_suppkey long, s_nationkey long",
    }
    for name, of in rows.items():
        spark.createDataFrame(of, schemas[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _line(order, n, discount, tax, supplier=1, quantity=1.0):
    return (order, n, supplier, n, quantity, discount, tax, datetime.datetime(2020, 1, 1))


def test_a_change_of_nothing_passes_no_gate(spark, tmp_path):
    """0.1 + 0.2 of tax less 0.3 of discount is 0."""
    sf = _written(spark, tmp_path, orders=[(1, 1, 10.0, "x"), (2, 1, 20.0, "x")], lineitem=[_line(1, 1, 0.3, 0.1), _line(1, 2, 0.0, 0.2), _line(2, 1, 0.0, 0.01)])
    assert {(r.record_id, r.dp, r.gate_dp) for r in tables.yields(bindings.Views(spark, sf)).collect()} == {(1, 0.0, False), (2, 0.01, True)}
    assert {(r.record_id, r.dp) for r in bindings.Views(spark, sf).gates().collect()} == {(1, 0.0), (2, 0.01)}


def test_halves_of_curves_fall_alike_in_sql(spark, tmp_path):
    """means of 16 lines lie on halves of the fourth digit; equal means of other sums don't rise."""
    import duckdb

    of = [_line(i, 1, d / 100, 0.0, supplier=s, quantity=q) for s in range(1, 6) for q in (10.0, 37.0, 40.0) for i, d in enumerate([(3 * s + int(q) + j * j) % 11 for j in range(16)])]
    of += [_line(i, 1, d, 0.0, supplier=9, quantity=q) for q, ds in ((37.0, (0.1, 0.2, 0.3)), (40.0, (0.3, 0.2, 0.1)), (41.0, (0.2, 0.2, 0.2))) for i, d in enumerate(ds)]
    sf = _written(spark, tmp_path, lineitem=of, supplier=[(s, s) for s in range(1, 10)])
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    for name in ("crv_half_width", "join_curve_lookup"):
        got = bindings.QUERIES[name](spark, sf)
        columns = ", ".join(f'"{c}"' for c in got.columns)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.sql(f"SELECT {columns} FROM ({bindings.SQL[name]})").fetchall())), name
    assert not any(r.rises for r in bindings.QUERIES["join_curve_lookup"](spark, sf).where("id = 9").collect())


def test_equal_costs_tie_by_id(spark):
    """the two partners are as far to either side; in doubles one seems nearer by its last bits."""
    from tessera.operators import matching

    side = spark.createDataFrame([(1, 0.3, 0.3)], "record_id long, x double, z double")
    other = spark.createDataFrame([(5, 0.1, 0.1), (9, 0.5, 0.5), (4, 0.7, 0.7), (3, -0.1, -0.1)], "record_id long, x double, z double")
    first = lambda k: [r.b for r in matching.candidates(side, other, "record_id", {"x": 1.0}, {"x": "z"}, k, digits=9).orderBy("cost", "b").collect()]
    assert first(1) == [5] and first(3) == [5, 9, 3]


def test_pairs_and_kmers_stay_where_their_row_lies(spark):
    """Characters and k-mers are not dealt out; a row's pairs and counts are worked out in the row's task."""
    from tessera.operators import sequences

    df = spark.createDataFrame([(1, "AUGCAUAGGAUUUNAUG", ")((..()).(())("), (2, "A", "."), (3, "AAUU", "(())"), (4, None, None)], "id long, seq string, b string")
    paired = sequences.with_pairs(df, "b")
    made = [sequences.base_pairs(df, "id", "b"), sequences.stem_mutations(paired, "id", "seq"), sequences.clamped(paired, None, "id", "seq"), sequences.with_kmer_vectors(df, "seq", {2: "d_", 3: "t_"})]
    assert not any("Exchange" in x._jdf.queryExecution().executedPlan().toString() for x in made)
    assert sorted((r.id, r.i, r.j) for r in made[0].collect()) == [(1, 2, 7), (1, 5, 6), (1, 9, 12), (1, 10, 11), (3, 0, 3), (3, 1, 2)]
    assert [(r.id, r.i, r.j, r.broken, r.rescued) for r in made[1].where("id = 3").collect()] == [(3, 0, 3, "UAUU", "UAUA")]
    assert [tuple(r) for r in made[2].where("id = 3").collect()] == [(3, 4, "GGCC")]
    wide = {r.id: r for r in made[3].collect()}
    assert (wide[1].d_AU, wide[1].t_AUG, wide[2].d_AU, wide[3].d_AU, wide[4].d_AU) == (4 / 16, 2 / 15, 0.0, 1 / 3, 0.0)


def test_long_near_copies_take_time_by_their_length(spark):
    """blocks and positions were sought by walking through the text, in time by the square of its length."""
    import random
    import time

    from tessera.operators import sequences

    rng = random.Random(4)
    base = [rng.choice("AUGC") for _ in range(300_000)]
    near, far = base.copy(), base.copy()
    for i in rng.sample(range(len(base)), 5000):
        near[i] = "N"
    for i in rng.sample(range(len(base)), 7000):
        far[i] = "é"
    df = spark.createDataFrame([(1, "".join(base)), (2, "".join(near)), (3, "".join(far)), (4, "".join(base[:299_000]))], "id long, s string")
    began = time.time()
    assert sorted(tuple(r) for r in sequences.near_identical(df, "id", "s", 0.98).collect()) == [(1, 2), (1, 4), (2, 4)]
    assert time.time() - began < 40


def test_truncated_partners_are_counted_not_paired(spark, tmp_path):
    """rows met every partner of about their length, and walked through its text."""
    from tessera.plans import panels

    texts = ["", "G", "AC", "abcd" * 20, "bcdz" * 25, "dcba" * 60, "g" * 300, "c" * 99 + "a" * 201, "xyz" * 50, "ab" * 140]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts * 4)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, (i // 10) % 2, 0) for i in range(len(texts) * 4)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    v = bindings.Views(spark, str(tmp_path))
    rows = v.panel().collect()
    gc = lambda s: sum(c in "GC" for c in s) / len(s)
    want = {}
    for a in rows:
        if a.label == 0 and a.len > 0:
            near = [b.len for b in rows if b.label == 1 and a.len <= b.len <= a.len + 200 and a.gc - 0.05 <= gc(b.seq[-a.len :]) <= a.gc + 0.05]
            if near:
                want[a.record_id] = (len(near), max(near))
    got = panels.join_truncating(v)
    assert {r.a: (r.partners, r.longest) for r in got.collect()} == want and want
    assert "cell" not in got._jdf.queryExecution().analyzed().toString()


def test_projection_reads_texts_once(spark):
    """two fits and the result each rewrote all texts and counted their k-mers."""
    got = bindings.QUERIES["sta_projection"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and not any("documents" in f for f in got.inputFiles())


def test_a_score_just_below_the_mean_keeps_its_sign(spark, tmp_path):
    """SQL rounds it to a zero below zero, which is another double than zero and another text."""
    import math

    sf = _written(spark, tmp_path, orders=[(1, 1, 100.0, "x"), (2, 1, 200.0, "x"), (3, 1, 149.99999, "x"), (4, 1, 150.00001, "x")], lineitem=[_line(1, 1, 0.0, 0.1)])
    got = {r.record_id: r.z for r in tables.yield_gates(bindings.Views(spark, sf)).collect()}
    assert got[3] == got[4] == 0 and math.copysign(1, got[3]) == -1 and math.copysign(1, got[4]) == 1
