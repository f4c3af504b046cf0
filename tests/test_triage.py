import pytest
from pyspark.sql import functions as F

from tessera.streaming import triage

GATES = {"low": "low", "novel": "novel"}


@pytest.fixture
def run(spark, tmp_path):
    static = spark.createDataFrame([(str(i), float(i % 7)) for i in range(60)], "record_id string, z double")

    def judge(rows):
        e = F.least(F.coalesce("evalue_a", F.lit(float("inf"))), F.coalesce("evalue_b", F.lit(float("inf"))))
        full = rows.join(static, "record_id", "left").withColumn("e", e)
        full = full.withColumn("low", F.coalesce(F.col("z") <= 3, F.lit(False))).withColumn("novel", F.col("e") > 0.1)
        return full.withColumn("passes", F.col("low") & F.col("novel"))

    class Run:
        source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

        def put(self, rows):
            spark.createDataFrame(rows, triage.EVENTS).coalesce(1).write.mode("append").parquet(self.source)

        def go(self, seed=0, stride=10):
            q = triage.triage(spark, self.source, self.out, self.mark, judge, GATES, ["z"], stride, seed, pilot=0.25)
            q.awaitTermination()
            assert q.exception() is None

        def records(self):
            return {(r.chunk, r.part): r for r in spark.read.parquet(f"{self.out}/analysis").collect()}

    return Run()


def row(i, record=None):
    return ("row", str(i if record is None else record), i, None, None, None, None)


def hit(kind, record, e, ident=0.5, target=1, line=1):
    return (kind, str(record), None, e, ident, target, line)


def test_chunk_over_two_files_is_one_record_and_the_remainder_waits(spark, run):
    run.put([row(i) for i in range(6)] + [hit("a", 1, 0.05), hit("b", 2, 0.5), hit("a", 2, 0.9)])
    run.go()
    assert run.records() == {} and [tuple(r) for r in triage.open_chunks(spark, run.out).collect()] == [(0, 6)]
    run.put([row(i) for i in range(6, 14)] + [hit("b", 3, 0.01), hit("a", 2, 0.02)])  # for rows that wait in the state
    run.go()
    got = run.records()
    assert list(got) == [(0, 0)] and got[0, 0].n == 10
    # z <= 3: 0 1 2 3 7 8 9; close hits: 1 2 3
    assert (got[0, 0].n_low, got[0, 0].n_novel, got[0, 0].n_pass, got[0, 0].first_id, got[0, 0].last_id) == (7, 7, 4, "0", "9")
    assert got[0, 0].top_ids == ["0", "7", "8", "9"] and got[0, 0].vs_pilot == pytest.approx(0.15)
    run.go()  # nothing new
    assert len(run.records()) == 1
    triage.flush(spark, run.source, run.out, 10)
    run.go()
    got = run.records()
    assert set(got) == {(0, 0), (1, 0)} and got[1, 0].n == 4
    run.put([row(i) for i in range(14, 20)])  # after a flush the rest is another part
    run.go()
    got = run.records()
    assert got[1, 1].n == 6 and triage.open_chunks(spark, run.out).count() == 0
    total = triage.totals(spark, run.out).orderBy("chunk").collect()
    assert [(r.chunk, r.n, r.cum_n) for r in total] == [(0, 10, 10), (1, 10, 20)]
    again = {(r.chunk, r.part): r for r in triage.backfilled(spark, run.out, GATES, ["z"], 0.25).collect()}
    assert {k: (r.n, r.n_pass, r.top_ids) for k, r in again.items()} == {k: (r.n, r.n_pass, r.top_ids) for k, r in got.items()}


def test_records_and_numbers_met_again(spark, run):
    run.put([row(i) for i in range(5)] + [row(5, record=2), row(6, record=2)])
    run.put([row(3), *(row(i) for i in range(7, 10)), row(0, record=40)])  # numbers 3 and 0 are taken
    run.go()
    got = run.records()
    assert got[0, 0].n == 10
    ids = sorted(int(r.record_id) for r in triage.master(spark, run.out).collect())
    assert ids == [0, 1, 2, 3, 4, 7, 8, 9]
    assert spark.read.parquet(f"{run.out}/rows").where("again").count() == 2


def test_late_hits_change_nothing(spark, run):
    run.put([row(i) for i in range(10)])
    run.go()
    run.put([hit("a", 3, 0.001)])
    run.go()
    assert run.records()[0, 0].n_novel == 10
    late = spark.read.schema(f"{triage.CLOSED}, batch long").parquet(f"{run.out}/closed").where("kind = 'late'").collect()
    assert [(r.record_id, r.evalue_a) for r in late] == [("3", 0.001)]


def test_seed_and_empty_source(spark, run):
    run.put([])
    run.go(seed=12)
    run.put([row(i) for i in range(8, 40)])
    run.go(seed=12)
    assert {k: (r.n, r.first_id) for k, r in run.records().items()} == {(0, 0): (10, "12"), (1, 0): (10, "22")}


def test_order_of_hits():
    hits = [(0.1, 0.5, 3, 1), (0.1, 0.9, 3, 1), (0.1, 0.9, 2, 9), (0.2, 1.0, 1, 1), (None, 1.0, 1, 1), (0.1, 0.9, 2, 4)]
    best = None
    for h in hits:
        best = h if triage._better(h, best) else best
    assert best == (0.1, 0.9, 2, 4)


def test_a_chunk_reads_and_writes_its_state_once_a_batch():
    from pyspark.sql import Row

    from tessera.streaming.triage import Chunks

    calls, values = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return values.get("x")

        def update(self, x):
            calls.append("update")
            values["x"] = x

    class Handle:
        def getValueState(self, *_):  # noqa: N802  Spark's name
            return Value()

    chunks = Chunks(250)
    chunks.init(Handle())
    rows = [Row(kind="row", record_id=str(i), seq_no=i, again=False, a=None, b=None) for i in range(250)]
    first = list(chunks.handleInputRows((0,), iter(rows[:100]), None))
    assert [r.kind for r in first] == ["open"] and first[0].held == 100 and calls == ["get", "update"]
    second = list(chunks.handleInputRows((0,), iter([*rows[90:], rows[3]]), None))
    assert sorted(r.seq_no for r in second if r.kind == "row") == list(range(250)) and calls == ["get", "update"] * 2
    assert [r.kind for r in chunks.handleInputRows((0,), iter(rows[:5]), None)] == ["open"]


def test_batches_follow_the_rules_said_row_by_row(spark, tmp_path):
    """Rows, numbers and hits met again, in any order, in several files, and flushes: as ``Records`` and ``Chunks`` have it. The plan runs no Python for a record."""
    import random

    from pyspark.sql import Row

    class Value:
        def __init__(self):
            self.x = None

        def get(self):
            return self.x

        def update(self, x):
            self.x = x

    class Handle:
        def getValueState(self, *_):  # noqa: N802  Spark's name
            return Value()

    def model(kind, *options):
        made = kind(*options)
        made.init(Handle())
        return made

    draw, stride, seed = random.Random(7), 6, 4
    files = [[row(draw.randrange(50), draw.randrange(60)) for _ in range(12)] + [hit(draw.choice("ab"), draw.randrange(60), draw.choice([0.0, 0.2, 0.5, None]), draw.random(), draw.randrange(9)) for _ in range(14)] for _ in range(3)]
    files.append([row(i) for i in range(30, 60)] + [hit("a", i, -1.0) for i in range(60)])
    files.append([("flush", None, stride * i + seed, None, None, None, None) for i in (0, 2, 3)] + [row(7, 99), hit("b", 99, 0.1)])
    files.append([row(i, 70 + i) for i in range(4, 24)] + [hit("b", i, -2.0) for i in range(95)])
    records, chunks, want = {}, {}, set()
    side = lambda x: (None, None, None) if x is None else tuple(x.values() if isinstance(x, dict) else x)[:3]
    for number, events in enumerate(files):
        placed, keyed = [], {}
        for e in events:
            keyed.setdefault(e[1] or "", []).append(Row(kind=e[0], record_id=e[1], seq_no=e[2], evalue=e[3], ident=e[4], target=e[5], line=e[6]))
        for key in sorted(keyed):
            placed += records.setdefault(key, model(triage.Records, stride, seed)).handleInputRows((key,), iter(keyed[key]), None)
        for c in sorted({p.chunk for p in placed}):
            own = sorted((p for p in placed if p.chunk == c), key=lambda p: p.record_id)
            for r in chunks.setdefault(c, model(triage.Chunks, stride)).handleInputRows((c,), iter(own), None):
                again = r.again if r.kind == "row" else False
                want.add((number, r.chunk, r.part, r.kind, r.record_id, r.seq_no, again, r.evalue_a, r.ident_a, r.target_a, r.evalue_b, r.ident_b, r.target_b, r.held))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, events in enumerate(files):
        spark.createDataFrame(events, triage.EVENTS).coalesce(1).write.mode("append").parquet(source)
        q = triage.triage(spark, source, out, str(tmp_path / "mark"), lambda rows: rows.withColumn("passes", F.lit(True)), stride=stride, seed=seed)
        q.awaitTermination()
    told = spark.read.schema(f"{triage.CLOSED}, batch long").parquet(f"{out}/closed").where("kind <> 'held'")
    names = [x.split()[0] for x in triage.CLOSED.split(", ")]
    got = {(r.batch, *(r[n] for n in ("chunk", "part", *names[2:]))) for r in told.collect()}
    assert {x[3] for x in got} == {"row", "late", "open"} and len({x[2] for x in got}) > 1
    assert got == want
    stream = spark.readStream.schema(triage.EVENTS).parquet(source)
    assert "python" not in triage._records(stream, seed)._jdf.queryExecution().analyzed().toString().lower()
