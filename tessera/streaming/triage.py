"""Stream triage: a growing source of candidates and of their hits, taken in chunks of a fixed stride.

All progress is Spark's or lies beside the results. The checkpoint holds what was read and, by record, the places it had
and the best hit of each tool so far: a streaming aggregate, without Python, that touches a batch's own keys alone. What
a batch changes is met with the rows of chunks that are still open, which are carried from batch to batch; a chunk
is handed on as a whole when it is full, or when a flush asks for the remainder. Of closed chunks one row each is read
again. What is handed on is gated and written under its batch id, over what a failed attempt of the same batch left,
so each chunk has one record. ``Records`` and ``Chunks`` say the same rules row by row, for tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessera.operators.statistics import cumulative

#: What the stream's files hold: candidates ('row'), hits of two tools ('a', 'b'), and flush marks.
EVENTS = "kind string, record_id string, seq_no long, evalue double, ident double, target long, line long"
_HIT = "evalue double, ident double, target long, line long"
#: What chunks hand on: 'row' of a closed chunk, 'late' hit for one, and how many rows an open chunk ('open') holds.
CLOSED = "chunk long, part int, kind string, record_id string, seq_no long, again boolean, evalue_a double, ident_a double, target_a long, evalue_b double, ident_b double, target_b long, held long"
#: What an open chunk's or a closed chunk's line also holds: how many places are closed, and which, unless it is all of them.
_STATE = f"{CLOSED}, n_gone int, gone array<long>, batch long"
TOP = 20


def _better(new: tuple | None, old: tuple | None) -> bool:
    """The order of hits: least e-value, greatest identity, least target and line; missing numbers last."""

    def order(h: tuple) -> tuple:
        e, i, t, n = h
        return (e is None, e or 0.0, i is None, -(i or 0.0), t is None, t or 0, n is None, n or 0)

    return new is not None and (old is None or order(new) < order(old))


def _hit(x) -> tuple | None:
    """A hit as a tuple, however Spark hands it over: as a dict in rows, as a Row in states."""
    return None if x is None else tuple(x.values()) if isinstance(x, dict) else tuple(x)


def _told(x: tuple | None) -> dict | None:
    return None if x is None else dict(zip(("evalue", "ident", "target", "line"), x, strict=True))


class Records(StatefulProcessor):
    """By record: whether it was seen before, under which numbers, and its best hits."""

    def __init__(self, stride: int, seed: int):
        self.stride, self.seed = stride, seed

    def init(self, handle) -> None:
        self.state = handle.getValueState("record", f"seqs array<long>, a struct<{_HIT}>, b struct<{_HIT}>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802  Spark's name
        seqs, best = [], {"a": None, "b": None}
        held = self.state.get()  # none for a new record; each call to the state is a way to the JVM and back
        if held is not None:
            seqs, best = list(held[0] or []), {"a": _hit(held[1]), "b": _hit(held[2])}
        known, new, improved, flushed = set(seqs), set(), False, []
        for r in rows:
            if r.kind == "row":
                if r.seq_no is not None and r.seq_no >= self.seed and r.seq_no not in known:
                    new.add(r.seq_no)
            elif r.kind == "flush":
                flushed.append(r.seq_no)
            else:
                hit = (r.evalue, r.ident, r.target, r.line)
                if _better(hit, best[r.kind]):
                    best[r.kind], improved = hit, True
        out = [(s, "row", bool(i or seqs)) for i, s in enumerate(sorted(new))]
        out += [(s, "hit", False) for s in seqs] if improved else []
        if new or improved:
            self.state.update((seqs + sorted(new), best["a"], best["b"]))
        for s, kind, again in [*out, *((s, "flush", False) for s in flushed)]:
            yield Row(chunk=(s - self.seed) // self.stride, kind=kind, record_id=key[0], seq_no=s, again=again, a=_told(best["a"]), b=_told(best["b"]))

    def close(self) -> None:
        pass


class Chunks(StatefulProcessor):
    """By chunk: the rows of the open chunk; all of them leave when the last place is filled, or at a flush.

    A chunk has ``stride`` places at most, so its state is one value, read and written once a batch.
    """

    def __init__(self, stride: int):
        self.stride = stride

    def init(self, handle) -> None:
        row = f"struct<seq_no long, record_id string, again boolean, a struct<{_HIT}>, b struct<{_HIT}>>"
        self.state = handle.getValueState("chunk", f"part int, rows array<{row}>, gone array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802  Spark's name
        told = self.state.get()
        part, held, gone = (0, {}, set()) if told is None else (told[0], {x[0]: (x[1], x[2], _hit(x[3]), _hit(x[4])) for x in told[1]}, set(told[2]))
        flush, late = False, []
        for r in rows:
            if r.kind == "flush":
                flush = True
            elif r.kind == "row" and r.seq_no not in held and r.seq_no not in gone:
                held[r.seq_no] = (r.record_id, r.again, _hit(r.a), _hit(r.b))
            elif r.kind == "hit" and r.seq_no in held:
                if held[r.seq_no][0] != r.record_id:
                    continue  # the place is another record's
                held[r.seq_no] = (*held[r.seq_no][:2], _hit(r.a), _hit(r.b))
            elif r.kind == "hit" and r.seq_no in gone:
                late.append(r)
        for r in late:
            yield Row(**self._row(key[0], part, "late", r.record_id, r.seq_no, False, r.a, r.b, 0))
        if held and (flush or len(held) + len(gone) == self.stride):
            for seq, v in held.items():
                yield Row(**self._row(key[0], part, "row", v[0], seq, v[1], v[2], v[3], 0))
            part, held, gone = part + 1, {}, gone | held.keys()  # the place stays known, so that nothing fills it twice
        self.state.update((part, [(seq, *v) for seq, v in held.items()], sorted(gone)))
        yield Row(**self._row(key[0], part, "open", None, None, False, None, None, len(held)))

    @staticmethod
    def _row(chunk: int, part: int, kind: str, record: str | None, seq: int | None, again: bool, a, b, held: int) -> dict:
        (ea, ia, ta), (eb, ib, tb) = (x[:3] if x else (None, None, None) for x in (_hit(a), _hit(b)))
        return {"chunk": chunk, "part": part, "kind": kind, "record_id": record, "seq_no": seq, "again": again, "evalue_a": ea, "ident_a": ia, "target_a": ta, "evalue_b": eb, "ident_b": ib, "target_b": tb, "held": held}

    def close(self) -> None:
        pass


def rolled_up(chunks: DataFrame) -> DataFrame:
    """Cumulative n, n_pass and ratio over ordered chunks, by ranges of chunks."""
    full = cumulative(chunks, [], "chunk", ["n", "n_pass"]).drop("next").withColumnRenamed("cum_n_pass", "cum_pass")
    return full.withColumn("cum_ratio", F.try_divide("cum_pass", "cum_n"))


def analysed(rows: DataFrame, gates: dict[str, str], rank: list[str], pilot: float | None = None, top: int = TOP) -> DataFrame:
    """One record for each (chunk, part) of gated ``rows``: counts of rows, gates and passes, first and last id, the best passers.

    ``gates`` and ``rank`` (ascending): SQL expressions over the rows.

    A chunk has at most ``stride`` rows, so its best passers are sorted within their group.
    """
    passer = F.when(F.col("passes"), F.struct(*(F.expr(r).alias(f"r{i}") for i, r in enumerate(rank)), "record_id"))
    full = rows.groupBy("chunk", "part").agg(
        F.count("*").alias("n"),
        F.count_if("passes").alias("n_pass"),
        *(F.count_if(F.expr(c)).alias(f"n_{name}") for name, c in gates.items()),
        F.min_by("record_id", "seq_no").alias("first_id"),
        F.max_by("record_id", "seq_no").alias("last_id"),
        F.transform(F.slice(F.array_sort(F.collect_list(passer)), 1, top), lambda x: x["record_id"]).alias("top_ids"),
    )
    ratio = F.try_divide("n_pass", "n")
    return full.withColumn("ratio", ratio).withColumn("vs_pilot", (ratio - F.lit(pilot) if pilot is not None else F.lit(None)).cast("double"))


def triage(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    judge: Callable[[DataFrame], DataFrame],
    gates: dict[str, str] | None = None,
    rank: list[str] | None = None,
    stride: int = 250,
    seed: int = 0,
    files: int = 1,
    pilot: float | None = None,
) -> StreamingQuery:
    """Read new Parquet files of EVENTS below ``source``, triage every chunk that fills up, and end when all is read.

    Candidates are numbered without gaps; those below ``seed`` count as done. ``judge`` gets the rows of closed chunks
    (CLOSED: each with its best hits of both tools) and joins what it needs of static tables; it adds ``passes``. A hit
    counts when it comes before its chunk is closed; later improvements are written apart. A record met again has a place
    in its chunk, as its number is taken, but isn't appended to the master. A number met again is nothing new.

    Writes ``out/rows`` (gated rows of closed chunks; ``again`` marks those that aren't in the master), ``out/analysis`` (one
    record for each closed chunk), ``out/late`` and ``out/open``, each by batch.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        s = df.sparkSession
        before = s.read.schema(_STATE).parquet(f"{out}/closed").where(F.col("batch") < number) if number else s.createDataFrame([], _STATE)
        now = _closed(_placed(df, stride, seed), before.where((F.col("kind") == "held") & (F.col("batch") == number - 1)), before.where("kind = 'open'"), stride)
        now.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/closed/batch={number}")  # once: the state isn't worked out again
        own = s.read.schema(CLOSED).parquet(f"{out}/closed/batch={number}")
        judge(own.where("kind = 'row'").drop("kind", "held")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        rows = s.read.parquet(f"{out}/rows/batch={number}")
        analysed(rows, gates or {}, rank or ["seq_no"], pilot).write.mode("overwrite").parquet(f"{out}/analysis/batch={number}")

    return _records(stream, seed).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _records(stream: DataFrame, seed: int) -> DataFrame:
    """By record, and by mark of a flush: its places and its best hits, each with the time of the batch that brought it, and the time of its last batch."""
    mark = F.col("kind") == "flush"
    name = F.when(mark, F.col("seq_no").cast("string")).otherwise(F.coalesce("record_id", F.lit("")))
    keyed = stream.withColumn("mark", F.coalesce(mark, F.lit(False))).withColumn("record_id", name).withColumn("at", F.current_timestamp())  # a batch's own, also when it is tried again
    order = F.struct(*(x for c, x in (("evalue", F.col("evalue")), ("ident", -F.col("ident")), ("target", F.col("target")), ("line", F.col("line"))) for x in (F.col(c).isNull().alias(f"no_{c}"), x.alias(c))), "at")
    return keyed.groupBy("mark", "record_id").agg(
        F.collect_set(F.when((F.col("kind") == "row") & (F.col("seq_no") >= seed), F.struct("seq_no", "at"))).alias("places"),
        *(F.min(F.when(F.col("kind") == k, order)).alias(k) for k in "ab"),
        F.max("at").alias("now"),
    )


def _placed(records: DataFrame, stride: int, seed: int) -> DataFrame:
    """(chunk, seq_no, kind, record_id, again, a, b): a batch's new places of its records ('row'), better hits for earlier ones ('hit') and marks ('flush')."""
    numbers = lambda new: F.array_distinct(F.transform(F.filter("places", lambda x: (x["at"] == F.col("now")) == new), lambda x: x["seq_no"]))
    told = records.select("*", numbers(False).alias("old"), numbers(True).alias("all_new"))
    told = told.select("*", F.array_sort(F.array_except("all_new", "old")).alias("new"), F.coalesce(F.greatest("a.at", "b.at") == F.col("now"), F.lit(False)).alias("improved"))
    entry = lambda seq, kind, again: F.struct(seq.alias("seq_no"), F.lit(kind).alias("kind"), again.alias("again"))
    rows = F.transform("new", lambda x, i: entry(x, "row", i > 0))
    hits = F.when(F.col("improved"), F.transform("old", lambda x: entry(x, "hit", F.lit(False)))).otherwise(F.array().cast("array<struct<seq_no: long, kind: string, again: boolean>>"))
    marks = F.array(entry(F.col("record_id").cast("long"), "flush", F.lit(False)))
    best = lambda k: F.when(F.col(k).isNotNull(), F.struct(F.col(f"{k}.evalue").alias("evalue"), (-F.col(f"{k}.ident")).alias("ident"), F.col(f"{k}.target").alias("target"))).alias(k)
    each = told.select("record_id", (F.size("old") > 0).alias("known"), best("a"), best("b"), F.explode(F.when(F.col("mark"), marks).otherwise(F.concat(rows, hits))).alias("x"))
    return each.select(F.expr(f"(x.seq_no - {seed}) div {stride}").alias("chunk"), "x.seq_no", "x.kind", "record_id", (F.col("x.again") | F.col("known")).alias("again"), "a", "b")


def _closed(placed: DataFrame, held: DataFrame, told: DataFrame, stride: int) -> DataFrame:
    """What a batch hands on (CLOSED, with n_gone and gone): rows of chunks that close, late hits, a line for each chunk that was touched, and the rows of chunks that stay open ('held').

    ``held``: those of the batch before; ``told``: the lines of chunks of all batches before.
    """
    hit = lambda k: F.when(F.coalesce(*(F.col(f"{c}_{k}").isNotNull() for c in ("evalue", "ident", "target"))), F.struct(*(F.col(f"{c}_{k}").alias(c) for c in ("evalue", "ident", "target")))).alias(k)
    carried = held.select("chunk", "seq_no", "kind", "record_id", "again", hit("a"), hit("b"))
    is_a = lambda *kinds: F.col("kind").isin(*kinds)
    places = carried.unionByName(placed).repartition("chunk").groupBy("chunk", "seq_no").agg(
        F.min(F.when(is_a("held", "row"), F.struct(is_a("row").alias("later"), "record_id", "again", "a", "b"))).alias("own"),
        F.collect_list(F.when(is_a("hit"), F.struct("record_id", "a", "b"))).alias("hits"),
        F.max(is_a("flush")).alias("flush"),
        F.max(~is_a("held")).alias("touched"),
    )
    chunks = places.groupBy("chunk").agg(F.collect_list(F.struct("seq_no", "own", "hits")).alias("places"), F.max("flush").alias("flush"), F.max("touched").alias("touched"))  # stride places at most
    known = told.where("n_gone > 0").groupBy("chunk").agg(F.max_by(F.struct("part", "n_gone", "gone"), "batch").alias("t"))
    full = chunks.join(known, "chunk", "left").select("chunk", "places", "flush", "touched", F.coalesce("t.part", F.lit(0)).alias("part"), F.coalesce("t.n_gone", F.lit(0)).alias("n_gone"), F.coalesce("t.gone", F.array().cast("array<long>")).alias("gone"))
    taken = lambda p: (F.col("n_gone") == stride) | F.array_contains("gone", p["seq_no"])
    full = full.select("*", F.filter("places", lambda p: p["own"].isNotNull() & ~taken(p)).alias("own"), F.filter("places", lambda p: taken(p) & (F.size(p["hits"]) > 0)).alias("past"))
    full = full.withColumn("n", F.size("own")).withColumn("shut", (F.col("n") > 0) & (F.col("flush") | (F.col("n") + F.col("n_gone") == stride)))
    full = full.withColumn("all_gone", F.col("n_gone") + F.when(F.col("shut"), F.col("n")).otherwise(0))

    def line(kind, part, record=None, seq=None, again=None, a=None, b=None, count=None, n_gone=None, gone=None):
        null = lambda x, t: F.lit(None).cast(t) if x is None else x.cast(t)
        sides = [(f"{c}_{k}", null(None if x is None else x[c], t)) for k, x in (("a", a), ("b", b)) for c, t in (("evalue", "double"), ("ident", "double"), ("target", "long"))]
        said = [("part", null(part, "int")), ("kind", null(kind, "string")), ("record_id", null(record, "string")), ("seq_no", null(seq, "long")), ("again", null(F.lit(False) if again is None else again, "boolean")), *sides]
        return F.struct(*(x.alias(n) for n, x in [*said, ("held", null(F.lit(0) if count is None else count, "long")), ("n_gone", null(n_gone, "int")), ("gone", null(gone, "array<long>"))]))

    def row(p):
        better = F.get(F.filter(p["hits"], lambda h: h["record_id"] == p["own"]["record_id"]), F.lit(0))
        side = {k: F.when(better.isNotNull(), better[k]).otherwise(p["own"][k]) for k in "ab"}
        return line(F.when(F.col("shut"), F.lit("row")).otherwise(F.lit("held")), F.col("part"), p["own"]["record_id"], p["seq_no"], p["own"]["again"], side["a"], side["b"])

    late = F.flatten(F.transform("past", lambda p: F.transform(p["hits"], lambda h: line(F.lit("late"), F.col("part"), h["record_id"], p["seq_no"], None, h["a"], h["b"]))))
    gone = F.when(F.col("all_gone") < stride, F.when(F.col("shut"), F.array_sort(F.concat("gone", F.transform("own", lambda p: p["seq_no"])))).otherwise(F.col("gone")))
    after = line(F.lit("open"), F.col("part") + F.col("shut").cast("int"), count=F.when(F.col("shut"), 0).otherwise(F.col("n")), n_gone=F.col("all_gone"), gone=gone)
    said = full.select("chunk", F.explode(F.concat(F.transform("own", row), late, F.filter(F.array(after), lambda _: F.col("touched")))).alias("x"))
    return said.select("chunk", "x.*").select([x.split()[0] for x in _STATE.split(", ")[:-1]])


def open_chunks(spark: SparkSession, out: str) -> DataFrame:
    """(chunk, held) of the chunks that hold rows."""
    told = spark.read.schema(f"{CLOSED}, batch long").parquet(f"{out}/closed").where("kind = 'open'")
    return told.groupBy("chunk").agg(F.max_by("held", "batch").alias("held")).where("held > 0")


def flush(spark: SparkSession, source: str, out: str, stride: int = 250, seed: int = 0) -> None:
    """Ask for the remainder: writes a mark for each open chunk to the source; the next run of ``triage`` takes them.

    Rows that come afterwards under numbers of a flushed chunk are its next part.
    """
    marks = open_chunks(spark, out).select(F.lit("flush").alias("kind"), F.lit(None).cast("string").alias("record_id"), (F.col("chunk") * stride + seed).alias("seq_no"))
    full = marks.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("evalue", "double"), ("ident", "double"), ("target", "long"), ("line", "long"))))
    full.coalesce(1).write.mode("append").parquet(source)


def totals(spark: SparkSession, out: str) -> DataFrame:
    """The rolling yield over all closed chunks so far."""
    chunks = spark.read.parquet(f"{out}/analysis").groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("n_pass").alias("n_pass"))
    return rolled_up(chunks)


def master(spark: SparkSession, out: str) -> DataFrame:
    """Every record of a closed chunk once, as it was gated."""
    return spark.read.parquet(f"{out}/rows").where(~F.col("again")).drop("again", "batch")


def backfilled(spark: SparkSession, out: str, gates: dict[str, str] | None = None, rank: list[str] | None = None, pilot: float | None = None) -> DataFrame:
    """The analysis records worked out anew from the stored rows of every batch."""
    return analysed(spark.read.parquet(f"{out}/rows"), gates or {}, rank or ["seq_no"], pilot)
