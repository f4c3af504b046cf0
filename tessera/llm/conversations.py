"""Repair of conversations by the cheapest edits, with the edits as an audit.

Each row of a conversation is a symbol: the class of its role and its fault. Equal neighbouring symbols are one run. What
a row can do to the state of the repaired turns (nothing yet, after system, after user, after assistant) is a 4 x 4
matrix over (cost, edits) with least as sum and addition as product; a run's matrix is put together from cached binary
powers. Going backwards over the runs gives the cost of the rest from each state; going forwards the choices are
unrolled. As no list of edits of a run is the beginning of another one, the least list of each run gives the least
audit.

Rows are sorted by conversation over the whole cluster, so a conversation may lie in several parts of the table. One
inside a part is repaired there. Of the first and the last one of each part the rows are kept; their pieces tell
matrices of costs, at most two a part, from which each piece's rest and then each piece's entry follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import attached
from tessera.llm.rows import may_be
from tessera.staging import staged

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bytes of rows in a part, greatest cached power, rows of an output batch, and the longest piece of a text in it.
PART_BYTES, GREATEST, BATCH, PIECE = 1 << 25, 14, 1024, 1 << 14
_NEXT = (2, 2, 3, 2)  # the state after the only turn that an edit can put there
_ENDS = (0, 2 * INSERT, INSERT, 0)
_FINISH = ("", "II", "I", "")
_ROLE = {2: "user", 3: "assistant"}
#: State before and after keeping a row of each class.
_KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}

Entry = tuple[int, str]
Matrix = tuple[dict[int, Entry], ...]


def _less(into: dict[int, Entry], state: int, entry: Entry) -> None:
    if state not in into or entry < into[state]:
        into[state] = entry


@lru_cache(None)
def power(symbol: str, k: int) -> Matrix:
    """The matrix of 2**k rows of one symbol: 's', 'u', 'a', 'o' (other), in capitals if truncated, or 'x', to be deleted."""
    if k:
        half = power(symbol, k - 1)
        return tuple(_times(row, half) for row in half)
    extra = TRUNCATED if symbol.isupper() else 0
    rows = []
    for start in range(4):
        out: dict[int, Entry] = {}
        state = start
        for inserted in range(3):
            cost, edits = INSERT * inserted, "I" * inserted
            _less(out, state, (cost + DELETE, edits + "D"))
            if symbol != "x":
                _less(out, _NEXT[state], (cost + REROLE + extra, edits + "R"))
                if state in _KEEPS[symbol.lower()]:
                    _less(out, _KEEPS[symbol.lower()][state], (cost + extra, edits + "K"))
            state = _NEXT[state]
        rows.append(out)
    return tuple(rows)


def _times(row: dict[int, Entry], m: Matrix) -> dict[int, Entry]:
    out: dict[int, Entry] = {}
    for state, (cost, edits) in row.items():
        for to, (more, then) in m[state].items():
            total = cost + more
            if to not in out or total < out[to][0] or (total == out[to][0] and edits + then < out[to][1]):
                out[to] = (total, edits + then)
    return out


def powers(symbol: str, n: int) -> Iterator[Matrix]:
    """Cached powers whose product is the matrix of n rows; from 2**GREATEST on the greatest comes several times."""
    for _ in range(n >> GREATEST):
        yield power(symbol, GREATEST)
    for k in range(GREATEST):
        if n >> k & 1:
            yield power(symbol, k)


@lru_cache(4096)
def _short(symbol: str, n: int, state: int) -> dict[int, Entry]:
    return _forward(symbol, n, state)


def _forward(symbol: str, n: int, state: int) -> dict[int, Entry]:
    row = {state: (0, "")}
    for m in powers(symbol, n):
        row = _times(row, m)
    return row


def rests(runs: list[tuple[str, int]], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost of all that follows, from each state, before the first run, ..., after the last one."""
    out, now = [end], end
    for symbol, n in reversed(runs):
        for m in powers(symbol, n):
            now = tuple(min(cost + now[to] for to, (cost, _) in row.items()) for row in m)
        out.append(now)
    return out[::-1]


def unrolled(runs: list[tuple[str, int]], rest: list[tuple[int, ...]], state: int) -> tuple[list[str], int]:
    """The least cheapest edits of each run, from a state, and the state that they end in."""
    edits = []
    for (symbol, n), after in zip(runs, rest[1:], strict=True):
        row = _short(symbol, n, state) if n <= 64 else _forward(symbol, n, state)
        _, text, state = min((cost + after[to], text, to) for to, (cost, text) in row.items())
        edits.append(text)
    return edits, state


def costs(runs: list[tuple[str, int]]) -> list[tuple[int, ...]]:
    """Costs from each state (rows) to each state, or a number above all costs where there is no way."""
    none = 1 << 50
    columns = [rests(runs, tuple(0 if i == j else none for i in range(4)))[0] for j in range(4)]
    return [tuple(min(columns[j][i], none) for j in range(4)) for i in range(4)]


class Piece:
    """Neighbouring rows of one conversation: (role, text, symbol, n, turn, fault); ``n`` equal rows lie side by side."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.runs: list[list] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.n = self.distinct = 0
        self.turns: list[int] = []  # first (least) and last (greatest)
        self.first = self.last = ""

    def add(self, turn: int | None, role: str, text: str, symbol: str, n: int, fault: str) -> None:
        first = role[:1]
        if self.n:
            self.counts["illegal"] += (self.last + first) not in ("su", "ua", "au")
        else:
            self.first = first
        self.counts["illegal"] += n - 1  # a role beside itself
        self.last, self.n = first, self.n + n
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn]
                self.distinct = 1
            elif turn != self.turns[1]:
                self.turns[1] = turn
                self.distinct += 1
        if fault:
            self.counts[fault] += 1
        if n > 1:
            self.counts["blank" if fault == "blank" else "duplicate"] += n - 1
        self.rows.append((role, None if symbol == "x" else text, symbol, n))
        for s, many in ((symbol, 1), ("x", n - 1)):
            if many and self.runs and self.runs[-1][0] == s:
                self.runs[-1][1] += many
            elif many:
                self.runs.append([s, many])

    def summary(self) -> list[int | None]:
        first, last = self.turns or (None, None)
        return [self.n, first, last, self.distinct, *self.counts.values(), *(c for row in costs(self.runs) for c in row)]


def repaired_rows(rows: list[tuple], edits: str, state: int, finish: str) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each edit in order; what is deleted has no role. Rows as in ``Piece.rows``."""
    at = 0

    def inserts() -> Iterator[tuple[str, str, str]]:
        nonlocal at, state
        while edits[at] == "I":
            at, state = at + 1, _NEXT[state]
            yield "I", _ROLE[state], ""

    for role, text, symbol, n in rows:
        for copy in range(n):
            yield from inserts()
            edit, at = edits[at], at + 1
            if edit == "K":
                state = _KEEPS[symbol.lower()][state]
                yield "K", role, text
            elif edit == "R":
                state = _NEXT[state]
                yield "R", _ROLE[state], text
            else:
                yield "D", None, None
            assert copy == 0 or edit == "D"
    for _ in finish:
        state = _NEXT[state]
        yield "I", _ROLE[state], ""


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the contract's damage; ``n``: how often the row stands there, 0 where it is dropped. Nulls count as one space."""
    space = F.lit(" ")
    text, role = (F.coalesce(F.col(c).cast("string"), space) for c in ("text", "role"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    way = F.crc32(key.cast("binary")) % 20
    # nothing but its conversation is kept of a row that is dropped
    return conversations.select(
        "conv_id",
        F.when(way != 0, F.col("turn").cast("long")).alias("turn"),
        F.when(way == 4, F.lit("user")).when(way != 0, role).alias("role"),
        F.when(way == 1, F.lit("")).when(way == 2, F.translate(text, ".!?", "")).when(way != 0, text).alias("text"),
        F.when(way == 0, 0).when(way == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _faulty(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n), equal ones as one, with their fault and symbol.

    A row is a duplicate where its conversation has its role and text at an earlier turn; equal rows of one turn lie side
    by side, and all but the first are duplicates. First turns are aggregates, and come back by a join that bears hot
    keys.
    """
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    mark = [x for c in ("conv_id", "role", "text") for x in (F.col(c).isNull(), F.col(c))]
    key = F.struct(F.xxhash64(F.lit(0), *mark).alias("a"), F.xxhash64(F.lit(1), *mark).alias("b"), F.lit(0).alias("c"))
    once = staged(once.withColumn("key", key), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    first = once.where("n > 0").groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("many")).where("many > 1")
    apart = F.struct(F.xxhash64("key", "turn").alias("a"), F.xxhash64("turn", "key").alias("b"), F.lit(1).alias("c"))
    first = staged(first, "first-turns")
    # rows whose role and text stand there once are not shuffled for this
    asked = may_be(once, "key", first, first.count())
    alone = asked.where(~F.col("_may")).drop("_may").withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    marked = alone.unionByName(attached(asked.where("_may").drop("_may"), first, "key", apart, once.count()))
    body = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(F.col("n") == 0, "gone")
        .when(body == "", "blank")
        .when(F.coalesce(F.col("first") < order, F.lit(False)), "duplicate")
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    kind = F.coalesce(F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)), F.lit("o"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    return marked.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "n", "fault", symbol.alias("symbol"))


_LAID = "kind string, part int, seq long, numbers array<long>, a string, b string, c string"


def _batches(rows: Iterator[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    types = [id_type, pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.string()]
    names = ["conv_id", "kind", "part", "seq", "numbers", "a", "b", "c"]
    held: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row[5:] if x)
        if len(held) >= BATCH or size >= BATCH * PIECE:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows with equal first columns, as one pass over them."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _whole(piece: Piece) -> tuple[list[int], str]:
    """Cost and audit of a conversation that lies in one piece."""
    runs = [tuple(r) for r in piece.runs]
    rest = rests(runs, _ENDS)
    edits, state = unrolled(runs, rest, 0)
    first, last = piece.turns or (0, 0)
    gaps = last - first + 1 - piece.distinct if piece.turns else 0
    return [gaps, *piece.counts.values(), rest[0][0]], "".join(edits) + _FINISH[state]


def _lines(conv: object, part: int, seq: int, turns: Iterator[tuple[str, str | None, str | None]]) -> Iterator[tuple]:
    for edit, role, text in turns:
        yield conv, "line", part, seq, None, edit, role, text
        seq += 1


def _sha(turns: Iterator[tuple[str, str | None, str | None]]) -> str:
    digest, between = hashlib.sha256(), b""
    for _, role, text in turns:
        if role is not None:
            digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            between = b"\n"
    return digest.hexdigest()


def _first_pass(digest: bool, id_type: pa.DataType) -> Callable:
    """Over rows in order: conversations inside the part are done; of its first and last one, matrices and rows go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def done(conv: object, piece: Piece, at: int) -> Iterator[tuple]:
            numbers, audit = _whole(piece)
            turns = repaired_rows(piece.rows, audit, 0, audit[len(audit.rstrip("I")) :])
            if digest:
                yield conv, "whole", part, at, numbers, audit, _sha(turns), None
            else:
                yield from _lines(conv, part, at, turns)

        def kept(conv: object, piece: Piece, at: int) -> Iterator[tuple]:
            yield conv, "piece", part, at, piece.summary(), piece.first, piece.last, None
            for i, (role, text, symbol, n) in enumerate(piece.rows):
                yield conv, "row", part, at + i, [n], role, text, symbol

        def results() -> Iterator[tuple]:
            before, at = None, 0
            for i, ((conv,), rows) in enumerate(_groups(batches, 1)):
                if before is not None:
                    yield from (kept if i == 1 else done)(*before)
                piece = Piece()
                for _, turn, role, text, n, fault, symbol in rows:
                    if fault != "gone":
                        piece.add(turn, role, text, symbol, n, fault)
                before, at = (conv, piece, at), at + 4 * piece.n + 4
            if before is not None:
                yield from kept(*before)

        yield from _batches(results(), id_type)

    return run


class Route:
    """What the driver tells a piece: the rest's cost after it, the state it starts in, and whether it is the last one."""

    def __init__(self, end: tuple[int, ...], last: bool):
        self.end, self.last, self.state = end, last, 0


def _routes(pieces: list) -> tuple[dict, dict]:
    """Routes by (conv_id, part) and totals by conv_id; pieces: (conv_id, part, numbers, first, last), at most two a part."""
    convs: dict = {}
    for p in sorted(pieces, key=lambda p: p["part"]):
        convs.setdefault(p["conv_id"], []).append(p)
    routes, totals = {}, {}
    for conv, own in convs.items():
        end, after = _ENDS, True
        for p in reversed(own):
            routes[conv, p["part"]] = Route(end, after)
            m, after = p["numbers"][8:], False
            end = tuple(min(m[4 * i + j] + end[j] for j in range(4)) for i in range(4))
        counts = [sum(p["numbers"][4 + k] for p in own) for k in range(4)]
        some = [p for p in own if p["numbers"][0]]
        counts[3] += sum((p["b"] + q["a"]) not in ("su", "ua", "au") for p, q in zip(some, some[1:], strict=False))
        told = [p["numbers"][1:4] for p in own if p["numbers"][1] is not None]
        both = sum(a[1] == b[0] for a, b in zip(told, told[1:], strict=False))
        gaps = told[-1][1] - told[0][0] + 1 - (sum(t[2] for t in told) - both) if told else 0
        totals[conv] = [gaps, *counts, end[0]]
    return routes, totals


def _runs_of(rows: list[tuple]) -> list[tuple[str, int]]:
    piece: list[list] = []
    for _, _, symbol, n in rows:
        for s, many in ((symbol, 1), ("x", n - 1)):
            if many and piece and piece[-1][0] == s:
                piece[-1][1] += many
            elif many:
                piece.append([s, many])
    return [tuple(r) for r in piece]


def _repaired(rows: DataFrame, digest: bool) -> DataFrame:
    """(conv_id, kind, part, seq, numbers, a, b, c): kind 'whole' with the digest, or 'line' for each edit, for all conversations."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType
    id_type = to_arrow_type(kind)
    shape = f"conv_id {kind.simpleString()}, {_LAID}"
    faulty = staged(_faulty(rows), "faults")
    volume = int(faulty.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0)
    parts = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-volume // (1 << 18))), -(-volume // PART_BYTES))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    ranged = faulty.repartitionByRange(parts, *order, F.substring("text", 1, 32).asc_nulls_first())
    ranged = ranged.sortWithinPartitions(*order, F.col("text").asc_nulls_first()).select("conv_id", "turn", "role", "text", "n", "fault", "symbol")
    laid = staged(ranged.mapInArrow(_first_pass(digest, id_type), shape), "pieces")

    pieces = laid.where("kind = 'piece'").select("conv_id", "part", "numbers", "a", "b").collect()
    routes, totals = _routes(pieces)
    edge = laid.where("kind = 'row'").select("conv_id", "part", "seq", "numbers", "a", "b", "c")
    edge = edge.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each piece the state after it, from each state before it."""
        out = []
        for (conv, part), rows in _groups(batches, 2):
            runs = _runs_of([(r[4], None, r[6], r[3][0]) for r in rows])
            rest = rests(runs, routes[conv, part].end)
            out.append((conv, part, [unrolled(runs, rest, s)[1] for s in range(4)]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (id_type, pa.int32(), pa.list_(pa.int64())), strict=True)], names=["conv_id", "part", "ends"])

    if len(pieces) > len(totals):  # some conversation has several: entries depend on the least edits before them
        exits = {(r["conv_id"], r["part"]): r["ends"] for r in edge.mapInArrow(ends, f"conv_id {kind.simpleString()}, part int, ends array<long>").collect()}
        now: dict = {}
        for conv, part in sorted(routes, key=lambda k: k[1]):
            routes[conv, part].state = now.get(conv, 0)
            if (conv, part) in exits:
                now[conv] = exits[conv, part][routes[conv, part].state]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for (conv, part), rows in _groups(batches, 2):
                held = [(r[4], r[5], r[6], r[3][0], r[2]) for r in rows]
                route, plain, at = routes[conv, part], [h[:4] for h in held], held[0][4]
                runs = _runs_of(plain)
                edits, state = unrolled(runs, rests(runs, route.end), route.state)
                finish = _FINISH[state] if route.last else ""
                yield from _lines(conv, part, at, repaired_rows(plain, "".join(edits), route.state, finish))

        yield from _batches(results(), id_type)

    lines = edge.mapInArrow(emit, shape)
    if not digest:
        return laid.where("kind = 'line'").unionByName(lines)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One conversation's lines in order: SHA-256 takes them one by one, and only the edits are gathered."""

        def results() -> Iterator[tuple]:
            for (conv,), rows in _groups(batches, 1):
                audit: list[str] = []

                def turns(rows: Iterator[tuple] = rows, audit: list[str] = audit) -> Iterator[tuple]:
                    for r in rows:
                        if r[3] is not None:
                            audit.append(r[3])
                            yield r[3], r[4], r[5]

                sha = _sha(turns())
                yield conv, "whole", 0, 0, totals[conv], "".join(audit), sha, None

        yield from _batches(results(), id_type)

    # a conversation without rows has no lines: its piece stands for it
    marks = laid.where("kind = 'piece'").select("conv_id", "part", F.lit(-1).cast("long").alias("seq"), *(F.lit(None).cast("string").alias(c) for c in "abc"))
    ordered = lines.select("conv_id", "part", "seq", "a", "b", "c").unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return laid.where("kind = 'whole'").unionByName(ordered.mapInArrow(hashed, shape))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, seq, edit, role, text): each edit of each conversation in the order of (part, seq), and the turn it leaves.

    Edits: K keeps, R gives another role, I inserts an empty turn, D deletes (role and text are null). Rows of
    ``conversations(conv_id, turn, role, text)`` are taken by turn (null first), role and text. Nulls in role and text count
    as one space, a null conv_id is a conversation. Other columns are not looked at; an empty table gives none.
    """
    space = F.lit(" ")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("n"))
    return _repaired(rows, False).select("conv_id", "part", "seq", F.col("a").alias("edit"), F.col("b").alias("role"), F.col("c").alias("text"))


def audited(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conv_id.

    ``rows``: (conv_id, turn, role, text, n) as ``damaged`` gives them; n: how often a row stands there, side by side; 0: not at
    all, but its conversation stays. Rows of one turn go by role and then by text. A conversation without rows has
    zeros, no edits, and the hash of an empty string. An empty table gives no rows.

    The digest of a conversation that lies in several parts is taken by one task, line by line, as SHA-256 is a chain.
    """
    out = _repaired(rows, True)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.col("numbers")[i].alias(n) for i, n in enumerate(names)), F.col("a").alias("audit"), F.col("b").alias("repaired_sha256"))


def _sql() -> str:
    """The same in SQL, row by row: each state carries its least (cost, edits) and the repaired lines."""

    def edit(x: str, cost: str, letter: str, line: str | None) -> str:
        lines = f"concat_ws(chr(10), {x}.t, {line})" if line else f"{x}.t"
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || {letter}, 't': {lines}}}"

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    kept = [edit(f"w{i}", "4", "'D'", None) for i in range(4)]
    user, assistant = (
        lambda x, r=r, name=name: edit(x, f"(CASE WHEN must THEN 1000000 ELSE 0 END + CASE WHEN initial = '{r}' THEN 0 ELSE 3 END + extra)", f"CASE WHEN initial = '{r}' THEN 'K' ELSE 'R' END", f"CASE WHEN initial = '{r}' THEN role ELSE '{name}' END || ':' || text")
        for r, name in (("u", "user"), ("a", "assistant"))
    )
    system = edit("w0", "(CASE WHEN must OR initial <> 's' THEN 1000000 ELSE extra END)", "'K'", "role || ':' || text")
    insert = {2: "'user:'", 3: "'assistant:'"}

    def after(v: str) -> tuple[str, str]:
        w2 = least(f"{v}.v2", *(edit(f"{v}.v{i}", "3", "'I'", insert[2]) for i in (0, 1, 3)))
        return w2, least(f"{v}.v3", edit("w2", "3", "'I'", insert[3]))

    w2, w3 = after("x")
    none = "{'c': 1000000, 'a': '', 't': CAST(NULL AS VARCHAR)}"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), ways AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 AS way FROM keyed, tab
), d AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy
  FROM ways WHERE way <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, {blanks}) AS body, substr(role, 1, 1) AS initial FROM d
), f AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM o
), m AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM f
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'v0': {{'c': 0, 'a': '', 't': CAST(NULL AS VARCHAR)}}, 'v1': {none}, 'v2': {none}, 'v3': {none}}} AS v FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, {{'v0': {kept[0]}, 'v1': {least(kept[1], system)}, 'v2': {least(kept[2], user("w0"), user("w1"), user("w3"))}, 'v3': {least(kept[3], assistant("w2"))}}}
  FROM (SELECT *, x.v0 AS w0, x.v1 AS w1, {w3} AS w3 FROM (SELECT *, {w2} AS w2 FROM (SELECT m.*, dp.v AS x FROM dp JOIN m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.n = dp.n + 1)))
), last AS (
  SELECT conv_id, max_by(v, n) AS x FROM dp GROUP BY conv_id
), done AS (
  SELECT conv_id, {least("x.v0", w3)} AS e FROM (SELECT conv_id, x, {w2} AS w2 FROM last)
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM f GROUP BY conv_id
)
SELECT done.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(e.c AS BIGINT) AS cost, e.a AS audit, sha256(coalesce(e.t, '')) AS repaired_sha256
FROM done LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM done.conv_id
"""


SQL = _sql()
