"""Best-fit packing with Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. Only their lengths decide how they pack,
and a length is one of ``capacity`` values, so the plan is made on the histogram of lengths: a table
of at most ``capacity`` rows at any corpus size. On it

1. *dominance reduction*: for the longest remaining length, if no set of one to three pieces can fill
   its sequence better than a given small set, that set is fixed for good, for as many sequences as
   there are pieces of those lengths at once;
2. *best fit, longest first* packs what is left, again many like pieces in one step.

The plan is a list of intervals "pieces of length L with rank a..b go to sequences s.., from offset o"
and is applied to all pieces where they lie. Ranks within a length come from per-task counts and a
prefix sum over tasks, so a length that holds a third of all pieces is never gathered anywhere.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import staged

CAPACITY = 4096
END_ID = 1
#: Characters of a part of a text up to which a task keeps its ids.
LONGEST = 64
#: Parts of texts in each of the two generations that a worker keeps, between tasks too: some 25 MB a generation.
KEPT = 1 << 17

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"

# Latin letters whose lower case and canonical composition are one code point and which the tokenizer's own
# pattern keeps together, and a run of signs (no apostrophe); anything else goes through the tokenizer whole.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _visible_bytes() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class TokenIds(dict):
    """Little-endian 32-bit ids of a blank-free part of a text, by the tokenizer, kept for two generations.

    The tokenizer cuts at white space before anything else, so a text's ids are those of its parts.
    """

    def __init__(self, path: str, keep: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.bpe, self.keep, self.old = self.tokenizer.model.tokenize, keep, {}
        self.shown = _visible_bytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)  # only short parts are kept, so bytes are bounded with entries
        if ids is None:
            m = _PLAIN.fullmatch(part)
            if not m:
                ids = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
            elif m[2]:
                ids = self[m[1]] + self[m[2]]
            else:
                seen = part if part.isascii() else "".join([self.shown[b] for b in part.encode()])
                ids = array("I", [t.id for t in self.bpe(seen)]).tobytes()
        if len(part) <= LONGEST:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            text.encode("latin-1")
            text = text.lower()  # on these code points just what the tokenizer's normaliser does
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_tokenizers: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _tokenizers:
        _tokenizers[path] = TokenIds(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document, with their place among the pieces of that length in their task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task = token_ids(tokenizer), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids.of(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Bins:
    """Groups of like sequences: what is left in each, and how many there are."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.intervals: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, first sequence, per sequence, offset, count
        self.used: dict[int, int] = {}
        self.open: dict[int, list[tuple[int, int]]] = {}  # what is left -> runs of sequences (first, how many)
        self.rooms: list[int] = []

    def put(self, length: int, first: int, n: int, each: int) -> None:
        """``n`` pieces of a length, ``each`` in a sequence, into sequences from ``first``, all with equal room."""
        offset, rank = self.capacity - self.room, self.used.get(length, 0)
        self.intervals.append((length, rank, first, each, offset, n))
        self.used[length] = rank + n

    def new(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def give(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, n))

    def take(self, room: int) -> tuple[int, int]:
        run = self.open[room].pop()
        if not self.open[room]:
            del self.open[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return run

    def fill(self, first: int, sets: list[int], n: int) -> None:
        """The same set of lengths into each of ``n`` sequences from ``first``."""
        self.room = self.capacity
        for length in sets:
            self.put(length, first, n, 1)
            self.room -= length
        self.give(self.room, first, n)


def reduce_by_dominance(left: np.ndarray, bins: Bins) -> int:
    """Fix sets that dominate every other set holding a piece of length w; gives how many sequences it fixed.

    A set dominates another if the other's pieces fit in the places of its own. With room r beside w and the
    longest fitting single k, over all remaining lengths:

    * nothing fits in r: {w};
    * k fills r, or no two fit in r: {w, k};
    * no three fit in r, and k is at least the fullest fitting pair: {w, k};
    * no three fit in r, and the longest b beside w and k is at least the shorter half of any pair: {w, k, b}.

    The longest lengths come first; where none holds, the length is left to best fit.
    """
    capacity, fixed = bins.capacity, 0
    lengths = [int(x) for x in np.flatnonzero(left)]

    def longest(most: int, *taken: int) -> int:
        """The longest remaining length up to ``most`` beside those taken; 0: none."""
        for j in range(bisect_left(lengths, most + 1) - 1, -1, -1):
            if left[lengths[j]] > taken.count(lengths[j]):
                return lengths[j]
        return 0

    i = len(lengths) - 1
    while i >= 0:
        w = lengths[i]
        room, small = capacity - w, []
        if not left[w]:
            i -= 1
            continue
        for x in lengths:
            small += [x] * min(3 - len(small), int(left[x]) - (x == w))
            if len(small) == 3:
                break
        k = longest(room, w)
        three, two = len(small) == 3 and sum(small) <= room, len(small) >= 2 and small[0] + small[1] <= room
        sets: list[int] = []
        if not k:
            sets = [w]
        elif k == room or not two:
            sets = [w, k]
        elif not three:
            best, x = 0, k
            while x and 2 * x >= best:  # x: the longer half of a pair
                y = longest(min(x, room - x), w, x)
                best = max(best, x + y if y else 0)
                x = longest(x - 1, w)
            b = longest(room - k, w, k)
            if k >= best:
                sets = [w, k]
            elif b and b >= longest(room // 2, w):
                sets = [w, k, b]
        if not sets:
            i -= 1
            continue
        many = min(int(left[x]) // sets.count(x) for x in set(sets))
        bins.fill(bins.new(many), sets, many)
        for x in sets:
            left[x] -= many
        fixed += many
    return fixed


def best_fit(left: np.ndarray, bins: Bins) -> None:
    """Each remaining piece, longest first, into the sequence with the least sufficient room."""
    for w in [int(x) for x in np.flatnonzero(left)[::-1]]:
        n = int(left[w])
        while n:
            at = bisect_left(bins.rooms, w)
            if at == len(bins.rooms):
                each = bins.capacity // w
                many = -(-n // each)
                bins.give(bins.capacity, bins.new(many), many)
                continue
            room = bins.rooms[at]
            first, m = bins.take(room)
            bins.room = room
            each = min(room // w, n)
            many = min(m, n // each)
            bins.put(w, first, many * each, each)
            bins.give(room - each * w, first, many)
            bins.give(room, first + many, m - many)
            n -= many * each
        left[w] = 0


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Intervals (length, first rank, first sequence, per sequence, offset, count) and the number of sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    bins = Bins(capacity)
    reduce_by_dominance(left, bins)
    best_fit(left, bins)
    table = np.array(sorted(bins.intervals), np.int64).reshape(-1, 6)
    return table, bins.sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Place every document of ``docs(doc_id, text)`` in sequences of at most ``capacity`` tokens.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come; ties between
    equal lengths go by where rows lie. An empty table gives no rows. Other columns are not looked at.
    """
    table = staged(pieces(docs, tokenizer, capacity, end_id), "pieces")
    per_task = table.groupBy("task", "length").agg((F.max("local_rank") + 1).alias("n"))
    # At most `capacity` rows come to the driver, whatever the corpus.
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    intervals, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = table.join(offsets.select("task", "length", "before"), ["task", "length"])
    shared = docs.sparkSession.sparkContext.broadcast(intervals)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        key = rows[:, 0] * (1 << 42) + rows[:, 1]
        for batch in batches:
            t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = t["length"].to_numpy(), t["local_rank"].to_numpy() + t["before"].to_numpy()
            row = rows[np.searchsorted(key, length * (1 << 42) + rank, "right") - 1] if len(rank) else rows[:0]
            at = rank - row[:, 1]
            t["sequence_id"] = pa.array(row[:, 2] + at // row[:, 3])
            t["offset"] = pa.array(row[:, 4] + at % row[:, 3] * length)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([t[n] for n in names], names=names)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
