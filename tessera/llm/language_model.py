"""Language-model scoring with a hashed maximum-entropy model.

``P(w | h) = P(group | h) * P(class | group, h) * P(place | class, h)``: a softmax over classes, in two steps, and one over
the places of a class. A place holds one of the most frequent words; place 0 stands for all other words of the class, each
of which has its add-``alpha`` share among them. Classes are runs of words in the order of their reversed letters, so words
that end alike, frequent or not, share a class.

``h`` is the words before. Features are the word before (bigram), the one before that (skip) and both (trigram) at the
first step, and the word before together with the group or class at the others. Each is hashed to a row of weights, one
weight for each outcome of the softmax, and adds to the outcomes' log shares in the corpus. Training passes once over all
training tokens: in each of ``ROUNDS`` rounds, tasks make gradient updates over minibatches of their own share of the
corpus; the mean of what they changed, weighted by how often each row was used, is where the next round starts. Texts are
staged as arrays of numbers, and scored in batches of tokens that gather the rows of their features.

What grows with the corpus is a shuffled table: the count of every word. The weights have a fixed size at any corpus.
"""

from __future__ import annotations

import math
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import CACHE, CACHE_BYTES
from tessera.staging import staged

#: Outcomes of each softmax; groups * groups classes, and places of a class besides place 0.
SIDE = 32
CLASSES, PLACES = SIDE * SIDE, SIDE - 1
HEAD_WORDS = CLASSES * PLACES
#: Rows of weights at each step: (bigram, skip, trigram), (bigram with group), (bigram with class). In the last two each group
#: or class has a run of rows of its own.
ROWS = ((16384, 4096, 16384), (16384,), (65536,))
TABLES = [(step, k, n) for step in range(3) for k, n in enumerate(ROWS[step])]
END = b""
ALPHA = 0.1
#: Words whose counts reach every task.
HEAD = 1 << 17
#: Bytes of texts whose words a task looks up at once.
TOGETHER = 1 << 22
#: Rounds, rate and minibatch of the training, rows told at once, and tokens of a training task.
ROUNDS, RATE, BATCH, BLOCK, SHARE = 4, 0.8, 8192, 256, 4_000_000
_K = np.uint32(0x9E3779B1)


def _tokens(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Runs of ``TOGETHER`` bytes of texts, or one longer text: different tokens, the place there of each token, where each text ends.

    White space and A-Z are those of ``text.words``; each text has its end as its last token.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        till = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right")))
        closed = pc.binary_join_element_wise(pc.fill_null(texts.slice(at, till - at), ""), " ", "")  # what stands after the blank is empty, as END is
        each = pc.ascii_split_whitespace(pc.ascii_lower(closed))
        ends, coded = np.cumsum(pc.list_value_length(each).to_numpy()), each.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        kept = index != index[-1]
        kept[ends - 1] = True  # white space at a text's beginning leaves an empty word, which is none
        yield coded.dictionary.cast(pa.binary()), index[kept], np.cumsum(kept)[ends - 1]
        at = till


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def counted(docs: DataFrame) -> DataFrame:
    """Partial counts (word, n) of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            for known, index, _ in _tokens(batch.column(0)):
                held.append(pa.table({"word": known, "n": np.bincount(index, minlength=len(known))}))
                rows, size = rows + len(known), size + known.nbytes
                if rows > CACHE or size > CACHE_BYTES:
                    held = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                    rows, size = held[0].num_rows, held[0].nbytes
                    if rows > CACHE // 2 or size > CACHE_BYTES // 2:
                        yield from held[0].to_batches()
                        held, rows, size = [], 0, 0
        if held:
            yield from pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

    return docs.where(~_held_out()).select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long")


@dataclass
class Lexicon:
    """The frequent words' places, and the class of any word."""

    starts: list[bytes]  # reversed first word of each class
    place: dict[bytes, int]  # frequent word -> class * PLACES + place - 1

    @staticmethod
    def of(head: list[bytes]) -> Lexicon:
        order = sorted(x[::-1] for x in head)
        per = -(-len(order) // CLASSES) or 1
        runs = [order[i : i + per] for i in range(0, len(order), per)]
        place = {w[::-1]: c * PLACES + i for c, run in enumerate(runs) for i, w in enumerate(run)}
        return Lexicon([run[0] for run in runs], place)

    def of_class(self, word: bytes) -> int:
        return max(bisect_right(self.starts, word[::-1]) - 1, 0)

    def codes(self, ws: list[bytes]) -> list[int]:
        """Each word as one number: its place, or its class and a hash."""
        at = map(self.place.get, ws)
        return [HEAD_WORDS + max(bisect_right(self.starts, w[::-1]) - 1, 0) + CLASSES * (zlib.crc32(w) & 0xFFFFF) if x is None else x for w, x in zip(ws, at, strict=True)]

    def code(self, word: bytes) -> int:
        return self.codes([word])[0]


def outcomes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code, then what each of the three steps gives."""
    own = codes < HEAD_WORDS
    k = np.where(own, codes // PLACES, (codes - HEAD_WORDS) % CLASSES)
    return k, k // SIDE, k % SIDE, np.where(own, codes % PLACES + 1, 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _K
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


@dataclass
class Tokens:
    """Of each token and for each step: the rows of its features, and the outcome."""

    rows: list[list[np.ndarray]]
    out: list[np.ndarray]

    def cut(self, of: slice) -> Tokens:
        return Tokens([[x[of] for x in step] for step in self.rows], [x[of] for x in self.out])


class Runs:
    """Tokens in the order of their rows: the rows met, where their runs begin, and how long they are."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(rows.astype(np.uint16), kind="stable")
        own = rows.take(self.order)
        self.first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        self.rows, self.times = own.take(self.first), np.diff(self.first, append=len(own))

    def inverse(self) -> np.ndarray:
        """Which of the rows met each token has."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.rows)), self.times)
        return out


def features(codes: np.ndarray, starts: np.ndarray, end: int) -> Tokens:
    """Texts begin at ``starts``; the end stands before them."""
    before, skipped = np.full(len(codes), end, np.int32), np.full(len(codes), end, np.int32)
    before[1:], skipped[2:] = codes[:-1], codes[:-2]
    before[starts] = skipped[starts] = end
    skipped[starts[:-1] + 1] = end
    skipped[min(starts[-1] + 1, len(codes) - 1)] = end
    one, two = _mixed(before.view(np.uint32)), _mixed(skipped.view(np.uint32) ^ np.uint32(0x5BD1E995))
    k, *out = outcomes(codes)
    rows = [[(h % np.uint32(n)).astype(np.int64) for h, n in zip((one, two, _mixed(one + two * np.uint32(3))), ROWS[0], strict=True)]]
    for given, step, kinds in ((out[0], 1, SIDE), (k, 2, CLASSES)):
        run = ROWS[step][0] // kinds
        rows.append([given * run + (_mixed(one ^ given.astype(np.uint32) * _K) % np.uint32(run))])
    return Tokens(rows, out)


class Weights:
    """Rows of weights by step, with the sum of squared gradients of each row; and what tells outcomes without features."""

    def __init__(self, priors: list[np.ndarray]):
        self.priors = priors
        self.tables = [[np.zeros((n, SIDE), np.float32) for n in of] for of in ROWS]
        self.sums = [[np.ones(n, np.float32) for n in of] for of in ROWS]

    def softmax(self, s: int, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities of step ``s``: the rows of weights, added to the prior."""
        z = self.tables[s][0].take(rows[0], axis=0)
        for t, r in zip(self.tables[s][1:], rows[1:], strict=True):
            z += t.take(r, axis=0)
        z += self.priors[s] if len(self.priors[s]) == 1 else self.priors[s].take(rows[0] // (ROWS[s][0] // len(self.priors[s])), axis=0)
        np.exp(np.minimum(z, 80, out=z), out=z)
        z *= (1 / (z @ np.ones(SIDE, np.float32)))[:, None]
        return z

    def step(self, x: Tokens, used: list[list[np.ndarray]], rate: float) -> None:
        """One gradient update from a minibatch."""
        for s in range(3):
            if len(ROWS[s]) == 1:  # tokens of one row have the same probabilities: once for each row is enough
                runs = Runs(x.rows[s][0])
                p = self.softmax(s, [runs.rows])
                seen = np.bincount(runs.inverse() * SIDE + x.out[s], minlength=p.size).reshape(p.shape)
                self._move(s, 0, runs, (p * runs.times[:, None] - seen).astype(np.float32), used, rate)
                continue
            d = self.softmax(s, x.rows[s])
            d[np.arange(len(d)), x.out[s]] -= 1
            for k, r in enumerate(x.rows[s]):
                runs = Runs(r)
                pairs = d.take(runs.order, axis=0).view(np.complex64)  # two outcomes are added at once
                self._move(s, k, runs, np.add.reduceat(pairs, runs.first, axis=0).view(np.float32), used, rate)

    def _move(self, s: int, k: int, runs: Runs, gradient: np.ndarray, used: list[list[np.ndarray]], rate: float) -> None:
        used[s][k][runs.rows] += runs.times
        size = self.sums[s][k][runs.rows] + np.einsum("ij,ij->i", gradient, gradient)
        self.sums[s][k][runs.rows] = size
        self.tables[s][k][runs.rows] -= gradient * (rate / np.sqrt(size))[:, None]

    def log10(self, x: Tokens) -> np.ndarray:
        """log10 probability of each token's class and place."""
        total = np.zeros(len(x.out[0]))
        for s in range(3):
            if len(ROWS[s]) == 1:
                runs = Runs(x.rows[s][0])
                p, at = self.softmax(s, [runs.rows]), runs.inverse()
            else:
                p, at = self.softmax(s, x.rows[s]), np.arange(len(total))
            total += np.log10(np.maximum(p.ravel().take(at * SIDE + x.out[s]), 1e-30), dtype=np.float64)
        return total


def priors(places: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """Log shares of outcomes by step, from the counts of places (0 where there is none) and of the other words of each class."""
    n = np.concatenate([rest[:, None] + 0.5, places], axis=1)
    n[:, 1:][places == 0] = 1e-38
    k = n.sum(axis=1).reshape(SIDE, SIDE)
    parts = [k.sum(axis=1)[None, :], k, n]
    return [np.maximum(np.log(x / x.sum(axis=1, keepdims=True)), -80).astype(np.float32) for x in parts]


def _batched(texts: Iterator[np.ndarray], end: int) -> Iterator[Tokens]:
    """At most ``BATCH`` tokens at a time, in order, from the codes of one text after the other."""

    def cut(held: list[np.ndarray]) -> Iterator[Tokens]:
        whole = features(np.concatenate(held), np.cumsum([0, *(len(x) for x in held[:-1])]), end)
        for at in range(0, len(whole.out[0]), BATCH):
            yield whole.cut(slice(at, at + BATCH))

    held, n = [], 0
    for codes in texts:
        held.append(codes)
        n += len(codes)
        if n >= 16 * BATCH:
            yield from cut(held)
            held, n = [], 0
    if held:
        yield from cut(held)


def train(texts: DataFrame, start: list[np.ndarray], end: int, rounds: int = ROUNDS, rate: float = RATE) -> Weights:
    """One pass over all ``texts(share, codes, n_tokens)``; share: the round in which a text takes part."""
    weights, context = Weights(start), texts.sparkSession.sparkContext
    sizes = {r["share"]: r["n"] for r in texts.groupBy("share").agg(F.sum("n_tokens").alias("n")).collect()}
    for turn in range(rounds):
        now = context.broadcast((weights.tables, weights.sums))

        def local(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own = Weights(start)
            own.tables, own.sums = ([[x.copy() for x in of] for of in part] for part in now.value)
            used = [[np.zeros(len(t), np.float32) for t in tables] for tables in own.tables]
            streams = (np.frombuffer(x, np.int32) for batch in batches for x in batch.column(0).to_pylist())
            for x in _batched(streams, end):
                own.step(x, used, rate)
            told = []
            for i, (s, k, n) in enumerate(TABLES):
                for at in range(0, n, BLOCK):
                    cut, times = slice(at, at + BLOCK), used[s][k][at : at + BLOCK]
                    if times.any():
                        moved = (own.tables[s][k][cut] - now.value[0][s][k][cut]).astype(np.float16)
                        told.append((i, at, times.tobytes(), moved.tobytes(), (own.sums[s][k][cut] - now.value[1][s][k][cut]).tobytes()))
            if told:
                names, kinds = ["part", "first", "used", "moved", "sums"], [pa.int32(), pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), kinds, strict=True)], names=names)

        def weighed(pdf: pd.DataFrame) -> pd.DataFrame:
            moved = [np.frombuffer(m, np.float16).astype(np.float32).reshape(-1, SIDE) * np.frombuffer(n, np.float32)[:, None] for m, n in zip(pdf["moved"], pdf["used"], strict=True)]
            return added(pdf.assign(moved=[m.tobytes() for m in moved]))

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            total = {c: sum(np.frombuffer(x, np.float32) for x in pdf[c]).astype(np.float32).tobytes() for c in ("used", "moved", "sums")}
            return pdf[["part", "first", "salt"]].iloc[:1].assign(**total)

        schema = "part int, first int, salt int, used binary, moved binary, sums binary"
        # tasks of enough tokens to be worth the weights they tell; first by a salt, so that no task gets a block from all others
        tasks = max(1, -(-sizes.get(turn, 0) // SHARE))
        mine = texts.where(F.col("share") == turn).select("codes").coalesce(tasks)
        each = mine.mapInArrow(local, "part int, first int, used binary, moved binary, sums binary")
        salted = each.withColumn("salt", (F.spark_partition_id() % int(tasks**0.5)).cast("int")).select("part", "first", "salt", "used", "moved", "sums")
        few = salted.groupBy("part", "first", "salt").applyInPandas(weighed, schema).groupBy("part", "first").applyInPandas(added, schema)
        for r in few.toLocalIterator():  # the weights, whose size is fixed
            s, k, _ = TABLES[r["part"]]
            used, moved, sums = (np.frombuffer(r[c], np.float32) for c in ("used", "moved", "sums"))
            cut = slice(r["first"], r["first"] + len(used))
            weights.tables[s][k][cut] += moved.reshape(-1, SIDE) / np.maximum(used, 1)[:, None]
            weights.sums[s][k][cut] += sums
        now.unpersist()
    return weights


def _other_words(vocabulary: DataFrame, lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and kinds of the words without a place, by class."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        known = lexicon.value
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in known.place:
                    k = known.of_class(word)
                    n[k] += c
                    kinds[k] += 1
        at = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(kinds[at])], names=["k", "n", "kinds"])

    n, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in vocabulary.select("word", "c").mapInArrow(tell, "k int, n long, kinds long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        n[r["k"]], kinds[r["k"]] = r["n"], r["kinds"]
    return n, kinds


class Known(dict):
    """Running numbers of the words a task has met, and what it has to know of each, as arrays by that number."""

    def __init__(self, frequent: dict[bytes, int], lexicon: Lexicon, of_class: np.ndarray, alpha: float):
        super().__init__()
        self.frequent, self.lexicon, self.of_class, self.alpha = frequent, lexicon, of_class, alpha
        self.seen: list[bytes] = []
        self.size = 0
        self.code, self.count, self.log, self.rest = array("i"), array("q"), array("d"), array("d")

    @property
    def full(self) -> bool:
        return len(self.seen) > CACHE or self.size > CACHE_BYTES

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        """Running numbers of different words; new ones are taken up all at once."""
        at = list(map(self.get, ws))
        new = [w for w, n in zip(ws, at, strict=True) if n is None]
        if new:
            after = iter(range(len(self.seen), len(self.seen) + len(new)))
            at = [next(after) if n is None else n for n in at]
            self._take_up(new)
        return np.array(at, np.int64)

    def _take_up(self, new: list[bytes]) -> None:
        self.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
        self.seen += new
        self.size += sum(map(len, new))
        code, log, rest = np.array(self.lexicon.codes(new), np.int32), np.zeros(len(new)), np.zeros(len(new))
        count = np.fromiter(map(self.frequent.get, new, repeat(0)), np.int64, len(new))
        told, other = np.flatnonzero((count > 0) | (code < HEAD_WORDS)), np.flatnonzero(code >= HEAD_WORDS)
        log[told] = [math.log10(c + self.alpha) for c in count[told].tolist()]
        rest[other] = log[other] - self.of_class[(code[other] - HEAD_WORDS) % CLASSES]
        for known, more in ((self.code, code), (self.count, count), (self.log, log), (self.rest, rest)):
            known.frombytes(more.tobytes())

    def told(self, tokens: pa.Array, index: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """Of each text (n_tokens, n_known, words_part, rest_part, codes, rare, times): rare words, whose counts are elsewhere."""
        at = self.numbers(tokens.to_pylist()).take(index)
        code, count, log, rest = (np.frombuffer(x, t).take(at) for x, t in ((self.code, np.int32), (self.count, np.int64), (self.log, float), (self.rest, float)))
        odd = np.flatnonzero((count == 0) & (code >= HEAD_WORDS))
        pairs, times = np.unique(np.searchsorted(ends, odd, "right") << 32 | at[odd], return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(len(ends) + 1) << 32).tolist()
        rare, times = [self.seen[i] for i in (pairs & 0xFFFFFFFF).tolist()], times.tolist()
        first = 0
        for i, end in enumerate(ends.tolist()):
            own, odd = slice(first, end), slice(cuts[i], cuts[i + 1])
            yield end - first, int(np.count_nonzero(count[own])), float(log[own].sum()), float(rest[own].sum()), code[own].tobytes(), rare[odd], times[odd]
            first = end


def scores(docs: DataFrame, head: int = HEAD, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """log10 probability of each whole text of ``docs(doc_id, text)``, by add-``alpha`` unigrams and by the model.

    Learns from the rows whose crc32(doc_id as text) mod 10 is not 0. Gives doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score: one row for each row, repeated ids included. A null or empty text is the end
    token alone; a null id counts as training. With no training rows N and V are 0 and every token is unknown.
    Words of one count are taken for frequent in the order of their bytes. An empty table gives no rows. Other columns
    are not looked at.
    """
    context = docs.sparkSession.sparkContext
    vocabulary = staged(staged(counted(docs), "partial-counts").groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    counts = {bytes(r["word"]): r["c"] for r in vocabulary.orderBy(F.desc("c"), "word").limit(head).collect()}
    lexicon = Lexicon.of(list(dict.fromkeys([END, *counts]))[:HEAD_WORDS])
    whole = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(whole["n"] or 0), int(whole["v"])
    shared = context.broadcast(lexicon)
    others, kinds = _other_words(vocabulary, shared)
    places = np.zeros((CLASSES, PLACES))
    for word, at in lexicon.place.items():
        places[at // PLACES, at % PLACES] = counts.get(word, 0) + alpha
    share_of = np.log10(others + alpha * (kinds + 1))
    frequent = context.broadcast(counts)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row, known = part << 40, Known(frequent.value, shared.value, share_of, alpha)
        for batch in batches:
            out: list[tuple] = []
            docs, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for told in _tokens(batch.column(2)):
                if known.full:
                    known = Known(frequent.value, shared.value, share_of, alpha)
                for one in known.told(*told):
                    out.append((part % rounds, row, docs[len(out)], held[len(out)], *one))
                    row += 1
            if out:
                types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
                names = ["share", "row", "doc_id", "held_out", "n_tokens", "n_known", "words_part", "rest_part", "codes", "rare", "times"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", _held_out().alias("held_out"), "text")
    schema = "share int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, words_part double, rest_part double, codes binary, rare array<binary>, times array<long>"
    told = staged(ready.mapInArrow(tell, schema), "texts")
    end = lexicon.place[END]
    model = context.broadcast(train(told.where("not held_out"), priors(places, others), end, rounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            codes = [np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist()]
            logs = [weights.log10(x) for x in _batched(iter(codes), end)]
            at = np.cumsum([0, *map(len, codes)])
            sums = np.add.reduceat(np.concatenate(logs), at[:-1]) if codes else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sums)], names=[*batch.schema.names[1:], "path_part"])

    kept = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, words_part double, rest_part double"
    names = [x.split()[0] for x in kept.split(", ")]
    scored = told.select("codes", *names).mapInArrow(score, f"{kept}, path_part double")
    rare = told.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    least = min(counts.values()) if len(counts) >= head else 0
    met = rare.join(vocabulary.where(F.col("c") <= least), "word", "left").select(
        "row",
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(alpha))).alias("words_part"),
    )
    met = met.groupBy("row").agg(F.sum("n_known").alias("more_known"), F.sum("words_part").alias("more_words"))
    more = F.coalesce("more_words", F.lit(0.0))
    return scored.join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("words_part") + more - F.col("n_tokens") * float(np.log10(n + alpha * (v + 1)))).alias("base_score"),
        (F.col("path_part") + F.col("rest_part") + more).alias("score"),
    )
