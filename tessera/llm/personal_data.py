"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field then labels every token with a digit or an at-sign: a potential for the
token's shape, a chain potential between tokens side by side, and a skip potential between repeated or similar
tokens anywhere in the document, by way of one hidden node for each thing that is mentioned, so evidence goes from any
mention to any other in two steps. Its potentials are fitted piece by piece: log ratios of label counts, taken over all
documents from the base spans and summed by grouped aggregation into tables of fixed size. Loopy message passing then
labels each document at once, until messages settle; tokens in base spans are observed. What it finds beyond them is
added; base spans stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
SHAPES = 1 << 15
#: Layout of the count table: shape x label, then chain label pairs, then skip pairs (differ, agree), then labels.
CHAIN, SKIP, PRIOR = SHAPES * LABELS, SHAPES * LABELS + LABELS * LABELS, SHAPES * LABELS + LABELS * LABELS + 2
CELLS = PRIOR + LABELS
#: Probability of a label from which on it counts, rounds of messages, the change at which they have settled, and edges at once.
CERTAIN, ROUNDS, SETTLED, CHUNK = 0.8, 100, 1e-4, 1 << 15

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")  # a later start in a run of digits does no better
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")  # words that hold one of these; tried once a word
_EDGE = ".,;:!?\"'<>[]{}|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        if m := _DOMAIN.match(text, at + 1):
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches that hold, by start and kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _shape(core: str) -> int:
    digits = re.sub(r"[^0-9]", "", core)
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 30)}", re.sub(r"[^\W\d_]+", "a", core))
    return zlib.crc32(f"{shape}|{len(digits)}|{12 <= len(digits) <= 19 and luhn(digits)}".encode("utf-8", "surrogatepass")) % SHAPES


def _key(core: str) -> str:
    """Tokens with the same key are taken for mentions of one thing."""
    if "@" in core:
        return core.split("@")[0].lower()
    digits = re.sub(r"[^0-9]", "", core)
    return digits if len(digits) >= 7 else ""


class Graph:
    """Tokens of a document, what base spans say of them, and their edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.tokens: list[tuple[int, int]] = []
        shapes, last = [], {}
        self.chain, self.skip, things = [], [], {}
        for m in _TOKEN.finditer(text):
            core = m[0].strip(_EDGE)
            if not core:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
            i = len(self.tokens)
            if i and m.start() - ended == 1:
                self.chain.append((i - 1, i))
            ended = m.end()
            self.tokens.append((start, start + len(core)))
            shapes.append(_shape(core))
            if key := _key(core):
                if key in last:
                    self.skip.append((last[key], i))
                    things.setdefault(key, [last[key]]).append(i)
                last[key] = i
        #: (hidden node, token), hidden nodes after the tokens: one for each thing that is mentioned twice at least.
        self.mentions = [(len(self.tokens) + h, i) for h, at in enumerate(things.values()) for i in at]
        self.hidden = len(things)
        self.shapes = np.array(shapes, np.int64)
        self.observed = np.zeros(len(self.tokens), np.int64)
        i = 0
        for start, kind, end in base:
            while i < len(self.tokens) and self.tokens[i][1] <= start:
                i += 1
            j = i
            while j < len(self.tokens) and self.tokens[j][0] < end:
                self.observed[j] = kind + 1
                j += 1

    def counts(self, into: np.ndarray) -> None:
        label = self.observed
        np.add.at(into, self.shapes * LABELS + label, 1)
        np.add.at(into, PRIOR + label, 1)
        for i, j in self.chain:
            into[CHAIN + label[i] * LABELS + label[j]] += 1
        for i, j in self.skip:
            if label[i] or label[j]:
                into[SKIP + (label[i] == label[j])] += 1


def _sums(unary: np.ndarray, target: np.ndarray, message: np.ndarray) -> np.ndarray:
    """Each node's own potential and what its neighbours say."""
    return np.stack([unary[:, k] + np.bincount(target, message[:, k], len(unary)) for k in range(LABELS)], axis=1)


class Field:
    """Log potentials from summed counts."""

    def __init__(self, counts: np.ndarray):
        shape = counts[:CHAIN].reshape(SHAPES, LABELS) + np.array([1.0, *[0.05] * len(KINDS)])
        self.shape = np.log(shape / shape.sum(1, keepdims=True))
        pair = counts[CHAIN:SKIP].reshape(LABELS, LABELS)
        expected = pair.sum(1, keepdims=True) * pair.sum(0, keepdims=True) / max(pair.sum(), 1)
        self.chain = np.log((pair + 2) / (expected + 2)).clip(-1, 2)  # pairs too rare to tell stay near 0
        differ, agree = counts[SKIP], counts[SKIP + 1]
        agreement = float(np.clip((agree + 1) / (differ + 1), 1, np.exp(6)))
        # over two steps, by a hidden node, two mentions weigh each other as counted
        strength = float(np.log(agreement + np.sqrt(agreement**2 + (LABELS - 2) * agreement - (LABELS - 1))))
        self.skip = strength * (2 * np.eye(LABELS) - 1) / 2

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product over the document's graph: label probabilities of each token, then of each hidden node."""
        unary = self.shape[g.shapes]
        unary = np.where((g.observed > 0)[:, None], np.where(np.arange(LABELS) == g.observed[:, None], 0.0, -60.0), unary)
        unary = np.concatenate([unary, np.zeros((g.hidden, LABELS))])
        edges = np.array([*g.chain, *g.mentions], np.int64).reshape(-1, 2)
        belief, m, chained = unary, len(edges), len(g.chain)
        if m:
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            message = np.zeros((2 * m, LABELS))
            for _ in range(ROUNDS):
                belief, change = _sums(unary, target, message), 0.0
                new = np.empty_like(message)
                for first, last, table in ((0, chained, self.chain), (chained, m, self.skip), (m, m + chained, self.chain.T), (m + chained, 2 * m, self.skip)):
                    for at in range(first, last, CHUNK):
                        of = slice(at, min(at + CHUNK, last))
                        back = (np.arange(of.start, of.stop) + m) % (2 * m)
                        got = np.logaddexp.reduce((belief[source[of]] - message[back])[:, :, None] + table, axis=1)
                        new[of] = 0.5 * message[of] + 0.5 * (got - got.max(1, keepdims=True))
                        change = max(change, float(np.abs(new[of] - message[of]).max()))
                message = new
                if change < SETTLED:
                    break
            belief = _sums(unary, target, message)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, g: Graph) -> list[tuple[int, int, int]]:
        """(start, kind, end) of what the field finds beyond the base spans."""
        if not len(g.tokens) or g.observed.all():
            return []
        p = self.marginals(g)[: len(g.tokens)]
        label = np.where(p.max(1) >= CERTAIN, p.argmax(1), 0) * (g.observed == 0)
        beside, out, i = {j for _, j in g.chain}, [], 0
        while i < len(label):
            j = i + 1
            if label[i] == 4:
                while j < len(label) and label[j] == 4 and j in beside:
                    j += 1
            if label[i]:
                start, end = g.tokens[i][0], g.tokens[j - 1][1]
                digits = len(re.sub(r"[^0-9]", "", text[start:end]))
                likely = {1: "@" in text[start:end], 2: text.count(".", start, end) == 3, 3: 12 <= digits <= 19, 4: 7 <= digits <= 15}
                if likely[int(label[i])]:
                    out.append((start, int(label[i]) - 1, end))
            i = j
        return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def trained(docs: DataFrame) -> np.ndarray:
    """Counts over all documents; CELLS numbers at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if text and ("@" in text or _DIGIT.search(text)):
                    Graph(text, base_spans(text)).counts(total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    counts = np.zeros(CELLS)
    for row in _texts(docs).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return counts


def _all_spans(text: str | None, field: Field) -> list[tuple[int, int, int, bool]]:
    if not text or ("@" not in text and not _DIGIT.search(text)):
        return []
    base = base_spans(text)
    return sorted([(*s, True) for s in base] + [(*s, False) for s in field.added(text, Graph(text, base))])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with spans an array of (kind, start, end, base), by start and kind, in code points, end exclusive.

    One row for each row of ``docs(doc_id, text)``, repeated ids included. Null, empty and clean texts have no span.
    An empty table gives no rows. Other columns are not looked at.
    """
    counts = docs.sparkSession.sparkContext.broadcast(trained(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(counts.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in _all_spans(t, field)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return _texts(docs).mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and the list of all spans, from ``spans``."""
    base = F.filter("spans", lambda s: s["base"])
    told = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    out, at = [], 0
    for start, kind, end, _ in found:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by the kind's name in angle brackets, and n_chars to match."""
    counts = docs.sparkSession.sparkContext.broadcast(trained(docs))
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(counts.value)
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            texts = [t and redact(t, _all_spans(t, field)) for t in columns["text"].to_pylist()]
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(clean, docs.schema)
