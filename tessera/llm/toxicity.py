"""Toxicity by a convolutional classifier over hashed word embeddings.

A word is the sum of two hashed embeddings: of the word, and of its first four letters. Filters of several widths run
over the whole text, each keeps its maximum, and a linear layer gives a logit. It is trained in numpy on a bounded
sample of labelled rows; scores of every text are calibrated by language, on labelled rows the training didn't see.
The language is what the text's own most common words show, never the table's: one of those listed below, or none of
them; texts of all other languages share one calibration.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labels import held_out, learnable
from tessera.llm.text import CACHE, CACHE_BYTES, raw
from tessera.staging import staged

WORDS, STARTS, SIZE, WIDTHS, FILTERS = 1 << 15, 1 << 14, 6, (1, 2, 3), 4
#: Labelled rows of each class that training and calibration may take, and bytes of their texts in all.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 27
TAPS = sum(WIDTHS) * FILTERS
STEP = 500  # texts whose distinct words meet the filters at once

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
# The commonest function words of some languages.
_COMMON = {
    "en": "the of and to in is that it for was".split(),
    "fr": "le la les et des du que un une dans".split(),
    "de": "der die das und den ist von nicht ein mit".split(),
    "es": "el los las y que del una por con para".split(),
}
LANGUAGES = ("", *_COMMON)
_LANGUAGE = {}
for _i, _name in enumerate(LANGUAGES[1:], 1):
    for _w in _COMMON[_name]:
        _LANGUAGE[_w.encode()] = 0 if _w.encode() in _LANGUAGE else _i


def split(text: str | None) -> list[bytes]:
    return _LETTERS.findall(raw(text).lower())


class Numbers(dict):
    """Running numbers of words, with the buckets and the language of each."""

    def __init__(self):
        super().__init__()
        self.word, self.start, self.language, self.size = [], [], [], 0

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self.word)
        self.size += len(w)
        self.word.append(zlib.crc32(w) % WORDS)
        self.start.append(zlib.crc32(w.decode("utf-8", "ignore")[:4].encode(), 7) % STARTS)
        self.language.append(_LANGUAGE.get(w, 0))
        return n

    def of(self, text: str | None) -> np.ndarray:
        ws = split(text)
        return np.fromiter(map(self.__getitem__, ws), np.int32, len(ws))


@dataclass
class Model:
    word: np.ndarray
    start: np.ndarray
    taps: np.ndarray  # SIZE x TAPS: for each width, for each place in it, FILTERS columns
    bias: np.ndarray
    out: np.ndarray
    base: float = 0.0
    scale: dict[int, tuple[float, float]] = field(default_factory=dict)

    def responses(self, n: Numbers, used: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What each of the numbered words used adds at each tap."""
        w, s = np.array(n.word, np.int64)[used], np.array(n.start, np.int64)[used]
        return ((self.word[w] + self.start[s]) @ self.taps).astype(np.float32)

    def pooled(self, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over a text's positions (0 at least), and where it is; taps: one row for each word."""
        top, where, at = np.zeros(len(WIDTHS) * FILTERS), np.full(len(WIDTHS) * FILTERS, -1), 0
        for k, width in enumerate(WIDTHS):
            n = len(taps) - width + 1
            if n > 0:
                total = taps[:n, at : at + FILTERS].copy()
                for j in range(1, width):
                    total += taps[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                cut = slice(k * FILTERS, (k + 1) * FILTERS)
                best = total.argmax(axis=0)
                value = total[best, np.arange(FILTERS)] + self.bias[cut]
                top[cut] = np.maximum(value, 0)
                where[cut] = np.where(value > 0, best, -1)
            at += width * FILTERS
        return top, where

    def logit(self, top: np.ndarray) -> float:
        return float(top @ self.out + self.base)

    def calibrated(self, logit: float, language: int) -> float:
        a, b = self.scale.get(language) or self.scale.get(-1) or (1.0, 0.0)
        return float(1 / (1 + np.exp(-np.clip(a * logit + b, -50, 50))))


def language(kinds: np.ndarray) -> int:
    counts = np.bincount(kinds, minlength=len(LANGUAGES))
    counts[0] = 0
    return int(counts.argmax()) if counts.any() else 0


def _platt(z: np.ndarray, y: np.ndarray, a: float, b: float, pull: float) -> tuple[float, float]:
    """Slope (positive) and offset of a logistic fit, pulled towards (a, b)."""
    at = np.array([a, b])
    x = np.stack([z, np.ones_like(z)], axis=1)
    to = at.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (p - y) + pull * (at - to)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + pull * np.eye(2)
        at = at - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        at[0] = max(at[0], 1e-2)
    return float(at[0]), float(at[1])


def fit(texts: list[str | None], labels: list[int], epochs: int = 3, rate: float = 0.05, seed: int = 1) -> Model:
    """Train on four fifths of the texts, calibrate on the rest."""
    rng, y = np.random.default_rng(seed), np.array(labels, float)
    n = Numbers()
    tokens = [n.of(t) for t in texts]
    word, start, kinds = (np.array(x, np.int64) for x in (n.word, n.start, n.language))
    train = np.array([i % 5 != 0 for i in range(len(y))], bool)
    model = Model(np.zeros((WORDS, SIZE)), np.zeros((STARTS, SIZE)), rng.normal(0, 0.15, (SIZE, TAPS)), np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.05, len(WIDTHS) * FILTERS))
    if not train.any() or len(set(labels)) < 2:
        model.base = -4.0 if not y.any() else 4.0
        return model
    # The first coordinate of an embedding starts as the shrunk log odds of its bucket, others at random.
    for table, buckets in ((model.word, word), (model.start, start)):
        table[:, 1:] = rng.normal(0, 0.1, (len(table), SIZE - 1))
        seen = np.zeros((2, len(table)))
        for i in np.flatnonzero(train):
            seen[int(y[i]), np.unique(buckets[tokens[i]])] += 1
        share = np.array([[max((y[train] == c).sum(), 1)] for c in (0, 1)])
        odds = np.log((seen[1] + 4 * share[1] / share.sum() * 2) / share[1]) - np.log((seen[0] + 4 * share[0] / share.sum() * 2) / share[0])
        table[:, 0] = np.clip(odds, -3, 5) / 2
    model.taps[0, ::FILTERS] += 1
    model.out[::FILTERS] += 1
    model.base = -2.0
    parts = [model.word, model.start, model.taps, model.bias, model.out]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    base_moments, step = [0.0, 0.0], 0
    weight = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-3), 0.5 / max(1 - y[train].mean(), 1e-3))
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(train))
        for at in range(0, len(order), 64):
            batch, step = order[at : at + 64], step + 1
            grads, g_base = [np.zeros_like(p) for p in parts[2:]], 0.0
            touched: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in batch:
                ids = tokens[i]
                embedded = model.word[word[ids]] + model.start[start[ids]]
                top, where = model.pooled(embedded @ model.taps)
                p = 1 / (1 + np.exp(-np.clip(model.logit(top), -30, 30)))
                d = (p - y[i]) * weight[i] / len(batch)
                grads[2] += d * top
                g_base += d
                column = 0
                for k, width in enumerate(WIDTHS):
                    for f in range(FILTERS):
                        j = k * FILTERS + f
                        if where[j] >= 0:
                            grads[1][j] += d * model.out[j]
                            columns = column + f + np.arange(width) * FILTERS
                            places = where[j] + np.arange(width)
                            grads[0][:, columns] += d * model.out[j] * embedded[places].T
                            touched.append((word[ids[places]], start[ids[places]], d * model.out[j] * model.taps[:, columns].T))
                    column += width * FILTERS
            sparse = []
            for t, table in enumerate(parts[:2]):
                if touched:
                    rows = np.concatenate([x[t] for x in touched])
                    g = np.zeros((len(unique := np.unique(rows)), SIZE))
                    np.add.at(g, np.searchsorted(unique, rows), np.concatenate([x[2] for x in touched]))
                    sparse.append((t, unique, g))
            for t, rows, g in [*sparse, *((k + 2, slice(None), g) for k, g in enumerate(grads))]:
                first[t][rows] = 0.9 * first[t][rows] + 0.1 * g
                second[t][rows] = 0.99 * second[t][rows] + 0.01 * g * g
                parts[t][rows] -= (rate if t > 1 else rate / 2) / (1 + step / 200) * (first[t][rows] / (1 - 0.9**step)) / (np.sqrt(second[t][rows] / (1 - 0.99**step)) + 1e-4) * 0.2
            base_moments = [0.9 * base_moments[0] + 0.1 * g_base, 0.99 * base_moments[1] + 0.01 * g_base**2]
            model.base -= rate * 0.2 * base_moments[0] / (1 - 0.9**step) / (np.sqrt(base_moments[1] / (1 - 0.99**step)) + 1e-4)
    rest = np.flatnonzero(~train)
    taps = model.responses(n)
    z = np.array([model.logit(model.pooled(taps[tokens[i]])[0]) for i in rest])
    spoken = np.array([language(kinds[tokens[i]]) for i in rest])
    model.scale[-1] = _platt(z, y[rest], 1.0, 0.0, 0.5)
    for c in range(len(LANGUAGES)):
        own = spoken == c
        if own.sum() >= 20 and 0 < y[rest][own].sum() < own.sum():
            model.scale[c] = _platt(z[own], y[rest][own], *model.scale[-1], 2.0)
    return model


def sampled(docs: DataFrame, labels: DataFrame, column: str, most: int = SAMPLE, size: int = SAMPLE_BYTES) -> tuple[list[str | None], list[int]]:
    """Whole texts and labels of at most ``most`` learnable rows of each class, by a hash of the id; they reach the driver.

    Of a repeated id the least text counts. Rows are taken in turn as long as their texts have ``size`` bytes in all.
    """
    known = learnable(labels, column).withColumn("by", F.xxhash64("doc_id"))
    picked = None
    for c in (0, 1):
        few = known.where(F.col("label") == c).orderBy("by", "doc_id").limit(most)
        picked = few if picked is None else picked.unionByName(few)
    picked = staged(picked, "picked")  # 2 * most ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = staged(rows.groupBy("doc_id", "by", "label").agg(F.min("text").alias("text")), "picked-texts")
    lengths = rows.select("by", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy("by", "doc_id").collect()
    total, last = 0, None
    for r in lengths:
        total += r["bytes"]
        if total > size and last is not None:
            break
        last = r
    if last is None:
        return [], []
    first = (F.col("by") < last["by"]) | ((F.col("by") == last["by"]) & (F.col("doc_id") <= last["doc_id"]))
    taken = sorted(rows.where(first).collect(), key=lambda r: (r["by"], r["doc_id"]))
    return [r["text"] for r in taken], [r["label"] for r in taken]


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs(doc_id, text)``.

    Learns ``toxic`` of ``labels(doc_id, toxic)`` from learnable rows only. Null, empty and wordless texts get the
    score of a text without any toxic sign. With labels of one class or none every score leans to that class (none: 0).
    One row for each row, repeated ids included; an empty table gives no rows. Other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*sampled(docs, labels, "toxic", most)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = model.value, Numbers()
        for batch in batches:
            out: list[float] = []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), STEP):
                if len(n) > CACHE // 2 or n.size > CACHE_BYTES:
                    n = Numbers()
                tokens = [n.of(t) for t in texts[at : at + STEP]]
                used = np.unique(np.concatenate(tokens))
                taps, kinds = m.responses(n, used), np.array(n.language, np.int64)[used]
                for ids in tokens:
                    own = np.searchsorted(used, ids)
                    out.append(m.calibrated(m.logit(m.pooled(taps[own])[0]), language(kinds[own])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of = of.select("doc_id", "text", held_out().alias("held_out"))
    return of.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
