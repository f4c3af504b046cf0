"""Quality scores by random Fourier features.

Statistics of each whole text (words, repetition, case, signs, lines) are standardised and mapped to random Fourier
features, whose inner products approximate a Gaussian kernel. Normal equations, summed by tasks over all learnable
rows, give a ridge fit; its values are calibrated by isotonic regression over a fixed number of bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labels import held_out, learnable
from tessera.llm.text import raw
from tessera.staging import staged

FEATURES, WIDTH, RIDGE, BINS, SEED = 192, 1.5, 1.0, 400, 11

_UPPER, _LOWER, _DIGIT, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:"))
_SIGN = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{}~"))
_HIGH, _BLANK = np.arange(256) >= 128, np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text; all are finite, also for none or an empty one."""
    data = raw(text)
    ws, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, size = len(ws), len(data)
    if not n:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, ws), np.int64, n)
    letters = max(int(counts[_UPPER | _LOWER | _HIGH].sum()), 1)
    share = counts[counts > 0] / size
    kinds = {}
    for w in ws:
        kinds[w] = kinds.get(w, 0) + 1
    pairs = len(set(zip(ws, ws[1:], strict=False)))
    same = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        float(counts[_UPPER].sum() / letters),
        float(counts[_DIGIT].sum() / size),
        float(counts[_STOP].sum() / n),
        float(counts[_SIGN].sum() / n),
        float(counts[33] / n),
        float(counts[124] / n),
        float(counts[_HIGH].sum() / letters),
        len(kinds) / n**0.8,
        max(kinds.values()) / n,
        pairs / max(n - 1, 1),
        same / max(n - 1, 1),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float((lengths <= 3).mean()),
        float(-(share * np.log(share)).sum()),
        float(counts[_BLANK].sum() / size),
    ]


N_STATISTICS = 20


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x) of each row, x: its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "held_out", "x"])

    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


class Fourier:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(0, 1 / (WIDTH * np.sqrt(len(mean))), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def of(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)


def normal_equations(rows: DataFrame, fourier: Fourier) -> np.ndarray:
    """Sum of [z, y]' [z, y] over rows (x, label): by task, then by groups of tasks; at most 64 matrices reach the driver."""
    side = len(fourier.b) + 2

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((side, side))
        for pdf in frames:
            if len(pdf):
                z = np.concatenate([fourier.of(np.stack(pdf["x"])), pdf[["label"]].to_numpy(float)], axis=1)
                total += z.T @ z
        yield pd.DataFrame({"g": [TaskContext.get().partitionId() % 64], "m": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "m": [sum(np.frombuffer(m) for m in pdf["m"]).tobytes()]})

    sums = rows.select("x", "label").mapInPandas(part, "g int, m binary").groupBy("g").applyInPandas(add, "g int, m binary").collect()
    return sum((np.frombuffer(r["m"]) for r in sums), np.zeros(side * side)).reshape(side, side)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators: the pools' centres and values."""
    pools: list[list[float]] = []
    for x, y, w in zip(at, mean, weight, strict=True):
        pools.append([x * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs(doc_id, text)``.

    Learns ``quality`` of ``labels(doc_id, quality)`` from all learnable rows. Null, empty and wordless texts are a text
    of statistics 0. Without learnable labels every score is 0.5. One row for each row, repeated ids included; an empty
    table gives no rows. Other columns are not looked at.
    """
    table = staged(described(docs), "statistics")
    known = table.join(learnable(labels, "quality"), "doc_id")
    known = staged(known.select("x", "label"), "learnable")
    numbers = [f(F.col("x")[i]).alias(f"{k}{i}") for i in range(N_STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = known.agg(F.count("*").alias("n"), *numbers).first()
    if not row["n"]:
        return table.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    fourier = Fourier(*(np.array([row[f"{k}{i}"] for i in range(N_STATISTICS)]) for k in "ms"))
    m = normal_equations(known, fourier)
    side = len(m) - 1
    weights = np.linalg.solve(m[:side, :side] + RIDGE * np.diag([*[1.0] * (side - 1), 1e-6]), m[:side, side])

    def ridge(x: pd.Series) -> np.ndarray:
        return fourier.of(np.stack(x)) @ weights if len(x) else np.zeros(0)

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            f = ridge(pdf["x"])
            yield pd.DataFrame({"bin": np.clip((f + 0.5) / 2 * BINS, 0, BINS - 1).astype(int), "f": f, "label": pdf["label"]})

    bins = known.mapInPandas(binned, "bin int, f double, label int").groupBy("bin").agg(F.avg("f").alias("f"), F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    centres, values = isotonic(bins["f"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = ridge(pd.Series(batch.column(2).to_pylist()))
            s = 0.98 * np.interp(f, centres, values) + 0.02 / (1 + np.exp(-np.clip(4 * f - 2, -50, 50)))  # the second keeps ties apart
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    return table.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
