"""Quality rules learned as a decision list.

Every whole text is described by counts of its words, signs, lines and repeats. From labelled rows, sequential covering
learns rules one after another: a rule grows by the threshold on one statistic that gains most information about bad
rows not yet covered, is pruned from its end on rows that it did not grow on, and is kept if on those it is right often
enough; the rows it covers are then taken away. The list becomes one Spark conditional expression, tried in order, that
decides on all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labels import learnable
from tessera.llm.text import raw
from tessera.staging import staged

#: Labelled rows of each label that rules are learned from, by the least hash of their id and statistics.
SAMPLE = 20_000
#: Rules, conditions of a rule, thresholds tried of a statistic, and what a rule must show on rows it did not grow on.
RULES, CONDITIONS, THRESHOLDS, LEAST_PRECISION, LEAST_COVERED = 12, 4, 64, 0.9, 5
LEAST_WORDS, MOST_REPEATED = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_kinds", "n_lines", "n_upper", "n_lower", "n_digits", "n_stops", "n_marks", "n_high", "n_longest", "n_pairs", "n_commonest")
_SYMBOLS, _UPPER, _LOWER, _DIGITS, _STOPS, _MARKS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?", b"!"
_SETS = [np.isin(np.arange(256), list(x)) for x in (_SYMBOLS, _UPPER, _LOWER, _DIGITS, _STOPS, _MARKS)]
_BLANK, _HIGH, _LEADS = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r")), np.arange(256) >= 128, (np.arange(256) & 0xC0) != 0x80


def counted(text: str | None) -> list[int]:
    """The numbers named in COUNTS and _MORE, of the whole text; 0 for none."""
    data = raw(text)
    ws = data.split()
    n = len(ws)
    if not n:
        return [0] * (len(COUNTS) + len(_MORE))
    letters = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    symbols, upper, lower, digits, stops, marks = (int(letters[s].sum()) for s in _SETS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    kinds: dict[bytes, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in ws), np.int64, n)
    pairs = np.unique(ids[:-1] * len(kinds) + ids[1:], return_inverse=True)
    repeated = 0
    if n > 3:
        triples = pairs[1][:-1] * len(kinds) + ids[2:]
        _, kind, many = np.unique(triples, return_inverse=True, return_counts=True)
        at = many[kind] > 1
        inside = np.zeros(n, bool)
        for i in range(3):
            inside[i : n - 2 + i] |= at
        repeated = int(inside.sum())
    longest = max(map(len, ws))
    own = [n, int(letters[_LEADS & ~_BLANK].sum()), symbols, len(lines) - len(set(lines)), repeated]
    return [*own, len(kinds), len(lines), upper, lower, digits, stops, marks, int(letters[_HIGH].sum()), longest, len(pairs[0]), int(np.bincount(ids).max())]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, _MORE) of each row."""
    names = [*COUNTS, *_MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([counted(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, i]) for i in range(len(names)))], names=["doc_id", *names])

    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def statistics() -> dict[str, Column]:
    """What rules are about: sizes, and shares of words, letters or lines; never null."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    cased = F.col("n_upper") + F.col("n_lower")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeated": share("n_repeat_words", "n_words"),
        "kinds": F.coalesce(F.col("n_kinds") / F.nullif(F.pow(F.col("n_words").cast("double"), F.lit(0.8)), F.lit(0.0)), F.lit(0.0)),
        "line_words": share("n_words", "n_lines"),
        "upper": F.coalesce(F.col("n_upper") / F.nullif(cased, F.lit(0)), F.lit(0.0)),
        "letters": F.coalesce((cased + F.col("n_high")) / F.nullif(F.col("word_chars"), F.lit(0)), F.lit(0.0)),
        "digits": share("n_digits", "word_chars"),
        "stops": share("n_stops", "n_words"),
        "marks": share("n_marks", "n_words"),
        "longest": F.col("n_longest").cast("double"),
        "pairs": share("n_pairs", "n_words"),
        "commonest": share("n_commonest", "n_words"),
    }


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    bound: float

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.bound if self.above else x[self.name] <= self.bound

    def column(self) -> Column:
        return F.col(self.name) > F.lit(self.bound) if self.above else F.col(self.name) <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.bound:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.of(x) for c in self.conditions])

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def thresholds(x: np.ndarray) -> np.ndarray:
    """Middles between neighbouring quantiles that differ, ascending."""
    if not len(x):
        return np.zeros(0)
    at = np.unique(np.quantile(x, np.linspace(0, 1, THRESHOLDS + 1), method="nearest"))
    return (at[:-1] + at[1:]) / 2


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of greatest gain: covered bad rows times the growth of the log of their share."""
    best: tuple[float, Condition | None] = (1e-9, None)
    before = math.log2(max(bad.mean(), 1e-12))
    for name in x:
        bounds = thresholds(x[name])
        if not len(bounds):
            continue
        place = np.searchsorted(bounds, x[name])  # a row is at most bounds[i] where place <= i
        low = np.stack([np.bincount(place[m], minlength=len(bounds) + 1).cumsum() for m in (bad, ~bad)])
        for above, (p, n) in ((False, low[:, :-1]), (True, (low[:, -1:] - low)[:, :-1])):
            gain = p * (np.log2(np.maximum(p, 1e-12) / np.maximum(p + n, 1)) - before)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Condition(name, above, float(bounds[i])))
    return best


def _grown(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Conditions added one by one until the rule covers no good row, or none gains."""
    rule: list[Condition] = []
    rows = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and bad[rows].any() and not bad[rows].all():
        _, condition = _best_condition({k: v[rows] for k, v in x.items()}, bad[rows])
        if condition is None:
            break
        rule.append(condition)
        rows &= condition.of(x)
    return rule


def _pruned(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Condition], int, int]:
    """The beginning of the rule with the best (bad - good) / (bad + good), the shortest of equals, and its bad and good rows."""
    best: tuple[float, int, int, int] = (-2.0, 0, 0, 0)
    rows = np.ones(len(bad), bool)
    for k, condition in enumerate(rule):
        rows = rows & condition.of(x)
        p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, k + 1, p, n)
    return rule[: best[1]], best[2], best[3]


def covered(x: dict[str, np.ndarray], bad: np.ndarray, grows: np.ndarray) -> list[Rule]:
    """A decision list that tells bad rows. ``grows``: the rows that rules grow on; they are pruned and judged on the others."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < RULES:
        own, other = left & grows, left & ~grows
        if not (bad[own].any() and (~bad[own]).any()):
            break
        grown = _grown({k: v[own] for k, v in x.items()}, bad[own])
        if not grown:
            break
        rule, p, n = _pruned(grown, {k: v[other] for k, v in x.items()}, bad[other])
        if p < LEAST_COVERED or p < LEAST_PRECISION * (p + n):
            break
        rules.append(Rule(tuple(rule)))
        left &= ~rules[-1].of(x)
    return rules


def learned(known: DataFrame) -> list[Rule]:
    """Rules from ``known`` (statistics and ``label``, 0: bad): from at most SAMPLE rows of each label, which reach the driver."""
    names = list(statistics())
    hashed = known.select(*names, "label", F.xxhash64("doc_id", *names).alias("h"), F.xxhash64("doc_id", F.lit(1)).alias("g"))
    parts = [hashed.where(F.col("label") == k).orderBy("h", "g").limit(SAMPLE).toPandas() for k in (0, 1)]
    x = {n: np.concatenate([p[n].to_numpy(float) for p in parts]) for n in names}
    bad = np.concatenate([p["label"].to_numpy() == 0 for p in parts])
    grows = np.concatenate([p["g"].to_numpy("<i8") % 3 != 0 for p in parts])
    return covered(x, bad, grows)


def decided(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, or 0: one conditional expression, tried in order."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].column(), F.lit(i)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, rule) of each row of ``docs(doc_id, text)``; rule: what drops it, null if nothing or the base does.

    Learns from ``quality`` of ``labels(doc_id, quality)``, from rows whose crc32(doc_id as text) mod 3 is not 1; labels,
    language and source are never inputs. Null and empty texts have no words and fail the base. Without labels of both
    kinds there are no rules, and the base alone decides. One row for each row, repeated ids included; an empty table
    gives none. Other columns are not looked at.
    """
    table = staged(described(docs).select("doc_id", *COUNTS, base_failed().alias("base_failed"), *(c.alias(n) for n, c in statistics().items())), "rule_statistics")
    known = table.where("not base_failed").join(learnable(labels, "quality"), "doc_id")
    rules = learned(known)
    at = F.when(F.col("base_failed"), 0).otherwise(decided(rules))
    named = F.lit(None).cast("string")
    for i, rule in enumerate(rules):
        named = F.when(at == i + 1, str(rule)).otherwise(named)
    return table.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (at == 0)).alias("kept"), named.alias("rule"))
