"""Expressions on sequences over the letters A, U, G, C. Positions are 0-based, ends exclusive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "AUGC"
# Motifs in order of priority, and recognition sites.
MOTIFS = ("AGGAGG", "AGGAG", "AGGA")
SITES = {"EcoRI": "GAATTC", "BamHI": "GGATCC", "XhoI": "CTCGAG"}
TAIL = 10


def normalized(s: Column) -> Column:
    return F.translate(F.upper(F.trim(s)), "T", "U")


def count_of(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc_fraction(s: Column) -> Column:
    return F.when(F.length(s) > 0, count_of(s, "GC") / F.length(s)).otherwise(0.0)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body (lambdas included) reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kmers(s: Column, k: int) -> Column:
    """All overlapping k-mers, in order; in time proportional to the length, which substrings of text by position are not: those of bytes are."""
    plain = bound(F.encode(s, "UTF-8"), lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - (k - 1)), lambda i: F.substring(b, i, F.lit(k)).cast("string")))
    other = bound(F.split(s, ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*(F.get(c, i + j) for j in range(k)))))
    return F.when((F.length(s) >= k) & (F.octet_length(s) == F.length(s)), plain).when(F.length(s) >= k, other).otherwise(F.array().cast("array<string>"))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "AUGC", "UACG"))


def motif(s: Column) -> Column:
    """(start, end) of the first motif by priority, else of the last bases."""
    other = F.struct(F.greatest(F.length(s) - TAIL, F.lit(0)).alias("start"), F.length(s).alias("end"))
    return reduce(
        lambda rest, m: F.when(F.instr(s, m) > 0, F.struct((F.instr(s, m) - 1).alias("start"), (F.instr(s, m) - 1 + len(m)).alias("end"))).otherwise(rest),
        reversed(MOTIFS),
        other,
    )


def spacing(s: Column) -> Column:
    """Bases between the motif and the first AUG after it; -1: none."""
    end = motif(s)["end"]
    at = F.call_function("locate", F.lit("AUG"), s, end + 1)
    return F.when(at > 0, at - 1 - end).otherwise(F.lit(-1))


def window(s: Column, width: int = 30) -> Column:
    """(start, length) of the last ``width`` bases, moved to cover a motif that isn't among the last ten."""
    n, w = F.length(s), F.least(F.lit(width), F.length(s))
    m = motif(s)
    start = F.greatest(F.lit(0), F.least(m["start"], n - w))
    start = F.when((m["end"] - m["start"] >= w) | (m["end"] - 1 >= start + w), F.greatest(F.lit(0), m["end"] - w)).otherwise(start)
    return F.struct(F.when(m["start"] >= n - TAIL, n - w).otherwise(start).alias("start"), w.alias("length"))


def stable_seed(key: Column, base: int = 42) -> Column:
    return F.lit(base) + F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % 10000


def sites(s: Column) -> Column:
    """Names of the recognition sites in a sequence with T for U."""
    dna = F.translate(s, "U", "T")
    return F.array_compact(F.array(*(F.when(F.contains(dna, F.lit(x)), F.lit(n)) for n, x in SITES.items())))


def top_fraction(s: Column, pieces: list[str], k: int) -> Column:
    """Share of the most frequent of the given overlapping k-mers."""
    if k == 1:
        most = F.array_max(F.array(*(count_of(s, p) for p in pieces)))
    else:

        def counted(of: Column) -> Column:
            def times(piece: str) -> Column:
                return F.size(F.filter(of, lambda x: x == piece))

            return F.array_max(F.array(*map(times, pieces)))

        most = bound(kmers(s, k), counted)
    return F.try_divide(most, F.length(s) - (k - 1))


def unique_ratio(s: Column, k: int = 3) -> Column:
    return F.try_divide(F.size(F.array_distinct(kmers(s, k))), F.length(s) - (k - 1))


def first_failure(raw: Column, shortest: int = 40, longest: int = 600, mono: float = 0.85, dimer: float = 0.85, unique: float = 0.05, unique_from: int = 80) -> Column:
    """The first quality rule that a sequence fails, null if none."""
    s, n = normalized(raw), F.length(normalized(raw))
    pairs = [a + b for a in BASES for b in BASES]
    return (
        F.when(raw.isNull() | (n == 0), "empty")
        .when(~s.rlike("^[AUGC]+$"), "alphabet")
        .when((n < shortest) | (n > longest), "length")
        .when(top_fraction(s, list(BASES), 1) >= mono, "mono")
        .when(top_fraction(s, pairs, 2) >= dimer, "dimer")
        .when((n >= unique_from) & (unique_ratio(s) < unique), "unique")
    )


def stem_and_loop(brackets: Column) -> Column:
    """(longest stem counter, longest run of dots) of a dot-bracket string."""
    step = lambda a, c: F.struct(
        (a["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("now"),
        F.greatest(a["most"], a["now"] + F.when(c == "(", 1).otherwise(0)).alias("most"),
    )
    stem = F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])
    loop = F.array_max(F.transform(F.split(brackets, "[^.]+"), F.length))
    return F.struct(stem.alias("stem"), loop.alias("loop"))


def hill(t: Column, bottom: Column, top: Column, tm: Column, n: Column) -> Column:
    """Sigmoid melting curve; operands of the power are at least 1e-6."""
    least = F.lit(1e-6)
    return bottom + (top - bottom) / (1 + F.pow(F.greatest(tm, least) / F.greatest(t, least), F.greatest(n, least)))
