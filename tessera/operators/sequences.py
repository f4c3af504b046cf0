"""Operators on tables of sequences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.functions import rna
from tessera.staging import staged


def kmer_tokens(df: DataFrame, key: str, seq: str, ks: tuple[int, ...]) -> DataFrame:
    """(key, k, kmer), one row for each occurrence."""
    per_k = F.array(*(F.struct(F.lit(k).alias("k"), rna.kmers(F.col(seq), k).alias("kmers")) for k in ks))
    return df.select(key, F.explode(per_k).alias("x")).select(key, F.col("x.k").alias("k"), F.explode("x.kmers").alias("kmer"))


def kmer_table(df: DataFrame, key: str, seq: str, ks: tuple[int, ...]) -> DataFrame:
    """(key, k, kmer, n, share): share of all overlapping k-mers of the sequence."""
    per_k = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), rna.kmers(F.col(seq), k).alias("kmers")) for k in ks))).alias("x")
    each = df.select(key, F.length(seq).alias("_len"), per_k).select(key, "_len", F.col("x.k").alias("k"), F.explode("x.kmers").alias("kmer"))
    n = each.groupBy(key, "k", "kmer").agg(F.count("*").alias("n"), F.first("_len").alias("_len"))  # added up where the sequence lies, before any shuffle
    return n.select(key, "k", "kmer", "n", (F.col("n") / (F.col("_len") - F.col("k") + 1)).alias("share"))


def _kmer_counts(column: str, ks: tuple[int, ...]):
    """Adds to each batch, for each k, the shares of all k-mers over the four letters in the order of ``product``."""
    import numpy as np
    import pyarrow as pa

    look = np.full(256, 4, np.uint8)
    look[[ord(b) for b in rna.BASES]] = range(4)

    def shares(text: str | None, k: int) -> np.ndarray:
        if text is None or len(text) < k:
            return np.zeros(4**k)
        c = look[np.frombuffer(text.encode("ascii", "replace"), np.uint8)].astype(np.int64)
        n = len(c) - k + 1
        own, code = np.ones(n, bool), np.zeros(n, np.int64)
        for i in range(k):
            own &= c[i : i + n] < 4
            code = code * 4 + c[i : i + n]
        return np.bincount(code[own], minlength=4**k) / n

    def added(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                arrays, texts = list(batch.columns), batch.column(column).to_pylist()
                for k in ks:
                    arrays += [pa.array(x) for x in np.array([shares(t, k) for t in texts]).T]
                names = [*batch.schema.names, *(f"_k{k}_{i}" for k in ks for i in range(4**k))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return added


def with_kmer_vectors(df: DataFrame, seq: str, prefixes: dict[int, str]) -> DataFrame:
    """Adds for each k of ``prefixes`` one column for each k-mer over the four letters, counted where the row lies."""
    ks = tuple(prefixes)
    plain = StructType([*df.schema.fields, *(StructField(f"_k{k}_{i}", DoubleType()) for k in ks for i in range(4**k))])
    wide = df.mapInArrow(_kmer_counts(seq, ks), plain)
    names = [prefixes[k] + "".join(p) for k in ks for p in product(rna.BASES, repeat=k)]
    return wide.toDF(*df.columns, *names)


def kmer_vector(df: DataFrame, key: str, seq: str, k: int, prefix: str) -> DataFrame:
    """One column for each k-mer over the four letters; all 0 for a sequence that is too short."""
    return with_kmer_vectors(df.select(key, seq), seq, {k: prefix}).drop(seq)


def with_occurrences(df: DataFrame, seq: str, names: dict[str, str]) -> DataFrame:
    """Adds for each text of ``names`` how often it is found in a sequence, from the left and without overlaps."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pc.count_substring(batch.column(seq), part).cast(pa.int64()) for part in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *names.values()])

    return df.mapInArrow(added, StructType([*df.schema.fields, *(StructField(n, LongType()) for n in names.values())]))


def _partners(column: str):
    """Adds to each batch the pairs of its brackets, by a stack."""
    import numpy as np
    import pyarrow as pa

    def of(text: str | None) -> np.ndarray:
        stack, pairs = [], []
        for at, c in enumerate(text or ""):
            if c == "(":
                stack.append(at)
            elif c == ")" and stack:
                pairs.append((stack.pop(), at))
        return np.array(sorted(pairs), np.int32).reshape(-1, 2)

    def added(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                each = [of(t) for t in batch.column(column).to_pylist()]
                flat = np.concatenate(each)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32))
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["i", "j"])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pairs)], [*batch.schema.names, "pairs"])

    return added


def with_pairs(df: DataFrame, brackets: str) -> DataFrame:
    """Adds pairs, an array of (i, j) by i, of a dot-bracket string; a closing bracket without a partner is left out."""
    pair = StructType([StructField("i", IntegerType()), StructField("j", IntegerType())])
    return df.mapInArrow(_partners(brackets), StructType([*df.schema.fields, StructField("pairs", ArrayType(pair))]))


def base_pairs(df: DataFrame, key: str, brackets: str) -> DataFrame:
    """(key, i, j) of the pairs of a dot-bracket string."""
    return with_pairs(df.select(key, brackets), brackets).select(key, F.inline("pairs"))


def gathered(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows that have a pair, with their own pairs as ``with_pairs`` gives them, from a table of pairs."""
    return df.join(pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")))).alias("pairs")), key)


def stem_mutations(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, i, j, seq, broken, rescued) for rows with pairs: a mismatch at the first pair that touches the motif, else the first pair; and the edit that mends it."""
    full = df.where(F.size("pairs") > 0).select(key, seq, "pairs", F.inline(F.array(rna.motif(F.col(seq)))))  # a generator, so that the motif is sought once
    inside = lambda x: (x >= F.col("start")) & (x < F.col("end"))
    touching = F.array_min(F.filter("pairs", lambda p: inside(p["i"]) | inside(p["j"])))
    one = full.select(key, seq, F.inline(F.array(F.coalesce(touching, F.array_min("pairs")))))
    base = F.translate(F.col(seq).substr(F.col("i") + 1, F.lit(1)), "AUGC", "UACG")
    broken = F.overlay(F.col(seq), base, F.col("i") + 1)
    return one.select(key, "i", "j", seq, broken.alias("broken"), F.overlay(broken, F.translate(base, "AUGC", "UACG"), F.col("j") + 1).alias("rescued"))


def capped_copies(df: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group of equal sequences, by key.

    Copies are numbered within a salt first, so that a group that holds much of the table is cut before it meets in a task.
    """
    digest = F.sha2(F.col(seq), 256)
    salted = df.withColumn("_d", digest).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_d", "_salt").orderBy(key))).where(F.col("_r") <= most)
    return few.withColumn("copy", F.row_number().over(Window.partitionBy("_d").orderBy(key))).where(F.col("copy") <= most).drop("_d", "_salt", "_r")


def near_identical(df: DataFrame, key: str, seq: str, identity: float) -> DataFrame:
    """(a, b): different sequences whose share of equal positions, over the longer length, is at least ``identity``.

    At most ``f = floor((1 - identity) * length)`` positions differ, and each spoils one of ``2 * (f + 1)`` blocks cut at the
    same places, so about half of a pair's blocks are equal. Lengths are banded to decide on the blocks. Pairs with
    fewer equal blocks, such as those that share only a common beginning, go before any text is fetched.
    """
    classes = df.groupBy(seq).agg(F.min(key).alias("k")).withColumn("n", F.length(seq)).where("n > 0")
    # a pair's lengths lie in one length band or in two next to each other
    step = F.greatest(F.lit(1), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / identity))).cast("int"))

    def band(g: Column) -> Column:
        longest = F.ceil(F.pow(F.lit(1 / identity), g + 1)).cast("int")
        blocks = 2 * (F.floor(longest * (1 - identity)).cast("int") + 1)
        return F.struct(g.alias("g"), F.greatest(F.ceil(longest / blocks), F.lit(1)).cast("int").alias("w"))

    both = classes.select("k", "n", seq, F.explode(F.array(step, step + 1)).alias("g")).select("k", "n", seq, F.inline(F.array(band(F.col("g")))))
    # four bytes a letter, so that a block is cut out by its place and not by walking there
    hashes = rna.bound(F.encode(seq, "UTF-32"), lambda t: F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("w")).cast("int") - 1), lambda i: F.xxhash64(F.substring(t, i * F.col("w") * 4 + 1, F.col("w") * 4))))
    thin = both.select("g", "w", "k", "n", F.posexplode(hashes).alias("block", "part"))
    left, right = thin.toDF("g", "w", "a", "na", "block", "part"), thin.drop("w").toDF("g", "b", "nb", "block", "part")
    met = left.join(right, ["g", "block", "part"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= identity * F.greatest("na", "nb")))
    longer = F.greatest("na", "nb")
    least = F.ceil(longer / F.col("w")) - F.floor(longer - identity * longer + 1e-9)
    equal = met.groupBy("g", "w", "a", "b", "na", "nb").agg(F.count("*").alias("equal")).where(F.col("equal") >= least)
    pairs = equal.select("a", "b").distinct()
    texts = classes.select("k", seq)
    full = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    same = F.size(F.filter(F.zip_with(F.split("x", ""), F.split("y", ""), lambda x, y: x == y), lambda e: e))
    return full.where(same >= identity * F.greatest(F.length("x"), F.length("y"))).select("a", "b")


def clamped(df: DataFrame, pairs: DataFrame | None, key: str, seq: str, n: int = 2) -> DataFrame:
    """(key, edits, clamped): the ``n`` A-U pairs farthest from the motif become G-C pairs, all at once.

    Without ``pairs``, a table of (key, i, j), rows have their own as ``with_pairs`` gives them.
    """
    # generators, so that the motif is sought and pairs are sorted once
    full = (df if pairs is None else gathered(df, pairs, key)).select(key, seq, "pairs", F.inline(F.array(rna.motif(F.col(seq)))))
    away = lambda x: F.greatest(F.col("start") - x, x - F.col("end") + 1, F.lit(0))
    soft = rna.bound(F.split(seq, ""), lambda c: F.filter("pairs", lambda p: F.concat(F.get(c, p["i"]), F.get(c, p["j"])).isin("AU", "UA")))
    far = F.transform(soft, lambda p: F.struct((-F.least(away(p["i"]), away(p["j"]))).alias("d"), p["i"].alias("i"), p["j"].alias("j")))
    full = full.select(key, seq, F.explode(F.array(F.slice(F.array_sort(far), 1, n))).alias("_far"))
    letter = lambda x: F.col(seq).substr(x + 1, F.lit(1))
    ends = F.transform("_far", lambda p: F.array(F.struct(p["i"].alias("at"), F.translate(letter(p["i"]), "AU", "GC").alias("base")), F.struct(p["j"].alias("at"), F.translate(letter(p["i"]), "AU", "CG").alias("base"))))
    edits = full.select(key, seq, F.explode(F.array(F.array_sort(F.flatten(ends)))).alias("edits")).where(F.size("edits") > 0)
    now = F.aggregate("edits", F.col(seq), lambda s, x: F.overlay(s, x["base"], x["at"] + 1))
    return edits.select(key, F.size("edits").alias("edits"), now.alias("clamped"))


#: Rows whose k-mers are counted to tell rare ones from frequent ones, and how many of these counts are kept.
RANKED, FREQUENT = 4000, 1 << 17
#: Bits of a signature: of its mark, few enough to be small in a shuffle, and of its range of sizes. Marks that are equal by chance cost a comparison.
MARK, RANGE = 42, 5
#: Parts of a range's signatures at most; signatures that a task holds, and pairs that it counts, at once.
PARTS, HELD, MET = 64, 1 << 25, 1 << 22
#: Bytes of k-mer sets that a worker remembers while it compares pairs.
REMEMBERED = 1 << 25


def _spread(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmer_set(text: str | None, k: int) -> np.ndarray:
    """The distinct k-mers of a text as sorted 64-bit hashes."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(c) - k + 1, 0)
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + c[i : i + n] + np.uint64(1)
    return np.unique(_spread(x))


def _apart(sizes: int, share: float) -> int:
    """How many elements at most only one of two sets has, whose sizes add up to ``sizes`` and whose similarity is ``share`` at least."""
    return int(sizes * (1 - share) / (1 + share) + 1e-9)


def needed(level: int, share: float) -> int:
    """How many signatures two similar sets have in common, at least."""
    return 1 + _apart(2 * ((2 << level) - 1), share) // 12


def signatures(s: np.ndarray, share: float, known: np.ndarray, weight: np.ndarray) -> Iterator[np.ndarray]:
    """The signatures of a set for each range of sizes that the larger set of a similar pair may lie in, the range in the low bits: similar sets have ``needed`` in common in one.

    In a range all sets are dealt to the same cells by their elements' hashes. Two similar sets differ in d elements at most,
    so all but d cells hold the same. Cells are put in one order for all sets, those of many and rare elements first;
    so sets that agree in all but d cells have 1 + e of the first d + 1 + e in common. Weights decide on the order alone.
    """
    n = len(s)
    at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
    w = np.where(known[at] == s, weight[at], 255) if len(known) else np.full(n, 255)
    largest = int(n / share + 1e-9)
    for level in range(n.bit_length() - 1, largest.bit_length()):
        top = (2 << level) - 1
        most, extra = _apart(2 * top, share), needed(level, share) - 1
        cells = most + 1 + (most + 4) // 4
        cell = (s % np.uint64(cells)).astype(np.int64)
        score = np.bincount(cell, weights=w, minlength=cells)  # whole numbers
        order = np.argsort(cell, kind="stable")
        held = cell[order]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        mark = np.zeros(cells, np.uint64)
        mark[held[first]] = np.add.reduceat(_spread(s[order] + np.uint64(1)), first)
        mark = _spread(mark ^ _spread(np.arange(cells, dtype=np.uint64) + np.uint64((level + 1) << 32)))
        chosen = mark[np.lexsort((mark, -score))[: _apart(n + min(largest, top), share) + 1 + extra]]
        yield (chosen >> np.uint64(64 - MARK) << np.uint64(RANGE)) | np.uint64(level)


def parts(level: int, share: float) -> tuple[int, int]:
    """In how many parts a range's signatures are dealt, and how many of one part two similar sets have in common, at least, in some part."""
    n = needed(level, share)
    some = max(1, min(n // 3, PARTS))
    return some, -(-n // some)


def _signed(k: int, share: float, known: np.ndarray, weight: np.ndarray, buckets: int):
    """(part, one, other, own, k, marks): the signatures of each row's k-mers by parts, 32 bits each; rows are dealt to buckets, and go where their bucket meets another."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                key, made = batch.column(0), []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    s = kmer_set(text, k)
                    own = int(s[0] % np.uint64(buckets)) if len(s) else 0
                    for t in signatures(s, share, known, weight) if len(s) else ():
                        level, mark = int(t[0] & np.uint64((1 << RANGE) - 1)), t >> np.uint64(RANGE)
                        some = np.uint64(parts(level, share)[0])
                        part, mark = mark % some, (mark // some).astype(np.uint32)
                        for p in range(int(some)):
                            blob = mark[part == p].tobytes()
                            if blob:
                                made += [(level * PARTS + p, min(own, o), max(own, o), own, row, blob) for o in range(buckets)]
                if made:
                    *places, row, blob = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in places), key.take(pa.array(row)), pa.array(blob, pa.binary())], ["part", "one", "other", "own", "k", "marks"])

    return sign


def _alike_marks(marks: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n): places of sets of 32-bit marks that have n in common, ``least`` at least, each pair once; pairs are counted for some sets at a time."""
    size = np.array([len(m) // 4 for m in marks])
    x = (np.frombuffer(b"".join(marks), np.uint32).astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(marks), dtype=np.uint64), size)
    x.sort()
    mark, owner = (x >> np.uint64(32)).astype(np.uint32), (x & np.uint64(0xFFFFFFFF)).astype(np.int32)
    del x
    ends = np.flatnonzero(np.r_[mark[1:] != mark[:-1], True]) if len(mark) else np.zeros(0, int)
    after = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(len(mark))  # later places of the same mark
    some = np.flatnonzero(after > 0)
    order = some[np.argsort(owner[some], kind="stable")]
    work = np.cumsum(after[order])
    at = 0
    while at < len(order):
        stop = int(np.searchsorted(work, (work[at - 1] if at else 0) + MET, side="right"))
        stop = max(stop, at + 1)
        stop = int(np.searchsorted(owner[order], owner[order[stop - 1]], side="right"))  # whole sets
        here, n = order[at:stop], after[order[at:stop]]
        first = np.repeat(here, n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        pair = np.sort((owner[first].astype(np.int64) << 32) | owner[second])
        edge = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        n, pair = np.diff(np.r_[edge, len(pair)]), pair[edge]
        a, b = pair >> 32, pair & 0xFFFFFFFF
        ok = (n >= least) & (a != b)
        yield a[ok], b[ok], n[ok]
        at = stop


def _met(share: float):
    """(a, b, level, n) of rows that have n signatures of one part in common, as many as ``parts`` says; rows come by (part, one, other)."""

    def told(group: tuple[int, int, int], own: list[np.ndarray], keys: list[pa.Array], marks: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, own, level = pa.concat_arrays(keys), np.concatenate(own), group[0] // PARTS
        for a, b, n in _alike_marks(marks, parts(level, share)[1]):
            if group[1] != group[2]:  # rows of one bucket meet where it meets itself
                a, b, n = (x[own[a] != own[b]] for x in (a, b, n))
            if len(a):
                yield pa.RecordBatch.from_arrays([key.take(pa.array(a)), key.take(pa.array(b)), pa.array(np.full(len(a), level, np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "level", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, side, keys, marks = None, [], [], []
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy() for i in range(3)], 1) if batch.num_rows else np.zeros((0, 3))
            cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(1)]) if len(ids) else []
            for start, stop in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                own = tuple(ids[start].tolist())
                if own != group and marks:
                    yield from told(group, side, keys, marks)
                    side, keys, marks = [], [], []
                group = own
                side.append(batch.column(3).slice(start, stop - start).to_numpy())
                keys.append(batch.column(4).slice(start, stop - start))
                marks += batch.column(5).slice(start, stop - start).to_pylist()
        if marks:
            yield from told(group, side, keys, marks)

    return meet


def _counted(k: int):
    """(t, c): how many rows of a batch have a k-mer."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                t, c = np.unique(np.concatenate([kmer_set(x, k) for x in whole.column(0).slice(at, 256).to_pylist()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c)], ["t", "c"])

    return count


def _alike(k: int, share: float):
    """(a, b) of the rows (a, x, b, y) whose texts are similar."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = {}, 0

        def kmers(text: str) -> np.ndarray:
            nonlocal sets, size
            if text not in sets:
                if size > REMEMBERED:
                    sets, size = {}, 0
                sets[text] = kmer_set(text, k)
                size += sets[text].nbytes + 4 * len(text)
            return sets[text]

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, ok = whole.slice(at, 256), []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    x, y = kmers(x), kmers(y)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both >= share * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return alike


def similar(df: DataFrame, key: str, seq: str, k: int = 9, share: float = 0.8) -> DataFrame:
    """(a, b), the longer first, ties by key: different sequences whose k-mer sets have a Jaccard similarity of ``share`` at least; exact.

    Sequences meet on ``signatures``, each of several k-mers at once, as single k-mers of few letters are in most sequences. Signatures are dealt to
    parts; a task has all of a part and counts how many two sequences have in common there, so pairs that meet by chance never leave it: similar ones
    have several in common in some part, and only such pairs are fetched and compared. Where a part has more signatures than a task may
    hold, sequences are dealt to buckets too, and each two buckets meet. k-mers are counted on a sample; the counts only put signatures in order.
    """
    kind = df.schema[key].dataType.simpleString()
    classes = staged(df.where(F.length(seq) >= k).groupBy(F.col(seq).alias("_seq")).agg(F.min(key).alias("k")).select("k", "_seq"), "classes")
    some = classes.orderBy(F.xxhash64("k"), "k").limit(RANKED).select("_seq")
    often = some.mapInArrow(_counted(k), "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "t").limit(FREQUENT).toPandas()
    known = often["t"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    weight = np.rint(16 * np.log2(RANKED / often["c"].to_numpy(float)) + 1).astype(np.int64)[order]
    letters = classes.groupBy(F.floor(F.log2(F.length("_seq"))).cast("int").alias("level")).agg(F.sum(F.length("_seq")).alias("n")).collect()  # RANGE bits
    most = max((0.3 * sum(r["n"] for r in letters if r["level"] in (x, x - 1)) / parts(x, share)[0] for x in {r["level"] for r in letters}), default=0)
    at = classes.mapInArrow(_signed(k, share, known[order], weight, int(most // HELD) + 1), f"part int, one int, other int, own int, k {kind}, marks binary")
    met = at.repartition("part", "one", "other").sortWithinPartitions("part", "one", "other").mapInArrow(_met(share), f"a {kind}, b {kind}, level int, n long")
    # parts that aren't told have fewer than ``least`` in common, so this is what all parts can have together
    of = [parts(level, share) for level in range(1 << RANGE)]
    below, enough = (F.get(F.array(*(F.lit(x) for x in xs)), F.col("level")) for xs in ([least - 1 for _, least in of], [needed(level, share) - some * (least - 1) for level, (some, least) in enumerate(of)]))
    each = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level", (F.col("n") - below).alias("n")).groupBy("a", "b", "level").agg(F.sum("n").alias("n"))
    pairs = staged(each.where(F.col("n") >= enough).select("a", "b").distinct(), "met")
    full = pairs.join(classes.toDF("a", "x"), "a").join(classes.toDF("b", "y"), "b")
    longer = F.struct(-F.length("x"), "a") < F.struct(-F.length("y"), "b")
    found = full.select(F.when(longer, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(longer, F.col("b")).otherwise(F.col("a")).alias("b"), "x", "y")
    return found.mapInArrow(_alike(k, share), f"a {kind}, b {kind}")


def collapse_report(df: DataFrame, key: str, seq: str, group: str, copies: int = 3, identity: float = 0.98, share: float = 0.2, limit: float = 0.85, unique: float = 0.05, unique_from: int = 80) -> DataFrame:
    """(group, rows, repetitive, copies, near_pairs, near_share, errors): whether the sequences of a group have collapsed to a few.

    Low-complexity rows, the largest number of copies, and the share of all pairs whose identity is ``identity`` at
    least, copies included. Copies are counted, not paired. Empty sequences are rows, but neither copies nor pairs.
    """
    s, digest = F.col(seq), F.sha2(F.col(seq), 256).alias("_d")
    pairs = [a + b for a in rna.BASES for b in rna.BASES]
    poor = (rna.top_fraction(s, list(rna.BASES), 1) >= limit) | (rna.top_fraction(s, pairs, 2) >= limit) | ((F.length(s) >= unique_from) & (rna.unique_ratio(s) < unique))
    each = df.select(group, key, digest, (F.length(s) > 0).alias("_full"), F.coalesce(poor, F.lit(False)).alias("_poor"))
    per = staged(each.groupBy(group, "_d", "_full").agg(F.count("*").alias("n"), F.count_if("_poor").alias("poor"), F.min(key).alias("k")), "copies")
    full = F.when(F.col("_full"), F.col("n"))
    whole = per.groupBy(group).agg(F.sum("n").alias("rows"), F.sum("poor").alias("repetitive"), F.coalesce(F.max(full), F.lit(0)).alias("copies"), F.coalesce(F.sum(full * (full - 1) / 2), F.lit(0.0)).alias("_same"))
    first = per.groupBy("_d").agg(F.min("k").alias("_k"))  # the key by which near_identical knows the class
    held = per.where("_full").join(first, "_d").select(group, "_k", "n")
    near = near_identical(df, key, seq, identity)
    left, right = held.toDF(group, "a", "na"), held.toDF("_g", "_b", "nb")
    met = near.join(left, "a").join(right, (F.col("b") == F.col("_b")) & F.col(group).eqNullSafe(F.col("_g")))
    between = met.groupBy(group).agg(F.sum(F.col("na") * F.col("nb")).alias("_near"))
    out = whole.join(between.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("near_pairs", (F.col("_same") + F.coalesce("_near", F.lit(0))).cast("long"))
    out = out.withColumn("near_share", F.coalesce(F.try_divide(F.col("near_pairs") * 2, F.col("rows") * (F.col("rows") - 1)), F.lit(0.0)))
    said = [
        F.when(F.col("repetitive") > 0, F.concat(F.lit("repetitive sequences: "), F.col("repetitive"))),
        F.when(F.col("copies") >= copies, F.concat(F.lit("identical copies: "), F.col("copies"))),
        F.when(F.col("near_share") > share, F.concat(F.lit("near-identical pairs: "), F.col("near_pairs"))),
    ]
    return out.select(group, "rows", "repetitive", "copies", "near_pairs", "near_share", F.concat_ws("; ", *said).alias("errors"))
