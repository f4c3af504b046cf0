"""Hard negatives by a secondary-sort shuffle.

Vectors become whole numbers and lie in blocks of neighbouring labels. Anchors first meet the blocks that hold their own
label; of each block's scores only the best few can be positives. Then they meet all blocks, with their positives'
scores: of each block only the best few in each positive's window can be its negatives. First a tenth of the blocks is
met; the last of the negatives found there is a bar for the others. What survives, a bounded number for each anchor and
block, is shuffled by anchor and sorted within partitions by (anchor, descending score, positives first, id), the
DataFrame form of ``repartitionAndSortWithinPartitions``. An iterator then reads one row at a time: a positive opens its
window, a negative goes to the open windows it lies in, and a window that is full or passed is closed. No anchor's rows
are ever held together. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.staging import staged

EVERY, POSITIVES, NEGATIVES, LEAST_PERCENT, SCALE = 100, 5, 5, 80, 256
#: Bytes of codes in a block, anchors and candidates multiplied at once, and the share of blocks that are met first.
BLOCK_BYTES, LEAST_BYTES, ASKED, MET, FIRST = 1 << 26, 1 << 18, 256, 8192, 10
_BOUND = (1 << 63) - 1


def codes(x: np.ndarray) -> tuple[bytes, bool]:
    """floor(SCALE * x) as int16, or where that is too small x itself, from which ``whole`` works the numbers out."""
    with np.errstate(over="ignore"):
        c = np.floor(x * SCALE)
    if np.all(np.abs(c) < 1 << 15):
        return c.astype("<i2").tobytes(), False
    return x.astype("<f8").tobytes(), True


def whole(x: float) -> int:
    """floor(SCALE * x) of any finite number: from 2**53 on numbers are whole."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE))


class Side:
    """Rows of equal length: ids, labels, and whole-number vectors, as int16 or, where one is wide, as Python's."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, data: list[bytes], wide: np.ndarray):
        self.ids, self.labels = ids, labels
        if wide.any():
            rows = [[whole(v) for v in np.frombuffer(d, "<f8").tolist()] if w else np.frombuffer(d, "<i2").tolist() for d, w in zip(data, wide.tolist(), strict=True)]
            self.x = np.array(rows, dtype=object).reshape(len(rows), -1)
        else:
            self.x = np.frombuffer(b"".join(data), "<i2").reshape(len(data), -1)

    def most(self) -> int:
        return int(max((abs(int(v)) for v in (self.x.max(), self.x.min())), default=0)) if self.x.size else 0


def scores(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products as int64 (held to the range of a long); ``most``: a bound of |a| * |b|."""
    if a.dtype == object or b.dtype == object:
        return np.clip(a.astype(object) @ b.astype(object).T, -_BOUND, _BOUND).astype(np.int64)
    width = np.float32 if most * a.shape[1] < 1 << 24 else np.float64 if most * a.shape[1] < 1 << 53 else np.int64
    return (a.astype(width) @ b.astype(width).T).astype(np.int64)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group, by score and then by smaller id."""
    order = np.lexsort((ids, -score, group))
    own = group[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def positives_of(q: Side, x: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, id, score) of the k best rows of its label in a block, the anchor's own row left out."""
    out, most = [], q.most() * x.most()
    for label in np.unique(q.labels):
        rows, met = np.flatnonzero(q.labels == label), np.flatnonzero(x.labels == label)
        for i in range(0, len(rows), ASKED):
            asked, bar, held = rows[i : i + ASKED], None, (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for j in range(0, len(met), MET):
                block = met[j : j + MET]
                s = scores(q.x[asked], x.x[block], most)
                found = (s >= bar[:, None]) if bar is not None else np.ones(s.shape, bool)
                r, c = np.nonzero(found & (q.ids[asked][:, None] != x.ids[block][None]))
                held = tuple(np.concatenate(p) for p in zip(held, (r, x.ids[block][c], s[r, c]), strict=True))
                kept = _best(held[0], held[2], held[1], k)
                held = tuple(h[kept] for h in held)
                bar = _bars(held[0], held[2], len(asked), k)
            out.append((asked[held[0]], held[1], held[2]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bars(group: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th best score of each of n groups; where there are fewer, the least long. Rows come ordered by ``_best``."""
    first, last = np.searchsorted(group, np.arange(n)), np.searchsorted(group, np.arange(n), side="right")
    full = last - first >= k
    out = np.full(n, -_BOUND)
    out[full] = score[first[full] + k - 1]
    return out


def least_allowed(positive: np.ndarray, percent: int) -> np.ndarray:
    """The least whole number n with percent * positive <= 100 * n, in Python's numbers where a long would overflow."""
    if len(positive) and np.abs(positive).max() > _BOUND // 128:
        return np.array([-((-percent * int(p)) // 100) for p in positive], np.int64)
    return -((-percent * positive) // 100)


def negatives_of(q: Side, tops: np.ndarray, bars: np.ndarray, x: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, id, score) of the rows of other labels that can be among the k best of one of its windows.

    A window takes scores of at most ``tops[a, w]`` and of at least ``bars[a, w]``; one that isn't there has a bar above
    its top.
    """
    out, most, windows = [], q.most() * x.most(), tops.shape[1]
    for i in range(0, len(q.ids), ASKED):
        asked = slice(i, i + ASKED)
        top, bar = tops[asked], bars[asked].copy()
        held = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))  # group: anchor * windows + window
        for j in range(0, len(x.ids), MET):
            met = slice(j, j + MET)
            s = scores(q.x[asked], x.x[met], most)
            open_ = top >= bar
            low, high = np.where(open_, bar, _BOUND).min(axis=1), np.where(open_, top, -_BOUND).max(axis=1)
            r, c = np.nonzero((s >= low[:, None]) & (s <= high[:, None]))
            other = q.labels[asked][r] != x.labels[met][c]
            r, c = r[other], c[other]
            v = s[r, c]
            for w in range(windows):
                inside = (v <= top[r, w]) & (v >= bar[r, w])
                held = tuple(np.concatenate(p) for p in zip(held, (r[inside] * windows + w, x.ids[met][c[inside]], v[inside]), strict=True))
            kept = _best(held[0], held[2], held[1], k)
            held = tuple(h[kept] for h in held)
            bar = np.maximum(bar, _bars(held[0], held[2], top.size, k).reshape(top.shape))
        if len(held[0]):
            pairs = np.unique(np.stack([held[0] // windows, held[1], held[2]]), axis=1)
            out.append((i + pairs[0], pairs[1], pairs[2]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))


def prepared(vectors: DataFrame, column: str, label: Column) -> DataFrame:
    """(vec_id, label, dim, wide, data) of the rows with an id, a label and a finite vector; an id met several times counts once."""
    of = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = of.where("vec_id is not null and label is not null and v is not null").where(F.coalesce(finite, F.lit(False)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            made = [codes(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            dims = pa.array(np.diff(ends), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dims, pa.array([w for _, w in made], pa.bool_()), pa.array([d for d, _ in made], pa.binary())], names=["vec_id", "label", "dim", "wide", "data"])

    rows = good.mapInArrow(coded, "vec_id long, label long, dim int, wide boolean, data binary")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "wide", "data")).alias("r")).select("vec_id", "r.*")


def mined(
    vectors: DataFrame,
    column: str = "embedding",
    label: Column | str = "label",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT,
) -> DataFrame:
    """For each row whose id ``every`` divides (an anchor) and each of its ``positives`` best rows of the same label: the
    ``negatives`` best rows of another label whose score is between ``percent`` percent of the positive's and the positive's.

    Gives anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. A score is the inner product
    of the vectors' whole numbers floor(256 * x), held to the range of a long; ties go to the smaller id. Rows without an
    id or a label, or with a vector that is null or holds null, NaN or infinity, take no part; a zero or empty vector does.
    Vectors of different lengths are not compared. An id met several times counts once, with its least label and, of that, its
    shortest and least vector; it is never its own positive. Anchors without positives and positives without negatives
    have no rows; an empty table gives none. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    clean = staged(prepared(vectors, column, F.col(label) if isinstance(label, str) else label), "codes")
    volume = int(clean.agg(F.sum(F.length("data") + 16)).first()[0] or 0)
    n_blocks = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-volume // LEAST_BYTES)), -(-volume // BLOCK_BYTES))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, at), pa.int32())], names=["vec_id", "label", "dim", "wide", "data", "block"])

    ranged = clean.repartitionByRange(n_blocks, "dim", "label", F.xxhash64("vec_id")).select("vec_id", "label", "dim", "wide", "data")
    shape = "vec_id long, label long, dim int, wide boolean, data binary, block int"
    laid = staged(ranged.mapInArrow(numbered, shape), "blocks")
    # one row for each block, of some 64 MB: which lengths and labels lie in it
    bounds = laid.groupBy("block").agg(F.min(F.struct("dim", "label")).alias("a"), F.max(F.struct("dim", "label")).alias("b")).collect()
    if not bounds:
        return spark.createDataFrame([], _OUT)
    table = F.array(*(F.struct(F.lit(r["block"]).alias("block"), *(F.lit(v).cast("long").alias(n) for n, v in zip(("d0", "l0", "d1", "l1"), (*r["a"], *r["b"]), strict=True))) for r in sorted(bounds, key=lambda r: r["block"])))
    anchors = laid.where(F.col("vec_id") % every == 0).select("vec_id", "label", "dim", "wide", "data")

    def within(dim: Column, x: Column) -> Column:
        return (dim >= x["d0"]) & (dim <= x["d1"])

    def holds(dim: Column, lab: Column, x: Column) -> Column:
        """The block's rows, in the order of (length, label), can include this one."""
        after = (dim > x["d0"]) | ((dim == x["d0"]) & (lab >= x["l0"]))
        return after & ((dim < x["d1"]) | ((dim == x["d1"]) & (lab <= x["l1"])))

    def met(asking: DataFrame, blocks: Column, base: DataFrame, positive: bool) -> DataFrame:
        """(anchor_id, id, score): the candidates of a block stay in one task; the anchors stream past them."""
        windows = F.array().cast("array<long>")
        own = base.select("block", F.lit(0).alias("asks"), "dim", "vec_id", "label", "wide", "data", windows.alias("tops"), windows.alias("bars"))
        tops, bars = ("tops", "bars") if not positive else (windows.alias("tops"), windows.alias("bars"))
        ask = asking.select(F.explode(blocks).alias("block"), F.lit(1).alias("asks"), "dim", "vec_id", "label", "wide", "data", tops, bars)
        # the most anchors come to a block; the fewest bytes are moved with them
        joined = own.unionByName(ask).repartition("block").sortWithinPartitions("block", "dim", "asks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, pieces, x = None, [], None
            for key, asks, c in _runs(batches):
                if not asks:
                    pieces, x, held = [*(pieces if held == key else []), c], None, key
                elif held == key:
                    if x is None:
                        x = _side(pieces)
                    q = _side([c])
                    if positive:
                        found = positives_of(q, x, positives)
                    else:
                        found = negatives_of(q, _square(c[4], positives, -_BOUND), _square(c[5], positives, _BOUND), x, negatives)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(q.ids[found[0]]), pa.array(found[1]), pa.array(found[2])], names=["anchor_id", "id", "score"])

        return joined.mapInArrow(run, "anchor_id long, id long, score long")

    same = F.transform(F.filter(table, lambda x: holds(F.col("dim"), F.col("label"), x)), lambda x: x["block"])
    first = met(anchors, same, laid, True).withColumn("kind", F.lit(0).cast("byte"))
    best = staged(first.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "id").mapInArrow(_first(positives), "anchor_id long, id long, score long, kind byte"), "positives")

    tops = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), lambda x: -x["s"])  # at most ``positives`` of an anchor
    opened = best.groupBy("anchor_id").agg(tops.alias("tops"))
    asking = anchors.join(opened, anchors["vec_id"] == opened["anchor_id"])
    least = F.transform("tops", lambda p: F.ceil(F.lit(percent).cast("decimal(38,0)") * p / 100).cast("long"))
    asking = staged(asking.select("vec_id", "label", "dim", "wide", "data", "tops", least.alias("bars")), "asking")

    def sifted(positive: DataFrame, negative: DataFrame) -> DataFrame:
        """The secondary sort: rows by (anchor, descending score, positives first, id), and the iterator over them."""
        packed = positive.select("anchor_id", "id", "score", "kind").unionByName(negative.withColumn("kind", F.lit(1).cast("byte")))
        ordered = packed.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "kind", "id")
        return ordered.mapInArrow(_windows(negatives, percent), _OUT)

    def blocks_of(some: Column) -> Column:
        return F.transform(F.filter(table, lambda x: within(F.col("dim"), x) & some(x)), lambda x: x["block"])

    tasted = staged(met(asking, blocks_of(lambda x: x["block"] % FIRST == 0), laid.where(F.col("block") % FIRST == 0), False), "first_blocks")
    raised = _raised(asking, sifted(best, tasted), negatives)
    rest = met(raised, blocks_of(lambda x: x["block"] % FIRST != 0), laid.where(F.col("block") % FIRST != 0), False)
    return sifted(best, tasted.unionByName(rest))


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _square(lists: list[list[int]], width: int, fill: int) -> np.ndarray:
    return np.array([[*x, *[fill] * (width - len(x))] for x in lists], np.int64).reshape(len(lists), width)


def _side(pieces: list[tuple]) -> Side:
    return Side(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), [d for p in pieces for d in p[3]], np.concatenate([p[2] for p in pieces]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, tuple]]:
    """Neighbouring rows of a batch with one (block, dim) and one side: key, side, and their columns."""
    for batch in batches:
        block, asks, dim = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks) != 0) | (np.diff(dim) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if a < b:
                part = batch.slice(a, b - a)
                ids, labels = part.column(3).to_numpy(), part.column(4).to_numpy()
                wide, data = part.column(5).to_numpy(zero_copy_only=False), part.column(6).to_pylist()
                lists = [part.column(i).to_pylist() if asks[a] else [] for i in (7, 8)]
                yield (int(block[a]), int(dim[a])), int(asks[a]), (ids, labels, wide, data, *lists)


def _first(k: int):
    """Of rows ordered by anchor, the first k of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            kept = []
            for i, a in enumerate(batch.column(0).to_pylist()):
                seen = seen + 1 if a == last else 1
                last = a
                if seen <= k:
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def _raised(asking: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``asking`` with each window's bar raised to the last of its k negatives of the first blocks. Equal scores have equal windows."""
    full = found.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_set(F.struct("positive_score", "negative_score"))).alias("m"))
    joined = asking.join(full, asking["vec_id"] == full["anchor_id"], "left")
    new = F.transform(F.arrays_zip("tops", "bars"), lambda x: F.coalesce(F.element_at("m", x["tops"]), x["bars"]))
    return joined.select("vec_id", "label", "dim", "wide", "data", "tops", new.alias("bars"))


def _windows(k: int, percent: int):
    """Of rows ordered by (anchor, descending score, positives first, id): each positive's first k negatives in its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened = None, []  # [positive id, score, negatives so far]
        for batch in batches:
            out = []
            for anchor, other, score, kind in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if anchor != last:
                    last, opened = anchor, []
                if not kind:
                    opened.append([other, score, 0])
                    continue
                opened = [w for w in opened if w[2] < k and percent * w[1] <= 100 * score]  # scores fall: a window that is passed stays passed
                for w in opened:
                    if score <= w[1]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], other, w[1], score))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def shifted_label() -> Column:
    """The contract's labels: where 7 divides the id, the next one modulo 10."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(a.e, x.e) AS BIGINT) AS score FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same
), r AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score WHERE n <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""
