"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks by a hash of their id. A block of candidates goes to one task, once; the blocks of
queries, a fixed share of the rows, are what is sent to every block of candidates and streams past it. In a tile both
sides are quantised to int8 with one scale a row. The int8 product gives every inner product up to a bound,
``|q| * |x - x8| + |q - q8| * |x8|``; a candidate whose upper bound is below the k-th lower bound can't be among the k
nearest. What survives is recomputed in double precision from the original vectors, and the tiles' lists are merged by
heaps, a fixed number of lists at a time. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.staging import staged

NEAREST, EVERY = 20, 20
#: Bytes of original vectors in a block of candidates, in a block of queries and in one row, lists merged at once, and the sides of a tile.
BLOCK_BYTES, LEAST_BYTES, QUERY_BYTES, ROW_BYTES, FAN, ASKED, MET = 1 << 25, 1 << 19, 1 << 18, 1 << 13, 16, 512, 4096


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what the codes leave out, norms of the coded vectors."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny
    codes = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(x - coded, axis=1), np.linalg.norm(coded, axis=1)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products. Up to 1040 products of int8 sum to less than 2**24, so float32 holds them exactly."""
    out = np.zeros((len(a), len(b)), np.float64 if a.shape[1] > 1040 else np.float32)
    for i in range(0, a.shape[1], 1040):
        out += a[:, i : i + 1040].astype(np.float32) @ b[:, i : i + 1040].astype(np.float32).T
    return out


class Side:
    """Rows of one side: ids, vectors and their codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.codes, self.scale, self.error, self.coded = quantised(self.vectors)
        self.norms = np.linalg.norm(self.vectors, axis=1)


def tile(q: Side, x: Side, k: int) -> Iterator[tuple[int, list[int], list[float]]]:
    """(query id, ids, scores) of the k nearest in a block, nearest first, ties to the smaller id."""
    for i in range(0, len(q.ids), ASKED):
        asked, found = slice(i, i + ASKED), []
        bar = np.full(len(q.ids[asked]), -np.inf)  # k candidates of one tile have a lower bound of at least this
        for j in range(0, len(x.ids), MET):
            met = slice(j, j + MET)
            near = int8_product(q.codes[asked], x.codes[met]) * q.scale[asked, None] * x.scale[None, met]
            error = (q.norms[asked, None] * x.error[None, met] + q.error[asked, None] * x.coded[None, met]) * (1 + 1e-9) + 1e-12 * q.norms[asked, None] * x.coded[None, met]
            near[q.ids[asked, None] == x.ids[None, met]] = -np.inf
            if near.shape[1] > k:
                bar = np.maximum(bar, np.partition(near - error, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
            rows, columns = np.nonzero((near + error >= bar[:, None]) & (near > -np.inf))
            scores = np.zeros(len(rows))
            for at in range(0, len(rows), 1 << 16):
                part = slice(at, at + (1 << 16))
                a, b = q.vectors[i + rows[part]], x.vectors[j + columns[part]]
                for c in range(a.shape[1]):  # in the order of components, so equal vectors have equal scores
                    scores[part] += a[:, c] * b[:, c]
            found = _best([*found, (rows, x.ids[j + columns], scores)], len(bar), k)
        for rows, ids, scores in found:
            first = np.searchsorted(rows, np.arange(len(bar) + 1))
            for n, query in enumerate(q.ids[asked].tolist()):
                if first[n] < first[n + 1]:
                    yield query, ids[first[n] : first[n + 1]].tolist(), scores[first[n] : first[n + 1]].tolist()


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best (row, id, score) of each of ``n`` rows, in order."""
    rows, ids, scores = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows] < k
    return [(rows[kept], ids[order][kept], scores[order][kept])]


def needed(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block, ids ascending, of which any query can need one: of equal vectors the k + 1 least ids, as ties go to those."""
    _, kind = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    place = np.arange(len(ids)) - np.searchsorted(kind[order], kind[order])
    return np.sort(order[place <= k])


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v, dim) of the rows with an id and a vector that is finite throughout and not all zero."""
    kind = "array<float>" if "float" in vectors.schema[column].dataType.simpleString() else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, column: str = "embedding", k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """The ``k`` rows of largest inner product for each row of ``vectors(vec_id, <column>)`` whose id ``every`` divides.

    Gives query_id, rank (from 1), vec_id, score. Rows without an id, and vectors that are null, empty, zero or hold
    null, NaN or infinity, take no part. Vectors of different lengths are not compared. An id met several times
    counts once, with its least vector. Ties go to the smaller id. A query without candidates has no row.
    """
    clean = usable(vectors, column)
    code = "<f4" if clean.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    width = 4 if code == "<f4" else 8
    queries = (F.col("vec_id") % every) == 0
    volume = clean.agg(F.sum(F.col("dim") * width).alias("all"), F.sum(F.when(queries, F.col("dim") * width)).alias("asked")).first()
    # smaller blocks where whole ones would leave cores without work; never under LEAST_BYTES
    every_core = min(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-int(volume["all"] or 0) // LEAST_BYTES))
    blocks, asked = max(1, every_core, -(-int(volume["all"] or 0) // BLOCK_BYTES)), max(1, -(-int(volume["asked"] or 0) // QUERY_BYTES))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy("<i8")
        order = np.argsort(ids)
        data = np.stack(pdf["v"].to_list()).astype(code)[order]
        if not pdf["asks"].iloc[0]:
            kept = needed(ids[order], data, k)
            order, data = order[kept], data[kept]
        ids, step = ids[order], max(1, ROW_BYTES // (width * data.shape[1]))
        cut = [slice(i, i + step) for i in range(0, len(ids), step)]
        row = pdf[["asks", "dim", "block"]].iloc[:1]
        return pd.concat([row] * len(cut)).assign(ids=[ids[c].tobytes() for c in cut], data=[data[c].tobytes() for c in cut])

    # an id met several times: its least vector
    once = clean.groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    both = once.withColumn("asks", F.explode(F.when(queries, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    block = F.pmod(F.xxhash64("vec_id"), F.when(F.col("asks"), F.lit(asked)).otherwise(F.lit(blocks))).cast("int")
    shape = "asks boolean, dim int, block int, ids binary, data binary"
    laid = staged(both.withColumn("block", block).groupBy("asks", "dim", "block").applyInPandas(packed, shape), "blocks")
    base = laid.where("not asks").withColumn("part", F.lit(-1))
    ask = laid.where("asks").withColumnRenamed("block", "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = base.unionByName(ask).select("dim", "block", "part", "ids", "data").repartition("dim", "block").sortWithinPartitions("dim", "block", "part")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray]]:
        """Neighbouring rows of a batch that belong to the same part: its key, ids and vectors."""
        for batch in batches:
            keys = list(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True))
            blobs, at = [batch.column(j).to_pylist() for j in (3, 4)], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                ids, data = (b"".join(b[at:end]) for b in blobs)
                yield keys[at], np.frombuffer(ids, "<i8"), np.frombuffer(data, code).reshape(-1, keys[at][0])
                at = end

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces, x = None, [], None
        for (dim, block, part), ids, data in runs(batches):
            if part < 0:
                pieces, x = [*(pieces if held == (dim, block) else []), (ids, data)], None
                held = dim, block
            elif held == (dim, block):
                if x is None:
                    x = Side(*(np.concatenate(c) for c in zip(*pieces, strict=True)))
                got = list(tile(Side(ids, data), x, k))
                if got:
                    n = len(got)
                    columns = [pa.array([dim] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([block // FAN] * n, pa.int32())]
                    columns += [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "part", "block", "query_id", "ids", "scores"])

    schema = "dim int, part int, block int, query_id long, ids array<long>, scores array<double>"
    lists = tiles.mapInArrow(multiply, schema)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, rows in pdf.groupby("query_id"):
            heap = heapq.merge(*([(-s, i) for i, s in zip(a, b, strict=True)] for a, b in zip(rows["ids"], rows["scores"], strict=True)))
            top = [x for _, x in zip(range(k), heap, strict=False)]
            out.append((query, [i for _, i in top], [-s for s, _ in top]))
        first = pdf.iloc[0]
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"]).assign(dim=first["dim"], part=first["part"], block=first["block"] // FAN)[["dim", "part", "block", "query_id", "ids", "scores"]]

    left = -(-blocks // FAN)
    lists = lists.groupBy("dim", "part", "block").applyInPandas(merge, schema)
    while left > 1:
        left = -(-left // FAN)
        lists = lists.groupBy("dim", "part", "block").applyInPandas(merge, schema)
    ranked = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.ids").alias("vec_id"), F.col("col.scores").alias("score"))


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
