"""Benchmark decontamination by winnowing.

A window is ``size`` consecutive words of an item (an item with fewer words is one window). Of each window of
words the least hash of its ``k``-grams is its fingerprint, so every shared span of a window's length has the
same fingerprint on both sides. Document windows whose fingerprint may be in the benchmark (a Bloom filter) are joined
with the benchmark's on the fingerprint and extended to the whole window. A window is joined once, whatever the number of
items it stands in; items come in by the sets of items that windows have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.rows import keyed, settled
from tessera.llm.text import grams, hashed, mixed, raw
from tessera.staging import staged

SIZE, GRAM = 10, 5
#: Copies of the benchmark's windows that the documents' are dealt over, as one window may be in a third of all documents.
SALTS = 8

_FOLD = bytes(
    32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return raw(text).translate(_FOLD).split()


def windows(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and whole hash of each window of ``size`` words."""
    k = min(GRAM, size)
    g, n = grams(h, k), len(h) - size + 1
    if n <= 0:
        return g[:0], g[:0]
    least = g[:n].copy()
    for i in range(1, size - k + 1):
        np.minimum(least, g[i : i + n], out=least)
    return mixed(least + np.uint64(size)), grams(h, size)


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, size, fp, win) of every window of ``items(item_id, text)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, fps, wins = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = hashed(item_words(text))
                if len(h):
                    fp, win = windows(h, s := min(size, len(h)))
                    ids += [item] * len(fp)
                    sizes += [s] * len(fp)
                    fps.append(fp)
                    wins.append(win)
            if ids:
                columns = [pa.array(ids, batch.schema.field(0).type), pa.array(sizes, pa.int32())]
                columns += [pa.array(np.concatenate(x).view(np.int64)) for x in (fps, wins)]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "size", "fp", "win"])

    of = items.select("item_id", F.col("text").cast("string").alias("text"))
    return of.mapInArrow(cut, f"item_id {of.schema['item_id'].dataType.simpleString()}, size int, fp long, win long").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, *carried: str) -> DataFrame:
    """What of each document of ``docs(doc_id, text)`` lies in windows of ``items(item_id, text)``.

    Gives doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of ``docs``, repeated
    ids included. Null, empty or wordless texts have 0 words. Items without words have no window; a null item id
    can hit words but is not listed. Repeated items count once. Other columns are not looked at; those named are carried along.
    """
    each = staged(item_windows(items, size), "item-windows")
    # windows with the same items share a number: a text that holds one of them holds those items
    bench = each.groupBy("size", "fp", "win").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    bench = staged(bench.withColumn("of", F.xxhash64("items")), "benchmark-windows")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most `size` values
    context = docs.sparkSession.sparkContext
    filled = context.broadcast(bloom.built(bench.select("fp"), bench.count()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int32()), ("fp", pa.int64()), ("win", pa.int64())]))
        for batch in batches:
            rows, counts, found = [], [], []
            for text in batch.column(1).to_pylist():
                h = hashed(item_words(text))
                own = []
                for s in sizes:
                    fp, win = windows(h, s)
                    at = np.flatnonzero(bloom.may_hold(filled.value, fp.view(np.int64)))
                    if len(at):
                        own += [{"size": s, "start": x, "fp": y, "win": z} for x, y, z in zip(at.tolist(), fp[at].view(np.int64).tolist(), win[at].view(np.int64).tolist(), strict=True)]
                rows.append(row)
                counts.append(len(h))
                found.append(own)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), *batch.columns[2:]], names=["row", "doc_id", "n_words", "found", *carried])

    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in of.schema[2:])
    scanned = staged(of.mapInArrow(scan, "row long, doc_id long, n_words long, found array<struct<size:int,start:int,fp:long,win:long>>" + more), "document-windows")
    salt, salts = F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"), F.explode(F.array(*map(F.lit, range(SALTS))).cast("array<long>")).alias("salt")
    hits = scanned.select("row", salt, F.explode("found").alias("x")).select("row", "salt", "x.*")
    hits = hits.join(bench.select("fp", "size", "win", "of", salts), ["fp", "size", "win", "salt"])
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "size"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    per_row = hits.groupBy("row").agg(covered.alias("n_hit"), F.collect_set("of").alias("of"))
    sets = bench.select("of", "items").dropDuplicates(["of"]).select("of", "items", salts)
    named = per_row.select("row", salt, F.explode("of").alias("of")).join(sets, ["of", "salt"]).select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_row = per_row.drop("of").join(named, "row", "left")
    none = F.array().cast("array<string>")
    return scanned.select("row", "doc_id", "n_words", *carried).join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        *carried,
    )


def decontaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without the rows whose text holds a window of ``items``; each row by its own text, whatever its id.

    A null text and an empty table of items drop nothing. An empty table gives no rows; other columns are kept.
    """
    rows, key = keyed(docs)
    bad = contamination(rows, items, size, key).where("contaminated")
    return settled(rows, key, bad.groupBy(F.col(key).alias("key")).agg(F.lit(False).alias("once"), F.count("*").alias("many")))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, s, array_to_string(w[i:i + s - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS s, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, i, array_to_string(w[i:i + s - 1], ' ') AS win
  FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM bw) WHERE len(w) >= s)
), hit AS (
  SELECT doc_id, i, s, item_id FROM dw JOIN bw USING (s, win)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM hit) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
