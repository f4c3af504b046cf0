"""Words and hashes of whole texts, inside tasks.

Texts are handled as UTF-8 bytes: ``bytes.lower`` folds A-Z alone, and ``bytes.split`` cuts at
x20 and x09-x0D alone, which is just what the contracts of the word operators say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries and bytes of keys of a per-process cache before it is dropped and filled anew, and the longest key that is kept.
CACHE, CACHE_BYTES, LONGEST = 400_000, 1 << 25, 256
#: Hashes that stay in a worker between tasks: some 12 MB.
KEPT = 1 << 16


#: Bytes of texts that travel to a Python worker at once, rows whose texts it holds as strings at once, and rows that Spark's
#: Parquet reader decodes at once.
BATCH_BYTES, PIECE, READ_ROWS = 1 << 22, 64, 512


def bounded(spark: SparkSession) -> None:
    """Bounds a batch of texts by BATCH_BYTES and READ_ROWS, where the session sets no bounds of its own; the settings stay in the session.

    By default a batch has 10000 rows, however long: executor and worker would each hold several copies of some 20 MB, and
    more where texts are long. One text longer than the bound is a batch of its own. The reader's batches have 4096 rows by
    default: some 8 MB in one array, which the executor's heap grows for.
    """
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(most))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to PIECE rows: a worker holds no more texts than these as strings, however many rows a batch has."""
    for whole in batches:
        for at in range(0, whole.num_rows, PIECE):
            yield whole.slice(at, PIECE)


def raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Words between white space, with A-Z lower-cased."""
    return raw(text).lower().split()


class Hashes(dict):
    """64-bit hash of a word; the same in every process."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = h
        return h


HASHES = Hashes()


def hashed(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, ws), np.uint64, len(ws))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes (none if there are fewer than ``k``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= h[i : i + n]
        out ^= out >> np.uint64(32)
    return mixed(out)


def row_key(df: DataFrame) -> Column:
    """A 128-bit hash of all of a row's columns: what a decision on the row is joined back by. Equal rows share it; nulls count.

    Maps count as their sorted entries. Values with maps further inside count as JSON: such rows with equal maps in another order
    may be taken for different rows, never different ones for equal.
    """
    marks = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name.replace('`', '``')}`")
        value = c
        if "map<" in kind:
            value = F.array_sort(F.map_entries(c)) if kind.startswith("map<") and kind.count("map<") == 1 else F.to_json(F.struct(c))
        marks += [c.isNull(), value]  # a null alone leaves the hash as it is
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *marks)), 16, "0") for seed in (0, 1)]
    return F.unhex(F.concat(*halves))
