"""A Bloom filter over a column of longs, put together by tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import mixed

#: Bits for each key, and at most: 32 MB. More keys than that only let more other keys through.
EACH, LEAST, MOST = 32, 1 << 20, 1 << 28
_CHUNK = 1 << 16


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys.view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def may_hold(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _slots(keys, 8 * len(filled))
    return ((filled[a >> 3] >> (a & 7)) & (filled[b >> 3] >> (b & 7)) & 1).astype(bool)


def built(keys: DataFrame, n: int) -> np.ndarray:
    """Bit map of the one long column of ``keys``, sized for ``n`` of them; at most MOST bits reach the driver, in chunks of 8 KB."""
    bits = min(max(1 << (EACH * max(n, 1) - 1).bit_length(), LEAST), MOST)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _slots(batch.column(0).drop_null().to_numpy(), bits):
                np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = own.reshape(-1, _CHUNK // 8)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([parts[c].tobytes() for c in some], pa.binary())], names=["chunk", "bits"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "group": [0], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    schema = "chunk long, group int, bits binary"
    # first by a salt, so that no task gets the chunks of all others
    once = keys.mapInArrow(mark, "chunk long, bits binary").withColumn("group", (F.spark_partition_id() % 64).cast("int"))
    parts = once.groupBy("chunk", "group").applyInPandas(joined, schema).groupBy("chunk").applyInPandas(joined, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row["chunk"] * _CHUNK // 8 :][: _CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out
