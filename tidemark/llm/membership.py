"""Fixed-size membership filters, built by Spark and sent to the executors.

A filter has no false negatives. Its size follows the number of keys but never
exceeds ``2 ** max_log2`` bits, so it can be broadcast whatever the corpus; with
more keys it only lets more through. Callers use it to leave out early what a
later exact step would leave out anyway.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 ** 27 bits are 16 MB.
MAX_LOG2 = 27
_CHUNK_LOG2 = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit keys."""
    x = keys.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Bits:
    """A filter over 64-bit keys."""

    def __init__(self, log2: int, data: bytes):
        self.log2 = log2
        self.data = np.frombuffer(data, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mixed(keys) >> np.uint64(64 - self.log2)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_of(df: DataFrame, column: str, max_log2: int = MAX_LOG2) -> tuple[int, bytes]:
    """Size (as a power of two) and bits of the filter of a long column; nulls are passed over."""
    keys = df.select(F.col(column).cast("long").alias("k")).where("k is not null")
    log2 = min(max_log2, max(_CHUNK_LOG2, math.ceil(math.log2(16 * max(keys.count(), 1)))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(mixed(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - log2)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> _CHUNK_LOG2).astype(np.int32)), pa.array((at & ((1 << _CHUNK_LOG2) - 1)).astype(np.int32))], names=["chunk", "bit"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _CHUNK_LOG2, np.uint8)
        bits[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    size = 1 << (_CHUNK_LOG2 - 3)
    data = bytearray(1 << (log2 - 3))
    packed = keys.mapInArrow(places, "chunk int, bit int").distinct().groupBy("chunk").applyInPandas(pack, "chunk int, bits binary")
    for r in packed.collect():  # at most 2 ** max_log2 bits
        data[r["chunk"] * size : (r["chunk"] + 1) * size] = r["bits"]
    return log2, bytes(data)
