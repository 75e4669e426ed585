"""Bloom filters of a bounded size, built by Spark and broadcast: they spare shuffles, an exact step follows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.words import mix

#: Bits of a filter at most (a fixed bound of what is broadcast: 32 MB), and bits per key below that.
#: A full filter passes more than it should; what it passes is checked exactly.
FILTER_BITS = 1 << 28
BITS_PER_KEY = 16

_U = np.uint64


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of every key in a filter of a power of two bits."""
    one, two = mix(keys + _U(7)), mix(keys + _U(13)) | _U(1)
    return [((one + _U(i) * two) & _U(bits - 1)).astype(np.int64) for i in range(3)]


class KeyFilter:
    """Which 64-bit keys may be in ``keys``; use in tasks."""

    def __init__(self, keys: DataFrame, key: Column, count: int):
        bits = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (count * BITS_PER_KEY).bit_length()))

        def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                here = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                spots = np.concatenate(_places(here, bits))
                marks = np.left_shift(_U(1), (spots & 63).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spots >> 6), pa.array(marks)], ["slot", "bit"])

        cells = keys.select(key.alias("key")).mapInArrow(place, "slot bigint, bit bigint").groupBy("slot").agg(F.bit_or("bit").alias("bits"))
        table = np.zeros(bits >> 6, np.int64)
        for batch in cells.toArrow().to_batches():
            table[batch.column("slot").to_numpy()] = batch.column("bits").to_numpy()
        self.bits = bits
        self.table = keys.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        table, found = self.table.value, np.ones(len(keys), bool)
        for spots in _places(keys, self.bits):
            found &= (table[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 == 1
        return found
