"""A bit array that admits every id of a table and few others, to drop rows before their texts are shuffled.

Its size follows the number of ids up to a fixed bound (MOST_BITS: 2 MiB). Beyond that it admits more rows in vain,
never fewer: an exact join always follows, so results do not depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.texts import mix

MOST_BITS = 1 << 24
_SALTS = (0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


def _bits(ids: np.ndarray, size: int) -> list[np.ndarray]:
    return [mix(ids.view(np.uint64) ^ np.uint64(s)) & np.uint64(size - 1) for s in _SALTS]


def members_filter(ids: DataFrame, n: int):
    """ids: one long column, without nulls, of about n distinct values. Returns ``admits(int64 array) -> bool array``."""
    spark = ids.sparkSession
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, (10 * max(n, 1)).bit_length()))

    def words(batches):
        seen = np.zeros(size // 64, np.uint64)
        for b in batches:
            for bit in _bits(b.column(0).to_numpy().astype(np.int64), size):
                np.bitwise_or.at(seen, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at].view(np.int64))], ["w", "v"])

    got = ids.mapInArrow(words, "w int, v long").groupBy("w").agg({"v": "bit_or"}).toDF("w", "v").toArrow()
    array = np.zeros(size // 64, np.uint64)
    array[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(array)

    def admits(values: np.ndarray) -> np.ndarray:
        ok = np.ones(len(values), bool)
        for bit in _bits(values.astype(np.int64), size):
            ok &= (shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return ok

    return admits
