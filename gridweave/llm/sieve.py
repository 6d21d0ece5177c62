"""Finding the rows whose key is in another table, without moving those whose key isn't.

The keys are counted. Up to MOST_KEYS a bitmap of their hashes, of 8 to 16 bits a key, is OR-ed together
before the shuffle and broadcast; it clears most other rows where they are read, and lets a tenth of them
through. Beyond, rows meet the keys by equi-join, which has no such limit. Callers get the same results
either way: what a sieve lets through in excess they drop by an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import columns_of, filtered

#: Keys up to which the bitmap, of 32 MB then, is broadcast.
MOST_KEYS = 1 << 25
LEAST_BITS = 1 << 16


class Sieve:
    """keys: a written table with the column `column`. hashed: the keys are 64-bit hashes themselves."""

    def __init__(self, keys: DataFrame, column: str, hashed: bool = False):
        self.keys, self.column, self.hashed, self.bitmap, self.bits = keys.select(column), column, hashed, None, 0
        n = keys.count()
        if n <= MOST_KEYS:
            self.bits = max(LEAST_BITS, 1 << max(0, 8 * n - 1).bit_length())
            words = keys.select(self.slot(column).alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
            # at most 8 * MOST_KEYS / 64 rows of two numbers
            rows = words.agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("b")).toArrow()
            out = np.zeros(self.bits // 64, np.int64)
            out[rows["w"].to_numpy()] = rows["b"].to_numpy()
            self.bitmap = keys.sparkSession.sparkContext.broadcast(out.tobytes())

    def slot(self, column: str):
        """The bit of a key; only with a bitmap."""
        key = F.col(column)
        return F.pmod(key if self.hashed else F.xxhash64(F.lit(5), key), F.lit(self.bits))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these hashed keys, or bits of keys, may be in the table; only with a bitmap."""
        return _hits(np.frombuffer(self.bitmap.value, np.int64), hashes % self.bits)

    def _sieved(self, rows: DataFrame, column: str, wanted: bool) -> DataFrame:
        return filtered(rows, _sift(self.bitmap, len(rows.columns), wanted), self.slot(column))

    def maybe(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose key may be in the table."""
        if self.bitmap is not None:
            return self._sieved(rows, column, True)
        return rows.join(self.keys.withColumnRenamed(self.column, column), column, "left_semi").select(*columns_of(rows))

    def surely_not(self, rows: DataFrame, column: str) -> DataFrame:
        """The other rows."""
        if self.bitmap is not None:
            return self._sieved(rows, column, False)
        return rows.join(self.keys.withColumnRenamed(self.column, column), column, "left_anti").select(*columns_of(rows))

    def __getstate__(self):  # tasks need the bitmap, not the table
        return {"bitmap": self.bitmap, "bits": self.bits}


def _hits(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return ((bitmap[slot >> 6] >> (slot & 63)) & 1).astype(bool)


def _sift(bitmap, at: int, wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.int64)
        for batch in batches:
            hit = _hits(bits, batch.column(at).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit == wanted)).select(list(range(at)))

    return run
