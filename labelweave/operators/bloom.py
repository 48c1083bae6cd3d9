"""Bloom filters of a key column, built and probed with built-in functions only.

A filter is sized from a count of the distinct keys for a stated false-positive rate. Every key sets ``k`` bits by
double hashing of two JVM-side xxhash values, ``(h1 mod m + i * (h2 mod (m - 1) + 1)) mod m``; the bits are combined
per 64-bit word by ``bit_or`` in Spark, so no task holds more than its part, and only the non-zero words reach the
driver. The probe reads the filter as one binary literal and tests the ``k`` bits of each row's key with built-in
functions, so the scan stays in the JVM and no column goes to Python. Filters over ``MAX_FILTER_BYTES`` are not made;
callers then decide by their exact join alone, with the same result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rate of false positives a filter is sized for, and the largest filter that is assembled and sent with the plan.
FALSE_POSITIVES = 0.01
MAX_FILTER_BYTES = 4 << 20
SALT = "bloom"


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(SALT), key)


def _position(key: Column, i: Column, n_bits: int) -> Column:
    """Bit ``i`` of a key: double hashing, in ranges where long arithmetic cannot overflow."""
    h1, h2 = key_hashes(key)
    first, step = F.pmod(h1, F.lit(n_bits)), F.pmod(h2, F.lit(n_bits - 1)) + 1
    return F.pmod(first + i.cast("long") * step, F.lit(n_bits))


@dataclass(frozen=True)
class BloomFilter:
    n_bits: int
    n_hashes: int
    words: np.ndarray  # uint64, n_bits / 64 of them; bit p is bit p % 64 of word p // 64

    @staticmethod
    def shape(n_keys: int, rate: float = FALSE_POSITIVES) -> tuple[int, int]:
        """Bits (a multiple of 64) and hash count of a filter for ``n_keys`` keys at ``rate``."""
        n_keys = max(1, n_keys)
        bits = math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2)
        bits = 64 * math.ceil(bits / 64)
        return bits, max(1, round(bits / n_keys * math.log(2)))

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The bits of keys by their two hashes, one column per hash function, as the probe computes them."""
        first = np.mod(h1.astype(np.int64), self.n_bits)
        step = np.mod(h2.astype(np.int64), self.n_bits - 1) + 1
        return np.mod(first[:, None] + np.arange(self.n_hashes)[None, :] * step[:, None], self.n_bits)

    def might_contain(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.positions(h1, h2)
        return ((self.words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)

    def literal(self) -> Column:
        """The bits as one binary literal: bit p is bit p % 8 of byte p // 8."""
        return F.lit(bytearray(self.words.astype("<u8").tobytes()))


def build(keys: DataFrame, key: str, rate: float = FALSE_POSITIVES) -> BloomFilter | None:
    """A filter of the distinct non-null values of ``key``, or None if it would be over ``MAX_FILTER_BYTES``."""
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()
    n_bits, n_hashes = BloomFilter.shape(distinct.count(), rate)
    if n_bits // 8 > MAX_FILTER_BYTES:
        return None
    exploded = distinct.select(key, F.explode(F.sequence(F.lit(0), F.lit(n_hashes - 1))).alias("i"))
    spots = exploded.select(_position(F.col(key), F.col("i"), n_bits).alias("p"))
    words = spots.groupBy((F.col("p") / 64).cast("long").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS INT))")).alias("bits")
    )
    filled = np.zeros(n_bits // 64, dtype=np.uint64)
    for row in words.collect():  # n_bits / 64 rows at most, within MAX_FILTER_BYTES
        filled[row["word"]] = np.array([row["bits"]], dtype=np.int64).view(np.uint64)[0]
    return BloomFilter(n_bits, n_hashes, filled)


def maybe_in(key: Column, bloom: BloomFilter) -> Column:
    """Whether all bits of ``key`` are set, by built-in functions over the binary literal of the filter."""
    bits = bloom.literal()

    def set_at(i: Column) -> Column:
        p = _position(key, i, bloom.n_bits)
        byte = F.conv(F.hex(F.substr(bits, (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (byte / F.pow(F.lit(2), p % 8)).cast("int") % 2 == 1

    return F.forall(F.sequence(F.lit(0), F.lit(bloom.n_hashes - 1)), set_at)


def probe(df: DataFrame, key: str, bloom: BloomFilter | None) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in the filter, all of them without a filter. Null keys never pass."""
    present = df.where(F.col(key).isNotNull())
    return present if bloom is None else present.where(maybe_in(F.col(key), bloom))
