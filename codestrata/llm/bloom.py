"""A Bloom filter of 64-bit hashes, built by Spark and probed by numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bound of a filter (32 MB), however many hashes it holds; beyond about 2^24 of them it lets more through.
FILTER_BITS = 1 << 28
_U = np.uint64


def bloom_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of distinct hashes: two bits each, 16 bits a hash up to FILTER_BITS in all."""
    size = min(FILTER_BITS, max(1 << 12, 1 << int(16 * hashes.count()).bit_length()))
    h = F.col(column)
    places = hashes.select(F.explode(F.array(h.bitwiseAND(size - 1), F.shiftrightunsigned(h, 32).bitwiseAND(size - 1))).alias("p"))
    filled = places.groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("word")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[filled.column("at").to_numpy()] = filled.column("word").to_numpy()
    return out


def contains(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; those that are always show."""
    h, mask = hashes.view(np.uint64), _U(len(filter_) * 64 - 1)
    p, q = (h & mask).astype(np.int64), ((h >> _U(32)) & mask).astype(np.int64)
    return (filter_[p >> 6] >> (p & 63)) & (filter_[q >> 6] >> (q & 63)) & 1 != 0
