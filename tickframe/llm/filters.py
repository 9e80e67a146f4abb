"""A table of bits of fixed size that passes every named key and, while it is sparse, few others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25  # 4 MB, whatever the input


def place(key: Column) -> Column:
    """The bit of a 64-bit key."""
    return F.pmod(key, F.lit(BITS))


def bit_table(keys: DataFrame, key: Column) -> np.ndarray:
    """One bit per key, made from at most BITS / 64 rows."""
    at = place(key)
    words = keys.select(F.floor(at / 64).alias("w"), (at % 64).cast("int").alias("b")).groupBy("w").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b"))).alias("bits")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for w, bits in words:
        out[w] = bits
    return out.view(np.uint64)


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit key is set."""
    at = keys.view(np.uint64) & np.uint64(BITS - 1)
    return bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1
