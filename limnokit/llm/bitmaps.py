"""Bitmaps of hashed keys: a filter of bounded size before a join.

A bitmap never has more than ``MOST_BITS`` bits, however many keys there are.
It only keeps rows out of a join that could not match; a full bitmap keeps none
out, and the join alone decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MiB.
MOST_BITS = 1 << 27


def bitmap_of(df: DataFrame, column: str, bits_per_key: int = 32) -> np.ndarray:
    """Bits set at the lowest bits of the hashed longs in ``column``, as an array of 64-bit words.

    At most ``MOST_BITS / 64`` rows reach the driver.
    """
    n = df.count()
    bits = min(MOST_BITS, 1 << max(12, (bits_per_key * n).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = (
        df.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the hashed ``keys`` may be among those of the bitmap."""
    slot = keys & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
