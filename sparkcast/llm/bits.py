"""Tables of bits that tell which hashes can't have a partner, so that their rows stay out of a shuffle.

A table is sized by what it holds, 16 bits each, up to 32 MB. Beyond that it lets more and more rows pass, never too few: what passes is
always joined exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 16, 28  # logarithms of the bits of a table


def size_for(count: int) -> int:
    return min(MOST, max(LEAST, int(16 * count).bit_length()))


def build(hashes: DataFrame, count: int) -> np.ndarray:
    """The table of the one column of ``hashes``, which has about ``count`` rows. Spark sets the bits; the driver gets the table."""
    size = size_for(count)
    mask, h = (1 << size) - 1, F.col(hashes.columns[0])
    places = hashes.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - size))).alias("bit"))
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << size - 6, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the table; true for all that are."""
    u, size = hashes.view(np.uint64), len(table).bit_length() + 5
    low, high = u & np.uint64((1 << size) - 1), u >> np.uint64(64 - size)
    first = table[low >> np.uint64(6)] >> (low & np.uint64(63))
    return (first & (table[high >> np.uint64(6)] >> (high & np.uint64(63))) & np.uint64(1)).astype(bool)
