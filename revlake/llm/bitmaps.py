"""Bitmaps of fixed size over 64-bit hashes: they let all members of a set pass, and few others.

A bitmap is small enough to broadcast whatever the size of the set; what passes
still goes through an exact join. While few of its bits are set only these are
sent: a broadcast value is a file on the driver and on every executor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The words of a bitmap, or how many it has and where which of them are not zero.
Packed = np.ndarray | tuple[int, np.ndarray, np.ndarray]


def bitmap(hashes: DataFrame, column: str, log: int) -> Packed:
    """2 to the ``log`` bits, of which each hash sets the one that its upper bits name."""
    bit = F.shiftrightunsigned(column, 64 - log)
    rows = hashes.select(bit.alias("_bit")).select(
        F.shiftright("_bit", 6).alias("at"), F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("bits")
    )
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    few = 1 << (log - 6), found.column("at").to_numpy().astype(np.uint32), found.column("bits").to_numpy().view(np.uint64)
    # A place takes half a word.
    return few if 3 * len(few[1]) < 2 * few[0] else unpacked(few)


def unpacked(packed: Packed) -> np.ndarray:
    """All words of a bitmap. Those that are zero take no memory until a task writes them."""
    if isinstance(packed, np.ndarray):
        return packed
    size, at, bits = packed
    out = np.zeros(size, np.uint64)
    out[at] = bits
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) hashes have their bit set."""
    log = int(len(bits)).bit_length() - 1 + 6
    bit = hashes >> np.uint64(64 - log)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
