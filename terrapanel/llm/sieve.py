"""A cheap test for membership in a set of 64-bit hashes, as a column expression that may stand inside lambdas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.session import store

MOST = 1 << 20  # bytes of the table
_ROOM = 64  # slots for each hash, while that fits
_BYTES = [bytes((x >> b) & 1 for b in range(8)) for x in range(256)]


def _slots(h: Column, size: int) -> tuple[Column, Column]:
    return h.bitwiseAND(F.lit(size - 1).cast("bigint")), F.shiftright(h, 32).bitwiseAND(F.lit(size - 1).cast("bigint"))


def sieve(hashes: DataFrame, col: str, in_lambdas: bool = True) -> Callable[[Column], Column]:
    """A test that every value of `hashes.col` passes, and few others: one in 1,000 or less while the set is small.

    The table has MOST bytes at most, whatever the set's size; a set too large
    for it makes a test that lets more through. So callers still join exactly,
    and only the number of rows they shuffle depends on it. What reaches the
    driver is bitmaps of MOST bytes in all.

    A literal is written out in full in each description of a plan that names it,
    and Spark keeps those. With `in_lambdas` false the table is a scalar subquery
    over a stored row instead, which lambdas must not hold. A slot is then a bit
    and not a byte, so that eight times as many hashes fit.
    """
    most = MOST if in_lambdas else 8 * MOST
    n = hashes.agg(F.approx_count_distinct(col)).first()[0]
    if n == 0:
        return lambda h: F.lit(False)
    if n >= most // 2:
        return lambda h: F.lit(True)
    size = min(most, 1 << max(16, (_ROOM * n - 1).bit_length()))
    slots = F.explode(F.array(*[s + 1 for s in _slots(F.col(col), size)]))
    bitmaps = hashes.select(slots.alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("b")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
    table = bytearray(size if in_lambdas else size // 8)
    for b, bits in bitmaps.collect():
        part = b"".join(map(_BYTES.__getitem__, bits)) if in_lambdas else bytes(bits)
        at = (b - 1) * len(part)
        table[at:at + len(part)] = part[: len(table) - at]
    if in_lambdas:
        known = F.lit(bytes(table))
        has = lambda s: F.substring(known, s.cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    else:
        words = np.frombuffer(table, "<i8").tolist()
        known = store(hashes.sparkSession.createDataFrame([(words,)], "t array<bigint>")).scalar()
        has = lambda s: F.getbit(F.get(known, F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1

    def test(h: Column) -> Column:
        one, two = map(has, _slots(h, size))
        return one & two

    return test
