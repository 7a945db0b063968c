"""Null placement, fallbacks and null-aware arithmetic.

NULL sorts last in both directions everywhere in this library, division by
zero gives NULL, and sums state whether an all-NULL input is 0 or NULL.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def asc_last(c: Column | str) -> Column:
    return as_col(c).asc_nulls_last()


def desc_last(c: Column | str) -> Column:
    return as_col(c).desc_nulls_last()


def safe_ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """`num / den * scale`, NULL unless the denominator is positive."""
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    ratio = n / d if scale == 1.0 else n * F.lit(float(scale)) / d
    return F.when(d > 0, ratio)


def ratio_or_null(num: Column | str, den: Column | str) -> Column:
    """`num / den`, NULL only where the denominator is zero or NULL."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def sum0(*cols: Column | str) -> Column:
    """Row-wise sum in which NULL counts as zero."""
    return reduce(add, [F.coalesce(as_col(c), F.lit(0.0)) for c in cols])


def add_cols(*cols: Column | str) -> Column:
    """Row-wise sum in which NULL makes the result NULL."""
    return reduce(add, [as_col(c) for c in cols])


def first_available(*cols: Column | str) -> Column:
    return F.coalesce(*[as_col(c) for c in cols])


def null_if(c: Column | str, bad: Column) -> Column:
    """NULL where the predicate `bad` holds (sentinels, negatives, blanks)."""
    return F.when(~F.coalesce(bad, F.lit(False)), as_col(c))


def try_double(c: Column | str) -> Column:
    return as_col(c).try_cast("double")


def finite(c: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    x = as_col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


# ---- aggregates -----------------------------------------------------------

def sum_na0(c: Column | str) -> Column:
    """Sum over a group, 0 when every value is NULL."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0.0))


def weighted_mean(x: Column | str, w: Column | str, null_weight: str = "zero") -> Column:
    """Weighted mean that skips NULL values of `x`.

    A NULL weight beside a known `x` counts as zero, or, with
    `null_weight="propagate"`, makes the whole result NULL.
    """
    x, w = as_col(x).cast("double"), as_col(w).cast("double")
    known = x.isNotNull()
    mean = F.try_divide(F.sum(F.when(known, x * w)), F.sum(F.when(known, w)))
    if null_weight == "zero":
        return mean
    if null_weight == "propagate":
        return F.when(F.count(F.when(known & w.isNull(), F.lit(1))) == 0, mean)
    raise ValueError(f"null_weight must be 'zero' or 'propagate', not {null_weight!r}")


def safe_weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Weighted mean with NULL weights as zero, falling back to the plain mean
    when the weights of the known values add up to nothing."""
    x = as_col(x).cast("double")
    w = F.coalesce(as_col(w).cast("double"), F.lit(0.0))
    total = F.sum(F.when(x.isNotNull(), w))
    return F.when(total > 0, F.sum(x * w) / total).otherwise(F.avg(x))


# ---- joins ----------------------------------------------------------------

def null_safe_join(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Join on `keys` where NULL equals NULL; keeps the left copy of the keys."""
    keys = list(keys)
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__r_{k}"]) for k in keys])
    return left.join(right, cond, how).drop(*[f"__r_{k}" for k in keys])
