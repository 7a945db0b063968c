"""Operators along time within one entity.

A series holds one row per period, so its length is bounded by the number of
periods; plain windows partitioned by entity are used throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.functions.nulls import asc_last, safe_ratio


def lag_of(value: Column | str, keys: Sequence[str], time: str, h: int, mode: str = "row") -> Column:
    """Value `h` rows (mode "row") or exactly `h` periods (mode "calendar") earlier."""
    c = F.col(value) if isinstance(value, str) else value
    if mode == "row":
        return F.lag(c, h).over(Window.partitionBy(*keys).orderBy(asc_last(time)))
    if mode == "calendar":
        return F.max(c).over(Window.partitionBy(*keys).orderBy(F.col(time).cast("bigint")).rangeBetween(-h, -h))
    raise ValueError(f"mode must be 'row' or 'calendar', not {mode!r}")


def growth(df: DataFrame, keys: Sequence[str], time: str, value: str, horizons: Sequence[int] = (1, 3, 5, 10), *,
           prefix: str | None = None, mode: str = "row", cagr: Sequence[int] | None = None) -> DataFrame:
    """Add `<prefix>_growth_<h>yr` and `<prefix>_cagr_<h>yr`, NULL unless the
    earlier value is positive. `cagr` lists the horizons for the annual rate."""
    p = prefix or value
    cagr = horizons if cagr is None else cagr
    spans = sorted({*horizons, *cagr})
    out = df.withColumns({f"__lag{h}": lag_of(value, keys, time, h, mode) for h in spans})
    v = F.col(value).cast("double")
    new = {f"{p}_growth_{h}yr": safe_ratio(v - F.col(f"__lag{h}"), f"__lag{h}") for h in horizons}
    new |= {f"{p}_cagr_{h}yr": F.when(F.col(f"__lag{h}") > 0, F.pow(v / F.col(f"__lag{h}"), F.lit(1.0 / h)) - 1)
            for h in cagr}
    return out.withColumns(new).drop(*[f"__lag{h}" for h in spans])


def level_change(df: DataFrame, keys: Sequence[str], time: str, value: str, h: int = 1, out: str | None = None,
                 mode: str = "row") -> DataFrame:
    return df.withColumn(out or f"{value}_change_{h}yr", F.col(value) - lag_of(value, keys, time, h, mode))


def rolling_mean(df: DataFrame, keys: Sequence[str], time: str, value: str, k: int, out: str,
                 strict: bool = False) -> DataFrame:
    """Mean over the current and k-1 preceding rows; `strict` needs k known values."""
    w = Window.partitionBy(*keys).orderBy(asc_last(time)).rowsBetween(-(k - 1), 0)
    mean = F.avg(value).over(w)
    return df.withColumn(out, F.when(F.count(value).over(w) == k, mean) if strict else mean)


def index_to_base(df: DataFrame, keys: Sequence[str], time: str, value: str, base: Column | int | None = None,
                  out: str = "index_value") -> DataFrame:
    """100 * value / value at the base period; the base defaults to each
    entity's first period. NULL unless the base value is non-zero."""
    w = Window.partitionBy(*keys)
    at = F.min(time).over(w) if base is None else (base if isinstance(base, Column) else F.lit(base))
    marked = df.withColumn("__at", at)
    b = F.max(F.when(F.col(time) == F.col("__at"), F.col(value).cast("double"))).over(w)
    return marked.withColumn(out, F.try_divide(F.col(value) * F.lit(100.0), b)).drop("__at")


def endpoint_change(df: DataFrame, keys: Sequence[str], time: str, value: str, t0: int | None = None,
                    t1: int | None = None) -> DataFrame:
    """Attach start and end values, absolute and relative change to every row."""
    w = Window.partitionBy(*keys)
    first = F.lit(t0) if t0 is not None else F.min(time).over(w)
    last = F.lit(t1) if t1 is not None else F.max(time).over(w)
    marked = df.withColumns({"__t0": first, "__t1": last})
    out = marked.withColumns({
        "start_value": F.max(F.when(F.col(time) == F.col("__t0"), F.col(value))).over(w),
        "end_value": F.max(F.when(F.col(time) == F.col("__t1"), F.col(value))).over(w)})
    return out.withColumns({
        "delta_abs": F.col("end_value") - F.col("start_value"),
        "delta_pct": ((F.col("end_value") - F.col("start_value")) / F.nullif(F.abs("start_value"), F.lit(0.0))),
    }).drop("__t0", "__t1")


def first_and_last(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """One row per entity: value at the first and last known period, and the sign of the change."""
    known = df.filter(F.col(value).isNotNull())
    out = known.groupBy(*keys).agg(F.min_by(value, time).alias("first_value"), F.max_by(value, time).alias("last_value"))
    return out.withColumns({"change": F.col("last_value") - F.col("first_value")}).withColumn(
        "direction", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat"))


def endpoints_pivot(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], t0: Column | int,
                    t1: Column | int) -> DataFrame:
    """One row per entity with `<v>_start`, `<v>_end` and `<v>_delta`, in one aggregation."""
    a, b = (t if isinstance(t, Column) else F.lit(t) for t in (t0, t1))
    aggs = []
    for v in values:
        aggs += [F.max(F.when(F.col(time) == a, F.col(v))).alias(f"{v}_start"),
                 F.max(F.when(F.col(time) == b, F.col(v))).alias(f"{v}_end")]
    ends = df.filter(F.col(time).isin(t0, t1) if isinstance(t0, int) and isinstance(t1, int) else
                     (F.col(time) == a) | (F.col(time) == b)).groupBy(*keys).agg(*aggs)
    return ends.withColumns({f"{v}_delta": F.col(f"{v}_end") - F.col(f"{v}_start") for v in values})


def endpoints_join(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], t0: int, t1: int) -> DataFrame:
    """Entities present at both periods, with both values side by side."""
    a = df.filter(F.col(time) == t0).select(*keys, *[F.col(v).alias(f"{v}_start") for v in values])
    b = df.filter(F.col(time) == t1).select(*keys, *[F.col(v).alias(f"{v}_end") for v in values])
    return a.join(b, list(keys))


def waterfall(df: DataFrame, group: Sequence[str], order: str, component: str, value: str,
              total_label: str = "Total") -> DataFrame:
    """Running start and end of each component plus a closing total row.

    A group's rows are its named components, so groups are small by meaning.
    """
    w = Window.partitionBy(*group).orderBy(asc_last(order), asc_last(component))
    running = F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(value).over(Window.partitionBy(*group))
    parts = df.select(*group, F.col(order).cast("bigint").alias(order), component, F.col(value).cast("double").alias(value),
                      running.alias("end_value"), whole.alias("__whole"))
    parts = parts.select(*group, order, component, value, (F.col("end_value") - F.coalesce(F.col(value), F.lit(0.0))).alias("start_value"),
                         "end_value", F.try_divide(F.col(value), F.col("__whole")).alias("share_of_total"),
                         F.lit(False).alias("is_total"))
    total = df.groupBy(*group).agg((F.max(order) + 1).cast("bigint").alias(order), F.sum(value).cast("double").alias(value))
    total = total.select(*group, order, F.lit(total_label).alias(component), value, F.lit(0.0).alias("start_value"),
                         F.col(value).alias("end_value"), F.lit(1.0).alias("share_of_total"), F.lit(True).alias("is_total"))
    return parts.unionByName(total)


def growth_many(df: DataFrame, keys: Sequence[str], time: str, values: dict[str, str], horizons: Sequence[int],
                cagr: Sequence[int] | None = None, mode: str = "row") -> DataFrame:
    """`growth` for several columns ({value: prefix}) over one window."""
    cagr = horizons if cagr is None else cagr
    spans = sorted({*horizons, *cagr})
    out = df.withColumns({f"__lag{h}_{p}": lag_of(v, keys, time, h, mode) for v, p in values.items() for h in spans})
    new = {}
    for v, p in values.items():
        x = F.col(v).cast("double")
        for h in horizons:
            new[f"{p}_growth_{h}yr"] = safe_ratio(x - F.col(f"__lag{h}_{p}"), f"__lag{h}_{p}")
        for h in cagr:
            new[f"{p}_cagr_{h}yr"] = F.when(F.col(f"__lag{h}_{p}") > 0,
                                            F.pow(x / F.col(f"__lag{h}_{p}"), F.lit(1.0 / h)) - 1)
    return out.withColumns(new).drop(*[f"__lag{h}_{p}" for p in values.values() for h in spans])
