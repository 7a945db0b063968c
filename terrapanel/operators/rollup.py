"""Aggregation up a geography hierarchy."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.nulls import asc_last, as_col, safe_weighted_mean, sum_na0, weighted_mean
from terrapanel.operators.ordered import column_quantiles, quantiles, running_sums, up

_NUMERIC = (T.IntegerType, T.LongType, T.ShortType, T.DoubleType, T.FloatType, T.DecimalType)


def cols_matching(df: DataFrame, pattern: str, numeric: bool = False) -> list[str]:
    """Column names in which the regular expression is found."""
    rx = re.compile(pattern)
    return [f.name for f in df.schema.fields
            if rx.search(f.name) and (not numeric or isinstance(f.dataType, _NUMERIC))]


def rollup_sum(df: DataFrame, keys: Sequence[str], pattern: str) -> DataFrame:
    """Sum every numeric column matching `pattern` by `keys`; all-NULL gives 0."""
    cols = [c for c in cols_matching(df, pattern, numeric=True) if c not in keys]
    return df.groupBy(*keys).agg(*[sum_na0(c).alias(c) for c in cols])


def rollup_weighted(df: DataFrame, keys: Sequence[str], pattern: str, weight: str,
                    null_weight: str = "zero") -> DataFrame:
    """Weighted mean of every numeric column matching `pattern` by `keys`."""
    cols = [c for c in cols_matching(df, pattern, numeric=True) if c not in keys and c != weight]
    if not cols:
        raise ValueError(f"no numeric column matches {pattern!r}")
    return df.groupBy(*keys).agg(*[weighted_mean(c, weight, null_weight).alias(c) for c in cols])


def multi_level_rollup(df: DataFrame, levels: Mapping[str, tuple[str | Column, str | Column]], keys: Sequence[str],
                       aggs: Sequence[Column]) -> DataFrame:
    """Aggregate one scan to several geography levels at once.

    `levels` maps a level name to its (id, name) columns. Each row is handed to
    all its ancestors and one grouped aggregation, combined before the shuffle,
    serves every level. Rows without an id at a level are left out of it.
    """
    ancestors = F.array(*[
        F.struct(F.lit(level).alias("geo_level"), as_col(i).cast("string").alias("geo_id"),
                 as_col(n).cast("string").alias("geo_name")) for level, (i, n) in levels.items()])
    spread = df.withColumn("__at", F.explode(ancestors)).filter(F.col("__at.geo_id").isNotNull())
    spread = spread.drop("geo_level", "geo_id", "geo_name").select("*", "__at.*").drop("__at")
    out = spread.groupBy("geo_level", "geo_id", *keys).agg(F.max("geo_name").alias("geo_name"), *aggs)
    return out.select("geo_level", "geo_id", "geo_name", *keys, *out.columns[len(keys) + 3:])


def densities(pop: str, area: str) -> list[Column]:
    """Gross density (people over area) and density as the average person sees it."""
    p, a = F.col(pop).cast("double"), F.col(area).cast("double")
    own = F.when(a > 0, p / a)
    return [
        F.sum(p).alias("density_population"),
        F.sum(a).alias("land_area_sqmi"),
        F.when(F.sum(a) > 0, F.sum(p) / F.sum(a)).alias("gross_density_sqmi"),
        F.when(F.sum(p) > 0, F.sum(p * own) / F.sum(p)).alias("pop_weighted_density_sqmi"),
    ]


def weighted_median(df: DataFrame, keys: Sequence[str], x: str, w: str, out: str = "weighted_median") -> DataFrame:
    """Smallest `x` at which the running share of weight reaches one half."""
    known = df.filter(F.col(x).isNotNull() & F.col(w).isNotNull())
    per_value = known.groupBy(*keys, x).agg(F.sum(F.col(w).cast("double")).alias("__w"))
    cum = running_sums(per_value, keys, [up(x)], {"__cum": F.col("__w")})
    hit = cum.filter(F.col("__cum") / F.col("__cum_total") >= 0.5)
    return hit.groupBy(*keys).agg(F.min(x).alias(out))


def dedupe_max(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key, taking the largest value of each column."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


def group_summary(df: DataFrame, group: Sequence[str], *, medians: Mapping[str, str] | None = None,
                  aggs: Sequence[Column] = ()) -> DataFrame:
    """Plain aggregates plus exact medians ({out: column}) per group."""
    base = df.groupBy(*group).agg(*aggs)
    if not medians:
        return base
    med = column_quantiles(df, list(group), {o: (c, 0.5) for o, c in medians.items()})
    return base.join(med, list(group), "left")


def benchmark_summary(df: DataFrame, group: Sequence[str], cols: Sequence[str], method: str = "mean",
                      weight: str | None = None) -> DataFrame:
    """Mean of each column over a group, plain or weighted by `weight`."""
    if method == "mean":
        aggs = [F.avg(c).alias(c) for c in cols]
    elif method == "weighted":
        aggs = [safe_weighted_mean(c, weight).alias(c) for c in cols]
    else:
        raise ValueError(f"method must be 'mean' or 'weighted', not {method!r}")
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def benchmark_bundle(df: DataFrame, group: Sequence[str], cols: Sequence[str], weight: str) -> DataFrame:
    """Long table (group, metric, mean, weighted, median) for each column."""
    long = df.select(*group, F.col(weight).cast("double").alias("__w"),
                     *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [*group, "__w"], list(cols), "metric", "value")
    means = long.groupBy(*group, "metric").agg(
        F.avg("value").alias("bench_mean"), safe_weighted_mean("value", "__w").alias("bench_weighted"))
    med = quantiles(long, [*group, "metric"], "value", {"bench_median": 0.5})
    return means.join(med, [*group, "metric"], "left")


def flow_balance(edges: DataFrame, members: DataFrame, origin: str, dest: str, member: str, group: str,
                 amount: str) -> DataFrame:
    """Inflow, outflow and internal totals per group of places."""
    o = members.select(F.col(member).alias(origin), F.col(group).alias("__og"))
    d = members.select(F.col(member).alias(dest), F.col(group).alias("__dg"))
    both = edges.groupBy(origin, dest).agg(F.sum(amount).alias("__amt")).join(o, origin, "left").join(d, dest, "left")
    pairs = both.groupBy("__og", "__dg").agg(F.sum("__amt").alias("__amt"))
    inside = F.col("__og").eqNullSafe(F.col("__dg"))
    roles = F.when(inside, F.array(F.struct(F.col("__og").alias("g"), F.lit("internal").alias("role")))).otherwise(
        F.array(F.struct(F.col("__og").alias("g"), F.lit("outflow").alias("role")),
                F.struct(F.col("__dg").alias("g"), F.lit("inflow").alias("role"))))
    spread = pairs.select("__amt", F.explode(roles).alias("r")).select("__amt", "r.*").filter(F.col("g").isNotNull())
    return spread.groupBy(F.col("g").alias(group)).agg(*[
        F.coalesce(F.sum(F.when(F.col("role") == r, F.col("__amt"))), F.lit(0.0)).alias(r)
        for r in ("inflow", "outflow", "internal")])


def composition_share(df: DataFrame, group: Sequence[str], part: str, amount: str, out: str = "share") -> DataFrame:
    """Amount per (group, part) with its share of the group's total."""
    per = df.groupBy(*group, part).agg(F.sum(amount).alias(amount))
    total = per.groupBy(*group).agg(F.sum(amount).alias("__total"))
    return per.join(total, list(group)).withColumn(out, F.try_divide(F.col(amount), F.col("__total"))).drop("__total")


def hex_bin(df: DataFrame, x: str, y: str, size: float | tuple[float, float], weight: str | None = None,
            group: Sequence[str] = ()) -> DataFrame:
    """Count points per hexagonal cell (pointy-top, axial coordinates q, r).

    `size` is the hexagon's radius, or (x radius, y radius) for axes of
    different scale. Cube coordinates are rounded and the worst one repaired.
    """
    sx, sy = size if isinstance(size, tuple) else (size, size)
    px, py = F.col(x) / F.lit(float(sx)), F.col(y) / F.lit(float(sy))
    qf = px * (3 ** 0.5 / 3) - py / 3
    rf = py * (2 / 3)
    pts = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__qf": qf, "__rf": rf})
    sf = -F.col("__qf") - F.col("__rf")
    pts = pts.withColumns({"__q": F.rint("__qf"), "__r": F.rint("__rf"), "__s": F.rint(sf), "__sf": sf})
    dq, dr, ds = F.abs(F.col("__q") - F.col("__qf")), F.abs(F.col("__r") - F.col("__rf")), F.abs(F.col("__s") - F.col("__sf"))
    q = F.when((dq > dr) & (dq > ds), -F.col("__r") - F.col("__s")).otherwise(F.col("__q"))
    r = F.when((dq > dr) & (dq > ds), F.col("__r")).when(dr > ds, -F.col("__q") - F.col("__s")).otherwise(F.col("__r"))
    w = F.sum(F.col(weight)) if weight else F.count(F.lit(1)).cast("double")
    return pts.groupBy(*group, q.cast("bigint").alias("q"), r.cast("bigint").alias("r")).agg(
        F.count(F.lit(1)).alias("n"), w.alias("weight"))
