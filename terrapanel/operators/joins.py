"""Joins between panels, crosswalks and reference tables.

No join here carries a broadcast hint: Spark broadcasts a side when its
measured size is below `spark.sql.autoBroadcastJoinThreshold` and otherwise
shuffles, splitting skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.functions.columns import parent_key, text_key
from terrapanel.functions.nulls import asc_last

PANEL_KEYS = ("geo_level", "geo_id", "year")


def join_on_spine(spine: DataFrame, *panels: DataFrame, keys: Sequence[str] = PANEL_KEYS,
                  names: Sequence[str] = ("geo_name",)) -> DataFrame:
    """Left join panels to the spine; shared name columns are filled in order.

    All joins use the same keys, so one partitioning serves the whole chain.
    """
    out = spine
    for i, p in enumerate(panels):
        extra = [n for n in names if n in p.columns]
        out = out.join(p.withColumnsRenamed({n: f"__{n}_{i}" for n in extra}), list(keys), "left")
    fill = {n: F.coalesce(F.col(n), *[F.col(f"__{n}_{i}") for i, p in enumerate(panels) if n in p.columns])
            for n in names if n in spine.columns}
    drop = [f"__{n}_{i}" for n in names for i, p in enumerate(panels) if n in p.columns]
    return out.withColumns(fill).drop(*drop) if fill else out.drop(*drop)


def via_crosswalk(df: DataFrame, xwalk: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """Carry rows to the crosswalk's target places (1:N fans out)."""
    x = xwalk.withColumnRenamed(right, left) if right != left else xwalk
    return df.join(x, left, how)


def allocate(df: DataFrame, xwalk: DataFrame, key: str, target: str, weight: str, values: Sequence[str],
             keys: Sequence[str] = ()) -> DataFrame:
    """Spread additive values over a weighted N:M crosswalk and add them up."""
    j = df.join(xwalk.select(key, target, weight), key)
    return j.groupBy(target, *keys).agg(*[F.sum(F.col(v) * F.col(weight)).alias(v) for v in values])


def hierarchy_backfill(df: DataFrame, paths: Mapping[str, tuple[DataFrame, Mapping[str, str]]], values: Sequence[str],
                       order: Sequence[str]) -> DataFrame:
    """Fill `values` from the first path that has them.

    Each path is (reference, {df column: reference column}); `order` gives
    precedence. `<value>_source` names the path used. Rows never multiply: where
    a reference repeats its keys, each value counts only if its rows agree on it.
    """
    out = df
    for name, (ref, on) in paths.items():
        keys = [F.col(rc).alias(f"__{name}_{lc}") for lc, rc in on.items()]
        r = ref.groupBy(*keys).agg(*[F.when(F.min(v) == F.max(v), F.max(v)).alias(f"__{name}_val_{v}") for v in values])
        cond = reduce(lambda a, b: a & b, [out[lc] == r[f"__{name}_{lc}"] for lc in on])
        out = out.join(r, cond, "left").drop(*[f"__{name}_{lc}" for lc in on])
    new = {}
    for v in values:
        new[v] = F.coalesce(*[F.col(f"__{n}_val_{v}") for n in order])
        new[f"{v}_source"] = F.coalesce(*[F.when(F.col(f"__{n}_val_{v}").isNotNull(), F.lit(n)) for n in order])
    return out.withColumns(new).drop(*[f"__{n}_val_{v}" for n in paths for v in values])


def match_names(df: DataFrame, ref: DataFrame, name: str, ref_name: str, take: Sequence[str]) -> DataFrame:
    """Left join on names reduced to letters and digits.

    `match_status` is matched, none, or ambiguous where several different
    reference rows have the same key; `take` is NULL unless matched.
    """
    rows = ref.select(text_key(ref_name).alias("__key"), F.struct(*take).alias("__take")).filter(F.col("__key").isNotNull())
    r = rows.groupBy("__key").agg(F.min("__take").alias("__take"), F.max("__take").alias("__other"))
    r = r.withColumn("match_status", F.when(F.col("__take").eqNullSafe(F.col("__other")), "matched").otherwise("ambiguous"))
    out = df.withColumn("__key", text_key(name)).join(r, "__key", "left").withColumn("match_status", F.coalesce("match_status", F.lit("none")))
    taken = {c: F.when(F.col("match_status") == "matched", F.col(f"__take.{c}")) for c in take}
    return out.withColumns(taken).drop("__key", "__take", "__other")


def zero_filled_right(facts: DataFrame, universe: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every row of the universe, with 0 where there is no fact."""
    return facts.join(universe, list(keys), "right").withColumns(
        {v: F.coalesce(F.col(v), F.lit(0).cast(facts.schema[v].dataType)) for v in values})


def coverage_full(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Full outer join on keys saying which side knows each key."""
    left, right = (d.select(*keys).distinct().withColumn(f"in_{n}", F.lit(True)) for d, n in zip((a, b), names))
    return left.join(right, list(keys), "full").withColumns(
        {f"in_{n}": F.coalesce(F.col(f"in_{n}"), F.lit(False)) for n in names})


def latest(df: DataFrame, time: str, where: Column | None = None) -> DataFrame:
    """Rows of the most recent period (a scalar subquery, evaluated once)."""
    scope = df if where is None else df.filter(where)
    return scope.filter(F.col(time) == scope.select(F.max(time)).scalar())


def latest_common(dfs: Sequence[DataFrame], time: str) -> list[DataFrame]:
    """Each frame at the latest period that all of them have reached."""
    tops = [d.select(F.max(time)).scalar() for d in dfs]
    at = F.least(*tops) if len(tops) > 1 else tops[0]
    return [d.filter(F.col(time) == at) for d in dfs]


def peer_pool(df: DataFrame, target: str, id_col: str, group: str, size: str, low: float = 0.5,
              high: float = 1.5) -> DataFrame:
    """Places in the target's group whose size lies within a band of the target's."""
    t = df.filter(F.col(id_col) == target).select(F.col(group).alias("__g"), F.col(size).alias("__s"))
    cond = (F.col(group) == F.col("__g")) & F.col(size).between(F.col("__s") * low, F.col("__s") * high)
    return df.join(t, cond).filter(F.col(id_col) != target).drop("__g", "__s")


def nearest_by_size(df: DataFrame, target: str, id_col: str, size: str, k: int, where: Column | None = None) -> DataFrame:
    """The k places closest to the target in size."""
    own = df.filter(F.col(id_col) == target).select(F.max(size)).scalar()
    pool = df if where is None else df.filter(where)
    gap = pool.filter(F.col(id_col) != target).withColumn("size_gap", F.abs(F.col(size) - own))
    return gap.orderBy(asc_last("size_gap"), asc_last(id_col)).limit(k)


def _entities(df: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    if not carry:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry])


def complete_periods(df: DataFrame, keys: Sequence[str], time: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per entity and period over the whole span, gaps as NULL.

    The span is two numbers; every entity expands on its own, so nothing is
    paired up across entities.
    """
    span = df.select(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi"))).scalar()
    entities = _entities(df, keys, carry).withColumn("__span", span)
    grid = entities.withColumn(time, F.explode(F.sequence("__span.lo", "__span.hi"))).drop("__span")
    return grid.join(df.drop(*carry), [*keys, time], "left")


def complete_grid(df: DataFrame, keys: Sequence[str], dims: Mapping[str, Sequence], carry: Sequence[str] = ()) -> DataFrame:
    """One row per entity and combination of the listed dimension values."""
    grid = _entities(df, keys, carry)
    for name, values in dims.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df.drop(*carry), [*keys, *dims], "left")


def assign_by_prefix(df: DataFrame, ref: DataFrame, key: str, ref_key: str, n: int, out: str = "assigned") -> DataFrame:
    """Assign rows to a reference place by the first `n` digits of their key.

    `match_status` is matched, no_key (too few digits) or unmatched.
    """
    r = ref.select(F.col(ref_key).alias(out)).distinct()
    marked = df.withColumn("__p", parent_key(key, n))
    j = marked.join(r, F.col("__p") == F.col(out), "left")
    status = F.when(F.col("__p").isNull() | (F.length("__p") < n), "no_key").when(F.col(out).isNotNull(), "matched").otherwise("unmatched")
    return j.withColumn("match_status", status).drop("__p")


def top_matches(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    best = Window.partitionBy(*[F.col(f"`{c}`") for c in key]).orderBy(*order)
    return df.withColumn("__best", F.row_number().over(best)).filter(F.col("__best") <= k).drop("__best")
