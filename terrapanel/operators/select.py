"""Choosing rows: top-k with forced inclusions, entity selection, latest records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.nulls import asc_last, desc_last
from terrapanel.operators.ranking import rank_by, top_k_per_group
from terrapanel.session import settled, store


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_with(df: DataFrame, value: str, ids: Sequence[str], k: int, keep: Column | None = None,
               descending: bool = True, overall_rank: str = "overall_rank") -> DataFrame:
    """Best k rows plus any row for which `keep` holds, each with its rank among all."""
    df = settled(df)
    r = rank_by(df, [], value, ids, overall_rank, descending=descending)
    chosen = F.col(overall_rank) <= k
    if keep is not None:
        chosen = chosen | F.coalesce(keep, F.lit(False))
    n = df.select(F.count(F.lit(1))).scalar()
    out = store(r.filter(chosen))
    kept = out.select(F.count(F.lit(1))).scalar()
    return out.withColumn("truncated_flag", kept < n)


def select_entities(df: DataFrame, strategy: str, entity: str, period: str, rank: str, *, k: int = 10,
                    at: int | None = None, peers: Sequence[str] = (), always: Column | None = None) -> DataFrame:
    """All periods of the entities picked by a strategy.

    fixed_top_n: the best k at one period (default the last); rolling_top_n:
    anyone who was ever in the best k; peer_set: the listed entities; all.
    """
    if strategy == "all":
        return df
    if strategy == "peer_set":
        chosen = F.col(entity).isin(list(peers))
    elif strategy == "rolling_top_n":
        chosen = F.col(rank) <= k
    elif strategy == "fixed_top_n":
        when = F.lit(at) if at is not None else df.select(F.max(period)).scalar()
        chosen = (F.col(period) == when) & (F.col(rank) <= k)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if always is not None:
        chosen = chosen | F.coalesce(always, F.lit(False))
    return df.join(df.filter(chosen).select(entity).distinct(), entity, "left_semi")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the largest `order` columns.

    An aggregation, so it is combined before the shuffle and a key with very
    many rows costs no more than any other. End `order` with an id to make the
    choice unique; NULL counts as smallest.
    """
    return _extreme(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the smallest `order` columns; NULL comes last."""
    return _extreme(df, keys, order, F.min_by)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = [x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))] if pick is F.min_by else order
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*by)).alias("__r"))
    return out.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def persistent_groups(df: DataFrame, key: Sequence[str], flag: Column, min_hits: int, k: int, value: str) -> DataFrame:
    """The k groups with at least `min_hits` flagged rows and the highest mean."""
    agg = df.groupBy(*key).agg(F.count(F.when(flag, 1)).alias("hits"), F.avg(value).alias("mean_value"))
    return agg.filter(F.col("hits") >= min_hits).orderBy(
        desc_last("hits"), desc_last("mean_value"), *[asc_last(c) for c in key]).limit(k)


__all__ = ["top_k", "top_k_with", "top_k_per_group", "select_entities", "latest_per_key", "first_per_key",
           "persistent_groups"]
