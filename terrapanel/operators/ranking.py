"""Ranks, percentiles, bins and shares over groups of any size.

All of these rest on `operators.ordered`, so a group holding most of the rows
is spread over many tasks. NULL values sort last.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.operators.ordered import Order, Ranks, column_quantiles, down, ranks, row_numbers, running_sums, up
from terrapanel.session import settled


def rank_by(df: DataFrame, group: Sequence[str], value: str, ids: Sequence[str], out: str = "rank", *,
            method: str = "row_number", descending: bool = True, keep_nulls: bool = True) -> DataFrame:
    """`method` is row_number (ties broken by `ids`), min or dense."""
    source = {"row_number": "rn", "min": "rank", "dense": "dense"}
    if method not in source:
        raise ValueError(f"method must be one of {sorted(source)}, not {method!r}")
    return ranks(df, group, value, ids, {out: lambda r: getattr(r, source[method])}, descending=descending, keep_nulls=keep_nulls,
                 dense=method == "dense")


def _percent(r: Ranks) -> Column:
    return F.when(r.n > 1, (r.rank - 1) / (r.n - 1)).when(r.n == 1, F.lit(0.0))


def _average(r: Ranks) -> Column:
    return r.rank + (r.ties - 1) / 2


def percent_rank(df: DataFrame, group: Sequence[str], value: str, ids: Sequence[str], out: str = "pctl", *,
                 descending: bool = False, keep_nulls: bool = True, fill: float | None = None) -> DataFrame:
    """(rank - 1) / (n - 1); 0 for a single row. `keep_nulls` counts NULL rows in n
    and ranks them last; otherwise they are left out and become `fill`."""
    return ranks(df, group, value, ids, {out: lambda r: _percent(r) if fill is None else F.coalesce(_percent(r), F.lit(fill))},
                 descending=descending, keep_nulls=keep_nulls)


def percentile_0_100(df: DataFrame, group: Sequence[str], value: str, ids: Sequence[str], out: str = "pctl",
                     higher_is_better: bool = True, single: float = 50.0) -> DataFrame:
    """Percentile from 0 to 100 with average rank for ties; NULL stays NULL."""
    def made(r: Ranks) -> Column:
        p = (_average(r) - 1) / (r.n - 1) * 100
        return F.when(r.n > 1, p if higher_is_better else 100 - p).when(r.n == 1, F.lit(single))

    return ranks(df, group, value, ids, {out: made})


def cume_dist(df: DataFrame, group: Sequence[str], value: str, ids: Sequence[str], out: str = "cume_dist", *,
              descending: bool = False) -> DataFrame:
    return ranks(df, group, value, ids, {out: lambda r: (r.rank + r.ties - 1) / r.n}, descending=descending, keep_nulls=True)


def bucket_of(rn: Column, n: Column, k: int) -> Column:
    """SQL NTILE: the first n mod k buckets hold one row more."""
    small, extra = F.floor(n / k), n % k
    big_rows = extra * (small + 1)
    return F.when(rn <= big_rows, F.ceil(rn / (small + 1))).otherwise(
        extra + F.ceil((rn - big_rows) / F.nullif(small, F.lit(0).cast("bigint")))).cast("bigint")


def ntile(df: DataFrame, group: Sequence[str], value: str, ids: Sequence[str], k: int, out: str = "bucket", *,
          descending: bool = False) -> DataFrame:
    """Equal-count buckets over rows with a known value; NULL elsewhere."""
    return ranks(df, group, value, ids, {out: lambda r: bucket_of(r.rn, r.n, k)}, descending=descending)


class Ranking(NamedTuple):
    """One of the rankings of `ranked_columns`: `make` turns a row's `Ranks` into the new column."""

    col: str
    make: Callable[[Ranks], Column]
    group: Sequence[str] = ()
    descending: bool = False
    keep_nulls: bool = True


def min_rank(col: str, group: Sequence[str] = (), descending: bool = True) -> Ranking:
    return Ranking(col, lambda r: r.rank, group, descending)


def pct_rank(col: str, group: Sequence[str] = (), descending: bool = False, keep_nulls: bool = True) -> Ranking:
    return Ranking(col, _percent, group, descending, keep_nulls)


def equal_buckets(col: str, k: int, group: Sequence[str] = ()) -> Ranking:
    return Ranking(col, lambda r: bucket_of(r.rn, r.n, k), group, keep_nulls=False)


def tie_bins(col: str, n: int, group: Sequence[str] = ()) -> Ranking:
    """Equal-count bins 1..n in which equal values share a bin (by average rank)."""
    return Ranking(col, lambda r: F.when(r.value.isNotNull(), F.least(F.floor((_average(r) - 0.5) / r.n * n) + 1, F.lit(n)).cast("bigint")), group, keep_nulls=False)


def ranked_columns(df: DataFrame, ids: Sequence[str], wanted: Mapping[str, Ranking]) -> DataFrame:
    """Several rankings of numeric columns, over groups of their own, in one ordered pass.

    Values are stacked as groups of one long, narrow frame, ranked once and
    joined back on `ids`, which must identify a row.
    """
    df = settled(df)
    cells = F.array(*[F.struct(
        F.lit(k).alias("k"), F.to_json(F.struct(*[F.col(f"`{g}`") for g in w.group])).alias("place") if w.group else F.lit("").alias("place"),
        (F.lit(not w.keep_nulls) & F.col(f"`{w.col}`").isNull()).alias("skip"),
        (-F.col(f"`{w.col}`").cast("double") if w.descending else F.col(f"`{w.col}`").cast("double")).alias("v")) for k, w in enumerate(wanted.values())])
    keys = [f"i{k}" for k in range(len(ids))]
    long = df.select(*[F.col(f"`{i}`").alias(k) for i, k in zip(ids, keys)], F.explode(cells).alias("x")).select(*keys, "x.*")

    def chosen(r: Ranks) -> Column:
        return F.struct(*[F.when((F.col("row.k") == k) & ~F.col("row.skip"), w.make(r)).alias(f"r{k}") for k, w in enumerate(wanted.values())])

    made = ranks(long, ["k", "place", "skip"], "v", keys, {"made": chosen}, keep_nulls=True)
    wide = made.groupBy(*keys).agg(*[F.max(f"made.r{k}").alias(f"r{k}") for k in range(len(wanted))])
    same = reduce(lambda a, b: a & b, [df[f"`{i}`"].eqNullSafe(wide[k]) for i, k in zip(ids, keys)])
    kept = [df[f"`{c}`"] for c in df.columns if c not in wanted]
    return df.join(wide, same, "left").select(*kept, *[wide[f"r{k}"].alias(name) for k, name in enumerate(wanted)])


def rank_gap(df: DataFrame, group: Sequence[str], a: str, b: str, ids: Sequence[str]) -> DataFrame:
    """Ranks on two metrics (largest first) and their difference."""
    r = ranked_columns(df, ids, {f"{c}_rank": min_rank(c, group) for c in (a, b)})
    return r.withColumn("rank_gap", F.col(f"{a}_rank") - F.col(f"{b}_rank"))


def rank_metrics(df: DataFrame, ids: Sequence[str], scopes: Mapping[str, Sequence[str]], metrics: Mapping[str, bool],
                 keep_nulls: bool = True) -> DataFrame:
    """Rank and percentile of many metrics within many scopes in one ordered pass.

    Metrics and scopes are stacked into one long frame, ranked once by
    (scope, group, metric, value) and spread back to
    `<scope>_<metric>_rank` / `<scope>_<metric>_pctl`. `metrics` maps a column
    to whether larger is better; the rank puts the best first, the percentile
    puts the best at 1.
    """
    cols = list(metrics)
    group_cols = sorted({c for g in scopes.values() for c in g})
    long = df.select(*ids, *[c for c in group_cols if c not in ids],
                     *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [*ids, *[c for c in group_cols if c not in ids]], cols, "__metric", "__value")
    sign = F.when(F.col("__metric").isin([c for c, up in metrics.items() if not up]), -F.col("__value")).otherwise(F.col("__value"))
    places = F.array(*[
        F.struct(F.lit(s).alias("scope"), F.to_json(F.struct(*[F.col(c) for c in g])).alias("place"))
        for s, g in scopes.items()])
    long = long.withColumn("__goodness", sign).withColumn("__p", F.explode(places)).select(
        *ids, "__metric", "__goodness", F.col("__p.scope").alias("__scope"), F.col("__p.place").alias("__place"))
    key = ["__scope", "__place", "__metric"]
    # of all members, NULL included: they rank last from either end
    up_ranks = ranks(long, key, "__goodness", ids, {
        "__rn": lambda r: r.rn, "__rank": lambda r: r.rank, "__ties": lambda r: r.ties, "__p": _percent}, keep_nulls=keep_nulls)
    # Positions from the best end follow from the ascending pass: everything
    # above this run, then the rank by id within the run.
    n_known = F.col("__known_n")
    known = up_ranks.groupBy(*key).agg(F.count("__goodness").alias("__known_n"))
    placed = up_ranks.join(known, key)
    in_run = F.col("__rn") - F.col("__rank") + 1
    above = F.when(F.col("__goodness").isNull(), n_known).otherwise(n_known - (F.col("__rank") + F.col("__ties") - 1))
    rank = (above + in_run).cast("bigint")
    wide = placed.select(*ids, F.concat_ws("|", "__scope", "__metric").alias("__k"), rank.alias("rank"), F.col("__p").alias("pctl"))
    picks = []
    for s in scopes:
        for m in cols:
            at = F.col("__k") == f"{s}|{m}"
            picks += [F.max(F.when(at, F.col("rank"))).alias(f"{s}_{m}_rank"),
                      F.max(F.when(at, F.col("pctl"))).alias(f"{s}_{m}_pctl")]
    return wide.groupBy(*ids).agg(*picks)


def percentiles_of(df: DataFrame, ids: Sequence[str], group: Sequence[str], metrics: Mapping[str, str],
                   fill: float | None = None) -> DataFrame:
    """Percent rank over known values of several columns ({column: out}) in one
    ordered pass, joined back on `ids`; NULL stays NULL (or becomes `fill`)."""
    cols = list(metrics)
    base = [*ids, *[g for g in group if g not in ids]]
    long = df.select(*base, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(base, cols, "__metric", "__value")
    r = percent_rank(long, [*group, "__metric"], "__value", ids, "__p", keep_nulls=False)
    wide = r.groupBy(*ids).agg(*[F.max(F.when(F.col("__metric") == c, F.col("__p"))).alias(o) for c, o in metrics.items()])
    out = df.join(wide, list(ids), "left")
    return out.fillna(fill, list(metrics.values())) if fill is not None else out


def top_share(df: DataFrame, group: Sequence[str], score: str, ids: Sequence[str], share: float) -> DataFrame:
    """Best ceil(n * share) rows of each group, with cut-off and seed rank."""
    r = row_numbers(df, group, [down(score), *map(up, ids)], "seed_rank", "cutoff_n")
    r = r.withColumn("cutoff_n", F.ceil(F.col("cutoff_n") * F.lit(share)).cast("bigint"))
    return r.filter(F.col("seed_rank") <= F.col("cutoff_n"))


_PARTIAL_LIMIT = 1000  # up to here Spark keeps the best k of a group before the shuffle


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Order], k: int, out: str = "rn") -> DataFrame:
    """Best k rows of each group, for any k and groups of any size; `order` must be total.

    Every task keeps its own best k rows of a group before the shuffle, so at most
    k rows of a group come from each; a larger k is cut from the ranking of all rows.
    """
    if k >= _PARTIAL_LIMIT:
        return row_numbers(df, group, order, out, None).filter(F.col(out) <= k)
    best = Window.partitionBy(*[F.col(f"`{g}`") for g in group]).orderBy(*[o.sort() for o in order])
    return df.withColumn(out, F.row_number().over(best).cast("bigint")).filter(F.col(out) <= k)


def cumulative_share(df: DataFrame, group: Sequence[str], value: str, ids: Sequence[str],
                     cuts: Mapping[str, float] | None = None) -> DataFrame:
    """Largest-first running share of the group's total, with a flag per cut.

    A flag marks the rows needed to reach the cut: those whose share before
    the row is still below it.
    """
    out = running_sums(df.filter(F.col(value).isNotNull()), group, [down(value), *map(up, ids)],
                       {"running": F.col(value).cast("double")}, rn="value_rank")
    out = out.withColumns({
        "share": F.try_divide(F.col(value), F.col("running_total")),
        "cumulative_share": F.try_divide(F.col("running"), F.col("running_total"))})
    before = F.try_divide(F.col("running") - F.col(value), F.col("running_total"))
    return out.withColumns({name: before < cut for name, cut in (cuts or {}).items()})


def quantile_flag(df: DataFrame, group: Sequence[str], value: str, p: float, out: str = "is_high") -> DataFrame:
    """True where the value reaches its group's exact p-quantile; value and threshold come from one evaluation."""
    df = settled(df)
    q = column_quantiles(df, list(group), {"__q": (value, p)})
    joined = df.join(q, list(group), "left") if group else df.withColumn("__q", q.scalar())
    return joined.withColumn(out, F.col(value) >= F.col("__q")).drop("__q")


def quantile_bins(df: DataFrame, value: str, probs: Sequence[float], out: str = "bin", labels: Sequence[str] | None = None,
                  group: Sequence[str] = ()) -> DataFrame:
    """Bin by exact quantile breaks: bin i where break(i-1) < value <= break(i)."""
    df = settled(df)  # values and breaks come from one evaluation
    names = {f"__b{i}": (value, p) for i, p in enumerate(probs)}
    q = column_quantiles(df, list(group), names)
    if group:
        joined = df.join(q, list(group), "left")
    else:
        joined = df.withColumn("__q", q.select(F.struct(*names)).scalar()).select("*", "__q.*").drop("__q")
    label = (lambda i: F.lit(labels[i])) if labels else (lambda i: F.lit(i + 1).cast("bigint"))
    chain = F.when(F.col(value).isNull(), None)
    for i in range(len(probs)):
        chain = chain.when(F.col(value) <= F.col(f"__b{i}"), label(i))
    return joined.withColumn(out, chain.otherwise(label(len(probs)))).drop(*names)


def tie_stable_bins(df: DataFrame, group: Sequence[str], value: str, ids: Sequence[str], n: int, out: str) -> DataFrame:
    """Equal-count bins 1..n in which equal values share a bin (by average rank)."""
    return ranks(df, group, value, ids, {out: tie_bins(value, n).make})


def bivariate_class(df: DataFrame, x: str, y: str, ids: Sequence[str], n: int = 3, group: Sequence[str] = ()) -> DataFrame:
    """x bin, y bin and their joint class `<x>-<y>`."""
    out = ranked_columns(df, ids, {"x_bin": tie_bins(x, n, group), "y_bin": tie_bins(y, n, group)})
    both = F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull()
    return out.withColumn("bi_class", F.when(both, F.concat_ws("-", F.col("x_bin").cast("string"), F.col("y_bin").cast("string"))))


def value_within(df: DataFrame, group: Sequence[str], value: str, marker: str, out: str = "marker_pctl") -> DataFrame:
    """Where a benchmark value would fall (0-100, average ties) in each group.

    `marker` is a column that is constant within the group.
    """
    agg = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"), F.sum((F.col(value) < F.col(marker)).cast("bigint")).alias("__below"),
        F.sum((F.col(value) == F.col(marker)).cast("bigint")).alias("__ties"), F.max(marker).alias(marker))
    # the benchmark row itself joins the distribution: n + 1 rows, ties + 1
    return agg.withColumn(out, F.when(F.col(marker).isNotNull(), (F.col("__below") + F.col("__ties") / 2) / F.col("__n") * 100)).drop(
        "__n", "__below", "__ties")
