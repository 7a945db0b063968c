"""Standardising, imputing, trimming, tiers and correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.nulls import null_safe_join
from terrapanel.operators.ordered import column_quantiles, ranks
from terrapanel.session import settled


def _with_group_stats(df: DataFrame, group: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Attach aggregates of the group (or of everything) to each row."""
    if not group:
        stats = df.agg(*aggs)
        return df.withColumn("__st", stats.select(F.struct(*stats.columns)).scalar()).select("*", "__st.*").drop("__st")
    return null_safe_join(df, df.groupBy(*group).agg(*aggs), group, "left")


def impute_median(df: DataFrame, group: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """Fill NULL with the group's exact median; `cols` maps column to output."""
    med = column_quantiles(df, list(group), {f"__m_{c}": (c, 0.5) for c in cols})
    if group:
        out = null_safe_join(df, med, group, "left")
    else:
        out = df.withColumn("__st", med.select(F.struct(*med.columns)).scalar()).select("*", "__st.*").drop("__st")
    return out.withColumns({o: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c, o in cols.items()}).drop(
        *[f"__m_{c}" for c in cols])


def zscore(df: DataFrame, group: Sequence[str], cols: Mapping[str, str], flat: float | None = 0.0) -> DataFrame:
    """(x - mean) / sample sd within the group; `flat` where there is no spread."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__mu_{c}"), F.stddev_samp(c).alias(f"__sd_{c}")]
    out = _with_group_stats(df, group, aggs)
    z = {o: F.when(F.coalesce(F.col(f"__sd_{c}"), F.lit(0.0)) == 0, F.lit(flat)).otherwise(
        (F.col(c) - F.col(f"__mu_{c}")) / F.nullif(F.col(f"__sd_{c}"), F.lit(0.0))) for c, o in cols.items()}
    return out.withColumns(z).drop(*[f"__{k}_{c}" for c in cols for k in ("mu", "sd")])


def z_index(df: DataFrame, reference: DataFrame, cols: Mapping[str, str], centre: float = 50.0, per_sd: float = 10.0) -> DataFrame:
    """Score against a reference distribution, clamped to 0-100; the centre where it has no spread."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__mu_{c}"), F.stddev_samp(c).alias(f"__sd_{c}")]
    stats = reference.agg(*aggs)
    out = df.withColumn("__st", stats.select(F.struct(*stats.columns)).scalar()).select("*", "__st.*").drop("__st")
    new = {}
    for c, o in cols.items():
        flat = F.coalesce(F.col(f"__sd_{c}"), F.lit(0.0)) <= 0
        z = F.when(flat, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__mu_{c}")) / F.nullif(f"__sd_{c}", F.lit(0.0)))
        new[o] = F.when(z.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(centre) + F.lit(per_sd) * z)))
    return out.withColumns(new).drop(*[f"__{k}_{c}" for c in cols for k in ("mu", "sd")])


def rescale_0_100(df: DataFrame, cols: Mapping[str, str], group: Sequence[str] = ()) -> DataFrame:
    """Min-max to 0-100; NULL where all values are equal."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}")]
    out = _with_group_stats(settled(df), group, aggs)
    new = {o: F.try_divide((F.col(c) - F.col(f"__lo_{c}")) * F.lit(100.0), F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))
           for c, o in cols.items()}
    return out.withColumns(new).drop(*[f"__{k}_{c}" for c in cols for k in ("lo", "hi")])


def winsorize(df: DataFrame, col: str, lo: float, hi: float, mode: str = "clamp", group: Sequence[str] = (),
              out: str | None = None) -> DataFrame:
    """Clamp to (mode "clamp") or keep only (mode "trim") the exact quantile range."""
    df = settled(df)  # values and bounds come from one evaluation
    q = column_quantiles(df, list(group), {"__lo": (col, lo), "__hi": (col, hi)})
    if group:
        j = null_safe_join(df, q, group, "left")
    else:
        j = df.withColumn("__st", q.select(F.struct("__lo", "__hi")).scalar()).select("*", "__st.*").drop("__st")
    if mode == "trim":
        return j.filter(F.col(col).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    if mode != "clamp":
        raise ValueError(f"mode must be 'clamp' or 'trim', not {mode!r}")
    bounded = F.when(F.col(col).isNotNull(), F.least(F.greatest(F.col(col), F.col("__lo")), F.col("__hi")))
    flag = F.when(F.col(col) < F.col("__lo"), "low").when(F.col(col) > F.col("__hi"), "high").when(F.col(col).isNotNull(), "kept")
    return j.withColumns({out or f"{col}_w": bounded, "bound_flag": flag}).drop("__lo", "__hi")


def sd_tiers(df: DataFrame, col: str, out: str = "tier", k: float = 1.0, group: Sequence[str] = ()) -> DataFrame:
    """high / middle / low by mean plus or minus k standard deviations."""
    df = settled(df)
    j = _with_group_stats(df, group, [F.avg(col).alias("__mu"), F.stddev_samp(col).alias("__sd")])
    t = F.when(F.col(col) >= F.col("__mu") + k * F.col("__sd"), "high").when(
        F.col(col) <= F.col("__mu") - k * F.col("__sd"), "low").when(F.col(col).isNotNull(), "middle")
    return j.withColumn(out, t).drop("__mu", "__sd")


def quantile_tiers(df: DataFrame, col: str, cuts: Sequence[tuple[float, str]], default: str, out: str = "tier",
                   group: Sequence[str] = ()) -> DataFrame:
    """Label of the highest quantile cut the value reaches; `cuts` from high to low."""
    df = settled(df)  # values and cuts come from one evaluation
    q = column_quantiles(df, list(group), {f"__c{i}": (col, p) for i, (p, _) in enumerate(cuts)})
    if group:
        j = null_safe_join(df, q, group, "left")
    else:
        j = df.withColumn("__st", q.select(F.struct(*q.columns)).scalar()).select("*", "__st.*").drop("__st")
    chain = F.when(F.col(col).isNull(), None)
    for i, (_, label) in enumerate(cuts):
        chain = chain.when(F.col(col) >= F.col(f"__c{i}"), F.lit(label))
    return j.withColumn(out, chain.otherwise(F.lit(default))).drop(*[f"__c{i}" for i in range(len(cuts))])


def z_outliers(df: DataFrame, group: Sequence[str], cols: Sequence[str], limit: float = 2.0) -> DataFrame:
    """z-score per column, the largest distance over all, and an outlier flag."""
    out = zscore(df, group, {c: f"z_{c}" for c in cols}, flat=None)
    far = F.greatest(*[F.abs(f"z_{c}") for c in cols]) if len(cols) > 1 else F.abs(f"z_{cols[0]}")
    return out.withColumn("extremity", far).withColumn("outlier_flag", F.coalesce(F.col("extremity") >= limit, F.lit(False)))


def correlation_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], method: str = "pearson",
                     group: Sequence[str] = (), weak: float | None = None) -> DataFrame:
    """Correlation of every pair of columns, using rows where both are known.

    Pearson needs one aggregation over the wide rows. Spearman ranks anew
    for each pair after dropping incomplete rows; pairs are stacked so that one
    ordered pass per side serves all of them. Work grows with the square of the
    number of metrics (tens), not of rows.
    """
    pairs = list(combinations(cols, 2))
    base = df.select(*ids, *group, *[F.col(c).cast("double").alias(c) for c in cols])
    if method == "spearman":
        cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).alias("vx"), F.col(b).alias("vy"))
                          for a, b in pairs])
        long = base.select(*ids, *group, F.explode(cells).alias("p")).select(*ids, *group, "p.*")
        long = long.filter(F.col("vx").isNotNull() & F.col("vy").isNotNull())
        key = [*group, "x", "y"]
        rx = ranks(long, key, "vx", ids, {"rx": lambda r: r.rank + (r.ties - 1) / 2})
        ry = ranks(rx, key, "vy", ids, {"ry": lambda r: r.rank + (r.ties - 1) / 2})
        upper = ry.groupBy(*key).agg(F.corr("rx", "ry").alias("correlation"), F.count(F.lit(1)).alias("n"))
    elif method == "pearson":
        aggs = []
        for i, (a, b) in enumerate(pairs):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggs += [F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"c{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
        wide = base.groupBy(*group).agg(*aggs) if group else base.agg(*aggs)
        cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("correlation"),
                                   F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])
        upper = wide.select(*group, F.explode(cells).alias("p")).select(*group, "p.*")
    else:
        raise ValueError(f"method must be 'pearson' or 'spearman', not {method!r}")
    diag_aggs = [F.count(c).alias(c) for c in cols]
    counts = (base.groupBy(*group).agg(*diag_aggs) if group else base.agg(*diag_aggs)).unpivot(list(group), list(cols), "x", "n")
    diag = counts.select(*group, "x", F.col("x").alias("y"), F.lit(1.0).alias("correlation"), "n")
    sides = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    both = upper.select(*group, F.explode(sides).alias("p"), "correlation", "n").select(*group, "p.*", "correlation", "n")
    out = both.unionByName(diag).withColumnsRenamed({"x": "metric_x", "y": "metric_y"})
    shown = F.col("correlation") if weak is None else F.when(
        (F.col("metric_x") == F.col("metric_y")) | (F.abs("correlation") >= weak), F.col("correlation"))
    return out.withColumn("correlation_display", shown)


def share_of_total(df: DataFrame, group: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Value over its group's sum (an aggregate joined back, not a window)."""
    j = _with_group_stats(df, group, [F.sum(value).alias("__total")])
    return j.withColumn(out, F.try_divide(F.col(value), F.col("__total"))).drop("__total")
