"""Chart-ready datasets: tidy frames shaped for one chart type each.

Inputs follow the chart's contract (`CONTRACTS`). Drawing is left to the
caller. `select_rows` applies the usual filters before a dataset is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.columns import classify
from terrapanel.functions.nulls import finite, ratio_or_null
from terrapanel.operators import ranking as K
from terrapanel.operators import series as T
from terrapanel.operators.joins import complete_grid, complete_periods
from terrapanel.operators.quality import contract_check
from terrapanel.operators.rollup import group_summary, hex_bin
from terrapanel.operators.select import select_entities, top_k_with
from terrapanel.operators.stats import correlation_long, winsorize
from terrapanel.session import settled

# Required and optional columns of each chart type.
_PLACE = ("geo_level", "geo_id", "geo_name")
_ORIGIN = ("source", "vintage")
_METRIC = ("metric_id", "metric_label", "metric_value")
CONTRACTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "line": ((*_PLACE, "period", *_METRIC, *_ORIGIN), ("time_window", "group", "highlight_flag", "benchmark_value", "index_base_period", "note")),
    "scatter": ((*_PLACE, "time_window", "x_value", "y_value", "x_label", "y_label"), (*_ORIGIN, "group", "size_value", "label_flag", "note", "x_metric_id", "y_metric_id")),
    "bar": ((*_PLACE, "time_window", *_METRIC, *_ORIGIN), ("rank", "group", "series", "share_value", "highlight_flag", "benchmark_value", "note")),
    "choropleth": ((*_PLACE, "time_window", "metric_value", "metric_label", *_ORIGIN), ("geometry", "bin", "benchmark_value", "highlight_flag", "group", "note")),
    "boxplot": ((*_PLACE, "time_window", *_METRIC, *_ORIGIN), ("group", "highlight_flag", "label_flag", "weight_value", "benchmark_value", "note")),
    "hexbin": ((*_PLACE, "time_window", "x_value", "y_value", "x_label", "y_label", *_ORIGIN), ("group", "weight_value", "highlight_flag", "note")),
    "strength_strip": ((*_PLACE, "time_window", *_METRIC, *_ORIGIN), ("metric_group", "direction", "normalized_value", "benchmark_value", "benchmark_normalized_value", "benchmark_label", "highlight_flag", "note")),
    "correlation_heatmap": ((*_PLACE, "time_window", *_METRIC, *_ORIGIN), ("group", "include_flag", "weight")),
    "highlight_context_map": ((*_PLACE, "time_window", *_ORIGIN, "highlight_flag"), ("metric_value", "metric_label", "geometry", "context_group", "neighbor_flag", "benchmark_value", "bin", "group", "label_flag", "label_text", "note")),
    "slopegraph": ((*_PLACE, "period", *_METRIC, *_ORIGIN), ("group", "highlight_flag", "benchmark_label", "rank", "note")),
    "heatmap_table": ((*_PLACE, *_METRIC, *_ORIGIN), ("time_window", "period", "metric_group", "normalized_value", "direction", "group", "highlight_flag", "note")),
    "age_pyramid": ((*_PLACE, "period", "age_bin", "sex", "pop_value", *_ORIGIN), ("pop_total", "pop_share", "benchmark_label", "highlight_flag", "note")),
    "bump_chart": ((*_PLACE, "period", *_METRIC, *_ORIGIN), ("rank", "group", "highlight_flag", "peer_flag", "note")),
    "waterfall": ((*_PLACE, "time_window", "total_label", "component_id", "component_label", "component_value", *_ORIGIN), ("start_period", "end_period", "component_delta", "unit_label", "component_group", "benchmark_label", "highlight_flag", "sort_order", "note")),
    "bivariate_choropleth": ((*_PLACE, "time_window", "x_value", "y_value", "x_label", "y_label", *_ORIGIN), ("geometry", "x_bin", "y_bin", "bivar_class", "highlight_flag", "group", "note")),
    "proportional_symbol_map": ((*_PLACE, "time_window", "size_value", "size_label", *_ORIGIN), ("geometry", "lon", "lat", "color_group", "highlight_flag", "label_flag", "note")),
}
NUMERIC = {
    "scatter": ("x_value", "y_value"), "hexbin": ("x_value", "y_value"), "bivariate_choropleth": ("x_value", "y_value"), "strength_strip": (),
    "heatmap_table": (), "highlight_context_map": (), "age_pyramid": ("pop_value",), "waterfall": ("component_value",),
    "proportional_symbol_map": ("size_value", "lon", "lat")}
LOWER_IS_BETTER = ("lower_is_better", "lower-better", "lower")


def validate_contract(df: DataFrame, chart: str, single: Sequence[str] = ()) -> DataFrame:
    """Contract checks of one chart type as rows."""
    required, optional = CONTRACTS[chart]
    return contract_check(df, required, optional, NUMERIC.get(chart, ("metric_value",)), single)


def select_rows(df: DataFrame, question_id: str | None = None, time_window: str | None = None, metric_id: str | None = None,
                geo_ids: Sequence[str] | None = None, period_min: int | None = None, period_max: int | None = None) -> DataFrame:
    """The filters every chart shares; a None leaves its column alone."""
    for c, v in (("question_id", question_id), ("time_window", time_window), ("metric_id", metric_id)):
        if v is not None and c in df.columns:
            df = df.filter(F.col(c) == v)
    if geo_ids is not None:
        df = df.filter(F.col("geo_id").isin(list(geo_ids)))
    if period_min is not None:
        df = df.filter(F.col("period") >= period_min)
    if period_max is not None:
        df = df.filter(F.col("period") <= period_max)
    return df


def _flag(df: DataFrame, name: str) -> Column:
    """A truth column, read from text, numbers or a missing column."""
    if name not in df.columns:
        return F.lit(False)
    t = F.lower(F.col(name).cast("string"))
    return F.coalesce(t.isin("true", "t", "1", "1.0", "yes", "y"), F.lit(False))


def line(df: DataFrame, variant: str = "single", base_period: int | None = None, rolling_k: int = 3, complete: bool = True) -> DataFrame:
    """Level, index or rolling mean per place, on complete periods."""
    keys = ["geo_id", "metric_id"]
    carry = [c for c in df.columns if c not in (*keys, "period", "metric_value", "benchmark_value")]
    out = complete_periods(df, keys, "period", carry) if complete else df
    out = out.withColumn("variant", F.lit(variant))
    if variant == "indexed":
        base = F.lit(base_period) if base_period is not None else df.select(F.min("period")).scalar()
        out = T.index_to_base(out, keys, "period", "metric_value", base, "plot_value")
        return out.withColumns({"time_window": F.lit("indexed"), "index_base_period": base})
    if variant == "rolling":
        out = T.rolling_mean(out, keys, "period", "metric_value", rolling_k, "plot_value", strict=True)
        return out.withColumn("time_window", F.lit(f"rolling_{rolling_k}yr"))
    return out.withColumn("plot_value", F.col("metric_value"))


def bar(df: DataFrame, top_n: int | None = None, bottom_n: int | None = None, descending: bool = True, sort_by: str = "metric_value",
        include: Sequence[str] = (), include_highlighted: bool = False) -> DataFrame:
    """Ranked bars: the best or worst n plus forced places, with rank among all."""
    known = df.filter(finite("metric_value")).withColumn("highlight_flag", _flag(df, "highlight_flag"))
    by = {"metric_value": F.col("metric_value"), "abs_metric_value": F.abs("metric_value")}
    sort = F.abs(F.col("metric_value") - F.col("benchmark_value")) if sort_by == "benchmark_delta" else by[sort_by]
    known = known.withColumns({"sort_value": sort, "plot_value": F.col("metric_value")})
    keep = F.col("geo_id").isin(list(include) or [""])
    if include_highlighted:
        keep = keep | F.col("highlight_flag")
    if top_n is None and bottom_n is None:
        return K.rank_by(known, [], "sort_value", ["geo_name", "geo_id"], "overall_rank", descending=descending).withColumns(
            {"display_order": F.col("overall_rank"), "truncated_flag": F.lit(False)})
    known = settled(known)  # ranked and counted
    if bottom_n is not None:
        out = top_k_with(known, "sort_value", ["geo_name", "geo_id"], bottom_n, keep, not descending, "__from_bottom")
        n = known.select(F.count(F.lit(1))).scalar()
        out = out.withColumn("overall_rank", n - F.col("__from_bottom") + 1).drop("__from_bottom")
    else:
        out = top_k_with(known, "sort_value", ["geo_name", "geo_id"], top_n, keep, descending)
    return K.rank_by(out, [], "overall_rank", [], "display_order", descending=False)


def scatter(df: DataFrame, drop_missing: bool = True) -> DataFrame:
    out = df.withColumns({c: F.col(c).try_cast("double") for c in ("x_value", "y_value")})
    return out.filter(finite("x_value") & finite("y_value")) if drop_missing else out


def slopegraph(df: DataFrame, start: int, end: int, variant: str = "value", order_by: str = "end_value", descending: bool = True,
               top_n: int | None = None, include: Sequence[str] = (), higher_is_better: bool = True, drop_incomplete: bool = True) -> DataFrame:
    """Two periods per place with change, display order and optional trimming."""
    two = df.filter(F.col("period").isin(start, end)).withColumns({
        "period_role": F.when(F.col("period") == start, "start").otherwise("end"), "highlight_flag": _flag(df, "highlight_flag")})
    ends = two.groupBy("geo_id").agg(F.max(F.when(F.col("period") == start, F.col("metric_value"))).alias("start_value"),
                                     F.max(F.when(F.col("period") == end, F.col("metric_value"))).alias("end_value"),
                                     F.max("geo_name").alias("__name"), F.bool_or("highlight_flag").alias("__hl"))
    ends = ends.withColumn("delta_value", F.col("end_value") - F.col("start_value")).withColumn("pct_change", ratio_or_null("delta_value", "start_value"))
    if drop_incomplete:
        ends = ends.filter(finite("start_value") & finite("end_value"))
    orders = {"abs_delta": F.abs("delta_value"), "abs_pct_change": F.abs("pct_change")}
    sort = orders.get(order_by, F.col(order_by) if order_by in ends.columns else F.col("end_value"))
    ends = ends.withColumn("sort_value", sort)
    ends = K.rank_by(ends, [], "sort_value", ["__name", "geo_id"], "__order", descending=descending)
    if top_n is not None:
        ends = ends.filter((F.col("__order") <= top_n) | F.col("__hl") | F.col("geo_id").isin(list(include) or [""]))
    ends = K.rank_by(ends, [], "__order", [], "display_order", descending=False).drop("__order", "__name", "__hl")
    out = two.join(ends, "geo_id")
    if variant == "indexed":
        return out.withColumn("plot_value", ratio_or_null(F.col("metric_value") * 100.0, "start_value"))
    if variant == "rank":
        return K.rank_by(out, ["period"], "metric_value", ["geo_name", "geo_id"], "plot_value", descending=higher_is_better, keep_nulls=False)
    return out.withColumn("plot_value", F.col("metric_value"))


def bump(df: DataFrame, strategy: str = "fixed_top_n", k: int = 10, at: int | None = None, peers: Sequence[str] = (), method: str = "row_number",
         higher_is_better: bool = True, include_highlighted: bool = True) -> DataFrame:
    """Ranks per period for the chosen places, with first and last rank attached."""
    out = df.withColumns({"highlight_flag": _flag(df, "highlight_flag"), "peer_flag": _flag(df, "peer_flag")}).filter(finite("metric_value"))
    out = K.rank_by(out.drop("rank"), ["period"], "metric_value", ["geo_name", "geo_id"], "rank", method=method, descending=higher_is_better, keep_nulls=False)
    always = F.col("highlight_flag") if include_highlighted else None
    if strategy == "peer_set":
        always = F.col("peer_flag") if always is None else always | F.col("peer_flag")
    out = select_entities(out, strategy, "geo_id", "period", "rank", k=k, at=at, peers=peers, always=always)
    lo, hi = out.select(F.min("period")).scalar(), out.select(F.max("period")).scalar()
    ends = out.withColumns({"__lo": lo, "__hi": hi}).groupBy("geo_id").agg(
        F.max(F.when(F.col("period") == F.col("__lo"), F.col("rank"))).alias("start_rank"),
        F.max(F.when(F.col("period") == F.col("__hi"), F.col("rank"))).alias("end_rank"),
        F.max(F.when(F.col("period") == F.col("__hi"), F.col("metric_value"))).alias("end_metric_value"))
    return out.join(ends, "geo_id", "left").withColumns({
        "rank_change": F.col("start_rank") - F.col("end_rank"),
        "complete_endpoint_flag": F.col("start_rank").isNotNull() & F.col("end_rank").isNotNull()})


def _higher(direction: str = "direction") -> Column:
    return ~F.coalesce(F.lower(F.col(direction)).isin(list(LOWER_IS_BETTER)), F.lit(False))


def normalized(df: DataFrame, group: Sequence[str], out: str = "normalized_value") -> DataFrame:
    """0-100 percentile with average ties, turned round for lower-is-better metrics."""
    p = K.percentile_0_100(df, group, "metric_value", ["geo_id"], out)
    return p.withColumn(out, F.when(_higher(), F.col(out)).otherwise(100 - F.col(out)))


def heatmap_table(df: DataFrame, variant: str, metrics: Mapping[str, str] | None = None, periods: Sequence[int] = ()) -> DataFrame:
    """Complete matrix of percentiles with a score per row.

    Variants: geo_metric (rows places, columns metrics), geo_period and
    metric_period. `metrics` maps metric id to label and lists the columns of
    the first, `periods` those of the others.
    """
    base = df.withColumns({"direction": F.col("direction") if "direction" in df.columns else F.lit("higher_is_better"),
                           "highlight_flag": _flag(df, "highlight_flag")})
    group = {"geo_metric": ["metric_id"], "geo_period": ["metric_id", "period"], "metric_period": ["metric_id"]}[variant]
    if variant == "metric_period":
        p = K.percentile_0_100(base, group, "metric_value", ["geo_id", "period"], "normalized_value")
        n = p.withColumn("normalized_value", F.when(_higher(), F.col("normalized_value")).otherwise(100 - F.col("normalized_value")))
        cells = n.select(F.col("metric_id").alias("row_id"), F.col("metric_label").alias("row_label"), F.col("period").alias("column_id"), "metric_value", "normalized_value", "highlight_flag")
        dims = {"column_id": list(periods)}
    else:
        n = normalized(base, group)
        column = F.col("metric_id") if variant == "geo_metric" else F.col("period")
        cells = n.select(F.col("geo_id").alias("row_id"), F.col("geo_name").alias("row_label"), column.alias("column_id"), "metric_value", "normalized_value", "highlight_flag")
        dims = {"column_id": list(metrics) if variant == "geo_metric" else list(periods)}
    full = complete_grid(cells, ["row_id"], dims, ["row_label", "highlight_flag"])
    score = full.groupBy("row_id").agg(F.avg("normalized_value").alias("row_score"))
    return full.join(score, "row_id").withColumn("missing_flag", F.col("metric_value").isNull() | F.col("normalized_value").isNull())


def strength_strip(df: DataFrame) -> DataFrame:
    """Percentile per metric and window, with the benchmark's own position."""
    base = df.withColumns({"direction": F.col("direction") if "direction" in df.columns else F.lit("higher_is_better"),
                           "highlight_flag": _flag(df, "highlight_flag")})
    group = ["metric_id", "time_window"]
    out = normalized(base, group)
    if "benchmark_value" in df.columns:
        ref = base.groupBy(*group).agg(F.max("benchmark_value").alias("__b"), F.max("direction").alias("__d"))
        pos = K.value_within(base.join(ref, group), group, "metric_value", "__b", "benchmark_normalized_value").drop("__b")
        out = out.join(pos, group, "left").withColumn("benchmark_normalized_value", F.when(
            _higher(), F.col("benchmark_normalized_value")).otherwise(100 - F.col("benchmark_normalized_value")))
    return out.withColumn("missing_flag", ~finite("normalized_value"))


def boxplot(df: DataFrame, trim: tuple[float, float] | None = None, clamp: bool = False, group: str = "group") -> DataFrame:
    """Values per group with the group's median and size, optionally trimmed."""
    out = df.filter(finite("metric_value")).withColumns({
        "plot_value": F.col("metric_value"),
        "box_group": F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("Ungrouped")) if group in df.columns else F.lit("All observations")})
    if trim:
        if clamp:
            out = winsorize(out, "plot_value", *trim, out="__p").withColumn("plot_value", F.col("__p")).drop("__p", "bound_flag")
        else:
            out = winsorize(out, "plot_value", *trim, mode="trim")
    stats = group_summary(out, ["box_group"], medians={"group_median": "plot_value"}, aggs=[F.count("plot_value").alias("group_n")])
    stats = K.rank_by(stats, [], "group_median", ["box_group"], "group_order")
    return out.join(stats, "box_group")


def hexbin(df: DataFrame, size: float | tuple[float, float], x_limits: tuple[float, float] | None = None, y_limits: tuple[float, float] | None = None,
           clamp: bool = False, weight: str | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Hexagon counts after optional quantile limits on both axes."""
    out = df.filter(finite("x_value") & finite("y_value"))
    for c, lim in (("x_value", x_limits), ("y_value", y_limits)):
        if lim:
            out = winsorize(out, c, *lim, mode="clamp" if clamp else "trim", **({"out": c} if clamp else {})).drop("bound_flag")
    return hex_bin(out, "x_value", "y_value", size, weight, group)


def correlation_heatmap(df: DataFrame, metrics: Sequence[str], method: str = "spearman", weak: float | None = None, facet: str | None = None) -> DataFrame:
    """Pairwise-complete correlation matrix of a long metric table."""
    keep = df.filter(F.coalesce(_flag(df, "include_flag"), F.lit(True))) if "include_flag" in df.columns else df
    group = [facet] if facet else []
    wide = keep.groupBy("geo_id", *group).agg(*[F.max(F.when(F.col("metric_id") == m, F.col("metric_value"))).alias(m) for m in metrics])
    out = correlation_long(wide, ["geo_id"], metrics, method, group, weak)
    return out.withColumns({"abs_correlation": F.abs("correlation"), "method": F.lit(method)})


def age_pyramid(df: DataFrame, bins: Sequence[str], measure: str = "share", sexes: tuple[str, str] = ("Male", "Female")) -> DataFrame:
    """Mirrored bars: complete bins, totals, shares, left side negative."""
    s = F.lower(F.trim("sex"))
    base = df.withColumn("sex", F.when(s.isin("male", "m", "men"), "Male").when(s.isin("female", "f", "women"), "Female").otherwise(F.col("sex")))
    keys = ["geo_id", "period", *[c for c in ("facet_label", "benchmark_label") if c in df.columns]]
    keyed = base.select(*keys, "geo_name", "age_bin", "sex", "pop_value").withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in keys[2:]})
    full = complete_grid(keyed, keys, {"age_bin": list(bins), "sex": list(sexes)}, ["geo_name"])
    full = full.withColumns({"missing_bin_flag": F.col("pop_value").isNull(), "pop_value": F.coalesce("pop_value", F.lit(0.0))})
    total = full.groupBy(*keys).agg(F.sum("pop_value").alias("pop_total"))
    out = full.join(total, keys).withColumn("pop_share", F.when(F.col("pop_total") > 0, F.col("pop_value") / F.col("pop_total")))
    shown = F.col("pop_share" if measure == "share" else "pop_value")
    return out.withColumns({"display_value": shown, "plot_value": F.when(F.col("sex") == sexes[0], -shown).otherwise(shown)})


def waterfall(df: DataFrame, group: Sequence[str] = ("geo_level", "geo_id", "geo_name", "time_window"), value: str = "component_value",
              total_label: str = "Total") -> DataFrame:
    """Running bars of the components and the closing total."""
    return T.waterfall(df.filter(finite(value)), list(group), "sort_order", "component_label", value, total_label)


def choropleth(df: DataFrame, variant: str = "continuous", probs: Sequence[float] = (), breaks: Sequence[float] = (), labels: Sequence[str] | None = None) -> DataFrame:
    """Fill value (difference from the benchmark when diverging) and its bin."""
    fill = F.col("metric_value") - F.col("benchmark_value") if variant == "diverging" else F.col("metric_value")
    out = df.withColumns({"fill_value": fill, "highlight_flag": _flag(df, "highlight_flag")})
    if probs:
        return K.quantile_bins(out, "fill_value", probs, "bin", labels)
    if breaks:
        chain = F.when(F.col("fill_value").isNull(), None)
        for i, b in enumerate(breaks):
            chain = chain.when(F.col("fill_value") <= b, F.lit(labels[i] if labels else str(i + 1)))
        return out.withColumn("bin", chain.otherwise(F.lit(labels[-1] if labels else str(len(breaks) + 1))))
    return out


def bivariate_choropleth(df: DataFrame, n_bins: int = 3, bin_by: Sequence[str] = ()) -> DataFrame:
    return K.bivariate_class(df, "x_value", "y_value", ["geo_id"], n_bins, bin_by).withColumnRenamed("bi_class", "bivar_class")


def highlight_context(df: DataFrame) -> DataFrame:
    """Role of each place: highlighted, neighbour or background."""
    hl, nb = _flag(df, "highlight_flag"), _flag(df, "neighbor_flag")
    return df.withColumns({"highlight_flag": hl, "neighbor_flag": nb}).withColumn("focus_role", classify(
        [(F.col("highlight_flag"), "Highlighted geography"), (F.col("neighbor_flag"), "Neighbor context")], "Background context"))


def proportional_symbol(df: DataFrame, top_n: int | None = None, label_top_n: int = 8, group: Sequence[str] = ()) -> DataFrame:
    """Positive sizes ranked, with share, running share and labels for the largest."""
    pos = df.filter(finite("size_value") & (F.col("size_value") > 0))
    out = K.cumulative_share(pos, [], "size_value", ["geo_name", "geo_id"]).drop("running", "running_total")
    out = out.withColumnsRenamed({"share": "size_share", "cumulative_share": "cumulative_size_share", "value_rank": "size_rank"})
    if group:
        out = K.rank_by(out.drop("size_rank"), group, "size_value", ["geo_name", "geo_id"], "size_rank")
    out = out.withColumn("label_flag", F.col("size_rank") <= label_top_n)
    return out.filter(F.col("size_rank") <= top_n) if top_n else out
