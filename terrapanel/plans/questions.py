"""Analytical questions: each turns gold rows into one chart's contract rows.

`g` is the stacked gold table (geo_level, geo_id, geo_name, year, KPIs); `x`
maps geo_id to the groups a question needs (metro, region, ...). Years,
targets and thresholds are arguments. A `year` of None means the latest year.
Latest years and single thresholds are scalar subqueries, so nothing is
collected while a question is being built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.columns import window_label
from terrapanel.functions.nulls import asc_last, desc_last, finite, ratio_or_null, sum0
from terrapanel.operators import ranking as K
from terrapanel.operators.joins import latest, nearest_by_size, peer_pool
from terrapanel.operators.ordered import column_quantiles
from terrapanel.operators.reshape import metric_rows
from terrapanel.operators.series import endpoints_pivot
from terrapanel.operators.stats import z_outliers
from terrapanel.session import store

PLACE = ("geo_level", "geo_id", "geo_name")
IDS = ["geo_name", "geo_id"]

# ---- shared pieces --------------------------------------------------------


def at(g: DataFrame, level: str, year: int | None = None, known: Sequence[str] = ()) -> DataFrame:
    """Rows of one level at one year; the latest year with known values by default."""
    lv = g.filter(F.col("geo_level") == level)
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in known]) if known else None
    if year is not None:
        out = lv.filter(F.col("year") == year)
        return out if ok is None else out.filter(ok)
    return latest(lv, "year", ok)


def _rows(df: DataFrame, question: str, **cols: Column | str) -> DataFrame:
    return df.select(F.lit(question).alias("question_id"), *PLACE,
                     *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])


def xy(g: DataFrame, x: DataFrame, question: str, level: str, xv: Column, yv: Column, group: str, year: int | None = None,
       known: Sequence[str] = (), where: Column | None = None, weight: str | None = None) -> DataFrame:
    """One point per place: x, y, group and optional weight; both values known."""
    df = at(g, level, year, known).join(x, "geo_id", "left")
    if where is not None:
        df = df.filter(where)
    out = _rows(df, question, year="year", x_value=xv, y_value=yv, group=group, weight_value=F.col(weight) if weight else F.lit(None).cast("double"))
    return out.filter(F.col("x_value").isNotNull() & F.col("y_value").isNotNull())


def one_metric(g: DataFrame, x: DataFrame, question: str, level: str, metric: str, group: str, highlight: Column, year: int | None = None,
               where: Column | None = None) -> DataFrame:
    """One row per place with a metric, a group and a highlight flag."""
    df = at(g, level, year, [metric]).join(x, "geo_id").filter(F.col(metric).isNotNull())
    if where is not None:
        df = df.filter(where)
    return _rows(df, question, year="year", metric_id=F.lit(metric), metric_value=metric, group=group, highlight_flag=highlight)


def profile(df: DataFrame, question: str, metrics: Mapping[str, tuple], keys: Sequence[str] = (), fields: Sequence[str] = ("metric_label", "metric_group", "direction", "metric_order")) -> DataFrame:
    """Long rows, one per place and metric, described from a literal table."""
    return metric_rows(df.withColumn("question_id", F.lit(question)), ["question_id", *PLACE, *keys], metrics, fields)


# Label, theme, direction and order of the profile metrics.
PROFILE = {
    "pop_growth_5yr": ("Population growth (5yr)", "Growth", "higher_is_better", 1),
    "median_hh_income": ("Median household income", "Prosperity", "higher_is_better", 2),
    "pct_ba_plus": ("Adults with BA+", "Talent", "higher_is_better", 3),
    "pct_unemployment_rate": ("Unemployment rate", "Labor", "lower_is_better", 4),
    "pct_rent_burden_30plus": ("Rent-burdened renter share", "Affordability", "lower_is_better", 5),
    "permits_per_1000_population": ("Permits per 1,000 residents", "Supply", "higher_is_better", 6)}
# The same for the peer profile.
PEER_PROFILE = {
    "pop_growth_5yr": ("Population growth (5yr)", "Growth", "higher_is_better", 1), "pct_ba_plus": ("Adults with BA+", "Talent", "higher_is_better", 2),
    "median_hh_income": ("Median household income", "Prosperity", "higher_is_better", 3), "jobs_to_pop_ratio": ("Jobs-to-population ratio", "Labor", "higher_is_better", 4),
    "pct_unemployment_rate": ("Unemployment rate", "Labor", "lower_is_better", 5), "pct_rent_burden_30plus": ("Rent-burdened renter share", "Affordability", "lower_is_better", 6),
    "value_to_income": ("Home value-to-income", "Affordability", "lower_is_better", 7), "permits_per_1000_population": ("Permits per 1,000 residents", "Supply", "higher_is_better", 8),
    "mean_travel_time": ("Mean commute time", "Access", "lower_is_better", 9)}
# The same for the shortlist.
SHORTLIST = {
    "median_hh_income": ("Median household income", "Prosperity", "higher_is_better", 1), "pct_ba_plus": ("Adults with BA+", "Talent", "higher_is_better", 2),
    "vacancy_rate": ("Vacancy rate", "Housing headroom", "higher_is_better", 3), "pct_rent_burden_30plus": ("Rent-burdened renter share", "Affordability", "lower_is_better", 4),
    "value_to_income": ("Home value-to-income", "Affordability", "lower_is_better", 5)}
# Order of the level metrics, and the growth metrics with label, theme, direction, order and group.
LEVELS = {k: (*PROFILE[k][:3], i, "levels") for i, k in enumerate(
    ("median_hh_income", "pct_ba_plus", "pct_unemployment_rate", "pct_rent_burden_30plus", "permits_per_1000_population"), 1)}
GROWTHS = {"pop_growth_5yr": ("Population growth (5yr)", "Growth", "higher_is_better", 1, "growth"),
           "income_pc_growth_5yr": ("Personal income growth (5yr)", "Growth", "higher_is_better", 2, "growth"),
           "lfpr_growth_5yr": ("Labor-force participation growth (5yr)", "Growth", "higher_is_better", 3, "growth")}

# ---- age pyramids ---------------------------------------------------------


def pyramid_rows(df: DataFrame, question: str, cells: Mapping[str, tuple[str, str]], facet: Column, benchmark: Column, highlight: Column) -> DataFrame:
    """Population by age and sex of the chosen rows; `cells` maps column -> (age_bin, sex)."""
    long = metric_rows(df.withColumns({"__f": facet, "__b": benchmark, "__h": highlight}), [*PLACE, "year", "pop_total", "__f", "__b", "__h"], cells, ("age_bin", "sex"), "pop_value")
    out = long.groupBy(*PLACE, "year", F.col("__f").alias("facet_label"), "age_bin", "sex").agg(
        F.sum("pop_value").alias("pop_value"), F.max("pop_total").alias("pop_total"), F.max("__b").alias("benchmark_label"), F.bool_or("__h").alias("highlight_flag"))
    return out.select(F.lit(question).alias("question_id"), *out.columns)


def pyramid_vs_nation(g: DataFrame, cells: Mapping, target: str, level: str = "cbsa") -> DataFrame:
    us = F.col("geo_level") == "us"
    year = g.filter((F.col("geo_level") == level) & (F.col("geo_id") == target)).select(F.max("year")).scalar()
    df = g.filter(((F.col("geo_level") == level) & (F.col("geo_id") == target)) | us).filter(F.col("year") == year)
    return pyramid_rows(df, "pyramid_cbsa_vs_us", cells, F.when(us, F.lit(target)).otherwise(F.col("geo_name")), F.when(us, "United States"), ~us)


def pyramid_top_places(g: DataFrame, x: DataFrame, question: str, cells: Mapping, share: Column, level: str, parent_level: str, k: int, target: str,
                       parent: str = "parent_id", where: Column | None = None) -> DataFrame:
    """The k places of a metro with the highest age-group share, each facet
    repeated with its parent as benchmark. `x`: geo_id, parent_id, parent_name, cbsa_code."""
    own = at(g, level).join(x.filter(F.col("cbsa_code") == target), "geo_id")
    if where is not None:
        own = own.filter(where)
    top = own.withColumn("__share", F.round(share, 12)).orderBy(desc_last("__share"), *[asc_last(c) for c in IDS]).limit(k)
    facet = F.concat(F.col("geo_name"), F.lit(" vs "), F.col("parent_name"))
    a = pyramid_rows(top, question, cells, facet, F.lit(None).cast("string"), F.lit(True))
    up = top.select(facet.alias("__facet"), F.col(parent).alias("geo_id"), F.col("parent_name"), F.col("year"))
    b = g.filter(F.col("geo_level") == parent_level).join(up, ["geo_id", "year"])
    return a.unionByName(pyramid_rows(b, question, cells, F.col("__facet"), F.col("parent_name"), F.lit(False)))


def pyramid_two_periods(g: DataFrame, cells: Mapping, target: str, since: int, level: str = "cbsa") -> DataFrame:
    own = (F.col("geo_level") == level) & (F.col("geo_id") == target)
    first, last = g.filter(own & (F.col("year") >= since)).select(F.min("year")).scalar(), g.filter(own).select(F.max("year")).scalar()
    us = F.col("geo_level") == "us"
    df = g.filter(own | us).withColumns({"__a": first, "__z": last}).filter((F.col("year") == F.col("__a")) | (F.col("year") == F.col("__z")))
    return pyramid_rows(df, "pyramid_peer_aging_compare", cells, F.col("year").cast("string"), F.when(us, "United States"), ~us)


# ---- bars, boxes, maps ----------------------------------------------------


def bar_sample(g: DataFrame, metro_x: DataFrame, county_x: DataFrame, target: str) -> DataFrame:
    """Metro income growth ranked nationally and the target's counties by rent burden."""
    a = at(g, "cbsa", known=["income_pc_growth_5yr"]).filter(F.col("income_pc_growth_5yr").isNotNull()).join(metro_x, "geo_id", "left")
    a = K.rank_by(a, [], "income_pc_growth_5yr", IDS, "rank")
    a = _rows(a, "bar_top_growth_cbsas", time_window=F.concat(window_label(F.col("year") - 5, "year"), F.lit("_growth")), metric_id=F.lit("income_pc_growth_5yr"),
              metric_value=F.col("income_pc_growth_5yr") * 100.0, rank="rank", group="region", highlight_flag=F.col("geo_id") == target)
    c = at(g, "county", known=["rent_to_income"]).join(county_x.filter(F.col("cbsa_code") == target), "geo_id")
    c = K.rank_by(c, [], "rent_to_income", IDS, "rank")
    c = _rows(c, "bar_county_affordability", time_window=F.concat(F.col("year").cast("string"), F.lit("_snapshot")), metric_id=F.lit("rent_to_income"),
              metric_value=F.col("rent_to_income") * 100.0, rank="rank", group=F.lit("target counties"), highlight_flag=F.lit(False))
    return a.unionByName(c)


def commute_tail(g: DataFrame, x: DataFrame, target: str, k: int = 3) -> DataFrame:
    """Commute intensity of the target's small areas with the longest tail flagged."""
    df = at(g, "tract", known=["mean_travel_time"]).join(x.filter(F.col("cbsa_code") == target), "geo_id")
    df = df.withColumn("metric_value", F.col("mean_travel_time") * sum0("pct_commute_drive_alone", "pct_commute_carpool"))
    df = K.rank_by(df.withColumn("__m", F.round("metric_value", 9)), [], "__m", ["geo_id"], "tail_rank")
    return _rows(df, "boxplot_target_cbsa_zcta_commute_tail", metric_value="metric_value", group="segment", highlight_flag=F.col("tail_rank") <= k)


def sweet_spot_boxplot(f: DataFrame, min_growth: float = 0.90, max_value: float = 0.85, label_growth: float = 0.95) -> DataFrame:
    """Home values with the fast-growing, still affordable metros flagged.

    `f` is the metro feature table with its national percentiles."""
    df = latest(f, "year", F.col("median_home_value").isNotNull()).filter(F.col("median_home_value").isNotNull())
    sweet = F.coalesce((F.col("cbsa_type") == "Metro Area") & (F.col("national_pop_growth_5yr_pctl") >= min_growth)
                       & (F.col("national_median_home_value_pctl") <= max_value), F.lit(False))
    return df.select(F.lit("boxplot_sweet_spot_affordability_outliers").alias("question_id"), F.col("cbsa_code").alias("geo_id"), F.col("median_home_value").alias("metric_value"),
                     F.col("cbsa_type").alias("group"), sweet.alias("highlight_flag"), (sweet & (F.col("national_pop_growth_5yr_pctl") >= label_growth)).alias("label_flag"),
                     F.col("pop_total").alias("weight_value"))


def within_metro_outliers(g: DataFrame, x: DataFrame, question: str, target: str, metric: str = "value_to_income", p: float = 0.95) -> DataFrame:
    """Small areas of one metro with the upper tail of a metric flagged."""
    df = at(g, "tract").filter(F.col(metric).isNotNull()).join(x.filter(F.col("cbsa_code") == target), "geo_id")
    df = K.quantile_flag(df, [], metric, p, "highlight_flag")
    return _rows(df, question, year="year", metric_value=metric, group="cbsa_name", highlight_flag="highlight_flag")


def against_weighted_benchmark(g: DataFrame, x: DataFrame, metric: str = "rpp_real_pc_income") -> DataFrame:
    """Metro values beside the population-weighted mean of all metros."""
    df = at(g, "cbsa", known=[metric]).filter(F.col(metric).isNotNull())
    b = df.select((F.sum(F.col(metric) * F.col("pop_total")) / F.sum("pop_total"))).scalar()
    return _rows(df.join(x, "geo_id", "left"), "map_benchmark_relative_metros", year="year", metric_value=metric, benchmark_value=b, group="region")


def growth_windows(g: DataFrame, x: DataFrame, question: str, level: str, windows: Mapping[str, str], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Several growth windows stacked; `windows` maps label to growth column."""
    df = at(g, level).join(x, "geo_id", "left")
    cells = F.array(*[F.struct(F.lit(lb).alias("time_window"), F.col(c).alias("metric_value")) for lb, c in windows.items()])
    df = df.withColumn("__w", F.explode(cells)).filter(F.col("__w.metric_value").isNotNull())
    return _rows(df, question, time_window="__w.time_window", metric_value="__w.metric_value", group="region", **(extra or {}))


# ---- bumps and slopes -----------------------------------------------------


def ranked_series(df: DataFrame, question: str, metric: str, years: tuple[int, int], descending: bool = True, highlight: Column | None = None, group: Column | None = None) -> DataFrame:
    """Values per year with the rank of each place in that year."""
    s = df.filter(F.col("year").between(*years) & F.col(metric).isNotNull())
    s = K.rank_by(s, ["year"], metric, IDS, "rank", descending=descending)
    return _rows(s, question, period="year", metric_id=F.lit(metric), metric_value=metric, rank="rank", group=group if group is not None else F.lit("all"),
                 highlight_flag=highlight if highlight is not None else F.lit(False))


def county_rank_movers(g: DataFrame, x: DataFrame, target: str, start: int, end: int, k: int = 2, metric: str = "pct_rent_burden_30plus") -> DataFrame:
    """Yearly ranks of the target's counties; those that moved up most are flagged."""
    c = g.filter(F.col("geo_level") == "county").join(x.filter(F.col("cbsa_code") == target).select("geo_id"), "geo_id")
    s = ranked_series(c, "bump_county_rent_burden_rank", metric, (start, end)).drop("highlight_flag")
    ends = s.groupBy("geo_id").agg(F.max(F.when(F.col("period") == start, F.col("rank"))).alias("a"), F.max(F.when(F.col("period") == end, F.col("rank"))).alias("z"))
    movers = K.rank_by(ends.withColumn("gain", F.col("a") - F.col("z")), [], "gain", ["geo_id"], "mover_order")
    return s.join(movers.select("geo_id", (F.col("mover_order") <= k).alias("highlight_flag")), "geo_id", "left")


# Weight of each percentile, and whether more of it counts.
OVERHEAT = {"pop_growth_5yr": (0.35, True), "income_pc_growth_5yr": (0.25, True), "value_to_income": (0.25, True), "pct_rent_burden_30plus": (0.15, True)}
SWEET = {"income_pc_growth_5yr": (0.40, True), "pop_growth_5yr": (0.30, True), "value_to_income": (0.30, False)}


def sweet_spot_overheating(g: DataFrame, years: tuple[int, int], at_year: int, k: int = 12, level: str = "cbsa") -> DataFrame:
    """Overheating score and rank over time for the places that look best at `at_year`."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in OVERHEAT])
    df = g.filter((F.col("geo_level") == level) & F.col("year").between(*years) & known).select(*PLACE, "year", *OVERHEAT, (-F.col("value_to_income")).alias("__cheap"))
    p = K.percentiles_of(df, ["geo_id", "year"], ["year"], {**{c: f"__p_{c}" for c in OVERHEAT}, "__cheap": "__p_cheap"})
    score = lambda w: 100 * sum((F.lit(wt) * F.col(f"__p_{c}" if up else "__p_cheap") for c, (wt, up) in w.items()), F.lit(0.0))
    p = p.withColumns({"sweet_spot_score": F.round(score(SWEET), 9), "overheating_score": F.round(score(OVERHEAT), 9)})
    best = p.filter(F.col("year") == at_year).orderBy(desc_last("sweet_spot_score"), *[asc_last(c) for c in IDS]).limit(k).select("geo_id")
    return ranked_series(p.join(best, "geo_id", "left_semi"), "bump_sweet_spot_overheating", "overheating_score", years)


def peer_ranks(g: DataFrame, question: str, peers: Sequence[str], target: str, years: Sequence[int], metric: str = "value_to_income") -> DataFrame:
    """A fixed peer set ranked lowest first."""
    df = g.filter((F.col("geo_level") == "cbsa") & F.col("geo_id").isin(list(peers)) & F.col("year").isin(list(years)))
    return ranked_series(df, question, metric, (min(years), max(years)), descending=False, highlight=F.col("geo_id") == target)


def slope_pairs(df: DataFrame, question: str, metric: str, start: int, end: int, k: int | None = None, positive: bool = False) -> DataFrame:
    """Both periods of places known at both; the k largest changes if asked."""
    both = df.filter(F.col("year").isin(start, end) & F.col(metric).isNotNull())
    e = endpoints_pivot(both, ["geo_id"], "year", [metric], start, end).filter(F.col(f"{metric}_delta").isNotNull())
    if positive:
        e = e.filter((F.col(f"{metric}_start") > 0) & (F.col(f"{metric}_end") > 0))
    e = e.withColumn("__d", F.round(F.abs(f"{metric}_delta"), 9))
    e = K.rank_by(e, [], "__d", ["geo_id"], "display_rank").select("geo_id", "display_rank")
    if k is not None:
        e = e.filter(F.col("display_rank") <= k)
    return _rows(both.join(e, "geo_id"), question, period="year", metric_id=F.lit(metric), metric_value=metric, display_rank="display_rank")


def slope_vs_region(g: DataFrame, x: DataFrame, target: str, start: int, end: int, metric: str = "rpp_real_pc_income") -> DataFrame:
    """The target beside the mean of its region's metros."""
    df = g.filter((F.col("geo_level") == "cbsa") & F.col("year").isin(start, end) & F.col(metric).isNotNull()).join(x, "geo_id")
    region = x.filter(F.col("geo_id") == target).select(F.max("region")).scalar()
    own = df.filter(F.col("geo_id") == target).select("geo_id", F.col("year").alias("period"), F.col(metric).alias("metric_value"), F.lit(True).alias("highlight_flag"), F.lit(None).cast("string").alias("benchmark_label"))
    bench = df.filter(F.col("region") == region).groupBy(F.col("year").alias("period")).agg(F.avg(metric).alias("metric_value")).select(
        F.lit("region_benchmark").alias("geo_id"), "period", "metric_value", F.lit(False).alias("highlight_flag"), F.lit("Regional benchmark").alias("benchmark_label"))
    return own.unionByName(bench)


# ---- correlation and profile inputs ---------------------------------------


def metric_table(df: DataFrame, question: str, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Known values of several metrics, long."""
    long = metric_rows(df.withColumn("question_id", F.lit(question)), ["question_id", *PLACE, *keys], {m: () for m in metrics}, ())
    return long.filter(F.col("metric_value").isNotNull())


def sweet_spot_metrics(g: DataFrame, x: DataFrame, metrics: Sequence[str], pop: tuple[float, float], level: str = "cbsa", k: int = 12,
                       growth_from: float = 0.65, permits_from: float = 0.55, burden_to: float = 0.45, price_to: float = 0.45) -> DataFrame:
    """All places and a derived shortlist, each as its own group of metric rows.

    The last four arguments bound the percentiles of the shortlist.
    """
    need = ("pop_growth_5yr", "pct_rent_burden_30plus", "value_to_income", "permits_per_1000_population")
    # read several times below: one evaluation, and only the columns in use
    g = store(g.filter(F.col("geo_level") == level).select(*dict.fromkeys([*PLACE, "year", "pop_total", *need, *metrics])))
    base = at(g, level).join(x, "geo_id", "left")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in need])
    medium = base.filter((F.col("cbsa_type") == "Metro Area") & F.col("pop_total").between(*pop) & known)
    p = K.percentiles_of(medium.select(*PLACE, *need), ["geo_id"], [], {c: f"p_{i}" for i, c in enumerate(need)})
    good = p.filter((F.col("p_0") >= growth_from) & (F.col("p_3") >= permits_from) & (F.col("p_1") <= burden_to) & (F.col("p_2") <= price_to))
    short = good.withColumn("__s", F.round(F.col("p_0") + F.col("p_3") - F.col("p_1") - F.col("p_2"), 9)).orderBy(desc_last("__s"), *[asc_last(c) for c in IDS]).limit(k)
    both = base.withColumn("group", F.lit("All CBSAs")).unionByName(base.join(short.select("geo_id"), "geo_id", "left_semi").withColumn("group", F.lit("Derived Sweet Spot shortlist")))
    return metric_table(both, "corr_sweet_spot_compare", metrics, ["group"])


def shortlist_scan(g: DataFrame, x: DataFrame, target: str, k: int = 25) -> DataFrame:
    """Profile of the target's small areas, scored by the mean of five percentiles."""
    df = at(g, "tract").join(x.filter(F.col("cbsa_code") == target).select("geo_id"), "geo_id", "left_semi")
    signed = {m: (F.col(m) if d[2] == "higher_is_better" else -F.col(m)) for m, d in SHORTLIST.items()}
    p = K.percentiles_of(df.select(*PLACE, *SHORTLIST, *[c.alias(f"__v_{m}") for m, c in signed.items()]), ["geo_id"], [], {f"__v_{m}": f"__p_{m}" for m in SHORTLIST})
    p = p.withColumn("row_order", F.round(sum((F.col(f"__p_{m}") for m in SHORTLIST), F.lit(0.0)) / len(SHORTLIST), 9))
    p = K.rank_by(p, [], "row_order", IDS, "__r").withColumn("display_flag", F.col("__r") <= k)
    return profile(p, "heatmap_shortlist_scan", SHORTLIST, ["row_order", "display_flag"])


def peer_profile(g: DataFrame, x: DataFrame, target: str, k: int = 6) -> DataFrame:
    """Nine metrics of all metros; the target and its nearest in size are displayed."""
    df = at(g, "cbsa").join(x, "geo_id", "left")
    region = x.filter(F.col("geo_id") == target).select(F.max("region")).scalar()
    near = nearest_by_size(df, target, "geo_id", "pop_total", k - 1, F.col("region") == region).select("geo_id", F.lit(True).alias("__near"))
    own = F.col("geo_id") == target
    df = df.join(near, "geo_id", "left").withColumns({"highlight_flag": own, "display_flag": own | F.coalesce("__near", F.lit(False))})
    return profile(df, "heatmap_peer_cbsa_profile", PEER_PROFILE, ["highlight_flag", "display_flag"])


def region_profile(g: DataFrame, x: DataFrame, question: str, level: str, target: str) -> DataFrame:
    """Profile of every place in the target metro's region; the metro's own displayed."""
    region = x.filter(F.col("cbsa_code") == target).select(F.max("region")).scalar()
    df = at(g, level).join(x.filter(F.col("region") == region), "geo_id").withColumn("display_flag", F.col("cbsa_code") == target)
    return profile(df, question, PROFILE, ["display_flag"])


def persistent_stress(g: DataFrame, x: DataFrame, target: str, years: tuple[int, int], min_known: int = 4, k: int = 18, metric: str = "pct_rent_burden_30plus") -> DataFrame:
    """Yearly stress of the target's small areas; the worst with enough history displayed."""
    df = g.filter((F.col("geo_level") == "tract") & F.col("year").between(*years)).join(x.filter(F.col("cbsa_code") == target).select("geo_id"), "geo_id", "left_semi")
    agg = df.groupBy("geo_id").agg(F.count(metric).alias("n"), F.round(F.avg(metric), 9).alias("m")).filter(F.col("n") >= min_known)
    top = agg.orderBy(desc_last("m"), asc_last("geo_id")).limit(k).select("geo_id", F.lit(True).alias("__d"))
    return _rows(df.join(top, "geo_id", "left"), "heatmap_zcta_persistent_stress", period="year", metric_value=metric, display_flag=F.coalesce("__d", F.lit(False)))


def target_improvement(g: DataFrame, target: str, years: tuple[int, int]) -> DataFrame:
    """Metric history of one metro with the improvement from first to last year."""
    df = g.filter((F.col("geo_level") == "cbsa") & (F.col("geo_id") == target) & F.col("year").between(*years))
    long = profile(df, "heatmap_target_metric_improvement", {k: PEER_PROFILE[k] for k in ("pop_growth_5yr", "median_hh_income", "pct_ba_plus", "pct_unemployment_rate", "pct_rent_burden_30plus", "value_to_income", "permits_per_1000_population")}, ["year"])
    ends = long.groupBy("metric_id").agg(F.min_by("metric_value", "year").alias("a"), F.max_by("metric_value", "year").alias("z"))
    gain = F.when(F.col("direction") == "lower_is_better", F.col("a") - F.col("z")).otherwise(F.col("z") - F.col("a"))
    return long.join(ends, "metric_id").withColumn("row_order", gain).drop("a", "z")


def strip_vs_peers(g: DataFrame, x: DataFrame, target: str, low: float = 0.7, high: float = 1.5, k: int = 3, level: str = "cbsa") -> DataFrame:
    """Profile of the target's region with the k nearest peers in size displayed."""
    df = at(g, level).join(x, "geo_id")
    region = x.filter(F.col("geo_id") == target).select(F.max("region")).scalar()
    own_pop = df.filter(F.col("geo_id") == target).select(F.max("pop_total")).scalar()
    pool = peer_pool(df, target, "geo_id", "region", "pop_total", low, high).withColumn("__gap", F.abs(F.col("pop_total") - own_pop))
    near = pool.orderBy(asc_last("__gap"), asc_last("geo_id")).limit(k).select("geo_id", F.lit(True).alias("__near"))
    own = F.col("geo_id") == target
    df = df.filter(F.col("region") == region).join(near, "geo_id", "left").withColumns({"highlight_flag": own, "display_flag": own | F.coalesce("__near", F.lit(False))})
    return profile(df, "strip_target_vs_peers", PROFILE, ["highlight_flag", "display_flag"])


def strip_vs_median(g: DataFrame, target: str, level: str = "cbsa") -> DataFrame:
    """Profile of all places beside each metric's exact median."""
    df = at(g, level)
    med = column_quantiles(df, [], {m: (m, 0.5) for m in PROFILE}).unpivot([], list(PROFILE), "metric_id", "benchmark_value")
    return profile(df.withColumn("highlight_flag", F.col("geo_id") == target), "strip_score_driver_scan", PROFILE, ["highlight_flag"]).join(med, "metric_id", "left")


# ---- hexbins, scatters, symbols -------------------------------------------


def hotspots(g: DataFrame, x: DataFrame, year: int, p: float = 0.975, k: int = 4, growth: str = "pop_growth_5yr", level: str = "tract") -> DataFrame:
    """Growth against burden; the most populous places in both upper tails flagged."""
    df = at(g, level, year, [growth, "pct_rent_burden_30plus"]).join(x, "geo_id", "left")
    df = df.withColumns({"x_value": F.col(growth) * 100.0, "y_value": F.col("pct_rent_burden_30plus")})
    q = column_quantiles(df, [], {"xc": ("x_value", p), "yc": ("y_value", p)}).select(F.struct("xc", "yc")).scalar()
    df = df.withColumn("__q", q).withColumn("__hot", (F.col("x_value") >= F.col("__q.xc")) & (F.col("y_value") >= F.col("__q.yc")))
    hot = df.filter("__hot").orderBy(desc_last("pop_total"), desc_last("y_value"), desc_last("x_value"), asc_last("geo_id")).limit(k).select("geo_id", F.lit(True).alias("__top"))
    return _rows(df.join(hot, "geo_id", "left"), "hexbin_growth_vs_burden", x_value="x_value", y_value="y_value", group="region", highlight_flag=F.coalesce("__top", F.lit(False)))


def tradeoff_shape(g: DataFrame, x: DataFrame, target: str, year: int, k: int = 5) -> DataFrame:
    """Value and rent ratios in one metro; the most extreme places on both axes flagged."""
    df = at(g, "tract", year, ["value_to_income", "rent_to_income"]).join(x.filter(F.col("cbsa_code") == target), "geo_id")
    z = z_outliers(df, [], ["value_to_income", "rent_to_income"])
    z = z.withColumn("__e", F.round(F.abs("z_value_to_income") + F.abs("z_rent_to_income"), 9))
    top = z.orderBy(desc_last("__e"), desc_last("pop_total"), asc_last("geo_id")).limit(k).select("geo_id", F.lit(True).alias("__top"))
    return _rows(z.join(top, "geo_id", "left"), "hexbin_target_tradeoff", x_value="value_to_income", y_value="rent_to_income", group="cbsa_name", highlight_flag=F.coalesce("__top", F.lit(False)))


def locator(places: DataFrame, x: DataFrame, question: str, targets: Mapping[str, str]) -> DataFrame:
    """All places with a few highlighted and labelled ({geo_id: label})."""
    hit = F.col("geo_id").isin(list(targets))
    label = F.lit(None).cast("string")
    for k, v in targets.items():
        label = F.when(F.col("geo_id") == k, F.lit(v)).otherwise(label)
    return _rows(places.join(x, "geo_id", "left"), question, context_group="region", highlight_flag=hit, label_text=label)


def neighbor_context(g: DataFrame, edges: DataFrame, question: str, level: str, target: str, metric: str, where: Column | None = None) -> DataFrame:
    """The target, the places touching it and the rest. `edges`: src, dst."""
    ring = edges.filter(F.col("src") == target).select(F.col("dst").alias("geo_id")).unionByName(edges.filter(F.col("dst") == target).select(F.col("src").alias("geo_id")))
    df = at(g, level).filter(F.col(metric).isNotNull())
    if where is not None:
        df = df.filter(where)
    df = df.join(ring.distinct().withColumn("__n", F.lit(True)), "geo_id", "left")
    return _rows(df, question, metric_value=metric, highlight_flag=F.col("geo_id") == target, neighbor_flag=F.coalesce("__n", F.lit(False)))


def line_sample(g: DataFrame, x: DataFrame, target: str, others: Sequence[str], years: tuple[int, int]) -> DataFrame:
    """Population of the target, and income of target and peers as level and index input."""
    df = g.filter((F.col("geo_level") == "cbsa") & F.col("year").between(*years)).join(x, "geo_id", "left")
    null_i = F.lit(None).cast("int")
    one = lambda d, q, w, m, base: _rows(d.filter(F.col(m).isNotNull()), q, period="year", time_window=F.lit(w), metric_id=F.lit(m), metric_value=m, group="region",
                                         highlight_flag=F.col("geo_id") == target, index_base_period=base)
    peers = df.filter(F.col("geo_id").isin([target, *others]))
    return one(df.filter(F.col("geo_id") == target), "line_single_population", "level", "pop_total", null_i).unionByName(
        one(peers, "line_multi_income", "level", "income_pc", null_i)).unionByName(one(peers, "line_indexed_income", "indexed", "income_pc", F.lit(years[0])))


def symbols(g: DataFrame, x: DataFrame, question: str, level: str, size: str, group: str, p: float, where: Column | None = None) -> DataFrame:
    """Sizes with the largest labelled by an exact quantile."""
    df = at(g, level, known=[size]).join(x, "geo_id").filter(F.col(size).isNotNull())
    if where is not None:
        df = df.filter(where)
    df = K.quantile_flag(df, [], size, p, "label_flag")
    return _rows(df, question, size_value=size, color_group=group, label_flag="label_flag")


def majority(g: DataFrame, level: str = "county", size: str = "permits", half: float = 0.50, label: float = 0.25) -> DataFrame:
    """Places that together make up the first half of a total, largest first."""
    df = at(g, level, known=[size]).filter(F.col(size) > 0)
    s = K.cumulative_share(df, [], size, IDS)
    flag = F.col("cumulative_share") <= half
    return _rows(s, "symbol_permit_majority", size_value=size, cumulative_share="cumulative_share",
                 color_group=F.when(flag, "Top places to 50% of units").otherwise("Remaining places"), highlight_flag=flag, label_flag=F.col("cumulative_share") <= label)


def weighted_points(g: DataFrame, pairs: DataFrame, question: str, level: str, size: str, p: float) -> DataFrame:
    """Sizes at the weighted mean point of each place's parts.

    `pairs`: geo_id, weight, lon, lat of every part."""
    pts = pairs.groupBy("geo_id").agg(ratio_or_null(F.sum(F.col("weight") * F.col("lon")), F.sum("weight")).alias("lon"),
                                      ratio_or_null(F.sum(F.col("weight") * F.col("lat")), F.sum("weight")).alias("lat"))
    df = K.quantile_flag(at(g, level).filter(F.col(size).isNotNull()).join(pts, "geo_id"), [], size, p, "label_flag")
    return _rows(df, question, size_value=size, lon="lon", lat="lat", label_flag="label_flag")


def target_zone_proxy(features: DataFrame, market: str, weights: Mapping[str, float], p_label: float = 0.92, p_keep: float = 0.75) -> DataFrame:
    """Tracts of one market worth a symbol: eligible, or in the upper quarter of a proxy score."""
    f = features.filter((F.col("cbsa_code") == market) & F.col("pop_total").isNotNull() & F.col("pop_density").isNotNull())
    f = f.withColumn("target_zone_score", sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)))
    q = column_quantiles(f, [], {"a": ("target_zone_score", p_label), "b": ("target_zone_score", p_keep)}).select(F.struct("a", "b")).scalar()
    f = f.withColumn("__q", q)
    hl = F.col("eligible_v1") == 1
    out = f.select(F.col("tract_geoid").alias("geo_id"), F.col("pop_total").alias("size_value"), F.when(hl, "Eligible target-zone tract").otherwise("Context tract").alias("color_group"),
                   hl.alias("highlight_flag"), "target_zone_score", (F.round("target_zone_score", 9) >= F.round("__q.a", 9)).alias("label_flag"),
                   (F.round("target_zone_score", 9) >= F.round("__q.b", 9)).alias("__keep"))
    return out.filter(F.col("highlight_flag") | F.col("__keep")).drop("__keep")


def growth_vs_burden_scatter(g: DataFrame, x: DataFrame, base: int, snap: int, target: str, level: str = "cbsa") -> DataFrame:
    """Income growth against rent burden for places with growth at both years."""
    lv = g.filter(F.col("geo_level") == level)
    b = lv.filter((F.col("year") == base) & finite("income_pc_growth_3yr")).select("geo_id")
    s = lv.filter((F.col("year") == snap) & finite("income_pc_growth_3yr") & F.col("pct_rent_burden_30plus").isNotNull()).join(b, "geo_id", "left_semi").join(x, "geo_id", "left")
    return _rows(s, "scatter_income_growth_vs_rent_burden", x_value=F.col("income_pc_growth_3yr") * 100.0, y_value=F.col("pct_rent_burden_30plus") * 100.0, group="region",
                 size_value="hu_total", label_flag=F.col("geo_id") == target)


def value_vs_income_scatter(g: DataFrame, x: DataFrame, year: int, target: str, p: float = 0.95, level: str = "county") -> DataFrame:
    """Home value against income; the top of the ratio's distribution labelled."""
    df = at(g, level, year, ["median_hh_income", "median_home_value"]).join(x, "geo_id", "left").withColumn("__ratio", ratio_or_null("median_home_value", "median_hh_income"))
    df = K.cume_dist(df, [], "__ratio", ["geo_id"], "__cd")
    return _rows(df, "scatter_home_value_vs_income", x_value="median_hh_income", y_value="median_home_value", group="region", size_value="hu_total",
                 label_flag=(F.col("__cd") >= p) | (F.col("geo_id") == target))


def rent_vs_income_scatter(g: DataFrame, x: DataFrame, year: int, metro: str, target: str, limit: float = 2.0) -> DataFrame:
    """Rent against income in one metro; places with an unusual ratio labelled."""
    df = at(g, "tract", year, ["median_hh_income", "median_gross_rent"]).join(x.filter(F.col("cbsa_code") == metro), "geo_id")
    df = z_outliers(df.withColumn("ratio", ratio_or_null(F.col("median_gross_rent") * 12.0, "median_hh_income")), [], ["ratio"], limit)
    return _rows(df, "scatter_rent_vs_income_outliers", x_value="median_hh_income", y_value="median_gross_rent", group="cbsa_name", size_value="hu_total",
                 label_flag=F.col("outlier_flag") | (F.col("geo_id") == target))


# ---- waterfalls -----------------------------------------------------------


def change_components(df: DataFrame, question: str, components: Mapping[str, tuple], start: int, end: int, scale: float = 1.0) -> DataFrame:
    """Change of each component between two years; `components` maps a column to
    (label, group, order)."""
    e = endpoints_pivot(df, list(PLACE), "year", list(components), start, end)
    cells = F.array(*[F.struct(F.lit(c).alias("component_id"), F.lit(a[0]).alias("component_label"), F.lit(a[1]).alias("component_group"), F.lit(a[2]).alias("sort_order"),
                               (F.col(f"{c}_end") / scale).alias("component_value"), (F.col(f"{c}_delta") / scale).alias("component_delta")) for c, a in components.items()])
    out = e.withColumn("__c", F.explode(cells)).select(F.lit(question).alias("question_id"), *PLACE, "__c.*")
    return out.filter(F.col("component_delta").isNotNull())


def income_mix(g: DataFrame, x: DataFrame, target: str) -> DataFrame:
    """Wage and other income per head, target beside its region's metros."""
    df = at(g, "cbsa", known=["pi_total", "pi_wages_salary"]).join(x, "geo_id")
    region = x.filter(F.col("geo_id") == target).select(F.max("region")).scalar()
    cols = [F.sum(c).alias(c) for c in ("pi_total", "pi_wages_salary", "pop_total")]
    own = df.filter(F.col("geo_id") == target).agg(*cols).select(F.lit("Target CBSA").alias("benchmark_label"), "*")
    bench = df.filter(F.col("region") == region).agg(*cols).select(F.lit("Regional benchmark").alias("benchmark_label"), "*")
    both = own.unionByName(bench)
    cells = F.array(
        F.struct(F.lit("wages_salary").alias("component_id"), F.lit(1).alias("sort_order"), ratio_or_null("pi_wages_salary", "pop_total").alias("component_value")),
        F.struct(F.lit("nonwage_income").alias("component_id"), F.lit(2).alias("sort_order"), ratio_or_null(F.col("pi_total") - F.col("pi_wages_salary"), "pop_total").alias("component_value")))
    return both.select("benchmark_label", F.explode(cells).alias("c")).select("benchmark_label", "c.*")


def negative_offsets(g: DataFrame, x: DataFrame, target: str, sectors: Mapping[str, tuple], start: int, end: int) -> DataFrame:
    """The growing county of a metro with the largest sector losses, by sector."""
    df = g.filter(F.col("geo_level") == "county").join(x.filter(F.col("cbsa_code") == target).select("geo_id"), "geo_id", "left_semi")
    e = endpoints_pivot(df, list(PLACE), "year", list(sectors), start, end)
    delta = [F.col(f"{s}_delta") for s in sectors]
    e = e.withColumns({"net_delta": sum0(*delta), "negative_delta": reduce(lambda a, b: a + b, [F.least(d, F.lit(0.0)) for d in delta])})
    best = e.filter((F.col("net_delta") > 0) & (F.col("negative_delta") < 0)).orderBy(
        F.round(F.abs("negative_delta"), 4).desc(), F.round("net_delta", 4).desc(), asc_last("geo_id")).limit(1)
    cells = F.array(*[F.struct(F.lit(s).alias("component_id"), F.lit(a[0]).alias("component_label"), F.lit(a[2]).alias("sort_order"), F.col(f"{s}_delta").alias("component_delta"))
                      for s, a in sectors.items()])
    return best.select(*PLACE, "net_delta", F.explode(cells).alias("c")).select(*PLACE, "net_delta", "c.*")
