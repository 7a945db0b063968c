"""Analytical sample questions over stand-in gold rows."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.joins import grid_polys
from catalog.registry import query
from catalog.scoring import _CF, _cf_rank, features, metro_features
from catalog.scoring import sql as feature_sql
from terrapanel.operators.series import growth_many
from terrapanel.operators.spatial import adjacency_edges
from terrapanel.plans import questions as Q
from terrapanel.plans.scoring import CBSA_METRICS

EXTRA = {
    "permits_per_1000_population": "permits_per_1000", "pct_unemployment_rate": "3e0 / (hu_total * 2 + 4)", "jobs_to_pop_ratio": "hu_total / pop_total",
    "pct_commute_drive_alone": "race_a / pop_total", "pct_commute_carpool": "CASE WHEN hu_total % 3 <> 0 THEN race_n / pop_total END",
    "rpp_real_pc_income": "income_pc * 5e-1", "pi_total": "income_total", "pi_wages_salary": "gdp_1 + gdp_2"}
_GROW = {("pop_total", "pop"): (3, 5), ("income_pc", "income_pc"): (3, 5), ("jobs_to_pop_ratio", "lfpr"): (3, 5)}


def gold(t, *levels):
    m = S.mart(t, *levels).withColumns({c: F.expr(e) for c, e in EXTRA.items()})
    return growth_many(m, ["geo_level", "geo_id"], "year", {"pop_total": "pop", "income_pc": "income_pc", "jobs_to_pop_ratio": "lfpr"}, (3, 5), cagr=(5,))


def sql(*levels, body, extra=""):
    lag = lambda c, h: f"lag({c}, {h}) OVER w"
    grow = ", ".join(f"CASE WHEN {lag(c, h)} > 0 THEN ({c} - {lag(c, h)}) / {lag(c, h)} END AS {p}_growth_{h}yr" for (c, p), hs in _GROW.items() for h in hs)
    cagr = "CASE WHEN lag(income_pc, 5) OVER w > 0 THEN pow(income_pc / lag(income_pc, 5) OVER w, 0.2) - 1 END AS income_pc_cagr_5yr"
    g0 = f"gold0 AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in EXTRA.items())} FROM mart), g AS (SELECT *, {grow}, {cagr} FROM gold0 WINDOW w AS (PARTITION BY geo_level, geo_id ORDER BY year)), ly AS (SELECT geo_level, max(year) AS y FROM g GROUP BY geo_level), gl AS (SELECT g.* FROM g JOIN ly USING (geo_level) WHERE year = y), cx AS (SELECT county_geoid AS geo_id, cbsa_code, cbsa_name, census_region AS region FROM county_cbsa), tx AS (SELECT tract_geoid AS geo_id, cbsa_code, cbsa_name, census_region AS region, c_mktsegment AS segment FROM tract_cbsa), mx AS (SELECT cbsa_code AS geo_id, cbsa_name, census_region AS region FROM cbsa_region)"
    return S.sql_mart(*levels, extra=g0 + (", " + extra if extra else ""), body=body)


def cx(t):
    return S.county_cbsa(t).select(F.col("county_geoid").alias("geo_id"), "cbsa_code", "cbsa_name", F.col("census_region").alias("region"))


def tx(t):
    return S.tract_cbsa(t).select(F.col("tract_geoid").alias("geo_id"), "cbsa_code", "cbsa_name", F.col("census_region").alias("region"), F.col("c_mktsegment").alias("segment"))


def mx(t):
    return S.cbsa_region(t).select(F.col("cbsa_code").alias("geo_id"), "cbsa_name", F.col("census_region").alias("region"))


P3 = "geo_level, geo_id, geo_name"
METRO, YEAR = "10003", 2001

# ---- age pyramids ---------------------------------------------------------

CELLS = {"age_1": ("0-14", "Male"), "age_2": ("0-14", "Female"), "age_3": ("15-64", "Male"), "age_4": ("15-64", "Female"), "age_5": ("15-64", "Female"), "age_6": ("65+", "Male"), "age_7": ("65+", "Female")}
_UNP = "(VALUES " + ", ".join(f"('{c}', '{b}', '{s}')" for c, (b, s) in CELLS.items()) + ") c(col, age_bin, sex)"
_VAL = "CASE col " + " ".join(f"WHEN '{c}' THEN {c}" for c in CELLS) + " END"
_PYR = lambda q, src: f"SELECT '{q}' AS question_id, {P3}, year, facet_label, age_bin, sex, sum({_VAL}) AS pop_value, max(pop_total) AS pop_total, max(bl) AS benchmark_label, bool_or(hl) AS highlight_flag FROM ({src}) s, {_UNP} GROUP BY ALL"


@query("age_pyramid_age_sex_helper", sql("county", body=_PYR("helper", "SELECT *, geo_name AS facet_label, CAST(NULL AS VARCHAR) AS bl, true AS hl FROM gl")), real="pop_value pop_total", ints="year")
def pyramid_helper(t):
    return Q.pyramid_rows(Q.at(gold(t, "county"), "county"), "helper", CELLS, F.col("geo_name"), F.lit(None).cast("string"), F.lit(True))


@query("age_pyramid_cbsa_vs_us", sql("cbsa", "us", body=_PYR("pyramid_cbsa_vs_us", f"SELECT *, CASE WHEN geo_level = 'us' THEN '{METRO}' ELSE geo_name END AS facet_label, CASE WHEN geo_level = 'us' THEN 'United States' END AS bl, geo_level <> 'us' AS hl FROM gl WHERE geo_level = 'us' OR geo_id = '{METRO}'")), real="pop_value pop_total", ints="year")
def pyramid_us(t):
    return Q.pyramid_vs_nation(gold(t, "cbsa", "us"), CELLS, METRO)


def _top_sql(q, share, lv, parent, k, where=""):
    x = "cx" if lv == "county" else "tx"
    return sql(lv, "cbsa", extra=f"top AS (SELECT gl.*, {x}.cbsa_code AS pid, {x}.cbsa_name AS pname FROM gl JOIN {x} USING (geo_id) WHERE geo_level = '{lv}' AND cbsa_code = '{METRO}'{where} ORDER BY round({share}, 12) DESC, geo_name, geo_id LIMIT {k})", body="SELECT * FROM (" + _PYR(q, "SELECT * EXCLUDE (pid, pname), geo_name || ' vs ' || pname AS facet_label, CAST(NULL AS VARCHAR) AS bl, true AS hl FROM top") + ") UNION ALL SELECT * FROM (" + _PYR(q, "SELECT gl.*, t.geo_name || ' vs ' || t.pname AS facet_label, t.pname AS bl, false AS hl FROM gl JOIN top t ON gl.geo_id = t.pid AND gl.geo_level = 'cbsa'") + ")")


def _px(x):
    return x.select("geo_id", "cbsa_code", F.col("cbsa_code").alias("parent_id"), F.col("cbsa_name").alias("parent_name"))


@query("age_pyramid_county_family_profile", _top_sql("pyramid_county_family_profile", "(age_1 + age_2 + age_4) / pop_total", "county", "cbsa", 3), real="pop_value pop_total", ints="year")
def pyramid_family(t):
    return Q.pyramid_top_places(gold(t, "county", "cbsa"), _px(cx(t)), "pyramid_county_family_profile", CELLS, (F.col("age_1") + F.col("age_2") + F.col("age_4")) / F.col("pop_total"), "county", "cbsa", 3, METRO)


@query("age_pyramid_housing_demand_alignment", _top_sql("pyramid_housing_demand_alignment", "(age_1 + age_4) / pop_total", "county", "cbsa", 1), real="pop_value pop_total", ints="year")
def pyramid_demand(t):
    return Q.pyramid_top_places(gold(t, "county", "cbsa"), _px(cx(t)), "pyramid_housing_demand_alignment", CELLS, (F.col("age_1") + F.col("age_4")) / F.col("pop_total"), "county", "cbsa", 1, METRO)


@query("age_pyramid_zcta_retiree_profile", _top_sql("pyramid_zcta_retiree_profile", "(age_6 + age_7) / pop_total", "tract", "cbsa", 3, " AND pop_total >= 100"), real="pop_value pop_total", ints="year")
def pyramid_retiree(t):
    return Q.pyramid_top_places(gold(t, "tract", "cbsa"), _px(tx(t)), "pyramid_zcta_retiree_profile", CELLS, (F.col("age_6") + F.col("age_7")) / F.col("pop_total"), "tract", "cbsa", 3, METRO, where=F.col("pop_total") >= 100)


@query("age_pyramid_peer_aging_compare", sql("cbsa", "us", body=_PYR("pyramid_peer_aging_compare", f"SELECT *, CAST(year AS VARCHAR) AS facet_label, CASE WHEN geo_level = 'us' THEN 'United States' END AS bl, geo_level <> 'us' AS hl FROM g WHERE (geo_level = 'us' OR geo_id = '{METRO}') AND year IN (1996, 2001)")), real="pop_value pop_total", ints="year")
def pyramid_periods(t):
    return Q.pyramid_two_periods(gold(t, "cbsa", "us"), CELLS, METRO, 1996)


# ---- bars, boxes, maps ----------------------------------------------------


@query("bar_sample", sql("cbsa", "county", body=f"""
SELECT 'bar_top_growth_cbsas' AS question_id, {P3}, (year - 5) || '_to_' || year || '_growth' AS time_window, 'income_pc_growth_5yr' AS metric_id, income_pc_growth_5yr * 100 AS metric_value, row_number() OVER (ORDER BY income_pc_growth_5yr DESC, geo_name, geo_id) AS rank, region AS "group", geo_id = '{METRO}' AS highlight_flag FROM gl LEFT JOIN mx USING (geo_id) WHERE geo_level = 'cbsa' AND income_pc_growth_5yr IS NOT NULL
UNION ALL SELECT 'bar_county_affordability', {P3}, year || '_snapshot', 'rent_to_income', rent_to_income * 100, row_number() OVER (ORDER BY rent_to_income DESC, geo_name, geo_id), 'target counties', false FROM gl JOIN cx USING (geo_id) WHERE geo_level = 'county' AND cbsa_code = '{METRO}'"""), real="metric_value")
def bar_sample(t):
    g = gold(t, "cbsa", "county")
    return Q.bar_sample(g, mx(t), cx(t).withColumnRenamed("region", "r"), METRO).withColumn("group", F.when(F.col("question_id") == "bar_county_affordability", "target counties").otherwise(F.col("group")))


_XY = lambda q, x, y, grp, src, w="NULL": f"SELECT '{q}' AS question_id, {P3}, year, {x} AS x_value, {y} AS y_value, {grp} AS \"group\", {w} AS weight_value FROM {src}"


@query("bivariate_q1_county_growth_affordability", sql("county", body=_XY("bivar_growth_affordability_counties", "pop_growth_5yr", "1 / nullif(value_to_income, 0)", "region", "gl JOIN cx USING (geo_id) WHERE pop_growth_5yr IS NOT NULL AND region NOT IN ('AFRICA')")), real="x_value y_value weight_value", ints="year")
def biv1(t):
    return Q.xy(gold(t, "county"), cx(t), "bivar_growth_affordability_counties", "county", F.col("pop_growth_5yr"), F.try_divide(F.lit(1.0), F.col("value_to_income")), "region", where=~F.col("region").isin("AFRICA"))


@query("bivariate_q2_tract_stress_zone_proxy", sql("tract", body=_XY("bivar_stress_zone_zctas", "pct_rent_burden_30plus", "-median_hh_income", "cbsa_name", f"gl JOIN tx USING (geo_id) WHERE cbsa_code = '{METRO}'")), real="x_value y_value weight_value", ints="year")
def biv2(t):
    return Q.xy(gold(t, "tract"), tx(t), "bivar_stress_zone_zctas", "tract", F.col("pct_rent_burden_30plus"), -F.col("median_hh_income"), "cbsa_name", where=F.col("cbsa_code") == METRO)


@query("bivariate_q3_local_overlap_target_cbsa", sql("tract", body=_XY("bivar_local_overlap_target_cbsa", "pct_rent_burden_30plus", "mean_travel_time", "cbsa_name", f"gl JOIN tx USING (geo_id) WHERE cbsa_code = '{METRO}'")), real="x_value y_value weight_value", ints="year")
def biv3(t):
    return Q.xy(gold(t, "tract"), tx(t), "bivar_local_overlap_target_cbsa", "tract", F.col("pct_rent_burden_30plus"), F.col("mean_travel_time"), "cbsa_name", where=F.col("cbsa_code") == METRO)


@query("bivariate_q4_cbsa_region_overlap", sql("cbsa", body=_XY("bivar_cbsa_region_overlap", "income_pc_growth_5yr", "1 / nullif(rent_to_income, 0)", "region", "gl JOIN mx USING (geo_id) WHERE income_pc_growth_5yr IS NOT NULL")), real="x_value y_value weight_value", ints="year")
def biv4(t):
    return Q.xy(gold(t, "cbsa"), mx(t), "bivar_cbsa_region_overlap", "cbsa", F.col("income_pc_growth_5yr"), F.try_divide(F.lit(1.0), F.col("rent_to_income")), "region", known=["income_pc_growth_5yr"])


_WIN = lambda q, lv, extra="": " UNION ALL ".join(f"SELECT '{q}' AS question_id, {P3}, '{lb}' AS time_window, {c} AS metric_value, region AS \"group\"{extra} FROM gl JOIN {'cx' if lv == 'county' else 'mx'} USING (geo_id) WHERE {c} IS NOT NULL" for lb, c in (("5yr_growth", "pop_growth_5yr"), ("3yr_growth", "pop_growth_3yr")))
WINDOWS = {"5yr_growth": "pop_growth_5yr", "3yr_growth": "pop_growth_3yr"}


@query("bivariate_q5_county_growth_window_compare", sql("county", body=_WIN("bivar_growth_window_compare", "county", ", 1 / nullif(value_to_income, 0) AS y_value")), real="metric_value y_value")
def biv5(t):
    return Q.growth_windows(gold(t, "county"), cx(t), "bivar_growth_window_compare", "county", WINDOWS, {"y_value": F.try_divide(F.lit(1.0), F.col("value_to_income"))})


_ONE = lambda q, m, grp, hl, src: f"SELECT '{q}' AS question_id, {P3}, year, '{m}' AS metric_id, {m} AS metric_value, {grp} AS \"group\", {hl} AS highlight_flag FROM {src}"


@query("boxplot_q1_rent_burden_by_region", sql("cbsa", body=_ONE("boxplot_rent_burden_by_region", "pct_rent_burden_30plus", "region", f"geo_id = '{METRO}'", "gl JOIN mx USING (geo_id)")), real="metric_value", ints="year")
def box1(t):
    return Q.one_metric(gold(t, "cbsa"), mx(t), "boxplot_rent_burden_by_region", "cbsa", "pct_rent_burden_30plus", "region", F.col("geo_id") == METRO)


@query("boxplot_q2_target_cbsa_county_rent_to_income", sql("county", body=_ONE("boxplot_target_cbsa_county_rent_to_income", "rent_to_income", "region", "geo_name LIKE '%3'", f"gl JOIN cx USING (geo_id) WHERE cbsa_code = '{METRO}'")), real="metric_value", ints="year")
def box2(t):
    return Q.one_metric(gold(t, "county"), cx(t), "boxplot_target_cbsa_county_rent_to_income", "county", "rent_to_income", "region", F.col("geo_name").like("%3"), where=F.col("cbsa_code") == METRO)


@query("boxplot_q3_target_cbsa_zcta_commute_tail", sql("tract", body=f"""SELECT 'boxplot_target_cbsa_zcta_commute_tail' AS question_id, {P3}, m AS metric_value, segment AS "group", row_number() OVER (ORDER BY round(m, 9) DESC, geo_id) <= 3 AS highlight_flag FROM (SELECT *, mean_travel_time * (coalesce(pct_commute_drive_alone, 0) + coalesce(pct_commute_carpool, 0)) AS m FROM gl JOIN tx USING (geo_id) WHERE cbsa_code = '{METRO}')"""), real="metric_value")
def box3(t):
    return Q.commute_tail(gold(t, "tract"), tx(t), METRO)


@query("boxplot_q4_sweet_spot_affordability_outliers", S.sql_mart("county", extra=_CF + ", r AS (SELECT *, " + ", ".join(_cf_rank(m, CBSA_METRICS[m]) for m in ("pop_growth_5yr", "median_home_value")) + " FROM f), s AS (SELECT *, cbsa_type = 'Metro Area' AND national_pop_growth_5yr_pctl >= 0.7 AND national_median_home_value_pctl <= 0.85 AS sweet FROM r WHERE year = (SELECT max(year) FROM r))",
       body="SELECT 'boxplot_sweet_spot_affordability_outliers' AS question_id, cbsa_code AS geo_id, median_home_value AS metric_value, cbsa_type AS \"group\", sweet AS highlight_flag, sweet AND national_pop_growth_5yr_pctl >= 0.95 AS label_flag, pop_total AS weight_value FROM s"), real="metric_value weight_value")
def box4(t):
    return Q.sweet_spot_boxplot(metro_features(t), min_growth=0.7)


@query("boxplot_q5_income_growth_by_cbsa_type", sql("tract", body=_ONE("boxplot_income_growth_by_cbsa_type", "income_pc_cagr_5yr", "segment", "geo_id = '00000000009'", "gl JOIN tx USING (geo_id) WHERE income_pc_cagr_5yr IS NOT NULL")), real="metric_value", ints="year")
def box5(t):
    return Q.one_metric(gold(t, "tract"), tx(t), "boxplot_income_growth_by_cbsa_type", "tract", "income_pc_cagr_5yr", "segment", F.col("geo_id") == "00000000009")


# ---- bumps ----------------------------------------------------------------

_RK = lambda q, m, src, order, grp="'all'", hl="false": f"SELECT '{q}' AS question_id, {P3}, year AS period, '{m}' AS metric_id, {m} AS metric_value, row_number() OVER (PARTITION BY year ORDER BY {m} {order}, geo_name, geo_id) AS rank, {grp} AS \"group\", {hl} AS highlight_flag FROM {src}"


@query("bump_county_rent_burden_rank", sql("county", extra="s AS (" + _RK("bump_county_rent_burden_rank", "pct_rent_burden_30plus", f"g JOIN cx USING (geo_id) WHERE cbsa_code = '{METRO}' AND year BETWEEN 1996 AND 2001", "DESC") + "), m AS (SELECT geo_id, row_number() OVER (ORDER BY max(CASE WHEN period = 1996 THEN rank END) - max(CASE WHEN period = 2001 THEN rank END) DESC NULLS LAST, geo_id) AS o FROM s GROUP BY geo_id)",
       body="SELECT s.* EXCLUDE (highlight_flag), o <= 2 AS highlight_flag FROM s JOIN m USING (geo_id)"), real="metric_value", ints="period")
def bump1(t):
    return Q.county_rank_movers(gold(t, "county"), cx(t), METRO, 1996, 2001)


_PCT = lambda c, d="": f"percent_rank() OVER (PARTITION BY year ORDER BY {c} {d})"


@query("bump_sweet_spot_overheating", sql("tract", extra=f"b AS (SELECT * FROM g WHERE year BETWEEN 2000 AND 2001 AND pop_growth_5yr IS NOT NULL AND income_pc_growth_5yr IS NOT NULL), s AS (SELECT *, round(100 * (0.40 * {_PCT('income_pc_growth_5yr')} + 0.30 * {_PCT('pop_growth_5yr')} + 0.30 * {_PCT('value_to_income', 'DESC')}), 9) AS sweet, round(100 * (0.35 * {_PCT('pop_growth_5yr')} + 0.25 * {_PCT('income_pc_growth_5yr')} + 0.25 * {_PCT('value_to_income')} + 0.15 * {_PCT('pct_rent_burden_30plus')}), 9) AS overheating_score FROM b), k AS (SELECT geo_id FROM s WHERE year = 2001 ORDER BY sweet DESC, geo_name, geo_id LIMIT 12)",
       body=_RK("bump_sweet_spot_overheating", "overheating_score", "s WHERE geo_id IN (SELECT geo_id FROM k)", "DESC")), real="metric_value", ints="period")
def bump2(t):
    return Q.sweet_spot_overheating(gold(t, "tract"), (2000, 2001), 2001, level="tract")


_PEERS = ["10001", "10002", "10003", "10004", "10011"]


@query("bump_target_affordability_rank", sql("cbsa", body=_RK("bump_target_affordability_rank", "value_to_income", "g WHERE geo_id IN ('10001', '10002', '10003', '10004', '10011') AND year BETWEEN 1996 AND 2001", "ASC", hl="geo_id = '10003'")), real="metric_value", ints="period")
def bump3(t):
    return Q.peer_ranks(gold(t, "cbsa"), "bump_target_affordability_rank", _PEERS, METRO, range(1996, 2002))


@query("bump_top10_growth", sql("tract", body=_RK("bump_top10_growth", "pop_growth_3yr", "g WHERE year BETWEEN 1998 AND 2001 AND pop_growth_3yr IS NOT NULL", "DESC")), real="metric_value", ints="period")
def bump4(t):
    return Q.ranked_series(gold(t, "tract"), "bump_top10_growth", "pop_growth_3yr", (1998, 2001))


@query("bump_top_performer_stability", sql("county", body=_RK("bump_top_performer_stability", "income_pc_growth_3yr", "g WHERE year BETWEEN 1998 AND 2001 AND income_pc_growth_3yr IS NOT NULL", "DESC")), real="metric_value", ints="period")
def bump5(t):
    return Q.ranked_series(gold(t, "county"), "bump_top_performer_stability", "income_pc_growth_3yr", (1998, 2001))


# ---- choropleths ----------------------------------------------------------


@query("choropleth_q1_county_rent_burden_clusters", sql("county", body=_ONE("map_rent_burden_clusters", "pct_rent_burden_30plus", "region", "false", "gl JOIN cx USING (geo_id) WHERE region <> 'EUROPE'")), real="metric_value", ints="year")
def map1(t):
    return Q.one_metric(gold(t, "county"), cx(t), "map_rent_burden_clusters", "county", "pct_rent_burden_30plus", "region", F.lit(False), where=F.col("region") != "EUROPE")


@query("choropleth_q2_county_population_growth_corridors", sql("county", body=_ONE("map_population_growth_corridors", "pop_growth_5yr", "region", "false", "gl JOIN cx USING (geo_id) WHERE pop_growth_5yr IS NOT NULL")), real="metric_value", ints="year")
def map2(t):
    return Q.one_metric(gold(t, "county"), cx(t), "map_population_growth_corridors", "county", "pop_growth_5yr", "region", F.lit(False))


_OUT = lambda q: f"SELECT '{q}' AS question_id, {P3}, year, value_to_income AS metric_value, cbsa_name AS \"group\", value_to_income >= quantile_cont(value_to_income, 0.95) OVER () AS highlight_flag FROM gl JOIN tx USING (geo_id) WHERE cbsa_code = '{METRO}'"


@query("choropleth_q3_tract_affordability_outliers", sql("tract", body=_OUT("map_tract_affordability_outliers")), real="metric_value", ints="year")
def map3(t):
    return Q.within_metro_outliers(gold(t, "tract"), tx(t), "map_tract_affordability_outliers", METRO)


@query("choropleth_q4_cbsa_benchmark_relative_metros", sql("cbsa", body=f"SELECT 'map_benchmark_relative_metros' AS question_id, {P3}, year, rpp_real_pc_income AS metric_value, (SELECT sum(rpp_real_pc_income * pop_total) / sum(pop_total) FROM gl) AS benchmark_value, region AS \"group\" FROM gl JOIN mx USING (geo_id)"), real="metric_value benchmark_value", ints="year")
def map4(t):
    return Q.against_weighted_benchmark(gold(t, "cbsa"), mx(t))


@query("choropleth_q5_cbsa_growth_window_compare", sql("cbsa", body=_WIN("map_growth_window_compare", "cbsa")), real="metric_value")
def map5(t):
    return Q.growth_windows(gold(t, "cbsa"), mx(t), "map_growth_window_compare", "cbsa", WINDOWS)


# ---- correlation inputs ---------------------------------------------------

_MT = lambda q, metrics, src, keys="": " UNION ALL ".join(f"SELECT '{q}' AS question_id, {P3}{keys}, '{m}' AS metric_id, {m} AS metric_value FROM {src} WHERE {m} IS NOT NULL" for m in metrics)
C1 = ("median_hh_income", "income_pc", "median_gross_rent", "median_home_value", "rent_to_income", "value_to_income")
C2 = ("pop_total", "median_hh_income", "pct_ba_plus", "pct_rent_burden_30plus", "permits_per_1000_population", "pop_growth_5yr", "income_pc_growth_5yr", "lfpr_growth_5yr")
C3 = ("pct_rent_burden_30plus", "median_hh_income", "median_gross_rent", "value_to_income", "vacancy_rate", "permits_per_1000_population", "pct_ba_plus", "pct_unemployment_rate")
C4 = ("pop_growth_5yr", "median_hh_income", "pct_ba_plus", "pct_rent_burden_30plus", "value_to_income", "permits_per_1000_population")
C5 = ("median_gross_rent", "median_home_value", "value_to_income", "pct_rent_burden_30plus", "vacancy_rate", "permits_per_1000_population", "owner_occ_rate")


@query("correlation_q1_redundant_kpis", sql("county", body=_MT("corr_redundant_kpis", C1, "gl")), real="metric_value")
def corr1(t):
    return Q.metric_table(Q.at(gold(t, "county"), "county"), "corr_redundant_kpis", C1)


@query("correlation_q2_growth_vs_level_blocks", sql("county", body=_MT("corr_growth_vs_level_blocks", C2, "gl")), real="metric_value")
def corr2(t):
    return Q.metric_table(Q.at(gold(t, "county"), "county"), "corr_growth_vs_level_blocks", C2)


@query("correlation_q3_rent_burden_driver_scan", sql("county", body=_MT("corr_rent_burden_driver_scan", C3, "gl")), real="metric_value")
def corr3(t):
    return Q.metric_table(Q.at(gold(t, "county"), "county"), "corr_rent_burden_driver_scan", C3)


_NEED = ("pop_growth_5yr", "pct_rent_burden_30plus", "value_to_income", "permits_per_1000_population")


@query("correlation_q4_sweet_spot_compare", sql("tract", extra="b AS (SELECT gl.*, CASE WHEN segment = 'BUILDING' THEN 'Micro Area' ELSE 'Metro Area' END AS cbsa_type FROM gl JOIN tx USING (geo_id)), k AS (SELECT geo_id FROM (SELECT *, " + ", ".join(f"percent_rank() OVER (ORDER BY {c}) AS p{i}" for i, c in enumerate(_NEED)) + " FROM b WHERE cbsa_type = 'Metro Area' AND pop_total BETWEEN 50 AND 400 AND pop_growth_5yr IS NOT NULL) WHERE p0 >= 0.65 AND p3 >= 0.55 AND p1 <= 0.45 AND p2 <= 0.45 ORDER BY round(p0 + p3 - p1 - p2, 9) DESC, geo_name, geo_id LIMIT 12), c AS (SELECT *, 'All CBSAs' AS grp FROM b UNION ALL SELECT *, 'Derived Sweet Spot shortlist' FROM b WHERE geo_id IN (SELECT geo_id FROM k))",
       body=_MT("corr_sweet_spot_compare", C4, "c", ', grp AS "group"')), real="metric_value")
def corr4(t):
    x = tx(t).select("geo_id", F.when(F.col("segment") == "BUILDING", "Micro Area").otherwise("Metro Area").alias("cbsa_type"))
    return Q.sweet_spot_metrics(gold(t, "tract"), x, C4, (50, 400), level="tract")


@query("correlation_q5_county_within_cbsa", sql("county", body=_MT("corr_county_within_cbsa", C5, f"gl JOIN cx USING (geo_id) WHERE cbsa_code = '{METRO}' AND true").replace("AND true WHERE", "AND")), real="metric_value")
def corr5(t):
    own = Q.at(gold(t, "county"), "county").join(cx(t).filter(F.col("cbsa_code") == METRO).select("geo_id"), "geo_id", "left_semi")
    return Q.metric_table(own, "corr_county_within_cbsa", C5)


# ---- heatmaps and strips --------------------------------------------------


def _prof(q, metrics, src, keys=""):
    return " UNION ALL ".join(f"SELECT '{q}' AS question_id, {P3}{keys}, '{m}' AS metric_id, '{a[0]}' AS metric_label, '{a[1]}' AS metric_group, '{a[2]}' AS direction, {a[3]} AS metric_order, {m} AS metric_value FROM {src}" for m, a in metrics.items())


_SC = " + ".join(f"percent_rank() OVER (ORDER BY {m} {'' if a[2] == 'higher_is_better' else 'DESC'})" for m, a in Q.SHORTLIST.items())


@query("heatmap_q1_shortlist_scan", sql("tract", extra=f"s AS (SELECT *, round(({_SC}) / 5, 9) AS row_order FROM gl JOIN tx USING (geo_id) WHERE cbsa_code = '{METRO}'), d AS (SELECT *, row_number() OVER (ORDER BY row_order DESC, geo_name, geo_id) <= 25 AS display_flag FROM s)", body=_prof("heatmap_shortlist_scan", Q.SHORTLIST, "d", ", row_order, display_flag")), real="metric_value row_order", ints="metric_order")
def heat1(t):
    return Q.shortlist_scan(gold(t, "tract"), tx(t), METRO)


_REG = f"(SELECT max(region) FROM mx WHERE geo_id = '{METRO}')"


@query("heatmap_q2_county_dimension_compare", sql("county", extra=f"d AS (SELECT gl.*, cbsa_code = '{METRO}' AS display_flag FROM gl JOIN cx USING (geo_id) WHERE region = {_REG})", body=_prof("heatmap_county_dimension_compare", Q.PROFILE, "d", ", display_flag")), real="metric_value", ints="metric_order")
def heat2(t):
    return Q.region_profile(gold(t, "county"), cx(t), "heatmap_county_dimension_compare", "county", METRO)


@query("heatmap_q3_peer_cbsa_profile", sql("cbsa", extra=f"n AS (SELECT geo_id FROM gl JOIN mx USING (geo_id) WHERE region = {_REG} AND geo_id <> '{METRO}' ORDER BY abs(pop_total - (SELECT pop_total FROM gl WHERE geo_id = '{METRO}')), geo_id LIMIT 5), d AS (SELECT *, geo_id = '{METRO}' AS highlight_flag, geo_id = '{METRO}' OR geo_id IN (SELECT geo_id FROM n) AS display_flag FROM gl)", body=_prof("heatmap_peer_cbsa_profile", Q.PEER_PROFILE, "d", ", highlight_flag, display_flag")), real="metric_value", ints="metric_order")
def heat3(t):
    return Q.peer_profile(gold(t, "cbsa"), mx(t), METRO)


@query("heatmap_q4_zcta_persistent_stress", sql("tract", extra=f"z AS (SELECT g.* FROM g JOIN tx USING (geo_id) WHERE cbsa_code = '{METRO}' AND year BETWEEN 1996 AND 2001), k AS (SELECT geo_id FROM z GROUP BY geo_id HAVING count(pct_rent_burden_30plus) >= 4 ORDER BY round(avg(pct_rent_burden_30plus), 9) DESC, geo_id LIMIT 18)", body=f"SELECT 'heatmap_zcta_persistent_stress' AS question_id, {P3}, year AS period, pct_rent_burden_30plus AS metric_value, geo_id IN (SELECT geo_id FROM k) AS display_flag FROM z"), real="metric_value", ints="period")
def heat4(t):
    return Q.persistent_stress(gold(t, "tract"), tx(t), METRO, (1996, 2001))


_IMP = {k: Q.PEER_PROFILE[k] for k in ("pop_growth_5yr", "median_hh_income", "pct_ba_plus", "pct_unemployment_rate", "pct_rent_burden_30plus", "value_to_income", "permits_per_1000_population")}


@query("heatmap_q5_target_metric_improvement", sql("cbsa", extra=f"d AS (SELECT * FROM g WHERE geo_id = '{METRO}' AND year BETWEEN 1996 AND 2001), l AS ({_prof('heatmap_target_metric_improvement', _IMP, 'd', ', year')})",
       body="SELECT *, CASE WHEN direction = 'lower_is_better' THEN first_value(metric_value) OVER (PARTITION BY metric_id ORDER BY year) - first_value(metric_value) OVER (PARTITION BY metric_id ORDER BY year DESC) ELSE first_value(metric_value) OVER (PARTITION BY metric_id ORDER BY year DESC) - first_value(metric_value) OVER (PARTITION BY metric_id ORDER BY year) END AS row_order FROM l"), real="metric_value row_order", ints="year metric_order")
def heat5(t):
    return Q.target_improvement(gold(t, "cbsa"), METRO, (1996, 2001))


@query("strip_q1_cbsa_profile", sql("cbsa", extra=f"d AS (SELECT *, geo_id = '{METRO}' AS highlight_flag FROM gl)", body=_prof("strip_cbsa_profile", Q.PROFILE, "d", ", highlight_flag")), real="metric_value", ints="metric_order")
def strip1(t):
    df = Q.at(gold(t, "cbsa"), "cbsa").withColumn("highlight_flag", F.col("geo_id") == METRO)
    return Q.profile(df, "strip_cbsa_profile", Q.PROFILE, ["highlight_flag"])


@query("strip_q2_target_vs_peers", sql("county", extra="b AS (SELECT gl.*, region FROM gl JOIN cx USING (geo_id) WHERE region = (SELECT region FROM cx WHERE geo_id = '000000007')), o AS (SELECT pop_total AS p FROM b WHERE geo_id = '000000007'), n AS (SELECT geo_id FROM b, o WHERE geo_id <> '000000007' AND pop_total BETWEEN p * 0.7 AND p * 1.5 ORDER BY abs(pop_total - p), geo_id LIMIT 3), d AS (SELECT *, geo_id = '000000007' AS highlight_flag, geo_id = '000000007' OR geo_id IN (SELECT geo_id FROM n) AS display_flag FROM b)",
       body=_prof("strip_target_vs_peers", Q.PROFILE, "d", ", highlight_flag, display_flag")), real="metric_value", ints="metric_order")
def strip2(t):
    return Q.strip_vs_peers(gold(t, "county"), cx(t), "000000007", level="county")


@query("strip_q3_score_driver_scan", sql("county", extra="d AS (SELECT *, geo_id = '000000007' AS highlight_flag FROM gl), l AS (" + _prof("strip_score_driver_scan", Q.PROFILE, "d", ", highlight_flag") + ")", body="SELECT *, median(metric_value) OVER (PARTITION BY metric_id) AS benchmark_value FROM l"), real="metric_value benchmark_value", ints="metric_order")
def strip3(t):
    return Q.strip_vs_median(gold(t, "county"), "000000007", level="county")


@query("strip_q4_level_vs_growth_compare", sql("county", body=" UNION ALL ".join(f"SELECT 'strip_level_vs_growth_compare' AS question_id, {P3}, '{m}' AS metric_id, '{a[0]}' AS metric_label, '{a[1]}' AS metric_group, '{a[2]}' AS direction, {a[3]} AS metric_order, '{a[4]}' AS time_window, {m} AS metric_value FROM gl" for m, a in {**Q.LEVELS, **Q.GROWTHS}.items())), real="metric_value", ints="metric_order")
def strip4(t):
    return Q.profile(Q.at(gold(t, "county"), "county"), "strip_level_vs_growth_compare", {**Q.LEVELS, **Q.GROWTHS}, (), ("metric_label", "metric_group", "direction", "metric_order", "time_window"))


@query("strip_q5_county_profile_compare", sql("county", extra=f"d AS (SELECT gl.*, cbsa_code = '{METRO}' AS display_flag FROM gl JOIN cx USING (geo_id) WHERE region = {_REG})", body=_prof("strip_county_profile_compare", Q.PROFILE, "d", ", display_flag")), real="metric_value", ints="metric_order")
def strip5(t):
    return Q.region_profile(gold(t, "county"), cx(t), "strip_county_profile_compare", "county", METRO)


# ---- hexbins --------------------------------------------------------------


def _hex(name, question, y, weight=None, where_sql="true", where=None):
    @query(name, sql("tract", body=_XY(question, "median_hh_income", y, "region", f"g JOIN tx USING (geo_id) WHERE year = 2000 AND {where_sql}", weight or "NULL")), real="x_value y_value weight_value", ints="year")
    def run(t):
        return Q.xy(gold(t, "tract"), tx(t), question, "tract", F.col("median_hh_income"), F.col(y), "region", 2000, where=where, weight=weight)


_hex("hexbin_q1_zcta_affordability_density", "hexbin_affordability_density", "pct_rent_burden_30plus")
_hex("hexbin_q4_regional_density_compare", "hexbin_regional_density", "rent_to_income", where_sql="region IS NOT NULL", where="region IS NOT NULL")
_hex("hexbin_q5_population_weighted_tradeoff", "hexbin_population_weighted", "rent_to_income", weight="pop_total")


@query("hexbin_q2_zcta_growth_vs_burden_clusters", sql("tract", extra="b AS (SELECT gl.*, region, pop_growth_5yr * 100 AS xv, pct_rent_burden_30plus AS yv FROM gl JOIN tx USING (geo_id) WHERE pop_growth_5yr IS NOT NULL), q AS (SELECT quantile_cont(xv, 0.8) AS a, quantile_cont(yv, 0.8) AS c FROM b), k AS (SELECT geo_id FROM b, q WHERE xv >= a AND yv >= c ORDER BY pop_total DESC, yv DESC, xv DESC, geo_id LIMIT 4)",
       body=f"SELECT 'hexbin_growth_vs_burden' AS question_id, {P3}, xv AS x_value, yv AS y_value, region AS \"group\", geo_id IN (SELECT geo_id FROM k) AS highlight_flag FROM b"), real="x_value y_value")
def hex2(t):
    return Q.hotspots(gold(t, "tract"), tx(t), 2001, p=0.8)


@query("hexbin_q3_target_cbsa_tradeoff_shape", sql("tract", extra=f"b AS (SELECT g.*, cbsa_name FROM g JOIN tx USING (geo_id) WHERE year = 2000 AND cbsa_code = '{METRO}'), s AS (SELECT *, round(abs((value_to_income - avg(value_to_income) OVER ()) / nullif(stddev_samp(value_to_income) OVER (), 0)) + abs((rent_to_income - avg(rent_to_income) OVER ()) / nullif(stddev_samp(rent_to_income) OVER (), 0)), 9) AS e FROM b)",
       body=f"SELECT 'hexbin_target_tradeoff' AS question_id, {P3}, value_to_income AS x_value, rent_to_income AS y_value, cbsa_name AS \"group\", row_number() OVER (ORDER BY e DESC, pop_total DESC, geo_id) <= 5 AS highlight_flag FROM s"), real="x_value y_value")
def hex3(t):
    return Q.tradeoff_shape(gold(t, "tract"), tx(t), METRO, 2000)


# ---- highlight maps -------------------------------------------------------


@query("highlight_q1_target_cbsa_locator", sql("county", body=f"SELECT 'highlight_target_locator' AS question_id, {P3}, region AS context_group, geo_id = '000000007' AS highlight_flag, CASE WHEN geo_id = '000000007' THEN 'Seven' END AS label_text FROM gl JOIN cx USING (geo_id)"))
def hl1(t):
    return Q.locator(Q.at(gold(t, "county"), "county"), cx(t), "highlight_target_locator", {"000000007": "Seven"})


@query("highlight_q2_target_cbsa_outlier_proxy", sql("tract", body=_OUT("highlight_zcta_outliers")), real="metric_value", ints="year")
def hl2(t):
    return Q.within_metro_outliers(gold(t, "tract"), tx(t), "highlight_zcta_outliers", METRO)


def _edges(t):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 11, "0").alias(c)
    return adjacency_edges(grid_polys(t), "geo_id").select(pad("src"), pad("dst"))


def _near_sql(q, metric):
    return sql("tract", body=f"SELECT '{q}' AS question_id, {P3}, {metric} AS metric_value, k = 250 AS highlight_flag, k <> 250 AND k % 7 <> 3 AND abs(k % 40 - 10) <= 1 AND abs(k // 40 - 6) <= 1 AS neighbor_flag FROM (SELECT *, CAST(geo_id AS BIGINT) AS k FROM gl WHERE {metric} IS NOT NULL)")


@query("highlight_q3_neighbor_growth_context", _near_sql("highlight_neighbor_growth", "pop_growth_5yr"), real="metric_value")
def hl3(t):
    return Q.neighbor_context(gold(t, "tract"), _edges(t), "highlight_neighbor_growth", "tract", "00000000250", "pop_growth_5yr")


@query("highlight_q4_adjacent_rent_burden", _near_sql("highlight_adjacent_rent_burden", "pct_rent_burden_30plus"), real="metric_value")
def hl4(t):
    return Q.neighbor_context(gold(t, "tract"), _edges(t), "highlight_adjacent_rent_burden", "tract", "00000000250", "pct_rent_burden_30plus")


@query("highlight_q5_sweet_spot_shortlist", sql("cbsa", body=f"SELECT 'highlight_sweet_spot_shortlist' AS question_id, {P3}, region AS context_group, geo_id IN ('10002', '10008', '10017') AS highlight_flag, CASE geo_id WHEN '10002' THEN 'Two' WHEN '10008' THEN 'Eight' WHEN '10017' THEN 'Seventeen' END AS label_text FROM gl JOIN mx USING (geo_id)"))
def hl5(t):
    return Q.locator(Q.at(gold(t, "cbsa"), "cbsa"), mx(t), "highlight_sweet_spot_shortlist", {"10002": "Two", "10008": "Eight", "10017": "Seventeen"})


@query("line_sample", sql("cbsa", body=" UNION ALL ".join(f"SELECT '{q}' AS question_id, {P3}, year AS period, '{w}' AS time_window, '{m}' AS metric_id, {m} AS metric_value, region AS \"group\", geo_id = '{METRO}' AS highlight_flag, {b} AS index_base_period FROM g JOIN mx USING (geo_id) WHERE year BETWEEN 1996 AND 2000 AND geo_id IN ({ids})" for q, w, m, b, ids in (("line_single_population", "level", "pop_total", "NULL", f"'{METRO}'"), ("line_multi_income", "level", "income_pc", "NULL", f"'{METRO}', '10001', '10009'"), ("line_indexed_income", "indexed", "income_pc", "1996", f"'{METRO}', '10001', '10009'")))), real="metric_value", ints="period index_base_period")
def line_sample(t):
    return Q.line_sample(gold(t, "cbsa"), mx(t), METRO, ["10001", "10009"], (1996, 2000))


# ---- symbols and scatters -------------------------------------------------

_SYM = lambda q, size, grp, p, src: f"SELECT '{q}' AS question_id, {P3}, {size} AS size_value, {grp} AS color_group, {size} >= quantile_cont({size}, {p}) OVER () AS label_flag FROM {src}"


@query("symbol_q1_cbsa_population_concentration", sql("county", body=_SYM("symbol_population_concentration", "pop_total", "region", 0.98, "gl JOIN cx USING (geo_id) WHERE region <> 'AFRICA'")), real="size_value")
def sym1(t):
    return Q.symbols(gold(t, "county"), cx(t), "symbol_population_concentration", "county", "pop_total", "region", 0.98, F.col("region") != "AFRICA")


@query("symbol_q2_county_permit_majority", sql("county", extra="b AS (SELECT *, sum(permits) OVER (ORDER BY permits DESC, geo_name, geo_id ROWS UNBOUNDED PRECEDING) / sum(permits) OVER () AS cs FROM g WHERE permits > 0 AND year = (SELECT max(year) FROM g WHERE permits IS NOT NULL))", body=f"SELECT 'symbol_permit_majority' AS question_id, {P3}, permits AS size_value, cs AS cumulative_share, CASE WHEN cs <= 0.5 THEN 'Top places to 50% of units' ELSE 'Remaining places' END AS color_group, cs <= 0.5 AS highlight_flag, cs <= 0.25 AS label_flag FROM b"), real="size_value cumulative_share")
def sym2(t):
    return Q.majority(gold(t, "county"))


@query("symbol_q3_largest_zctas", sql("county", extra="w AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS geo_id, sum(q * (l_partkey % 360 - 180)) / sum(q) AS lon, sum(q * (l_partkey % 180 - 90)) / sum(q) AS lat FROM (SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS q FROM lineitem GROUP BY ALL) GROUP BY l_suppkey)", body=f"SELECT 'symbol_largest_zctas' AS question_id, {P3}, pop_total AS size_value, lon, lat, pop_total >= quantile_cont(pop_total, 0.85) OVER () AS label_flag FROM gl JOIN w USING (geo_id)"), real="size_value lon lat")
def sym3(t):
    w = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("weight"))
    pairs = w.select(F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("geo_id"), "weight", (F.col("l_partkey") % 360 - 180).cast("double").alias("lon"), (F.col("l_partkey") % 180 - 90).cast("double").alias("lat"))
    return Q.weighted_points(gold(t, "county"), pairs, "symbol_largest_zctas", "county", "pop_total", 0.85)


@query("symbol_q4_retail_parcel_cluster_proxy", feature_sql("SELECT tract_geoid AS geo_id, pop_total AS size_value, CASE WHEN eligible_v1 = 1 THEN 'Eligible target-zone tract' ELSE 'Context tract' END AS color_group, eligible_v1 = 1 AS highlight_flag, s AS target_zone_score, round(s, 9) >= round(a, 9) AS label_flag FROM z, q WHERE eligible_v1 = 1 OR round(s, 9) >= round(b, 9)",
       f"z AS (SELECT *, 0.3 * coalesce(pop_growth_pctl, 0) + 0.25 * coalesce(density_pctl, 0) + 0.25 * coalesce(price_proxy_pctl, 0) + 0.2 * coalesce(income_pctl, 0) AS s FROM tf WHERE cbsa_code = '{METRO}'), q AS (SELECT quantile_cont(s, 0.92) AS a, quantile_cont(s, 0.75) AS b FROM z)"), real="size_value target_zone_score")
def sym4(t):
    return Q.target_zone_proxy(features(t), METRO, {"pop_growth_pctl": 0.3, "density_pctl": 0.25, "price_proxy_pctl": 0.25, "income_pctl": 0.2})


@query("symbol_q5_county_jobs_concentration", sql("county", body=_SYM("symbol_jobs_concentration", "hu_total", "region", 0.75, f"gl JOIN cx USING (geo_id) WHERE cbsa_code = '{METRO}'")), real="size_value")
def sym5(t):
    return Q.symbols(gold(t, "county"), cx(t), "symbol_jobs_concentration", "county", "hu_total", "region", 0.75, F.col("cbsa_code") == METRO)


@query("scatter_q1_income_growth_vs_rent_burden", sql("county", body=f"SELECT 'scatter_income_growth_vs_rent_burden' AS question_id, {P3}, income_pc_growth_3yr * 100 AS x_value, pct_rent_burden_30plus * 100 AS y_value, region AS \"group\", hu_total AS size_value, geo_id = '000000007' AS label_flag FROM g JOIN cx USING (geo_id) WHERE year = 2001 AND income_pc_growth_3yr IS NOT NULL AND geo_id IN (SELECT geo_id FROM g WHERE year = 1998 AND income_pc_growth_3yr IS NOT NULL)"), real="x_value y_value size_value")
def scat1(t):
    return Q.growth_vs_burden_scatter(gold(t, "county"), cx(t), 1998, 2001, "000000007", level="county")


@query("scatter_q2_home_value_vs_income", sql("tract", body=f"SELECT 'scatter_home_value_vs_income' AS question_id, {P3}, median_hh_income AS x_value, median_home_value AS y_value, region AS \"group\", hu_total AS size_value, cume_dist() OVER (ORDER BY median_home_value / nullif(median_hh_income, 0)) >= 0.95 OR geo_id = '00000000007' AS label_flag FROM g JOIN tx USING (geo_id) WHERE year = 2000"), real="x_value y_value size_value")
def scat2(t):
    return Q.value_vs_income_scatter(gold(t, "tract"), tx(t), 2000, "00000000007", level="tract")


@query("scatter_q3_rent_vs_income_outliers", sql("tract", extra=f"b AS (SELECT g.*, cbsa_name, median_gross_rent * 12 / nullif(median_hh_income, 0) AS r FROM g JOIN tx USING (geo_id) WHERE year = 2000 AND cbsa_code = '{METRO}')", body=f"SELECT 'scatter_rent_vs_income_outliers' AS question_id, {P3}, median_hh_income AS x_value, median_gross_rent AS y_value, cbsa_name AS \"group\", hu_total AS size_value, abs((r - avg(r) OVER ()) / nullif(stddev_samp(r) OVER (), 0)) >= 2 OR geo_id = '00000000007' AS label_flag FROM b"), real="x_value y_value size_value")
def scat3(t):
    return Q.rent_vs_income_scatter(gold(t, "tract"), tx(t), 2000, METRO, "00000000007")


# ---- slopes ---------------------------------------------------------------


def _slope_sql(q, metric, src, a, z, k=None, positive=""):
    lim = f" WHERE r <= {k}" if k else ""
    return f"WITH_PLACEHOLDER e AS (SELECT geo_id, row_number() OVER (ORDER BY round(abs(z - a), 9) DESC, geo_id) AS r FROM (SELECT geo_id, max(CASE WHEN year = {a} THEN {metric} END) AS a, max(CASE WHEN year = {z} THEN {metric} END) AS z FROM {src} GROUP BY geo_id) WHERE a IS NOT NULL AND z IS NOT NULL{positive})", f"SELECT '{q}' AS question_id, {P3}, year AS period, '{metric}' AS metric_id, {metric} AS metric_value, r AS display_rank FROM g JOIN (SELECT * FROM e{lim}) e USING (geo_id) WHERE year IN ({a}, {z}) AND {metric} IS NOT NULL"


def _slope(levels, *args, **kw):
    cte, body = _slope_sql(*args, **kw)
    return sql(*levels, extra=cte.replace("WITH_PLACEHOLDER ", ""), body=body)


@query("slope_county_rent_burden", _slope(["county"], "slope_county_rent_burden", "pct_rent_burden_30plus", f"g JOIN cx USING (geo_id) WHERE cbsa_code = '{METRO}'", 1997, 2001), real="metric_value", ints="period")
def slope1(t):
    df = gold(t, "county").join(cx(t).filter(F.col("cbsa_code") == METRO).select("geo_id"), "geo_id", "left_semi")
    return Q.slope_pairs(df, "slope_county_rent_burden", "pct_rent_burden_30plus", 1997, 2001)


@query("slope_income_change_cbsas", _slope(["cbsa"], "slope_income_change_cbsas", "rpp_real_pc_income", "g", 1996, 2001, k=12, positive=" AND a > 0 AND z > 0"), real="metric_value", ints="period")
def slope2(t):
    return Q.slope_pairs(gold(t, "cbsa"), "slope_income_change_cbsas", "rpp_real_pc_income", 1996, 2001, 12, positive=True)


@query("slope_peer_affordability_shift", sql("cbsa", body=_RK("slope_peer_affordability_shift", "value_to_income", "g WHERE geo_id IN ('10001', '10002', '10003', '10004', '10011') AND year IN (1996, 2001)", "ASC", hl="geo_id = '10003'")), real="metric_value", ints="period")
def slope3(t):
    return Q.peer_ranks(gold(t, "cbsa"), "slope_peer_affordability_shift", _PEERS, METRO, (1996, 2001))


@query("slope_target_vs_region", sql("cbsa", body=f"SELECT geo_id, year AS period, rpp_real_pc_income AS metric_value, true AS highlight_flag, NULL AS benchmark_label FROM g WHERE geo_id = '{METRO}' AND year IN (1996, 2001) UNION ALL SELECT 'region_benchmark', year, avg(rpp_real_pc_income), false, 'Regional benchmark' FROM g JOIN mx USING (geo_id) WHERE region = {_REG} AND year IN (1996, 2001) GROUP BY year"), real="metric_value", ints="period")
def slope4(t):
    return Q.slope_vs_region(gold(t, "cbsa"), mx(t), METRO, 1996, 2001)


@query("slope_zcta_value_to_income_change", _slope(["tract"], "slope_zcta_value_to_income_change", "value_to_income", f"g JOIN tx USING (geo_id) WHERE cbsa_code = '{METRO}'", 1997, 2001, k=18), real="metric_value", ints="period")
def slope5(t):
    df = gold(t, "tract").join(tx(t).filter(F.col("cbsa_code") == METRO).select("geo_id"), "geo_id", "left_semi")
    return Q.slope_pairs(df, "slope_zcta_value_to_income_change", "value_to_income", 1997, 2001, 18)


# ---- waterfalls -----------------------------------------------------------

_SECTORS = {f"gdp_{k}": (f"Sector {k}", "Goods" if k < 4 else "Services", k) for k in range(1, 8)}


def _wf(q, comps, src, a, z, scale):
    return " UNION ALL ".join(f"SELECT '{q}' AS question_id, {P3}, '{c}' AS component_id, '{x[0]}' AS component_label, '{x[1]}' AS component_group, {x[2]} AS sort_order, max(CASE WHEN year = {z} THEN {c} END) / {scale} AS component_value, (max(CASE WHEN year = {z} THEN {c} END) - max(CASE WHEN year = {a} THEN {c} END)) / {scale} AS component_delta FROM {src} GROUP BY {P3} HAVING max(CASE WHEN year = {z} THEN {c} END) - max(CASE WHEN year = {a} THEN {c} END) IS NOT NULL" for c, x in comps.items())


_INC = {"pi_wages_salary": ("Wages and salaries", "Earnings", 1), "pi_nonwage": ("Non-wage income", "Other income", 2)}


@query("waterfall_q1_income_change_drivers", sql("cbsa", extra="n AS (SELECT *, pi_total - pi_wages_salary AS pi_nonwage FROM g)", body=_wf("waterfall_income_change_drivers", _INC, "n", 1996, 2001, "1e6")), real="component_value component_delta", ints="sort_order")
def wf1(t):
    g = gold(t, "cbsa").withColumn("pi_nonwage", F.col("pi_total") - F.col("pi_wages_salary"))
    return Q.change_components(g, "waterfall_income_change_drivers", _INC, 1996, 2001, 1e6)


@query("waterfall_q2_income_mix_compare", sql("cbsa", extra=f"b AS (SELECT 'Target CBSA' AS benchmark_label, sum(pi_total) AS p, sum(pi_wages_salary) AS w, sum(pop_total) AS n FROM gl WHERE geo_id = '{METRO}' UNION ALL SELECT 'Regional benchmark', sum(pi_total), sum(pi_wages_salary), sum(pop_total) FROM gl JOIN mx USING (geo_id) WHERE region = {_REG})", body="SELECT benchmark_label, 'wages_salary' AS component_id, 1 AS sort_order, w / n AS component_value FROM b UNION ALL SELECT benchmark_label, 'nonwage_income', 2, (p - w) / n FROM b"), real="component_value", ints="sort_order")
def wf2(t):
    return Q.income_mix(gold(t, "cbsa"), mx(t), METRO)


@query("waterfall_q3_gdp_sector_change", sql("county", body=_wf("waterfall_gdp_sector_change", _SECTORS, "g", 1996, 2001, "1e6")), real="component_value component_delta", ints="sort_order")
def wf3(t):
    return Q.change_components(gold(t, "county"), "waterfall_gdp_sector_change", _SECTORS, 1996, 2001, 1e6)


_STOCK = {"race_a": ("Detached single-unit", "Single-unit", 1), "race_n": ("2-4 unit buildings", "Multifamily", 2), "other_units": ("Other/attached units", "Other", 3)}


@query("waterfall_q4_housing_stock_components", sql("county", extra="n AS (SELECT *, pop_total - coalesce(race_a, 0) - coalesce(race_n, 0) AS other_units FROM g)", body=_wf("waterfall_housing_stock", _STOCK, "n", 1997, 2001, "1")), real="component_value component_delta", ints="sort_order")
def wf4(t):
    from terrapanel.functions.nulls import sum0
    g = gold(t, "county").withColumn("other_units", F.col("pop_total") - sum0("race_a", "race_n"))
    return Q.change_components(g, "waterfall_housing_stock", _STOCK, 1997, 2001)


@query("waterfall_q5_negative_offsets", sql("county", extra="e AS (SELECT geo_level, geo_id, geo_name, " + ", ".join(f"max(CASE WHEN year = 2000 THEN {s} END) - max(CASE WHEN year = 1996 THEN {s} END) AS {s}" for s in _SECTORS) + f" FROM g JOIN cx USING (geo_id) WHERE cbsa_code = '10010' GROUP BY ALL), s AS (SELECT *, " + " + ".join(f"coalesce({s}, 0)" for s in _SECTORS) + " AS net_delta, " + " + ".join(f"least({s}, 0)" for s in _SECTORS) + " AS neg FROM e), k AS (SELECT * FROM s WHERE net_delta > 0 AND neg < 0 ORDER BY round(abs(neg), 4) DESC, round(net_delta, 4) DESC, geo_id LIMIT 1)",
       body=" UNION ALL ".join(f"SELECT {P3}, net_delta, '{s}' AS component_id, '{a[0]}' AS component_label, {a[2]} AS sort_order, {s} AS component_delta FROM k" for s, a in _SECTORS.items())), real="net_delta component_delta", ints="sort_order", digits=4)
def wf5(t):
    return Q.negative_offsets(gold(t, "county"), cx(t), "10010", _SECTORS, 1996, 2000)
