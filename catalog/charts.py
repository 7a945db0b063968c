"""CH1-CH16: chart-ready datasets."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.registry import query
from terrapanel.plans import charts as C
from terrapanel.session import store

TRACT = lambda body, extra="": S.sql_mart("tract", extra="ty AS (SELECT m.* REPLACE (m.geo_id || '-' || CAST(m.year AS INTEGER) AS geo_id), x.census_region, x.cbsa_code || '-' || CAST(m.year AS INTEGER) AS cbsa_code FROM mart m JOIN tract_cbsa x ON m.geo_id = x.tract_geoid)" + (", " + extra if extra else ""), body=body)
COUNTY = lambda body, extra="": S.sql_mart("county", extra=extra, body=body)


def yearly(df, *cols):
    return df.withColumns({c: F.concat_ws("-", c, F.col("year").cast("int").cast("string")) for c in cols})


def places(t):
    """Every tract in every year, with its metro in that year."""
    return yearly(S.mart(t, "tract").join(S.tract_cbsa(t), F.col("geo_id") == F.col("tract_geoid")).drop("tract_geoid"), "geo_id", "cbsa_code")


def long_metric(t, value="income_pc", level="county"):
    """Contract-shaped rows of one metric over all periods."""
    return S.mart(t, level).select("geo_level", "geo_id", "geo_name", F.col("year").alias("period"), F.lit(value).alias("metric_id"), F.lit(value).alias("metric_label"),
                                   F.col(value).alias("metric_value"), F.lit("mart").alias("source"), F.lit("2024").alias("vintage"))


_GAPS = "g AS (SELECT geo_id, geo_name, year, income_pc FROM mart WHERE hu_total % 4 <> 0), grid AS (SELECT geo_id, geo_name, y AS period FROM (SELECT geo_id, max(geo_name) AS geo_name FROM g GROUP BY geo_id), (SELECT unnest(generate_series((SELECT min(year) FROM g), (SELECT max(year) FROM g))) AS y)), f AS (SELECT grid.*, income_pc AS metric_value FROM grid LEFT JOIN g ON g.geo_id = grid.geo_id AND g.year = grid.period)"


@query("ch01_line_indexed", COUNTY("SELECT geo_id, geo_name, period, metric_value, 100 * metric_value / nullif(max(CASE WHEN period = 1996 THEN metric_value END) OVER (PARTITION BY geo_id), 0) AS plot_value FROM f", _GAPS), real="metric_value plot_value", ints="period")
def ch01(t):
    gaps = S.mart(t, "county").filter("hu_total % 4 <> 0").select("geo_id", "year")
    df = long_metric(t).join(gaps.withColumnRenamed("year", "period"), ["geo_id", "period"], "left_semi")
    return C.line(df, "indexed", base_period=1996).select("geo_id", "geo_name", "period", "metric_value", "plot_value")


@query("ch01_line_rolling", COUNTY("SELECT geo_id, geo_name, period, metric_value, CASE WHEN count(metric_value) OVER w = 3 THEN avg(metric_value) OVER w END AS plot_value FROM f WINDOW w AS (PARTITION BY geo_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", _GAPS), real="metric_value plot_value", ints="period")
def ch01r(t):
    gaps = S.mart(t, "county").filter("hu_total % 4 <> 0").select("geo_id", "year")
    df = long_metric(t).join(gaps.withColumnRenamed("year", "period"), ["geo_id", "period"], "left_semi")
    return C.line(df, "rolling", rolling_k=3).select("geo_id", "geo_name", "period", "metric_value", "plot_value")


@query("ch02_ranked_bar", TRACT("SELECT geo_id, income_pc AS metric_value, overall_rank, row_number() OVER (ORDER BY overall_rank) AS display_order, true AS truncated_flag FROM (SELECT *, row_number() OVER (ORDER BY income_pc DESC, geo_name, geo_id) AS overall_rank FROM ty) WHERE overall_rank <= 12 OR geo_id IN ('00000000010-1999', '00000000020-1999')"), real="metric_value")
def ch02(t):
    df = places(t).select("geo_id", "geo_name", F.col("income_pc").alias("metric_value"))
    return C.bar(df, top_n=12, include=["00000000010-1999", "00000000020-1999"]).select("geo_id", "metric_value", "overall_rank", "display_order", "truncated_flag")


@query("ch02_bottom_bar", TRACT("SELECT geo_id, overall_rank, row_number() OVER (ORDER BY overall_rank) AS display_order FROM (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY income_pc, geo_name, geo_id) + 1 AS overall_rank, row_number() OVER (ORDER BY income_pc, geo_name, geo_id) AS b FROM ty) WHERE b <= 9"))
def ch02b(t):
    return C.bar(places(t).select("geo_id", "geo_name", F.col("income_pc").alias("metric_value")), bottom_n=9).select("geo_id", "overall_rank", "display_order")


@query("ch03_scatter", TRACT("SELECT geo_id, income_pc AS x_value, vacancy_rate AS y_value FROM ty WHERE hu_total % 6 <> 0"), real="x_value y_value")
def ch03(t):
    df = places(t).select("geo_id", F.col("income_pc").alias("x_value"), F.when(F.col("hu_total") % 6 != 0, F.col("vacancy_rate")).alias("y_value"))
    return C.scatter(df)


_SLOPE = "s AS (SELECT geo_id, max(geo_name) AS nm, max(CASE WHEN year = 1996 THEN income_pc END) AS start_value, max(CASE WHEN year = 2000 THEN income_pc END) AS end_value FROM mart WHERE year IN (1996, 2000) GROUP BY geo_id), o AS (SELECT *, end_value - start_value AS delta_value, row_number() OVER (ORDER BY abs(end_value - start_value) DESC, nm, geo_id) AS ord FROM s WHERE start_value IS NOT NULL AND end_value IS NOT NULL)"


@query("ch04_slopegraph", COUNTY("SELECT m.geo_id, m.year AS period, CASE WHEN m.year = 1996 THEN 'start' ELSE 'end' END AS period_role, start_value, end_value, delta_value, delta_value / nullif(start_value, 0) AS pct_change, ord AS display_order, 100 * income_pc / nullif(start_value, 0) AS plot_value FROM mart m JOIN o USING (geo_id) WHERE m.year IN (1996, 2000) AND ord <= 20", _SLOPE), real="start_value end_value delta_value pct_change plot_value", ints="period")
def ch04(t):
    out = C.slopegraph(long_metric(t), 1996, 2000, "indexed", "abs_delta", top_n=20)
    return out.select("geo_id", "period", "period_role", "start_value", "end_value", "delta_value", "pct_change", "display_order", "plot_value")


_BUMP = "r AS (SELECT geo_id, year AS period, income_pc AS metric_value, row_number() OVER (PARTITION BY year ORDER BY income_pc DESC, geo_name, geo_id) AS rank FROM mart), k AS (SELECT * FROM r WHERE geo_id IN (SELECT geo_id FROM r WHERE period = (SELECT max(period) FROM r) AND rank <= 10)), e AS (SELECT geo_id, max(CASE WHEN period = (SELECT min(period) FROM k) THEN rank END) AS start_rank, max(CASE WHEN period = (SELECT max(period) FROM k) THEN rank END) AS end_rank FROM k GROUP BY geo_id)"


@query("ch05_bump", COUNTY("SELECT k.*, start_rank, end_rank, start_rank - end_rank AS rank_change FROM k JOIN e USING (geo_id)", _BUMP), real="metric_value", ints="period")
def ch05(t):
    return C.bump(long_metric(t)).select("geo_id", "period", "metric_value", "rank", "start_rank", "end_rank", "rank_change")


_P = lambda v: f"(rank() OVER (PARTITION BY metric_id ORDER BY metric_value) + (count(*) OVER (PARTITION BY metric_id, metric_value) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY metric_id) - 1) * 100"
_HEAT = f"l AS (SELECT geo_id, 'hu_total' AS metric_id, hu_total AS metric_value FROM ty UNION ALL SELECT geo_id, 'pop_total', pop_total FROM ty WHERE hu_total % 5 <> 0), n AS (SELECT *, CASE WHEN metric_id = 'pop_total' THEN 100 - ({_P('')}) ELSE {_P('')} END AS normalized_value FROM l), g AS (SELECT geo_id, metric_id FROM (SELECT DISTINCT geo_id FROM l), (VALUES ('hu_total'), ('pop_total')) v(metric_id)), f AS (SELECT g.geo_id, g.metric_id, metric_value, normalized_value FROM g LEFT JOIN n USING (geo_id, metric_id))"


def _metrics_long(t):
    ty = store(places(t).select("geo_level", "geo_id", "geo_name", "hu_total", "pop_total"))
    one = lambda m, d, df: df.select("geo_level", "geo_id", "geo_name", F.lit(m).alias("metric_id"), F.lit(m).alias("metric_label"), F.col(m).alias("metric_value"), F.lit(d).alias("direction"))
    return one("hu_total", "higher_is_better", ty).unionByName(one("pop_total", "lower_is_better", ty.filter("hu_total % 5 <> 0")))


@query("ch06_heatmap_table", TRACT("SELECT geo_id AS row_id, metric_id AS column_id, metric_value, normalized_value, avg(normalized_value) OVER (PARTITION BY geo_id) AS row_score, metric_value IS NULL AS missing_flag FROM f", _HEAT), real="metric_value normalized_value row_score")
def ch06(t):
    out = C.heatmap_table(_metrics_long(t), "geo_metric", {"hu_total": "Units", "pop_total": "People"})
    return out.select("row_id", "column_id", "metric_value", "normalized_value", "row_score", "missing_flag")


@query("ch07_strength_strip", TRACT("""SELECT geo_id, metric_id, metric_value, normalized_value, benchmark_value, CASE WHEN metric_id = 'pop_total' THEN 100 - p ELSE p END AS benchmark_normalized_value FROM n JOIN b USING (metric_id)""", _HEAT + ", b AS (SELECT metric_id, m AS benchmark_value, (count(*) FILTER (metric_value < m) + count(*) FILTER (metric_value = m) / 2.0) / count(*) * 100 AS p FROM l JOIN (SELECT metric_id, round(avg(metric_value), 0) AS m FROM l GROUP BY metric_id) USING (metric_id) GROUP BY ALL)"),
       real="metric_value normalized_value benchmark_value benchmark_normalized_value")
def ch07(t):
    df = _metrics_long(t).withColumn("time_window", F.lit("1999"))
    bench = df.groupBy("metric_id").agg(F.round(F.avg("metric_value"), 0).alias("benchmark_value"))
    return C.strength_strip(df.join(bench, "metric_id")).select("geo_id", "metric_id", "metric_value", "normalized_value", "benchmark_value", "benchmark_normalized_value")


@query("ch08_boxplot", TRACT("""SELECT geo_id, census_region AS box_group, plot_value, group_median, group_n, group_order FROM w JOIN (SELECT census_region, median(plot_value) AS group_median, count(*) AS group_n, row_number() OVER (ORDER BY median(plot_value) DESC, census_region) AS group_order FROM w GROUP BY census_region) USING (census_region)""",
       "w AS (SELECT geo_id, census_region, vacancy_rate AS plot_value FROM ty, (SELECT quantile_cont(vacancy_rate, 0.05) AS a, quantile_cont(vacancy_rate, 0.95) AS b FROM ty) WHERE vacancy_rate BETWEEN a AND b)"), real="plot_value group_median")
def ch08(t):
    df = places(t).withColumns({"metric_value": F.col("vacancy_rate"), "group": F.col("census_region")})
    return C.boxplot(df, trim=(0.05, 0.95)).select("geo_id", "box_group", "plot_value", "group_median", "group_n", "group_order")


_HX = """h AS (SELECT w, CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END AS q, CASE WHEN dq > dr AND dq > ds THEN r0 WHEN dr > ds THEN -q0 - s0 ELSE r0 END AS r FROM (SELECT *, abs(q0 - qf) AS dq, abs(r0 - rf) AS dr, abs(s0 + qf + rf) AS ds FROM (SELECT *, round_even(qf, 0) AS q0, round_even(rf, 0) AS r0, round_even(-qf - rf, 0) AS s0 FROM (
SELECT pop_total AS w, (income_pc / 100e0) * (sqrt(3) / 3) - (least(greatest(vacancy_rate, a), b) / 0.05e0) / 3 AS qf, (least(greatest(vacancy_rate, a), b) / 0.05e0) * (2e0 / 3) AS rf FROM ty, (SELECT quantile_cont(vacancy_rate, 0.02) AS a, quantile_cont(vacancy_rate, 0.98) AS b FROM ty)))))"""


@query("ch09_hexbin", TRACT("SELECT q, r, count(*) AS n, sum(w) AS weight FROM h GROUP BY q, r", _HX), real="weight", ints="q r")
def ch09(t):
    df = places(t).select("geo_id", F.col("income_pc").alias("x_value"), F.col("vacancy_rate").alias("y_value"), "pop_total")
    return C.hexbin(df, (100.0, 0.05), y_limits=(0.02, 0.98), clamp=True, weight="pop_total")


@query("ch10_correlation_heatmap", TRACT("""SELECT metric_x, metric_y, correlation, n, CASE WHEN metric_x = metric_y OR abs(correlation) >= 0.1 THEN correlation END AS correlation_display, abs(correlation) AS abs_correlation, 'pearson' AS method FROM (
SELECT 'hu_total' AS metric_x, 'pop_total' AS metric_y, c AS correlation, n FROM x UNION ALL SELECT 'pop_total', 'hu_total', c, n FROM x UNION ALL SELECT 'hu_total', 'hu_total', 1, count(*) FROM ty UNION ALL SELECT 'pop_total', 'pop_total', 1, count(*) FROM ty WHERE hu_total % 5 <> 0)""",
       "x AS (SELECT corr(hu_total, pop_total) AS c, count(*) AS n FROM ty WHERE hu_total % 5 <> 0)"), real="correlation correlation_display abs_correlation")
def ch10(t):
    return C.correlation_heatmap(_metrics_long(t), ["hu_total", "pop_total"], "pearson", weak=0.1)


@query("ch11_age_pyramid", COUNTY("""SELECT geo_id, period, age_bin, sex, pop_value, pop_total, pop_share, CASE WHEN sex = 'Male' THEN -pop_share ELSE pop_share END AS plot_value, missing_bin_flag FROM (SELECT *, sum(pop_value) OVER (PARTITION BY geo_id, period) AS pop_total, pop_value / sum(pop_value) OVER (PARTITION BY geo_id, period) AS pop_share FROM f)""",
       "l AS (SELECT geo_id, year AS period, '0-14' AS age_bin, 'Male' AS sex, age_1 AS pop_value FROM mart UNION ALL SELECT geo_id, year, '0-14', 'Female', age_2 FROM mart UNION ALL SELECT geo_id, year, '15-64', 'Male', age_3 FROM mart UNION ALL SELECT geo_id, year, '65+', 'Female', age_4 FROM mart), f AS (SELECT g.geo_id, g.period, b.age_bin, s.sex, coalesce(pop_value, 0) AS pop_value, pop_value IS NULL AS missing_bin_flag FROM (SELECT DISTINCT geo_id, period FROM l) g, (VALUES ('0-14'), ('15-64'), ('65+')) b(age_bin), (VALUES ('Male'), ('Female')) s(sex) LEFT JOIN l ON l.geo_id = g.geo_id AND l.period = g.period AND l.age_bin = b.age_bin AND l.sex = s.sex)"),
       real="pop_value pop_total pop_share plot_value", ints="period")
def ch11(t):
    m = S.mart(t, "county")
    one = lambda b, s, c: m.select("geo_id", "geo_name", F.col("year").alias("period"), F.lit(b).alias("age_bin"), F.lit(s).alias("sex"), F.col(c).alias("pop_value"))
    df = one("0-14", "male", "age_1").unionByName(one("0-14", "F", "age_2")).unionByName(one("15-64", "M", "age_3")).unionByName(one("65+", "women", "age_4"))
    return C.age_pyramid(df, ["0-14", "15-64", "65+"]).select("geo_id", "period", "age_bin", "sex", "pop_value", "pop_total", "pop_share", "plot_value", "missing_bin_flag")


@query("ch12_waterfall", COUNTY("""SELECT geo_id, sort_order, component_label, v AS component_value, c - v AS start_value, c AS end_value, v / nullif(t, 0) AS share_of_total, false AS is_total FROM (SELECT *, sum(v) OVER (PARTITION BY geo_id ORDER BY sort_order ROWS UNBOUNDED PRECEDING) AS c, sum(v) OVER (PARTITION BY geo_id) AS t FROM l)
UNION ALL SELECT geo_id, 4, 'Population', sum(v), 0, sum(v), 1, true FROM l GROUP BY geo_id""", "my AS (SELECT * REPLACE (geo_id || '-' || CAST(year AS INTEGER) AS geo_id) FROM mart), l AS (SELECT geo_id, 1 AS sort_order, 'A' AS component_label, race_a AS v FROM my UNION ALL SELECT geo_id, 2, 'N', race_n FROM my UNION ALL SELECT geo_id, 3, 'R', -race_r FROM my)"),
       real="component_value start_value end_value share_of_total", ints="sort_order")
def ch12(t):
    m = yearly(S.mart(t, "county"), "geo_id")
    one = lambda k, lb, e: m.select("geo_level", "geo_id", "geo_name", F.lit("1999").alias("time_window"), F.lit(k).alias("sort_order"), F.lit(lb).alias("component_label"), e.alias("component_value"))
    df = one(1, "A", F.col("race_a")).unionByName(one(2, "N", F.col("race_n"))).unionByName(one(3, "R", -F.col("race_r")))
    return C.waterfall(df, total_label="Population").select("geo_id", "sort_order", "component_label", "component_value", "start_value", "end_value", "share_of_total", "is_total")


@query("ch13_choropleth_diverging", TRACT("SELECT geo_id, f AS fill_value, CASE WHEN f <= a THEN 'low' WHEN f <= b THEN 'mid' ELSE 'high' END AS bin FROM d, (SELECT quantile_cont(f, 0.25) AS a, quantile_cont(f, 0.75) AS b FROM d)", "d AS (SELECT geo_id, hu_total - (SELECT round(avg(hu_total), 2) FROM ty) AS f FROM ty)"), real="fill_value")
def ch13(t):
    df = store(places(t).select("geo_id", "hu_total"))
    df = df.withColumns({"metric_value": F.col("hu_total"), "benchmark_value": df.select(F.round(F.avg("hu_total"), 2)).scalar()})
    return C.choropleth(df, "diverging", probs=(0.25, 0.75), labels=("low", "mid", "high")).select("geo_id", "fill_value", "bin")


@query("ch14_bivariate_choropleth", TRACT("""SELECT geo_id, xb AS x_bin, yb AS y_bin, xb || '-' || yb AS bivar_class FROM (SELECT geo_id, CAST(least(floor((rx + (kx - 1) / 2.0 - 0.5) / n * 3) + 1, 3) AS BIGINT) AS xb, CAST(least(floor((ry + (ky - 1) / 2.0 - 0.5) / n * 3) + 1, 3) AS BIGINT) AS yb
FROM (SELECT geo_id, count(*) OVER (PARTITION BY census_region) AS n, rank() OVER (PARTITION BY census_region ORDER BY hu_total) AS rx, count(*) OVER (PARTITION BY census_region, hu_total) AS kx, rank() OVER (PARTITION BY census_region ORDER BY income_pc) AS ry, count(*) OVER (PARTITION BY census_region, income_pc) AS ky FROM ty))"""))
def ch14(t):
    df = places(t).withColumns({"x_value": F.col("hu_total"), "y_value": F.col("income_pc")})
    return C.bivariate_choropleth(df, 3, ["census_region"]).select("geo_id", "x_bin", "y_bin", "bivar_class")


@query("ch15_highlight_context", TRACT("SELECT geo_id, CASE WHEN cbsa_code = '10003-1999' THEN 'Highlighted geography' WHEN census_region = 'ASIA' THEN 'Neighbor context' ELSE 'Background context' END AS focus_role FROM ty"))
def ch15(t):
    df = places(t).withColumns({"highlight_flag": F.when(F.col("cbsa_code") == "10003-1999", "yes"), "neighbor_flag": (F.col("census_region") == "ASIA").cast("int")})
    return C.highlight_context(df).select("geo_id", "focus_role")


@query("ch16_proportional_symbol", TRACT("""SELECT geo_id, size_rank, pop_total / t AS size_share, c / t AS cumulative_size_share, size_rank <= 8 AS label_flag FROM (SELECT geo_id, pop_total, row_number() OVER (ORDER BY pop_total DESC, geo_name, geo_id) AS size_rank, sum(pop_total) OVER (ORDER BY pop_total DESC, geo_name, geo_id ROWS UNBOUNDED PRECEDING) AS c, sum(pop_total) OVER () AS t FROM ty) WHERE size_rank <= 60"""), real="size_share cumulative_size_share")
def ch16(t):
    return C.proportional_symbol(places(t).withColumn("size_value", F.col("pop_total")), top_n=60).select("geo_id", "size_rank", "size_share", "cumulative_size_share", "label_flag")


@query("ch_contract_validation", COUNTY("""SELECT 'required_columns' AS check_name, 0.0 AS metric_value, true AS pass, '' AS details UNION ALL SELECT 'optional_columns_present', 0, true, '' UNION ALL SELECT 'non_empty', count(*), true, '' FROM mart UNION ALL SELECT 'single_geo_level', 0, true, '' UNION ALL SELECT 'finite_metric_value', 0, true, ''"""), real="metric_value")
def ch_contract(t):
    return C.validate_contract(long_metric(t), "line", ["geo_level"])


@query("ch06_heatmap_metric_period", COUNTY("""SELECT metric_id AS row_id, year AS column_id, metric_value, (rank() OVER (PARTITION BY metric_id ORDER BY metric_value) + (count(*) OVER (PARTITION BY metric_id, metric_value) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY metric_id) - 1) * 100 AS normalized_value FROM l""",
       "l AS (SELECT 'income_pc' AS metric_id, year, income_pc AS metric_value FROM mart WHERE geo_id = '000000007' UNION ALL SELECT 'vacancy_rate', year, vacancy_rate FROM mart WHERE geo_id = '000000007')"), real="metric_value normalized_value", ints="column_id")
def ch06p(t):
    df = long_metric(t, "income_pc").unionByName(long_metric(t, "vacancy_rate")).filter("geo_id = '000000007'")
    return C.heatmap_table(df, "metric_period", periods=range(1995, 2002)).select("row_id", "column_id", "metric_value", "normalized_value")
