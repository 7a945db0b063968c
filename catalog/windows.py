"""WN: growth, ranks, percentiles, bins, shares, index series."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.registry import query
from terrapanel.operators import ranking as K
from terrapanel.operators import select as L
from terrapanel.operators import series as T
from terrapanel.operators import stats
from terrapanel.session import store

MART = lambda body, *lv, extra="": S.sql_mart(*(lv or ("county",)), body=body, extra=extra)
KEYS = ["geo_level", "geo_id"]


def tract_year(t):
    """Every tract in every year, with its metro in that year and its region, written once."""
    df = S.mart(t, "tract").join(S.tract_cbsa(t), F.col("geo_id") == F.col("tract_geoid")).drop("tract_geoid")
    yearly = lambda c: F.concat_ws("-", c, F.col("year").cast("int").cast("string"))
    return store(df.select(yearly("geo_id").alias("geo_id"), "geo_name", yearly("cbsa_code").alias("cbsa_code"), "census_region", "pop_total", "hu_total", "income_pc", "vacancy_rate"))


TRACT = lambda body: MART(body, "tract", extra="ty AS (SELECT * REPLACE (geo_id || '-' || CAST(year AS INTEGER) AS geo_id, cbsa_code || '-' || CAST(year AS INTEGER) AS cbsa_code) FROM mart JOIN tract_cbsa ON geo_id = tract_geoid)")


@query("wn01_multi_horizon_growth", MART("""
SELECT geo_id, year, """ + ", ".join(
    f"CASE WHEN l{h} > 0 THEN (pop_total - l{h}) / l{h} END AS pop_growth_{h}yr, CASE WHEN l{h} > 0 THEN pow(pop_total / l{h}, 1.0 / {h}) - 1 END AS pop_cagr_{h}yr" for h in (1, 3, 5)) + """
FROM (SELECT *, lag(pop_total, 1) OVER w AS l1, lag(pop_total, 3) OVER w AS l3, lag(pop_total, 5) OVER w AS l5 FROM mart WINDOW w AS (PARTITION BY geo_id ORDER BY year))""", "tract"),
       real=" ".join(f"pop_growth_{h}yr pop_cagr_{h}yr" for h in (1, 3, 5)), ints="year")
def wn01(t):
    out = T.growth(S.mart(t, "tract"), KEYS, "year", "pop_total", (1, 3, 5), prefix="pop")
    return out.select("geo_id", "year", *[f"pop_{k}_{h}yr" for h in (1, 3, 5) for k in ("growth", "cagr")])


@query("wn01_calendar_growth", MART("""
SELECT a.geo_id, a.year, CASE WHEN b.pop_total > 0 THEN (a.pop_total - b.pop_total) / b.pop_total END AS pop_growth_3yr
FROM (SELECT * FROM mart WHERE hu_total % 4 <> 0) a LEFT JOIN (SELECT * FROM mart WHERE hu_total % 4 <> 0) b ON a.geo_id = b.geo_id AND b.year = a.year - 3""", "tract"), real="pop_growth_3yr", ints="year")
def wn01c(t):
    gaps = S.mart(t, "tract").filter("hu_total % 4 <> 0")
    return T.growth(gaps, KEYS, "year", "pop_total", (3,), prefix="pop", mode="calendar", cagr=()).select("geo_id", "year", "pop_growth_3yr")


@query("wn02_level_change", MART("""
SELECT geo_id, year, vacancy_rate - lag(vacancy_rate) OVER (PARTITION BY geo_id ORDER BY year) AS vacancy_rate_change_1yr FROM mart"""), real="vacancy_rate_change_1yr", ints="year")
def wn02(t):
    return T.level_change(S.mart(t, "county"), KEYS, "year", "vacancy_rate").select("geo_id", "year", "vacancy_rate_change_1yr")


@query("wn03_rolling_mean", MART("""
SELECT geo_id, year, avg(permits) OVER w AS loose, CASE WHEN count(permits) OVER w = 3 THEN avg(permits) OVER w END AS strict FROM mart
WINDOW w AS (PARTITION BY geo_id ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""), real="loose strict", ints="year")
def wn03(t):
    out = T.rolling_mean(S.mart(t, "county"), KEYS, "year", "permits", 3, "loose")
    return T.rolling_mean(out, KEYS, "year", "permits", 3, "strict", strict=True).select("geo_id", "year", "loose", "strict")


@query("wn04_row_number_national", TRACT("""
SELECT geo_id, row_number() OVER (ORDER BY income_pc DESC NULLS LAST, geo_id) AS national_rank, row_number() OVER (PARTITION BY cbsa_code ORDER BY income_pc DESC NULLS LAST, geo_id) AS cbsa_rank FROM ty"""))
def wn04(t):
    df = K.rank_by(tract_year(t), [], "income_pc", ["geo_id"], "national_rank")
    return K.rank_by(df, ["cbsa_code"], "income_pc", ["geo_id"], "cbsa_rank").select("geo_id", "national_rank", "cbsa_rank")


@query("wn05_rank_gap", TRACT("""
SELECT *, hu_total_rank - pop_total_rank AS rank_gap FROM (SELECT geo_id, rank() OVER (PARTITION BY census_region ORDER BY hu_total DESC) AS hu_total_rank, rank() OVER (PARTITION BY census_region ORDER BY pop_total DESC) AS pop_total_rank FROM ty)"""))
def wn05(t):
    return K.rank_gap(tract_year(t), ["census_region"], "hu_total", "pop_total", ["geo_id"]).select("geo_id", "hu_total_rank", "pop_total_rank", "rank_gap")


@query("wn06_deterministic_ranks", TRACT("""
SELECT geo_id, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY census_region, v IS NULL ORDER BY v, geo_name, geo_id) END AS rn,
  CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY census_region, v IS NULL ORDER BY v) END AS min_rank, CASE WHEN v IS NOT NULL THEN dense_rank() OVER (PARTITION BY census_region, v IS NULL ORDER BY v) END AS dense
FROM (SELECT *, CASE WHEN hu_total % 7 <> 0 THEN hu_total END AS v FROM ty)"""))
def wn06(t):
    df, ids = tract_year(t).withColumn("v", F.when(F.col("hu_total") % 7 != 0, F.col("hu_total"))), ["geo_name", "geo_id"]
    for out, method in (("rn", "row_number"), ("min_rank", "min"), ("dense", "dense")):
        df = K.rank_by(df, ["census_region"], "v", ids, out, method=method, descending=False, keep_nulls=False)
    return df.select("geo_id", "rn", "min_rank", "dense")


@query("wn07_percent_rank", TRACT("""
SELECT geo_id, percent_rank() OVER (PARTITION BY cbsa_code ORDER BY v NULLS LAST) AS up, percent_rank() OVER (PARTITION BY cbsa_code ORDER BY v DESC NULLS LAST) AS down
FROM (SELECT *, CASE WHEN hu_total % 7 <> 0 THEN hu_total END AS v FROM ty)"""), real="up down")
def wn07(t):
    df = tract_year(t).withColumn("v", F.when(F.col("hu_total") % 7 != 0, F.col("hu_total")))
    both = {"up": K.pct_rank("v", ["cbsa_code"]), "down": K.pct_rank("v", ["cbsa_code"], descending=True)}
    return K.ranked_columns(df, ["geo_id"], both).select("geo_id", "up", "down")


@query("wn08_percentile_known_rows", TRACT("""
SELECT a.geo_id, p.pr AS v_pctl, q.pr AS income_pctl FROM ty a
LEFT JOIN (SELECT geo_id, percent_rank() OVER (PARTITION BY cbsa_code ORDER BY hu_total) AS pr FROM ty WHERE hu_total % 7 <> 0) p USING (geo_id)
LEFT JOIN (SELECT geo_id, percent_rank() OVER (PARTITION BY cbsa_code ORDER BY income_pc) AS pr FROM ty) q USING (geo_id)"""), real="v_pctl income_pctl")
def wn08(t):
    df = tract_year(t).select("geo_id", "cbsa_code", F.when(F.col("hu_total") % 7 != 0, F.col("hu_total")).alias("v"), "income_pc")
    return K.percentiles_of(df, ["geo_id"], ["cbsa_code"], {"v": "v_pctl", "income_pc": "income_pctl"}).select("geo_id", "v_pctl", "income_pctl")


@query("wn09_percent_rank_filled", TRACT("""
SELECT geo_id, coalesce(CASE WHEN v IS NOT NULL THEN percent_rank() OVER (PARTITION BY v IS NULL ORDER BY v) END, 0.5) AS pctl FROM (SELECT *, CASE WHEN hu_total % 7 <> 0 THEN hu_total END AS v FROM ty)"""), real="pctl")
def wn09(t):
    df = tract_year(t).select("geo_id", F.when(F.col("hu_total") % 7 != 0, F.col("hu_total")).alias("v"))
    return K.percent_rank(df, [], "v", ["geo_id"], "pctl", keep_nulls=False, fill=0.5).select("geo_id", "pctl")


_P100 = "CASE WHEN n > 1 THEN (r + (k - 1) / 2.0 - 1) / (n - 1) * 100 ELSE 50 END"


@query("wn10_percentile_0_100", TRACT(f"""
SELECT geo_id, {_P100} AS high_good, 100 - {_P100} AS low_good FROM (SELECT geo_id, rank() OVER (PARTITION BY census_region ORDER BY hu_total) AS r, count(*) OVER (PARTITION BY census_region, hu_total) AS k, count(*) OVER (PARTITION BY census_region) AS n FROM ty)"""), real="high_good low_good")
def wn10(t):
    df = K.percentile_0_100(tract_year(t), ["census_region"], "hu_total", ["geo_id"], "high_good")
    return df.select("geo_id", "high_good", (100 - F.col("high_good")).alias("low_good"))


@query("wn11_benchmark_percentile", TRACT("""
SELECT census_region, b AS benchmark, (count(*) FILTER (hu_total < b) + count(*) FILTER (hu_total = b) / 2.0) / count(*) * 100 AS benchmark_pctl
FROM (SELECT *, (SELECT median(hu_total) FROM ty) AS b FROM ty) GROUP BY census_region, b"""), real="benchmark benchmark_pctl")
def wn11(t):
    from terrapanel.operators.ordered import column_quantiles
    df = tract_year(t).select("geo_id", "census_region", "hu_total")
    med = column_quantiles(df, [], {"m": ("hu_total", 0.5)}).scalar()
    return K.value_within(df.withColumn("benchmark", med), ["census_region"], "hu_total", "benchmark", "benchmark_pctl")


@query("wn12_ntile", TRACT("""
SELECT geo_id, ntile(4) OVER (PARTITION BY census_region ORDER BY income_pc, geo_id) AS quartile, ntile(10) OVER (ORDER BY income_pc DESC, geo_id) AS decile FROM ty"""))
def wn12(t):
    df = K.ntile(tract_year(t), ["census_region"], "income_pc", ["geo_id"], 4, "quartile")
    return K.ntile(df, [], "income_pc", ["geo_id"], 10, "decile", descending=True).select("geo_id", "quartile", "decile")


@query("wn13_bivariate_class", TRACT("""
SELECT geo_id, xb AS x_bin, yb AS y_bin, xb || '-' || yb AS bi_class FROM (SELECT geo_id, CAST(least(floor((rx + (kx - 1) / 2.0 - 0.5) / n * 3) + 1, 3) AS BIGINT) AS xb, CAST(least(floor((ry + (ky - 1) / 2.0 - 0.5) / n * 3) + 1, 3) AS BIGINT) AS yb
FROM (SELECT geo_id, count(*) OVER () AS n, rank() OVER (ORDER BY hu_total) AS rx, count(*) OVER (PARTITION BY hu_total) AS kx, rank() OVER (ORDER BY pop_total) AS ry, count(*) OVER (PARTITION BY pop_total) AS ky FROM ty))"""))
def wn13(t):
    return K.bivariate_class(tract_year(t), "hu_total", "pop_total", ["geo_id"], 3).select("geo_id", "x_bin", "y_bin", "bi_class")


@query("wn14_quantile_breaks", TRACT("""
SELECT geo_id, CASE WHEN income_pc <= a THEN 'low' WHEN income_pc <= b THEN 'mid' ELSE 'high' END AS bin FROM ty, (SELECT quantile_cont(income_pc, 0.33) AS a, quantile_cont(income_pc, 0.66) AS b FROM ty)"""))
def wn14(t):
    return K.quantile_bins(tract_year(t), "income_pc", [0.33, 0.66], "bin", ["low", "mid", "high"]).select("geo_id", "bin")


@query("wn15_cume_dist", TRACT("SELECT geo_id, cume_dist() OVER (PARTITION BY census_region ORDER BY hu_total) AS cume_dist FROM ty"), real="cume_dist")
def wn15(t):
    return K.cume_dist(tract_year(t), ["census_region"], "hu_total", ["geo_id"]).select("geo_id", "cume_dist")


@query("wn16_quantile_threshold_flag", TRACT("SELECT geo_id, income_pc >= quantile_cont(income_pc, 0.95) OVER () AS is_high, income_pc >= quantile_cont(income_pc, 0.8) OVER (PARTITION BY cbsa_code) AS is_high_local FROM ty"))
def wn16(t):
    df = K.quantile_flag(tract_year(t), [], "income_pc", 0.95)
    return K.quantile_flag(df, ["cbsa_code"], "income_pc", 0.8, "is_high_local").select("geo_id", "is_high", "is_high_local")


@query("wn17_impute_and_zscore", TRACT("""
SELECT geo_id, v_scoring, CASE WHEN coalesce(stddev_samp(v_scoring) OVER (PARTITION BY cbsa_code), 0) = 0 THEN 0 ELSE (v_scoring - avg(v_scoring) OVER (PARTITION BY cbsa_code)) / nullif(stddev_samp(v_scoring) OVER (PARTITION BY cbsa_code), 0) END AS z_v
FROM (SELECT *, coalesce(v, median(v) OVER (PARTITION BY cbsa_code)) AS v_scoring FROM (SELECT *, CASE WHEN hu_total % 5 <> 0 THEN income_pc END AS v FROM ty))"""), real="v_scoring z_v")
def wn17(t):
    df = tract_year(t).withColumn("v", F.when(F.col("hu_total") % 5 != 0, F.col("income_pc")))
    df = stats.impute_median(df, ["cbsa_code"], {"v": "v_scoring"})
    return stats.zscore(df, ["cbsa_code"], {"v_scoring": "z_v"}).select("geo_id", "v_scoring", "z_v")


@query("wn18_zscore_outliers", TRACT("""
SELECT *, greatest(abs(z_income_pc), abs(z_vacancy_rate)) AS extremity, coalesce(greatest(abs(z_income_pc), abs(z_vacancy_rate)) >= 2, false) AS outlier_flag FROM (SELECT geo_id,
  (income_pc - avg(income_pc) OVER w) / nullif(stddev_samp(income_pc) OVER w, 0) AS z_income_pc, (vacancy_rate - avg(vacancy_rate) OVER w) / nullif(stddev_samp(vacancy_rate) OVER w, 0) AS z_vacancy_rate FROM ty WINDOW w AS (PARTITION BY census_region))"""),
       real="z_income_pc z_vacancy_rate extremity")
def wn18(t):
    out = stats.z_outliers(tract_year(t), ["census_region"], ["income_pc", "vacancy_rate"])
    return out.select("geo_id", "z_income_pc", "z_vacancy_rate", "extremity", "outlier_flag")


@query("wn19_reference_index", TRACT("""
SELECT geo_id, least(100, greatest(0, 50 + 10 * (income_pc - m) / s)) AS income_index FROM ty, (SELECT avg(income_pc) AS m, stddev_samp(income_pc) AS s FROM mart WHERE year = 1997)"""), real="income_index")
def wn19(t):
    reference = S.mart(t, "tract").filter("year = 1997")
    return stats.z_index(tract_year(t), reference, {"income_pc": "income_index"}).select("geo_id", "income_index")


@query("wn20_winsorize", TRACT("""
SELECT geo_id, least(greatest(income_pc, a), b) AS income_pc_w, CASE WHEN income_pc < a THEN 'low' WHEN income_pc > b THEN 'high' ELSE 'kept' END AS bound_flag, income_pc BETWEEN a AND b AS in_trim
FROM ty, (SELECT quantile_cont(income_pc, 0.05) AS a, quantile_cont(income_pc, 0.95) AS b FROM ty)"""), real="income_pc_w")
def wn20(t):
    df = tract_year(t)
    kept = stats.winsorize(df, "income_pc", 0.05, 0.95, "trim").select("geo_id", F.lit(True).alias("in_trim"))
    out = stats.winsorize(df, "income_pc", 0.05, 0.95).join(kept, "geo_id", "left").withColumn("in_trim", F.coalesce("in_trim", F.lit(False)))
    return out.select("geo_id", "income_pc_w", "bound_flag", "in_trim")


@query("wn21_cumulative_share", TRACT("""
SELECT geo_id, value_rank, pop_total / t AS share, c / t AS cumulative_share, (c - pop_total) / t < 0.5 AS in_half FROM (SELECT geo_id, pop_total, row_number() OVER w AS value_rank, sum(pop_total) OVER (ORDER BY pop_total DESC, geo_id ROWS UNBOUNDED PRECEDING) AS c, sum(pop_total) OVER () AS t FROM ty WINDOW w AS (ORDER BY pop_total DESC, geo_id))"""),
       real="share cumulative_share")
def wn21(t):
    return K.cumulative_share(tract_year(t), [], "pop_total", ["geo_id"], {"in_half": 0.5}).select("geo_id", "value_rank", "share", "cumulative_share", "in_half")


@query("wn22_waterfall_positions", MART("""
, p AS (SELECT geo_id, i AS sort_order, 'gdp_' || i AS component, v FROM (SELECT geo_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS i, unnest([gdp_1, gdp_2, gdp_3, gdp_4, gdp_5, gdp_6, gdp_7]) AS v FROM (SELECT * REPLACE (geo_id || '-' || CAST(year AS INTEGER) AS geo_id) FROM mart)))
SELECT geo_id, sort_order, component, v AS value, c - v AS start_value, c AS end_value, v / t AS share_of_total, false AS is_total FROM (SELECT *, sum(v) OVER (PARTITION BY geo_id ORDER BY sort_order ROWS UNBOUNDED PRECEDING) AS c, sum(v) OVER (PARTITION BY geo_id) AS t FROM p)
UNION ALL SELECT geo_id, max(sort_order) + 1, 'Total', sum(v), 0, sum(v), 1, true FROM p GROUP BY geo_id""").replace("\n, p AS", ", p AS"), real="value start_value end_value share_of_total", ints="sort_order", digits=3)
def wn22(t):
    from terrapanel.operators.reshape import longer
    m = S.mart(t, "county").withColumn("geo_id", F.concat_ws("-", "geo_id", F.col("year").cast("int").cast("string")))
    long = longer(m, ["geo_id"], [f"gdp_{k}" for k in range(1, 8)], "component")
    long = long.withColumn("sort_order", F.substring("component", 5, 1).cast("int"))
    return T.waterfall(long, ["geo_id"], "sort_order", "component", "value")


@query("wn23_first_and_last_value", MART("""
SELECT geo_id, f AS first_value, l AS last_value, l - f AS change, CASE WHEN l > f THEN 'up' WHEN l < f THEN 'down' ELSE 'flat' END AS direction FROM (SELECT geo_id, arg_min(vacancy_rate, year) AS f, arg_max(vacancy_rate, year) AS l FROM mart GROUP BY geo_id)"""), real="first_value last_value change")
def wn23(t):
    return T.first_and_last(S.mart(t, "county"), ["geo_id"], "year", "vacancy_rate")


@query("wn24_index_to_base", MART("""
SELECT geo_id, year, 100 * income_total / nullif(max(CASE WHEN year = 1996 THEN income_total END) OVER (PARTITION BY geo_id), 0) AS index_value FROM mart"""), real="index_value", ints="year")
def wn24(t):
    return T.index_to_base(S.mart(t, "county"), KEYS, "year", "income_total", 1996).select("geo_id", "year", "index_value")


@query("wn25_endpoint_change", MART("""
SELECT geo_id, year, s AS start_value, e AS end_value, e - s AS delta_abs, (e - s) / nullif(abs(s), 0) AS delta_pct FROM (SELECT geo_id, year, max(CASE WHEN year = 1995 THEN pop_total END) OVER w AS s, max(CASE WHEN year = 2001 THEN pop_total END) OVER w AS e FROM mart WINDOW w AS (PARTITION BY geo_id))"""),
       real="start_value end_value delta_abs delta_pct", ints="year")
def wn25(t):
    return T.endpoint_change(S.mart(t, "county"), KEYS, "year", "pop_total", 1995, 2001).select("geo_id", "year", "start_value", "end_value", "delta_abs", "delta_pct")


@query("wn26_latest_record_per_key", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", real="value")
def wn26(t):
    return L.latest_per_key(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("wn27_top_share", TRACT("""
SELECT * FROM (SELECT geo_id, cbsa_code, row_number() OVER (PARTITION BY cbsa_code ORDER BY income_pc DESC, geo_id) AS seed_rank, CAST(ceil(count(*) OVER (PARTITION BY cbsa_code) * 0.25) AS BIGINT) AS cutoff_n FROM ty) WHERE seed_rank <= cutoff_n"""))
def wn27(t):
    return K.top_share(tract_year(t), ["cbsa_code"], "income_pc", ["geo_id"], 0.25).select("geo_id", "cbsa_code", "seed_rank", "cutoff_n")


@query("wn28_share_of_group_total", TRACT("SELECT geo_id, pop_total / sum(pop_total) OVER (PARTITION BY cbsa_code) AS share FROM ty"), real="share")
def wn28(t):
    return stats.share_of_total(tract_year(t), ["cbsa_code"], "pop_total", "share").select("geo_id", "share")


@query("wn29_tiers", TRACT("""
SELECT geo_id, CASE WHEN income_pc >= m + s THEN 'high' WHEN income_pc <= m - s THEN 'low' ELSE 'middle' END AS sd_tier, CASE WHEN income_pc >= a THEN 'A' WHEN income_pc >= b THEN 'B' ELSE 'C' END AS q_tier
FROM ty, (SELECT avg(income_pc) AS m, stddev_samp(income_pc) AS s, quantile_cont(income_pc, 0.8) AS a, quantile_cont(income_pc, 0.4) AS b FROM ty)"""))
def wn29(t):
    df = stats.sd_tiers(tract_year(t), "income_pc", "sd_tier")
    return stats.quantile_tiers(df, "income_pc", [(0.8, "A"), (0.4, "B")], "C", "q_tier").select("geo_id", "sd_tier", "q_tier")
