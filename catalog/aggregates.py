"""AG: aggregations and reshaping."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.joins import GRID_SQL, POINTS_SQL, grid_polys, points
from catalog.registry import query
from terrapanel.functions import nulls as N
from terrapanel.operators import quality as Q
from terrapanel.operators import rollup as R
from terrapanel.operators import select as L
from terrapanel.operators import series as T
from terrapanel.operators import spatial as G
from terrapanel.operators import stats
from terrapanel.operators.boundary import zone_polygons
from terrapanel.operators.geometry import parts_area
from terrapanel.operators.ordered import column_quantiles
from terrapanel.session import store

MART = lambda body, *lv, extra="": S.sql_mart(*(lv or ("county",)), body=body, extra=extra)


def county_geo(t):
    return S.mart(t, "county").join(S.county_cbsa(t), F.col("geo_id") == F.col("county_geoid"))


@query("ag01_pattern_sum_rollup", MART("""
SELECT cbsa_code, year, sum(age_1) AS age_1, sum(age_2) AS age_2, sum(age_3) AS age_3, sum(age_4) AS age_4, sum(age_5) AS age_5, sum(age_6) AS age_6, sum(age_7) AS age_7
FROM mart JOIN county_cbsa ON geo_id = county_geoid GROUP BY ALL"""), real="age_1 age_2 age_3 age_4 age_5 age_6 age_7", ints="year")
def ag01(t):
    return R.rollup_sum(county_geo(t), ["cbsa_code", "year"], "^age_[0-9]+$")


@query("ag02_weighted_mean", MART("""
SELECT cbsa_code, year, sum(income_pc * w) / nullif(sum(w) FILTER (income_pc IS NOT NULL), 0) AS zero_weight,
  CASE WHEN count(*) FILTER (w IS NULL) = 0 THEN sum(income_pc * w) / sum(w) END AS propagated
FROM (SELECT *, CASE WHEN hu_total % 11 <> 0 THEN pop_total END AS w FROM mart) JOIN county_cbsa ON geo_id = county_geoid GROUP BY ALL"""),
       real="zero_weight propagated", ints="year")
def ag02(t):
    df = county_geo(t).withColumn("w", F.when(F.col("hu_total") % 11 != 0, F.col("pop_total")))
    return df.groupBy("cbsa_code", "year").agg(N.weighted_mean("income_pc", "w").alias("zero_weight"),
                                               N.weighted_mean("income_pc", "w", "propagate").alias("propagated"))


@query("ag03_weighted_pattern_rollup", MART("""
SELECT cbsa_code, year, sum(median_hh_income * pop_total) / sum(pop_total) AS median_hh_income, sum(median_gross_rent * pop_total) / sum(pop_total) AS median_gross_rent,
  sum(median_home_value * pop_total) / sum(pop_total) AS median_home_value FROM mart JOIN county_cbsa ON geo_id = county_geoid GROUP BY ALL"""),
       real="median_hh_income median_gross_rent median_home_value", ints="year")
def ag03(t):
    return R.rollup_weighted(county_geo(t), ["cbsa_code", "year"], "^median_", "pop_total")


@query("ag04_safe_weighted_mean", MART("""
SELECT cbsa_code, year, CASE WHEN sum(w) > 0 THEN sum(income_pc * w) / sum(w) ELSE avg(income_pc) END AS value
FROM (SELECT *, CASE WHEN hu_total % 2 = 0 AND year <> 1997 THEN pop_total ELSE 0 END AS w FROM mart) JOIN county_cbsa ON geo_id = county_geoid GROUP BY ALL"""), real="value", ints="year")
def ag04(t):
    df = county_geo(t).withColumn("w", F.when((F.col("hu_total") % 2 == 0) & (F.col("year") != 1997), F.col("pop_total")))
    return df.groupBy("cbsa_code", "year").agg(N.safe_weighted_mean("income_pc", "w").alias("value"))


@query("ag05_weighted_median", """
SELECT c_mktsegment, min(c_acctbal) AS weighted_median FROM (SELECT c_mktsegment, c_acctbal, w, sum(w) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS cum,
  sum(w) OVER (PARTITION BY c_mktsegment) AS tot FROM (SELECT c_mktsegment, c_acctbal, CAST(sum(1 + c_custkey % 9) AS DOUBLE) AS w FROM customer GROUP BY ALL))
WHERE cum / tot >= 0.5 GROUP BY c_mktsegment""", real="weighted_median")
def ag05(t):
    return R.weighted_median(t.customer.withColumn("w", 1 + F.col("c_custkey") % 9), ["c_mktsegment"], "c_acctbal", "w")


@query("ag06_endpoint_pivot", MART("""
SELECT geo_id, max(CASE WHEN year = 1995 THEN income_total END) AS income_total_start, max(CASE WHEN year = 2000 THEN income_total END) AS income_total_end,
  max(CASE WHEN year = 2000 THEN income_total END) - max(CASE WHEN year = 1995 THEN income_total END) AS income_total_delta FROM mart WHERE year IN (1995, 2000) GROUP BY geo_id"""),
       real="income_total_start income_total_end income_total_delta", digits=4)
def ag06(t):
    return T.endpoints_pivot(S.mart(t, "county"), ["geo_id"], "year", ["income_total"], 1995, 2000)


@query("ag07_pivot_wider", """
SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN s END) AS urgent, max(CASE WHEN o_orderpriority = '5-LOW' THEN s END) AS low
FROM (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS s FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL) GROUP BY o_custkey""", real="urgent low", digits=2)
def ag07(t):
    from terrapanel.operators.reshape import pivot_wide
    o = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return pivot_wide(o, ["o_custkey"], "o_orderpriority", {"1-URGENT": "urgent", "5-LOW": "low"}, F.sum("o_totalprice"))


@query("ag08_unpivot_longer", MART("""
SELECT geo_id, year, 'age_1' AS metric_key, age_1 AS value FROM mart UNION ALL SELECT geo_id, year, 'age_2', age_2 FROM mart UNION ALL SELECT geo_id, year, 'age_3', age_3 FROM mart"""),
       real="value", ints="year")
def ag08(t):
    from terrapanel.operators.reshape import longer
    return longer(S.mart(t, "county"), ["geo_id", "year"], ["age_1", "age_2", "age_3"])


@query("ag09_multi_level_rollup", MART("SELECT geo_level, geo_id, geo_name, year, pop_total FROM mart", "county", "cbsa", "region", "us"), real="pop_total", ints="year")
def ag09(t):
    return S.panel(t, "county", "cbsa", "region", "us").select("geo_level", "geo_id", "geo_name", "year", F.col("pop").cast("double").alias("pop_total"))


@query("ag10_gross_and_weighted_density", MART("""
SELECT cbsa_code, year, sum(pop_total) AS density_population, sum(land_area_sqmi) AS land_area_sqmi, sum(pop_total) / sum(land_area_sqmi) AS gross_density_sqmi,
  sum(pop_total * (pop_total / land_area_sqmi)) / sum(pop_total) AS pop_weighted_density_sqmi FROM mart JOIN county_cbsa ON geo_id = county_geoid GROUP BY ALL"""),
       real="density_population land_area_sqmi gross_density_sqmi pop_weighted_density_sqmi", ints="year")
def ag10(t):
    return county_geo(t).groupBy("cbsa_code", "year").agg(*R.densities("pop_total", "land_area_sqmi"))


@query("ag11_dedupe_by_max", """
SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_partkey % 2 = 0) GROUP BY ALL""",
       real="l_quantity l_extendedprice", ints="l_linenumber")
def ag11(t):
    dup = t.lineitem.unionByName(t.lineitem.filter("l_partkey % 2 = 0"))
    return R.dedupe_max(dup, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])


@query("ag12_quantiles", """
SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS median_price, quantile_cont(o_totalprice, 0.9) AS p90_price, quantile_cont(year(o_orderdate), 0.25) AS p25_year FROM orders GROUP BY o_orderpriority""",
       real="median_price p90_price p25_year")
def ag12(t):
    o = t.orders.withColumn("y", F.year("o_orderdate"))
    return column_quantiles(o, ["o_orderpriority"], {"median_price": ("o_totalprice", 0.5), "p90_price": ("o_totalprice", 0.9), "p25_year": ("y", 0.25)})


@query("ag13_distinct_and_duplicates", """
SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) - count(DISTINCT o_custkey) AS repeats FROM orders GROUP BY o_orderpriority HAVING count(*) > count(DISTINCT o_custkey)""")
def ag13(t):
    per = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy("o_orderpriority").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("customers"))
    return out.withColumn("repeats", F.col("n") - F.col("customers")).filter("repeats > 0")


@query("ag14_persistent_groups", MART("""
SELECT geo_id, count(*) FILTER (vacancy_rate > 0.36) AS hits, avg(vacancy_rate) AS mean_value FROM mart GROUP BY geo_id HAVING count(*) FILTER (vacancy_rate > 0.36) >= 2
ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25"""), real="mean_value")
def ag14(t):
    return L.persistent_groups(S.mart(t, "county"), ["geo_id"], F.col("vacancy_rate") > 0.36, 2, 25, "vacancy_rate")


@query("ag15_filtered_bool_list", """
SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchases, bool_or(event_type = 'error') AS had_error,
  (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT event_type AS x FROM events e2 WHERE e2.user_id = events.user_id)) AS kinds FROM events GROUP BY user_id""")
def ag15(t):
    e = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # one row per (user, kind) first, so the list holds kinds, never events
    return e.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("n"))), F.lit(0)).alias("purchases"),
                                    F.bool_or(F.col("event_type") == "error").alias("had_error"),
                                    F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("kinds"))


@query("ag16_benchmark_summary", MART("""
SELECT 'target' AS scope, avg(income_pc) AS income_pc, avg(vacancy_rate) AS vacancy_rate FROM mart WHERE geo_id = '000000003'
UNION ALL SELECT census_region, sum(income_pc * pop_total) / sum(pop_total), sum(vacancy_rate * pop_total) / sum(pop_total) FROM mart JOIN county_cbsa ON geo_id = county_geoid GROUP BY census_region
UNION ALL SELECT 'us', avg(income_pc), avg(vacancy_rate) FROM mart"""), real="income_pc vacancy_rate")
def ag16(t):
    df, cols = county_geo(t), ["income_pc", "vacancy_rate"]
    target = R.benchmark_summary(df.filter("geo_id = '000000003'"), [], cols).select(F.lit("target").alias("scope"), *cols)
    region = R.benchmark_summary(df, ["census_region"], cols, "weighted", "pop_total").withColumnRenamed("census_region", "scope")
    us = R.benchmark_summary(df, [], cols).select(F.lit("us").alias("scope"), *cols)
    return target.unionByName(region).unionByName(us)


@query("ag17_benchmark_bundle_index", MART("""
, l AS (SELECT census_region, geo_id, pop_total, 'income_pc' AS metric, income_pc AS value FROM mart JOIN county_cbsa ON geo_id = county_geoid
  UNION ALL SELECT census_region, geo_id, pop_total, 'vacancy_rate', vacancy_rate FROM mart JOIN county_cbsa ON geo_id = county_geoid),
b AS (SELECT census_region, metric, avg(value) AS bench_mean, sum(value * pop_total) / sum(pop_total) AS bench_weighted, median(value) AS bench_median FROM l GROUP BY ALL)
SELECT census_region, metric, geo_id, value, bench_mean, bench_weighted, bench_median, 100 * value / nullif(bench_median, 0) AS index_vs_median FROM l JOIN b USING (census_region, metric)""").replace("\n, l AS", ", l AS"),
       real="value bench_mean bench_weighted bench_median index_vs_median")
def ag17(t):
    df = county_geo(t)
    b = R.benchmark_bundle(df, ["census_region"], ["income_pc", "vacancy_rate"], "pop_total")
    long = df.select("census_region", "geo_id", "income_pc", "vacancy_rate").unpivot(["census_region", "geo_id"], ["income_pc", "vacancy_rate"], "metric", "value")
    return long.join(b, ["census_region", "metric"]).withColumn("index_vs_median", F.try_divide(F.lit(100.0) * F.col("value"), F.col("bench_median")))


_CORR = ["income_pc", "vacancy_rate", "mean_travel_time"]
_CORR_BASE = """, c AS (SELECT geo_id, year, income_pc, CASE WHEN hu_total % 5 <> 0 THEN vacancy_rate END AS vacancy_rate, round(mean_travel_time, 0) AS mean_travel_time FROM mart)"""


def _corr_frame(t):
    return S.mart(t, "county").select("geo_id", "year", "income_pc", F.when(F.col("hu_total") % 5 != 0, F.col("vacancy_rate")).alias("vacancy_rate"),
                                      F.round("mean_travel_time", 0).alias("mean_travel_time"))


@query("ag18_correlation_pearson", S.sql_mart("county", extra=_CORR_BASE.strip(", "), body="""
SELECT x AS metric_x, y AS metric_y, r AS correlation, n, CASE WHEN x = y OR abs(r) >= 0.05 THEN r END AS correlation_display FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {'1.0' if a == b else f'corr({a}, {b})'} AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM c" for a in _CORR for b in _CORR) + ")"),
       real="correlation correlation_display")
def ag18p(t):
    return stats.correlation_long(_corr_frame(t), ["geo_id", "year"], _CORR, "pearson", weak=0.05)


def _spearman_sql(a, b):
    if a == b:
        return f"SELECT '{a}' AS metric_x, '{b}' AS metric_y, 1.0 AS correlation, count({a}) AS n FROM c"
    avg = lambda v: f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"
    return f"""SELECT '{a}' AS metric_x, '{b}' AS metric_y, corr(ra, rb) AS correlation, count(*) AS n FROM (SELECT {avg(a)} AS ra, {avg(b)} AS rb FROM c WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("ag18_correlation_spearman", S.sql_mart("county", extra=_CORR_BASE.strip(", "), body="SELECT *, correlation AS correlation_display FROM (" + " UNION ALL ".join(
    _spearman_sql(a, b) for a in _CORR for b in _CORR) + ")"), real="correlation correlation_display")
def ag18s(t):
    return stats.correlation_long(_corr_frame(t), ["geo_id", "year"], _CORR, "spearman")


@query("ag19_group_stats_joined_back", MART("""
SELECT geo_id, census_region, vacancy_rate, median(vacancy_rate) OVER (PARTITION BY census_region) AS group_median, count(*) OVER (PARTITION BY census_region) AS group_n
FROM mart JOIN county_cbsa ON geo_id = county_geoid"""), real="vacancy_rate group_median")
def ag19(t):
    df = county_geo(t).select("geo_id", "census_region", "vacancy_rate")
    g = R.group_summary(df, ["census_region"], medians={"group_median": "vacancy_rate"}, aggs=[F.count("vacancy_rate").alias("group_n")])
    return df.join(g, "census_region")


_HEX = """, h AS (SELECT *, CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END AS q, CASE WHEN dq > dr AND dq > ds THEN r0 WHEN dr > ds THEN -q0 - s0 ELSE r0 END AS r FROM (
  SELECT *, abs(q0 - qf) AS dq, abs(r0 - rf) AS dr, abs(s0 + qf + rf) AS ds FROM (SELECT *, round_even(qf, 0) AS q0, round_even(rf, 0) AS r0, round_even(-qf - rf, 0) AS s0 FROM (
    SELECT score, (x / 0.04) * (sqrt(3) / 3) - (y / 0.04) / 3 AS qf, (y / 0.04) * (2.0 / 3) AS rf FROM p))))"""


@query("ag20_hexagonal_binning", f"WITH {POINTS_SQL}{_HEX} SELECT q, r, count(*) AS n, sum(score) AS weight FROM h GROUP BY q, r", real="weight", ints="q r n")
def ag20(t):
    return R.hex_bin(points(t), "x", "y", 0.04, "score")


@query("ag21_column_profile", """
WITH s AS (SELECT 'c_acctbal' AS column_name, CAST(c_acctbal AS VARCHAR) AS v, c_acctbal AS num, true AS isnum FROM customer UNION ALL
  SELECT 'c_mktsegment', nullif(c_mktsegment, 'BUILDING'), NULL, false FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), c_nationkey, true FROM customer)
SELECT column_name, count(*) AS row_count, count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count, min(num) AS min_value, max(num) AS max_value,
  min(CASE WHEN NOT isnum THEN length(v) END) AS min_length, max(CASE WHEN NOT isnum THEN length(v) END) AS max_length, (count(*) - count(v)) * 100.0 / count(*) AS null_pct FROM s GROUP BY column_name""",
       real="min_value max_value null_pct", ints="min_length max_length")
def ag21(t):
    df = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return Q.profile(df, ["c_acctbal", "c_mktsegment", "c_nationkey"])


@query("ag21_top_values", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS value_rank FROM (
  SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY ALL)) WHERE value_rank <= 5""")
def ag21_top(t):
    return Q.top_values(t.customer, ["c_mktsegment", "c_nationkey"], 5).withColumn("value_rank", F.col("value_rank").cast("bigint"))


@query("ag22_key_candidates", """
SELECT 'l_orderkey' AS key_columns, count(*) AS row_count, count(DISTINCT l_orderkey) AS distinct_keys, count(*) - count(DISTINCT l_orderkey) AS duplicate_rows, 0 AS null_key_rows, count(*) = count(DISTINCT l_orderkey) AS is_key FROM lineitem
UNION ALL SELECT 'l_orderkey + l_linenumber', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) - count(DISTINCT (l_orderkey, l_linenumber)), 0, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""", ints="null_key_rows")
def ag22(t):
    return Q.key_stats(t.lineitem, [["l_orderkey"], ["l_orderkey", "l_linenumber"]])


@query("ag23_funnel_counts", """
SELECT 1 AS step_order, 'All rows' AS step, count(*) AS rows_remaining FROM customer UNION ALL SELECT 2, 'positive balance', count(*) FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 3, 'builder', count(*) FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' UNION ALL SELECT 4, 'core', count(*) FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND c_nationkey < 10""", ints="step_order")
def ag23(t):
    return Q.funnel(t.customer, {"positive balance": F.col("c_acctbal") > 0, "builder": F.col("c_mktsegment") == "BUILDING", "core": F.col("c_nationkey") < 10})


@query("ag24_zone_rollup", MART("""
SELECT census_region, count(*) AS tracts, sum(pop_total) AS total_population, sum(income_pc * pop_total) / sum(pop_total) AS income_pc_wtd, avg(pct_ba_plus) AS mean_pct_ba_plus, median(vacancy_rate) AS vacancy_rate_median
FROM mart JOIN tract_cbsa ON geo_id = tract_geoid GROUP BY census_region""", "tract"), real="total_population income_pc_wtd mean_pct_ba_plus vacancy_rate_median")
def ag24(t):
    from terrapanel.operators.graph import zone_summary
    df = S.mart(t, "tract").join(S.tract_cbsa(t), F.col("geo_id") == F.col("tract_geoid"))
    return zone_summary(df, ["census_region"], "pop_total", ["income_pc"], ["vacancy_rate"], "pct_ba_plus")


@query("ag25_zone_boundary", f"""
WITH {GRID_SQL}, e AS (SELECT c_nationkey AS zone, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM g UNION ALL SELECT c_nationkey, x, y + 1, x + 1, y + 1 FROM g
  UNION ALL SELECT c_nationkey, x, y, x, y + 1 FROM g UNION ALL SELECT c_nationkey, x + 1, y, x + 1, y + 1 FROM g)
SELECT zone, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) = 1""", real="x1 y1 x2 y2", ints="zone")
def ag25(t):
    return G.dissolve(grid_polys(t).withColumnRenamed("c_nationkey", "zone"), ["zone"])


@query("ag25_zone_polygon", f"""
WITH {GRID_SQL}, e AS (SELECT c_nationkey AS zone, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM g UNION ALL SELECT c_nationkey, x, y + 1, x + 1, y + 1 FROM g
  UNION ALL SELECT c_nationkey, x, y, x, y + 1 FROM g UNION ALL SELECT c_nationkey, x + 1, y, x + 1, y + 1 FROM g),
once AS (SELECT zone, count(*) AS outline_edges, min(x1) AS least_x, max(y2) AS most_y FROM (SELECT zone, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) = 1) GROUP BY zone)
SELECT zone, (SELECT CAST(count(*) AS DOUBLE) FROM g WHERE c_nationkey = zone) AS area, outline_edges, least_x, most_y, true AS closed FROM once""",
       real="area least_x most_y", ints="zone outline_edges")
def ag25_polygon(t):
    """Geometry of each zone: what SQL can state of it is its area, the length of its outline and its extent."""
    z = store(zone_polygons(grid_polys(t).withColumnRenamed("c_nationkey", "zone"), ["zone"]))
    rings = F.flatten("parts")
    points = F.flatten(rings)
    return z.select("zone", parts_area("parts").alias("area"), (F.size(points) - F.size(rings)).cast("bigint").alias("outline_edges"),
                    F.array_min(F.transform(points, lambda p: p["x"])).alias("least_x"), F.array_max(F.transform(points, lambda p: p["y"])).alias("most_y"),
                    F.forall(rings, lambda r: r[0] == F.element_at(r, -1)).alias("closed"))


@query("ag25_zone_area", f"WITH {GRID_SQL} SELECT c_nationkey AS zone, CAST(count(*) AS DOUBLE) AS zone_area, count(*) AS polygons FROM g GROUP BY c_nationkey", real="zone_area", ints="zone")
def ag25_area(t):
    return G.zone_areas(grid_polys(t).withColumnRenamed("c_nationkey", "zone"), ["zone"])


@query("ag26_composition_share", """
SELECT zone, c_mktsegment, area, area / sum(area) OVER (PARTITION BY zone) AS share FROM (
  SELECT c_nationkey AS zone, c_mktsegment, CAST(sum(1 + c_custkey % 5) AS DOUBLE) AS area FROM customer GROUP BY c_nationkey, c_mktsegment)""", real="area share", ints="zone")
def ag26(t):
    df = t.customer.select(F.col("c_nationkey").alias("zone"), "c_mktsegment", (1 + F.col("c_custkey") % 5).cast("double").alias("area"))
    return R.composition_share(df, ["zone"], "c_mktsegment", "area")


@query("ag27_flow_balance", """
WITH f AS (SELECT c_nationkey AS o, s_nationkey AS d, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
x AS (SELECT f.q, a.n_regionkey AS og, b.n_regionkey AS dg FROM f JOIN nation a ON o = a.n_nationkey JOIN nation b ON d = b.n_nationkey)
SELECT r_regionkey AS region_key, (SELECT sum(q) FROM x WHERE dg = r_regionkey AND og <> dg) AS inflow, (SELECT sum(q) FROM x WHERE og = r_regionkey AND og <> dg) AS outflow, (SELECT sum(q) FROM x WHERE og = r_regionkey AND og = dg) AS internal FROM region""",
       real="inflow outflow internal", ints="region_key")
def ag27(t):
    f = flows(t)
    members = t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region_key"))
    return R.flow_balance(f, members, "origin_id", "dest_id", "nation", "region_key", "amount")


def flows(t):
    """Customer nation to supplier nation, units shipped."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").alias("origin_id"), F.col("s_nationkey").alias("dest_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("amount"))
