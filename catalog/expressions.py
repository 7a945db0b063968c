"""PR, FI: projections, scalar expressions and predicates."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.registry import query
from terrapanel.functions import columns as C
from terrapanel.functions import nulls as N
from terrapanel.operators import stats
from terrapanel.operators.joins import latest, latest_common
from terrapanel.operators.rollup import cols_matching
from terrapanel.plans.silver import standardize_frame

MART = lambda body, *lv: S.sql_mart(*(lv or ("county",)), body=body)


@query("pr01_standardize_survey_frame", MART("""
SELECT 'county' AS geo_level, geo_id, geo_name, year, pop_total, median_hh_income FROM mart"""), real="pop_total median_hh_income", ints="year")
def pr01(t):
    raw = S.mart(t, "county").select(
        F.col("geo_id").alias("GEOID"), F.col("geo_name").alias("NAME"), "year", F.col("pop_total").alias("pop_totalE"),
        F.lit(1.0).alias("pop_totalM"), F.col("median_hh_income").alias("median_hh_incomeE"), F.lit(2.0).alias("median_hh_incomeM"))
    return standardize_frame(raw, "county", drop_e=True)


@query("pr02_normalize_geo_key", """
SELECT CASE WHEN k = '00000' THEN 'us' WHEN lv = 'zip code' THEN 'zcta' ELSE lv END AS geo_level,
  CASE WHEN k = '00000' THEN '1' WHEN lv = 'state' AND length(k) = 5 AND substr(k, 3, 3) = '000' THEN substr(k, 1, 2) ELSE k END AS geo_id,
  c_custkey FROM (SELECT c_custkey, lower(trim(lv0)) AS lv, CASE WHEN c_custkey % 50 = 0 THEN '00000' WHEN c_custkey % 3 = 0
    THEN lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || '000' ELSE lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS k
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' State' WHEN c_custkey % 3 = 1 THEN 'ZIP Code ' ELSE 'County' END AS lv0 FROM customer))""")
def pr02(t):
    k = F.col("c_custkey")
    raw = t.customer.select("c_custkey",
        F.when(k % 3 == 0, " State").when(k % 3 == 1, "ZIP Code ").otherwise("County").alias("geo_level"),
        F.when(k % 50 == 0, "00000").when(k % 3 == 0, F.concat(F.lpad((k % 60).cast("string"), 2, "0"), F.lit("000"))).otherwise(
            F.lpad(k.cast("string"), 5, "0")).alias("geo_id"))
    return C.normalize_geo_key(raw)


@query("pr03_geoid", """
SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS county_geoid FROM supplier""")
def pr03(t):
    return t.supplier.select("s_suppkey", C.geoid("s_nationkey", F.col("s_suppkey") % 1000, widths=(2, 3)).alias("county_geoid"))


@query("pr04_safe_ratio", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_custkey * 1000.0 / c_acctbal END AS per_1000,
  c_custkey / nullif(CAST(c_custkey % 4 AS DOUBLE), 0) AS ratio FROM customer""", real="per_1000 ratio")
def pr04(t):
    return t.customer.select("c_custkey", N.safe_ratio("c_custkey", "c_acctbal", 1000.0).alias("per_1000"),
                             N.ratio_or_null("c_custkey", F.col("c_custkey") % 4).alias("ratio"))


@query("pr05_null_as_zero_sum", MART("""
SELECT geo_id, year, coalesce(nullif(race_a, 0), 0) + coalesce(CASE WHEN race_n > 200 THEN race_n END, 0) + coalesce(race_r, 0) AS churn FROM mart"""),
       real="churn", ints="year")
def pr05(t):
    m = S.mart(t, "county").withColumn("race_n", F.when(F.col("race_n") > 200, F.col("race_n")))
    return m.select("geo_id", "year", N.sum0("race_a", "race_n", "race_r").alias("churn"))


@query("pr06_first_available", """
SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 5000 THEN s_acctbal END, CASE WHEN s_suppkey % 2 = 0 THEN -1.0 END, 0.0) AS value FROM supplier""", real="value")
def pr06(t):
    return t.supplier.select("s_suppkey", N.first_available(
        F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal")), F.when(F.col("s_suppkey") % 2 == 0, F.lit(-1.0)), F.lit(0.0)).alias("value"))


@query("pr07_bucket_columns", MART("""
SELECT geo_id, year, age_1 + age_2 AS young, age_3 + age_4 + age_5 AS middle, age_6 + age_7 AS old FROM mart"""), real="young middle old", ints="year")
def pr07(t):
    out = C.bucket_columns(S.mart(t, "county"), {"young": ["age_1", "age_2"], "middle": ["age_3", "age_4", "age_5"], "old": ["age_6", "age_7"]})
    return out.select("geo_id", "year", "young", "middle", "old")


@query("pr08_share_family", MART("""
SELECT geo_id, year, race_a / nullif(pop_total, 0) AS pct_race_a, race_n / nullif(pop_total, 0) AS pct_race_n,
  race_r / nullif(pop_total, 0) AS pct_race_r FROM mart"""), real="pct_race_a pct_race_n pct_race_r", ints="year")
def pr08(t):
    out = C.add_shares(S.mart(t, "county"), ["race_a", "race_n", "race_r"], "pop_total")
    return out.select("geo_id", "year", "pct_race_a", "pct_race_n", "pct_race_r")


@query("pr09_age_bands", MART("""
SELECT geo_id, year, young, mid, d AS band_denominator, CASE WHEN d > 0 THEN young / d END AS pct_young, CASE WHEN d > 0 THEN mid / d END AS pct_mid
FROM (SELECT geo_id, year, age_1 + age_2 AS young, age_3 + age_4 AS mid, CASE WHEN hu_total % 2 = 0 THEN pop_total ELSE age_1 + age_2 + age_3 + age_4 END AS d FROM mart)"""),
       real="young mid band_denominator pct_young pct_mid", ints="year")
def pr09(t):
    m = S.mart(t, "county").withColumn("denom", F.when(F.col("hu_total") % 2 == 0, F.col("pop_total")))
    bands = C.age_bands({"young": ["age_1", "age_2"], "mid": ["age_3", "age_4"]}, "denom")
    return m.select("geo_id", "year", *[c.alias(n) for n, c in bands.items()])


@query("pr10_dependency_ratios", MART("""
SELECT geo_id, year, (age_1 + age_2) / nullif(age_3 + age_4 + age_5, 0) AS youth_dependency,
  (age_6 + age_7) / nullif(age_3 + age_4 + age_5, 0) AS old_age_dependency, (age_1 + age_2) / nullif(age_6 + age_7, 0) AS aging_index FROM mart"""),
       real="youth_dependency old_age_dependency aging_index", ints="year")
def pr10(t):
    young, work, old = N.add_cols("age_1", "age_2"), N.add_cols("age_3", "age_4", "age_5"), N.add_cols("age_6", "age_7")
    return S.mart(t, "county").select("geo_id", "year", N.ratio_or_null(young, work).alias("youth_dependency"),
                                      N.ratio_or_null(old, work).alias("old_age_dependency"), N.ratio_or_null(young, old).alias("aging_index"))


@query("pr11_hhi_diversity", MART("""
SELECT geo_id, year, a * a + n * n + r * r AS hhi, 1 - (a * a + n * n + r * r) AS diversity_index
FROM (SELECT geo_id, year, owner_occ_rate AS a, renter_occ_rate AS n, vacancy_rate AS r FROM mart)"""), real="hhi diversity_index", ints="year")
def pr11(t):
    shares = ("owner_occ_rate", "renter_occ_rate", "vacancy_rate")
    return S.mart(t, "county").select("geo_id", "year", C.hhi(*shares).alias("hhi"), C.diversity(*shares).alias("diversity_index"))


@query("pr12_residual_reconciliation", MART("""
SELECT geo_id, year, s AS part_sum, income_total - s AS residual, s / nullif(income_total, 0) AS coverage_ratio,
  (income_total - s) / nullif(income_total, 0) AS pct_residual, CASE WHEN s / nullif(income_total, 0) > 0.9 THEN 'over' ELSE 'ok' END AS coverage_flag
FROM (SELECT *, gdp_1 + gdp_2 + gdp_3 + gdp_4 + gdp_5 + gdp_6 AS s FROM mart)"""),
       real="part_sum residual coverage_ratio pct_residual", ints="year", digits=4)
def pr12(t):
    out = C.residual(S.mart(t, "county"), "income_total", [f"gdp_{k}" for k in range(1, 7)], high=0.9)
    return out.select("geo_id", "year", "part_sum", "residual", "coverage_ratio", "pct_residual", "coverage_flag")


@query("pr13_classify", """
SELECT p_partkey, CASE WHEN p_type LIKE 'ECO%' THEN 'economy' WHEN p_size >= 40 THEN 'large' WHEN p_name LIKE '%ring' THEN 'ring' ELSE 'other' END AS mix FROM part""")
def pr13(t):
    return t.part.select("p_partkey", C.classify([(F.col("p_type").startswith("ECO"), "economy"), (F.col("p_size") >= 40, "large"),
                                                  (F.col("p_name").rlike("ring$"), "ring")], "other").alias("mix"))


@query("pr14_sentinels_to_null", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer""", real="balance")
def pr14(t):
    return t.customer.select("c_custkey", N.null_if("c_acctbal", F.col("c_acctbal") < 0).alias("balance"),
                             N.null_if("c_mktsegment", F.col("c_mktsegment") == "BUILDING").alias("segment"))


@query("pr15_text_extraction", """
SELECT s_suppkey, 'SAGDP2' AS table_code, 'Dollars ' || s_nationkey AS unit, s_name AS plain, regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g') AS snake,
  regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS name_key, 'NC' AS state_abbr, 'Wilmington' AS city FROM supplier""")
def pr15(t):
    title = F.concat(F.lit("[SAGDP2] "), "s_name", F.lit(" (Dollars "), F.col("s_nationkey").cast("string"), F.lit(")"))
    place = F.lit("Wilmington, NC-SC (MSA)")
    return t.supplier.select(
        "s_suppkey", C.in_brackets(title).alias("table_code"), C.in_parentheses(title).alias("unit"),
        C.strip_apostrophe(F.concat(F.lit("'"), "s_name")).alias("plain"), C.snake_case("s_name").alias("snake"),
        C.text_key("s_name").alias("name_key"), C.state_of_title(place).alias("state_abbr"), F.split_part(place, F.lit(","), F.lit(1)).alias("city"))


@query("pr16_dates", """
SELECT o_orderkey, CASE WHEN m BETWEEN 1 AND 12 THEN make_date(y, m, 1) END AS sale_month, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS recency_days,
  y || '_to_' || (y + 5) AS time_window FROM (SELECT o_orderkey, o_orderdate, year(o_orderdate) AS y, month(o_orderdate) + o_orderkey % 3 AS m FROM orders)""", ints="recency_days")
def pr16(t):
    y, m = F.year("o_orderdate"), F.month("o_orderdate") + F.col("o_orderkey") % 3
    return t.orders.select("o_orderkey", C.month_start(y, m).alias("sale_month"), C.days_since("o_orderdate", "2002-01-01").alias("recency_days"),
                           C.window_label(y, y + 5).alias("time_window"))


@query("pr17_rescale_and_clamp", """
SELECT c_custkey, 100.0 * (c_acctbal - lo) / nullif(hi - lo, 0) AS score, least(greatest(c_acctbal, 0), 5000) AS clamped, least(NULL, c_acctbal, 0) AS offset_value
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""", real="score clamped offset_value")
def pr17(t):
    out = stats.rescale_0_100(t.customer, {"c_acctbal": "score"})
    return out.select("c_custkey", "score", C.clamp("c_acctbal", 0, 5000).alias("clamped"),
                      F.least(F.lit(None).cast("double"), "c_acctbal", F.lit(0.0)).alias("offset_value"))


@query("pr18_weighted_scores", MART("""
SELECT geo_id, year, 0.5 * owner_occ_rate + 0.3 * vacancy_rate + 0.2 * pct_ba_plus AS score,
  CASE WHEN d > 0 THEN 100 * (0.5 * coalesce(o, 0) + 0.5 * coalesce(v, 0)) / d END AS reweighted
FROM (SELECT *, CASE WHEN o IS NULL THEN 0 ELSE 0.5 END + CASE WHEN v IS NULL THEN 0 ELSE 0.5 END AS d
  FROM (SELECT *, CASE WHEN owner_occ_rate > 0.3 THEN owner_occ_rate END AS o, CASE WHEN vacancy_rate > 0.3 THEN vacancy_rate END AS v FROM mart))"""),
       real="score reweighted", ints="year")
def pr18(t):
    m = S.mart(t, "county").withColumns({"o": F.when(F.col("owner_occ_rate") > 0.3, F.col("owner_occ_rate")),
                                         "v": F.when(F.col("vacancy_rate") > 0.3, F.col("vacancy_rate"))})
    return m.select("geo_id", "year", C.weighted_score({"owner_occ_rate": 0.5, "vacancy_rate": 0.3, "pct_ba_plus": 0.2}).alias("score"),
                    C.reweighted_score({"o": 0.5, "v": 0.5}, 100).alias("reweighted"))


@query("pr19_gates", MART("""
SELECT geo_id, year, g1 AS gate_pop, g2 AS gate_price, CASE WHEN g1 = 1 AND g2 = 1 THEN 1 ELSE 0 END AS eligible FROM (
  SELECT geo_id, year, CASE WHEN nullif(vacancy_rate, 0) >= 0.3 THEN 1 ELSE 0 END AS g1, CASE WHEN owner_occ_rate < 0.35 THEN 1 ELSE 0 END AS g2 FROM mart)"""),
       ints="year gate_pop gate_price eligible")
def pr19(t):
    out = C.with_gates(S.mart(t, "county"), {"gate_pop": F.nullif("vacancy_rate", F.lit(0.0)) >= 0.3, "gate_price": F.col("owner_occ_rate") < 0.35})
    return out.select("geo_id", "year", "gate_pop", "gate_price", "eligible")


@query("pr20_reason_tags", """
SELECT c_custkey, CASE WHEN t = '' THEN 'Balanced profile' ELSE t END AS why_tags FROM (SELECT c_custkey, concat_ws(' | ',
  CASE WHEN c_acctbal > 8000 THEN 'High balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Builder' END, CASE WHEN c_nationkey < 5 THEN 'Core nation' END) AS t FROM customer)""")
def pr20(t):
    return t.customer.select("c_custkey", C.reason_tags({
        "High balance": F.col("c_acctbal") > 8000, "Builder": F.col("c_mktsegment") == "BUILDING", "Core nation": F.col("c_nationkey") < 5},
        "Balanced profile").alias("why_tags"))


@query("pr21_safe_numeric_cast", "SELECT p_partkey, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no, try_cast(p_name AS DOUBLE) AS name_no FROM part", real="brand_no name_no")
def pr21(t):
    return t.part.select("p_partkey", N.try_double(F.regexp_replace("p_brand", "Brand#", "")).alias("brand_no"), N.try_double("p_name").alias("name_no"))


@query("pr22_utf8_scrub", "SELECT doc_id, length(text) AS chars, lang FROM documents", ints="chars")
def pr22(t):
    return C.scrub_utf8(t.documents.select("doc_id", "text", "lang")).select("doc_id", F.length("text").cast("bigint").alias("chars"), "lang")


@query("pr23_columns_by_pattern", MART("SELECT geo_id, year, age_1, age_2, age_3, age_4, age_5, age_6, age_7 FROM mart"),
       real="age_1 age_2 age_3 age_4 age_5 age_6 age_7", ints="year")
def pr23(t):
    m = S.mart(t, "county")
    return m.select("geo_id", "year", *cols_matching(m, "^age_[0-9]+$"))


@query("fi01_predicates", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 8000 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
  AND c_name ILIKE 'customer#%' AND regexp_matches(c_name, '[0-9]{3}$') AND isfinite(c_acctbal)
  AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))""", real="c_acctbal")
def fi01(t):
    keep = t.nation.filter(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("c_nationkey"))
    df = t.customer.filter(F.col("c_acctbal").between(1000, 8000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")
                           & F.col("c_name").ilike("customer#%") & F.col("c_name").rlike("[0-9]{3}$") & N.finite("c_acctbal"))
    return df.join(keep, "c_nationkey", "left_semi").select("c_custkey", "c_name", "c_acctbal")


@query("fi02_latest_period", MART("""
SELECT 'latest' AS which, geo_id, year, pop_total FROM mart WHERE year = (SELECT max(year) FROM mart WHERE hu_total > 3) AND hu_total > 3
UNION ALL SELECT 'common', geo_id, year, pop_total FROM mart WHERE year = (SELECT least(max(year), (SELECT max(year(o_orderdate)) - 1 FROM orders)) FROM mart)"""),
       real="pop_total", ints="year")
def fi02(t):
    m = S.mart(t, "county").select("geo_id", "year", "pop_total", "hu_total")
    last = latest(m, "year", F.col("hu_total") > 3).select(F.lit("latest").alias("which"), "geo_id", "year", "pop_total")
    o = t.orders.select((F.year("o_orderdate") - 1).alias("year"))
    both = latest_common([m, o], "year")[0].select(F.lit("common").alias("which"), "geo_id", "year", "pop_total")
    return last.unionByName(both)
