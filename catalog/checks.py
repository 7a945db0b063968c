"""DQ: data-quality operators."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.registry import query
from terrapanel.operators import quality as Q
from terrapanel.operators.joins import assign_by_prefix

MART = lambda body, *lv, extra="": S.sql_mart(*(lv or ("county",)), body=body, extra=extra)


@query("dq01_contract_check", MART("""
SELECT 'required_columns' AS check_name, 1.0 AS metric_value, false AS pass, 'note' AS details UNION ALL SELECT 'optional_columns_present', 1.0, true, '' UNION ALL SELECT 'non_empty', count(*), count(*) > 0, '' FROM mart
UNION ALL SELECT 'single_geo_level', 0.0, true, '' UNION ALL SELECT 'single_year', 1.0, false, '' UNION ALL SELECT 'finite_v', count(*) FILTER (hu_total % 9 = 0), count(*) FILTER (hu_total % 9 = 0) = 0, '' FROM mart"""), real="metric_value")
def dq01(t):
    m = S.mart(t, "county").withColumn("v", F.when(F.col("hu_total") % 9 != 0, F.col("income_pc")))
    return Q.contract_check(m, ["geo_level", "geo_id", "note"], ["vacancy_rate", "rank"], ["v"], ["geo_level", "year"])


@query("dq02_unique_key", MART("SELECT count(*) AS row_count, count(DISTINCT (geo_id, year)) AS distinct_keys, count(*) - count(DISTINCT (geo_id, year)) AS duplicate_rows, true AS pass FROM mart", "tract"))
def dq02(t):
    return Q.duplicate_keys(S.panel(t, "tract"), ["geo_level", "geo_id", "year"])


@query("dq03_null_rates", """
SELECT c_mktsegment, 'balance' AS column_name, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END) AS null_rate FROM customer GROUP BY c_mktsegment
UNION ALL SELECT c_mktsegment, 'nation', avg(CASE WHEN c_nationkey = 3 THEN 1.0 ELSE 0 END) FROM customer GROUP BY c_mktsegment""", real="null_rate")
def dq03(t):
    df = t.customer.select("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    return Q.null_rates(df, ["balance", "nation"], ["c_mktsegment"])


@query("dq04_pattern_check", """
SELECT 'c_name' AS column_name, count(*) AS row_count, count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) AS bad_rows, count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) = 0 AS pass FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (NOT regexp_matches(c_mktsegment, '^[A-H]')), count(*) FILTER (NOT regexp_matches(c_mktsegment, '^[A-H]')) = 0 FROM customer""")
def dq04(t):
    return Q.pattern_check(t.customer, {"c_name": r"^Customer#[0-9]{9}$", "c_mktsegment": "^[A-H]"})


@query("dq05_component_sums", MART("""
SELECT year, count(*) AS row_count, count(*) FILTER (abs(race_a + race_n - pop_total) > 700) AS bad_rows, max(abs(race_a + race_n - pop_total)) AS max_gap FROM mart GROUP BY year"""), real="max_gap", ints="year")
def dq05(t):
    return Q.component_sum_check(S.mart(t, "county"), F.col("pop_total"), [F.col("race_a"), F.col("race_n")], 700, ["year"])


@query("dq06_coverage_gap", """
SELECT lpad(CAST(k % 10 AS VARCHAR), 2, '0') AS coverage_group, count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a AND NOT b) AS only_cheap, count(*) FILTER (b AND NOT a) AS only_dear
FROM (SELECT k, bool_or(o_totalprice < 20000) AS a, bool_or(o_totalprice > 450000) AS b FROM (SELECT o_custkey AS k, o_totalprice FROM orders) GROUP BY k) WHERE a OR b GROUP BY 1""")
def dq06(t):
    o = t.orders.withColumnRenamed("o_custkey", "k")
    return Q.coverage_gap(o.filter("o_totalprice < 20000"), o.filter("o_totalprice > 450000"), ["k"], F.lpad((F.col("k") % 10).cast("string"), 2, "0"), ("cheap", "dear"))


@query("dq07_validation_suite", """
SELECT 'order_key_unique' AS check_name, 'error' AS severity, 'orders' AS dataset, CAST(count(*) - count(DISTINCT o_orderkey) AS DOUBLE) AS metric_value, count(*) = count(DISTINCT o_orderkey) AS pass, 'Duplicate keys: ' || (count(*) - count(DISTINCT o_orderkey)) AS details FROM orders
UNION ALL SELECT 'order_without_customer', 'error', 'orders', count(*), count(*) = 0, 'Orphan orders: ' || count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'negative_balance', 'warning', 'customer', count(*) FILTER (c_acctbal < 0), count(*) FILTER (c_acctbal < 0) = 0, 'Negative balances: ' || count(*) FILTER (c_acctbal < 0) FROM customer""", real="metric_value")
def dq07(t):
    zero = F.col("metric_value") == 0
    orphans = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    keys = t.orders.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return Q.validation_suite([
        Q.validation_row(keys, "order_key_unique", "error", "orders", F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), zero, "Duplicate keys"),
        Q.validation_row(orphans, "order_without_customer", "error", "orders", F.count(F.lit(1)), zero, "Orphan orders"),
        Q.validation_row(t.customer, "negative_balance", "warning", "customer", F.count(F.when(F.col("c_acctbal") < 0, 1)), zero, "Negative balances")])


@query("dq08_table_agreement", """
SELECT 'orders' AS table_name, count(*) AS row_count, count(DISTINCT o_orderkey) AS distinct_keys, 0 AS keys_not_in_base FROM orders
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey), count(DISTINCT l_orderkey) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem""", ints="keys_not_in_base")
def dq08(t):
    return Q.table_agreement({"orders": t.orders.select(F.col("o_orderkey").alias("k")), "lineitem": t.lineitem.select(F.col("l_orderkey").alias("k"))}, ["k"])


@query("dq09_assignment_rate", """
SELECT o_orderpriority, count(*) AS row_count, count(*) FILTER (o_custkey % 13 <> 0) AS assigned_rows, avg(CASE WHEN o_custkey % 13 <> 0 THEN 1.0 ELSE 0 END) AS assignment_rate FROM orders GROUP BY o_orderpriority""", real="assignment_rate")
def dq09(t):
    ref = t.customer.filter("c_custkey % 13 <> 0").select(F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("tract_geoid"))
    o = t.orders.select("o_orderpriority", F.concat(F.lpad(F.col("o_custkey").cast("string"), 11, "0"), F.lit("2001")).alias("block"))
    return Q.assignment_rate(assign_by_prefix(o, ref, "block", "tract_geoid", 11), F.col("assigned").isNotNull(), ["o_orderpriority"])
