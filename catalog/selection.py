"""SO, ST: sorting, top-k, entity selection, set operations."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.registry import query
from terrapanel.functions.nulls import asc_last, desc_last
from terrapanel.operators import ranking as K
from terrapanel.operators import select as L

MART = lambda body, *lv, extra="": S.sql_mart(*(lv or ("county",)), body=body, extra=extra)


@query("so01_sort_nulls_last", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer ORDER BY 2 DESC NULLS LAST, 1", real="c_acctbal")
def so01(t):
    df = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_acctbal")
    return df.orderBy(desc_last("segment"), asc_last("c_custkey"))


@query("so02_top_and_bottom_k", """
SELECT * FROM (SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) UNION ALL
SELECT * FROM (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20)""", real="o_totalprice")
def so02(t):
    cols = ["o_orderkey", "o_totalprice"]
    top = L.top_k(t.orders, [desc_last("o_totalprice"), asc_last("o_orderkey")], 20).select(F.lit("top").alias("side"), *cols)
    low = L.top_k(t.orders, [asc_last("o_totalprice"), asc_last("o_orderkey")], 20).select(F.lit("bottom").alias("side"), *cols)
    return top.unionByName(low)


@query("so03_top_k_with_forced_rows", """
SELECT c_custkey, c_acctbal, overall_rank, true AS truncated_flag FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS overall_rank FROM customer) WHERE overall_rank <= 15 OR c_custkey IN (3, 77, 140)""", real="c_acctbal")
def so03(t):
    return L.top_k_with(t.customer, "c_acctbal", ["c_custkey"], 15, F.col("c_custkey").isin(3, 77, 140)).select("c_custkey", "c_acctbal", "overall_rank", "truncated_flag")


_RANKED = "r AS (SELECT geo_id, year, income_total, row_number() OVER (PARTITION BY year ORDER BY income_total DESC, geo_id) AS rank FROM mart)"


@query("so04_select_entities", MART("""
SELECT 'fixed' AS strategy, geo_id, year, rank FROM r WHERE geo_id IN (SELECT geo_id FROM r WHERE year = 2001 AND rank <= 8)
UNION ALL SELECT 'rolling', geo_id, year, rank FROM r WHERE geo_id IN (SELECT geo_id FROM r WHERE rank <= 3)
UNION ALL SELECT 'peers', geo_id, year, rank FROM r WHERE geo_id IN ('000000001', '000000002')""", extra=_RANKED), ints="year")
def so04(t):
    r = K.rank_by(S.mart(t, "county").select("geo_id", "year", "income_total"), ["year"], "income_total", ["geo_id"], "rank")
    pick = lambda name, *a, **k: L.select_entities(r, *a, "geo_id", "year", "rank", **k).select(F.lit(name).alias("strategy"), "geo_id", "year", "rank")
    return pick("fixed", "fixed_top_n", k=8).unionByName(pick("rolling", "rolling_top_n", k=3)).unionByName(
        pick("peers", "peer_set", peers=["000000001", "000000002"]))


@query("st01_union_by_name", """
SELECT 'supplier' AS kind, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT 'customer', c_name, c_acctbal, c_mktsegment FROM customer""", real="balance")
def st01(t):
    s = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = t.customer.select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("st02_distinct_keep_first", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def st02(t):
    return L.first_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("st03_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def st03(t):
    k = F.col("o_custkey").alias("k")
    return t.orders.filter("o_orderstatus = 'F'").select(k).intersect(t.orders.filter("o_orderpriority = '1-URGENT'").select(k))


@query("st04_difference_both_ways", """
SELECT 'only_a' AS side, k FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice < 20000 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
UNION ALL SELECT 'only_b', k FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 450000 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice < 20000)""")
def st04(t):
    k = F.col("o_custkey").alias("k")
    a, b = t.orders.filter("o_totalprice < 20000").select(k).distinct(), t.orders.filter("o_totalprice > 450000").select(k).distinct()
    return a.subtract(b).select(F.lit("only_a").alias("side"), "k").unionByName(b.subtract(a).select(F.lit("only_b").alias("side"), "k"))
