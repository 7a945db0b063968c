"""Panel tables derived from the supplied tables, in Spark and as SQL text.

customer plays the tract (also the ZCTA), supplier the county, nation the
metro (CBSA), region the census region. Measures come from order lines by
ship year and stay integers (dollars as cents) until rates are formed, so
that both engines add them exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import Tables
from terrapanel.operators.rollup import multi_level_rollup

# Additive measures of an order line; the expressions are valid in both engines.
LINE = """year(l_shipdate) AS year, CAST(l_quantity AS BIGINT) AS qty,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS disc,
    CAST(round(l_tax * 100) AS BIGINT) AS tax, l_linenumber AS ln, l_returnflag AS flag, l_linestatus AS status"""
MEASURES = {
    "pop": "sum(qty)", "hu": "count(*)", "inc": "sum(cents)", "rentw": "sum(qty * disc)", "taxw": "sum(qty * tax)",
    **{f"age{k}": f"sum(CASE WHEN ln = {k} THEN qty ELSE 0 END)" for k in range(1, 8)},
    **{f"gdp{k}": f"sum(CASE WHEN ln = {k} THEN cents ELSE 0 END)" for k in range(1, 8)},
    "race_a": "sum(CASE WHEN flag = 'A' THEN qty ELSE 0 END)",
    "race_n": "sum(CASE WHEN flag = 'N' THEN qty ELSE 0 END)",
    "race_r": "sum(CASE WHEN flag = 'R' THEN qty ELSE 0 END)",
    "permits": "sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END)",
}
# Rates and levels in the marts' column names, from the additive measures.
DERIVED = {
    "pop_total": "CAST(pop AS DOUBLE)",
    "hu_total": "CAST(hu AS DOUBLE)",
    "income_total": "CAST(inc AS DOUBLE) / 100",
    "income_pc": "CAST(inc AS DOUBLE) / (100 * pop)",
    "median_hh_income": "CAST(inc AS DOUBLE) / (100 * hu)",
    "median_gross_rent": "CAST(inc AS DOUBLE) / (100 * pop) * (5e-1 + rentw / (1e1 * pop)) / 2",
    "median_home_value": "CAST(inc AS DOUBLE) / (25 * pop) * (1 + taxw / (1e1 * pop))",
    "pct_rent_burden_30plus": "rentw / (1e1 * pop)",
    "pct_rent_burden_50plus": "taxw / (1e1 * pop)",
    "pct_ba_plus": "CAST(age1 AS DOUBLE) / pop",
    "vacancy_rate": "CAST(race_r AS DOUBLE) / pop",
    "owner_occ_rate": "CAST(race_a AS DOUBLE) / pop",
    "renter_occ_rate": "CAST(race_n AS DOUBLE) / pop",
    "mean_travel_time": "taxw * 5e0 / pop",
    "pct_commute_wfh": "CAST(age7 AS DOUBLE) / pop",
    "permits": "CAST(permits AS DOUBLE)",
    "permits_per_1000": "permits * 1e3 / pop",
    "land_area_sqmi": "CAST(hu AS DOUBLE) + 5e-1",
    **{f"age_{k}": f"CAST(age{k} AS DOUBLE)" for k in range(1, 8)},
    **{f"gdp_{k}": f"CAST(gdp{k} AS DOUBLE) / 100" for k in range(1, 8)},
    **{f"race_{k}": f"CAST(race_{k} AS DOUBLE)" for k in "anr"},
}
RATIOS = {
    "value_to_income": "median_home_value / median_hh_income",
    "rent_to_income": "median_gross_rent * 12 / median_hh_income",
}
KEYS = ["geo_level", "geo_id", "geo_name", "year"]


def lines(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey", "l_suppkey", *[s.strip() for s in _split(LINE)])


def _split(exprs: str) -> list[str]:
    """Split a select list on commas outside parentheses."""
    out, depth, cur = [], 0, ""
    for ch in exprs:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def _measured(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e).alias(m) for m, e in MEASURES.items()])


def counties(t: Tables) -> DataFrame:
    """County-year measures with the county's metro and region."""
    geo = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    geo = geo.select("s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("county_id"),
                     F.col("s_name").alias("county_name"),
                     (F.col("n_nationkey") + 10000).cast("string").alias("cbsa_id"),
                     F.col("n_name").alias("cbsa_name"), (F.col("r_regionkey") + 1).cast("string").alias("region_id"),
                     F.col("r_name").alias("region_name"))
    return _measured(lines(t), ["l_suppkey", "year"]).join(
        geo, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")


def tracts(t: Tables) -> DataFrame:
    """Tract-year measures with the tract's metro and region."""
    geo = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    geo = geo.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("tract_id"),
                     F.col("c_name").alias("tract_name"),
                     (F.col("n_nationkey") + 10000).cast("string").alias("cbsa_id"),
                     F.col("n_name").alias("cbsa_name"), (F.col("r_regionkey") + 1).cast("string").alias("region_id"),
                     F.col("r_name").alias("region_name"))
    own = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return _measured(lines(t).join(own, "l_orderkey"), ["o_custkey", "year"]).join(
        geo, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")


def panel(t: Tables, *levels: str) -> DataFrame:
    """Stacked (geo_level, geo_id, geo_name, year, measures) for the levels asked."""
    parts = []
    if "tract" in levels:
        parts.append(tracts(t).select(F.lit("tract").alias("geo_level"), F.col("tract_id").alias("geo_id"),
                                      F.col("tract_name").alias("geo_name"), "year", *MEASURES))
    above = {"county": ("county_id", "county_name"), "cbsa": ("cbsa_id", "cbsa_name"),
             "region": ("region_id", "region_name"), "us": (F.lit("us"), F.lit("United States"))}
    wanted = {lv: above[lv] for lv in levels if lv != "tract"}
    if wanted:
        parts.append(multi_level_rollup(counties(t), wanted, ["year"], [F.sum(m).alias(m) for m in MEASURES]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_rates(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c not in MEASURES]
    wide = df.select(*keep, *[F.expr(e).alias(c) for c, e in DERIVED.items()])
    return wide.withColumns({c: F.expr(e) for c, e in RATIOS.items()})


def mart(t: Tables, *levels: str) -> DataFrame:
    """Wide mart stand-in: keys plus levels and rates."""
    return with_rates(panel(t, *levels))


def county_cbsa(t: Tables) -> DataFrame:
    """County to metro and region crosswalk."""
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("county_geoid"),
        (F.col("n_nationkey") + 10000).cast("string").alias("cbsa_code"), F.col("n_name").alias("cbsa_name"),
        F.col("r_name").alias("census_region"))


def tract_cbsa(t: Tables) -> DataFrame:
    """Tract to metro and region crosswalk."""
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("tract_geoid"),
        (F.col("n_nationkey") + 10000).cast("string").alias("cbsa_code"), F.col("n_name").alias("cbsa_name"),
        F.col("r_name").alias("census_region"), "c_mktsegment")


def cbsa_region(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 10000).cast("string").alias("cbsa_code"), F.col("n_name").alias("cbsa_name"),
        F.col("r_name").alias("census_region"))


# ---- the same tables as SQL -----------------------------------------------

_M = ", ".join(f"{e} AS {m}" for m, e in MEASURES.items())
_SUM = ", ".join(f"sum({m}) AS {m}" for m in MEASURES)
_D = ", ".join(f"{e} AS {c}" for c, e in DERIVED.items())
_R = ", ".join(f"{e} AS {c}" for c, e in RATIOS.items())
_GEO = """CAST(n_nationkey + 10000 AS VARCHAR) AS cbsa_id, n_name AS cbsa_name,
    CAST(r_regionkey + 1 AS VARCHAR) AS region_id, r_name AS region_name"""

SQL_XWALKS = f"""county_cbsa AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS county_geoid,
    CAST(n_nationkey + 10000 AS VARCHAR) AS cbsa_code, n_name AS cbsa_name, r_name AS census_region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tract_cbsa AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS tract_geoid,
    CAST(n_nationkey + 10000 AS VARCHAR) AS cbsa_code, n_name AS cbsa_name, r_name AS census_region, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cbsa_region AS (SELECT CAST(n_nationkey + 10000 AS VARCHAR) AS cbsa_code, n_name AS cbsa_name,
    r_name AS census_region FROM nation JOIN region ON n_regionkey = r_regionkey)"""

SQL_COUNTIES = f"""county_m AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS county_id, s_name AS county_name, {_GEO}, m.*
  FROM (SELECT l_suppkey, year, {_M} FROM (SELECT l_suppkey, {LINE} FROM lineitem) GROUP BY l_suppkey, year) m
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
SQL_TRACTS = f"""tract_m AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS tract_id, c_name AS tract_name, {_GEO}, m.*
  FROM (SELECT o_custkey, year, {_M} FROM (SELECT o_custkey, {LINE} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        GROUP BY o_custkey, year) m
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
_BRANCH = {
    "tract": f"SELECT 'tract' AS geo_level, tract_id AS geo_id, tract_name AS geo_name, year, {', '.join(MEASURES)} FROM tract_m",
    "county": f"SELECT 'county' AS geo_level, county_id AS geo_id, county_name AS geo_name, year, {', '.join(MEASURES)} FROM county_m",
    "cbsa": f"SELECT 'cbsa', cbsa_id, max(cbsa_name), year, {_SUM} FROM county_m GROUP BY cbsa_id, year",
    "region": f"SELECT 'region', region_id, max(region_name), year, {_SUM} FROM county_m GROUP BY region_id, year",
    "us": f"SELECT 'us', 'us', 'United States', year, {_SUM} FROM county_m GROUP BY year",
}
_NAMED = "panel(geo_level, geo_id, geo_name, year, " + ", ".join(MEASURES) + ")"


def sql_mart(*levels: str, body: str, extra: str = "") -> str:
    """`WITH panel, mart, crosswalks[, extra] body` for the levels asked."""
    ctes = [SQL_XWALKS]
    if "tract" in levels:
        ctes.append(SQL_TRACTS)
    if set(levels) - {"tract"}:
        ctes.append(SQL_COUNTIES)
    ctes.append(_NAMED + " AS (" + " UNION ALL ".join(_BRANCH[lv] for lv in levels) + ")")
    ctes.append(f"mart0 AS (SELECT geo_level, geo_id, geo_name, year, {_D} FROM panel)")
    ctes.append(f"mart AS (SELECT *, {_R} FROM mart0)")
    if extra:
        ctes.append(extra.strip().rstrip(","))
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
