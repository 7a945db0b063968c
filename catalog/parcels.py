"""MT29-MT35, MT44-MT47: parcels, market overview, membership, commuting, reports."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.aggregates import flows
from catalog.registry import query
from catalog.scoring import _CF, metro_features
from terrapanel.plans import overview as O
from terrapanel.plans import parcels as P
from terrapanel.session import store

# ---- parcels: parts sold through suppliers play parcels in counties -------

_RAW = """raw AS (SELECT CASE WHEN l_partkey % 4 = 0 THEN ' fl' ELSE 'FL ' END AS state, 'Nation ' || s_nationkey || ' county' AS county_name, CAST(s_nationkey AS VARCHAR) AS county_code, 'co_' || s_nationkey AS county_tag, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS join_key, l_partkey, p_size AS use_code, l_extendedprice AS just_value, l_shipdate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
mk AS (SELECT CASE WHEN n_regionkey < 2 THEN 'north' ELSE 'south' END AS market_key, CAST(10000 + n_nationkey AS VARCHAR) AS cbsa_code, 'FL' AS state_abbr, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS county_geoid, 'NATION-' || n_nationkey AS county_name, 'nation' || n_nationkey AS key FROM nation WHERE n_nationkey % 6 <> 5),
lu AS (SELECT lpad(CAST(p_size AS VARCHAR), 3, '0') AS code, 'cat_' || (p_size % 4) AS category, p_size % 4 = 0 AS retail_flag, CASE WHEN p_size % 8 = 0 THEN 'store' END AS retail_subtype FROM (SELECT DISTINCT p_size FROM part WHERE p_size <= 40)),
pc AS (SELECT mk.market_key, mk.cbsa_code, mk.county_geoid, raw.county_tag, raw.county_code || '::' || join_key AS parcel_uid, join_key, lpad(CAST(use_code AS VARCHAR), 3, '0') AS land_use_code, just_value, CASE WHEN month(l_shipdate) + l_partkey % 3 <= 12 THEN make_date(year(l_shipdate), month(l_shipdate) + CAST(l_partkey % 3 AS INTEGER), 1) END AS last_sale_date, raw.county_code = '0' AS qa_zero_county, lu.category AS land_use_category, coalesce(lu.retail_flag, false) AS retail_flag, CASE WHEN lu.retail_flag AND lu.retail_subtype IS NULL THEN 'retail_uncategorized' ELSE lu.retail_subtype END AS retail_subtype, CASE WHEN lu.retail_flag THEN 'Retail parcel' ELSE 'Residential/other parcel' END AS parcel_segment, l_partkey
  FROM raw JOIN mk ON 'nation' || county_code = mk.key LEFT JOIN lu ON lu.code = lpad(CAST(use_code AS VARCHAR), 3, '0'))"""


def _raw(t):
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    nk = F.col("s_nationkey").cast("string")
    return j.select(
        F.when(F.col("l_partkey") % 4 == 0, " fl").otherwise("FL ").alias("state"), F.concat(F.lit("Nation "), nk, F.lit(" county")).alias("county_name"),
        nk.alias("county_code"), F.concat(F.lit("co_"), nk).alias("county_tag"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("join_key"), "l_partkey",
        F.col("p_size").alias("use_code"), F.col("l_extendedprice").alias("just_value"), F.year("l_shipdate").alias("sale_yr1"),
        (F.month("l_shipdate") + F.col("l_partkey") % 3).alias("sale_mo1"), F.lit("").alias("census_block_id"))


def _counties(t):
    return t.nation.filter("n_nationkey % 6 <> 5").select(
        F.when(F.col("n_regionkey") < 2, "north").otherwise("south").alias("market_key"), (F.col("n_nationkey") + 10000).cast("string").alias("cbsa_code"),
        F.lit("fl ").alias("state_abbr"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("county_geoid"),
        F.concat(F.lit("NATION-"), F.col("n_nationkey").cast("string")).alias("county_name"))


def _land_use(t):
    s = F.col("p_size")
    return t.part.filter("p_size <= 40").select("p_size").distinct().select(
        s.cast("string").alias("land_use_code"), F.concat(F.lit("cat_"), (s % 4).cast("string")).alias("category"), (s % 4 == 0).alias("retail_flag"),
        F.when(s % 8 == 0, "store").alias("retail_subtype"))


_PC_COLS = ["market_key", "cbsa_code", "county_geoid", "county_tag", "parcel_uid", "join_key", "land_use_code", "just_value", "last_sale_date", "qa_zero_county",
            "land_use_category", "retail_flag", "retail_subtype", "parcel_segment"]


def parcels(t):
    return P.parcels_canonical(_raw(t), _counties(t), _land_use(t))


@query("mt29_parcels_canonical", f"WITH {_RAW} SELECT {', '.join(_PC_COLS)} FROM pc", real="just_value")
def mt29(t):
    return parcels(t).select(*_PC_COLS)


_LOG = """lg AS (SELECT 'nation' || (event_id % 25) AS key, event_id AS ingest_run_id, event_type AS load_status, value / 500 AS unmatched_rate, ts AS load_completed_at FROM events WHERE event_id % 25 <> 3 QUALIFY row_number() OVER (PARTITION BY event_id % 25 ORDER BY ts DESC, event_id DESC) = 1),
cnt AS (SELECT market_key, county_geoid, count(*) AS parcel_rows, count(DISTINCT parcel_uid) AS distinct_parcels FROM pc GROUP BY ALL),
ln AS (SELECT mk.market_key, mk.county_geoid, lg.ingest_run_id, lg.load_status, lg.unmatched_rate, parcel_rows, distinct_parcels, CASE WHEN load_status IS NOT NULL THEN 'county load log' ELSE 'market counties only' END AS lineage_source FROM mk LEFT JOIN lg ON lg.key = mk.key LEFT JOIN cnt USING (market_key, county_geoid))"""


def _log(t):
    return t.events.filter("event_id % 25 <> 3").select(
        F.lit("FL").alias("state"), F.concat(F.lit("Nation "), (F.col("event_id") % 25).cast("string"), F.lit(" County")).alias("county_name"),
        F.col("event_id").alias("ingest_run_id"), F.col("event_type").alias("load_status"), (F.col("value") / 500).alias("unmatched_rate"),
        F.col("ts").alias("load_completed_at"), F.col("ts").alias("generated_at"))


@query("mt31_parcel_cleanup", """
WITH r AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN upper('p' || (l_orderkey % 5000)) END AS parcel_id, CASE WHEN l_orderkey % 21 <> 0 THEN upper('a' || l_partkey) END AS alt_key, l_extendedprice AS just_value, CAST(year(l_shipdate) AS BIGINT) AS sale_yr1, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS sale_qual_code, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey * 100 + l_suppkey % 100 AS line FROM lineitem),
k AS (SELECT *, coalesce(parcel_id, alt_key) AS join_key FROM r)
SELECT join_key, parcel_id, alt_key, just_value, sale_yr1, sale_qual_code FROM k QUALIFY join_key IS NULL OR row_number() OVER (PARTITION BY join_key ORDER BY line) = 1""", real="just_value")
def mt31c(t):
    o = F.col("l_orderkey")
    raw = t.lineitem.select(
        F.when(o % 7 != 0, F.concat(F.lit(" p"), (o % 5000).cast("string"))).alias("PARCELID"), F.when(o % 21 != 0, F.concat(F.lit("a"), F.col("l_partkey").cast("string"), F.lit(" "))).alias("altkey"),
        F.concat(F.lit("$"), F.col("l_extendedprice").cast("string")).alias("jv"), F.year("l_shipdate").alias("sale_year1"), F.col("l_linenumber").alias("qual_cd1"), ((o * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("line"))
    return P.parcel_cleanup(raw, "line").select("join_key", "parcel_id", "alt_key", "just_value", "sale_yr1", "sale_qual_code")


@query("mt30_parcel_lineage", f"WITH {_RAW}, {_LOG} SELECT * FROM ln", real="unmatched_rate")
def mt30(t):
    out = P.parcel_lineage(_counties(t), _log(t), parcels(t))
    return out.select("market_key", "county_geoid", "ingest_run_id", "load_status", "unmatched_rate", "parcel_rows", "distinct_parcels", "lineage_source")


@query("mt30_unmapped_use_codes", f"WITH {_RAW} SELECT land_use_code, count(*) AS parcel_count FROM pc WHERE land_use_code NOT IN (SELECT code FROM lu) GROUP BY land_use_code")
def mt30u(t):
    return P.unmapped_use_codes(parcels(t), _land_use(t))


_V = lambda name, sev, ds, metric, text, src: f"SELECT '{name}' AS check_name, '{sev}' AS severity, '{ds}' AS dataset, CAST({metric} AS DOUBLE) AS metric_value, {metric} = 0 AS pass, '{text}: ' || CAST({metric} AS BIGINT) AS details FROM {src}"


@query("mt30_parcel_validation", f"WITH {_RAW}, {_LOG} " + " UNION ALL ".join([
    _V("parcel_canonical_unique_parcel_uid", "error", "parcel.parcels_canonical", "(count(*) - count(DISTINCT parcel_uid))", "Duplicate parcel_uid rows", "pc"),
    _V("parcel_canonical_missing_join_key", "error", "parcel.parcels_canonical", "count(*) FILTER (join_key IS NULL)", "Rows with missing join_key", "pc"),
    _V("parcel_canonical_missing_county_geoid", "error", "parcel.parcels_canonical", "count(*) FILTER (county_geoid IS NULL)", "Rows with missing county_geoid", "pc"),
    _V("parcel_land_use_mapping_unmapped_codes", "error", "parcel.retail_parcels", "count(DISTINCT land_use_code) FILTER (land_use_code NOT IN (SELECT code FROM lu))", "Distinct unmapped land_use_code values", "pc"),
    _V("parcel_join_qa_missing_counties", "error", "parcel.parcel_lineage", "count(*) FILTER (load_status IS NULL)", "Counties without load lineage", "ln"),
    _V("parcel_join_qa_high_unmatched_rate_counties", "warning", "parcel.parcel_lineage", "count(*) FILTER (unmatched_rate > 0.02)", "Counties above the unmatched limit", "ln"),
    _V("parcel_lineage_zero_parcel_counties", "warning", "parcel.parcel_lineage", "count(*) FILTER (coalesce(distinct_parcels, 0) = 0)", "Counties without parcels", "ln")]), real="metric_value")
def mt30v(t):
    p = parcels(t)
    return P.parcel_validation(p, P.parcel_lineage(_counties(t), _log(t), p), _land_use(t))


@query("mt31_duplicate_profile", """
SELECT county_tag, copies, count(*) AS keys, sum(copies) AS rows FROM (SELECT 'co_' || s_nationkey AS county_tag, l_partkey, count(*) AS copies FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) GROUP BY ALL""", ints="rows")
def mt31(t):
    p = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("co_"), F.col("s_nationkey").cast("string")).alias("county_tag"), "l_partkey")
    return P.duplicate_profile(p, ["l_partkey"])


@query("mt31_geometry_join_qa", """
SELECT 'co_' || s_nationkey AS county_tag, count(*) AS total_rows, count(*) FILTER (l_partkey % 9 = 4) AS unmatched_rows, count(*) FILTER (l_partkey % 9 = 4) / count(*) AS unmatched_rate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""", real="unmatched_rate")
def mt31g(t):
    p = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("co_"), F.col("s_nationkey").cast("string")).alias("county_tag"), F.col("l_partkey").alias("join_key"))
    return P.geometry_join_qa(p, t.part.filter("p_partkey % 9 <> 4").select(F.col("p_partkey").alias("join_key")), "join_key")


# Retail parcels: parts shipped in line 1 orders, located in the tract of the ordering customer.
_RET = _RAW + """, asg AS (SELECT parcel_uid, lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS tract_geoid, (1 + l_partkey % 97) / 1024.0 AS parcel_area_sqmi FROM pc JOIN orders ON CAST(split_part(join_key, '-', 1) AS BIGINT) = o_orderkey WHERE retail_flag),
tl AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS tract_geoid, 1.0 + c_custkey % 13 AS tract_land_area_sqmi, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'zone_' || c_nationkey END AS zone_id FROM customer),
ri0 AS (SELECT tl.tract_geoid, coalesce(n, 0) AS retail_parcel_count, coalesce(a, 0) AS retail_area, tract_land_area_sqmi, coalesce(a, 0) / tract_land_area_sqmi AS retail_area_density FROM tl LEFT JOIN (SELECT tract_geoid, count(DISTINCT parcel_uid) AS n, sum(parcel_area_sqmi) AS a FROM asg GROUP BY tract_geoid) g ON g.tract_geoid = tl.tract_geoid),
ri AS (SELECT *, percent_rank() OVER (ORDER BY retail_parcel_count) AS pctl_tract_retail_parcel_count, percent_rank() OVER (ORDER BY retail_area_density) AS pctl_tract_retail_area_density, 0.5 * percent_rank() OVER (ORDER BY retail_parcel_count) + 0.5 * percent_rank() OVER (ORDER BY retail_area_density) AS local_retail_context_score FROM ri0),
zq AS (SELECT *, percent_rank() OVER (ORDER BY mean_tract_score) AS zone_quality_score FROM (SELECT 'zone_' || c_nationkey AS zone_id, avg(c_acctbal) AS mean_tract_score FROM customer WHERE c_custkey % 4 <> 3 GROUP BY 1)),
ov AS (SELECT zone_id, 'Zone ' || substr(zone_id, 6) AS zone_label, count(*) AS tracts, sum(retail_parcel_count) AS retail_parcel_count, sum(retail_area) AS retail_area, sum(ri.tract_land_area_sqmi) AS tract_land_area_sqmi, sum(retail_area) / sum(ri.tract_land_area_sqmi) AS retail_area_density, avg(local_retail_context_score) AS local_retail_context_score FROM tl JOIN ri USING (tract_geoid) WHERE zone_id IS NOT NULL GROUP BY zone_id)"""


def _retail(t, keep=lambda df: df):
    """(parcels, assignment, tracts, tract-zone map, zone quality); `keep` is `store` where the first two are read again."""
    p = keep(parcels(t).filter("retail_flag").select("parcel_uid", "join_key", "just_value", "last_sale_date", ((1 + F.col("l_partkey") % 97) / 1024.0).alias("parcel_area_sqmi")))
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.lpad(F.col("o_custkey").cast("string"), 11, "0").alias("tract_geoid"))
    asg = keep(p.withColumn("k", F.split_part("join_key", F.lit("-"), F.lit(1)).cast("bigint")).join(o, "k").select("parcel_uid", "tract_geoid", "parcel_area_sqmi"))
    k = F.col("c_custkey")
    tid = F.lpad(k.cast("string"), 11, "0").alias("tract_geoid")
    tracts = t.customer.select(tid, (1.0 + k % 13).alias("tract_land_area_sqmi"))
    zid = F.concat(F.lit("zone_"), F.col("c_nationkey").cast("string"))
    zones = t.customer.filter("c_custkey % 4 <> 3").select(tid, zid.alias("zone_id"), F.concat(F.lit("Zone "), F.col("c_nationkey").cast("string")).alias("zone_label"), "c_acctbal")
    quality = P.zone_quality(zones.groupBy("zone_id").agg(F.avg("c_acctbal").alias("mean_tract_score")))
    return p, asg, tracts, zones.drop("c_acctbal"), quality


@query("mt32_retail_intensity", f"WITH {_RET} SELECT * FROM ri", real="retail_area tract_land_area_sqmi retail_area_density pctl_tract_retail_parcel_count pctl_tract_retail_area_density local_retail_context_score")
def mt32(t):
    _, asg, tracts, _, _ = _retail(t)
    return P.retail_intensity(asg, tracts)


@query("mt33_zone_overlay", f"WITH {_RET} SELECT ov.*, mean_tract_score, zone_quality_score FROM ov LEFT JOIN zq USING (zone_id)",
       real="retail_area tract_land_area_sqmi retail_area_density local_retail_context_score mean_tract_score zone_quality_score", ints="retail_parcel_count")
def mt33(t):
    _, asg, tracts, zones, quality = _retail(t)
    return P.zone_overlay(zones, P.retail_intensity(asg, tracts), quality)


_SL = _RET + """, s0 AS (SELECT parcel_uid, asg.tract_geoid, tl.zone_id, parcel_area_sqmi, pc.just_value, local_retail_context_score, zone_quality_score, date_diff('day', last_sale_date, DATE '2002-01-01') AS sale_recency_days, CASE WHEN pc.just_value > 0 AND parcel_area_sqmi * 27878400.0 >= 1000 THEN pc.just_value / (parcel_area_sqmi * 27878400.0) END AS psf FROM asg JOIN tl ON tl.tract_geoid = asg.tract_geoid AND tl.zone_id IS NOT NULL JOIN (SELECT * FROM pc WHERE retail_flag) pc USING (parcel_uid) JOIN ri ON ri.tract_geoid = asg.tract_geoid JOIN zq ON zq.zone_id = tl.zone_id),
s1 AS (SELECT *, least(greatest(psf, quantile_cont(psf, 0.05) OVER ()), quantile_cont(psf, 0.95) OVER ()) AS w FROM s0),
s2 AS (SELECT *, CASE WHEN w IS NULL THEN 0.5 ELSE percent_rank() OVER (PARTITION BY w IS NULL ORDER BY w) END AS pw, percent_rank() OVER (ORDER BY parcel_area_sqmi) AS pa, CASE WHEN sale_recency_days IS NULL THEN 0.5 ELSE percent_rank() OVER (PARTITION BY sale_recency_days IS NULL ORDER BY -sale_recency_days) END AS ps FROM s1),
s3 AS (SELECT *, 0.4 * pa + 0.3 * (1 - pw) + 0.3 * ps AS pch FROM s2), s4 AS (SELECT *, 0.5 * zone_quality_score + 0.25 * local_retail_context_score + 0.25 * pch AS score FROM s3),
sl AS (SELECT parcel_uid, zone_id, tract_geoid, parcel_area_sqmi, just_value, psf AS assessed_value_psf, w AS assessed_value_psf_winsorized, sale_recency_days, pch AS parcel_characteristics_score, score AS shortlist_score, row_number() OVER (ORDER BY round(score, 9) DESC, zone_quality_score DESC, parcel_area_sqmi DESC, parcel_uid) AS shortlist_rank_system, row_number() OVER (PARTITION BY zone_id ORDER BY round(score, 9) DESC, parcel_area_sqmi DESC, parcel_uid) AS shortlist_rank_zone FROM s4)"""
_SL_REAL = "parcel_area_sqmi just_value assessed_value_psf assessed_value_psf_winsorized parcel_characteristics_score shortlist_score"


def shortlist(t):
    p, asg, tracts, zones, quality = _retail(t, store)
    own = p.select("parcel_uid", "just_value", "last_sale_date", "parcel_area_sqmi")
    return P.parcel_shortlist(asg, own, zones, P.retail_intensity(asg, tracts), quality, "2002-01-01")


@query("mt34_parcel_shortlist", f"WITH {_SL} SELECT * FROM sl", real=_SL_REAL, ints="sale_recency_days")
def mt34(t):
    return shortlist(t).select("parcel_uid", "zone_id", "tract_geoid", "parcel_area_sqmi", "just_value", "assessed_value_psf", "assessed_value_psf_winsorized",
                               "sale_recency_days", "parcel_characteristics_score", "shortlist_score", "shortlist_rank_system", "shortlist_rank_zone")


@query("mt44_shortlist_summary", f"WITH {_SL} SELECT count(*) AS n_shortlisted, count(DISTINCT zone_id) AS n_zones, median(shortlist_score) AS median_shortlist_score, quantile_cont(shortlist_score, 0.9) AS p90_shortlist_score, median(parcel_area_sqmi) AS median_parcel_area_sqmi, median(just_value) AS median_assessed_value FROM sl",
       real="median_shortlist_score p90_shortlist_score median_parcel_area_sqmi median_assessed_value")
def mt44(t):
    return P.shortlist_summary(shortlist(t))


@query("mt44_top_zones", f"WITH {_RET} SELECT zone_id, retail_parcel_count, zone_quality_score FROM ov LEFT JOIN zq USING (zone_id) ORDER BY round(zone_quality_score, 9) DESC, retail_parcel_count DESC, zone_id LIMIT 3", real="zone_quality_score", ints="retail_parcel_count")
def mt44z(t):
    _, asg, tracts, zones, quality = _retail(t)
    return P.top_zones(P.zone_overlay(zones, P.retail_intensity(asg, tracts), quality)).select("zone_id", "retail_parcel_count", "zone_quality_score")


# ---- market overview ------------------------------------------------------

_OV = _CF + ", ff AS (SELECT *, bps_units_per_1k_3yr_avg AS units_per_1k_3yr FROM f)"
TARGET, REGION, YEAR = "000000007", "ASIA", 2001


def _overview(t):
    return metro_features(t).withColumnRenamed("bps_units_per_1k_3yr_avg", "units_per_1k_3yr")


@query("mt35_kpi_row", S.sql_mart("county", extra=_OV, body=f"SELECT cbsa_code, year, pop_total AS population, pop_growth_5yr, units_per_1k_3yr, median_gross_rent AS median_rent FROM ff WHERE cbsa_code = '{TARGET}' AND year = {YEAR}"),
       real="population pop_growth_5yr units_per_1k_3yr median_rent", ints="year")
def mt35(t):
    return O.kpi_row(_overview(t), TARGET, YEAR, {"pop_total": "population", "pop_growth_5yr": "pop_growth_5yr", "units_per_1k_3yr": "units_per_1k_3yr", "median_gross_rent": "median_rent"})


@query("mt35_peer_table", S.sql_mart("county", extra=_OV + ", rk AS (SELECT *, row_number() OVER (PARTITION BY census_division, year, cbsa_type ORDER BY pop_growth_5yr DESC NULLS LAST, cbsa_code) AS region_pop_growth_5yr_rank FROM ff)", body=f"""
SELECT cbsa_code, cbsa_name, pop_growth_5yr, region_pop_growth_5yr_rank, median_gross_rent, cbsa_code = '{TARGET}' AS is_target_market FROM rk WHERE year = {YEAR} AND cbsa_code IN ('000000001', '000000007', '000000020', '000000033')"""), real="pop_growth_5yr median_gross_rent")
def mt35p(t):
    return O.peer_table(_overview(t), ["000000001", TARGET, "000000020", "000000033"], TARGET, YEAR, ["pop_growth_5yr", "region_pop_growth_5yr_rank", "median_gross_rent"])


_B = lambda where: "avg(pop_total) AS population, " + ", ".join(f"sum({c} * pop_total) FILTER ({c} IS NOT NULL) / sum(pop_total) FILTER ({c} IS NOT NULL) AS {c}" for c in O.BENCH) + f" FROM ff WHERE year = {YEAR}{where}"


@query("mt35_benchmark_table", S.sql_mart("county", extra=_OV + f", r AS (SELECT 'region' AS geo_level, '{REGION}' AS geo_name, {_B(chr(32) + 'AND census_division = ' + chr(39) + REGION + chr(39))}), u AS (SELECT 'us' AS geo_level, 'United States' AS geo_name, {_B('')}), t AS (SELECT 'metro' AS geo_level, cbsa_name AS geo_name, pop_total AS population, {', '.join(O.BENCH)} FROM ff WHERE year = {YEAR} AND cbsa_code = '{TARGET}')", body="""
SELECT t.*, t.population / r.population AS target_vs_region_pop, t.median_gross_rent / r.median_gross_rent AS target_vs_region_rent, t.population / u.population AS target_vs_us_pop, t.median_gross_rent / u.median_gross_rent AS target_vs_us_rent FROM t, r, u UNION ALL SELECT *, NULL, NULL, NULL, NULL FROM r UNION ALL SELECT *, NULL, NULL, NULL, NULL FROM u"""),
       real="population target_vs_region_pop target_vs_region_rent target_vs_us_pop target_vs_us_rent " + " ".join(O.BENCH))
def mt35b(t):
    return O.benchmark_table(_overview(t), TARGET, YEAR, "census_division", REGION)


@query("mt35_indexed_trend", S.sql_mart("county", extra=_OV + f", tr AS (SELECT 'target' AS geo, year, pop_total AS population FROM ff WHERE cbsa_code = '{TARGET}' UNION ALL SELECT 'region', year, sum(pop_total) FROM ff WHERE census_division = '{REGION}' GROUP BY year UNION ALL SELECT 'us', year, sum(pop_total) FROM ff GROUP BY year), b AS (SELECT max(y) AS y FROM (SELECT min(year) AS y FROM tr GROUP BY geo))",
       body="SELECT tr.*, 100 * population / max(CASE WHEN year = y THEN population END) OVER (PARTITION BY geo) AS pop_index FROM tr, b"), real="population pop_index", ints="year")
def mt35t(t):
    return O.indexed_trend(_overview(t), TARGET, "census_division", REGION)


@query("mt35_distributions", S.sql_mart("county", extra=_OV, body=f"SELECT cbsa_code, cbsa_name, cbsa_code = '{TARGET}' AS is_target_market, 'pop_growth_5yr' AS metric, pop_growth_5yr AS value FROM ff WHERE year = {YEAR} AND pop_growth_5yr IS NOT NULL UNION ALL SELECT cbsa_code, cbsa_name, cbsa_code = '{TARGET}', 'median_gross_rent', median_gross_rent FROM ff WHERE year = {YEAR}"), real="value")
def mt35d(t):
    return O.distributions(_overview(t), YEAR, ["pop_growth_5yr", "median_gross_rent"], TARGET)


@query("mt45_market_tract_universe", """
SELECT DISTINCT CASE WHEN n_regionkey = 1 THEN 'west' ELSE 'east' END AS market_key, CAST(10000 + n_nationkey AS VARCHAR) AS cbsa_code, n_nationkey AS county_geoid, c_custkey AS tract_geoid FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 2)""", ints="county_geoid")
def mt45(t):
    prof = t.nation.filter(F.col("n_regionkey").isin(1, 2)).select(F.when(F.col("n_regionkey") == 1, "west").otherwise("east").alias("market_key"), (F.col("n_nationkey") + 10000).cast("string").alias("cbsa_code"))
    x = t.nation.select((F.col("n_nationkey") + 10000).cast("string").alias("cbsa_code"), F.col("n_nationkey").alias("county_geoid"))
    tracts = t.customer.select(F.col("c_nationkey").alias("county_geoid"), F.col("c_custkey").alias("tract_geoid"))
    return O.tract_universe(O.market_membership(prof, x), tracts)


@query("mt45_land_use_mapping", """
SELECT p_size AS land_use_code, CASE WHEN p_size % 10 = 0 THEN p_size % 20 = 0 ELSE p_size % 4 = 0 END AS retail_flag, CASE WHEN p_size % 10 = 0 THEN 'reviewed' ELSE 'rule_' || (p_size % 4) END AS retail_subtype, CASE WHEN p_size % 10 = 0 THEN 'checked' END AS review_note, CASE WHEN p_size % 10 = 0 THEN 'manual_review' ELSE 'rule' END AS mapping_method FROM (SELECT DISTINCT p_size FROM part)""", ints="land_use_code")
def mt45l(t):
    s = F.col("p_size")
    codes = t.part.select("p_size").distinct()
    base = codes.select(s.alias("land_use_code"), (s % 4 == 0).alias("retail_flag"), F.concat(F.lit("rule_"), (s % 4).cast("string")).alias("retail_subtype"))
    review = codes.filter("p_size % 10 = 0").select(s.alias("land_use_code"), (s % 20 == 0).alias("retail_flag"), F.lit("reviewed").alias("retail_subtype"), F.lit("checked").alias("review_note"))
    return O.land_use_mapping(base, review)


_FL = "f AS (SELECT c_nationkey AS h, s_nationkey AS w, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), m AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2)"


@query("mt46_commute_summary", f"""WITH {_FL} SELECT CASE WHEN h IN (SELECT k FROM m) AND w IN (SELECT k FROM m) THEN 'Internal: live & work in CBSA' WHEN w IN (SELECT k FROM m) THEN 'Inflow: live outside, work in CBSA' ELSE 'Outflow: live in CBSA, work outside' END AS type, sum(n) AS commuters FROM f WHERE h IN (SELECT k FROM m) OR w IN (SELECT k FROM m) GROUP BY 1""", real="commuters")
def mt46(t):
    m = t.nation.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("k"))
    return O.commute_summary(flows(t), m, "origin_id", "dest_id", "amount", "k")


@query("mt46_commute_partners", f"""WITH {_FL} SELECT 'inflow' AS side, h AS geoid, sum(n) AS commuters FROM f WHERE w IN (SELECT k FROM m) AND h NOT IN (SELECT k FROM m) GROUP BY h UNION ALL SELECT 'outflow', w, sum(n) FROM f WHERE h IN (SELECT k FROM m) AND w NOT IN (SELECT k FROM m) GROUP BY w""", real="commuters", ints="geoid")
def mt46p(t):
    m, f = t.nation.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("k")), flows(t)
    one = lambda s: O.commute_partners(f, m, "origin_id", "dest_id", "amount", "k", s).select(F.lit(s).alias("side"), "geoid", "commuters")
    return one("inflow").unionByName(one("outflow"))


@query("mt47_range_report", S.sql_mart("county", extra=_CF, body="""
SELECT cbsa_type, year, count(*) AS rows, count(*) FILTER (pop_growth_3yr IS NULL) AS null_pop_growth_3yr, min(pop_growth_3yr) AS min_pop_growth_3yr, max(pop_growth_3yr) AS max_pop_growth_3yr, 0 AS null_median_gross_rent, min(median_gross_rent) AS min_median_gross_rent, max(median_gross_rent) AS max_median_gross_rent FROM f GROUP BY ALL"""),
       real="min_pop_growth_3yr max_pop_growth_3yr min_median_gross_rent max_median_gross_rent", ints="year null_median_gross_rent")
def mt47(t):
    return O.range_report(metro_features(t), ["cbsa_type", "year"], ["pop_growth_3yr", "median_gross_rent"])
