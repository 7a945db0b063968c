"""MT12-MT21, MT40, MT41: silver tables."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.aggregates import flows
from catalog.registry import query
from terrapanel.operators.reshape import longer
from terrapanel.plans import silver as P
from terrapanel.plans.themes import THEMES

K4 = "geo_level, geo_id, geo_name, year"


def _survey_columns(name):
    """Source columns a theme needs, each a fixed multiple of a stand-in measure."""
    th = THEMES[name]
    made = {*th.buckets, *th.less}
    src = []
    for cols in (*th.buckets.values(), *th.less.values(), *[(c, w) for c, w in th.weighted.items()]):
        src += [c for c in cols if c not in made and c not in src]
    return {c: f"age_{i % 7 + 1} * {(i % 3 + 1) / 4} + {i % 5}" for i, c in enumerate(src)}


def _theme_sql(name):
    th, src = THEMES[name], _survey_columns(name)
    import re
    q = lambda c: f'"{c}"'
    sums = [c for c in src if re.search(th.sums, c) and c not in th.weighted]
    aggs = [f"sum({q(c)}) AS {q(c)}" for c in sums] + [f"sum({q(c)} * {q(w)}) / sum({q(w)}) AS {q(c)}" for c, w in th.weighted.items()]
    cols = sums + list(th.weighted)
    rest = [c for c in src if c not in cols]
    assert not rest, (name, rest)
    sel = ", ".join(q(c) for c in cols)
    base = f"""survey AS (SELECT {K4}, {', '.join(f'{e} AS {q(c)}' for c, e in src.items())} FROM mart),
base AS (SELECT {K4}, {sel} FROM survey UNION ALL SELECT 'cbsa', cbsa_code, max(cbsa_name), year, {', '.join(aggs)} FROM survey JOIN county_cbsa ON geo_id = county_geoid WHERE geo_level = 'county' GROUP BY cbsa_code, year)"""
    first = {b: c for b, c in th.buckets.items() if all(n in src for n in c)}
    second = {b: c for b, c in th.buckets.items() if b not in first}
    steps = [("b1", "base", {b: " + ".join(q(n) for n in c) for b, c in first.items()}), ("b2", "b1", {b: " + ".join(q(n) for n in c) for b, c in second.items()}),
             ("b3", "b2", {b: (f"greatest({q(x)} - {q(y)}, 0)" if b in th.at_least_0 else f"{q(x)} - {q(y)}") for b, (x, y) in th.less.items()}),
             ("b4", "b3", {s: f"{q(n)} / nullif({q(d)}, 0)" for s, (n, d) in th.shares.items()})]
    ctes = [base] + [f"{n} AS (SELECT *{''.join(f', {e} AS {q(c)}' for c, e in d.items())} FROM {f})" for n, f, d in steps]
    names = [n for n in (*th.buckets, *th.less, *th.shares) if not n.startswith("__")]
    out = ", ".join(q(n) for n in names)
    if th.diversity:
        out += ", 1 - (" + " + ".join(f"{n} * {n}" for n in th.diversity) + ") AS diversity_index"
        names.append("diversity_index")
    return S.sql_mart("county", "region", extra=", ".join(ctes), body=f"SELECT {K4}, {out} FROM b4"), " ".join(names)


def _register(name):
    text, real = _theme_sql(name)

    @query(f"mt12_{name}_theme", text, real=real, ints="year")
    def run(t):
        m = S.mart(t, "county", "region")
        m = m.select(*S.KEYS, *[F.expr(e).alias(c) for c, e in _survey_columns(name).items()])
        base = P.theme_base([m.filter("geo_level = 'region'")], m.filter("geo_level = 'county'"), S.county_cbsa(t), THEMES[name])
        return P.theme_kpi(base, THEMES[name])


for _name in THEMES:
    _register(_name)


# ---- regional accounts ----------------------------------------------------

_CODES = [("CAINC1", 1, "pi_total"), ("CAINC1", 2, "population")]
_LONG_SQL = """stage AS (SELECT geo_id, geo_name, year AS period, 'pi_total' AS metric_key, income_total AS value FROM mart WHERE geo_level = 'county' UNION ALL SELECT geo_id, geo_name, year, 'population', pop_total FROM mart WHERE geo_level = 'county'),
tot AS (SELECT 'CAINC1' AS "table", 'county' AS geo_level, geo_id, geo_name, period, metric_key, value FROM stage UNION ALL SELECT 'CAINC1', 'cbsa', cbsa_code, max(cbsa_name), period, metric_key, sum(value) FROM stage JOIN county_cbsa ON geo_id = county_geoid GROUP BY cbsa_code, period, metric_key),
long AS (SELECT * FROM tot UNION ALL SELECT "table", geo_level, geo_id, geo_name, period, 'pi_per_capita', max(CASE WHEN metric_key = 'pi_total' THEN value END) / max(CASE WHEN metric_key = 'population' THEN value END) FROM tot GROUP BY ALL
  UNION ALL SELECT 'CAINC1', 'state', geo_id, geo_name, year, 'pi_total', income_total FROM mart WHERE geo_level = 'region')"""


def _accounts(t):
    m = S.mart(t, "county", "region")
    codes = t.spark.createDataFrame(_CODES, "table string, line_code int, metric_key string")
    per = F.col("year").alias("period")
    c = m.filter("geo_level = 'county'")
    # line codes stay data, as in a landed file: one row per place, period and line
    def lines(df, cols):
        stacked = longer(df.select("geo_id", "geo_name", per, *cols), ["geo_id", "geo_name", "period"], list(cols), "src")
        code = F.when(F.col("src") == "income_total", 1).when(F.col("src") == "pop_total", 2).otherwise(9)
        return stacked.select("geo_id", "geo_name", "period", F.when(F.col("src").isNotNull(), "CAINC1").alias("table"), code.alias("line_code"), "value")

    stage = lines(c, ["income_total", "pop_total", "hu_total"])
    state = lines(m.filter("geo_level = 'region'"), ["income_total"])
    return P.accounts_long(stage, state, codes, S.county_cbsa(t), ["pi_total", "population"], {"pi_per_capita": ("pi_total", "population")})


@query("mt13_accounts_long", S.sql_mart("county", "region", extra=_LONG_SQL, body="SELECT * FROM long"), real="value", ints="period", digits=4)
def mt13(t):
    return _accounts(t)


@query("mt13_accounts_wide", S.sql_mart("county", "region", extra=_LONG_SQL, body="""
SELECT geo_level, geo_id, geo_name, period, "table", max(CASE WHEN metric_key = 'pi_total' THEN value END) AS pi_total, max(CASE WHEN metric_key = 'population' THEN value END) AS population, max(CASE WHEN metric_key = 'pi_per_capita' THEN value END) AS pi_per_capita FROM long GROUP BY ALL"""),
       real="pi_total population pi_per_capita", ints="period", digits=4)
def mt13w(t):
    return P.accounts_wide(_accounts(t), ["pi_total", "population", "pi_per_capita"])


_TBL = "CASE p_size % 3 WHEN 0 THEN 'CAINC1' WHEN 1 THEN 'CAGDP9' ELSE 'SAEXP' END"


@query("mt14_metric_dictionary", f"""
WITH l AS (SELECT {_TBL} AS "table", p_size AS line_code, p_name || ' ' || p_type AS d, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN '31-33' ELSE '22' END END AS n FROM part),
k AS (SELECT "table", line_code, d, n, CASE WHEN n IS NULL THEN d ELSE d || ' (' || n || ')' END AS full_d FROM l QUALIFY row_number() OVER (PARTITION BY "table", line_code ORDER BY n IS NULL, CASE WHEN n IS NULL THEN d ELSE d || ' (' || n || ')' END) = 1)
SELECT "table", line_code, d AS line_desc_clean, CASE WHEN "table" = 'CAINC1' AND line_code = 3 THEN 'pi_per_capita' WHEN "table" = 'CAGDP9' AND line_code = 1 THEN 'real_gdp_total' WHEN "table" = 'CAGDP9' AND line_code = 10 THEN 'real_gdp_utilities' WHEN "table" = 'CAGDP9' AND line_code = 13 THEN 'real_gdp_durable_manufacturing'
  WHEN "table" = 'CAGDP9' AND line_code = 25 THEN 'real_gdp_nondurable_manufacturing' WHEN "table" = 'CAGDP9' AND line_code = 34 THEN 'real_gdp_wholesale_trade' ELSE trim(regexp_replace(lower(full_d), '[^a-z0-9]+', '_', 'g'), '_') END AS metric_key,
  full_d AS metric_label, "table" IN ('CAINC1', 'CAGDP9') AND line_code IN (1, 2, 3) AS include_in_wide, n AS naics_raw, coalesce(n LIKE '%-%', false) AS is_aggregate, CASE "table" WHEN 'CAINC1' THEN 'income' WHEN 'CAGDP9' THEN 'gdp' ELSE 'other' END AS topic, '2024-01-01' AS vintage FROM k""", ints="line_code")
def mt14(t):
    n = F.when(F.col("p_partkey") % 2 == 0, F.when(F.col("p_partkey") % 3 == 0, "31-33").otherwise("22"))
    lines = t.part.select(F.expr(_TBL).alias("table"), F.col("p_size").alias("line_code"),
                          F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("("), n, F.lit(")"))).alias("line_desc"))
    return P.metric_dictionary(lines, "2024-01-01")


# ---- labour, permits, rents -----------------------------------------------


def _county_geo(t):
    return S.county_cbsa(t).select(F.col("county_geoid").alias("geo_id"), "cbsa_code", "cbsa_name", F.substring("census_region", 1, 2).alias("state_fips"),
                                   F.col("census_region").alias("state_abbr"), F.substring("census_region", 1, 2).alias("region_code"), F.col("census_region").alias("region_name"))


def _up(cols, third, k="0"):
    """Counties plus metro and region sums, as SQL."""
    s = ", ".join(f"sum({c}) AS {c}" for c in cols)
    return f"""SELECT 'county' AS geo_level, geo_id, geo_name, period, {', '.join(cols)} FROM c UNION ALL SELECT 'cbsa', cbsa_code, max(cbsa_name), period, {s} FROM c GROUP BY cbsa_code, period
UNION ALL SELECT '{third}', substr(census_region, 1, 2), max(census_region), period, {s} FROM c GROUP BY substr(census_region, 1, 2), period"""


@query("mt15_labor_force_rollup", S.sql_mart("county", extra=f"""c AS (SELECT geo_id, geo_name, year AS period, cbsa_code, cbsa_name, census_region, hu_total * 2 + 4 AS labor_force, hu_total * 2 + 1 AS employed, 3.0 AS unemployed FROM mart JOIN county_cbsa ON geo_id = county_geoid), u AS ({_up(['labor_force', 'employed', 'unemployed'], 'state')})""",
       body="SELECT *, unemployed / labor_force * 100 AS unemployment_rate_percent FROM u"), real="labor_force employed unemployed unemployment_rate_percent", ints="period")
def mt15(t):
    c = S.mart(t, "county").select("geo_id", "geo_name", F.col("year").alias("period"), (F.col("hu_total") * 2 + 4).alias("labor_force"),
                                   (F.col("hu_total") * 2 + 1).alias("employed"), F.lit(3.0).alias("unemployed"))
    return P.labor_force_rollup(c, _county_geo(t).select("geo_id", "cbsa_code", "cbsa_name", "state_fips", "state_abbr"))


_PC = [f"total_{m}" for m in ("bldgs", "units", "value")] + [f"{m}_{s}" for m in ("bldgs", "units", "value") for s in P.PERMIT_SIZES]
_PERMIT = {**{f"{m}_{s}": f"age_{(3 * i + j) % 7 + 1} * {k}" for i, (m, k) in enumerate((("bldgs", 1), ("units", 2), ("value", 50))) for j, s in enumerate(P.PERMIT_SIZES)}}
_PERMIT |= {f"total_{m}": " + ".join(f"({_PERMIT[f'{m}_{s}']})" for s in P.PERMIT_SIZES) for m in ("bldgs", "units", "value")}


@query("mt16_permits", S.sql_mart("county", extra=f"c AS (SELECT geo_id, geo_name, year AS period, cbsa_code, cbsa_name, census_region, {', '.join(f'{_PERMIT[c]} AS {c}' for c in _PC)} FROM mart JOIN county_cbsa ON geo_id = county_geoid), u AS ({_up(_PC, 'region')}), "
       + "v AS (SELECT *, " + ", ".join(f"{m}_2_units + {m}_3_4_units + {m}_5_units AS {m}_multifam" for m in ("units", "bldgs", "value")) + " FROM u), w AS (SELECT *, CASE WHEN total_bldgs > 0 THEN total_units / total_bldgs END AS avg_units_per_bldg, CASE WHEN bldgs_multifam > 0 THEN units_multifam / bldgs_multifam END AS avg_units_per_mf_bldg, CASE WHEN total_units > 0 THEN units_multifam / total_units END AS share_multifam_units, CASE WHEN total_units > 0 THEN units_5_units / total_units END AS share_units_5_plus, CASE WHEN total_units > 0 THEN units_1_unit / total_units END AS share_units_1_unit FROM v)",
       body="SELECT *, CASE WHEN share_units_5_plus >= 0.5 THEN 'mostly_large_multifam' WHEN share_multifam_units >= 0.5 THEN 'mostly_multifam' ELSE 'mostly_single_family' END AS structure_mix FROM w"),
       real=" ".join(_PC) + " units_multifam bldgs_multifam value_multifam avg_units_per_bldg avg_units_per_mf_bldg share_multifam_units share_units_5_plus share_units_1_unit", ints="period")
def mt16(t):
    c = S.mart(t, "county").select("geo_id", "geo_name", F.col("year").alias("period"), *[F.expr(_PERMIT[n]).alias(n) for n in _PC])
    return P.permits(c, _county_geo(t).select("geo_id", "cbsa_code", "cbsa_name", "region_code", "region_name"))


@query("mt17_fair_rents", S.sql_mart("county", "tract", extra="c AS (SELECT geo_id, geo_name, year AS period, cbsa_code, cbsa_name, census_region, median_gross_rent AS fmr_1br, median_gross_rent * 1.5 AS fmr_2br, pop_total AS w FROM mart JOIN county_cbsa ON geo_id = county_geoid WHERE geo_level = 'county')", body="""
SELECT 'county' AS geo_level, geo_id, geo_name, period, fmr_1br, fmr_2br FROM c UNION ALL SELECT 'cbsa', cbsa_code, max(cbsa_name), period, sum(fmr_1br * w) / sum(w), sum(fmr_2br * w) / sum(w) FROM c GROUP BY cbsa_code, period
UNION ALL SELECT 'state', substr(census_region, 1, 2), max(census_region), period, sum(fmr_1br * w) / sum(w), sum(fmr_2br * w) / sum(w) FROM c GROUP BY substr(census_region, 1, 2), period
UNION ALL SELECT 'zip code', geo_id, geo_id, year, median_gross_rent, median_gross_rent * 1.5 FROM mart WHERE geo_level = 'tract'"""), real="fmr_1br fmr_2br", ints="period")
def mt17(t):
    m = S.mart(t, "county", "tract").select("geo_level", "geo_id", "geo_name", F.col("year").alias("period"), F.col("median_gross_rent").alias("fmr_1br"),
                                            (F.col("median_gross_rent") * 1.5).alias("fmr_2br"), F.col("pop_total").alias("pop_weight"))
    return P.fair_rents(m.filter("geo_level = 'county'").drop("geo_level"), m.filter("geo_level = 'tract'").drop("geo_level"),
                        _county_geo(t).select("geo_id", "cbsa_code", "cbsa_name", "state_fips", "state_abbr"), ["fmr_1br", "fmr_2br"])


@query("mt18_burden_long", S.sql_mart("county", body="""
SELECT geo_id, year, v.variable, CASE v.variable WHEN 'T1_est1' THEN race_a WHEN 'T1_est2' THEN race_n ELSE race_r END AS estimate, m.tenure, m.cost_burden, 'County' AS geo_level, '2018-2022' AS chas_period
FROM mart, (VALUES ('T1_est1'), ('T1_est2'), ('T1_est3')) v(variable) LEFT JOIN (VALUES ('T1_est1', 'Owner', 'All'), ('T1_est2', 'Renter', '30-50%')) m(variable, tenure, cost_burden) ON m.variable = v.variable"""), real="estimate", ints="year")
def mt18(t):
    wide = S.mart(t, "county").select("geo_id", "year", F.col("race_a").alias("T1_est1"), F.col("race_n").alias("T1_est2"), F.col("race_r").alias("T1_est3"))
    meta = t.spark.createDataFrame([("T1_est1", "Owner", "All"), ("T1_est2", "Renter", "30-50%")], "variable string, tenure string, cost_burden string")
    return P.burden_long(wide, ["geo_id", "year"], ["T1_est1", "T1_est2", "T1_est3"], meta, geo_level="County", chas_period="2018-2022")


@query("mt19_index_long", """
SELECT s_nationkey AS state, d AS date, year(d) AS year, month(d) AS month, v AS zhvi FROM (SELECT s_nationkey, unnest([DATE '2011-01-31', DATE '2012-02-29']) AS d, unnest([max(s_acctbal), min(s_acctbal)]) AS v FROM supplier GROUP BY s_nationkey)""", real="zhvi", ints="state year month")
def mt19(t):
    wide = t.supplier.groupBy(F.col("s_nationkey").alias("state")).agg(
        F.sum("s_acctbal").alias("x2010_12_31"), F.max("s_acctbal").alias("x2011_01_31"), F.min("s_acctbal").alias("x2012_02_29"))
    return P.index_long(wide, ["state"], after=2010).select("state", "date", "year", "month", "zhvi")


# ---- flows and crosswalks -------------------------------------------------

_FLOW_SQL = """WITH f AS (SELECT c_nationkey AS o, s_nationkey AS d, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _raw_flows(t):
    return flows(t).select(F.lit(2001).alias("year"), (F.col("dest_id") + 1).alias("y1_statefips"), F.when(F.col("dest_id") != 7, F.col("dest_id") * 30).alias("y1_countyfips"),
                           (F.col("origin_id") + 1).alias("y2_statefips"), (F.col("origin_id") * 30).alias("y2_countyfips"),
                           F.when(F.col("n_rows") % 4 == 0, -1).otherwise(F.col("n_rows")).alias("n1"), F.col("amount").alias("n2"), F.col("n_rows").alias("agi"))


@query("mt20_county_flows", _FLOW_SQL + """, g AS (SELECT lpad(CAST(o + 1 AS VARCHAR), 2, '0') || lpad(CAST(o * 30 AS VARCHAR), 3, '0') AS origin_geoid, lpad(CAST(d + 1 AS VARCHAR), 2, '0') || lpad(CAST(d * 30 AS VARCHAR), 3, '0') AS dest_geoid, n, q, o, d FROM f WHERE d <> 7 AND o > 0 AND d > 0)
SELECT '2001_' || origin_geoid || '_' || dest_geoid AS flow_id, 2001 AS year, origin_geoid, dest_geoid, CASE WHEN n % 4 <> 0 THEN n END AS n_returns, q AS n_exemptions, n AS agi_thousands, n * 1000 AS agi, a.n_name AS origin_name, b.n_name AS dest_name, 'County' AS geo_level
FROM g JOIN nation a ON a.n_nationkey = o JOIN nation b ON b.n_nationkey = d WHERE origin_geoid <> dest_geoid""", real="n_returns n_exemptions agi_thousands agi", ints="year")
def mt20(t):
    names = t.nation.select(F.concat(F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.lpad((F.col("n_nationkey") * 30).cast("string"), 3, "0")).alias("geo_id"),
                            F.col("n_name").alias("geo_name"))
    return P.named_flows(P.county_flows(_raw_flows(t)), names, "County")


@query("mt20_flow_summary_types", """
SELECT CASE p_size % 6 WHEN 0 THEN 'us_and_foreign_total' WHEN 1 THEN 'us_total' WHEN 2 THEN 'same_state_total' WHEN 3 THEN 'different_state_total' WHEN 4 THEN 'foreign_total' ELSE 'other_summary' END AS summary_type, count(*) AS n, sum(p_partkey) AS total FROM part GROUP BY 1""", ints="total")
def mt20s(t):
    k = F.col("p_size") % 6
    label = F.concat(F.lit("County Total Migration-"), F.when(k == 0, "US and Foreign").when(k == 1, "US").when(k == 2, "Same State").when(k == 3, "Different State").when(k == 4, "Foreign").otherwise("x"))
    return t.part.withColumn("y1_countyname", label).groupBy(P.flow_summary_type().alias("summary_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("total"))


@query("mt21_county_crosswalk", """
SELECT DISTINCT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 900 AS VARCHAR), 3, '0') AS county_geoid, s_name AS county_name, CAST(10000 + s_nationkey AS VARCHAR) AS cbsa_code, n_name AS cbsa_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Micro Area' ELSE 'Metro Area' END AS cbsa_type, CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS county_flag FROM supplier JOIN nation ON s_nationkey = n_nationkey""", ints="county_flag")
def mt21(t):
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_nationkey").alias("state_fips"), (F.col("s_suppkey") % 900).alias("county_fips"), F.col("s_name").alias("county_name"),
        (F.col("s_nationkey") + 10000).cast("string").alias("cbsa_code"), F.col("n_name").alias("cbsa_name"),
        F.when(F.col("s_suppkey") % 3 == 0, "Micropolitan Statistical Area").otherwise("Metropolitan Statistical Area").alias("cbsa_type"),
        F.when(F.col("s_acctbal") > 0, "Central").otherwise("Outlying").alias("central_outlying"))
    return P.county_crosswalk(d)


@query("mt21_zip_crosswalk", """
WITH p AS (SELECT l_partkey AS zip_geoid, l_suppkey AS supp_id, CAST(sum(CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS DOUBLE) AS pop, CAST(count(*) AS DOUBLE) AS bus, CAST(sum(l_linenumber) AS DOUBLE) AS hu FROM lineitem GROUP BY ALL)
SELECT zip_geoid, supp_id, CASE WHEN sum(pop) OVER w > 0 THEN pop / sum(pop) OVER w ELSE 1.0 / count(*) OVER w END AS rel_weight_pop, bus / sum(bus) OVER w AS rel_weight_bus, hu / sum(hu) OVER w AS rel_weight_hu FROM p WINDOW w AS (PARTITION BY zip_geoid)""", real="rel_weight_pop rel_weight_bus rel_weight_hu")
def mt21z(t):
    p = t.lineitem.groupBy(F.col("l_partkey").alias("zip_geoid"), F.col("l_suppkey").alias("supp_id")).agg(
        F.sum(F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(F.col("l_quantity").cast("bigint"))).cast("double").alias("pop"),
        F.count(F.lit(1)).cast("double").alias("bus"), F.sum("l_linenumber").cast("double").alias("hu"))
    return P.zip_crosswalk(p, "supp_id")


_Z = "lpad(CAST({} AS VARCHAR), {}, '0')"


@query("mt20_state_flows", _FLOW_SQL + f"""
SELECT 'State' AS geo_level, '2001_' || {_Z.format('o + 1', 2)} || '_' || {_Z.format('d + 1', 2)} AS flow_id, 2001 AS year, {_Z.format('o + 1', 2)} AS origin_geo_id, {_Z.format('d + 1', 2)} AS dest_geo_id, CASE WHEN n % 4 <> 0 THEN n END AS n_returns, q AS n_people, n AS agi_thousands, n * 1000 AS agi, a.n_name AS origin_state_abbr, b.n_name AS dest_state_abbr
FROM f LEFT JOIN nation a ON a.n_nationkey = o AND o % 5 <> 0 LEFT JOIN nation b ON b.n_nationkey = d AND d % 5 <> 0 WHERE o <> d""", real="n_returns n_people agi_thousands agi", ints="year")
def mt20st(t):
    states = t.nation.filter("n_nationkey % 5 <> 0").select(F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0").alias("state_fip"), F.col("n_name").alias("state_abbr"))
    return P.state_flows(_raw_flows(t), states)


def _pair(table, key, target, width, digits):
    """SQL of a ZIP crosswalk with published weights."""
    return (f"SELECT {_Z.format('l_partkey', 5)} AS zip_geoid, {_Z.format(target, width)} AS {key}, CAST(round(avg(l_discount), 4) AS DOUBLE) AS rel_weight_pop, CAST(round(avg(l_tax), 4) AS DOUBLE) AS rel_weight_bus, count(*) AS rel_weight_hu, 2025 AS vintage, '{table}' AS source "
            f"FROM lineitem GROUP BY l_partkey, {target}")


def _zip_pairs(t, target):
    return t.lineitem.groupBy(F.col("l_partkey").alias("ZIP"), F.expr(target).alias("AREA")).agg(
        F.round(F.avg("l_discount"), 4).alias("RES_RATIO"), F.round(F.avg("l_tax"), 4).alias("BUS_RATIO"), F.count(F.lit(1)).alias("TOT_RATIO"))


def _zip_query(name, key, width, sql_target, target):
    @query(name, _pair(name, key, sql_target, width, 4), real="rel_weight_pop rel_weight_bus rel_weight_hu", ints="vintage", digits=3)
    def run(t):
        cols = {"zip_geoid": "ZIP", key: "AREA", "rel_weight_pop": "RES_RATIO", "rel_weight_bus": "BUS_RATIO", "rel_weight_hu": "TOT_RATIO"}
        out = P.code_crosswalk(_zip_pairs(t, target), cols, {"zip_geoid": 5, key: width}, ["zip_geoid"], vintage=2025, source=name)
        return out.withColumn("rel_weight_hu", F.col("rel_weight_hu").cast("double"))


_zip_query("mt21_zcta_county", "county_geoid", 5, "l_suppkey", "l_suppkey")
_zip_query("mt21_zcta_cbsa", "cbsa_geoid", 5, "l_suppkey % 50", "l_suppkey % 50")
_zip_query("mt21_zcta_tract", "tract_geoid", 11, "l_orderkey % 400", "l_orderkey % 400")


@query("mt21_cbsa_primary_city", f"""
SELECT {_Z.format('c_nationkey', 5)} AS cbsa_code, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS cbsa_name, c_mktsegment AS cbsa_type, 'city ' || c_custkey AS primary_city, {_Z.format('c_nationkey', 2)} AS state_fips, {_Z.format('c_custkey', 5)} AS place_fips, 2023 AS vintage, 'delineation' AS source FROM customer WHERE c_custkey % 9 <> 0""", ints="vintage")
def mt21p(t):
    raw = t.customer.withColumns({"title": F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")), "city": F.concat(F.lit("city "), F.col("c_custkey").cast("string"))})
    cols = {"cbsa_code": "c_nationkey", "cbsa_name": "title", "cbsa_type": "c_mktsegment", "primary_city": "city", "state_fips": "c_nationkey", "place_fips": "c_custkey"}
    return P.code_crosswalk(raw, cols, {"cbsa_code": 5, "state_fips": 2, "place_fips": 5}, ["cbsa_name"], vintage=2023, source="delineation")


@query("mt21_tract_county", f"""
SELECT {_Z.format('n_regionkey', 2)} AS state_fip, {_Z.format('c_nationkey', 3)} AS county_fip, {_Z.format('c_custkey', 6)} AS tract_fip, {_Z.format('c_custkey', 11)} AS tract_geoid, c_name AS tract_name, n_name AS county_name, 2023 AS vintage, 'boundaries' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey""", ints="vintage")
def mt21t(t):
    raw = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    cols = {"state_fip": "n_regionkey", "county_fip": "c_nationkey", "tract_fip": "c_custkey", "tract_geoid": "c_custkey", "tract_name": "c_name", "county_name": "n_name"}
    return P.code_crosswalk(raw, cols, {"state_fip": 2, "county_fip": 3, "tract_fip": 6, "tract_geoid": 11}, vintage=2023, source="boundaries")


@query("mt21_county_state", f"""
SELECT {_Z.format('s_nationkey', 2)} AS state_fip, {_Z.format('s_suppkey', 3)} AS county_fip, s_name AS county_name, n_name AS state_abbr, 2023 AS vintage, 'boundaries' AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey""", ints="vintage")
def mt21s(t):
    raw = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return P.code_crosswalk(raw, {"state_fip": "s_nationkey", "county_fip": "s_suppkey", "county_name": "s_name", "state_abbr": "n_name"}, {"state_fip": 2, "county_fip": 3}, vintage=2023, source="boundaries")


@query("mt21_cbsa_state", """
SELECT CAST(c_custkey % 40 AS VARCHAR) AS cbsa_code, 'metro ' || (c_custkey % 40) AS cbsa_name, CAST(c_nationkey AS VARCHAR) AS state_fips, n_name AS state_name, count(*) AS counties, 'derived' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def mt21cs(t):
    k = (F.col("c_custkey") % 40).cast("string")
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("cbsa_code"), F.concat(F.lit("metro "), k).alias("cbsa_name"), F.col("c_nationkey").cast("string").alias("state_fips"), F.col("n_name").alias("state_name"))
    return P.cbsa_state_crosswalk(x, source="derived")


@query("mt21_state_region", """
SELECT n_nationkey AS state_fips, n_name AS state_name, r_name AS census_region, 'division ' || (n_regionkey % 3) AS census_division, 'dimension' AS source FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""", ints="state_fips")
def mt21r(t):
    regions = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("state_fips"), F.col("r_name").alias("census_region"), F.concat(F.lit("division "), (F.col("n_regionkey") % 3).cast("string")).alias("census_division"))
    return P.state_region_crosswalk(t.nation.select(F.col("n_nationkey").alias("state_fips"), F.col("n_name").alias("state_name")), regions.unionByName(regions), source="dimension")


@query("mt40_table_catalog", S.sql_mart("county", "cbsa", "region", body="""
SELECT 'place_mart' AS table_name, 'demographics' AS topic, count(*) AS row_count, 5 AS col_count, 0 AS rows_no_year, min(year) AS min_year, max(year) AS max_year, 'cbsa, county, region' AS geo_levels FROM mart
UNION ALL SELECT 'region_mart', 'other', count(*), 6, 0, min(year), max(year), 'region' FROM mart WHERE geo_level = 'region'"""), ints="col_count rows_no_year min_year max_year")
def mt40(t):
    m = S.mart(t, "county", "cbsa", "region").select(*S.KEYS, "pop_total", "hu_total")
    return P.table_catalog({"place_mart": m.drop("hu_total"), "region_mart": m.filter("geo_level = 'region'")}, {"place_mart": "demographics"})


@query("mt40_variable_catalog", """
SELECT table_name, 'other' AS topic, c.column_name, ordinal_position, lower(CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END) AS data_type, false AS is_key, c.column_name NOT LIKE '%name' AS is_measure,
  n AS row_count, n - k AS null_count FROM information_schema.columns AS c JOIN (UNPIVOT (SELECT 'orders' AS t, count(*) AS n, count(COLUMNS(*)) FROM orders) ON COLUMNS(* EXCLUDE (t, n)) INTO NAME column_name VALUE k
  UNION ALL UNPIVOT (SELECT 'nation' AS t, count(*) AS n, count(COLUMNS(*)) FROM nation) ON COLUMNS(* EXCLUDE (t, n)) INTO NAME column_name VALUE k) AS v
  ON t = table_name AND v.column_name = c.column_name""", ints="ordinal_position")
def mt40v(t):
    return P.variable_catalog({"orders": t.orders, "nation": t.nation}, {})


@query("mt41_age_band_table", S.sql_mart("county", extra="c AS (SELECT cbsa_code, cbsa_name, year, sum(pop_total) FILTER (hu_total % 2 = 0) AS p, sum(age_1 + age_2) AS b1, sum(age_3 + age_4 + age_5) AS b2, sum(age_6 + age_7) AS b3 FROM mart JOIN county_cbsa ON geo_id = county_geoid GROUP BY ALL), d AS (SELECT *, CASE WHEN p > 0 THEN p ELSE b1 + b2 + b3 END AS denom FROM c)", body="""
SELECT cbsa_code, cbsa_name, year, coalesce(p, 0) AS pop_total, b1 AS band_0_24, b2 AS band_25_64, b3 AS band_65_plus, b1 + b2 + b3 AS total_banded, denom, b1 * 100 / denom AS pct_0_24, b2 * 100 / denom AS pct_25_64, b3 * 100 / denom AS pct_65_plus FROM d"""),
       real="pop_total band_0_24 band_25_64 band_65_plus total_banded denom pct_0_24 pct_25_64 pct_65_plus", ints="year")
def mt41(t):
    m = S.mart(t, "county").withColumn("pop_total", F.when(F.col("hu_total") % 2 == 0, F.col("pop_total")))
    return P.age_band_table(m, S.county_cbsa(t), {"0_24": ["age_1", "age_2"], "25_64": ["age_3", "age_4", "age_5"], "65_plus": ["age_6", "age_7"]})
