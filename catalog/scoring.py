"""MT22-MT28, MT37, MT39, MT42: features, models, seeds, zones, screens."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.graphs import CC, REACH
from catalog.joins import square
from catalog.marts import _DIST_SQL, _SCORED_SQL, GROWTH, district_table
from catalog.registry import query
from terrapanel.operators.series import growth
from terrapanel.plans import marts as M
from terrapanel.plans import scoring as P
from terrapanel.plans import zones as Z
from terrapanel.session import store

G = lambda c, h: GROWTH(c, h).replace("geo_level, geo_id", "geo_id")

# ---- metro features: suppliers play the metros ---------------------------

_CF_METRICS = list(P.CBSA_METRICS)
_CF = f"""f0 AS (SELECT m.geo_id AS cbsa_code, m.geo_name AS cbsa_name, CASE WHEN CAST(m.geo_id AS BIGINT) % 3 = 0 THEN 'Micro Area' ELSE 'Metro Area' END AS cbsa_type, x.census_region AS census_division, m.year, pop_total, {G('pop_total', 3)} AS pop_growth_3yr, {G('pop_total', 5)} AS pop_growth_5yr, median_gross_rent, median_home_value, pct_commute_wfh, mean_travel_time, permits AS bps_total_units,
  avg(permits) OVER (PARTITION BY m.geo_id ORDER BY m.year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bps_units_3yr_avg FROM mart m JOIN county_cbsa x ON m.geo_id = x.county_geoid),
f AS (SELECT *, mean_travel_time * (1 - pct_commute_wfh) AS commute_intensity_b, bps_total_units * 1000 / pop_total AS bps_units_per_1k, bps_units_3yr_avg * 1000 / pop_total AS bps_units_per_1k_3yr_avg FROM f0)"""


# nations play metros that no panel row describes
_CF_ALL = _CF.replace("FROM f0)", "FROM f1)").replace("f AS (SELECT *,", "f1 AS (SELECT * FROM f0 UNION ALL BY NAME SELECT 'N' || n_nationkey AS cbsa_code, n_name AS cbsa_name, 'Metro Area' AS cbsa_type, 'ASIA' AS census_division FROM nation),\nf AS (SELECT *,")


def metro_features(t, more_metros=False):
    m = growth(S.mart(t, "county"), ["geo_level", "geo_id"], "year", "pop_total", (3, 5), prefix="pop", cagr=())
    meta = S.county_cbsa(t).join(t.supplier, F.col("county_geoid") == F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).select(
        F.col("county_geoid").alias("cbsa_code"), F.col("s_name").alias("cbsa_name"), F.col("census_region").alias("census_division"),
        F.when(F.col("s_suppkey") % 3 == 0, "Micro Area").otherwise("Metro Area").alias("cbsa_type"))
    if more_metros:
        meta = meta.unionByName(t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("cbsa_code"), F.col("n_name").alias("cbsa_name"),
                                                F.lit("ASIA").alias("census_division"), F.lit("Metro Area").alias("cbsa_type")))
    cols = ["pop_total", "pop_growth_3yr", "pop_growth_5yr", "median_gross_rent", "median_home_value", "pct_commute_wfh", "mean_travel_time"]
    m = store(m.select("geo_id", "year", *cols, "permits"))
    code = F.col("geo_id").alias("cbsa_code")
    return P.cbsa_features(meta, m.select(code, "year", *cols), m.select(code, "year", F.col("permits").alias("total_units")))


def _cf_rank(m, up):
    best, worst = ("DESC", "") if up else ("", "DESC")
    one = lambda s, part: (f"row_number() OVER (PARTITION BY {part} ORDER BY {m} {best} NULLS LAST, cbsa_code) AS {s}_{m}_rank, percent_rank() OVER (PARTITION BY {part} ORDER BY {m} {worst} NULLS LAST) AS {s}_{m}_pctl")
    return one("national", "year, cbsa_type") + ", " + one("region", "census_division, year, cbsa_type")


@query("mt22_metro_features", S.sql_mart("county", extra=_CF_ALL, body="SELECT *, " + ", ".join(_cf_rank(m, up) for m, up in P.CBSA_METRICS.items()) + " FROM f"),
       real="pop_total pop_growth_3yr pop_growth_5yr median_gross_rent median_home_value pct_commute_wfh mean_travel_time bps_total_units bps_units_3yr_avg commute_intensity_b bps_units_per_1k bps_units_per_1k_3yr_avg "
       + " ".join(f"{s}_{m}_pctl" for m in _CF_METRICS for s in ("national", "region")), ints="year")
def mt22(t):
    return metro_features(t, more_metros=True)


# ---- tract features: customers play the tracts, nations counties and metros -

_RENT = "CASE WHEN hu_total % 11 <> 0 THEN median_gross_rent END"
_VAL = "CASE WHEN hu_total % 7 <> 0 THEN median_home_value END"
_PR = lambda c, o: f"CASE WHEN {c} IS NOT NULL THEN percent_rank() OVER (PARTITION BY cbsa_code, {c} IS NULL ORDER BY {c}) END AS {o}"
TF_SQL = f"""tg AS (SELECT *, {G('pop_total', 3)} AS pop_growth_3yr, {G('pop_total', 5)} AS pop_growth_5yr FROM mart WHERE geo_level = 'tract'),
bp AS (SELECT geo_id AS county_geoid, year, avg(permits) OVER (PARTITION BY geo_id ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS total_units_3yr_avg FROM mart WHERE geo_level = 'cbsa'),
tb AS (SELECT x.cbsa_code, x.cbsa_code AS county_geoid, g.geo_id AS tract_geoid, g.year, pop_total, pop_growth_3yr, pop_growth_5yr, median_hh_income, {_RENT} AS median_gross_rent, {_VAL} AS median_home_value, pct_commute_wfh, mean_travel_time, land_area_sqmi, total_units_3yr_avg,
  mean_travel_time * (1 - pct_commute_wfh) AS commute_intensity_b, total_units_3yr_avg * 1000 / pop_total AS units_per_1k_3yr, pop_total / land_area_sqmi AS pop_density FROM tg g JOIN tract_cbsa x ON g.geo_id = x.tract_geoid LEFT JOIN bp ON bp.county_geoid = x.cbsa_code AND bp.year = g.year WHERE g.year = 2000),
tp AS (SELECT *, {_PR('pop_growth_3yr', 'pop_growth_pctl')}, {_PR('median_hh_income', 'income_pctl')}, {_PR('median_gross_rent', 'rent_pctl')}, {_PR('median_home_value', 'value_pctl')}, {_PR('pop_density', 'density_pctl')} FROM tb),
tq AS (SELECT *, coalesce(0.5 * rent_pctl + 0.5 * value_pctl, value_pctl, rent_pctl) AS price_proxy_pctl FROM tp),
tr AS (SELECT *, CASE WHEN pop_growth_pctl >= 0.5 THEN 1 ELSE 0 END AS gate_pop, CASE WHEN price_proxy_pctl < 0.7 THEN 1 ELSE 0 END AS gate_price, CASE WHEN density_pctl <= 0.7 THEN 1 ELSE 0 END AS gate_density FROM tq),
tf AS (SELECT *, CASE WHEN gate_pop = 1 AND gate_price = 1 AND gate_density = 1 THEN 1 ELSE 0 END AS eligible_v1 FROM tr)"""
TF_REAL = "pop_total pop_growth_3yr pop_growth_5yr median_hh_income median_gross_rent median_home_value pct_commute_wfh mean_travel_time land_area_sqmi total_units_3yr_avg commute_intensity_b units_per_1k_3yr pop_density pop_growth_pctl income_pctl rent_pctl value_pctl density_pctl price_proxy_pctl"


def features(t):
    m = growth(S.mart(t, "tract"), ["geo_level", "geo_id"], "year", "pop_total", (3, 5), prefix="pop", cagr=())
    m = m.withColumns({"median_gross_rent": F.expr(_RENT), "median_home_value": F.expr(_VAL)})
    m = store(m.filter("year = 2000").select("geo_id", "year", "pop_total", "pop_growth_3yr", "pop_growth_5yr", "median_hh_income", "median_gross_rent",
                                                   "median_home_value", "pct_commute_wfh", "mean_travel_time", "land_area_sqmi"))
    tracts = S.tract_cbsa(t).select("tract_geoid", F.col("cbsa_code").alias("county_geoid"), "cbsa_code").join(
        m.select(F.col("geo_id").alias("tract_geoid"), "land_area_sqmi"), "tract_geoid")
    metrics = m.select(F.col("geo_id").alias("tract_geoid"), "year", "pop_total", "pop_growth_3yr", "pop_growth_5yr", "median_hh_income", "median_gross_rent",
                       "median_home_value", "pct_commute_wfh", "mean_travel_time")
    permits = S.mart(t, "cbsa").select(F.col("geo_id").alias("county_geoid"), "year", F.col("permits").alias("total_units"))
    return P.tract_features(tracts, metrics, permits, 2000)


def sql(body, extra=""):
    return S.sql_mart("tract", "cbsa", extra=TF_SQL + (", " + extra.strip() if extra else ""), body=body)


@query("mt23_tract_features", sql("SELECT * FROM tf"), real=TF_REAL, ints="year gate_pop gate_price gate_density eligible_v1")
def mt23(t):
    return features(t)


_IN = P.SCORING_INPUTS
_SRC = {"pop_growth_3yr": "pop_growth_3yr", "permits_per_1k_3yr": "units_per_1k_3yr", "density": "pop_density", "price_proxy": "price_proxy_pctl", "commute_intensity": "commute_intensity_b", "median_household_income": "median_hh_income"}
_Z = lambda o: f"CASE WHEN coalesce(stddev_samp({o}_scoring) OVER w, 0) = 0 THEN 0 ELSE ({o}_scoring - avg({o}_scoring) OVER w) / nullif(stddev_samp({o}_scoring) OVER w, 0) END AS z_{o}"
MODEL_SQL = f"""m0 AS (SELECT cbsa_code, tract_geoid, pop_growth_pctl, density_pctl, {', '.join(f'{s} AS {c}' for c, s in _SRC.items())} FROM tf),
m1 AS (SELECT *, {', '.join(f'coalesce({c}, median({c}) OVER (PARTITION BY cbsa_code)) AS {o}_scoring' for c, o in _IN.items())} FROM m0),
m2 AS (SELECT *, {', '.join(_Z(o) for o in _IN.values())} FROM m1 WINDOW w AS (PARTITION BY cbsa_code)),
m3 AS (SELECT *, -z_density AS z_density_inv, -z_price AS z_price_inv, CASE WHEN pop_growth_pctl >= 0.5 THEN 1 ELSE 0 END AS growth_gate_flag, CASE WHEN price_proxy < 0.7 THEN 1 ELSE 0 END AS price_gate_flag, CASE WHEN density_pctl <= 0.7 THEN 1 ELSE 0 END AS density_gate_flag FROM m2),
m4 AS (SELECT *, growth_gate_flag * price_gate_flag * density_gate_flag AS eligible_flag, {', '.join(' + '.join(f'{w} * {z}' for z, w in ws.items()) + f' AS score_{m}' for m, ws in P.MODELS.items())} FROM m3),
m5 AS (SELECT *, {', '.join(f'row_number() OVER (PARTITION BY cbsa_code ORDER BY score_{m} DESC, tract_geoid) AS rank_{m}_cbsa, row_number() OVER (ORDER BY score_{m} DESC, cbsa_code, tract_geoid) AS rank_{m}_national' for m in P.MODELS)} FROM m4)"""
_MREAL = " ".join([*_IN, *[f"z_{o}" for o in _IN.values()], "z_density_inv", "z_price_inv", *[f"score_{m}" for m in P.MODELS]])
_MGATES = "growth_gate_flag price_gate_flag density_gate_flag eligible_flag"


@query("mt24_tract_models", sql("SELECT * EXCLUDE (pop_growth_pctl, density_pctl, " + ", ".join(f"{o}_scoring" for o in _IN.values()) + ") FROM m5", MODEL_SQL), real=_MREAL, ints=_MGATES)
def mt24(t):
    return P.tract_models(features(t))


_TERM = {f"{m}_{z[2:]}_contribution": f"{w} * {z}" for m, ws in P.MODELS.items() for z, w in ws.items()}


@query("mt25_model_audit", sql(f"""SELECT cbsa_code, tract_geoid, {', '.join(f'{o}_scoring' for o in _IN.values())}, {', '.join(f'{c} IS NULL AS imputed_{o}' for c, o in _IN.items())}, {' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in _IN)} AS imputed_count,
  {', '.join(f'{e} AS {n}' for n, e in _TERM.items())}, {', '.join(f'score_{m}' for m in P.MODELS)} FROM m4""", MODEL_SQL),
       real=" ".join([*[f"{o}_scoring" for o in _IN.values()], *_TERM, *[f"score_{m}" for m in P.MODELS]]), ints="imputed_count")
def mt25(t):
    return P.model_audit(features(t))


_SEEDS = ", sl AS (" + " UNION ALL ".join(f"SELECT cbsa_code, tract_geoid, '{m}' AS model_name, score_{m} AS model_score, rank_{m}_cbsa AS model_rank_cbsa, rank_{m}_national AS model_rank_national, eligible_flag FROM m5 WHERE eligible_flag = 1" for m in P.MODELS) + """),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cbsa_code, model_name ORDER BY model_score DESC, tract_geoid) AS cluster_seed_rank, CAST(ceil(count(*) OVER (PARTITION BY cbsa_code, model_name) * 0.25) AS BIGINT) AS cluster_cutoff_n FROM sl) WHERE cluster_seed_rank <= cluster_cutoff_n)"""


@query("mt26_cluster_seeds", sql("SELECT *, 0.25 AS cluster_top_share, 1 AS is_cluster_seed FROM seeds", MODEL_SQL + _SEEDS), real="model_score cluster_top_share", ints="eligible_flag is_cluster_seed")
def mt26(t):
    return P.cluster_seeds(P.tract_models(features(t)))


_V1 = P.V1_TERMS
V1_SQL = f"""v1 AS (SELECT *, {', '.join(f'{c} * {s} AS {t}_raw' for t, (c, s, _) in _V1.items())} FROM tf),
v2 AS (SELECT *, {', '.join(f'coalesce({t}_raw, median({t}_raw) OVER ()) AS {t}_scoring' for t in _V1)} FROM v1), v3 AS (SELECT *, {', '.join(_Z(t) for t in _V1)} FROM v2 WINDOW w AS ()),
v4 AS (SELECT *, {', '.join(f'{w} * z_{t} AS contrib_{t}' for t, (_, _, w) in _V1.items())} FROM v3), v5 AS (SELECT *, {' + '.join(f'contrib_{t}' for t in _V1)} AS tract_score FROM v4),
vq AS (SELECT quantile_cont(pop_growth_3yr, 0.75) AS qg, quantile_cont(units_per_1k_3yr, 0.75) AS qu, quantile_cont(commute_intensity_b, 0.75) AS qc, quantile_cont(median_hh_income, 0.75) AS qi FROM tf),
vt AS (SELECT v5.*, concat_ws(' | ', CASE WHEN pop_growth_3yr >= qg THEN 'High growth' END, CASE WHEN units_per_1k_3yr >= qu THEN 'High housing pipeline' END, CASE WHEN density_pctl <= 0.7 THEN 'Low density headroom' END, CASE WHEN price_proxy_pctl <= 0.5 THEN 'Moderate price pressure' END, CASE WHEN commute_intensity_b >= qc THEN 'High commute exposure' END, CASE WHEN median_hh_income >= qi THEN 'Strong household income' END) AS tags FROM v5, vq),
scores AS (SELECT * EXCLUDE (tags, {', '.join(f'{t}_scoring' for t in _V1)}), row_number() OVER (ORDER BY tract_score DESC, tract_geoid) AS tract_rank, CASE WHEN tags = '' THEN 'Balanced profile' ELSE tags END AS why_tags, true AS is_scored FROM vt)"""
_V1REAL = TF_REAL + " tract_score " + " ".join(f"{t}_raw z_{t} contrib_{t}" for t in _V1)


@query("mt27_tract_scores", sql("SELECT * FROM scores", V1_SQL), real=_V1REAL, ints="year gate_pop gate_price gate_density eligible_v1")
def mt27(t):
    return P.tract_scores(features(t))


@query("mt27_top_tracts", sql("SELECT tract_geoid, row_number() OVER (ORDER BY tract_score DESC, tract_geoid) AS tract_rank, tract_score, why_tags FROM scores WHERE eligible_v1 = 1 ORDER BY tract_score DESC, tract_geoid LIMIT 50", V1_SQL), real="tract_score")
def mt27_top(t):
    return P.top_tracts(P.tract_scores(features(t)), 50).select("tract_geoid", "tract_rank", "tract_score", "why_tags")


@query("mt27_eligibility_funnel", sql("""
SELECT 1 AS step_order, 'All rows' AS step, count(*) AS rows_remaining FROM tf UNION ALL SELECT 2, 'After growth gate', count(*) FROM tf WHERE gate_pop = 1 UNION ALL SELECT 3, 'After growth + price gates', count(*) FROM tf WHERE gate_pop = 1 AND gate_price = 1
UNION ALL SELECT 4, 'After growth + price + density gates', count(*) FROM tf WHERE gate_pop = 1 AND gate_price = 1 AND gate_density = 1 UNION ALL SELECT 5, 'Eligible (v1)', count(*) FROM tf WHERE eligible_v1 = 1"""), ints="step_order")
def mt27_funnel(t):
    return P.eligibility_funnel(features(t))


# ---- zones ----------------------------------------------------------------

CAND_SQL = V1_SQL + ", cand AS (SELECT s.*, CAST(tract_geoid AS BIGINT) AS k FROM scores s WHERE (CAST(tract_geoid AS BIGINT) * CAST(tract_geoid AS BIGINT)) % 11 < 3)"


def tract_polygons(t):
    """Unit squares on a 40-wide grid, one per tract."""
    k = F.col("c_custkey")
    return t.customer.select(F.lpad(k.cast("string"), 11, "0").alias("tract_geoid"), square(k % 40, F.floor(k / 40)).alias("ring"),
                             (k % 40 + 0.5).alias("x"), (F.floor(k / 40) + 0.5).alias("y"))


def candidates(t):
    """Scored tracts chosen as zone seeds."""
    scores = P.tract_scores(features(t))
    seeds = t.customer.filter("c_custkey * c_custkey % 11 < 3").select(F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("tract_geoid"))
    return Z.zone_candidates(scores, seeds.unionByName(seeds))


_ZSUM = """count(*) AS tracts, sum(pop_total) AS total_population, sum(pop_growth_3yr * pop_total) / sum(pop_total) FILTER (pop_growth_3yr IS NOT NULL) AS pop_growth_3yr_wtd, sum(units_per_1k_3yr * pop_total) / sum(pop_total) AS units_per_1k_3yr_wtd, avg(tract_score) AS mean_tract_score, median(pop_density) AS pop_density_median, median(price_proxy_pctl) AS price_proxy_pctl_median"""
_ZREAL = "total_population pop_growth_3yr_wtd units_per_1k_3yr_wtd mean_tract_score pop_density_median price_proxy_pctl_median"
_LETTER = lambda n: f"CASE WHEN {n} > 26 THEN chr(CAST(64 + ({n} - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + ({n} - 1) % 26 AS INTEGER))"
_ORDER = lambda prefix, label: f"o AS (SELECT *, '{prefix}' || CASE WHEN ord < 10 THEN '0' ELSE '' END || ord AS zid, '{label}' || {_LETTER('ord')} AS zlabel FROM (SELECT component, row_number() OVER (ORDER BY round(avg(tract_score), 9) DESC, component) AS ord FROM z GROUP BY component))"


@query("mt28_contiguity_zone_summary", sql(f"SELECT zid AS zone_id, zlabel AS zone_label, ord AS zone_order, {_ZSUM}, CAST(count(*) AS DOUBLE) AS zone_area FROM z JOIN o USING (component) GROUP BY ALL", CAND_SQL + f""",
v AS (SELECT k AS id, k % 40 AS x, k // 40 AS y FROM cand), e AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.id <> b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), {REACH}, {CC}, z AS (SELECT cand.*, component FROM cand JOIN cc ON cc.id = k), {_ORDER('zone_', 'Zone ')}""").replace("WITH ", "WITH RECURSIVE ", 1),
       real=_ZREAL + " zone_area")
def mt28(t):
    _, summary = Z.contiguity_zone_table(candidates(t), tract_polygons(t))
    return summary


_EPS = 1.2


@query("mt28_cluster_zone_summary", sql(f"SELECT zid AS cluster_id, zlabel AS cluster_label, ord AS cluster_order, {_ZSUM} FROM z JOIN o USING (component) GROUP BY ALL", CAND_SQL.replace("(CAST(tract_geoid AS BIGINT) * CAST(tract_geoid AS BIGINT)) % 11 < 3", "CAST(tract_geoid AS BIGINT) % 5 < 2") + f""",
v AS (SELECT k AS id, k % 40 + 0.5 AS x, k // 40 + 0.5 AS y FROM cand), e AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_EPS} * {_EPS}), {REACH}, {CC}, z AS (SELECT cand.*, component FROM cand JOIN cc ON cc.id = k), {_ORDER('cluster_', 'Cluster Zone ')}""").replace("WITH ", "WITH RECURSIVE ", 1), real=_ZREAL)
def mt28_clusters(t):
    scores = P.tract_scores(features(t))
    pick = t.customer.filter("c_custkey % 5 < 2").select(F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("tract_geoid"))
    _, summary = Z.cluster_zone_table(Z.zone_candidates(scores, pick), tract_polygons(t), _EPS, min_pts=1)
    return summary


# ---- screens --------------------------------------------------------------

_Z3 = "z AS (SELECT geo_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z_{c}" for c in ("income_pc", "vacancy_rate", "pct_ba_plus")) + " FROM (SELECT * REPLACE (geo_id || '-' || CAST(year AS INTEGER) AS geo_id) FROM mart))"


def _yearly(t):
    """Every tract in every year as a place of its own."""
    return S.mart(t, "tract").withColumn("geo_id", F.concat_ws("-", "geo_id", F.col("year").cast("int").cast("string")))


def _zframe(t):
    from terrapanel.operators.stats import zscore
    cols = {c: f"z_{c}" for c in ("income_pc", "vacancy_rate", "pct_ba_plus")}
    return zscore(_yearly(t).select("geo_id", *cols), [], cols).select("geo_id", *cols.values())


@query("mt37_overheat_gap", S.sql_mart("tract", extra=_Z3 + ", g AS (SELECT *, z_income_pc + z_vacancy_rate AS overheating_score, z_pct_ba_plus - 0.5 * z_vacancy_rate AS support_score, z_income_pc + z_vacancy_rate - (z_pct_ba_plus - 0.5 * z_vacancy_rate) AS overheat_gap FROM z)", body="""
SELECT *, CASE WHEN overheat_gap >= quantile_cont(overheat_gap, 0.9) OVER () THEN 'Overheated' WHEN overheat_gap <= quantile_cont(overheat_gap, 0.1) OVER () THEN 'Undervalued' ELSE 'Neutral' END AS market_type, 100 * (overheat_gap - min(overheat_gap) OVER ()) / (max(overheat_gap) OVER () - min(overheat_gap) OVER ()) AS overheat_gap_score FROM g"""),
       real="z_income_pc z_vacancy_rate z_pct_ba_plus overheating_score support_score overheat_gap overheat_gap_score")
def mt37(t):
    return P.overheat_gap(_zframe(t), ["z_income_pc", "z_vacancy_rate"], {"z_pct_ba_plus": 1.0, "z_vacancy_rate": -0.5})


@query("mt37_investment_index", S.sql_mart("tract", extra=_Z3 + ", g AS (SELECT *, 0.5 * z_income_pc + 0.3 * z_pct_ba_plus + -0.2 * z_vacancy_rate AS raw_index FROM z)", body="""
SELECT *, ntile(5) OVER (ORDER BY raw_index, geo_id) AS investment_tier, CASE WHEN raw_index >= avg(raw_index) OVER () + stddev_samp(raw_index) OVER () THEN 'High Performer' WHEN raw_index <= avg(raw_index) OVER () - stddev_samp(raw_index) OVER () THEN 'Under Performer' ELSE 'Middle Tier' END AS index_outlier,
  100 * (raw_index - min(raw_index) OVER ()) / (max(raw_index) OVER () - min(raw_index) OVER ()) AS investment_index FROM g"""), real="z_income_pc z_vacancy_rate z_pct_ba_plus raw_index investment_index")
def mt37i(t):
    return P.investment_index(_zframe(t), {"z_income_pc": 0.5, "z_pct_ba_plus": 0.3, "z_vacancy_rate": -0.2}, ["geo_id"])


@query("mt39_sweet_spot_screen", S.sql_mart("tract", extra="p AS (SELECT geo_id, percent_rank() OVER (ORDER BY income_pc) AS income_pc_pctl, percent_rank() OVER (ORDER BY vacancy_rate DESC) AS vacancy_rate_pctl FROM (SELECT * REPLACE (geo_id || '-' || CAST(year AS INTEGER) AS geo_id) FROM mart))", body="""
SELECT *, (income_pc_pctl + vacancy_rate_pctl) / 2 AS screen_score FROM p ORDER BY round((income_pc_pctl + vacancy_rate_pctl) / 2, 9) DESC, geo_id LIMIT 40"""), real="income_pc_pctl vacancy_rate_pctl screen_score")
def mt39(t):
    df = _yearly(t).select("geo_id", "income_pc", "vacancy_rate")
    return P.percentile_screen(df, ["geo_id"], {"income_pc": True, "vacancy_rate": False}, 40).select("geo_id", "income_pc_pctl", "vacancy_rate_pctl", "screen_score")


@query("mt42_radar_long", "WITH " + _DIST_SQL + """, l AS (SELECT nces_district_id, 'enrollment' AS kpi, enrollment AS value FROM districts UNION ALL SELECT nces_district_id, 'title_1_allocations', title_1_allocations FROM districts)
SELECT *, CASE WHEN kpi = 'enrollment' THEN pct ELSE 1 - pct END AS pct_adj, CASE WHEN kpi = 'enrollment' THEN 'Higher is better' ELSE 'Lower is better (inverted)' END AS direction FROM (SELECT *, CASE WHEN value IS NOT NULL THEN percent_rank() OVER (PARTITION BY kpi, value IS NULL ORDER BY value) END AS pct FROM l)""", real="value pct pct_adj")
def mt42(t):
    return P.radar_long(district_table(t), ["nces_district_id"], {"enrollment": True, "title_1_allocations": False})


@query("mt42_top_districts", S.sql_mart("tract", extra=_SCORED_SQL + """,
t AS (SELECT * FROM b ORDER BY round(lead_score, 9) DESC, nces_district_id LIMIT 25), q AS (SELECT quantile_cont(allocations_per_student, 0.75) AS qa, quantile_cont(enrollment, 0.75) AS qe, quantile_cont(child_poverty_rate, 0.75) AS qp FROM t)""", body="""
SELECT nces_district_id, lead_score, CASE pop_growth_quartile WHEN 4 THEN 'High growth' WHEN 3 THEN 'Moderate growth' WHEN 1 THEN 'Declining' ELSE 'Stable' END AS growth_label,
  CASE WHEN allocations_per_student >= qa AND economically_disadvantaged_percent / 100 >= 0.6 THEN 'High Title I funding and high student need' WHEN enrollment >= qe THEN 'Large district with meaningful contract scale'
    WHEN child_poverty_rate >= qp THEN 'High community need aligned with federal funding' WHEN pop_growth_quartile = 4 THEN 'Strong growth outlook with solid funding base' ELSE 'Balanced mix of scale, funding, and need' END AS why FROM t, q"""), real="lead_score")
def mt42_top(t):
    acs = S.mart(t, "tract").select("geo_level", F.substring("geo_id", 5, 7).alias("geo_id"), "geo_name", "year", F.col("pop_total").alias("population"),
                                    F.when(F.col("hu_total") % 8 != 0, F.col("vacancy_rate")).alias("child_poverty_rate"))
    return P.top_districts(M.school_district_mart(district_table(t), acs), 25).select("nces_district_id", "lead_score", "growth_label", "why")
