"""MT1-MT11, MT36, MT38, MT43: wide marts on stand-in silver panels."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.registry import query
from terrapanel.plans import marts as M
from terrapanel.session import store

# Silver column -> expression over the stand-in mart, valid in both engines.
SILVER = {
    "pop_total": "pop_total",
    "age_0_4": "age_1", "age_5_14": "age_2", "age_15_17": "age_3 * 0.5", "age_18_24": "age_3 * 0.5", "age_25_34": "age_4",
    "age_35_44": "age_5 * 0.5", "age_45_54": "age_5 * 0.5", "age_55_64": "age_6 * 0.25", "age_65_74": "age_6 * 0.75",
    "age_75_84": "age_7 * 0.5", "age_85p": "age_7 * 0.5",
    "pct_white_nh": "race_a / pop_total", "pct_hispanic": "race_n / pop_total",
    "pct_lt_hs_25p": "age_1 / pop_total", "pct_hs_ged_25p": "age_2 / pop_total", "pct_ba_25p": "age_3 / pop_total",
    "pct_ma_plus_25p": "age_4 / pop_total",
    "hu_total": "hu_total", "median_gross_rent": "median_gross_rent", "median_home_value": "median_home_value",
    "pct_rent_burden_30plus": "pct_rent_burden_30plus", "pct_struct_small_mf": "vacancy_rate * 0.25",
    "pct_struct_mid_mf": "CASE WHEN hu_total % 3 = 0 THEN vacancy_rate * 0.5 END", "pct_struct_large_mf": "vacancy_rate * 0.125",
    "median_hh_income": "median_hh_income", "per_capita_income": "income_pc",
    "pi_total": "income_total", "pi_wages_salary": "gdp_1 + gdp_2",
    "gdp_total": "income_total", "real_gdp_total": "income_total * 0.875", "employed": "hu_total * 2 + 1",
    "labor_force": "hu_total * 2 + 4", "unemployed": "3.0 + 0 * hu_total", "unemployment_rate_percent": "100.0 * 3 / (hu_total * 2 + 4)",
    "real_gdp_natural_resources_all": "gdp_1 * 0.5", "real_gdp_manufacturing_all": "gdp_2", "real_gdp_construction": "gdp_3 * 0.25",
    "real_gdp_trade_all": "gdp_4", "real_gdp_transportation": "gdp_1 * 0.25", "real_gdp_information": "gdp_5 * 0.5",
    "real_gdp_finance_insurance": "gdp_5 * 0.25", "real_gdp_real_estate": "gdp_6 * 0.5", "real_gdp_professional_scientific": "gdp_6 * 0.25",
    "real_gdp_professional_management": "gdp_6 * 0.125", "real_gdp_professional_admin_support": "gdp_6 * 0.125",
    "real_gdp_education_all": "gdp_7 * 0.5", "real_gdp_arts_entertainment": "gdp_7 * 0.25", "real_gdp_accomodation_food": "gdp_7 * 0.125",
    "real_gdp_gov_enterprises": "gdp_3 * 0.5",
    "ind_total_emp": "pop_total", "ind_retail": "age_1 + age_2", "ind_construction": "age_3",
    "pct_ind_retail": "(age_1 + age_2) / pop_total", "pct_ind_construction": "age_3 / pop_total",
    "pct_same_house": "CASE WHEN hu_total % 5 <> 0 THEN owner_occ_rate END", "pct_moved_same_cnty": "renter_occ_rate * 0.5",
    "pct_moved_same_st": "CASE WHEN hu_total % 2 = 0 THEN renter_occ_rate * 0.25 END", "pct_moved_diff_st": "renter_occ_rate * 0.125",
    "pct_moved_abroad": "vacancy_rate * 0.0625", "mig_moved_same_cnty": "race_n * 0.5", "mig_moved_same_st": "race_n * 0.25",
    "mig_moved_diff_st": "race_n * 0.125", "mig_moved_abroad": "race_r * 0.5", "pop_nativity_total": "pop_total",
    "pop_foreign_born_citizen": "race_a * 0.5", "pop_foreign_born_noncitizen": "race_r * 0.25",
    "pct_commute_transit": "age_1 / pop_total", "pct_commute_walk": "CASE WHEN hu_total % 4 <> 0 THEN age_2 / pop_total END",
    "pct_commute_wfh": "pct_commute_wfh", "mean_travel_time": "mean_travel_time", "land_area_sqmi": "land_area_sqmi",
    "rpp_real_pc_income": "income_pc * 0.5", "rpp_all_items": "80 + 40 * vacancy_rate", "rpp_price_deflator": "95 + 10 * owner_occ_rate",
    "permits": "permits", "fmr_2br": "median_gross_rent * 1.25", "rent50_2br": "median_gross_rent * 0.75",
    "unemployment_rate": "3.0 / (hu_total * 2 + 4)",
}
_SILVER_SQL = "silver AS (SELECT geo_level, geo_id, geo_name, year, " + ", ".join(f"{e} AS {c}" for c, e in SILVER.items()) + " FROM mart)"


def silver(t, *levels, cols, stored=True):
    """Silver columns; written once when a mart reads them several times."""
    m = S.mart(t, *levels)
    out = m.select(*S.KEYS, *[F.expr(SILVER[c]).alias(c) for c in cols])
    return store(out) if stored else out


def sql(*levels, body, extra=""):
    return S.sql_mart(*levels, body=body, extra=_SILVER_SQL + (", " + extra.strip() if extra else ""))


AGES = [c for c in SILVER if c.startswith("age_")]
LV = ("county", "cbsa", "region", "us")
LAG = lambda c, h: f"lag({c}, {h}) OVER (PARTITION BY geo_level, geo_id ORDER BY year)"
GROWTH = lambda c, h: f"CASE WHEN {LAG(c, h)} > 0 THEN ({c} - {LAG(c, h)}) / {LAG(c, h)} END"
CAGR = lambda c, h: f"CASE WHEN {LAG(c, h)} > 0 THEN pow({c} / {LAG(c, h)}, 1.0 / {h}) - 1 END"
K4 = "geo_level, geo_id, geo_name, year"


@query("mt01_population_mart", sql(*LV, body=f"""
SELECT {K4}, pop_total, {', '.join(f"{GROWTH('pop_total', h)} AS pop_growth_{h}yr" for h in (1, 3, 5, 10))}, {', '.join(f"{CAGR('pop_total', h)} AS pop_cagr_{h}yr" for h in (3, 5, 10))},
  (age_0_4 + age_5_14 + age_15_17) / pop_total AS pct_age_under_18, (age_18_24 + age_25_34 + age_35_44 + age_45_54 + age_55_64) / pop_total AS pct_age_18_64,
  (age_65_74 + age_75_84 + age_85p) / pop_total AS pct_age_over_64, (age_0_4 + age_5_14 + age_15_17 + age_65_74 + age_75_84 + age_85p) / nullif(age_25_34 + age_35_44 + age_45_54, 0) AS dependents_per_worker,
  (age_0_4 + age_5_14) / nullif(age_18_24 + age_25_34 + age_35_44 + age_45_54 + age_55_64, 0) AS youth_dependency, (age_65_74 + age_75_84 + age_85p) / nullif(age_18_24 + age_25_34 + age_35_44 + age_45_54 + age_55_64, 0) AS old_age_dependency,
  (age_0_4 + age_5_14) / nullif(age_65_74 + age_75_84 + age_85p, 0) AS aging_index, pct_white_nh, pct_hispanic, 1 - (pct_white_nh * pct_white_nh + pct_hispanic * pct_hispanic) AS diversity_index,
  pct_lt_hs_25p + pct_hs_ged_25p AS pct_hs_or_less, pct_ba_25p AS pct_ba, pct_ba_25p + pct_ma_plus_25p AS pct_ba_plus, pct_ma_plus_25p AS pct_grad_plus FROM silver"""),
       real="pop_total pop_growth_1yr pop_growth_3yr pop_growth_5yr pop_growth_10yr pop_cagr_3yr pop_cagr_5yr pop_cagr_10yr pct_age_under_18 pct_age_18_64 pct_age_over_64 dependents_per_worker youth_dependency old_age_dependency aging_index pct_white_nh pct_hispanic diversity_index pct_hs_or_less pct_ba pct_ba_plus pct_grad_plus", ints="year")
def mt01(t):
    s = silver(t, *LV, cols=["pop_total", *AGES, "pct_white_nh", "pct_hispanic", "pct_lt_hs_25p", "pct_hs_ged_25p", "pct_ba_25p", "pct_ma_plus_25p"])
    race = s.select(*S.KEYS, "pct_white_nh", "pct_hispanic", M.hhi("pct_white_nh", "pct_hispanic").alias("h")).withColumn("diversity_index", 1 - F.col("h")).drop("h")
    edu = s.select(*S.KEYS, "pct_lt_hs_25p", "pct_hs_ged_25p", "pct_ba_25p", "pct_ma_plus_25p")
    return M.population_mart(s.select(*S.KEYS, "pop_total", *AGES), race, edu)


@query("mt02_housing_core_mart", sql("county", "cbsa", body=f"""
SELECT {K4}, hu_total, median_gross_rent, median_home_value, pct_struct_small_mf, pct_struct_mid_mf, pct_struct_large_mf, pop_total, median_hh_income,
  CASE WHEN geo_level = 'cbsa' OR hu_total % 2 = 0 THEN fmr_2br END AS fmr_2br, CASE WHEN geo_level = 'cbsa' THEN rent50_2br END AS rent50_2br, permits AS permits_total_units, CAST(permits AS BIGINT) // 2 AS permits_multifam_units,
  median_gross_rent * 12 AS annualized_median_rent, median_gross_rent * 12 / median_hh_income AS rent_to_income, median_home_value / median_hh_income AS value_to_income,
  CASE WHEN geo_level = 'cbsa' OR hu_total % 2 = 0 THEN fmr_2br END - median_gross_rent AS fmr_gap_2br_vs_median_rent, CASE WHEN geo_level = 'cbsa' THEN rent50_2br END - median_gross_rent AS rent50_gap_2br_vs_median_rent,
  permits * 1000 / hu_total AS permits_per_1000_housing_units, permits * 1000 / pop_total AS permits_per_1000_population, (CAST(permits AS BIGINT) // 2) * 1000.0 / hu_total AS multifam_permits_per_1000_housing_units,
  pct_struct_small_mf + coalesce(pct_struct_mid_mf, 0) + pct_struct_large_mf AS pct_struct_multifam FROM silver"""),
       real="hu_total median_gross_rent median_home_value pct_struct_small_mf pct_struct_mid_mf pct_struct_large_mf pop_total median_hh_income fmr_2br rent50_2br permits_total_units permits_multifam_units annualized_median_rent rent_to_income value_to_income fmr_gap_2br_vs_median_rent rent50_gap_2br_vs_median_rent permits_per_1000_housing_units permits_per_1000_population multifam_permits_per_1000_housing_units pct_struct_multifam", ints="year")
def mt02(t):
    s = silver(t, "county", "cbsa", cols=["pop_total", "hu_total", "median_gross_rent", "median_home_value", "pct_struct_small_mf", "pct_struct_mid_mf",
                                           "pct_struct_large_mf", "median_hh_income", "fmr_2br", "rent50_2br", "permits"])
    series = lambda df, *cols: df.select("geo_level", "geo_id", "geo_name", F.col("year").alias("period"), *cols)
    fmr = series(s.filter("geo_level = 'cbsa' OR hu_total % 2 = 0").withColumn("geo_level", F.concat(F.lit(" "), F.upper("geo_level"))), "fmr_2br")
    bps = series(s, F.col("permits").alias("permits_total_units"), F.floor(F.col("permits") / 2).cast("double").alias("permits_multifam_units"))
    return M.housing_core_mart(
        s.select(*S.KEYS, "pop_total"),
        s.select(*S.KEYS, "hu_total", "median_gross_rent", "median_home_value", "pct_struct_small_mf", "pct_struct_mid_mf", "pct_struct_large_mf"),
        s.select(*S.KEYS, "median_hh_income"), fmr, series(s.filter("geo_level = 'cbsa'"), "rent50_2br"), bps.unionByName(bps))


_INC = f"""inc AS (SELECT {K4}, pop_total, median_hh_income, per_capita_income AS acs_income_pc, pi_total, pi_total / pop_total AS calc_income_pc, pi_wages_salary, pi_wages_salary / pi_total AS pi_wage_share FROM silver),
income AS (SELECT *, {GROWTH('calc_income_pc', 1)} AS income_pc_growth_1yr, {GROWTH('calc_income_pc', 5)} AS income_pc_growth_5yr, {GROWTH('calc_income_pc', 10)} AS income_pc_growth_10yr, {CAGR('calc_income_pc', 5)} AS income_pc_cagr_5yr, {CAGR('calc_income_pc', 10)} AS income_pc_cagr_10yr FROM inc)"""
_INC_REAL = "pop_total median_hh_income acs_income_pc pi_total calc_income_pc pi_wages_salary pi_wage_share income_pc_growth_1yr income_pc_growth_5yr income_pc_growth_10yr income_pc_cagr_5yr income_pc_cagr_10yr"


def income_mart(t, *levels):
    s = silver(t, *levels, cols=["pop_total", "median_hh_income", "per_capita_income", "pi_total", "pi_wages_salary"])
    per = lambda c: s.select("geo_level", "geo_id", "geo_name", F.col("year").alias("period"), c)
    return M.income_mart(s.select(*S.KEYS, "pop_total"), s.select(*S.KEYS, "median_hh_income", "per_capita_income"), per("pi_total"), per("pi_wages_salary"))


@query("mt03_income_mart", sql("county", "cbsa", body="SELECT * FROM income", extra=_INC), real=_INC_REAL, ints="year", digits=5)
def mt03(t):
    return income_mart(t, "county", "cbsa")


_GDPV = {"nominal_gdp_total": "nominal_gdp", "nominal_gdp_pc": "nominal_gdp_pc", "real_gdp_total": "real_gdp", "real_gdp_pc": "real_gdp_pc", "productivity_index": "productivity"}


@query("mt04_gdp_mart", sql("county", "cbsa", extra=f"g AS (SELECT {K4}, pop_total, gdp_total AS nominal_gdp_total, real_gdp_total, employed, gdp_total / pop_total AS nominal_gdp_pc, real_gdp_total / pop_total AS real_gdp_pc, real_gdp_total / employed AS productivity_index FROM silver)",
       body="SELECT *, " + ", ".join(f"{GROWTH(v, 5)} AS {p}_growth_5yr, {CAGR(v, 5)} AS {p}_cagr_5yr" for v, p in _GDPV.items()) + " FROM g"),
       real="pop_total nominal_gdp_total real_gdp_total employed nominal_gdp_pc real_gdp_pc productivity_index " + " ".join(f"{p}_growth_5yr {p}_cagr_5yr" for p in _GDPV.values()), ints="year", digits=5)
def mt04(t):
    s = silver(t, "county", "cbsa", cols=["pop_total", "gdp_total", "real_gdp_total", "employed"])
    per = lambda c: s.select(F.upper("geo_level").alias("geo_level"), "geo_id", F.col("year").alias("period"), c)
    return M.gdp_mart(s.select(*S.KEYS, "pop_total"), per("gdp_total"), per("real_gdp_total"), per("employed"))


@query("mt05_labor_mart", sql("county", "cbsa", extra=f"""l AS (SELECT {K4}, pop_total, age_15_17 + age_18_24 + age_25_34 + age_35_44 + age_45_54 + age_55_64 + age_65_74 + age_75_84 + age_85p AS working_age_pop, labor_force, employed, unemployed,
  labor_force / (age_15_17 + age_18_24 + age_25_34 + age_35_44 + age_45_54 + age_55_64 + age_65_74 + age_75_84 + age_85p) AS lfpr, employed / pop_total AS jobs_to_pop_ratio, unemployment_rate_percent / 100 AS pct_unemployment_rate FROM silver)""",
       body=f"SELECT *, {GROWTH('lfpr', 5)} AS lfpr_growth_5yr, {CAGR('lfpr', 5)} AS lfpr_cagr_5yr, pct_unemployment_rate - {LAG('pct_unemployment_rate', 1)} AS unemployment_rate_change_1yr FROM l"),
       real="pop_total working_age_pop labor_force employed unemployed lfpr jobs_to_pop_ratio pct_unemployment_rate lfpr_growth_5yr lfpr_cagr_5yr unemployment_rate_change_1yr", ints="year")
def mt05(t):
    s = silver(t, "county", "cbsa", cols=["pop_total", *AGES, "labor_force", "employed", "unemployed", "unemployment_rate_percent"])
    laus = s.select("geo_level", "geo_id", F.col("year").alias("period"), "labor_force", "employed", "unemployed", "unemployment_rate_percent")
    return M.labor_mart(s.select(*S.KEYS, "pop_total", *AGES), laus)


_SEC = {s: " + ".join(p) for s, p in M.SECTORS.items()}


@query("mt06_industry_mart", sql("county", "cbsa", extra=f"""a AS (SELECT {K4}, pop_total, ind_total_emp AS acs_ind_total_emp, ind_retail AS acs_ind_retail, ind_construction AS acs_ind_construction, pct_ind_retail AS pct_acs_ind_retail, pct_ind_construction AS pct_acs_ind_construction, real_gdp_total, {', '.join(f'{e} AS real_gdp_{s}' for s, e in _SEC.items())} FROM (SELECT * RENAME (real_gdp_construction AS rgc, real_gdp_transportation AS rgt, real_gdp_information AS rgi) FROM silver)),
b AS (SELECT *, {', '.join(f'real_gdp_{s} / real_gdp_total AS pct_real_gdp_{s}' for s in _SEC)}, {' + '.join(f'real_gdp_{s}' for s in _SEC)} AS sector_sum FROM a)""".replace("real_gdp_construction AS real_gdp_construction", "rgc AS real_gdp_construction").replace("real_gdp_transportation AS real_gdp_transportation", "rgt AS real_gdp_transportation").replace("real_gdp_information AS real_gdp_information", "rgi AS real_gdp_information"),
       body=f"""SELECT *, real_gdp_total - sector_sum AS calc_real_gdp_other, sector_sum / real_gdp_total AS sector_sum_ratio, (real_gdp_total - sector_sum) / real_gdp_total AS pct_calc_real_gdp_other,
  {' + '.join(f'pct_real_gdp_{s} * pct_real_gdp_{s}' for s in _SEC)} + pow((real_gdp_total - sector_sum) / real_gdp_total, 2) AS industry_concentration_hhi, pct_acs_ind_retail * pct_acs_ind_retail + pct_acs_ind_construction * pct_acs_ind_construction AS acs_industry_concentration_hhi,
  CASE WHEN sector_sum / real_gdp_total > 1.05 THEN 'Sector Bug' ELSE 'Non Bug' END AS sector_sum_ratio_quality_flag FROM b"""),
       real="pop_total acs_ind_total_emp acs_ind_retail acs_ind_construction pct_acs_ind_retail pct_acs_ind_construction real_gdp_total sector_sum calc_real_gdp_other sector_sum_ratio pct_calc_real_gdp_other industry_concentration_hhi acs_industry_concentration_hhi " + " ".join(f"real_gdp_{s} pct_real_gdp_{s}" for s in _SEC), ints="year")
def mt06(t):
    gdp = [c for c in SILVER if c.startswith("real_gdp_")]
    ind = ["ind_total_emp", "ind_retail", "ind_construction", "pct_ind_retail", "pct_ind_construction"]
    s = silver(t, "county", "cbsa", cols=["pop_total", *gdp, *ind])
    return M.industry_mart(s.select(*S.KEYS, "pop_total"), s.select(*S.KEYS, *ind), s.select("geo_level", "geo_id", F.col("year").alias("period"), *gdp))


_MIG = [c for c in SILVER if c.startswith(("pct_same", "pct_moved", "mig_", "pop_native", "pop_nativity", "pop_foreign"))]


@query("mt07_migration_mart", sql("county", "cbsa", body=f"""
SELECT {K4}, {', '.join(_MIG)}, 1 - pct_same_house AS mobility_rate, pct_moved_same_cnty + coalesce(pct_moved_same_st, 0) + pct_moved_diff_st AS pct_moved_domestic,
  pct_moved_same_cnty + coalesce(pct_moved_same_st, 0) + pct_moved_diff_st + pct_moved_abroad AS migration_churn, mig_moved_same_cnty + mig_moved_same_st + mig_moved_diff_st + mig_moved_abroad AS migration_churn_count,
  pop_foreign_born_citizen / pop_nativity_total AS pct_foreign_born_citizen, pop_foreign_born_noncitizen / pop_nativity_total AS pct_foreign_born_noncitizen, NULL AS irs_inflow_total, NULL AS irs_outflow_total, NULL AS irs_net_migration, NULL AS irs_net_migration_rate, NULL AS irs_migration_churn FROM silver"""),
       real=" ".join(_MIG) + " mobility_rate pct_moved_domestic migration_churn migration_churn_count pct_foreign_born_citizen pct_foreign_born_noncitizen irs_inflow_total irs_outflow_total irs_net_migration irs_net_migration_rate irs_migration_churn", ints="year")
def mt07(t):
    return M.migration_mart(silver(t, "county", "cbsa", cols=_MIG, stored=False))


@query("mt08_transport_mart", sql("tract", extra="""tc AS (SELECT s.*, x.cbsa_code, x.cbsa_name FROM silver s JOIN tract_cbsa x ON s.geo_id = x.tract_geoid),
d AS (SELECT 'tract' AS geo_level, geo_id, max(geo_name) AS geo_name, year, sum(pop_total) AS p, sum(land_area_sqmi) AS a, sum(pop_total * (pop_total / land_area_sqmi)) AS w FROM tc GROUP BY geo_id, year
  UNION ALL SELECT 'cbsa', cbsa_code, max(cbsa_name), year, sum(pop_total), sum(land_area_sqmi), sum(pop_total * (pop_total / land_area_sqmi)) FROM tc GROUP BY cbsa_code, year),
tr AS (SELECT geo_level, geo_id, geo_name, year, pct_commute_transit, pct_commute_walk, pct_commute_wfh FROM silver UNION ALL SELECT 'cbsa', cbsa_code, max(cbsa_name), year, max(pct_commute_transit), NULL, min(pct_commute_wfh) FROM tc GROUP BY cbsa_code, year)""",
       body=f"""SELECT tr.geo_level, tr.geo_id, tr.geo_name, tr.year, pct_commute_transit, pct_commute_walk, pct_commute_wfh, p AS density_population, a AS land_area_sqmi, p / a AS gross_density_sqmi, w / p AS pop_weighted_density_sqmi,
  coalesce(pct_commute_transit, 0) + coalesce(pct_commute_walk, 0) + coalesce(pct_commute_wfh, 0) AS pct_low_car_commute FROM tr LEFT JOIN d USING (geo_level, geo_id, year)"""),
       real="pct_commute_transit pct_commute_walk pct_commute_wfh density_population land_area_sqmi gross_density_sqmi pop_weighted_density_sqmi pct_low_car_commute", ints="year")
def mt08(t):
    s = silver(t, "tract", cols=["pop_total", "land_area_sqmi", "pct_commute_transit", "pct_commute_walk", "pct_commute_wfh"])
    x = s.join(S.tract_cbsa(t), F.col("geo_id") == F.col("tract_geoid")).drop("tract_geoid")
    tracts = x.withColumnsRenamed({"geo_id": "tract_geoid", "geo_name": "tract_name"})
    cbsa = x.groupBy(F.lit("CBSA").alias("geo_level"), F.col("cbsa_code").alias("geo_id"), "year").agg(
        F.max("cbsa_name").alias("geo_name"), F.max("pct_commute_transit").alias("pct_commute_transit"),
        F.lit(None).cast("double").alias("pct_commute_walk"), F.min("pct_commute_wfh").alias("pct_commute_wfh"))
    tr = s.select(*S.KEYS, "pct_commute_transit", "pct_commute_walk", "pct_commute_wfh").unionByName(cbsa)
    return M.transport_mart(tr, tracts.select("tract_geoid", "tract_name", "year", "pop_total", "land_area_sqmi", "cbsa_code", "cbsa_name"))


@query("mt09_affordability_mart", sql("county", "cbsa", "region", extra=_INC + """,
rpp AS (SELECT CASE WHEN geo_level = 'region' THEN 'state' ELSE 'cbsa' END AS lv, CASE WHEN geo_level = 'region' THEN '0' || geo_id ELSE geo_id END AS gid, year, rpp_real_pc_income, rpp_all_items, rpp_price_deflator FROM silver WHERE geo_level = 'region' OR (geo_level = 'cbsa' AND hu_total % 3 <> 0)),
cx AS (SELECT county_geoid, cbsa_code, '0' || (r_regionkey + 1) AS st FROM county_cbsa JOIN region ON r_name = census_region)""", body=f"""
SELECT s.geo_level, s.geo_id, s.geo_name, s.year, s.hu_total, s.median_gross_rent, s.median_home_value, i.pop_total, i.median_hh_income, i.acs_income_pc, i.pi_total, i.calc_income_pc, i.pi_wages_salary, i.pi_wage_share, i.income_pc_growth_1yr, i.income_pc_growth_5yr, i.income_pc_growth_10yr, i.income_pc_cagr_5yr, i.income_pc_cagr_10yr,
  coalesce(c.rpp_real_pc_income, d.rpp_real_pc_income, t.rpp_real_pc_income) AS rpp_real_pc_income, coalesce(c.rpp_all_items, d.rpp_all_items, t.rpp_all_items) AS rpp_all_items, coalesce(c.rpp_price_deflator, d.rpp_price_deflator, t.rpp_price_deflator) AS rpp_price_deflator,
  CASE WHEN coalesce(c.rpp_real_pc_income, d.rpp_real_pc_income, t.rpp_real_pc_income) > 0 THEN s.median_gross_rent * 12 / coalesce(c.rpp_real_pc_income, d.rpp_real_pc_income, t.rpp_real_pc_income) END AS rent_to_rpp_income, CASE WHEN coalesce(c.rpp_real_pc_income, d.rpp_real_pc_income, t.rpp_real_pc_income) > 0 THEN s.median_home_value / coalesce(c.rpp_real_pc_income, d.rpp_real_pc_income, t.rpp_real_pc_income) END AS value_to_rpp_income
FROM silver s JOIN income i USING (geo_level, geo_id, year) LEFT JOIN rpp d ON d.lv = s.geo_level AND d.gid = s.geo_id AND d.year = s.year LEFT JOIN cx ON s.geo_level = 'county' AND cx.county_geoid = s.geo_id
LEFT JOIN rpp c ON c.lv = 'cbsa' AND c.gid = cx.cbsa_code AND c.year = s.year LEFT JOIN rpp t ON t.lv = 'state' AND t.gid = CASE WHEN s.geo_level = 'county' THEN cx.st ELSE s.geo_id END AND t.year = s.year"""),
       real="hu_total median_gross_rent median_home_value rpp_real_pc_income rpp_all_items rpp_price_deflator rent_to_rpp_income value_to_rpp_income " + _INC_REAL, ints="year", digits=5)
def mt09(t):
    s = silver(t, "county", "cbsa", "region", cols=["hu_total", "median_gross_rent", "median_home_value", *M.RPP])
    region = F.col("geo_level") == "region"
    rpp = s.filter(region | ((F.col("geo_level") == "cbsa") & (F.col("hu_total") % 3 != 0))).select(
        F.when(region, "State").otherwise("CBSA").alias("geo_level"),
        F.when(region, F.concat(F.lit("0"), "geo_id", F.lit("000"))).otherwise(F.col("geo_id")).alias("geo_id"), F.col("year").alias("period"), *M.RPP)
    x = S.county_cbsa(t).join(t.region, F.col("census_region") == F.col("r_name"))
    state = x.select("county_geoid", F.concat(F.lit("0"), (F.col("r_regionkey") + 1).cast("string")).alias("state_fip"))
    return M.affordability_mart(s.select(*S.KEYS, "hu_total", "median_gross_rent", "median_home_value"), income_mart(t, "county", "cbsa", "region"),
                                rpp, x.select("county_geoid", "cbsa_code"), state)


# Districts stand-in: one per customer; enrollment and money from orders.
_DIST_SQL = """d0 AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS nces_district_id, c_name AS district_name, count(*) AS number_of_schools, avg(o_orderkey % 900 + 50) AS avg_school_enrollment, CAST(sum(o_orderkey % 900 + 50) AS DOUBLE) AS enrollment
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
districts AS (SELECT nces_district_id, district_name, number_of_schools, avg_school_enrollment, enrollment, CASE WHEN k % 9 <> 0 THEN k * 977 % 100000 * 1.0 END AS title_1_allocations, CASE WHEN k % 7 <> 0 THEN k * 31 % 1000 / 10.0 END AS not_economically_disadvantaged_percent, 100 - CASE WHEN k % 7 <> 0 THEN k * 31 % 1000 / 10.0 END AS economically_disadvantaged_percent FROM d0)"""


def district_table(t):
    raw = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("'"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("nces_district_id"), F.col("c_name").alias("district_name"),
        (F.col("o_orderkey") % 900 + 50).cast("double").alias("school_enrollment"))
    k, did = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("nces_district_id")
    money = t.customer.filter("c_custkey % 9 <> 0").select(did, (k * 977 % 100000).cast("double").alias("title_1_allocations"))
    need = t.customer.select(did, F.when(k % 7 != 0, k * 31 % 1000 / 10.0).otherwise(-999.0).alias("not_economically_disadvantaged_percent"))
    return M.school_source_table(raw, money, need, ["nces_district_id", "district_name"], "school_enrollment")


@query("mt11_school_source_table", "WITH " + _DIST_SQL + " SELECT * FROM districts", real="avg_school_enrollment enrollment title_1_allocations not_economically_disadvantaged_percent economically_disadvantaged_percent")
def mt11(t):
    return district_table(t)


_SCORED_SQL = _DIST_SQL + """,
acs AS (SELECT substr(geo_id, 5, 7) AS nces_district_id, year, population, child_poverty_rate, CASE WHEN l > 0 THEN (population - l) / l END AS population_growth_5yr FROM (SELECT geo_id, year, pop_total AS population, CASE WHEN hu_total % 8 <> 0 THEN vacancy_rate END AS child_poverty_rate, lag(pop_total, 5) OVER (PARTITION BY geo_id ORDER BY year) AS l FROM mart)),
j AS (SELECT d.*, population, child_poverty_rate, population_growth_5yr, round(title_1_allocations / enrollment, 2) AS allocations_per_student FROM districts d JOIN acs USING (nces_district_id) WHERE year = (SELECT max(year) FROM mart)),
r AS (SELECT *, percent_rank() OVER (ORDER BY enrollment) AS enrollment_pct_rank, percent_rank() OVER (ORDER BY allocations_per_student NULLS LAST) AS student_allocation_pct_rank, percent_rank() OVER (ORDER BY child_poverty_rate NULLS LAST) AS child_poverty_pct_rank,
  CASE WHEN economically_disadvantaged_percent IS NOT NULL THEN percent_rank() OVER (PARTITION BY economically_disadvantaged_percent IS NULL ORDER BY economically_disadvantaged_percent) END AS economic_disadvantaged_pct_rank,
  CASE WHEN population_growth_5yr IS NOT NULL THEN percent_rank() OVER (PARTITION BY population_growth_5yr IS NULL ORDER BY population_growth_5yr) END AS population_growth_pct_rank,
  CASE WHEN population_growth_5yr IS NOT NULL THEN ntile(4) OVER (PARTITION BY population_growth_5yr IS NULL ORDER BY population_growth_5yr, nces_district_id) END AS pop_growth_quartile FROM j),
s AS (SELECT *, 100 * (0.3 * coalesce(enrollment_pct_rank, 0) + 0.3 * coalesce(student_allocation_pct_rank, 0) + 0.2 * coalesce(economic_disadvantaged_pct_rank, 0) + 0.2 * coalesce(child_poverty_pct_rank, 0)) / (0.3 + 0.3 + CASE WHEN economic_disadvantaged_pct_rank IS NULL THEN 0 ELSE 0.2 END + 0.2) AS lead_score FROM r),
b AS (SELECT *, lead_score + CASE pop_growth_quartile WHEN 1 THEN -5 WHEN 3 THEN 2 WHEN 4 THEN 5 ELSE 0 END AS lead_score_growth_boost FROM s)"""


@query("mt10_school_district_mart", S.sql_mart("tract", extra=_SCORED_SQL,
       body="SELECT *, rank() OVER (ORDER BY round(lead_score, 9) DESC) AS lead_score_rank, rank() OVER (ORDER BY round(lead_score_growth_boost, 9) DESC) AS lead_score_growth_boost_rank FROM b"),
       real="avg_school_enrollment enrollment title_1_allocations not_economically_disadvantaged_percent economically_disadvantaged_percent population child_poverty_rate population_growth_5yr allocations_per_student enrollment_pct_rank student_allocation_pct_rank child_poverty_pct_rank economic_disadvantaged_pct_rank population_growth_pct_rank lead_score lead_score_growth_boost")
def mt10(t):
    acs = S.mart(t, "tract").select("geo_level", F.substring("geo_id", 5, 7).alias("geo_id"), "geo_name", "year", F.col("pop_total").alias("population"),
                                    F.when(F.col("hu_total") % 8 != 0, F.col("vacancy_rate")).alias("child_poverty_rate"))
    return M.school_district_mart(district_table(t), acs)


@query("mt36_constant_membership_overview", S.sql_mart("county", extra="""c AS (SELECT cbsa_code, year, sum(pop_total) AS pop_total, sum(income_total) AS income_total FROM mart JOIN county_cbsa ON geo_id = county_geoid GROUP BY ALL),
md AS (SELECT cbsa_code, year, min(median_gross_rent) AS rent_median FROM (SELECT *, sum(w) OVER (PARTITION BY cbsa_code, year ORDER BY median_gross_rent) AS cw, sum(w) OVER (PARTITION BY cbsa_code, year) AS tw FROM (SELECT cbsa_code, year, median_gross_rent, sum(pop_total) AS w FROM mart JOIN county_cbsa ON geo_id = county_geoid GROUP BY ALL)) WHERE cw / tw >= 0.5 GROUP BY ALL),
o AS (SELECT cbsa_code, year, pop_total, income_total, rent_median, income_total / pop_total AS inc_pc FROM c JOIN md USING (cbsa_code, year))""",
       body="SELECT *, " + ", ".join(f"{g(v, 5).replace('geo_level, geo_id', 'cbsa_code')} AS {p}_{k}_5yr" for v, p in (("pop_total", "pop"), ("income_total", "inc"), ("inc_pc", "inc_pc")) for k, g in (("growth", GROWTH), ("cagr", CAGR))) + " FROM o"),
       real="pop_total income_total rent_median inc_pc " + " ".join(f"{p}_{k}_5yr" for p in ("pop", "inc", "inc_pc") for k in ("growth", "cagr")), ints="year", digits=4)
def mt36(t):
    return M.constant_membership_overview(S.mart(t, "county"), S.county_cbsa(t), {"income_total": "inc"}, {"median_gross_rent": "rent_median"}, horizons=(5,))


@query("mt38_real_personal_income", S.sql_mart("county", "cbsa", "region", extra="""meta AS (SELECT cbsa_code, CASE WHEN CAST(county_geoid AS INTEGER) % 2 = 0 THEN 'Metro Area' ELSE 'Micro Area' END AS cbsa_type, census_region AS state_fips FROM county_cbsa JOIN (SELECT * FROM mart WHERE geo_level = 'county' AND year = 2000) ON geo_id = county_geoid QUALIFY row_number() OVER (PARTITION BY cbsa_code ORDER BY pop_total DESC, county_geoid DESC) = 1),
i AS (SELECT m.geo_id, m.year AS period, m.income_pc AS pi_per_capita, cbsa_type, state_fips, coalesce(CASE WHEN m.hu_total % 3 <> 0 THEN 80 + 40 * m.vacancy_rate END, 80 + 40 * r.vacancy_rate) AS rpp_all_items FROM mart m LEFT JOIN meta ON m.geo_id = cbsa_code LEFT JOIN mart r ON r.geo_level = 'region' AND r.geo_name = state_fips AND r.year = m.year WHERE m.geo_level = 'cbsa'),
x AS (SELECT *, pi_per_capita / (rpp_all_items / 100) AS real_pc_income FROM i)""", body="""
SELECT *, n - m AS pc_real_rank_change FROM (SELECT *, (real_pc_income - pi_per_capita) / pi_per_capita AS pc_real_change, rank() OVER (PARTITION BY cbsa_type, period ORDER BY rpp_all_items NULLS LAST) AS lowest_rpp_rank, rank() OVER (PARTITION BY cbsa_type, period ORDER BY pi_per_capita DESC NULLS LAST) AS m, rank() OVER (PARTITION BY cbsa_type, period ORDER BY real_pc_income DESC NULLS LAST) AS n FROM x)""").replace("SELECT *, n - m AS", "SELECT * EXCLUDE (m, n), m AS nominal_pc_income_rank, n AS real_pc_income_rank, n - m AS"),
       real="pi_per_capita rpp_all_items real_pc_income pc_real_change", ints="period")
def mt38(t):
    m = S.mart(t, "county", "cbsa", "region")
    xw = S.county_cbsa(t).join(m.filter("geo_level = 'county' AND year = 2000").select(F.col("geo_id").alias("county_geoid"), "pop_total"), "county_geoid").select(
        "cbsa_code", "county_geoid", "pop_total", F.when(F.col("county_geoid").cast("int") % 2 == 0, "Metro Area").otherwise("Micro Area").alias("cbsa_type"),
        F.col("census_region").alias("state_fips"))
    rpp = (F.lit(80.0) + 40 * F.col("vacancy_rate")).alias("rpp_all_items")
    per = F.col("year").alias("period")
    return M.real_income(m.filter("geo_level = 'cbsa'").select("geo_id", per, F.col("income_pc").alias("pi_per_capita")),
                         m.filter("geo_level = 'cbsa' AND hu_total % 3 <> 0").select("geo_id", per, rpp),
                         m.filter("geo_level = 'region'").select(F.col("geo_name").alias("state_fips"), per, rpp), xw)


@query("mt43_metro_growth_study", S.sql_mart("tract", extra="""p AS (SELECT m.geo_id, m.year, pop_total, permits, unemployment_rate, x.census_region AS region, c_mktsegment AS cbsa_type FROM (SELECT *, 3.0 / (hu_total * 2 + 4) AS unemployment_rate FROM mart) m JOIN tract_cbsa x ON m.geo_id = x.tract_geoid),
q AS (SELECT *, CASE WHEN lag(pop_total, 5) OVER w > 0 THEN (pop_total - lag(pop_total, 5) OVER w) / lag(pop_total, 5) OVER w END AS pop_growth_5yr, CASE WHEN lag(pop_total, 5) OVER w > 0 THEN pow(pop_total / lag(pop_total, 5) OVER w, 0.2) - 1 END AS pop_cagr_5yr, unemployment_rate - lag(unemployment_rate, 5) OVER w AS unemp_rate_chg_5y, permits * 1000 / pop_total AS units_per_1k FROM p WINDOW w AS (PARTITION BY geo_id ORDER BY year)),
z AS (SELECT *, CASE WHEN count(units_per_1k) OVER w = 5 THEN avg(units_per_1k) OVER w END AS units_per_1k_5y_avg FROM q WINDOW w AS (PARTITION BY geo_id ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
l AS (SELECT *, region = 'ASIA' AS in_region FROM z WHERE year = (SELECT max(year) FROM mart) AND pop_cagr_5yr IS NOT NULL)""", body="""
SELECT geo_id, pop_growth_5yr, pop_cagr_5yr, unemp_rate_chg_5y, units_per_1k, units_per_1k_5y_avg, in_region, rank() OVER (ORDER BY pop_cagr_5yr DESC) AS nat_all_rank, percent_rank() OVER (ORDER BY pop_cagr_5yr) AS nat_all_pct, rank() OVER (PARTITION BY cbsa_type ORDER BY pop_cagr_5yr DESC) AS nat_in_type_rank,
  percent_rank() OVER (PARTITION BY cbsa_type ORDER BY pop_cagr_5yr) AS nat_in_type_pct, rank() OVER (PARTITION BY cbsa_type, in_region ORDER BY pop_cagr_5yr DESC) AS reg_in_type_rank, percent_rank() OVER (PARTITION BY cbsa_type, in_region ORDER BY pop_cagr_5yr) AS reg_in_type_pct,
  CASE WHEN in_region THEN ntile(5) OVER (PARTITION BY in_region ORDER BY pop_cagr_5yr, geo_id) END AS growth_q5 FROM l"""), real="pop_growth_5yr pop_cagr_5yr unemp_rate_chg_5y units_per_1k units_per_1k_5y_avg nat_all_pct nat_in_type_pct reg_in_type_pct")
def mt43(t):
    s = silver(t, "tract", cols=["pop_total", "permits", "unemployment_rate"])
    half = s.select("geo_id", "year", (F.col("permits") / 2).alias("units"))
    meta = S.tract_cbsa(t).select(F.col("tract_geoid").alias("geo_id"), F.col("census_region").alias("region"), F.col("c_mktsegment").alias("cbsa_type"))
    out = M.growth_study(s.drop("permits"), half.unionByName(half), meta, region="ASIA")
    return out.select("geo_id", "pop_growth_5yr", "pop_cagr_5yr", "unemp_rate_chg_5y", "units_per_1k", "units_per_1k_5y_avg", "in_region", "nat_all_rank", "nat_all_pct",
                      "nat_in_type_rank", "nat_in_type_pct", "reg_in_type_rank", "reg_in_type_pct", "growth_q5")
