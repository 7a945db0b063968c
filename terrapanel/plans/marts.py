"""Gold marts: wide KPI tables keyed by (geo_level, geo_id, geo_name, year).

Inputs are silver panels with those keys. Columns that are not needed for a
rate pass through untouched, so Spark reads only what the caller selects.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.columns import hhi, normalize_geo_key, residual, reweighted_score
from terrapanel.functions.nulls import add_cols, ratio_or_null, safe_ratio, sum0
from terrapanel.operators.joins import PANEL_KEYS, hierarchy_backfill, join_on_spine
from terrapanel.operators.ranking import equal_buckets, min_rank, pct_rank, ranked_columns
from terrapanel.operators.rollup import dedupe_max, densities, multi_level_rollup, weighted_median
from terrapanel.operators.select import latest_per_key
from terrapanel.operators.series import growth, growth_many, level_change, rolling_mean
from terrapanel.session import store

KEYS = ["geo_level", "geo_id", "geo_name", "year"]
ENTITY = ["geo_level", "geo_id"]

# Age bands of the age panel.
UNDER_15 = ("age_0_4", "age_5_14")
UNDER_18 = ("age_0_4", "age_5_14", "age_15_17")
WORKING = ("age_18_24", "age_25_34", "age_35_44", "age_45_54", "age_55_64")
PRIME = ("age_25_34", "age_35_44", "age_45_54")
OVER_64 = ("age_65_74", "age_75_84", "age_85p")


def _panel(df: DataFrame) -> DataFrame:
    """Lower-case level, integer year (series tables call it `period`)."""
    out = df.withColumnRenamed("period", "year") if "period" in df.columns and "year" not in df.columns else df
    return out.withColumns({"geo_level": F.lower("geo_level"), "year": F.col("year").cast("int")})


def population_mart(age: DataFrame, race: DataFrame, education: DataFrame) -> DataFrame:
    """Population size and growth, age structure, race and education shares."""
    a = growth(_panel(age), ENTITY, "year", "pop_total", (1, 3, 5, 10), prefix="pop", cagr=(3, 5, 10))
    share = lambda cols: ratio_or_null(add_cols(*cols), "pop_total")
    a = a.withColumns({
        "pct_age_under_18": share(UNDER_18), "pct_age_18_64": share(WORKING), "pct_age_over_64": share(OVER_64),
        "dependents_per_worker": ratio_or_null(add_cols(*UNDER_18, *OVER_64), add_cols(*PRIME)),
        "youth_dependency": ratio_or_null(add_cols(*UNDER_15), add_cols(*WORKING)),
        "old_age_dependency": ratio_or_null(add_cols(*OVER_64), add_cols(*WORKING)),
        "aging_index": ratio_or_null(add_cols(*UNDER_15), add_cols(*OVER_64))})
    e = _panel(education).select(
        *PANEL_KEYS, add_cols("pct_lt_hs_25p", "pct_hs_ged_25p").alias("pct_hs_or_less"), F.col("pct_ba_25p").alias("pct_ba"),
        add_cols("pct_ba_25p", "pct_ma_plus_25p").alias("pct_ba_plus"), F.col("pct_ma_plus_25p").alias("pct_grad_plus"))
    a = a.drop(*[c for c in a.columns if c.startswith("age_")])
    return join_on_spine(a, _panel(race).drop("geo_name"), e)


def housing_core_mart(pop: DataFrame, housing: DataFrame, income: DataFrame, fmr: DataFrame, rent50: DataFrame,
                      permits: DataFrame) -> DataFrame:
    """Stock, tenure, burden, rents and permits. Rent and permit tables may repeat
    a key, so they are reduced to one row per key before joining."""
    def stable(df: DataFrame) -> DataFrame:
        p = normalize_geo_key(_panel(df))
        return dedupe_max(p, list(PANEL_KEYS), [c for c in p.columns if c not in PANEL_KEYS])

    h = _panel(housing)
    out = join_on_spine(h, _panel(pop), _panel(income), stable(fmr), stable(rent50), stable(permits))
    out = out.withColumn("annualized_median_rent", F.col("median_gross_rent") * 12.0)
    per_1000 = lambda n, d: safe_ratio(F.col(n) * 1000.0, d)
    return out.withColumns({
        "rent_to_income": safe_ratio("annualized_median_rent", "median_hh_income"),
        "value_to_income": safe_ratio("median_home_value", "median_hh_income"),
        "fmr_gap_2br_vs_median_rent": F.col("fmr_2br") - F.col("median_gross_rent"),
        "rent50_gap_2br_vs_median_rent": F.col("rent50_2br") - F.col("median_gross_rent"),
        "permits_per_1000_housing_units": per_1000("permits_total_units", "hu_total"),
        "permits_per_1000_population": per_1000("permits_total_units", "pop_total"),
        "multifam_permits_per_1000_housing_units": per_1000("permits_multifam_units", "hu_total"),
        "pct_struct_multifam": sum0("pct_struct_small_mf", "pct_struct_mid_mf", "pct_struct_large_mf")})


def income_mart(pop: DataFrame, income: DataFrame, cainc1: DataFrame, cainc4: DataFrame) -> DataFrame:
    """Personal income per head with growth, wage share and survey income."""
    p = _panel(pop).select(*KEYS, "pop_total")
    pi = _panel(cainc1).select(*PANEL_KEYS, "pi_total").join(p.select(*PANEL_KEYS, "pop_total"), list(PANEL_KEYS))
    pi = pi.withColumn("calc_income_pc", ratio_or_null("pi_total", "pop_total"))
    pi = growth(pi, ENTITY, "year", "calc_income_pc", (1, 5, 10), prefix="income_pc", cagr=(5, 10)).drop("pop_total")
    inc = _panel(income).drop("geo_name").withColumnRenamed("per_capita_income", "acs_income_pc")
    out = join_on_spine(p, inc, pi, _panel(cainc4).select(*PANEL_KEYS, "pi_wages_salary"))
    return out.withColumn("pi_wage_share", ratio_or_null("pi_wages_salary", "pi_total"))


def gdp_mart(pop: DataFrame, nominal: DataFrame, real: DataFrame, labor: DataFrame) -> DataFrame:
    """Output in current and constant prices, per head and per worker, with 5-year growth."""
    g = lambda df, c, o: normalize_geo_key(_panel(df)).select(*PANEL_KEYS, F.col(c).alias(o))
    out = join_on_spine(_panel(pop).select(*KEYS, "pop_total"), g(nominal, "gdp_total", "nominal_gdp_total"),
                        g(real, "real_gdp_total", "real_gdp_total"), _panel(labor).select(*PANEL_KEYS, "employed"))
    out = out.withColumns({"nominal_gdp_pc": ratio_or_null("nominal_gdp_total", "pop_total"),
                           "real_gdp_pc": ratio_or_null("real_gdp_total", "pop_total"),
                           "productivity_index": ratio_or_null("real_gdp_total", "employed")})
    return growth_many(out, ENTITY, "year", {
        "nominal_gdp_total": "nominal_gdp", "nominal_gdp_pc": "nominal_gdp_pc", "real_gdp_total": "real_gdp",
        "real_gdp_pc": "real_gdp_pc", "productivity_index": "productivity"}, (5,))


def labor_mart(age: DataFrame, laus: DataFrame) -> DataFrame:
    """Participation, jobs per head and unemployment with their changes."""
    a = _panel(age).select(*KEYS, "pop_total", add_cols("age_15_17", *WORKING, *OVER_64).alias("working_age_pop"))
    out = join_on_spine(a, _panel(laus).select(*PANEL_KEYS, "labor_force", "employed", "unemployed", "unemployment_rate_percent"))
    out = out.withColumns({"lfpr": ratio_or_null("labor_force", "working_age_pop"),
                           "jobs_to_pop_ratio": ratio_or_null("employed", "pop_total"),
                           "pct_unemployment_rate": F.col("unemployment_rate_percent") / 100}).drop("unemployment_rate_percent")
    out = growth(out, ENTITY, "year", "lfpr", (5,))
    return level_change(out, ENTITY, "year", "pct_unemployment_rate", out="unemployment_rate_change_1yr")


# Output sectors of the industry mart and the accounts they add up.
SECTORS = {
    "natural_resources": ("real_gdp_natural_resources_all",), "manufacturing": ("real_gdp_manufacturing_all",),
    "construction": ("real_gdp_construction",), "trade": ("real_gdp_trade_all",),
    "transportation": ("real_gdp_transportation",), "information": ("real_gdp_information",),
    "fire": ("real_gdp_finance_insurance", "real_gdp_real_estate"),
    "professional": ("real_gdp_professional_scientific", "real_gdp_professional_management", "real_gdp_professional_admin_support"),
    "edu_health": ("real_gdp_education_all",), "leisure": ("real_gdp_arts_entertainment", "real_gdp_accomodation_food"),
    "gov": ("real_gdp_gov_enterprises",)}


def industry_mart(pop: DataFrame, employment: DataFrame, real_gdp: DataFrame) -> DataFrame:
    """Sector output and shares, concentration, and what the sectors leave unexplained.

    `employment` carries `ind_*` counts and `pct_ind_*` shares.
    """
    sector = normalize_geo_key(_panel(real_gdp)).select(*PANEL_KEYS, "real_gdp_total", *[
        add_cols(*parts).alias(f"__s_{s}") for s, parts in SECTORS.items()])
    sector = sector.withColumnsRenamed({f"__s_{s}": f"real_gdp_{s}" for s in SECTORS})
    sector = sector.withColumns({f"pct_real_gdp_{s}": ratio_or_null(f"real_gdp_{s}", "real_gdp_total") for s in SECTORS})
    emp = _panel(employment).drop("geo_name")
    emp = emp.withColumnsRenamed({c: c.replace("ind_", "acs_ind_", 1) for c in emp.columns if c.startswith(("ind_", "pct_ind_"))})
    shares = [c for c in emp.columns if c.startswith("pct_acs_ind_")]
    out = join_on_spine(_panel(pop).select(*KEYS, "pop_total"), emp, sector)
    out = residual(out, "real_gdp_total", [f"real_gdp_{s}" for s in SECTORS])
    out = out.withColumnsRenamed({"part_sum": "sector_sum", "residual": "calc_real_gdp_other", "coverage_ratio": "sector_sum_ratio",
                                  "pct_residual": "pct_calc_real_gdp_other"})
    flag = F.when(F.col("coverage_flag") == "over", "Sector Bug").when(F.col("coverage_flag").isNotNull(), "Non Bug")
    return out.withColumns({
        "industry_concentration_hhi": hhi(*[f"pct_real_gdp_{s}" for s in SECTORS], "pct_calc_real_gdp_other"),
        "acs_industry_concentration_hhi": hhi(*shares),
        "sector_sum_ratio_quality_flag": flag}).drop("coverage_flag")


def migration_mart(migration: DataFrame) -> DataFrame:
    """Mobility and nativity; IRS flow columns are typed placeholders."""
    m = _panel(migration)
    none = F.lit(None).cast("double")
    return m.withColumns({
        "mobility_rate": 1.0 - F.col("pct_same_house"),
        "pct_moved_domestic": sum0("pct_moved_same_cnty", "pct_moved_same_st", "pct_moved_diff_st"),
        "migration_churn": sum0("pct_moved_same_cnty", "pct_moved_same_st", "pct_moved_diff_st", "pct_moved_abroad"),
        "migration_churn_count": sum0("mig_moved_same_cnty", "mig_moved_same_st", "mig_moved_diff_st", "mig_moved_abroad"),
        "pct_foreign_born_citizen": safe_ratio("pop_foreign_born_citizen", "pop_nativity_total"),
        "pct_foreign_born_noncitizen": safe_ratio("pop_foreign_born_noncitizen", "pop_nativity_total"),
        **{c: none for c in ("irs_inflow_total", "irs_outflow_total", "irs_net_migration", "irs_net_migration_rate", "irs_migration_churn")}})


def transport_mart(transport: DataFrame, tracts: DataFrame) -> DataFrame:
    """Commuting plus built-form density of every level above the tract.

    `tracts` has one row per tract and year: tract_geoid, tract_name, year,
    pop_total, land_area_sqmi and the ids / names of its county, state and
    metro. One scan and one aggregation give all four levels.
    """
    levels = {"tract": ("tract_geoid", "tract_name"), "county": ("county_geoid", "county_name"),
              "state": ("state_fip", "state_abbr"), "cbsa": ("cbsa_code", "cbsa_name")}
    d = multi_level_rollup(tracts, {lv: p for lv, p in levels.items() if p[0] in tracts.columns}, ["year"],
                           densities("pop_total", "land_area_sqmi"))
    out = join_on_spine(_panel(transport), d)
    return out.withColumn("pct_low_car_commute", sum0("pct_commute_transit", "pct_commute_walk", "pct_commute_wfh"))


RPP = ("rpp_real_pc_income", "rpp_all_items", "rpp_price_deflator")


def affordability_mart(housing: DataFrame, income: DataFrame, rpp: DataFrame, county_cbsa: DataFrame,
                       county_state: DataFrame, order: Sequence[str] = ("cbsa", "direct", "state")) -> DataFrame:
    """Cost burden, income and price-adjusted income.

    Price parities exist for states and metros; `order` says which of the
    place's own, its metro's and its state's value is preferred.
    """
    r = normalize_geo_key(_panel(rpp)).filter(F.col("geo_level").isin("state", "cbsa")).select(*PANEL_KEYS, *RPP)
    r = dedupe_max(r, list(PANEL_KEYS), list(RPP))
    i = _panel(income)
    up = i.select(*PANEL_KEYS).join(county_cbsa.select(F.col("county_geoid").alias("geo_id"), F.col("cbsa_code").alias("__cbsa")), "geo_id", "left")
    up = up.join(county_state.select(F.col("county_geoid").alias("geo_id"), F.col("state_fip").alias("__st")), "geo_id", "left")
    county = F.col("geo_level") == "county"
    up = up.withColumns({"__cbsa": F.when(county, F.col("__cbsa")), "__st": F.when(county, F.col("__st")).otherwise(F.col("geo_id"))})
    own = {"geo_level": "geo_level", "geo_id": "geo_id", "year": "year"}
    at = lambda lv: r.filter(F.col("geo_level") == lv)
    up = hierarchy_backfill(up, {"direct": (r, own), "cbsa": (at("cbsa"), {"__cbsa": "geo_id", "year": "year"}),
                                 "state": (at("state"), {"__st": "geo_id", "year": "year"})}, RPP, order)
    up = up.select(*PANEL_KEYS, *RPP)
    h = _panel(housing)
    i = i.select(*[c for c in i.columns if c not in h.columns or c in KEYS])
    out = join_on_spine(h, i, up)
    return out.withColumns({
        "rent_to_rpp_income": safe_ratio(F.col("median_gross_rent") * 12.0, "rpp_real_pc_income"),
        "value_to_rpp_income": safe_ratio("median_home_value", "rpp_real_pc_income")})


def school_source_table(schools: DataFrame, allocations: DataFrame, need: DataFrame, district_keys: Sequence[str], enrollment: str) -> DataFrame:
    """One row per district: schools counted, Title I money and need report joined.

    -999 marks a suppressed value. Identifiers lose the leading apostrophe.
    """
    d = schools.withColumns({k: F.regexp_replace(F.col(k).cast("string"), "^'+", "") for k in district_keys})
    d = d.groupBy(*district_keys).agg(F.count(F.lit(1)).alias("number_of_schools"), F.avg(enrollment).alias("avg_school_enrollment"),
                                      F.sum(enrollment).alias("enrollment"))
    n = need.withColumns({c: F.when(F.col(c) != -999, F.col(c)) for c in need.columns if c.endswith(("_percent", "_count"))})
    n = n.withColumn("economically_disadvantaged_percent", 100 - F.col("not_economically_disadvantaged_percent"))
    return d.join(allocations, district_keys[0], "left").join(n, district_keys[0], "left")


# Weights of the district lead score and its growth adjustment by quartile.
LEAD_WEIGHTS = {"enrollment_pct_rank": 0.30, "student_allocation_pct_rank": 0.30, "economic_disadvantaged_pct_rank": 0.20,
                "child_poverty_pct_rank": 0.20}
GROWTH_BOOST = {1: -5.0, 2: 0.0, 3: 2.0, 4: 5.0}


def school_district_mart(districts: DataFrame, acs: DataFrame, district_id: str = "nces_district_id") -> DataFrame:
    """Lead score of school districts: percentiles re-weighted over what is known,
    adjusted by population-growth quartile, and ranked."""
    a = growth(_panel(acs), ["geo_id"], "year", "population", (5,), cagr=())
    a = a.withColumnRenamed("geo_id", district_id).filter(F.col("year") == a.select(F.max("year")).scalar()).drop("geo_level", "geo_name", "year")
    j = districts.withColumn("allocations_per_student", F.round(ratio_or_null("title_1_allocations", "enrollment"), 2)).join(a, district_id)
    ids = [district_id]
    j = ranked_columns(j, ids, {
        "enrollment_pct_rank": pct_rank("enrollment"), "student_allocation_pct_rank": pct_rank("allocations_per_student"),
        "child_poverty_pct_rank": pct_rank("child_poverty_rate"),
        "economic_disadvantaged_pct_rank": pct_rank("economically_disadvantaged_percent", keep_nulls=False),
        "population_growth_pct_rank": pct_rank("population_growth_5yr", keep_nulls=False),
        "pop_growth_quartile": equal_buckets("population_growth_5yr", 4)})
    boost = F.lit(0.0)
    for q, b in GROWTH_BOOST.items():
        boost = F.when(F.col("pop_growth_quartile") == q, F.lit(b)).otherwise(boost)
    j = j.withColumn("lead_score", reweighted_score(LEAD_WEIGHTS, 100)).withColumn("lead_score_growth_boost", F.col("lead_score") + boost)
    j = j.withColumns({"__a": F.round("lead_score", 9), "__b": F.round("lead_score_growth_boost", 9)})
    j = ranked_columns(j, ids, {"lead_score_rank": min_rank("__a"), "lead_score_growth_boost_rank": min_rank("__b")})
    return j.drop("__a", "__b")


def growth_study(panel: DataFrame, permits: DataFrame, meta: DataFrame, metric: str = "pop_cagr_5yr", region: str = "South") -> DataFrame:
    """Metro growth study at the latest year: permits per 1,000 (annual and complete
    5-year mean), unemployment change, and ranks over the nation, the class and
    the class within the region."""
    p = growth(_panel(panel), ENTITY, "year", "pop_total", (5,), prefix="pop")
    p = level_change(p, ENTITY, "year", "unemployment_rate", 5, "unemp_rate_chg_5y")
    annual = permits.groupBy("geo_id", "year").agg(F.sum("units").alias("permits_units"))
    p = p.join(annual, ["geo_id", "year"], "left").withColumn("units_per_1k", safe_ratio(F.col("permits_units") * 1000.0, "pop_total"))
    p = rolling_mean(p, ENTITY, "year", "units_per_1k", 5, "units_per_1k_5y_avg", strict=True)
    last = p.filter((F.col("year") == p.select(F.max("year")).scalar()) & F.col(metric).isNotNull()).join(meta, "geo_id")
    last = store(last.withColumn("in_region", F.col("region") == region))
    wanted = {}
    for name, group in (("nat_all", []), ("nat_in_type", ["cbsa_type"]), ("reg_in_type", ["cbsa_type", "in_region"])):
        wanted |= {f"{name}_rank": min_rank(metric, group), f"{name}_pct": pct_rank(metric, group)}
    q = ranked_columns(last, ["geo_id"], wanted | {"growth_q5": equal_buckets(metric, 5, ["in_region"])})
    return q.withColumn("growth_q5", F.when(F.col("in_region"), F.col("growth_q5")))


def constant_membership_overview(counties: DataFrame, xwalk: DataFrame, values: Mapping[str, str], medians: Mapping[str, str],
                                 pop: str = "pop_total", horizons: Sequence[int] = (5, 10)) -> DataFrame:
    """Metro series rebuilt from a fixed set of counties, so that boundary changes
    do not show up as growth. `values` maps a summed county column to its prefix,
    `medians` a column to the output of its population-weighted median."""
    c = counties.join(xwalk.select(F.col("county_geoid").alias("geo_id"), "cbsa_code"), "geo_id")
    keys = ["cbsa_code", "year"]
    out = c.groupBy(*keys).agg(F.coalesce(F.sum(pop), F.lit(0.0)).alias(pop), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])
    for col, name in medians.items():
        out = out.join(weighted_median(c, keys, col, pop, name), keys, "left")
    out = out.withColumns({f"{p}_pc": ratio_or_null(v, pop) for v, p in values.items()})
    prefixes = {pop: "pop", **dict(values), **{f"{p}_pc": f"{p}_pc" for p in values.values()}}
    return growth_many(out, ["cbsa_code"], "year", prefixes, horizons)


def real_income(income: DataFrame, cbsa_rpp: DataFrame, state_rpp: DataFrame, counties: DataFrame) -> DataFrame:
    """Income at regional prices and how it changes each metro's rank.

    A metro belongs to the state of its largest county (`counties`: cbsa_code,
    cbsa_type, state_fips, county_geoid, pop_total).
    """
    meta = latest_per_key(counties.select("cbsa_code", "pop_total", "county_geoid", "cbsa_type", "state_fips"), ["cbsa_code"],
                          ["pop_total", "county_geoid"]).select(F.col("cbsa_code").alias("geo_id"), "cbsa_type", "state_fips")
    i = income.join(meta, "geo_id", "left")
    i = i.join(cbsa_rpp.select("geo_id", "period", F.col("rpp_all_items").alias("__c")), ["geo_id", "period"], "left")
    i = i.join(state_rpp.select("state_fips", "period", F.col("rpp_all_items").alias("__s")), ["state_fips", "period"], "left")
    i = i.withColumn("rpp_all_items", F.coalesce("__c", "__s")).drop("__c", "__s")
    i = i.withColumn("real_pc_income", ratio_or_null("pi_per_capita", F.col("rpp_all_items") / 100))
    i = i.withColumn("pc_real_change", ratio_or_null(F.col("real_pc_income") - F.col("pi_per_capita"), "pi_per_capita"))
    g = ["cbsa_type", "period"]
    i = ranked_columns(i, ["geo_id", "period"], {
        "lowest_rpp_rank": min_rank("rpp_all_items", g, descending=False), "nominal_pc_income_rank": min_rank("pi_per_capita", g),
        "real_pc_income_rank": min_rank("real_pc_income", g)})
    return i.withColumn("pc_real_rank_change", F.col("real_pc_income_rank") - F.col("nominal_pc_income_rank"))


