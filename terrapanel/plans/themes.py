"""Survey themes as tables of column names: what is added up, what is averaged,
which source columns form a bucket and which ratios are published.

All names below are fixed values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Theme:
    sums: str                                              # columns added up for a metro
    weighted: Mapping[str, str] = field(default_factory=dict)   # column -> weight column
    buckets: Mapping[str, Sequence[str]] = field(default_factory=dict)  # output -> source columns
    less: Mapping[str, tuple[str, str]] = field(default_factory=dict)   # output -> (a, b): a - b
    at_least_0: Sequence[str] = ()                         # differences that cannot be negative
    shares: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # output -> (numerator, denominator)
    diversity: Sequence[str] = ()                          # shares of the diversity index


def _e(*names: str) -> tuple[str, ...]:
    return tuple(f"{n}E" for n in names)


def _both(pattern: str, *ages: str) -> tuple[str, ...]:
    return tuple(f"{pattern.format(sex=s)}{a}E" for s in ("male", "female") for a in ages)


def _age(*ages: str) -> tuple[str, ...]:
    return _both("pop_age_{sex}_", *ages)


AGE_BUCKETS = {
    "age_0_4": _age("under5"), "age_5_14": _age("5_9", "10_14"), "age_15_17": _age("15_17"),
    "age_18_24": _age("18_19", "20", "21", "22_24"), "age_25_34": _age("25_29", "30_34"),
    "age_35_44": _age("35_39", "40_44"), "age_45_54": _age("45_49", "50_54"),
    "age_55_64": _age("55_59", "60_61", "62_64"), "age_65_74": _age("65_66", "67_69", "70_74"),
    "age_75_84": _age("75_79", "80_84"), "age_85p": _age("85_plus"),
    "age_25_54": _age("25_29", "30_34", "35_39", "40_44", "45_49", "50_54")}

OCCUPATIONS = ("mgmt_business_sci_arts", "service", "sales_office", "nat_resources_const_maint", "prod_transp_material")
INDUSTRIES = {
    "ag_mining": "ag_mining", "construction": "construction", "manufacturing": "manufacturing", "wholesale": "wholesale",
    "retail": "retail", "transport_util": "transport_util", "information": "information", "finance_real": "finance_real",
    "professional": "professional", "educ_health": "educ_health", "arts_accomm_food": "arts_accomm_food",
    "other_services": "other", "public_admin": "public_admin"}
INSURED = ("u19", "19_34", "35_64", "65u")
RACES = {"white_nh": "white_nonhisp", "black_nh": "black_nonhisp", "aian_nh": "amind_nonhisp", "asian_nh": "asian_nonhisp",
         "nhpi_nh": "pacisl_nonhisp", "other_nh": "other_nonhisp", "two_plus_nh": "two_plus_nonhisp", "hispanic": "hispanic_any"}

THEMES = {
    "age": Theme(
        sums="^pop", weighted={"median_age.E": "pop_totalE"},
        buckets={"pop_total": _e("pop_total"), "median_age": ("median_age.E",), **AGE_BUCKETS,
                 "__young": ("age_0_4", "age_5_14"), "__old": ("age_65_74", "age_75_84", "age_85p")},
        shares={**{f"pct_{b}": (b, "pop_total") for b in AGE_BUCKETS}, "aging_index": ("__old", "age_0_4"),
                "youth_dependency": ("__young", "age_25_54"), "old_age_dependency": ("__old", "age_25_54")}),
    "edu": Theme(
        sums="edu",
        buckets={"edu_total_25p": _e("edu_total_25p"),
                 "lt_hs_25p": _e("edu_no_schooling", "edu_nursery", "edu_kindergarten", *[f"edu_grade{k}" for k in range(1, 12)], "edu_grade12_no_diploma"),
                 "hs_ged_25p": _e("edu_hs_diploma", "edu_ged_alt_credential"),
                 "somecol_assoc_25p": _e("edu_some_college_lt1yr", "edu_some_college_ge1yr", "edu_associates"),
                 "ba_25p": _e("edu_bachelors"), "ma_plus_25p": _e("edu_masters", "edu_professional", "edu_doctorate")},
        shares={f"pct_{b}": (b, "edu_total_25p") for b in ("lt_hs_25p", "hs_ged_25p", "somecol_assoc_25p", "ba_25p", "ma_plus_25p")}),
    "housing": Theme(
        sums="^(rent_|struct_|hu_total|occ_|tenure_total|owner_occ|renter_occ)",
        weighted={f"median_{m}E": "hu_totalE" for m in ("gross_rent", "home_value", "owner_costs_mortgage", "owner_costs_no_mortgage")},
        buckets={**{c: _e(c) for c in ("hu_total", "occ_total", "occ_occupied", "occ_vacant", "tenure_total", "owner_occupied", "renter_occupied",
                                       "median_gross_rent", "median_home_value", "median_owner_costs_mortgage", "median_owner_costs_no_mortgage",
                                       "rent_burden_total", "struct_total", "struct_mobile")},
                 "rent_burden_30plus": _e("rent_30_34", "rent_35_39", "rent_40_49", "rent_50_plus"), "rent_burden_50plus": _e("rent_50_plus"),
                 "struct_1_unit": _e("struct_1_det", "struct_1_att"), "struct_sf_det": _e("struct_1_det"),
                 "struct_small_mf": _e("struct_2_units", "struct_3_4_units"), "struct_mid_mf": _e("struct_5_9_units", "struct_10_19"),
                 "struct_large_mf": _e("struct_20_49", "struct_50_plus")},
        less={"__rent_denom": ("rent_burden_totalE", "rent_not_computedE")}, at_least_0=("__rent_denom",),
        shares={"vacancy_rate": ("occ_vacant", "hu_total"), "occupancy_rate": ("occ_occupied", "hu_total"),
                "owner_occ_rate": ("owner_occupied", "tenure_total"), "renter_occ_rate": ("renter_occupied", "tenure_total"),
                "pct_rent_burden_30plus": ("rent_burden_30plus", "__rent_denom"), "pct_rent_burden_50plus": ("rent_burden_50plus", "__rent_denom"),
                **{f"pct_struct_{s}": (f"struct_{s}", "struct_total") for s in ("1_unit", "sf_det", "small_mf", "mid_mf", "large_mf", "mobile")}}),
    "income": Theme(
        sums="^(hh_inc_|pov_)",
        weighted={"median_hh_incomeE": "hh_inc_totalE", "per_capita_incomeE": "pov_universeE", "gini_indexE": "pov_universeE"},
        buckets={**{c: _e(c) for c in ("median_hh_income", "per_capita_income", "pov_universe", "pov_below", "gini_index")},
                 "__hh": _e("hh_inc_total"), "__lt25": _e("hh_inc_lt10k", "hh_inc_10k_15k", "hh_inc_15k_20k", "hh_inc_20k_25k"),
                 "__25_50": _e("hh_inc_25k_30k", "hh_inc_30k_35k", "hh_inc_35k_40k", "hh_inc_40k_45k", "hh_inc_45k_50k"),
                 "__50_100": _e("hh_inc_50k_60k", "hh_inc_60k_75k", "hh_inc_75k_100k"),
                 "__100": _e("hh_inc_100k_125k", "hh_inc_125k_150k", "hh_inc_150k_200k", "hh_inc_200k_plus")},
        shares={"pov_rate": ("pov_below", "pov_universe"), "pct_hh_lt25k": ("__lt25", "__hh"), "pct_hh_25k_50k": ("__25_50", "__hh"),
                "pct_hh_50k_100k": ("__50_100", "__hh"), "pct_hh_100k_plus": ("__100", "__hh")}),
    "labor": Theme(
        sums="^(pop_16|in_|not_in|employed|occ_|ind_)",
        buckets={**{c: _e(c) for c in ("pop_16plus", "in_labor_force", "in_lf_civilian", "in_lf_armed_forces", "not_in_labor_force", "employed")},
                 "occ_total_emp": _e("occ_total"), **{f"occ_{o}": _both("occ_{sex}_", o) for o in OCCUPATIONS},
                 "ind_total_emp": _e("ind_total"), **{f"ind_{i}": _both("ind_{sex}_", src) for i, src in INDUSTRIES.items()}},
        less={"unemployed": ("in_labor_forceE", "employedE")},
        shares={"lfpr": ("in_labor_force", "pop_16plus"), "unemp_rate": ("unemployed", "in_labor_force"),
                "emp_pop_ratio": ("employed", "pop_16plus"), "unemp_rate_civ": ("unemployed", "in_lf_civilian"),
                **{f"pct_occ_{o}": (f"occ_{o}", "occ_total_emp") for o in OCCUPATIONS},
                **{f"pct_ind_{i}": (f"ind_{i}", "ind_total_emp") for i in INDUSTRIES}}),
    "migration": Theme(
        sums="^(mig_|pop_)",
        buckets={c: _e(c) for c in ("mig_total", "mig_same_house", "mig_moved_same_cnty", "mig_moved_same_st", "mig_moved_diff_st",
                                    "mig_moved_abroad", "pop_nativity_total", "pop_native", "pop_foreign_born", "pop_foreign_born_citizen")},
        less={"pop_foreign_born_noncitizen": ("pop_foreign_bornE", "pop_foreign_born_citizenE")},
        shares={**{f"pct_{m}": (f"mig_{m}", "mig_total") for m in ("same_house", "moved_same_cnty", "moved_same_st", "moved_diff_st", "moved_abroad")},
                "pct_native": ("pop_native", "pop_nativity_total"), "pct_foreign_born": ("pop_foreign_born", "pop_nativity_total"),
                "pct_non_citizen": ("pop_foreign_born_noncitizen", "pop_nativity_total")}),
    "race": Theme(
        sums="(_b03002|nonhisp|hispanic)",
        buckets={"race_total": _e("pop_total_b03002"), **{f"race_{r}": _e(src) for r, src in RACES.items()}},
        shares={f"pct_{r}": (f"race_{r}", "race_total") for r in RACES}, diversity=tuple(f"pct_{r}" for r in RACES)),
    "transport": Theme(
        sums="^(commute_|veh_|total_travel)",
        buckets={**{f"commute_{c}": _e(f"commute_{c}") for c in ("workers_total", "car_truck_van", "drove_alone", "carpool", "public_trans", "taxicab",
                                                                 "motorcycle", "bicycle", "walked", "other", "worked_home")},
                 **{f"veh_{v}": _e(f"veh_{v}") for v in ("total_hh", "0", "1", "2", "3", "4_plus")}, "total_travel_time": _e("total_travel_time")},
        shares={"mean_travel_time": ("total_travel_time", "commute_workers_total"),
                "pct_commute_drive_alone": ("commute_drove_alone", "commute_workers_total"), "pct_commute_carpool": ("commute_carpool", "commute_workers_total"),
                "pct_commute_transit": ("commute_public_trans", "commute_workers_total"), "pct_commute_walk": ("commute_walked", "commute_workers_total"),
                "pct_commute_wfh": ("commute_worked_home", "commute_workers_total"),
                **{f"pct_hh_{k}_vehicles": (f"veh_{v}", "veh_total_hh") for k, v in (("0", "0"), ("1", "1"), ("2", "2"), ("3", "3"), ("4p", "4_plus"))}}),
    "social_infra": Theme(
        sums="^(hh_|ins_)",
        buckets={**{c: _e(c) for c in ("hh_total", "hh_family", "hh_married", "hh_other_family", "hh_nonfamily", "hh_nonfam_alone", "hh_nonfam_not_alone", "ins_total")},
                 "single_households": _e("hh_nonfam_alone"),
                 **{f"ins_{a}_total": _e(f"ins_{a}_one_plan", f"ins_{a}_two_plans", f"ins_{a}_uncovered") for a in INSURED},
                 **{f"ins_{a}_covered": _e(f"ins_{a}_one_plan", f"ins_{a}_two_plans") for a in INSURED},
                 **{f"ins_{a}_uncovered": _e(f"ins_{a}_uncovered") for a in INSURED},
                 "ins_uninsured": _e(*[f"ins_{a}_uncovered" for a in INSURED])},
        less={"ins_insured": ("ins_total", "ins_uninsured")},
        shares={"pct_hh_family": ("hh_family", "hh_total"), "pct_hh_married": ("hh_married", "hh_total"), "pct_hh_other_family": ("hh_other_family", "hh_total"),
                "pct_hh_nonfamily": ("hh_nonfamily", "hh_total"), "pct_single_households": ("single_households", "hh_total"),
                "pct_nonfamily_alone": ("hh_nonfam_alone", "hh_nonfamily"), "pct_nonfamily_not_alone": ("hh_nonfam_not_alone", "hh_nonfamily"),
                "pct_health_insured": ("ins_insured", "ins_total"), "pct_health_uninsured": ("ins_uninsured", "ins_total"),
                **{f"pct_{a}_{k}": (f"ins_{a}_{k}", f"ins_{a}_total") for a in INSURED for k in ("covered", "uncovered")}}),
}

# Regional-account line codes and the metric each one holds.
GDP_LINES = {
    1: "total", 2: "private", 3: "agriculture", 6: "mining", 10: "utilities", 11: "construction", 12: "manufacturing_all",
    13: "durable_manufacturing", 25: "nondurable_manufacturing", 34: "wholesale_trade", 35: "retail_trade", 36: "transportation",
    45: "information", 50: "finance_real_estate_all", 51: "finance_insurance", 56: "real_estate", 59: "professional_all",
    60: "professional_scientific", 64: "professional_management", 65: "professional_admin_support", 68: "education_all",
    69: "education", 70: "health", 75: "arts_food_all", 76: "arts_entertainment", 79: "accomodation_food", 82: "other",
    83: "gov_enterprises", 87: "natural_resources_all", 88: "trade_all", 89: "transport_utilities_all", 90: "manufacturing_info_all",
    91: "private_goods_producing_industries", 92: "private_services_providing_industries"}
LINE_METRICS = {
    "CAINC1": {1: "pi_total", 2: "population", 3: "pi_per_capita"},
    "CAINC4": {
        10: "pi_total", 11: "pi_nonfarm", 12: "pi_farm", 20: "population", 30: "pi_per_capita", 35: "pi_earnings_workplace",
        36: "pi_contrib_social_insurance", 37: "pi_employee_contrib_social_insurance", 38: "pi_employer_contrib_social_insurance",
        42: "pi_residence_adjustment", 45: "pi_net_earnings_residence", 46: "pi_dividends_interest_rent", 47: "pi_transfer_receipts",
        50: "pi_wages_salary", 60: "pi_supplements_wages_salary", 61: "pi_employer_pension_insurance", 62: "pi_employer_social_insurance",
        70: "pi_proprietors", 71: "pi_farm_proprietors", 72: "pi_nonfarm_proprietors"},
    "CAGDP2": {k: f"gdp_{v}" for k, v in GDP_LINES.items()},
    "CAGDP9": {k: f"real_gdp_{v}" for k, v in GDP_LINES.items()},
    "MARPP": {1: "rpp_real_personal_income", 2: "rpp_real_pc_income", 3: "rpp_all_items", 4: "rpp_goods", 5: "rpp_services_rents",
              6: "rpp_services_utilities", 7: "rpp_services_other", 8: "rpp_price_deflator"},
    "SARPP": {1: "rpp_real_personal_income", 2: "rpp_real_pc_income", 3: "rpp_real_consumption", 4: "rpp_real_pc_consumption",
              5: "rpp_all_items", 6: "rpp_goods", 7: "rpp_services_rents", 8: "rpp_services_utilities", 9: "rpp_services_other",
              10: "rpp_price_deflator"}}
LINE_TOPICS = {"CAINC1": "income", "CAINC4": "income", "CAGDP2": "gdp", "CAGDP9": "gdp", "MARPP": "prices"}
WIDE_TABLES = ("CAINC1", "CAGDP2", "CAGDP9", "MARPP", "SARPP")
