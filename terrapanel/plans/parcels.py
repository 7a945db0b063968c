"""Parcels: standardising, lineage, retail intensity, zone overlay and shortlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.columns import days_since, month_start, pad_zeros
from terrapanel.functions.nulls import asc_last, desc_last, ratio_or_null, safe_ratio
from terrapanel.operators.joins import zero_filled_right
from terrapanel.operators.ordered import column_quantiles, down, row_numbers, up
from terrapanel.operators.quality import validation_row, validation_rows, validation_suite
from terrapanel.operators.ranking import percentiles_of
from terrapanel.operators.select import first_per_key, latest_per_key
from terrapanel.operators.stats import winsorize
from terrapanel.session import store
from terrapanel.sources.files import read_with_aliases

SQFT_PER_SQMI = 27878400.0


def county_name_key(name: str):
    """County name as letters and digits without a trailing 'county'."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), "county$", "")


def land_use_code(code: str):
    """Code of at least three digits; longer codes stay whole."""
    return pad_zeros(F.trim(F.col(code).cast("string")), 3)


# column names under which county files hold a field; fixed values
PARCEL_ALIASES = {
    "census_block_id": ("census_bk", "census_block_id", "block_geoid", "blockid"), "parcel_id": ("parcel_id", "parcelid", "parid"),
    "alt_key": ("alt_key", "altkey", "alternate_id"), "county_code": ("co_no", "county", "county_code"), "use_code": ("dor_uc", "pa_uc", "use_code"),
    "owner_name": ("own_name", "owner_name"), "owner_addr": ("own_addr1", "owner_addr"), "phys_addr": ("phy_addr1", "phys_addr", "site_address"),
    "just_value": ("jv",), "land_value": ("lnd_val", "land_value"), "impro_value": ("nconst_val", "impro_value"), "total_value": ("del_val", "total_value"),
    "living_area_sqft": ("tot_lvg_area", "living_area_sqft"), "sale_qual_code": ("qual_cd1", "qual_cd2", "sale_qual_code", "sale_qual1"),
    "sale_price1": ("sale_prc1", "sale_price1"), "sale_yr1": ("sale_yr1", "sale_year1"), "sale_mo1": ("sale_mo1", "sale_month1")}
_NUMBERS = ("just_value", "land_value", "impro_value", "total_value", "living_area_sqft", "sale_price1")


def parcel_cleanup(raw: DataFrame, order: str, keep: Sequence[str] = ()) -> DataFrame:
    """A county's parcel file under standard names: numbers parsed, keys in upper case, one row per key.

    `join_key` is the parcel id, else the alternate key. Of rows with the same
    key the one with the smallest `order` (a number, such as the line of the
    file) stays; rows without a key all stay. `keep` names further columns.
    """
    casts = {**dict.fromkeys(_NUMBERS, "number"), "sale_yr1": "integer", "sale_mo1": "integer", "__order": "number"}
    p = read_with_aliases(raw, {**PARCEL_ALIASES, "__order": (order,), **{c: (c,) for c in keep}}, casts)
    p = p.withColumns({"parcel_id": F.upper("parcel_id"), "alt_key": F.upper("alt_key"), "sale_qual_code": pad_zeros(F.col("sale_qual_code"), 2)})
    p = p.withColumn("join_key", F.coalesce("parcel_id", "alt_key"))
    keyed = first_per_key(p.filter(F.col("join_key").isNotNull()), ["join_key"], ["__order"])
    return keyed.unionByName(p.filter(F.col("join_key").isNull())).drop("__order")


def parcels_canonical(raw: DataFrame, counties: DataFrame, land_use: DataFrame) -> DataFrame:
    """Parcels of market counties with one identifier, typed values, sale date and
    land-use class.

    `counties`: market_key, cbsa_code, state_abbr, county_geoid, county_name. Only
    counties that have parcels match, by state and name key.
    """
    c = counties.select("market_key", "cbsa_code", "county_geoid", F.upper(F.trim("state_abbr")).alias("state_abbr"),
                        county_name_key("county_name").alias("county_name_key"), F.col("county_name").alias("market_county_name"))
    p = raw.withColumns({"state_abbr": F.upper(F.trim("state")), "county_name_key": county_name_key("county_name"),
                         "join_key": F.trim(F.col("join_key").cast("string")), "land_use_code": land_use_code("use_code"),
                         "census_block_id": F.nullif(F.trim("census_block_id"), F.lit(""))})
    p = p.join(c, ["state_abbr", "county_name_key"])
    p = p.withColumns({
        "parcel_uid": F.concat_ws("::", "county_code", "join_key"),
        "last_sale_date": month_start("sale_yr1", "sale_mo1"),
        "qa_missing_join_key": F.col("join_key").isNull() | (F.col("join_key") == ""),
        "qa_zero_county": F.coalesce(F.col("county_code").isin("", "0"), F.lit(True))})
    lu = land_use.select(land_use_code("land_use_code").alias("land_use_code"), F.col("category").alias("land_use_category"),
                         F.col("retail_flag").alias("__r"), F.col("retail_subtype").alias("__s"))
    p = p.join(lu, "land_use_code", "left")
    retail = F.coalesce("__r", F.lit(False))
    return p.withColumns({
        "retail_flag": retail,
        "retail_subtype": F.when(retail & F.col("__s").isNull(), "retail_uncategorized").otherwise(F.col("__s")),
        "parcel_segment": F.when(retail, "Retail parcel").otherwise("Residential/other parcel")}).drop("__r", "__s", "state", "sale_yr1", "sale_mo1", "use_code")


def parcel_lineage(counties: DataFrame, load_log: DataFrame, parcels: DataFrame) -> DataFrame:
    """Per market county: its latest load and what was published."""
    log = load_log.withColumns({"state_abbr": F.upper(F.trim("state")), "county_name_key": county_name_key("county_name")}).drop("state", "county_name")
    log = latest_per_key(log, ["state_abbr", "county_name_key"], ["load_completed_at", "generated_at", "ingest_run_id"])
    per = parcels.groupBy("market_key", "county_geoid", "parcel_uid").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("market_key", "county_geoid").agg(F.sum("n").alias("parcel_rows"), F.count("parcel_uid").alias("distinct_parcels"))
    c = counties.withColumns({"state_abbr": F.upper(F.trim("state_abbr")), "county_name_key": county_name_key("county_name")})
    out = c.join(log, ["state_abbr", "county_name_key"], "left").join(counts, ["market_key", "county_geoid"], "left")
    return out.withColumn("lineage_source", F.when(F.col("load_status").isNotNull(), "county load log").otherwise("market counties only"))


def unmapped_use_codes(parcels: DataFrame, land_use: DataFrame) -> DataFrame:
    known = land_use.select(land_use_code("land_use_code").alias("land_use_code")).distinct()
    return parcels.filter(F.col("land_use_code").isNotNull()).join(known, "land_use_code", "left_anti").groupBy("land_use_code").agg(
        F.count(F.lit(1)).alias("parcel_count"))


def parcel_validation(parcels: DataFrame, lineage: DataFrame, land_use: DataFrame, max_unmatched: float = 0.02) -> DataFrame:
    """Validation results that decide whether the layer may be published."""
    zero = F.col("metric_value") == 0
    canon, line = "parcel.parcels_canonical", "parcel.parcel_lineage"
    hits = lambda cond: F.count(F.when(cond, 1))
    per = parcels.groupBy("parcel_uid").agg(
        F.count(F.lit(1)).alias("n"), hits(F.col("qa_missing_join_key")).alias("no_key"),
        hits(F.col("county_geoid").isNull() | (F.col("county_geoid") == "")).alias("no_county"))
    return validation_suite([
        *validation_rows(per, [
            ("parcel_canonical_unique_parcel_uid", "error", canon, F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), zero, "Duplicate parcel_uid rows"),
            ("parcel_canonical_missing_join_key", "error", canon, F.coalesce(F.sum("no_key"), F.lit(0)), zero, "Rows with missing join_key"),
            ("parcel_canonical_missing_county_geoid", "error", canon, F.coalesce(F.sum("no_county"), F.lit(0)), zero, "Rows with missing county_geoid")]),
        validation_row(unmapped_use_codes(parcels, land_use), "parcel_land_use_mapping_unmapped_codes", "error", "parcel.retail_parcels", F.count(F.lit(1)), zero, "Distinct unmapped land_use_code values"),
        *validation_rows(lineage, [
            ("parcel_join_qa_missing_counties", "error", line, hits(F.col("load_status").isNull()), zero, "Counties without load lineage"),
            ("parcel_join_qa_high_unmatched_rate_counties", "warning", line, hits(F.col("unmatched_rate") > max_unmatched), zero, "Counties above the unmatched limit"),
            ("parcel_lineage_zero_parcel_counties", "warning", line, hits(F.coalesce("distinct_parcels", F.lit(0)) == 0), zero, "Counties without parcels")])])


def duplicate_profile(parcels: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many keys occur once, twice, ... per county tag."""
    per = parcels.groupBy("county_tag", *key).agg(F.count(F.lit(1)).alias("copies"))
    return per.groupBy("county_tag", "copies").agg(F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("rows"))


def geometry_join_qa(parcels: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """Share of parcels per county without a shape of the same key."""
    s = shapes.select(F.col(key)).distinct().withColumn("__hit", F.lit(1))
    j = parcels.join(s, key, "left")
    return j.groupBy("county_tag").agg(F.count(F.lit(1)).alias("total_rows"), F.count(F.when(F.col("__hit").isNull(), 1)).alias("unmatched_rows")).withColumn(
        "unmatched_rate", ratio_or_null("unmatched_rows", "total_rows"))


def retail_intensity(assigned: DataFrame, tracts: DataFrame) -> DataFrame:
    """Retail parcels and area per tract, every tract kept, with percentiles and a
    context score. `assigned`: parcel_uid, tract_geoid, parcel_area_sqmi."""
    per = assigned.groupBy("tract_geoid", "parcel_uid").agg(F.sum("parcel_area_sqmi").alias("a"))
    agg = per.groupBy("tract_geoid").agg(F.count(F.lit(1)).alias("retail_parcel_count"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("retail_area"))
    out = zero_filled_right(agg, tracts.select("tract_geoid", "tract_land_area_sqmi"), ["tract_geoid"], ["retail_parcel_count", "retail_area"])
    out = store(out.withColumn("retail_area_density", safe_ratio("retail_area", "tract_land_area_sqmi")))
    out = percentiles_of(out, ["tract_geoid"], [], {"retail_parcel_count": "pctl_tract_retail_parcel_count",
                                                    "retail_area_density": "pctl_tract_retail_area_density"}, fill=0.5)
    return out.withColumn("local_retail_context_score", 0.5 * F.col("pctl_tract_retail_parcel_count") + 0.5 * F.col("pctl_tract_retail_area_density"))


def zone_quality(zones: DataFrame) -> DataFrame:
    """Percentile of each zone's mean score (0.5 when unknown)."""
    return percentiles_of(zones, ["zone_id"], [], {"mean_tract_score": "zone_quality_score"}, fill=0.5)


def zone_overlay(tract_zone: DataFrame, intensity: DataFrame, quality: DataFrame) -> DataFrame:
    """Retail counts, area and context per zone beside the zone's quality."""
    j = tract_zone.select("tract_geoid", "zone_id", "zone_label").distinct().join(intensity, "tract_geoid", "left")
    agg = j.groupBy("zone_id", "zone_label").agg(
        F.count(F.lit(1)).alias("tracts"), F.coalesce(F.sum("retail_parcel_count"), F.lit(0)).alias("retail_parcel_count"),
        F.coalesce(F.sum("retail_area"), F.lit(0.0)).alias("retail_area"), F.coalesce(F.sum("tract_land_area_sqmi"), F.lit(0.0)).alias("tract_land_area_sqmi"),
        F.avg("local_retail_context_score").alias("local_retail_context_score"))
    agg = agg.withColumn("retail_area_density", safe_ratio("retail_area", "tract_land_area_sqmi"))
    return agg.join(quality.select("zone_id", "mean_tract_score", "zone_quality_score"), "zone_id", "left")


def parcel_shortlist(assigned: DataFrame, parcels: DataFrame, tract_zone: DataFrame, intensity: DataFrame, quality: DataFrame, as_of: str) -> DataFrame:
    """Retail parcels in zones scored by zone quality, local context and the
    parcel itself, ranked overall and within the zone."""
    p = assigned.select("parcel_uid", "tract_geoid").join(tract_zone.select("tract_geoid", "zone_id", "zone_label"), "tract_geoid")
    p = p.join(parcels, "parcel_uid").join(intensity.select("tract_geoid", "local_retail_context_score"), "tract_geoid", "left")
    p = p.join(quality.select("zone_id", "mean_tract_score", "zone_quality_score"), "zone_id", "left")
    sqft = F.col("parcel_area_sqmi") * SQFT_PER_SQMI
    p = store(p.withColumn("assessed_value_psf", F.when((F.col("just_value") > 0) & (sqft >= 1000), F.col("just_value") / sqft)))
    p = winsorize(p, "assessed_value_psf", 0.05, 0.95, out="assessed_value_psf_winsorized").withColumnRenamed("bound_flag", "winsor_flag")
    p = p.withColumn("sale_recency_days", days_since("last_sale_date", as_of)).withColumn("__recent", -F.col("sale_recency_days"))
    p = percentiles_of(p, ["parcel_uid"], [], {"assessed_value_psf_winsorized": "pctl_assessed_value_psf", "parcel_area_sqmi": "pctl_parcel_area",
                                               "__recent": "pctl_sale_recency"}, fill=0.5).drop("__recent")
    p = p.withColumn("parcel_characteristics_score", 0.4 * F.col("pctl_parcel_area") + 0.3 * (1 - F.col("pctl_assessed_value_psf")) + 0.3 * F.col("pctl_sale_recency"))
    p = p.withColumn("shortlist_score", 0.50 * F.col("zone_quality_score") + 0.25 * F.col("local_retail_context_score") + 0.25 * F.col("parcel_characteristics_score"))
    # the score is rounded for ordering, so that equal scores stay equal
    p = p.withColumn("__s", F.round("shortlist_score", 9))
    p = row_numbers(p, [], [down("__s"), down("zone_quality_score"), down("parcel_area_sqmi"), up("parcel_uid")],
                    "shortlist_rank_system", None)
    p = row_numbers(p, ["zone_id"], [down("__s"), down("parcel_area_sqmi"), up("parcel_uid")], "shortlist_rank_zone", None)
    return p.drop("__s")


def shortlist_summary(shortlist: DataFrame) -> DataFrame:
    """Counts, medians and the upper tenth of the shortlist."""
    shortlist = store(shortlist.select("zone_id", "shortlist_score", "parcel_area_sqmi", "just_value"))
    zones = shortlist.select("zone_id").distinct().select(F.count(F.lit(1))).scalar()
    q = column_quantiles(shortlist, [], {
        "median_shortlist_score": ("shortlist_score", 0.5), "p90_shortlist_score": ("shortlist_score", 0.9),
        "median_parcel_area_sqmi": ("parcel_area_sqmi", 0.5), "median_assessed_value": ("just_value", 0.5)})
    n = shortlist.select(F.count(F.lit(1))).scalar()
    return q.withColumns({"n_shortlisted": n, "n_zones": zones})


def top_zones(overlay: DataFrame, k: int = 3) -> DataFrame:
    return overlay.orderBy(F.round("zone_quality_score", 9).desc_nulls_last(), desc_last("retail_parcel_count"), asc_last("zone_id")).limit(k)
