"""Standardised survey, regional-account, permit and flow tables (silver layer)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.columns import classify, diversity, geoid, in_parentheses, pad_zeros, snake_case
from terrapanel.functions.nulls import ratio_or_null, safe_ratio, sum0, sum_na0, weighted_mean
from terrapanel.operators.reshape import longer
from terrapanel.operators.rollup import cols_matching, multi_level_rollup
from terrapanel.plans.themes import LINE_METRICS, LINE_TOPICS, WIDE_TABLES, Theme

KEYS = ["geo_level", "geo_id", "geo_name", "year"]


def standardize_frame(df: DataFrame, level: str, drop_e: bool = False) -> DataFrame:
    """Survey frame to panel shape: level, id, name, year first; margin-of-error
    columns (`...M`) dropped; optionally the estimate suffix `E` removed."""
    names = {"GEOID": "geo_id", "NAME": "geo_name"}
    keys = ["geo_id", "geo_name", "year"]
    kept = [c for c in df.columns if not c.endswith("M")]
    renamed = {c: names.get(c, c[:-1] if drop_e and c.endswith("E") and c not in names else c) for c in kept}
    rest = [c for c in kept if renamed[c] not in keys]
    back = {v: k for k, v in renamed.items()}
    return df.select(F.lit(level).alias("geo_level"), *[F.col(f"`{back[k]}`").alias(k) for k in keys if k in back],
                     *[F.col(f"`{c}`").alias(renamed[c]) for c in rest])


# ---- survey themes --------------------------------------------------------


def theme_base(frames: Sequence[DataFrame], counties: DataFrame, xwalk: DataFrame, theme: Theme) -> DataFrame:
    """All levels stacked, with metros rebuilt from their counties: counts are
    added up, medians and rates averaged with the theme's weights."""
    c = counties.join(xwalk.select(F.col("county_geoid").alias("geo_id"), "cbsa_code", "cbsa_name"), "geo_id")
    sums = [n for n in cols_matching(counties, theme.sums, numeric=True) if n not in ("year", *theme.weighted)]
    aggs = [sum_na0(F.col(f"`{n}`")).alias(n) for n in sums]
    aggs += [weighted_mean(F.col(f"`{n}`"), F.col(f"`{w}`"), "propagate").alias(n) for n, w in theme.weighted.items()]
    cbsa = c.groupBy("cbsa_code", "year").agg(F.max("cbsa_name").alias("geo_name"), *aggs)
    cbsa = cbsa.withColumnRenamed("cbsa_code", "geo_id").withColumn("geo_level", F.lit("cbsa"))
    out = cbsa
    for f in (counties, *frames):
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*KEYS, *[F.col(f"`{n}`") for n in out.columns if n not in KEYS])


def theme_kpi(base: DataFrame, theme: Theme) -> DataFrame:
    """Buckets, differences, shares and diversity of one theme."""
    col = lambda n: F.col(f"`{n}`")
    total = lambda names: reduce(add, [col(n) for n in names])
    # buckets may build on earlier buckets, which are computed first
    first = {b: c for b, c in theme.buckets.items() if all(n in base.columns for n in c)}
    second = {b: c for b, c in theme.buckets.items() if b not in first}
    out = base.withColumns({b: total(c).cast("double") for b, c in first.items()})
    if second:
        out = out.withColumns({b: total(c) for b, c in second.items()})
    if theme.less:
        out = out.withColumns({b: col(x) - col(y) for b, (x, y) in theme.less.items()})
        out = out.withColumns({b: F.when(col(b) < 0, F.lit(0.0)).otherwise(col(b)) for b in theme.at_least_0})
    if theme.shares:
        out = out.withColumns({s: ratio_or_null(n, d) for s, (n, d) in theme.shares.items()})
    names = [n for n in (*theme.buckets, *theme.less, *theme.shares) if not n.startswith("__")]
    if theme.diversity:
        out = out.withColumn("diversity_index", diversity(*theme.diversity))
        names.append("diversity_index")
    return out.select(*KEYS, *names)


# ---- regional accounts ----------------------------------------------------


def accounts_long(stage: DataFrame, state: DataFrame, codes: DataFrame, xwalk: DataFrame, totals: Sequence[str],
                  rates: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Long table (geo..., period, metric_key, value) for county, metro and state.

    Lines are named through `codes` (table, line_code, metric_key). Totals are
    added up to metros; `rates` {metric: (numerator, denominator)} are formed
    again from totals at each level instead of being averaged.
    """
    named = stage.join(codes, ["table", "line_code"]).filter(F.col("metric_key").isin(list(totals)))
    keys = ["table", "period", "metric_key"]
    county = named.groupBy("geo_id", *keys).agg(F.max("geo_name").alias("geo_name"), sum_na0("value").alias("value")).withColumn(
        "geo_level", F.lit("county"))
    x = county.drop("geo_name").join(xwalk.select(F.col("county_geoid").alias("geo_id"), "cbsa_code", "cbsa_name"), "geo_id")
    cbsa = x.groupBy(F.col("cbsa_code").alias("geo_id"), *keys).agg(F.max("cbsa_name").alias("geo_name"), sum_na0("value").alias("value")).withColumn(
        "geo_level", F.lit("cbsa"))
    cols = ["table", "geo_level", "geo_id", "geo_name", "period", "metric_key", "value"]
    both = county.select(*cols).unionByName(cbsa.select(*cols))
    parts = sorted({p for r in rates.values() for p in r})
    wide = both.groupBy("table", "geo_level", "geo_id", "geo_name", "period").agg(
        *[F.max(F.when(F.col("metric_key") == p, F.col("value"))).alias(p) for p in parts])
    rated = wide.select("table", "geo_level", "geo_id", "geo_name", "period", *[ratio_or_null(n, d).alias(r) for r, (n, d) in rates.items()]).unpivot(
        ["table", "geo_level", "geo_id", "geo_name", "period"], list(rates), "metric_key", "value")
    st = state.join(codes, ["table", "line_code"]).withColumn("geo_level", F.lit("state")).select(*cols)
    return both.unionByName(rated).unionByName(st)


def accounts_wide(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return long.groupBy("geo_level", "geo_id", "geo_name", "period", "table").agg(
        *[F.max(F.when(F.col("metric_key") == m, F.col("value"))).alias(m) for m in metrics])


def metric_dictionary(lines: DataFrame, vintage: str) -> DataFrame:
    """One row per (table, line code): metric key, label, trailing industry code,
    whether it is an aggregate, topic. Of several descriptions the one with an
    industry code wins."""
    naics = in_parentheses("line_desc")
    d = lines.withColumns({"naics_raw": naics, "line_desc_clean": F.trim(F.regexp_replace("line_desc", r"\([^()]*\)\s*$", ""))})
    d = d.groupBy("table", "line_code").agg(F.min_by(
        F.struct("line_desc", "line_desc_clean", "naics_raw"),
        F.struct(F.col("naics_raw").isNull().cast("int"), F.col("line_desc"))).alias("r")).select("table", "line_code", "r.*")
    known = F.create_map(*[F.lit(x) for t, m in LINE_METRICS.items() for c, k in m.items() for x in (f"{t}:{c}", k)])
    key = F.coalesce(F.try_element_at(known, F.concat_ws(":", "table", F.col("line_code").cast("string"))), snake_case("line_desc"))
    topics = F.create_map(*[F.lit(x) for kv in LINE_TOPICS.items() for x in kv])
    return d.select(
        "table", "line_code", "line_desc_clean", key.alias("metric_key"), F.col("line_desc").alias("metric_label"),
        (F.col("table").isin(list(WIDE_TABLES)) & F.col("line_code").isin(1, 2, 3)).alias("include_in_wide"), "naics_raw",
        F.coalesce(F.col("naics_raw").rlike("[,-]"), F.lit(False)).alias("is_aggregate"),
        F.coalesce(F.try_element_at(topics, F.col("table")), F.lit("other")).alias("topic"), F.lit(vintage).alias("vintage"))


# ---- labour, permits, rents -----------------------------------------------


def labor_force_rollup(counties: DataFrame, geo: DataFrame) -> DataFrame:
    """Labour-force counts for county, metro and state with the rate formed again."""
    c = counties.join(geo, "geo_id", "left")
    counts = ("labor_force", "employed", "unemployed")
    out = multi_level_rollup(c, {"county": ("geo_id", "geo_name"), "cbsa": ("cbsa_code", "cbsa_name"), "state": ("state_fips", "state_abbr")},
                             ["period"], [sum_na0(n).alias(n) for n in counts])
    return out.withColumn("unemployment_rate_percent", ratio_or_null("unemployed", "labor_force") * 100)


PERMIT_SIZES = ("1_unit", "2_units", "3_4_units", "5_units")


def permit_metrics(df: DataFrame) -> DataFrame:
    """Multifamily totals, averages, shares and the structure-mix label."""
    multi = {f"{m}_multifam": reduce(add, [F.col(f"{m}_{s}") for s in PERMIT_SIZES[1:]]) for m in ("units", "bldgs", "value")}
    out = df.withColumns(multi)
    out = out.withColumns({
        "avg_units_per_bldg": safe_ratio("total_units", "total_bldgs"), "avg_units_per_mf_bldg": safe_ratio("units_multifam", "bldgs_multifam"),
        "share_multifam_units": safe_ratio("units_multifam", "total_units"), "share_units_5_plus": safe_ratio("units_5_units", "total_units"),
        "share_units_1_unit": safe_ratio("units_1_unit", "total_units")})
    return out.withColumn("structure_mix", classify([
        (F.col("share_units_5_plus") >= 0.5, "mostly_large_multifam"), (F.col("share_multifam_units") >= 0.5, "mostly_multifam")],
        "mostly_single_family"))


def permits(counties: DataFrame, geo: DataFrame) -> DataFrame:
    """Permits by county, metro and region with their metrics."""
    counts = [f"total_{m}" for m in ("bldgs", "units", "value")] + [f"{m}_{s}" for m in ("bldgs", "units", "value") for s in PERMIT_SIZES]
    c = counties.join(geo, "geo_id", "left")
    out = multi_level_rollup(c, {"county": ("geo_id", "geo_name"), "cbsa": ("cbsa_code", "cbsa_name"), "region": ("region_code", "region_name")},
                             ["period"], [sum_na0(n).alias(n) for n in counts])
    return permit_metrics(out)


def fair_rents(counties: DataFrame, zips: DataFrame, geo: DataFrame, cols: Sequence[str], weight: str = "pop_weight") -> DataFrame:
    """Rents for metro and state as population-weighted means, beside county and ZIP rows."""
    c = counties.join(geo, "geo_id", "left")
    up = multi_level_rollup(c, {"cbsa": ("cbsa_code", "cbsa_name"), "state": ("state_fips", "state_abbr")}, ["period"],
                            [weighted_mean(n, weight, "propagate").alias(n) for n in cols])
    out = ["geo_level", "geo_id", "geo_name", "period", *cols]
    own = counties.withColumn("geo_level", F.lit("county")).select(*out)
    z = zips.withColumns({"geo_level": F.lit("zip code"), "geo_name": F.col("geo_id")}).select(*out)
    return up.select(*out).unionByName(own).unionByName(z)


# ---- long tables ----------------------------------------------------------


def burden_long(wide: DataFrame, keys: Sequence[str], variables: Sequence[str], meta: DataFrame, **labels: str) -> DataFrame:
    """Housing-burden cells stacked and described by their metadata row."""
    long = longer(wide, keys, variables, "variable", "estimate").join(meta, "variable", "left")
    return long.withColumns({k: F.lit(v) for k, v in labels.items()})


def index_long(wide: DataFrame, keys: Sequence[str], pattern: str = r"^x\d{4}_\d{2}_\d{2}$", value: str = "zhvi", *, after: int | None) -> DataFrame:
    """Monthly index columns named by date, stacked with date, year and month.

    Only years after `after` are kept; None keeps all.
    """
    cols = cols_matching(wide, pattern)
    long = longer(wide, keys, cols, "date_raw", value)
    d = F.to_date(F.regexp_replace(F.substring("date_raw", 2, 10), "_", "-"))
    out = long.withColumn("date", d).withColumns({"year": F.year("date"), "month": F.month("date")}).drop("date_raw")
    return out if after is None else out.filter(F.col("year") > after)


# ---- migration flows ------------------------------------------------------


def county_flows(raw: DataFrame) -> DataFrame:
    """Domestic county-to-county moves: valid codes only, suppressed values as
    NULL, movers within one county dropped.

    Side 1 is the destination and side 2 the origin of an inflow file.
    """
    ok = F.col("y1_statefips").between(1, 56) & F.col("y2_statefips").between(1, 56) & \
        F.col("y1_countyfips").between(1, 840) & F.col("y2_countyfips").between(1, 840)
    f = raw.filter(ok).withColumns({"origin_geoid": geoid("y2_statefips", "y2_countyfips", widths=(2, 3)),
                                    "dest_geoid": geoid("y1_statefips", "y1_countyfips", widths=(2, 3))})
    f = f.filter(F.col("origin_geoid") != F.col("dest_geoid"))
    clean = lambda c: F.when(F.col(c) >= 0, F.col(c)).cast("double")
    return f.select(F.concat_ws("_", F.col("year").cast("string"), "origin_geoid", "dest_geoid").alias("flow_id"), "year", "origin_geoid", "dest_geoid",
                    clean("n1").alias("n_returns"), clean("n2").alias("n_exemptions"), clean("agi").alias("agi_thousands"),
                    (clean("agi") * 1000).alias("agi"))


def flow_summary_type(name: str = "y1_countyname"):
    """Bucket of a summary row of a flow file, from its label."""
    c = F.col(name)
    return classify([
        (c.contains("US and Foreign"), "us_and_foreign_total"), (c.rlike("Total Migration-US$"), "us_total"), (c.contains("Same State"), "same_state_total"),
        (c.contains("Different State"), "different_state_total"), (c.contains("Foreign"), "foreign_total")], "other_summary")


def named_flows(flows: DataFrame, names: DataFrame, level: str) -> DataFrame:
    """Flows with the names of both ends (names: geo_id, geo_name)."""
    o = names.select(F.col("geo_id").alias("origin_geoid"), F.col("geo_name").alias("origin_name"))
    d = names.select(F.col("geo_id").alias("dest_geoid"), F.col("geo_name").alias("dest_name"))
    return flows.join(o, "origin_geoid", "left").join(d, "dest_geoid", "left").withColumn("geo_level", F.lit(level))


def state_flows(raw: DataFrame, states: DataFrame) -> DataFrame:
    """Domestic state-to-state moves with the abbreviations of both ends (states: state_fip, state_abbr).

    Valid state codes only, suppressed values as NULL; moves within a state stay
    out. Side 1 is the destination and side 2 the origin.
    """
    f = raw.filter(F.col("y1_statefips").between(1, 56) & F.col("y2_statefips").between(1, 56)).withColumns({
        "origin_geo_id": geoid("y2_statefips", widths=(2,)), "dest_geo_id": geoid("y1_statefips", widths=(2,))})
    f = f.filter(F.col("origin_geo_id") != F.col("dest_geo_id"))
    clean = lambda c: F.when(F.col(c) >= 0, F.col(c)).cast("double")
    f = f.select(F.lit("State").alias("geo_level"), F.concat_ws("_", F.col("year").cast("string"), "origin_geo_id", "dest_geo_id").alias("flow_id"), "year",
                 "origin_geo_id", "dest_geo_id", clean("n1").alias("n_returns"), clean("n2").alias("n_people"), clean("agi").alias("agi_thousands"), (clean("agi") * 1000).alias("agi"))
    o = states.select(F.col("state_fip").alias("origin_geo_id"), F.col("state_abbr").alias("origin_state_abbr")).distinct()
    d = states.select(F.col("state_fip").alias("dest_geo_id"), F.col("state_abbr").alias("dest_state_abbr")).distinct()
    return f.join(o, "origin_geo_id", "left").join(d, "dest_geo_id", "left")


# ---- crosswalks and catalogs ----------------------------------------------


def code_crosswalk(raw: DataFrame, columns: Mapping[str, str], pads: Mapping[str, int] | None = None, required: Sequence[str] = (), **labels: object) -> DataFrame:
    """A published crosswalk under standard names ({output: source column}).

    `pads` fills codes with zeros to a width, rows without a `required` column
    are left out, `labels` (vintage, source, ...) become constant columns.
    Serves primary cities, tracts, ZIP pairs with published weights, counties.
    """
    out = raw.select(*[(pad_zeros(F.trim(F.col(c).cast("string")), pads[o]) if pads and o in pads else F.col(c)).alias(o) for o, c in columns.items()])
    out = out.dropna(subset=list(required)) if required else out
    return out.withColumns({k: F.lit(v) for k, v in labels.items()})


def cbsa_state_crosswalk(county_xwalk: DataFrame, **labels: object) -> DataFrame:
    """States of each CBSA with its number of counties there."""
    keys = ["cbsa_code", "cbsa_name", "state_fips", "state_name"]
    return county_xwalk.groupBy(*keys).agg(F.count(F.lit(1)).alias("counties")).withColumns({k: F.lit(v) for k, v in labels.items()})


def state_region_crosswalk(states: DataFrame, regions: DataFrame, **labels: object) -> DataFrame:
    """States with census region and division (regions: state_fips, census_region, census_division, one row per state)."""
    return states.join(regions.dropDuplicates(["state_fips", "census_region", "census_division"]), "state_fips", "left").withColumns({k: F.lit(v) for k, v in labels.items()})


def county_crosswalk(delineation: DataFrame) -> DataFrame:
    """CBSA to county with flags: geoid built from codes, core or outlying county."""
    return delineation.select(
        geoid("state_fips", "county_fips", widths=(2, 3)).alias("county_geoid"), "county_name", "cbsa_code", "cbsa_name",
        F.when(F.col("cbsa_type").rlike("(?i)metro"), "Metro Area").when(F.col("cbsa_type").rlike("(?i)micro"), "Micro Area").alias("cbsa_type"),
        (F.col("central_outlying") == "Central").cast("int").alias("county_flag")).distinct()


def zip_crosswalk(pairs: DataFrame, target: str) -> DataFrame:
    """ZIP to target areas with relative weights of people, businesses and homes.

    The weights of one ZIP add up to one; a ZIP without any people is split evenly.
    """
    w = {"rel_weight_pop": "pop", "rel_weight_bus": "bus", "rel_weight_hu": "hu"}
    tot = pairs.groupBy("zip_geoid").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__{c}") for c in w.values()])
    j = pairs.join(tot, "zip_geoid")
    return j.select("zip_geoid", target, *[
        F.when(F.col(f"__{c}") > 0, F.col(c) / F.col(f"__{c}")).otherwise(1.0 / F.col("__n")).alias(o) for o, c in w.items()])


def table_catalog(tables: Mapping[str, DataFrame], topics: Mapping[str, str]) -> DataFrame:
    """One row per table: rows, columns, year range and geography levels.

    Levels are reduced to distinct values before they are listed.
    """
    parts = []
    for name, df in tables.items():
        stats = df.groupBy("geo_level").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("year").isNull(), 1)).alias("no_year"),
                                            F.min("year").alias("lo"), F.max("year").alias("hi"))
        parts.append(stats.agg(F.sum("n").alias("row_count"), F.sum("no_year").alias("rows_no_year"), F.min("lo").alias("min_year"), F.max("hi").alias("max_year"),
                               F.array_join(F.sort_array(F.collect_list("geo_level")), ", ").alias("geo_levels")).select(
            F.lit(name).alias("table_name"), F.lit(topics.get(name, "other")).alias("topic"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("col_count"),
            "rows_no_year", "min_year", "max_year", "geo_levels"))
    return reduce(DataFrame.unionByName, parts)


def variable_catalog(tables: Mapping[str, DataFrame], topics: Mapping[str, str]) -> DataFrame:
    """One row per column of each table, with its rows and NULLs: one pass over each table."""
    parts = []
    for t, df in tables.items():
        fields = [F.struct(
            F.lit(f.name).alias("column_name"), F.lit(i + 1).cast("bigint").alias("ordinal_position"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.name in KEYS).alias("is_key"), F.lit(f.name not in KEYS and not f.name.endswith("name")).alias("is_measure"),
            F.col("n").alias("row_count"), (F.col("n") - F.col(f"known_{i}")).alias("null_count")) for i, f in enumerate(df.schema.fields)]
        one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(df[f"`{f.name}`"]).alias(f"known_{i}") for i, f in enumerate(df.schema.fields)])
        parts.append(one.select(F.lit(t).alias("table_name"), F.lit(topics.get(t, "other")).alias("topic"), F.inline(F.array(*fields))))
    return reduce(DataFrame.unionByName, parts)


def age_band_table(counties: DataFrame, xwalk: DataFrame, bands: Mapping[str, Sequence[str]], pop: str = "pop_total") -> DataFrame:
    """Age bands by metro; a missing population falls back to the banded total."""
    c = counties.join(xwalk.select(F.col("county_geoid").alias("geo_id"), "cbsa_code", "cbsa_name"), "geo_id")
    c = c.withColumns({f"band_{b}": sum0(*cols) for b, cols in bands.items()})
    out = c.groupBy("cbsa_code", "cbsa_name", "year").agg(sum_na0(pop).alias(pop), *[sum_na0(f"band_{b}").alias(f"band_{b}") for b in bands])
    out = out.withColumn("total_banded", sum0(*[f"band_{b}" for b in bands]))
    denom = F.when(F.col(pop) > 0, F.col(pop)).otherwise(F.col("total_banded"))
    return out.withColumn("denom", denom).withColumns({f"pct_{b}": ratio_or_null(F.col(f"band_{b}") * 100.0, "denom") for b in bands})
