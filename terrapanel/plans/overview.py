"""Market overview, membership, commuting and quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.functions.nulls import ratio_or_null, safe_weighted_mean
from terrapanel.operators.reshape import longer
from terrapanel.operators.series import index_to_base

BENCH = ("pop_growth_5yr", "units_per_1k_3yr", "median_gross_rent", "median_home_value", "mean_travel_time")


def kpi_row(features: DataFrame, target: str, year: int, cols: Mapping[str, str]) -> DataFrame:
    """The target market's headline numbers ({column: output})."""
    return features.filter((F.col("cbsa_code") == target) & (F.col("year") == year)).select(
        "cbsa_code", "year", *[F.col(c).alias(o) for c, o in cols.items()])


def peer_table(features: DataFrame, peers: Sequence[str], target: str, year: int, cols: Sequence[str]) -> DataFrame:
    return features.filter(F.col("cbsa_code").isin(list(peers)) & (F.col("year") == year)).select(
        "cbsa_code", "cbsa_name", *cols, (F.col("cbsa_code") == target).alias("is_target_market"))


def benchmark_table(features: DataFrame, target: str, year: int, region_col: str, region: str) -> DataFrame:
    """Target, region and nation: mean population, population-weighted rates, and
    the target relative to both."""
    f = features.filter(F.col("year") == year)
    # each metro counts for the nation, for its region and for itself; one aggregation makes all rows
    at = F.array_compact(F.array(F.lit("us"), F.when(F.col(region_col) == region, F.lit("region")), F.when(F.col("cbsa_code") == target, F.lit("metro"))))
    rows = f.withColumn("geo_level", F.explode(at)).groupBy("geo_level").agg(
        F.first("cbsa_name").alias("__name"), F.avg("pop_total").alias("population"),
        *[F.when(F.col("geo_level") == "metro", F.max(c)).otherwise(safe_weighted_mean(c, "pop_total")).alias(c) for c in BENCH])
    name = F.when(F.col("geo_level") == "metro", F.col("__name")).when(F.col("geo_level") == "region", F.lit(region)).otherwise(F.lit("United States"))
    table = Window.partitionBy(F.lit(1))  # three rows at most
    val = lambda n, c: F.max(F.when(F.col("geo_level") == n, F.col(c))).over(table)
    return rows.withColumn("geo_name", name).withColumns({
        f"target_vs_{n}_{k}": F.when(F.col("geo_level") == "metro", ratio_or_null(c, val(n, c)))
        for n in ("region", "us") for k, c in (("pop", "population"), ("rent", "median_gross_rent"))}).select(
        "geo_level", "geo_name", "population", *BENCH, *[f"target_vs_{n}_{k}" for n in ("region", "us") for k in ("pop", "rent")])


def indexed_trend(features: DataFrame, target: str, region_col: str, region: str) -> DataFrame:
    """Population of target, region and nation indexed to their first common year."""
    parts = [features.filter(F.col("cbsa_code") == target).select(F.lit("target").alias("geo"), "year", F.col("pop_total").cast("double").alias("population")),
             features.filter(F.col(region_col) == region).groupBy("year").agg(F.sum("pop_total").cast("double").alias("population")).select(F.lit("region").alias("geo"), "year", "population"),
             features.groupBy("year").agg(F.sum("pop_total").cast("double").alias("population")).select(F.lit("us").alias("geo"), "year", "population")]
    trend = parts[0].unionByName(parts[1]).unionByName(parts[2])
    base = trend.groupBy("geo").agg(F.min("year").alias("y")).select(F.max("y")).scalar()
    return index_to_base(trend, ["geo"], "year", "population", base, "pop_index")


def distributions(features: DataFrame, year: int, cols: Sequence[str], target: str) -> DataFrame:
    """Known values of each metric over all metros, long."""
    f = features.filter(F.col("year") == year).withColumn("is_target_market", F.col("cbsa_code") == target)
    return longer(f, ["cbsa_code", "cbsa_name", "is_target_market"], cols, "metric", "value").filter(F.col("value").isNotNull())


def market_membership(profiles: DataFrame, county_cbsa: DataFrame) -> DataFrame:
    """Counties of each market."""
    return profiles.select("market_key", "cbsa_code").join(county_cbsa, "cbsa_code").distinct()


def tract_universe(membership: DataFrame, tracts: DataFrame) -> DataFrame:
    """Tracts of each market through their county."""
    return membership.select("market_key", "cbsa_code", "county_geoid").join(tracts, "county_geoid").distinct()


def land_use_mapping(base: DataFrame, review: DataFrame) -> DataFrame:
    """Mapping with reviewed decisions laid over the derived ones."""
    r = review.select("land_use_code", F.col("retail_flag").alias("__r"), F.col("retail_subtype").alias("__s"), F.col("review_note"))
    j = base.join(r, "land_use_code", "left")
    reviewed = F.col("__r").isNotNull()
    return j.withColumns({"retail_flag": F.coalesce("__r", "retail_flag"), "retail_subtype": F.when(reviewed, F.col("__s")).otherwise(F.col("retail_subtype")),
                          "mapping_method": F.when(reviewed, "manual_review").otherwise("rule")}).drop("__r", "__s")


def commute_summary(flows: DataFrame, members: DataFrame, home: str, work: str, n: str, member: str) -> DataFrame:
    """Inflow, outflow and internal commuters of one set of counties."""
    m = members.select(F.col(member)).distinct()
    per = flows.groupBy(home, work).agg(F.sum(n).alias("n"))
    j = per.join(m.select(F.col(member).alias(home), F.lit(True).alias("__h")), home, "left").join(
        m.select(F.col(member).alias(work), F.lit(True).alias("__w")), work, "left")
    h, w = F.coalesce("__h", F.lit(False)), F.coalesce("__w", F.lit(False))
    kind = F.when(h & w, "Internal: live & work in CBSA").when(w, "Inflow: live outside, work in CBSA").when(h, "Outflow: live in CBSA, work outside")
    return j.withColumn("type", kind).filter(F.col("type").isNotNull()).groupBy("type").agg(F.sum("n").alias("commuters"))


def commute_partners(flows: DataFrame, members: DataFrame, home: str, work: str, n: str, member: str, side: str) -> DataFrame:
    """Commuters by outside county: where they live (inflow) or work (outflow)."""
    m = members.select(F.col(member)).distinct()
    inside, outside = (work, home) if side == "inflow" else (home, work)
    f = flows.join(m.withColumnRenamed(member, inside), inside, "left_semi").join(m.withColumnRenamed(member, outside), outside, "left_anti")
    return f.groupBy(F.col(outside).alias("geoid")).agg(F.sum(n).alias("commuters"))


def range_report(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows, NULLs, minimum and maximum of each column per class and period."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.groupBy(*by).agg(*aggs)
