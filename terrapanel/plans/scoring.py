"""Feature tables, tract models, seeds and screens.

The market (`cbsa_code`) is a grouping key throughout, so all markets are
scored by one job. Feature rows are far fewer than the records behind them and
feed several ordered passes, so they are written once (`store`). Ranks and quantiles go through the ordered operators, so a
market, or the whole nation, may be arbitrarily large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.columns import reason_tags, weighted_score, with_gates
from terrapanel.functions.nulls import asc_last, desc_last, null_safe_join, safe_ratio
from terrapanel.operators.ordered import column_quantiles, down, row_numbers, up
from terrapanel.operators.quality import funnel
from terrapanel.operators.ranking import ntile, percent_rank, percentiles_of, rank_metrics, top_share
from terrapanel.operators.reshape import longer
from terrapanel.operators.series import rolling_mean
from terrapanel.operators.stats import impute_median, quantile_tiers, rescale_0_100, sd_tiers, zscore
from terrapanel.session import mark_settled, settled, store

# Metrics of the metro table and whether larger is better.
CBSA_METRICS = {
    "pop_total": True, "pop_growth_3yr": True, "pop_growth_5yr": True, "median_gross_rent": True, "median_home_value": True,
    "pct_commute_wfh": True, "mean_travel_time": False, "bps_units_per_1k_3yr_avg": True}
# Gate thresholds and model weights.
MIN_GROWTH_PCTL, MAX_PRICE_PCTL, MAX_DENSITY_PCTL = 0.50, 0.70, 0.70
MODEL_TERMS = ("z_pop_growth", "z_permits", "z_density_inv", "z_price_inv", "z_income", "z_commute")
MODELS = {
    "balanced": dict(zip(MODEL_TERMS, (0.35, 0.25, 0.15, 0.10, 0.10, 0.05))),
    "growth": dict(zip(MODEL_TERMS, (0.45, 0.25, 0.10, 0.05, 0.10, 0.05))),
    "value": dict(zip(MODEL_TERMS, (0.25, 0.20, 0.10, 0.30, 0.10, 0.05))),
    "corridor": dict(zip(MODEL_TERMS, (0.25, 0.15, 0.10, 0.10, 0.10, 0.30)))}
SEED_SHARE = 0.25
SCORING_INPUTS = {"pop_growth_3yr": "pop_growth", "permits_per_1k_3yr": "permits", "density": "density", "price_proxy": "price",
                  "commute_intensity": "commute", "median_household_income": "income"}


def cbsa_features(meta: DataFrame, panel: DataFrame, permits: DataFrame) -> DataFrame:
    """Metro features by year with rank and percentile in the nation and the division.

    `meta`: cbsa_code, cbsa_type, census_division, ...; `panel`: cbsa_code, year
    and metrics; `permits`: cbsa_code, year, total_units. A metro without a
    panel row stays, with a NULL year and NULL measures. All ranks of all
    metrics come from one ordered pass over stacked rows.
    """
    b = rolling_mean(permits.select("cbsa_code", "year", F.col("total_units").alias("bps_total_units")), ["cbsa_code"], "year",
                     "bps_total_units", 3, "bps_units_3yr_avg")
    f = meta.join(panel, "cbsa_code", "left").join(b, ["cbsa_code", "year"], "left")
    f = f.withColumns({
        "commute_intensity_b": F.col("mean_travel_time") * (1 - F.col("pct_commute_wfh")),
        "bps_units_per_1k": safe_ratio(F.col("bps_total_units") * 1000.0, "pop_total"),
        "bps_units_per_1k_3yr_avg": safe_ratio(F.col("bps_units_3yr_avg") * 1000.0, "pop_total")})
    f = store(f)
    ranks = rank_metrics(f, ["cbsa_code", "year"], {"national": ["year", "cbsa_type"], "region": ["census_division", "year", "cbsa_type"]}, CBSA_METRICS)
    return null_safe_join(f, ranks, ["cbsa_code", "year"])


def tract_features(tracts: DataFrame, metrics: DataFrame, permits: DataFrame, year: int) -> DataFrame:
    """Tract features of one year with market percentiles and eligibility gates.

    `tracts`: tract_geoid, county_geoid, cbsa_code, land_area_sqmi; `metrics`:
    tract_geoid, year and the measures; `permits`: county_geoid, year, total_units.
    """
    b = rolling_mean(permits, ["county_geoid"], "year", "total_units", 3, "total_units_3yr_avg").filter(F.col("year") == year)
    f = tracts.join(metrics.filter(F.col("year") == year), "tract_geoid").join(
        b.select("county_geoid", "total_units_3yr_avg"), "county_geoid", "left")
    f = f.withColumns({
        "commute_intensity_b": F.col("mean_travel_time") * (1 - F.col("pct_commute_wfh")),
        "units_per_1k_3yr": safe_ratio(F.col("total_units_3yr_avg") * 1000.0, "pop_total"),
        "pop_density": safe_ratio("pop_total", "land_area_sqmi")})
    f = store(f)
    f = percentiles_of(f, ["tract_geoid"], ["cbsa_code"], {
        "pop_growth_3yr": "pop_growth_pctl", "median_hh_income": "income_pctl", "median_gross_rent": "rent_pctl",
        "median_home_value": "value_pctl", "pop_density": "density_pctl"})
    rent, value = F.col("rent_pctl"), F.col("value_pctl")
    f = f.withColumn("price_proxy_pctl", F.coalesce(0.5 * rent + 0.5 * value, value, rent))
    return with_gates(f, {"gate_pop": F.col("pop_growth_pctl") >= MIN_GROWTH_PCTL, "gate_price": F.col("price_proxy_pctl") < MAX_PRICE_PCTL,
                          "gate_density": F.col("density_pctl") <= MAX_DENSITY_PCTL}, "eligible_v1")


def _scored(features: DataFrame) -> DataFrame:
    f = features.select(
        "cbsa_code", "tract_geoid", "pop_growth_3yr", F.col("units_per_1k_3yr").alias("permits_per_1k_3yr"), F.col("pop_density").alias("density"),
        F.col("price_proxy_pctl").alias("price_proxy"), F.col("commute_intensity_b").alias("commute_intensity"),
        F.col("median_hh_income").alias("median_household_income"), "pop_growth_pctl", "price_proxy_pctl", "density_pctl")
    f = store(f)
    f = impute_median(f, ["cbsa_code"], {c: f"{o}_scoring" for c, o in SCORING_INPUTS.items()})
    f = zscore(f, ["cbsa_code"], {f"{o}_scoring": f"z_{o}" for o in SCORING_INPUTS.values()})
    f = f.withColumns({"z_density_inv": -F.col("z_density"), "z_price_inv": -F.col("z_price")})
    f = with_gates(f, {"growth_gate_flag": F.col("pop_growth_pctl") >= MIN_GROWTH_PCTL, "price_gate_flag": F.col("price_proxy_pctl") < MAX_PRICE_PCTL,
                       "density_gate_flag": F.col("density_pctl") <= MAX_DENSITY_PCTL}, "eligible_flag")
    return f.withColumns({f"score_{m}": weighted_score(w) for m, w in MODELS.items()})


def tract_models(features: DataFrame) -> DataFrame:
    """Four model scores per tract with ranks in the market and the nation.

    Models are stacked so that two ordered passes give all eight ranks. A tract
    outside any market has no national rank but keeps its place in the count.
    """
    f = store(_scored(features))
    long = longer(f, ["cbsa_code", "tract_geoid"], [f"score_{m}" for m in MODELS], "model", "score")
    order = [down("score"), up("tract_geoid")]
    long = row_numbers(long, ["model", "cbsa_code"], order, "rank_cbsa", None)
    long = row_numbers(long, ["model"], [down("score"), up("cbsa_code"), up("tract_geoid")], "rank_national", None)
    long = long.withColumn("rank_national", F.when(F.col("cbsa_code").isNotNull() & (F.col("cbsa_code") != ""), F.col("rank_national")))
    wide = long.groupBy("tract_geoid").agg(*[
        F.max(F.when(F.col("model") == f"score_{m}", F.col(f"rank_{s}"))).alias(f"rank_{m}_{s}") for m in MODELS for s in ("cbsa", "national")])
    keep = [c for c in f.columns if not c.endswith(("_scoring", "_pctl"))]
    return f.select(*keep).join(wide, "tract_geoid")


def model_audit(features: DataFrame) -> DataFrame:
    """Which inputs were imputed and what each term adds to each model's score."""
    f = _scored(features)
    flags = {f"imputed_{o}": F.col(c).isNull() for c, o in SCORING_INPUTS.items()}
    terms = {f"{m}_{t[2:]}_contribution": F.lit(w) * F.col(t) for m, ws in MODELS.items() for t, w in ws.items()}
    out = f.withColumns({**flags, **terms})
    n = sum((F.col(k).cast("bigint") for k in flags), F.lit(0).cast("bigint"))
    return out.withColumn("imputed_count", n).select("cbsa_code", "tract_geoid", *[f"{o}_scoring" for o in SCORING_INPUTS.values()], *flags,
                                                     "imputed_count", *terms, *[f"score_{m}" for m in MODELS])


def cluster_seeds(models: DataFrame, share: float = SEED_SHARE) -> DataFrame:
    """Best share of the eligible tracts per market and model, long by model."""
    cells = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(f"score_{m}").alias("model_score"), F.col(f"rank_{m}_cbsa").alias("model_rank_cbsa"),
                               F.col(f"rank_{m}_national").alias("model_rank_national")) for m in MODELS])
    long = models.filter(F.col("eligible_flag") == 1).select("cbsa_code", "tract_geoid", "eligible_flag", F.explode(cells).alias("m")).select(
        "cbsa_code", "tract_geoid", "eligible_flag", "m.*")
    out = top_share(long, ["cbsa_code", "model_name"], "model_score", ["tract_geoid"], share)
    return out.withColumnsRenamed({"seed_rank": "cluster_seed_rank", "cutoff_n": "cluster_cutoff_n"}).withColumns(
        {"cluster_top_share": F.lit(share), "is_cluster_seed": F.lit(1)})


# Terms of the first tract score, the column each reads, its sign and weight.
V1_TERMS = {"growth": ("pop_growth_3yr", 1, 0.35), "units": ("units_per_1k_3yr", 1, 0.25), "headroom": ("pop_density", -1, 0.15),
            "price": ("price_proxy_pctl", -1, 0.10), "commute": ("commute_intensity_b", 1, 0.05), "income": ("median_hh_income", 1, 0.10)}
WHY_DEFAULT = "Balanced profile"


def tract_scores(features: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Tract score with contributions, rank and reason tags.

    `group` scores each market on its own; empty scores all tracts together.
    """
    features = store(features)
    f = features.withColumns({f"{t}_raw": F.col(c).cast("double") * s for t, (c, s, _) in V1_TERMS.items()})
    f = impute_median(f, group, {f"{t}_raw": f"{t}_scoring" for t in V1_TERMS})
    f = zscore(f, group, {f"{t}_scoring": f"z_{t}" for t in V1_TERMS})
    f = f.withColumns({f"contrib_{t}": F.lit(w) * F.col(f"z_{t}") for t, (_, _, w) in V1_TERMS.items()})
    f = f.withColumn("tract_score", sum((F.col(f"contrib_{t}") for t in V1_TERMS), F.lit(0.0)))
    f = row_numbers(f, group, [down("tract_score"), up("tract_geoid")], "tract_rank", None)
    cuts = column_quantiles(features, list(group), {f"__q_{t}": (V1_TERMS[t][0], 0.75) for t in ("growth", "units", "commute", "income")})
    f = f.join(cuts, list(group), "left") if group else f.withColumn("__q", cuts.select(F.struct(*cuts.columns)).scalar()).select("*", "__q.*").drop("__q")
    tags = {"High growth": F.col("pop_growth_3yr") >= F.col("__q_growth"), "High housing pipeline": F.col("units_per_1k_3yr") >= F.col("__q_units"),
            "Low density headroom": F.col("density_pctl") <= MAX_DENSITY_PCTL, "Moderate price pressure": F.col("price_proxy_pctl") <= 0.50,
            "High commute exposure": F.col("commute_intensity_b") >= F.col("__q_commute"), "Strong household income": F.col("median_hh_income") >= F.col("__q_income")}
    out = f.withColumns({"why_tags": reason_tags(tags, WHY_DEFAULT), "is_scored": F.col("tract_score").isNotNull()})
    return out.drop(*[c for c in out.columns if c.endswith("_scoring") or c.startswith("__q_")])


def top_tracts(scores: DataFrame, n: int) -> DataFrame:
    """Best n eligible tracts, renumbered."""
    best = scores.filter(F.col("eligible_v1") == 1).orderBy(desc_last("tract_score"), asc_last("tract_geoid")).limit(n)
    # n rows at most remain
    return row_numbers(best.drop("tract_rank"), [], [down("tract_score"), up("tract_geoid")], "tract_rank", None)


def eligibility_funnel(features: DataFrame) -> DataFrame:
    return funnel(features, {"After growth gate": F.col("gate_pop") == 1, "After growth + price gates": F.col("gate_price") == 1,
                             "After growth + price + density gates": F.col("gate_density") == 1, "Eligible (v1)": F.col("eligible_v1") == 1})


def overheat_gap(df: DataFrame, pressure: Sequence[str], support: Mapping[str, float]) -> DataFrame:
    """Pressure minus support, its label by the outer tenths, and a 0-100 score."""
    out = df.withColumns({"overheating_score": weighted_score({c: 1.0 for c in pressure}), "support_score": weighted_score(support)})
    out = settled(out.withColumn("overheat_gap", F.col("overheating_score") - F.col("support_score")))
    out = quantile_tiers(out, "overheat_gap", [(0.9, "Overheated")], "__low", "market_type")
    q = column_quantiles(out, [], {"q": ("overheat_gap", 0.1)}).scalar()
    out = out.withColumn("market_type", F.when(F.col("market_type") != "__low", F.col("market_type")).when(F.col("overheat_gap") <= q, "Undervalued").otherwise("Neutral"))
    return rescale_0_100(mark_settled(out), {"overheat_gap": "overheat_gap_score"})


def investment_index(df: DataFrame, weights: Mapping[str, float], ids: Sequence[str]) -> DataFrame:
    """Weighted index scaled to 0-100, quintile tier and one-sd outlier class."""
    out = df.withColumn("raw_index", weighted_score(weights))
    out = ntile(out, [], "raw_index", ids, 5, "investment_tier")
    out = sd_tiers(out, "raw_index", "__t")
    names = {"high": "High Performer", "low": "Under Performer", "middle": "Middle Tier"}
    label = F.lit(None).cast("string")
    for k, v in names.items():
        label = F.when(F.col("__t") == k, F.lit(v)).otherwise(label)
    return rescale_0_100(out.withColumn("index_outlier", label), {"raw_index": "investment_index"}).drop("__t")


def percentile_screen(df: DataFrame, ids: Sequence[str], metrics: Mapping[str, bool], k: int, group: Sequence[str] = ()) -> DataFrame:
    """The k places with the best mean percentile over several metrics, where
    False marks metrics for which less is better."""
    signed = df.withColumns({f"__v_{c}": F.col(c) if up else -F.col(c) for c, up in metrics.items()})
    p = percentiles_of(signed, ids, group, {f"__v_{c}": f"{c}_pctl" for c in metrics})
    out = p.withColumn("screen_score", sum((F.col(f"{c}_pctl") for c in metrics), F.lit(0.0)) / len(metrics)).drop(*[f"__v_{c}" for c in metrics])
    return out.orderBy(F.round("screen_score", 9).desc_nulls_last(), *[asc_last(i) for i in ids]).limit(k)


def radar_long(df: DataFrame, ids: Sequence[str], kpis: Mapping[str, bool]) -> DataFrame:
    """Percentile of each indicator among known values, turned round where less is better."""
    long = longer(df, ids, list(kpis), "kpi", "value")
    p = percent_rank(long, ["kpi"], "value", ids, "pct", keep_nulls=False)
    low = F.col("kpi").isin([k for k, up in kpis.items() if not up])
    return p.withColumns({"pct_adj": F.when(low, 1 - F.col("pct")).otherwise(F.col("pct")),
                          "direction": F.when(low, "Lower is better (inverted)").otherwise("Higher is better")})


def top_districts(df: DataFrame, k: int = 25) -> DataFrame:
    """Best districts with a growth label and the main reason for the rank."""
    best = df.orderBy(F.round("lead_score", 9).desc_nulls_last(), asc_last("nces_district_id")).limit(k)
    q = column_quantiles(best, [], {"qa": ("allocations_per_student", 0.75), "qe": ("enrollment", 0.75), "qp": ("child_poverty_rate", 0.75)})
    best = best.withColumn("__q", q.select(F.struct("qa", "qe", "qp")).scalar()).select("*", "__q.*").drop("__q")
    quartile, need = F.col("pop_growth_quartile"), F.col("economically_disadvantaged_percent") / 100
    # fixed values: the texts of labels and reasons
    label = F.when(quartile == 4, "High growth").when(quartile == 3, "Moderate growth").when(quartile == 1, "Declining").otherwise("Stable")
    why = (F.when((F.col("allocations_per_student") >= F.col("qa")) & (need >= 0.60), "High Title I funding and high student need")
           .when(F.col("enrollment") >= F.col("qe"), "Large district with meaningful contract scale")
           .when(F.col("child_poverty_rate") >= F.col("qp"), "High community need aligned with federal funding")
           .when(quartile == 4, "Strong growth outlook with solid funding base")
           .otherwise("Balanced mix of scale, funding, and need"))
    return best.withColumns({"growth_label": label, "why": why}).drop("qa", "qe", "qp")
