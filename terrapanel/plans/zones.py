"""Zone candidates, contiguity and distance zones, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrapanel.operators.graph import contiguity_zones, distance_clusters, order_zones, zone_summary
from terrapanel.operators.spatial import adjacency_edges, zone_areas
from terrapanel.session import cut_lineage, store


def zone_candidates(scores: DataFrame, seeds: DataFrame, tract: str = "tract_geoid") -> DataFrame:
    """Scored tracts that are seeds (a tract may be a seed of several models)."""
    return scores.join(seeds.select(tract).distinct(), tract, "left_semi")


def contiguity_zone_table(candidates: DataFrame, polys: DataFrame, tract: str = "tract_geoid", ring: str = "ring") -> tuple[DataFrame, DataFrame]:
    """(tract assignment, zone summary with area) for touching candidates."""
    own = cut_lineage(polys.select(tract, ring).join(candidates, tract))
    assigned, _ = contiguity_zones(own.drop(ring), adjacency_edges(own, tract, ring), tract, "tract_score")
    s = zone_summary(assigned, ["zone_id", "zone_label", "zone_order"], "pop_total", ["pop_growth_3yr", "units_per_1k_3yr"],
                     ["pop_density", "price_proxy_pctl"], "tract_score")
    area = zone_areas(own.select(tract, ring).join(assigned.select(tract, "zone_id"), tract), ["zone_id"], ring)
    return assigned, s.join(area.select("zone_id", "zone_area"), "zone_id")


def cluster_zone_table(candidates: DataFrame, centroids: DataFrame, eps: float, min_pts: int = 2, policy: str = "nearest_core",
                       tract: str = "tract_geoid") -> tuple[DataFrame, DataFrame]:
    """(tract assignment, cluster summary) for candidates linked by distance."""
    pts = store(candidates.join(centroids.select(tract, "x", "y"), tract))
    c = cut_lineage(distance_clusters(pts, tract, "x", "y", eps, min_pts, policy))
    order = order_zones(c, "cluster_raw_id", "tract_score", "cluster_", "Cluster Zone ").withColumnsRenamed(
        {"zone_id": "cluster_id", "zone_label": "cluster_label", "zone_order": "cluster_order"})
    assigned = c.join(order, "cluster_raw_id")
    s = zone_summary(assigned, ["cluster_id", "cluster_label", "cluster_order"], "pop_total", ["pop_growth_3yr", "units_per_1k_3yr"],
                     ["pop_density", "price_proxy_pctl"], "tract_score")
    return assigned, s
