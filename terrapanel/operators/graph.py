"""Connected components, zones, distance clusters and peer groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.nulls import asc_last, desc_last, safe_weighted_mean
from terrapanel.operators.ordered import down, row_numbers, up
from terrapanel.operators.rollup import group_summary
from terrapanel.operators.spatial import assign_nearest, distance_components
from terrapanel.session import cut_lineage, settled


def connected_components(vertices: DataFrame, edges: DataFrame, vertex: str = "id", src: str = "src", dst: str = "dst",
                         out: str = "component") -> DataFrame:
    """Label every vertex with the smallest vertex id it is connected to.

    Alternates two rewirings of the edge list until it is a set of stars: first
    each vertex hands its larger neighbours its smallest one, then its smaller
    neighbours. Both only need a minimum per vertex (combined before the
    shuffle) and one equi-join, so no neighbour list is ever gathered in one
    place, and the number of rounds grows with the logarithm of the longest
    path. The edge list is checkpointed every round.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut_lineage(e)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(root, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        hub = root.select("a", F.col("m").alias("b"))
        e = small.unionByName(hub).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        e = cut_lineage(e)
        # two numbers decide whether anything moved
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.groupBy(F.col("a").alias(vertex)).agg(F.min("b").alias("__root"))
    return vertices.join(roots, vertex, "left").withColumn(out, F.coalesce("__root", vertex)).drop("__root")


def letters(n: Column | str, digits: int = 14) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, ...; 14 letters name every bigint."""
    rest = F.col(n) if isinstance(n, str) else n
    start = F.struct(rest.cast("bigint").alias("rest"), F.lit("").alias("text"))

    def step(s: Column, _: Column) -> Column:
        more = s["rest"] > 0
        return F.struct(F.when(more, F.floor((s["rest"] - 1) / 26).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("rest"),
                        F.when(more, F.concat(F.char((s["rest"] - 1) % 26 + 65), s["text"])).otherwise(s["text"]).alias("text"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda s: s["text"])


def order_zones(df: DataFrame, raw: str, score: str, prefix: str, label: str) -> DataFrame:
    """One row per raw zone: best mean score first, with public id and label."""
    agg = df.groupBy(raw).agg(F.count(F.lit(1)).alias("tracts"), F.avg(score).alias("mean_tract_score"))
    # equal means must stay equal however the sum was ordered
    agg = agg.withColumn("__key", F.round("mean_tract_score", 9))
    o = row_numbers(agg, [], [down("__key"), up(raw)], "zone_order", None).drop("__key")
    width = F.greatest(F.length(F.col("zone_order").cast("string")), F.lit(2))
    return o.withColumns({
        "zone_id": F.concat(F.lit(prefix), F.lpad(F.col("zone_order").cast("string"), width, F.lit("0"))),
        "zone_label": F.concat(F.lit(label), letters("zone_order"))})


def contiguity_zones(tracts: DataFrame, edges: DataFrame, tract: str, score: str) -> tuple[DataFrame, DataFrame]:
    """(tract assignment, zone order) for zones of touching tracts."""
    comp = connected_components(tracts, edges, tract, "src", "dst", "zone_component_id")
    comp = cut_lineage(comp)
    order = order_zones(comp, "zone_component_id", score, "zone_", "Zone ")
    return comp.join(order, "zone_component_id"), order


def distance_clusters(points: DataFrame, id_col: str, x: str, y: str, eps: float, min_pts: int = 2,
                      policy: str = "nearest_core", out: str = "cluster_raw_id") -> DataFrame:
    """Clusters of points linked by steps of at most `eps`.

    Components smaller than `min_pts` join the component with the nearest mean
    point (policy "nearest_core") or stay on their own ("own"). Points without a
    place are in no cluster: their component and cluster are NULL.
    """
    labelled = distance_components(points, id_col, x, y, eps, connected_components)
    ids = labelled.groupBy("cell_comp").agg(F.min(id_col).alias("component"), F.count(F.lit(1)).alias("component_size"))
    done = cut_lineage(points.join(labelled, id_col, "left").join(ids, "cell_comp", "left").drop("cell_comp"))
    if policy == "own":
        return done.withColumn(out, F.col("component"))
    if policy != "nearest_core":
        raise ValueError(f"policy must be 'nearest_core' or 'own', not {policy!r}")
    core = done.filter(F.col("component_size") >= min_pts).groupBy(F.col("component").alias("core_id")).agg(
        F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    small = done.filter(F.col("component_size") < min_pts)
    near = assign_nearest(small.select(id_col, x, y), core, id_col, x, y, "core_id", "cx", "cy", step=4 * eps)
    return done.join(near.select(id_col, "core_id"), id_col, "left").withColumn(
        out, F.coalesce("core_id", "component")).drop("core_id")


def zone_summary(df: DataFrame, zone: Sequence[str], pop: str, weighted: Sequence[str], medians: Sequence[str],
                 score: str) -> DataFrame:
    """Counts, population, population-weighted means, medians and mean score per zone."""
    return group_summary(
        df, zone,
        aggs=[F.count(F.lit(1)).alias("tracts"), F.coalesce(F.sum(pop), F.lit(0.0)).alias("total_population"),
              *[safe_weighted_mean(c, pop).alias(f"{c}_wtd") for c in weighted], F.avg(score).alias(f"mean_{score}")],
        medians={f"{c}_median": c for c in medians})


def kmeans_peers(df: DataFrame, ids: Sequence[str], features: Sequence[str], k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(assignment, profile): standardised k-means groups and their feature means."""
    known = settled(df).dropna(subset=list(features))  # fitting and assigning read the rows many times
    vec = VectorAssembler(inputCols=list(features), outputCol="__raw").transform(known)
    scaled = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(vec).transform(vec)
    model = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="peer_group").fit(scaled)
    out = model.transform(scaled).withColumn("__z", vector_to_array("__x"))
    assign = out.select(*ids, *features, F.col("peer_group").cast("bigint").alias("peer_group"))
    profile = assign.groupBy("peer_group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in features])
    return assign, profile
