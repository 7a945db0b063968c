"""GR: components, zones, clusters, peer groups."""

from pyspark.sql import functions as F

from catalog import standins as S
from catalog.joins import GRID_SQL, POINTS_SQL, grid_polys, points
from catalog.registry import query
from terrapanel.operators import graph as GR
from terrapanel.operators import spatial as G
from terrapanel.session import store

# transitive closure: every vertex with everything it reaches, then the smallest
REACH = """reach AS (SELECT id, id AS other FROM v UNION SELECT reach.id, e.dst FROM reach JOIN e ON e.src = reach.other)"""
CC = "cc AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"
EPS = 0.0125


@query("gr01_connected_components", f"""
WITH RECURSIVE v AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), e0 AS (SELECT c_custkey AS a, c_custkey + 1 + c_custkey % 5 AS b FROM customer WHERE c_custkey % 4 <> 1),
e AS (SELECT a AS src, b AS dst FROM e0 WHERE a IN (SELECT id FROM v) AND b IN (SELECT id FROM v) UNION SELECT b, a FROM e0 WHERE a IN (SELECT id FROM v) AND b IN (SELECT id FROM v)),
{REACH}, {CC} SELECT id, component FROM cc""")
def gr01(t):
    k = F.col("c_custkey")
    v = t.customer.filter(k % 3 != 0).select(k.alias("id"))
    e = t.customer.filter(k % 4 != 1).select(k.alias("src"), (k + 1 + k % 5).alias("dst"))
    e = e.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return GR.connected_components(v, e)


_ZG = "v AS (SELECT id, x, y, c_acctbal FROM g WHERE id % 5 < 3)"


@query("gr02_contiguity_zones", f"""
WITH RECURSIVE {GRID_SQL}, {_ZG}, e AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.id <> b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
{REACH}, {CC}, z AS (SELECT component, count(*) AS tracts, avg(c_acctbal) AS mean_tract_score FROM cc JOIN v USING (id) GROUP BY component),
o AS (SELECT *, row_number() OVER (ORDER BY round(mean_tract_score, 9) DESC, component) AS zone_order FROM z)
SELECT id AS geo_id, component AS zone_component_id, zone_order, 'zone_' || lpad(CAST(zone_order AS VARCHAR), CAST(greatest(2, length(CAST(zone_order AS VARCHAR))) AS INTEGER), '0') AS zone_id, tracts, mean_tract_score FROM cc JOIN o USING (component)""",
       real="mean_tract_score")
def gr02(t):
    polys = grid_polys(t).filter("geo_id % 5 < 3")
    edges = G.adjacency_edges(polys, "geo_id")
    out, _ = GR.contiguity_zones(polys.select("geo_id", "c_acctbal"), edges, "geo_id", "c_acctbal")
    return out.select("geo_id", "zone_component_id", "zone_order", "zone_id", "tracts", "mean_tract_score")


@query("gr03_distance_clusters", f"""
WITH RECURSIVE {POINTS_SQL}, v AS (SELECT id FROM p), e AS (SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS} * {EPS}),
{REACH}, {CC}, s AS (SELECT component, count(*) AS n FROM cc GROUP BY component), core AS (SELECT component AS core_id, avg(x) AS cx, avg(y) AS cy FROM cc JOIN p USING (id) JOIN s USING (component) WHERE n >= 3 GROUP BY component),
near AS (SELECT p.id, core_id FROM p JOIN cc USING (id) JOIN s USING (component), core WHERE n < 3 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), core_id) = 1)
SELECT cc.id, component, n AS component_size, coalesce(core_id, component) AS cluster_raw_id FROM cc JOIN s USING (component) LEFT JOIN near ON near.id = cc.id""")
def gr03(t):
    out = GR.distance_clusters(points(t), "id", "x", "y", EPS, min_pts=3)
    return out.select("id", "component", "component_size", "cluster_raw_id")


@query("gr04_kmeans_peer_groups", S.sql_mart("tract", body="""
SELECT count(*) AS rows_in, count(*) AS rows_assigned, 5 AS groups, count(*) AS rows_in_groups, avg(income_pc) AS income_pc, avg(vacancy_rate) AS vacancy_rate, avg(pct_ba_plus) AS pct_ba_plus
FROM mart WHERE income_pc IS NOT NULL AND vacancy_rate IS NOT NULL AND pct_ba_plus IS NOT NULL"""), real="income_pc vacancy_rate pct_ba_plus", ints="groups")
def gr04(t):
    """What does not depend on the random start: every row has a group, and the profile adds up to the whole."""
    cols = ["income_pc", "vacancy_rate", "pct_ba_plus"]
    df = store(S.mart(t, "tract").select(F.concat_ws("-", "geo_id", F.col("year").cast("int").cast("string")).alias("geo_id"), *cols))
    assign, profile = GR.kmeans_peers(df, ["geo_id"], cols, 5)
    n, whole = F.col("n"), F.sum("n")
    groups = profile.agg(F.count(F.lit(1)).alias("groups"), whole.alias("rows_in_groups"), *[(F.sum(F.col(f"mean_{c}") * n) / whole).alias(c) for c in cols])
    given = df.dropna(subset=cols).select(F.count(F.lit(1))).scalar()
    assigned = assign.select(F.count("peer_group")).scalar()
    return groups.withColumns({"rows_in": given, "rows_assigned": assigned})
