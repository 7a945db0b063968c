"""Geometry and graph operators on shapes whose answer is known."""

import random

import pytest
from pyspark.sql import functions as F

from terrapanel.operators import graph as GR
from terrapanel.operators import spatial as G
from terrapanel.plans.zones import contiguity_zone_table


def sq(i, x, y, w=1.0):
    pts = [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    return (i, "POLYGON ((" + ", ".join(f"{a} {b}" for a, b in pts) + "))")


@pytest.fixture
def polys(frame):
    shapes = [sq(1, 0, 0), sq(2, 1, 0), sq(3, 2, 1), sq(4, 9, 9)]
    return frame(shapes, "id int, wkt string").withColumn("ring", G.ring_from_wkt("wkt"))


def test_area_centroid_and_wkt_round_trip(polys):
    r = polys.select("id", G.ring_area("ring").alias("a"), G.ring_centroid("ring").alias("c"), G.ring_from_wkt(G.wkt_from_ring("ring")).alias("b"), "ring").filter("id = 3").first()
    assert r.a == 1.0 and (r.c.x, r.c.y) == (2.5, 1.5) and r.b == r.ring


def test_adjacency_counts_edges_and_corners(polys, values):
    assert values(G.adjacency_edges(polys, "id"), "src", "dst") == [(1, 2), (2, 3)]


def test_point_in_polygon_assigns_borders_once(frame, polys, values):
    pts = frame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 5.0, 5.0), (4, 9.9, 9.1)], "p int, x double, y double")
    assert values(G.point_in_polygon(pts, polys, "x", "y", "id", cell=0.7), "p", "id") == [(1, 1), (2, 2), (4, 4)]


def test_parts_and_holes_add_up(frame):
    hole = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"
    parts = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((10 0, 11 0, 11 1, 10 1, 10 0)))"
    df = frame([(1, hole), (2, parts), (3, None)], "id int, wkt string").withColumn("ring", G.ring_from_wkt("wkt"))
    assert {r["id"]: r.a for r in df.select("id", G.ring_area("ring").alias("a")).collect()} == {1: 12.0, 2: 17.0, 3: None}
    c = df.filter("id = 1").select(G.ring_centroid("ring").alias("c")).first().c
    assert (c.x, c.y) == (2.0, 2.0)
    pts = frame([(1, 2.0, 2.0), (2, 0.5, 2.0), (3, 10.5, 0.5), (4, 7.0, 0.5)], "p int, x double, y double")
    got = G.point_in_polygon(pts, df, "x", "y", "id", cell=0.5, how="left")
    assert sorted((r.p, r["id"] or 0) for r in got.collect()) == [(1, 2), (2, 1), (2, 2), (3, 2), (4, 0)]


def test_large_polygon_is_listed_under_few_cells(frame):
    df = frame([sq(1, 0, 0, 100000.0), sq(2, 5, 5)], "id int, wkt string").withColumn("ring", G.ring_from_wkt("wkt"))
    pts = frame([(1, 5.5, 5.5), (2, 99999.0, 3.0)], "p int, x double, y double")
    got = G.point_in_polygon(pts, df, "x", "y", "id", cell=1.0)
    assert sorted((r.p, r["id"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_vertex_in_the_middle_of_an_edge_touches(frame, values):
    shapes = [sq(1, 0, 0, 4.0), sq(2, 4, 1), sq(3, 4, 3), sq(4, 4.5, 9)]
    df = frame(shapes, "id int, wkt string").withColumn("ring", G.ring_from_wkt("wkt"))
    assert values(G.adjacency_edges(df, "id"), "src", "dst") == [(1, 2), (1, 3)]


def test_dissolve_drops_shared_edge(polys, values):
    z = polys.withColumn("z", F.when(F.col("id") <= 2, "a").otherwise("b"))
    n = {r.z: r["count"] for r in G.dissolve(z, ["z"]).groupBy("z").count().collect()}
    assert n == {"a": 6, "b": 8}
    assert {r.z: r.zone_area for r in G.zone_areas(z, ["z"]).collect()} == {"a": 2.0, "b": 2.0}


def components(edges, vertices):
    parent = {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in vertices}


def test_components_chain_cliques_star_and_isolated(frame):
    chain = [(i, i + 1) for i in range(1, 50)]
    cliques = [(a, b) for base in (100, 110) for a in range(base, base + 5) for b in range(base, base + 5)] + [(104, 110)]
    star = [(200, i) for i in range(201, 260)] + [(230, 200), (231, 200)]
    edges = chain + cliques + star
    vertices = sorted({v for e in edges for v in e} | {999})
    got = GR.connected_components(frame([(v,) for v in vertices], "id int"), frame(edges, "src int, dst int"))
    assert {r["id"]: r.component for r in got.collect()} == components(edges, vertices)


def test_components_without_edges(frame):
    got = GR.connected_components(frame([(1,), (2,)], "id int"), frame([(1, 1)], "src int, dst int"))
    assert {r["id"]: r.component for r in got.collect()} == {1: 1, 2: 2}


def test_distance_clusters_match_all_pairs(frame):
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(150)] + [(1000 + i, 5 + rnd.uniform(0, 0.2), 5 + rnd.uniform(0, 0.2)) for i in range(150)]
    eps = 0.7
    pairs = [(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= eps * eps]
    df = frame(pts, "id int, x double, y double")
    got = {r["id"]: r.component for r in GR.distance_clusters(df, "id", "x", "y", eps, policy="own").collect()}
    assert got == components(pairs, [p[0] for p in pts])
    near = {(r.src, r.dst) for r in G.within_distance(df.filter("id < 1000"), "id", "x", "y", eps).collect()}
    assert near == {p for p in pairs if p[1] < 1000}


def test_small_clusters_join_nearest_core(frame):
    pts = [(1, 0.0, 0.0), (2, 0.1, 0.0), (3, 9.0, 0.0), (4, 9.1, 0.0), (5, 3.0, 0.0), (6, 70.0, 0.0)]
    out = GR.distance_clusters(frame(pts, "id int, x double, y double"), "id", "x", "y", 0.5, min_pts=2)
    assert {r["id"]: r.cluster_raw_id for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1, 6: 3}


def test_points_without_a_place_end_and_stay_apart(frame):
    pts = [(1, 0.0, 0.0), (2, 0.1, 0.0), (3, None, None), (4, None, 1.0), (5, float("nan"), 0.0), (6, 1e6, 1e6)]
    df = frame(pts, "id int, x double, y double")
    out = {r["id"]: (r.component, r.cluster_raw_id) for r in GR.distance_clusters(df, "id", "x", "y", 0.5, min_pts=2).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (None, None), 4: (None, None), 5: (None, None), 6: (6, 1)}
    near = G.assign_nearest(df, frame([(9, 0.0, 1.0), (8, None, 0.0)], "t int, tx double, ty double"), "id", "x", "y", "t", "tx", "ty", step=0.5)
    assert {r["id"]: r.t for r in near.collect()} == {1: 9, 2: 9, 3: None, 4: None, 5: None, 6: 9}


def test_two_dense_blobs_are_never_paired(frame, spark):
    """Just over and just under eps apart; the pairs looked at stay far below |A| x |B|."""
    rnd = random.Random(8)
    blob = lambda n, x: [(n + i, x - rnd.random() * 0.05, rnd.random() * 0.3) for i in range(400)]
    for gap, parts in ((0.7001, 2), (0.6999, 1)):
        left, right = [(i, min(x, 1.0), y) for i, x, y in blob(0, 1.0)], [(i, 2.0 - x + 1.0 + gap - 1.0, y) for i, x, y in blob(1000, 1.0)]
        left[0], right[0] = (0, 1.0, 0.15), (1000, 1.0 + gap, 0.15)
        df = frame(left + right, "id int, x double, y double")
        got = GR.distance_clusters(df, "id", "x", "y", 0.7, policy="own")
        assert len({r.component for r in got.collect()}) == parts


def test_letters(frame):
    big = frame([(26**6 + 5,), (26**6 + 5 + 26**5,)], "n long").select(GR.letters("n").alias("v"))
    assert len({r.v for r in big.collect()}) == 2
    df = frame([(1,), (26,), (27,), (702,), (703,)], "n int")
    assert [r.v for r in df.select(GR.letters("n").alias("v")).collect()] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_zone_table(frame, polys):
    cand = frame([(1, 5.0, 10.0, 0.1, 2.0, 3.0, 0.2), (2, 1.0, 30.0, 0.3, 2.0, 5.0, 0.4), (4, 9.0, 1.0, None, None, 1.0, 0.9)],
                 "id int, tract_score double, pop_total double, pop_growth_3yr double, units_per_1k_3yr double, pop_density double, price_proxy_pctl double")
    assigned, zones = contiguity_zone_table(cand, polys, "id")
    z = {r.zone_id: r for r in zones.collect()}
    assert z["zone_01"].tracts == 1 and z["zone_02"].tracts == 2 and z["zone_02"].zone_area == 2.0
    assert z["zone_02"].pop_growth_3yr_wtd == pytest.approx(0.25) and z["zone_02"].pop_density_median == 4.0


def test_kmeans_profile_covers_everything(frame):
    df = frame([(i, float(i % 3) * 10, float(i % 3)) for i in range(30)], "id int, a double, b double")
    assign, profile = GR.kmeans_peers(df, ["id"], ["a", "b"], 3)
    assert profile.agg(F.sum("n")).first()[0] == 30 and assign.select("peer_group").distinct().count() == 3
