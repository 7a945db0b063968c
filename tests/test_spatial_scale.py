"""Spatial joins on uneven data: lengths far apart, dense cells, ties."""

import random

from pyspark.sql import functions as F

from terrapanel.operators import graph as GR
from terrapanel.operators import spatial as G


def box(i, x0, y0, x1, y1):
    pts = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return (i, "POLYGON ((" + ", ".join(f"{a} {b}" for a, b in pts) + "))")


def test_edges_of_any_length_are_listed_under_four_cells(frame):
    rnd = random.Random(3)
    rows = [(i, {"x1": a, "y1": b, "x2": a + rnd.uniform(-1, 1) * 10.0**k, "y2": b + rnd.uniform(-1, 1) * 10.0**k})
            for i, k, a, b in ((10 * k + j, k, rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for k in range(-3, 7) for j in range(10))]
    rows += [(900, {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 0.0}), (901, {"x1": 0.0, "y1": 0.0, "x2": 1048576.0, "y2": 1048576.0})]
    df = frame(rows, "id int, e struct<x1: double, y1: double, x2: double, y2: double>")
    n = {r["id"]: r["count"] for r in G.edge_index(df, 5e-7).groupBy("id").count().collect()}
    assert set(n) == {r[0] for r in rows} and max(n.values()) <= 4


def test_long_border_among_short_ones(frame, values):
    """A polygon of width 10^6 beside unit squares: each square touches it and its neighbours."""
    shapes = [box(0, 0, -1000000, 1000000, 0), *[box(i, 7 * 10**4 + i, 0, 7 * 10**4 + i + 1, 1) for i in range(1, 6)], box(9, 5, 3, 6, 4)]
    df = frame(shapes, "id int, wkt string").withColumn("ring", G.ring_from_wkt("wkt"))
    assert values(G.adjacency_edges(df, "id"), "src", "dst") == [(0, i) for i in range(1, 6)] + [(i, i + 1) for i in range(1, 5)]


def test_dense_cell_is_dealt_over_tasks(frame, spark):
    rnd = random.Random(4)
    pts = [(i, rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(400)] + [(1000 + i, 5 + rnd.random() * 0.4, 5 + rnd.random() * 0.4) for i in range(100)]
    eps = 0.5
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= eps * eps}
    df = frame(pts, "id int, x double, y double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = G.within_distance(df, "id", "x", "y", eps, cell_rows=20).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(want) and {(r.src, r.dst) for r in got} == want
    assert len({r.task for r in got if r.src >= 1000}) > 1
    assert {(r.src, r.dst) for r in G.within_distance(df, "id", "x", "y", eps).collect()} == want


def nearest(pts, targets):
    return {p[0]: min(((p[1] - t[1]) ** 2 + (p[2] - t[2]) ** 2, t[0]) for t in targets)[1] for p in pts}


def test_equal_distances_go_to_the_smallest_target(frame):
    targets = [(i, 100.0 + (i % 3), 100.0 + (i // 3)) for i in range(9)] + [(20, 100.0, 100.0), (21, 100.0, 100.0)]
    p = frame([(1, 0.0, 0.0), (2, 101.5, 100.5), (3, -5.0, 101.0)], "id int, x double, y double")
    got = G.assign_nearest(p, frame(targets, "t int, tx double, ty double"), "id", "x", "y", "t", "tx", "ty", step=0.25)
    assert {r["id"]: r.t for r in got.collect()} == nearest([(1, 0.0, 0.0), (2, 101.5, 100.5), (3, -5.0, 101.0)], targets)


def test_refined_links_join_components(frame):
    """Many blobs in a row whose nearest points are just near enough, so that links are found below the first level."""
    rnd = random.Random(9)
    pts, n = [], 0
    for b in range(6):
        gap = 0.4999 if b % 2 else 0.5001
        left = 0.0 if not pts else max(p[1] for p in pts) + gap
        blob = [(left, 0.2)] + [(left + rnd.random() * 0.3, rnd.random() * 0.4) for _ in range(20)] + [(left + 0.3, 0.2)]
        pts += [(n + k, x, y) for k, (x, y) in enumerate(blob)]
        n += len(blob)
    pairs = [(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.25]
    parent = {p[0]: p[0] for p in pts}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = GR.distance_clusters(frame(pts, "id int, x double, y double"), "id", "x", "y", 0.5, policy="own")
    assert {r["id"]: r.component for r in got.collect()} == {v: find(v) for v in parent}


def test_adjacency_sends_no_side_through_the_driver(frame):
    """Vertices and edges look as small as their polygons' file, however many they are."""
    df = frame([box(i, i, 0, i + 1, 1) for i in range(4)], "id int, wkt string").withColumn("ring", G.ring_from_wkt("wkt"))
    plan = G.adjacency_edges(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_search_for_the_nearest_starts_with_few_targets_in_a_cell(frame):
    """Targets crowd in one cell of the step asked for, and half of them at one place."""
    rnd = random.Random(5)
    targets = [(i, rnd.random() * 0.04, rnd.random() * 0.04) for i in range(200)] + [(500 - i, 0.01, 0.01) for i in range(200)]
    pts = [(i, rnd.random() * 0.05, rnd.random() * 0.05) for i in range(60)] + [(99, 3.0, -2.0), (100, 0.01, 0.01)]
    t, p = frame(targets, "t int, tx double, ty double"), frame(pts, "id int, x double, y double")
    side = G.first_side(t.dropDuplicates(["tx", "ty"]), "tx", "ty", 0.05, 3.0)
    assert t.dropDuplicates(["tx", "ty"]).groupBy(F.floor(F.col("tx") / side), F.floor(F.col("ty") / side)).count().agg(F.max("count")).first()[0] <= 16
    got = G.assign_nearest(p, t, "id", "x", "y", "t", "tx", "ty", step=0.05)
    assert {r["id"]: r.t for r in got.collect()} == nearest(pts, targets)
