"""Zone boundaries: T-junctions, holes, touching corners, nested parts, and random zones against a count of cells."""

import random

import pytest
from pyspark.sql import functions as F

from terrapanel.operators.boundary import outline_edges, zone_polygons
from terrapanel.operators.geometry import parts_area, parts_from_wkb, wkb_from_parts, wkt_from_parts
from terrapanel.session import store


def box(x, y, w=1, h=1, turned=False):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return [(float(a), float(b)) for a, b in (reversed(ring) if turned else ring)]


@pytest.fixture
def shapes(spark):
    def make(rows):
        return spark.createDataFrame(rows, "zone string, ring array<struct<x:double,y:double>>")
    return make


def points(parts):
    return [[[(p.x, p.y) for p in r] for r in part] for part in parts]


def test_long_edge_against_two_short_ones_leaves_no_inner_edge(shapes):
    df = shapes([("a", box(0, 0, 2, 1)), ("a", box(0, 1)), ("a", box(1, 1, turned=True))])
    got = zone_polygons(df, ["zone"]).collect()
    assert len(got) == 1
    assert points(got[0].parts) == [[[(0, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1), (0, 0)]]]
    assert outline_edges(df, ["zone"]).filter("p.y = 1 AND q.y = 1").count() == 0


def test_hole_with_an_island_and_corner_to_corner_parts(shapes):
    frame = [("a", box(x, y)) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4)]
    df = shapes(frame + [("a", box(2, 2)), ("a", box(5, 5)), ("b", box(2, 1)), (None, box(9, 9)), ("empty", None), ("empty", [])])
    got = {r.zone: points(r.parts) for r in zone_polygons(df, ["zone"]).collect()}
    assert set(got) == {"a", "b", None}
    assert [len(part) for part in got["a"]] == [2, 1, 1]  # frame with its hole, the island, the corner square
    assert got["a"][0][1][0] == (1, 1) and len(got["a"][0][1]) == 13
    assert got["b"] == [[box(2, 1)]] and got[None] == [[box(9, 9)]]


def _faces(cells):
    """Number of parts (cells joined by edges) and of holes (outside cells joined by edges or corners), by brute force."""
    def count(todo, steps):
        n = 0
        todo = set(todo)
        while todo:
            n, stack = n + 1, [todo.pop()]
            while stack:
                x, y = stack.pop()
                for dx, dy in steps:
                    if (x + dx, y + dy) in todo:
                        todo.remove((x + dx, y + dy))
                        stack.append((x + dx, y + dy))
        return n
    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    around = {(x, y) for x in range(-1, 13) for y in range(-1, 13)} - cells
    return count(cells, four), count(around, four + [(1, 1), (1, -1), (-1, 1), (-1, -1)]) - 1


def test_random_zones_have_the_area_parts_and_holes_of_their_cells(shapes):
    rnd = random.Random(4)
    zones = {f"z{k}": {(x, y) for x in range(12) for y in range(12) if rnd.random() < 0.35 + 0.15 * k} for k in range(4)}
    df = shapes([(z, box(x, y, turned=rnd.random() < 0.5)) for z, cells in zones.items() for x, y in cells]).repartition(7)
    out = store(zone_polygons(df, ["zone"], cell=2.0).withColumn("area", parts_area("parts")))
    got = {r.zone: r for r in out.collect()}
    again = {r.zone: r.parts for r in store(out.select("zone", wkb_from_parts("parts").alias("wkb"))).select("zone", parts_from_wkb("wkb").alias("parts")).collect()}
    for z, cells in zones.items():
        parts, holes = _faces(cells)
        assert got[z].area == len(cells)
        assert len(got[z].parts) == parts and sum(len(p) - 1 for p in got[z].parts) == holes
        assert again[z] == got[z].parts
        assert all(r[0] == r[-1] for part in got[z].parts for r in part)


def test_a_long_ring_takes_few_rounds_and_no_zone_is_an_empty_table(shapes):
    df = shapes([("a", box(x, 0)) for x in range(600)])
    row = store(zone_polygons(df, ["zone"], cell=8.0)).select(F.size(F.col("parts")[0][0]).alias("n"), wkt_from_parts("parts").alias("w")).first()
    assert row.n == 1203 and row.w.startswith("POLYGON ((0.0 0.0, 1.0 0.0")
    assert zone_polygons(df.filter("1 = 0"), ["zone"]).count() == 0
