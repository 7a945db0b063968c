"""Parts and holes, binary geometry, points on surfaces and overlaps against plain Python."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from terrapanel.operators import geometry as G
from terrapanel.operators import spatial as S

SHAPES = {
    "square": [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]],
    "hole": [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 3.5), (3.0, 3.5), (3.0, 1.0), (1.0, 1.0)]]],
    "parts": [[[(0.0, 0.0), (1.0, 0.0), (0.5, 1.0), (0.0, 0.0)]], [[(-5.5, 7.25), (-4.0, 7.25), (-4.0, 9.0), (-5.5, 7.25)], [(-4.2, 7.4), (-4.1, 7.4), (-4.1, 7.5), (-4.2, 7.4)]]],
    "u": [[[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (7.0, 9.0), (7.0, 1.0), (1.5, 1.0), (1.5, 9.0), (0.0, 9.0), (0.0, 0.0)]]],
}
POINTS = [0.0, -0.0, 1.0, -1.0, 0.1, -123.456789, 1e308, -1.7976931348623157e308, 2.2250738585072014e-308, 5e-324, -3e-310, 2.0**-30, 3.9999999999999996, 1 / 3]


def wkb(parts, order="<", force_multi=False):
    mark = b"\x01" if order == "<" else b"\x00"
    one = lambda rings: mark + struct.pack(f"{order}II", 3, len(rings)) + b"".join(
        struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}dd", *p) for p in r) for r in rings)
    if len(parts) == 1 and not force_multi:
        return one(parts[0])
    return mark + struct.pack(f"{order}II", 6, len(parts)) + b"".join(map(one, parts))


def plain(parts):
    return None if parts is None else [[[(p["x"], p["y"]) for p in r] for r in rings] for rings in parts]


def same_bits(a, b):
    return struct.pack("d", a) == struct.pack("d", b)


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(4)
    values = POINTS + [rnd.uniform(-180, 180) for _ in range(20)] + [math.ldexp(rnd.random(), rnd.randint(-1000, 1000)) for _ in range(20)]
    return [[[(v, rnd.choice(values)) for v in values]]]


def test_wkb_is_read_in_both_byte_orders(spark, odd):
    shapes = [*SHAPES.values(), odd, []]
    rows = [(k, bytearray(wkb(s, o, m))) for k, s in enumerate(shapes) for o in "<>" for m in ((False, True) if len(s) == 1 else (True,))]
    rows += [(99, None), (99, bytearray(struct.pack("<BIdd", 1, 1, 2.0, 3.0)))]
    for r in spark.createDataFrame(rows, "k int, w binary").select("k", G.parts_from_wkb("w").alias("p")).collect():
        got = plain(r.p)
        assert (got is None) if r.k == 99 else got == shapes[r.k]
        if r.k == len(SHAPES):
            assert all(same_bits(a, b) for p, q in zip(got[0][0], shapes[r.k][0][0]) for a, b in zip(p, q))


def test_wkb_round_trip_is_exact(spark, odd):
    shapes = [*SHAPES.values(), odd, []]
    df = spark.createDataFrame([(k, [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in s]) for k, s in enumerate(shapes)], f"k int, p {G.PARTS}")
    for r in df.select("k", G.wkb_from_parts("p").alias("w")).collect():
        assert bytes(r.w) == wkb(shapes[r.k])


def test_wkt_keeps_parts_and_holes(spark):
    df = spark.createDataFrame([(k, [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in s]) for k, s in SHAPES.items()], f"k string, p {G.PARTS}")
    out = df.select("k", G.wkt_from_parts("p").alias("t"), G.parts_area("p").alias("area"), S.ring_area(G.path_from_parts("p")).alias("path")).withColumn("back", G.parts_from_wkt("t"))
    for r in out.collect():
        assert plain(r.back) == SHAPES[r.k] and r.t.startswith("MULTI") == (len(SHAPES[r.k]) > 1) and r.area == pytest.approx(r.path)
    assert spark.range(1).select(G.parts_from_wkt(F.lit("POINT (1 2)")).alias("p")).first().p is None


def test_point_on_surface_lies_inside(spark):
    """Also of a ring with a hole in the middle, of several parts, and of a U whose centroid is outside."""
    df = spark.createDataFrame([(k, [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in s]) for k, s in SHAPES.items()], f"k string, p {G.PARTS}")
    df = df.withColumn("ring", G.path_from_parts("p")).withColumn("s", S.point_on_surface("ring")).withColumn("c", S.ring_centroid("ring"))
    got = {r.k: (r.inside, r.centre) for r in df.select("k", S.inside_ring(F.col("s.x"), F.col("s.y"), F.col("ring")).alias("inside"),
                                                        S.inside_ring(F.col("c.x"), F.col("c.y"), F.col("ring")).alias("centre")).collect()}
    assert all(v[0] for v in got.values()) and not got["u"][1] and not got["hole"][1]
    flat = spark.range(1).select(S.ring_from_wkt(F.lit("POLYGON ((1 2, 3 2, 1 2))")).alias("r")).select(S.point_on_surface("r").alias("s")).first().s
    assert (flat.x, flat.y) == (1.0, 2.0)


def box(x, y, w, h):
    return f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"


def test_overlaps_of_boxes(spark):
    """Boxes that cross, lie within each other, are equal, touch along a side or at a corner, or are apart."""
    rnd = random.Random(8)
    boxes = [(rnd.randint(0, 12), rnd.randint(0, 12), rnd.randint(1, 5), rnd.randint(1, 5)) for _ in range(24)] + [(0, 0, 9, 9), (2, 2, 1, 1), (2, 2, 1, 1)]
    a, b = boxes[:14] + boxes[24:26], boxes[14:]
    make = lambda bs, name: spark.createDataFrame([(k, box(*x)) for k, x in enumerate(bs)], f"{name} int, wkt string").select(name, S.ring_from_wkt("wkt").alias("ring"))
    got = {tuple(r) for r in G.polygons_overlap(make(a, "i"), make(b, "j"), "i", "j", cell=2.0).select("i", "j").collect()}
    meet = lambda p, q: p[0] < q[0] + q[2] and q[0] < p[0] + p[2] and p[1] < q[1] + q[3] and q[1] < p[1] + p[3]
    assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if meet(p, q)}


def test_overlap_counts_take_a_point_inside(spark):
    """A U-shaped district whose centroid lies in another metro counts where its area is."""
    u = "POLYGON ((0 0, 9 0, 9 9, 7 9, 7 1, 1.5 1, 1.5 9, 0 9, 0 0))"
    districts = spark.createDataFrame([(1, u)], "d int, wkt string").select("d", S.ring_from_wkt("wkt").alias("ring"))
    metros = spark.createDataFrame([(1, box(2, 2, 4, 6)), (2, box(3, 0, 3, 1))], "m int, wkt string").select("m", S.ring_from_wkt("wkt").alias("ring"))
    assert {r.m: r.n for r in S.overlap_counts(districts, metros, "d", "m").collect()} == {1: 0, 2: 1}
