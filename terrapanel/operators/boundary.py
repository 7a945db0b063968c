"""Zone boundaries as closed geometries, put together from the polygons of each zone.

Every step is a join or an aggregation by place, so neither a zone nor a ring is
ordered inside one task: edges are cut at the vertices that lie on them, edges
that two polygons run along in opposite directions cancel, every edge left finds
the one after it at its end, and pointer jumping gives each edge its ring and its
place there in as many rounds as the longest ring's length has binary digits.
Only the finished rings and geometries are gathered, as values of a row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.spatial import _edge_cells, _twice_area, point_in_polygon, ring_edges
from terrapanel.session import store


def _along(p: Column, q: Column, v: Column) -> Column:
    """Place of `v` between `p` (0) and `q` (1)."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    return ((v["x"] - p["x"]) * dx + (v["y"] - p["y"]) * dy) / (dx * dx + dy * dy)


def noded_edges(polys: DataFrame, zone: Sequence[str], ring: str = "ring", cell: float = 1.0, digits: int = 6) -> DataFrame:
    """Directed edges z (struct of the zone's columns), p, q of all polygons, the inside on their left.

    Each edge is cut at all vertices of its zone that lie on it. Vertices and
    edges meet in grid cells of side `cell`. Coordinates are rounded to `digits`.
    """
    at = lambda x, y: F.struct((F.round(x, digits) + 0.0).alias("x"), (F.round(y, digits) + 0.0).alias("y"))
    left = F.when(_twice_area(ring) < 0, F.reverse(F.col(f"`{ring}`"))).otherwise(F.col(f"`{ring}`"))
    e = polys.filter(F.size(f"`{ring}`") > 1).select(F.struct(*[F.col(f"`{c}`") for c in zone]).alias("z"), F.explode(ring_edges(left)).alias("e"))
    e = e.select("z", at(F.col("e.x1"), F.col("e.y1")).alias("p"), at(F.col("e.x2"), F.col("e.y2")).alias("q")).filter("p <> q")
    e = store(e.withColumn("id", F.monotonically_increasing_id()))
    near = 10.0**-digits
    line = F.struct(F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))
    cells = e.select("z", "id", "p", "q", F.explode(_edge_cells(line, F.lit(float(cell)), near)).alias("c")).select("z", "id", "p", "q", "c.cx", "c.cy")
    v = e.select("z", F.col("p").alias("v")).distinct().withColumns({
        "cx": F.floor(F.col("v.x") / cell).cast("bigint"), "cy": F.floor(F.col("v.y") / cell).cast("bigint")})
    p, q, w = F.col("p"), F.col("q"), F.col("v")
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    off = F.abs(dx * (w["y"] - p["y"]) - dy * (w["x"] - p["x"])) / F.sqrt(dx * dx + dy * dy)
    t = _along(p, q, w)
    on = cells.join(v, ["z", "cx", "cy"]).filter((off <= near) & (t > 0) & (t < 1) & (w != p) & (w != q))
    # an edge's cuts are part of one geometry
    cuts = on.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(t.alias("t"), w.alias("v")))).alias("cuts"))
    path = F.concat(F.array("p"), F.coalesce(F.transform("cuts", lambda c: c["v"]), F.slice(F.array("p"), F.lit(1), F.lit(0))), F.array("q"))
    whole = e.join(cuts, "id", "left").select("z", path.alias("path"))
    steps = F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    return whole.select("z", F.explode(steps).alias("e")).select("z", "e.p", "e.q")


def outline_edges(polys: DataFrame, zone: Sequence[str], ring: str = "ring", cell: float = 1.0, digits: int = 6) -> DataFrame:
    """Directed boundary edges z, p, q of each zone: what polygons pass both ways is inside and goes."""
    e = noded_edges(polys, zone, ring, cell, digits)
    forward = F.col("p") < F.col("q")
    net = e.groupBy("z", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("net")).filter("net <> 0")
    return net.select("z", F.when(F.col("net") > 0, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(F.col("net") > 0, F.col("b")).otherwise(F.col("a")).alias("q"))


def rings_of_edges(edges: DataFrame) -> DataFrame:
    """Closed rings z, id, ring, area of directed edges z, p, q; outsides run against the clock (area > 0), holes with it.

    At a vertex that several edges leave, the one that bounds the same piece of
    the inside follows, so pieces that only touch in a point are rings of their own.
    """
    e = store(edges.withColumn("id", F.monotonically_increasing_id()))
    out = e.select("z", F.col("p").alias("q"), F.col("q").alias("to"), F.col("id").alias("next"))
    rx, ry = F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")
    dx, dy = F.col("to.x") - F.col("q.x"), F.col("to.y") - F.col("q.y")
    turn = -F.atan2(rx * dy - ry * dx, rx * dx + ry * dy)  # clockwise from the way back
    turn = F.when(turn <= 0, turn + 2 * pi).otherwise(turn)
    follow = e.join(out, ["z", "q"]).groupBy("z", "p", "q", "id").agg(F.min_by("next", F.struct(turn, "next")).alias("next"))
    # low: the smallest start among the edges seen from here on, far: how many steps away it is
    state = store(follow.select("z", "p", "id", F.col("next").alias("jump"), F.struct("p", "id").alias("low"), F.lit(0).cast("bigint").alias("far")))
    width, moved = 1, not state.isEmpty()
    while moved:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"), F.col("far").alias("far2"))
        lower = F.col("low2") < F.col("low")
        state = store(state.join(ahead, "jump").select(
            "z", "p", "id", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low"),
            F.when(lower, F.col("far2") + width).otherwise(F.col("far")).alias("far"), lower.alias("moved")))
        moved = not state.filter("moved").isEmpty()
        state, width = state.drop("moved"), width * 2
    first = F.when(F.col("far") == 0, F.lit(-(2**62)).cast("bigint")).otherwise(-F.col("far"))
    rings = state.groupBy("z", F.col("low.id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(first.alias("at"), "p"))).alias("pts"))
    rings = rings.select("z", "id", F.transform("pts", lambda x: x["p"]).alias("open")).select("z", "id", F.concat("open", F.slice("open", F.lit(1), F.lit(1))).alias("ring"))
    return store(rings.withColumn("area", _twice_area("ring") / 2))


def zone_polygons(polys: DataFrame, zone: Sequence[str], ring: str = "ring", cell: float = 1.0, digits: int = 6) -> DataFrame:
    """One geometry for each zone: its columns and `parts`, as `geometry` describes them, for WKT and WKB.

    Holes lie with the smallest outside around them; parts, holes and the start
    of each ring are in order of their points, so equal zones give equal values.
    The polygons of a zone may touch along whole edges or parts of them, or in
    points, but not overlap. A zone whose rings are all NULL or empty has no row.
    """
    rings = rings_of_edges(outline_edges(polys, zone, ring, cell, digits))
    outside = rings.filter("area > 0").select(F.col("id").alias("around"), F.col("z").alias("own"), F.col("ring").alias("shape"), "area")
    # the middle of a hole's edge is never on the outside's own edges
    holes = rings.filter("area < 0").select("z", "id", F.col("ring").alias("hole"), *[
        ((F.col("ring")[0][c] + F.col("ring")[1][c]) / 2).alias(f"m{c}") for c in "xy"])
    inside = point_in_polygon(holes.select("z", "id", "mx", "my"), outside, "mx", "my", "around", "shape", cell)
    parent = inside.join(outside.select("around", "own", "area"), "around").filter("z = own").groupBy("id").agg(
        F.min_by("around", F.struct("area", "around")).alias("around"))
    held = holes.join(parent, "id").groupBy("around").agg(F.array_sort(F.collect_list("hole")).alias("holes"))
    part = F.concat(F.array("shape"), F.coalesce("holes", F.slice(F.array("shape"), F.lit(1), F.lit(0))))
    return outside.join(held, "around", "left").groupBy("own").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        *[F.col(f"own.`{c}`").alias(c) for c in zone], "parts")
