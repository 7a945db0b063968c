"""Polygons of several parts with holes, in Spark expressions only.

A polygon here is `parts`: array<array<array<struct<x, y>>>>, parts of rings of
points, the first ring of a part its outside and the others its holes. It is
read from and written to WKT and WKB without loss. `path_from_parts` turns it
into the one closed path that the functions of `spatial` take.

Spark has no function for the bits of a double; they are put together from
sign, exponent and mantissa, exactly, for all finite values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.spatial import _edge_cells, _let, point_in_polygon, point_on_surface, ring_edges, ring_from_wkt
from terrapanel.session import spread

RINGS = "array<array<struct<x:double,y:double>>>"
PARTS = f"array<{RINGS}>"
# fixed values of the WKB format
_POLYGON, _MULTIPOLYGON = 3, 6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(count: Column, start: Column, step: Callable[[Column], Column]) -> Column:
    """`step` applied `count` times, from `start` on."""
    return F.aggregate(F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>")), start, lambda s, _: step(s))


# ---- WKT ------------------------------------------------------------------


def parts_from_wkt(wkt: Column | str) -> Column:
    """Parts of a `POLYGON` or `MULTIPOLYGON` text; NULL for other texts."""
    c = _col(wkt)
    parts = F.regexp_extract_all(c, F.lit(r"\(\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*\)"), F.lit(0))

    def points(ring: Column) -> Column:
        pairs = F.transform(F.split(F.regexp_replace(ring, "[()]", ""), ","), lambda p: F.split(F.trim(p), r"\s+"))
        return F.transform(pairs, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))

    found = F.transform(parts, lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\([^()]*\)"), F.lit(0)), points))
    return F.when(c.rlike(r"(?i)^\s*(MULTI)?POLYGON"), found)


def wkt_from_parts(parts: Column | str) -> Column:
    """`POLYGON` of one part, `MULTIPOLYGON` of none or several."""
    def ring(r: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))

    texts = F.transform(_col(parts), lambda rings: F.concat(F.lit("("), F.array_join(F.transform(rings, ring), ", "), F.lit(")")))
    one = F.concat(F.lit("POLYGON "), texts[0])
    several = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(texts, ", "), F.lit(")"))
    return F.when(F.size(texts) == 1, one).when(F.size(texts) > 1, several).when(F.size(texts) == 0, F.lit("MULTIPOLYGON EMPTY"))


def path_from_parts(parts: Column | str) -> Column:
    """The parts as one closed path with bridges, as `spatial` describes it."""
    return ring_from_wkt(wkt_from_parts(parts))


def parts_area(parts: Column | str) -> Column:
    """Area of all outsides less that of all holes, whichever way the rings run."""
    def area(r: Column) -> Column:
        return F.abs(F.aggregate(ring_edges(r), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2

    signed = F.transform(_col(parts), lambda rings: F.aggregate(
        F.transform(rings, lambda r, i: F.when(i == 0, area(r)).otherwise(-area(r))), F.lit(0.0), lambda s, x: s + x))
    return F.aggregate(signed, F.lit(0.0), lambda s, x: s + x)


# ---- WKB ------------------------------------------------------------------


def _turned(digits: Column) -> Column:
    """Hexadecimal with its bytes in reverse order."""
    return F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")


def _hex(data: Column, at: Column, n: int, little: Column) -> Column:
    """n bytes from `at` (from 0) on as hexadecimal, the most significant first; `data` holds all digits both ways round."""
    back = (data["n"] - at - n).cast("int")
    turned = F.when(back >= 0, F.substring(data["back"], 2 * back + 1, F.lit(2 * n))).otherwise("")
    return F.when(little, turned).otherwise(F.substring(data["digits"], 2 * at.cast("int") + 1, F.lit(2 * n)))


def _is_little(data: Column, at: Column) -> Column:
    return F.substring(data["digits"], 2 * at.cast("int") + 1, F.lit(2)) == "01"


def _uint(data: Column, at: Column, little: Column) -> Column:
    return F.conv(_hex(data, at, 4, little), 16, 10).cast("bigint")


def _double(data: Column, at: Column, little: Column) -> Column:
    def value(h: Column) -> Column:
        mantissa = F.conv(F.substring(h, F.lit(4), F.lit(13)), 16, 10).cast("double")

        def scaled(head: Column) -> Column:
            power = head % 2048
            # in two factors, so that none of them leaves the range of a double
            half = F.floor((power - 1075) / 2)
            normal = (mantissa + 2.0**52) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - 1075 - half)
            small = mantissa * 2.0**-537 * 2.0**-537
            size = F.when(power == 0, small).otherwise(normal)
            return F.when(head >= 2048, -size).otherwise(size)

        return _let(F.conv(F.substring(h, F.lit(1), F.lit(3)), 16, 10).cast("bigint"), scaled)

    return _let(_hex(data, at, 8, little), value)


def _polygon(data: Column, start: Column) -> Column:
    """The polygon that begins at a byte: its rings and the byte after it."""
    little = _is_little(data, start)

    def ring(s: Column) -> Column:
        def read(n: Column) -> Column:
            first = s["end"] + 4
            places = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
            points = F.transform(places, lambda k: F.struct(
                _double(data, first + 16 * k, little).alias("x"), _double(data, first + 16 * k + 8, little).alias("y")))
            return F.struct(F.concat(s["rings"], F.array(points)).alias("rings"), (first + 16 * n).alias("end"))

        return _let(_uint(data, s["end"], little), read)

    return _fold(_uint(data, start + 5, little), F.struct(F.array().cast(RINGS).alias("rings"), (start + 9).alias("end")), ring)


def parts_from_wkb(wkb: Column | str) -> Column:
    """Parts of a polygon or multipolygon in well-known binary, of either byte order; NULL for other kinds."""
    zero = F.lit(0).cast("bigint")

    def read(data: Column) -> Column:
        little = _is_little(data, zero)
        kind = _uint(data, zero + 1, little)

        def part(s: Column) -> Column:
            return _let(_polygon(data, s["end"]), lambda p: F.struct(F.concat(s["parts"], F.array(p["rings"])).alias("parts"), p["end"].alias("end")))

        many = _fold(_uint(data, zero + 5, little), F.struct(F.array().cast(PARTS).alias("parts"), (zero + 9).alias("end")), part)
        return F.when(kind == _POLYGON, F.array(_polygon(data, zero)["rings"])).when(kind == _MULTIPOLYGON, many["parts"])

    # the bytes are turned into digits once, not for each number
    digits = F.hex(_col(wkb))
    return _let(F.struct(digits.alias("digits"), _turned(digits).alias("back"), F.octet_length(_col(wkb)).alias("n")), read)


def _number(n: Column) -> Column:
    """Eight digits of a count, the most significant byte first."""
    return F.lpad(F.hex(n), 8, "0")


def _double_hex(x: Column) -> Column:
    """The sixteen digits of a double, the most significant byte first."""
    def bits(a: Column) -> Column:
        def exact(e: Column) -> Column:
            # the logarithm can be one off beside a power of two
            half = F.floor(e / 2)
            m = a / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), e - half)
            return F.when(m >= 2, e + 1).when(m < 1, e - 1).otherwise(e)

        def normal(e: Column) -> Column:
            half = F.floor(e / 2)
            m = a / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), e - half)
            return F.shiftleft((e + 1023).cast("bigint"), 52) + ((m - 1) * 2.0**52).cast("bigint")

        small = (a * 2.0**537 * 2.0**537).cast("bigint")
        return F.when(a < 2.0**-1022, small).otherwise(_let(_let(F.floor(F.log2(a)), exact), normal))

    negative = (x < 0) | (x.cast("string") == "-0.0")
    return F.lpad(F.hex(bits(F.abs(x)) + F.when(negative, F.lit(-(2**63)).cast("bigint")).otherwise(0)), 16, "0")


def wkb_from_parts(parts: Column | str) -> Column:
    """Little-endian well-known binary: a polygon of one part, a multipolygon of none or several."""
    def head(kind: int, n: Column) -> Column:
        return F.array(F.lit("01"), F.lit(f"{kind:08x}"), _number(n))

    def ring(r: Column) -> Column:
        # a point is one field; turning all digits round at the end swaps its numbers
        return F.concat(F.array(_number(F.size(r))), F.transform(r, lambda p: F.concat(_double_hex(p["y"]), _double_hex(p["x"]))))

    fields = F.flatten(F.transform(_col(parts), lambda rings: F.concat(head(_POLYGON, F.size(rings)), F.flatten(F.transform(rings, ring)))))
    whole = F.when(F.size(_col(parts)) == 1, fields).otherwise(F.concat(head(_MULTIPOLYGON, F.size(_col(parts))), fields))
    return F.unhex(_turned(F.array_join(F.reverse(whole), "")))


# ---- points and pairs -----------------------------------------------------


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_cross(e: Column, f: Column) -> Column:
    """Whether two segments pass through each other; touching at an end or running along one another does not count."""
    one = _side(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"]) * _side(e["x1"], e["y1"], e["x2"], e["y2"], f["x2"], f["y2"])
    two = _side(f["x1"], f["y1"], f["x2"], f["y2"], e["x1"], e["y1"]) * _side(f["x1"], f["y1"], f["x2"], f["y2"], e["x2"], e["y2"])
    return (one < 0) & (two < 0)


def polygons_overlap(a: DataFrame, b: DataFrame, a_id: str, b_id: str, ring: str = "ring", cell: float = 1.0) -> DataFrame:
    """Pairs of polygons with area in common, each pair once.

    Two polygons overlap where edges of theirs cross, or where a point inside
    one, or the middle of one of its edges, lies inside the other. Edges meet in
    grid cells of side `cell`; the points are looked up by `point_in_polygon`.
    Polygons that only touch do not overlap. A path without points pairs with none.
    A polygon becomes some twenty places and more, so polygons are dealt over tasks first.
    """
    a, b = (spread(df.select(f"`{i}`", ring), f"`{i}`") for df, i in ((a, a_id), (b, b_id)))

    def edges(df: DataFrame, id_col: str, name: str) -> DataFrame:
        e = df.select(F.col(f"`{id_col}`").alias(f"{name}_id"), F.explode(ring_edges(ring)).alias(name))
        return e.select("*", F.explode(_edge_cells(F.col(name), F.lit(float(cell)), 1e-9)).alias("c")).select(f"{name}_id", name, "c.cx", "c.cy")

    def inside(points_of: DataFrame, points_id: str, polys: DataFrame, poly_id: str, names: tuple[str, str]) -> DataFrame:
        surface = points_of.select(F.col(f"`{points_id}`").alias("of"), point_on_surface(ring).alias("p"))
        middles = points_of.select(F.col(f"`{points_id}`").alias("of"), F.explode(ring_edges(ring)).alias("e")).select(
            "of", F.struct(((F.col("e.x1") + F.col("e.x2")) / 2).alias("x"), ((F.col("e.y1") + F.col("e.y2")) / 2).alias("y")).alias("p"))
        places = surface.unionByName(middles).select("of", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
        # a middle counts only off the other's border, where points just beside it lie on the same side
        beside = F.array_distinct(F.array(*[F.struct((F.col("px") + dx).alias("x"), (F.col("py") + dy).alias("y")) for dx in (-1e-7, 1e-7) for dy in (-1e-7, 1e-7)]))
        four = places.distinct().select("of", F.col("px").alias("mx"), F.col("py").alias("my"), F.explode(beside).alias("q")).select("of", "mx", "my", F.col("q.x").alias("px"), F.col("q.y").alias("py"))
        shapes = polys.select(F.col(f"`{poly_id}`").alias("shape"), F.col(ring).alias("ring"))
        hits = point_in_polygon(four, shapes.hint("merge"), "px", "py", "shape", "ring", cell).groupBy("of", "mx", "my", "shape").agg(F.count(F.lit(1)).alias("n"))
        return hits.filter("n = 4").select(F.col("of").alias(names[0]), F.col("shape").alias(names[1]))

    crossing = edges(a, a_id, "e").join(edges(b, b_id, "f").hint("merge"), ["cx", "cy"]).filter(segments_cross(F.col("e"), F.col("f"))).select(
        F.col("e_id").alias("a_id"), F.col("f_id").alias("b_id"))
    pairs = crossing.unionByName(inside(a, a_id, b, b_id, ("a_id", "b_id"))).unionByName(inside(b, b_id, a, a_id, ("b_id", "a_id")))
    return pairs.distinct().withColumnsRenamed({"a_id": f"{a_id}", "b_id": f"{b_id}"} if a_id != b_id else {"a_id": f"{a_id}_a", "b_id": f"{b_id}_b"})
