"""Points, lines and polygons on the sphere, as plain column expressions.

A geography is a struct of a kind and its points: ``{kind, points: [{x, y}, ...]}`` with longitude ``x`` and latitude ``y`` in
degrees.  Distances are great-circle metres on a sphere of radius 6,371,010 m.  Polygons are single rings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6371010.0


def _shape(kind: str, points: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), points.alias("points"))


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column) -> Column:
    return _shape("POINT", F.array(_pair(x, y)))


def first(g: Column) -> Column:
    return F.try_element_at(g["points"], F.lit(1))


def apart(a: Column, b: Column) -> Column:
    """Metres between two {x, y}."""
    x1, y1, x2, y2 = (F.radians(v) for v in (a["x"], a["y"], b["x"], b["y"]))
    h = F.pow(F.sin((y2 - y1) / 2), F.lit(2)) + F.cos(y1) * F.cos(y2) * F.pow(F.sin((x2 - x1) / 2), F.lit(2))
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distance(a: Column, b: Column) -> Column:
    """The least distance between points of two geographies: exact for points, and for others between their corners."""
    return F.array_min(F.flatten(F.transform(a["points"], lambda p: F.transform(b["points"], lambda q: apart(p, q)))))


def length(g: Column) -> Column:
    p = g["points"]
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: apart(F.try_element_at(p, i), F.coalesce(F.try_element_at(p, i + 1), F.try_element_at(p, i))))
    return F.when(g["kind"] == "LINESTRING", F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))


def perimeter(g: Column) -> Column:
    return F.when(g["kind"] == "POLYGON", length(_shape("LINESTRING", g["points"]))).otherwise(F.lit(0.0))


def area(g: Column) -> Column:
    """Square metres inside a ring, by the spherical trapezoid rule."""
    p = g["points"]
    n = F.size(p)

    def part(i: Column) -> Column:
        a, b = F.try_element_at(p, i), F.try_element_at(p, F.when(i == n, 1).otherwise(i + 1))
        return F.radians(b["x"] - a["x"]) * (F.lit(2.0) + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"])))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), part), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(g["kind"] == "POLYGON", F.abs(total) * F.lit(RADIUS * RADIUS / 2)).otherwise(F.lit(0.0))


def contains(g: Column, h: Column) -> Column:
    """Whether a ring holds every corner of ``h`` (even-odd rule in degrees), or a point equals it."""
    p, n = g["points"], F.size(g["points"])

    def inside(q: Column) -> Column:
        def crosses(i: Column) -> Column:
            a, b = F.try_element_at(p, i), F.try_element_at(p, F.when(i == n, 1).otherwise(i + 1))
            at = a["x"] + (q["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"])
            return F.when(((a["y"] > q["y"]) != (b["y"] > q["y"])) & (q["x"] < at), 1).otherwise(0)

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), crosses), F.lit(0), lambda acc, x: acc + x) % 2 == 1

    return F.when(g["kind"] == "POLYGON", F.forall(h["points"], inside)).otherwise(F.forall(h["points"], lambda q: F.exists(p, lambda r: r == q)))


def text(g: Column) -> Column:
    """Well-known text."""
    pairs = F.array_join(F.transform(g["points"], lambda q: F.concat_ws(" ", _plain(q["x"]), _plain(q["y"]))), ", ")
    return F.concat(g["kind"], F.when(g["kind"] == "POLYGON", F.concat(F.lit("(("), pairs, F.lit("))"))).otherwise(F.concat(F.lit("("), pairs, F.lit(")"))))


def _plain(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def from_text(s: Column) -> Column:
    kind = F.upper(F.regexp_substr(s, F.lit("^[A-Za-z]+")))
    body = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]+\s*\(+", ""), r"\)+\s*$", "")
    points = F.transform(F.split(body, r"\s*,\s*"), lambda t: _pair(F.split(F.trim(t), r"\s+")[0], F.split(F.trim(t), r"\s+")[1]))
    return F.struct(kind.alias("kind"), points.alias("points"))


def json(g: Column) -> Column:
    pairs = F.transform(g["points"], lambda q: F.concat(F.lit("["), _plain(q["x"]), F.lit(", "), _plain(q["y"]), F.lit("]")))
    line = F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]"))
    shape = F.when(g["kind"] == "POINT", pairs[0]).when(g["kind"] == "POLYGON", F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    kind = F.when(g["kind"] == "POINT", "Point").when(g["kind"] == "POLYGON", "Polygon").otherwise("LineString")
    return F.concat(F.lit('{"type": "'), kind, F.lit('", "coordinates": '), shape, F.lit("}"))


def from_json(s: Column) -> Column:
    """A geography from the text of a GeoJSON geometry: point, line, or polygon of one ring."""
    kind = F.upper(F.get_json_object(s, "$.type"))
    pairs = F.regexp_extract_all(F.get_json_object(s, "$.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(0))
    numbers = F.transform(pairs, lambda t: F.split(F.regexp_replace(t, r"[\[\s]", ""), ","))
    return F.struct(kind.alias("kind"), F.transform(numbers, lambda t: _pair(t[0], t[1])).alias("points"))


#: Fixed value: the digits of geohashes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def _bits(x: Column, low: float, high: float) -> Column:
    """Thirty halvings of a range as a number."""
    cell = F.floor((x - low) / (high - low) * (1 << 30))
    return F.greatest(F.least(cell, F.lit((1 << 30) - 1)), F.lit(0)).cast("long")


def geohash(g: Column, size: Column | None = None) -> Column:
    """The geohash of a point, of 12 digits or ``size``."""
    lon, lat = _bits(first(g)["x"], -180, 180), _bits(first(g)["y"], -90, 90)

    def digit(i: Column) -> Column:
        def bit(k: Column) -> Column:  # longitude and latitude take turns
            at = i * 5 + k
            return F.call_function("shiftright", F.when(at % 2 == 0, lon).otherwise(lat), (29 - F.floor(at / 2)).cast("int")).bitwiseAND(F.lit(1))

        value = F.aggregate(F.sequence(F.lit(0), F.lit(4)), F.lit(0).cast("long"), lambda acc, k: acc * 2 + bit(k))
        return F.substr(F.lit(GEOHASH), (value + 1).cast("int"), F.lit(1))

    whole = F.when(lon.isNotNull() & lat.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), digit), ""))
    return whole if size is None else F.substr(whole, F.lit(1), size.cast("int"))


def from_geohash(s: Column) -> Column:
    """The middle of a geohash's cell."""
    digits = F.transform(F.filter(F.split(F.lower(s), ""), lambda c: c != ""), lambda c: F.instr(F.lit(GEOHASH), c) - 1)
    bits = F.flatten(F.transform(digits, lambda d: F.array(*[F.shiftright(d, k).bitwiseAND(F.lit(1)) for k in (4, 3, 2, 1, 0)])))

    def middle(start: int, low: float, high: float) -> Column:
        own = F.filter(bits, lambda b, i: i % 2 == start)
        empty = F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
        half = lambda r: (r["low"] + r["high"]) / 2
        cell = F.aggregate(own, empty, lambda r, b: F.struct(F.when(b == 1, half(r)).otherwise(r["low"]).alias("low"), F.when(b == 1, r["high"]).otherwise(half(r)).alias("high")))
        return half(cell)

    return point(middle(0, -180, 180), middle(1, -90, 90))


def edges(g: Column) -> Column:
    """The straight pieces of a line or ring, as arrays of two points; a ring's last piece leads back to its first point."""
    p, n = g["points"], F.size(g["points"])
    ends = F.when(g["kind"] == "POLYGON", n).otherwise(n - 1)
    made = F.transform(F.sequence(F.lit(1), F.greatest(ends, F.lit(1))), lambda i: F.array(F.try_element_at(p, i), F.try_element_at(p, F.when(i == n, 1).otherwise(i + 1))))
    return F.when(ends >= 1, made).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))


def _side(a: Column, b: Column, q: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (q["y"] - a["y"]) - (b["y"] - a["y"]) * (q["x"] - a["x"]))


def _on(a: Column, b: Column, q: Column) -> Column:
    """Whether a point lies on a straight piece (in degrees)."""
    return (_side(a, b, q) == 0) & q["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & q["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def cross(g: Column, h: Column, proper: bool = False) -> Column:
    """Whether pieces of two geographies meet; with ``proper``, whether they cross inside both."""

    def meet(e: Column, f: Column) -> Column:
        a, b, c, d = e[0], e[1], f[0], f[1]
        inside = (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)
        return inside if proper else inside | _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b)

    return F.exists(edges(g), lambda e: F.exists(edges(h), lambda f: meet(e, f)))


def on_edge(g: Column, h: Column) -> Column:
    """Whether a point of ``h`` lies on a piece of ``g``."""
    return F.exists(h["points"], lambda q: F.exists(edges(g), lambda e: _on(e[0], e[1], q)))


def intersects(a: Column, b: Column) -> Column:
    return contains(a, b) | contains(b, a) | F.arrays_overlap(a["points"], b["points"]) | cross(a, b) | on_edge(a, b) | on_edge(b, a)


def touches(a: Column, b: Column) -> Column:
    """They meet, but only at their borders: nothing crosses, and no ring holds a point of the other inside."""
    def strictly(g: Column, h: Column) -> Column:
        return F.when(g["kind"] == "POLYGON", F.exists(h["points"], lambda q: contains(g, _shape("POINT", F.array(q))) & ~F.exists(edges(g), lambda e: _on(e[0], e[1], q)))).otherwise(F.lit(False))

    return intersects(a, b) & ~cross(a, b, proper=True) & ~strictly(a, b) & ~strictly(b, a) & ~((a["kind"] == "POINT") & (b["kind"] == "POINT"))


def _mean(g: Column, axis: str) -> Column:
    return F.aggregate(F.transform(g["points"], lambda q: q[axis]), F.lit(0.0), lambda acc, x: acc + x) / F.size(g["points"])


def _snap(g: Column, size: Column) -> Column:
    return F.struct(g["kind"].alias("kind"), F.transform(g["points"], lambda q: _pair(F.round(q["x"] / size) * size, F.round(q["y"] / size) * size)).alias("points"))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "StGeogpoint": point, "StX": lambda g: first(g)["x"], "StY": lambda g: first(g)["y"], "StDistance": distance, "StDwithin": lambda a, b, d: distance(a, b) <= d, "StMaxdistance": lambda a, b: F.array_max(F.flatten(F.transform(a["points"], lambda p: F.transform(b["points"], lambda q: apart(p, q))))),
    "StLength": length, "StPerimeter": perimeter, "StArea": area, "StContains": contains, "StCovers": contains, "StWithin": lambda a, b: contains(b, a), "StCoveredby": lambda a, b: contains(b, a), "StEquals": lambda a, b: a == b,
    "StIntersects": intersects, "StDisjoint": lambda a, b: ~intersects(a, b), "StTouches": touches, "StIsempty": lambda g: F.size(g["points"]) == 0,
    "StGeogfromgeojson": from_json, "StGeohash": geohash, "StGeogpointfromgeohash": from_geohash,
    "StAstext": text, "StGeogfromtext": from_text, "StAsgeojson": json, "StNumpoints": lambda g: F.size(g["points"]).cast("long"), "StIscollection": lambda g: F.lit(False), "StDimension": lambda g: F.when(g["kind"] == "POINT", 0).when(g["kind"] == "LINESTRING", 1).otherwise(2).cast("long"),
    "StMakeline": lambda a, b: _shape("LINESTRING", F.concat(a["points"], b["points"])), "StMakepolygon": lambda g: _shape("POLYGON", g["points"]), "StMakepolygonoriented": lambda g: _shape("POLYGON", g["points"]),
    "StBoundary": lambda g: _shape("LINESTRING", g["points"]), "StCentroid": lambda g: point(_mean(g, "x"), _mean(g, "y")), "StSnaptogrid": _snap,
    "StIntersectsbox": lambda g, a, b, c, d: F.exists(g["points"], lambda q: (q["x"] >= a) & (q["y"] >= b) & (q["x"] <= c) & (q["y"] <= d)),
    "StClosestpoint": lambda a, b: _shape("POINT", F.array(F.array_min(F.transform(a["points"], lambda p: F.struct(F.array_min(F.transform(b["points"], lambda q: apart(p, q))).alias("d"), p.alias("p"))))["p"])),
}
