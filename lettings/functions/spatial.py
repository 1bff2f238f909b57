"""Geometry on plain arrays of doubles: no extension and no Python per row.

A boundary is polygons -> rings -> vertices.  Containment is planar even-odd,
so holes and second polygons need no special case; distance and area are on the
sphere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from lettings import rules
from lettings.functions.clean import ColumnLike, as_col

VERTEX = "struct<x:double,y:double>"
BOUNDARY = f"array<array<array<{VERTEX}>>>"


def make_point(lon: ColumnLike, lat: ColumnLike) -> Column:
    return F.struct(as_col(lon).cast("double").alias("x"), as_col(lat).cast("double").alias("y"))


def parse_boundary(geometry_json: ColumnLike) -> Column:
    """Boundary from the text of a GeoJSON Polygon or MultiPolygon."""
    text = as_col(geometry_json)
    coordinates = F.get_json_object(text, "$.coordinates")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    kind = F.get_json_object(text, "$.type")
    nested = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", one)

    def vertex(v: Column) -> Column:
        return F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y"))

    return F.transform(nested, lambda rings: F.transform(rings, lambda ring: F.transform(ring, vertex)))


def boundary_json(boundary: ColumnLike) -> Column:
    """GeoJSON MultiPolygon geometry of a boundary."""
    def pair(v: Column) -> Column:
        return F.array(v["x"], v["y"])

    nested = F.transform(
        as_col(boundary), lambda rings: F.transform(rings, lambda ring: F.transform(ring, pair))
    )
    return F.struct(F.lit("MultiPolygon").alias("type"), nested.alias("coordinates"))


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring."""
    n = F.size(ring) - 1
    return F.zip_with(
        F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n),
        lambda a, b: F.struct(
            a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")
        ),
    )


def edges(boundary: ColumnLike) -> Column:
    """All edges of all rings as one flat array."""
    return F.flatten(F.transform(F.flatten(as_col(boundary)), ring_edges))


def crossings(edge_array: ColumnLike, lon: ColumnLike, lat: ColumnLike) -> Column:
    """Number of edges that a ray to the east meets."""
    px, py = as_col(lon), as_col(lat)

    def met(e: Column) -> Column:
        spans = (e["y0"] > py) != (e["y1"] > py)
        return spans & (px < (e["x1"] - e["x0"]) * (py - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])

    return F.size(F.filter(as_col(edge_array), met))


def contains(edge_array: ColumnLike, lon: ColumnLike, lat: ColumnLike) -> Column:
    return crossings(edge_array, lon, lat) % 2 == 1


def bounds(boundary: ColumnLike) -> Column:
    vertices = F.flatten(F.flatten(as_col(boundary)))
    xs = F.transform(vertices, lambda v: v["x"])
    ys = F.transform(vertices, lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"),
        F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"),
    )


def in_box(lon: ColumnLike, lat: ColumnLike, box: Column) -> Column:
    return as_col(lon).between(box["xmin"], box["xmax"]) & as_col(lat).between(box["ymin"], box["ymax"])


def distance_m(lon_a: ColumnLike, lat_a: ColumnLike, lon_b: ColumnLike, lat_b: ColumnLike) -> Column:
    """Great-circle metres (haversine)."""
    la, lb = F.radians(as_col(lat_a)), F.radians(as_col(lat_b))
    half_lat = (lb - la) / 2.0
    half_lon = (F.radians(as_col(lon_b)) - F.radians(as_col(lon_a))) / 2.0
    h = F.pow(F.sin(half_lat), 2.0) + F.cos(la) * F.cos(lb) * F.pow(F.sin(half_lon), 2.0)
    return F.lit(2.0 * rules.EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def unit_vector(lon: ColumnLike, lat: ColumnLike) -> Column:
    """Point on the unit sphere, worked out once per row so that pairs need no trigonometry."""
    x, y = F.radians(as_col(lon)), F.radians(as_col(lat))
    return F.struct(
        (F.cos(y) * F.cos(x)).alias("x"), (F.cos(y) * F.sin(x)).alias("y"), F.sin(y).alias("z")
    )


def chord(unit_a: ColumnLike, unit_b: ColumnLike) -> Column:
    """Straight distance of two points on the unit sphere."""
    a, b = as_col(unit_a), as_col(unit_b)
    steps = [a[axis] - b[axis] for axis in ("x", "y", "z")]
    return F.sqrt(steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2])


def is_within(unit_a: ColumnLike, unit_b: ColumnLike, metres: float) -> Column:
    """Great-circle distance at most ``metres``, by the squared chord of unit vectors."""
    a, b = as_col(unit_a), as_col(unit_b)
    steps = [a[axis] - b[axis] for axis in ("x", "y", "z")]
    chord = steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2]
    return chord <= F.lit(4.0 * math.sin(metres / (2.0 * rules.EARTH_RADIUS_M)) ** 2)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _ring_sqkm(ring: Column) -> Column:
    half_square = rules.EARTH_RADIUS_M * rules.EARTH_RADIUS_M / 2.0

    def strip(e: Column) -> Column:
        turn = F.radians(e["x1"]) - F.radians(e["x0"])
        return turn * (F.lit(2.0) + F.sin(F.radians(e["y0"])) + F.sin(F.radians(e["y1"])))

    return F.abs(_total(F.transform(ring_edges(ring), strip))) * F.lit(half_square / 1e6)


def area_sqkm(boundary: ColumnLike) -> Column:
    """Area on the sphere: first ring of each polygon less its other rings."""
    def polygon(rings: Column) -> Column:
        sizes = F.transform(rings, _ring_sqkm)
        return F.lit(2.0) * F.get(sizes, 0) - _total(sizes)

    return _total(F.transform(as_col(boundary), polygon))


def centroid(boundary: ColumnLike) -> Column:
    """Planar area centroid over all rings, holes taken away."""
    def ring_moments(ring: Column) -> Column:
        pairs = ring_edges(ring)

        def cross(e: Column) -> Column:
            return e["x0"] * e["y1"] - e["x1"] * e["y0"]

        area = _total(F.transform(pairs, cross)) / 2.0
        mx = _total(F.transform(pairs, lambda e: (e["x0"] + e["x1"]) * cross(e))) / 6.0
        my = _total(F.transform(pairs, lambda e: (e["y0"] + e["y1"]) * cross(e))) / 6.0
        sign = F.signum(area)
        return F.struct((area * sign).alias("a"), (mx * sign).alias("mx"), (my * sign).alias("my"))

    signed = F.flatten(F.transform(
        as_col(boundary),
        lambda rings: F.transform(rings, lambda ring, i: F.struct(
            F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s"),
            ring_moments(ring).alias("m"),
        )),
    ))
    area = _total(F.transform(signed, lambda r: r["s"] * r["m"]["a"]))
    mx = _total(F.transform(signed, lambda r: r["s"] * r["m"]["mx"]))
    my = _total(F.transform(signed, lambda r: r["s"] * r["m"]["my"]))
    return F.struct(F.try_divide(mx, area).alias("x"), F.try_divide(my, area).alias("y"))
