"""Geometry on plain columns: no geometry type, no UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii and metres a degree.
EARTH_M = 6_371_000.0
EARTH_KM = 6371.0088
M_PER_DEG = 111_320.0


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    return F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, by the arc tangent."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres on the mean radius, by the arc sine."""
    return 2 * EARTH_KM * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def to_metres(lat: Column, lon: Column, lat0: Column) -> tuple[Column, Column]:
    """(x, y) of the equirectangular projection around ``lat0``."""
    return lon * M_PER_DEG * F.cos(F.radians(lat0)), lat * M_PER_DEG


def coord_key(lat: Column, lon: Column) -> Column:
    """A text key of a coordinate to six places, ties to even."""
    return F.concat_ws(",", F.format_string("%.6f", F.bround(lat, 6)), F.format_string("%.6f", F.bround(lon, 6)))


def metre_block(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def hex_id(col: Column, row: Column) -> Column:
    return F.format_string("H%04d_%04d", col, row)


def hex_steps(cell_m: float) -> tuple[float, float, float]:
    """(circumradius, column step, row step) of flat-topped hexagons with inradius ``cell_m``."""
    radius = cell_m / math.cos(math.pi / 6)
    return radius, 1.5 * radius, math.sqrt(3) * radius


def hex_centre(col: Column, row: Column, min_x: Column, min_y: Column, cell_m: float) -> tuple[Column, Column]:
    """The centre of a lattice cell; odd columns sit half a row higher and the lattice starts one cell outside the box."""
    radius, dx, dy = hex_steps(cell_m)
    shift = F.when(F.pmod(col, F.lit(2)) == 0, F.lit(0.0)).otherwise(F.lit(dy / 2))
    return min_x - radius + col * dx, min_y - dy + shift + row * dy


def hex_vertices(x: Column, y: Column, radius: float) -> Column:
    """The six corners as an array of (x, y)."""
    corner = lambda k: F.struct((x + radius * F.cos(k * math.pi / 3)).alias("x"), (y + radius * F.sin(k * math.pi / 3)).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(5)), corner)


def shard_of(hexagon: Column, block: int = 4, buckets: int = 4096) -> Column:
    """Grid ids by blocks of ``block`` columns and rows, other ids by a rolling hash of their characters."""
    form = r"^H(\d+)_(\d+)$"
    grid = F.format_string("s%04d_%04d", (F.regexp_extract(hexagon, form, 1).cast("int") / block).cast("int"), (F.regexp_extract(hexagon, form, 2).cast("int") / block).cast("int"))
    rolled = F.aggregate(F.filter(F.split(hexagon, ""), lambda c: c != ""), F.lit(0), lambda h, c: (h * 31 + F.ascii(c)) % buckets)
    return F.when(hexagon.rlike(form), grid).otherwise(F.format_string("sx%04d", rolled))


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring (array of x, y; the last point joins the first), by crossings of a ray."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.pmod(i + 1, n) + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def line_samples(points: Column, step: float) -> Column:
    """Points every ``step`` along a line of (x, y): its start, the places at the step's multiples, and its end."""
    legs = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("n")))
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<x:double,y:double>>").alias("out"))

    def leg(acc, s):
        first = F.ceil(acc["at"] / step).cast("int")
        last = F.ceil((acc["at"] + s["n"]) / step).cast("int") - 1
        place = lambda k: F.struct((s["ax"] + (s["bx"] - s["ax"]) * (k * step - acc["at"]) / s["n"]).alias("x"), (s["ay"] + (s["by"] - s["ay"]) * (k * step - acc["at"]) / s["n"]).alias("y"))
        own = F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), place)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        return F.struct((acc["at"] + s["n"]).alias("at"), F.concat(acc["out"], own).alias("out"))

    end = F.element_at(points, -1)
    return F.aggregate(legs, start, leg, lambda acc: F.concat(acc["out"], F.array(F.struct(end["x"].cast("double").alias("x"), end["y"].cast("double").alias("y")))))
