"""Distances and projections as column expressions; everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii of the spheres and the ellipsoid in use.
EARTH_KM = 6371.0
GREAT_CIRCLE_KM = 6371.009
MERCATOR_M = 6378137.0
WGS84_FLATTENING = 1 / 298.257223563
#: Standard parallels, origin and radius of the equal-area conic for the contiguous United States.
ALBERS = {"south": 29.5, "north": 45.5, "lat0": 37.5, "lon0": -96.0, "radius": 6378137.0}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2, GREAT_CIRCLE_KM)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Spherical web Mercator metres (x, y)."""
    return F.lit(MERCATOR_M) * F.radians(lon), F.lit(MERCATOR_M) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def albers(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Equal-area conic metres (x, y) on a sphere; distances of a few kilometres are what it is for."""
    import math

    south, north, lat0 = (math.radians(ALBERS[k]) for k in ("south", "north", "lat0"))
    n = (math.sin(south) + math.sin(north)) / 2
    c = math.cos(south) ** 2 + 2 * n * math.sin(south)
    r0 = ALBERS["radius"] * math.sqrt(c - 2 * n * math.sin(lat0)) / n
    r = F.lit(ALBERS["radius"] / n) * F.sqrt(F.lit(c) - F.lit(2 * n) * F.sin(F.radians(lat)))
    theta = F.lit(n) * F.radians(lon - F.lit(ALBERS["lon0"]))
    return r * F.sin(theta), F.lit(r0) - r * F.cos(theta)


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 6) -> Column:
    """Metres on the WGS-84 ellipsoid by Vincenty's inverse formula (1975) with a fixed number of iterations.

    The iteration is one fold over a struct, so the expression does not grow with ``rounds``.  It does not converge
    for points nearly opposite each other, which schedules do not have.
    """
    f, a = WGS84_FLATTENING, MERCATOR_M
    b = a * (1 - f)
    u1, u2 = F.atan(F.lit(1 - f) * F.tan(F.radians(lat1))), F.atan(F.lit(1 - f) * F.tan(F.radians(lat2)))
    fixed = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("l"))

    def over(x: Column, y: Column) -> Column:
        return F.when(y == 0, F.lit(0.0)).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))

    def angles(k: Column, lam: Column, then) -> Column:
        """Binds sin and cos of sigma, then what follows from them."""
        ss = F.sqrt(F.pow(k["c2"] * F.sin(lam), 2) + F.pow(k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam), 2))
        one = F.struct(ss.alias("ss"), (k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam)).alias("cs"))

        def two(x: Column) -> Column:
            sa = over(k["c1"] * k["c2"] * F.sin(lam), x["ss"])
            return _let(F.struct(F.atan2(x["ss"], x["cs"]).alias("sigma"), sa.alias("sa"), (F.lit(1.0) - sa * sa).alias("ca")), lambda y: three(x, y))

        def three(x: Column, y: Column) -> Column:
            return _let(x["cs"] - over(2 * k["s1"] * k["s2"], y["ca"]), lambda cm: then(x["ss"], x["cs"], y["sigma"], y["sa"], y["ca"], F.when(y["ca"] == 0, F.lit(0.0)).otherwise(cm)))

        return _let(one, two)

    def step(k: Column, lam: Column) -> Column:
        def then(ss, cs, sigma, sa, ca, cm):
            c = F.lit(f / 16) * ca * (F.lit(4.0) + F.lit(f) * (F.lit(4.0) - 3 * ca))
            return _let(c, lambda c: k["l"] + (F.lit(1.0) - c) * F.lit(f) * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))))

        return angles(k, lam, then)

    def finish(k: Column, lam: Column) -> Column:
        def then(ss, cs, sigma, sa, ca, cm):
            return _let(ca * F.lit((a * a - b * b) / (b * b)), lambda q: metres(ss, cs, sigma, cm, q))

        return angles(k, lam, then)

    def metres(ss, cs, sigma, cm, q) -> Column:
        big_a = F.lit(1.0) + q / 16384 * (F.lit(4096.0) + q * (F.lit(-768.0) + q * (F.lit(320.0) - 175 * q)))
        big_b = q / 1024 * (F.lit(256.0) + q * (F.lit(-128.0) + q * (F.lit(74.0) - 47 * q)))
        turn = lambda w: w * ss * (cm + w / 4 * (cs * (2 * cm * cm - 1) - w / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        return F.lit(b) * big_a * (sigma - _let(big_b, turn))

    return _let(fixed, lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k["l"], lambda lam, _: step(k, lam), lambda lam: finish(k, lam)))


def _let(value: Column, then) -> Column:
    """Names a value, so that an expression which uses it often does not contain it as often."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: whether (x, y) lies in the polygon ``ring``, an array of struct<x, y> without a closing point."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"]) + p["x"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    return F.pmod(F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)), F.lit(2)) == 1


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(((x - x1) * dx + (y - y1) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return planar(x, y, x1 + t * dx, y1 + t * dy)


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Planar distance of a point from a polygon's boundary."""
    n = F.size(ring)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: segment_distance(x, y, F.get(ring, i)["x"], F.get(ring, i)["y"], F.get(ring, F.pmod(i + 1, n))["x"], F.get(ring, F.pmod(i + 1, n))["y"]))
    return F.array_min(each)


def inside_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings of a polygon: outer ones, holes, islands in holes."""
    return F.pmod(F.size(F.filter(rings, lambda r: inside(x, y, r))), F.lit(2)) == 1


def rings_distance(x: Column, y: Column, rings: Column) -> Column:
    """Planar distance of a point from the nearest of several boundaries."""
    return F.array_min(F.transform(rings, lambda r: ring_distance(x, y, r)))
