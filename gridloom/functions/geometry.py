"""Planar geometry expressions: boxes, rings as arrays of (x, y), clipping, circles and transverse Mercator coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid and the projection's constants; central meridians by zone code; buffer radii by class of place.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
CENTRAL_MERIDIANS = {32628: -15.0, 32630: -3.0}
BUFFER_RADII = {"U": 2000.0, "R": 5050.0}
QUARTER_SEGMENTS = 16


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def boxes_meet(a: Column, b: Column, closed: bool = True) -> Column:
    """Whether boxes intersect; closed: touching counts."""
    if closed:
        return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def box_ring(b: Column) -> Column:
    return F.array(point(b["x0"], b["y0"]), point(b["x1"], b["y0"]), point(b["x1"], b["y1"]), point(b["x0"], b["y1"]))


def _turned(ring: Column) -> Column:
    """The ring from its second point on, the first at the end."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _cross(ring: Column, of) -> Column:
    return F.aggregate(F.zip_with(ring, _turned(ring), of), F.lit(0.0), lambda s, x: s + x)


def signed_area(ring: Column) -> Column:
    return _cross(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def ring_area(ring: Column) -> Column:
    """Area inside a ring of points, closed or not; 0 with fewer than three."""
    return F.when(F.size(ring) >= 3, F.abs(signed_area(ring))).otherwise(0.0)


def ring_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def centroid(ring: Column) -> Column:
    """Centre of the area inside a ring; of the points, if it has none."""
    a = signed_area(ring)
    part = lambda k: _cross(ring, lambda p, q: (p[k] + q[k]) * (p["x"] * q["y"] - q["x"] * p["y"]))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    return point(F.coalesce(F.try_divide(part("x"), 6 * a), mean("x")), F.coalesce(F.try_divide(part("y"), 6 * a), mean("y")))


def valid_ring(ring: Column) -> Column:
    return (F.size(ring) >= 4) & (ring_area(ring) > 0)


def clipped(ring: Column, b: Column) -> Column:
    """The part of a ring inside a box, as a ring: the box's four half-planes cut it one after the other.

    Of concave rings the parts may hang together by edges of no area, so areas are right.
    """
    planes = F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(sign).alias("sign"), b[bound].alias("at")) for axis, sign, bound in (("x", 1.0, "x0"), ("x", -1.0, "x1"), ("y", 1.0, "y0"), ("y", -1.0, "y1"))])

    def cut(ring: Column, h: Column) -> Column:
        depth = lambda p: h["sign"] * (F.when(h["axis"] == "x", p["x"]).otherwise(p["y"]) - h["at"])

        def edge(p: Column, q: Column) -> Column:
            t = F.try_divide(depth(p), depth(p) - depth(q))
            crossing = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
            enters_or_leaves = (depth(p) >= 0) != (depth(q) >= 0)
            own = F.when(depth(p) >= 0, F.array(p)).otherwise(F.slice(F.array(p), 1, 0))
            return F.when(enters_or_leaves, F.concat(own, F.array(crossing))).otherwise(own)

        return F.flatten(F.zip_with(ring, _turned(ring), edge))

    return F.aggregate(planes, ring, cut)


def buffer_radius(place: Column) -> Column:
    """By class of place; an unknown class raises."""
    out = None
    for k, v in BUFFER_RADII.items():
        out = F.when(place == k, v) if out is None else out.when(place == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown class of place: "), F.coalesce(place, F.lit("null")))).cast("double"))


def circle(x: Column, y: Column, r: Column, segments: int = 4 * QUARTER_SEGMENTS) -> Column:
    """A regular polygon around a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: point(x + r * F.cos(i * (2 * math.pi / segments)), y - r * F.sin(i * (2 * math.pi / segments))))


def _series() -> tuple[float, float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Rectifying radius, eccentricity and the coefficients of Krueger's series to the fourth power of the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return radius, math.sqrt(FLATTENING * (2 - FLATTENING)), alpha, beta, delta


def projected(lon: Column, lat: Column, zone: int) -> Column:
    """Degrees to metres of a transverse Mercator zone."""
    radius, e, alpha, _, _ = _series()
    phi, lam = F.radians(lat), F.radians(lon - CENTRAL_MERIDIANS[zone])
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(FALSE_EASTING + SCALE * radius * x, SCALE * radius * y)


def unprojected(x: Column, y: Column, zone: int) -> Column:
    """Metres of a transverse Mercator zone to degrees (x: longitude, y: latitude)."""
    radius, _, _, beta, delta = _series()
    xi, eta = y / (SCALE * radius), (x - FALSE_EASTING) / (SCALE * radius)
    u, v = xi, eta
    for j, b in enumerate(beta, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return point(F.lit(CENTRAL_MERIDIANS[zone]) + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi))
