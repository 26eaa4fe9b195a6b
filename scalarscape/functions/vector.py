"""Vector and spherical geometry as column expressions; a vector is a tuple of three columns.

Undefined directions are null. Angles are in radians unless a name says otherwise.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str, names: str = "xyz") -> Vec:
    """Columns ``<prefix>x``, ``<prefix>y``, ``<prefix>z``."""
    return tuple(F.col(f"{prefix}{n}") for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vec, k: Column) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def plus(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vec, least: float = 1e-15) -> Vec:
    """Unit vector; null where the length is at most ``least``."""
    n = norm(a)
    return tuple(F.when(n > least, c / n) for c in a)


def clipped(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def angle(a: Vec, b: Vec) -> Column:
    """Angle between unit vectors; the product is clipped so that rounding gives no NaN."""
    return F.acos(clipped(dot(a, b)))


def separation_deg(a: Vec, b: Vec) -> Column:
    """Angle in degrees between any vectors; 180 where one has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na > 1e-12) & (nb > 1e-12), F.degrees(F.acos(clipped(dot(a, b) / (na * nb))))).otherwise(180.0)


def tangent_project(v: Vec, at: Vec) -> Vec:
    """Part of ``v`` in the tangent plane at the unit vector ``at``."""
    return minus(v, scaled(at, dot(v, at)))


def tangent_basis(c: Vec, legacy: bool = False) -> tuple[Vec, Vec]:
    """Two tangents at the unit vector ``c``: the helper axis is z, x near the poles; ``legacy``: x, y where c leans to x or y."""
    zero, one = F.lit(0.0), F.lit(1.0)
    if legacy:
        lean = (F.abs(c[0]) >= 0.8) | (F.abs(c[1]) >= 0.8)
        helper = (F.when(lean, zero).otherwise(one), F.when(lean, one).otherwise(zero), zero)
    else:
        polar = F.abs(c[2]) >= 0.9
        helper = (F.when(polar, one).otherwise(zero), zero, F.when(polar, zero).otherwise(one))
    t1 = unit(cross(c, helper))
    return t1, cross(c, t1)


def circle_point(c: Vec, t1: Vec, t2: Vec, radius: Column, phi: Column) -> Vec:
    """Unit vector at angular ``radius`` and azimuth ``phi`` about ``c``."""
    ring = plus(scaled(t1, F.cos(phi)), scaled(t2, F.sin(phi)))
    return unit(plus(scaled(c, F.cos(radius)), scaled(ring, F.sin(radius))))


def ellipse_radius(a: Column, b: Column, phi: Column) -> Column:
    return F.sqrt(F.pow(a * F.cos(phi), 2) + F.pow(b * F.sin(phi), 2))


def folded_angle_deg(a: Vec, b: Vec) -> Column:
    """Angle in degrees between two undirected axes, from 0 to 90; null where one has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na >= 1e-9) & (nb >= 1e-9), F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(a, b) / (na * nb))))))


def support_radius(c: Vec, axis: Vec, a: Column, b: Column, toward: Vec) -> Column:
    """Angular reach of an elliptic patch (centre ``c``, major ``axis``, half axes a, b) toward a direction; a where the bearing is undefined."""
    bearing, line = tangent_project(toward, c), tangent_project(axis, c)
    nb, nl = norm(bearing), norm(line)
    cos2 = F.least(F.lit(1.0), F.pow(dot(bearing, line) / (nb * nl), 2))
    return (
        F.when(a <= 0, 0.0)
        .when((b <= 0) | (F.abs(a - b) <= 1e-12) | (nb < 1e-12) | (nl < 1e-9), a)
        .otherwise(F.sqrt(a * a * cos2 + b * b * F.greatest(F.lit(0.0), 1 - cos2)))
    )


def pitch(edge: Column, radius: Column) -> Column:
    """Angular pitch of a mesh with mean edge length ``edge`` on a sphere of ``radius``."""
    return 2 * F.asin(clipped(edge / (2 * radius)))


def azimuth(phi: Column) -> Column:
    """An angle taken into [0, 2 pi)."""
    return phi - F.floor(phi / (2 * pi)) * (2 * pi)
