"""Vector geometry as Spark expressions on array<double> columns: angles, planes, areas, solid angles, cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: Column, v: Column) -> Column:
    return F.array(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def minus(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a - b)


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def angle(u: Column, v: Column) -> Column:
    """Angle between two vectors in radian, 0 to pi; null if one has no length."""
    length = norm(u) * norm(v)  # greatest and least pass over nulls, so the case is told apart first
    return F.when(length > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / length))))


def dihedral(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Unsigned angle in radian between the planes through p1, p2, p3 and p2, p3, p4."""
    a, b, c = minus(p2, p1), minus(p3, p2), minus(p4, p3)
    return angle(cross(a, b), cross(b, c))


def plane(p1: Column, p2: Column, p3: Column) -> Column:
    """[a, b, c, d] with a x + b y + c z + d = 0 on the plane through three points."""
    n = cross(minus(p2, p1), minus(p3, p1))
    return F.concat(n, F.array(-dot(n, p1)))


def polygon_area(vertices: Column) -> Column:
    """Area of a flat polygon whose vertices come in order."""
    fan = F.transform(F.sequence(F.lit(1), F.greatest(F.size(vertices) - 2, F.lit(1))), lambda i: cross(minus(F.get(vertices, i), F.get(vertices, F.lit(0))), minus(F.get(vertices, i + 1), F.get(vertices, F.lit(0)))))
    total = F.aggregate(fan, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    return F.when(F.size(vertices) > 2, norm(total) / 2).otherwise(F.lit(0.0))


def solid_angle(center: Column, points: Column) -> Column:
    """Solid angle of a polyhedral cone: the points in order about its edge, seen from the center."""
    p = F.transform(points, lambda q: minus(q, center))

    def one(i: Column) -> Column:
        a, b, c = F.get(p, F.lit(0)), F.get(p, i), F.get(p, i + 1)
        na, nb, nc = norm(a), norm(b), norm(c)
        top = F.abs(dot(a, cross(b, c)))
        below = na * nb * nc + dot(a, b) * nc + dot(a, c) * nb + dot(b, c) * na
        t = F.atan(top / F.nullif(below, F.lit(0.0)))
        return F.when(below == 0, F.lit(math.pi)).otherwise(2 * F.when(t > 0, t).otherwise(t + math.pi))

    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 2, F.lit(1))), one)
    return F.when(F.size(points) > 2, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))


def circular_segment_area(radius: Column, distance: Column) -> Column:
    """Area of the part of a circle beyond a chord at `distance` from its middle; null if the chord misses the circle."""
    theta = 2 * F.acos(distance / radius)
    return F.when(distance <= radius, 0.5 * radius * radius * (theta - F.sin(theta)))


def reflection_matrix(n: Column) -> Column:
    """Matrix of the reflection at the plane normal to n."""
    nn = dot(n, n)
    return F.array(*[F.array(*[F.lit(float(i == j)) - 2 * n[i] * n[j] / nn for j in range(3)]) for i in range(3)])


def independent_vector(v: Column) -> Column:
    """v with 1 added to its first entry that is 0 (to 1e-5), or else to the first."""
    zero = lambda i: F.abs(v[i]) <= 1e-5
    at = F.when(zero(0), 0).when(zero(1), 1).when(zero(2), 2).otherwise(0)
    return F.array(*[v[i] + F.when(at == i, 1.0).otherwise(0.0) for i in range(3)])


def gaussian(x: Column, mu: float, sigma: float) -> Column:
    return F.exp(-((x - mu) / sigma) * ((x - mu) / sigma) / 2) / (math.sqrt(2 * math.pi) * sigma)


def cell_from_parameters(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Cell vectors from lengths and angles in degrees: a along x, b in the plane of x and y."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    y = (ca - cb * cg) / sg
    zero = F.lit(0.0)
    return F.array(F.array(a * 1.0, zero, zero), F.array(b * cg, b * sg, zero), F.array(c * cb, c * y, c * F.sqrt(F.greatest(1 - cb * cb - y * y, zero))))


def reciprocal_cell(cell: Column) -> Column:
    """Reciprocal cell vectors, with the factor 2 pi."""
    v = F.abs(dot(cross(cell[0], cell[1]), cell[2]))
    row = lambda i: F.transform(cross(cell[(i + 1) % 3], cell[(i + 2) % 3]), lambda x: x * 2 * math.pi / v)
    return F.array(*[row(i) for i in range(3)])
