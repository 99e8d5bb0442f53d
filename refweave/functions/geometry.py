"""Numeric column expressions: rounding, matrices, boxes, triangles, grids and angles. Matrices are arrays of 16 doubles, by rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

IDENTITY = [float(i % 5 == 0) for i in range(16)]


def doubles(values: list) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def round4(x: Column) -> Column:
    """x * 10^4 rounded to even, over 10^4."""
    return F.rint(x * 1e4) / 1e4


def multiply(a: Column, b: Column) -> Column:
    return F.array(*[sum((F.get(a, F.lit(4 * i + k)) * F.get(b, F.lit(4 * k + j)) for k in range(1, 4)), F.get(a, F.lit(4 * i)) * F.get(b, F.lit(j))) for i in range(4) for j in range(4)])


def entry(m: Column, i: int, j: int) -> Column:
    return F.get(m, F.lit(4 * i + j))


def determinant(m: Column) -> Column:
    e = lambda i, j: entry(m, i, j)
    return e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))


def rigid(m: Column) -> Column:
    """Finite and affine, columns orthonormal within 1e-9, determinant 1."""
    finite = F.forall(m, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    affine = None
    for j, want in enumerate((0, 0, 0, 1)):
        one = F.abs(entry(m, 3, j) - want) <= 1e-12
        affine = one if affine is None else affine & one
    square = None
    for i in range(3):
        for j in range(i, 3):
            dot = sum((entry(m, k, i) * entry(m, k, j) for k in (1, 2)), entry(m, 0, i) * entry(m, 0, j))
            one = F.abs(dot - float(i == j)) <= 1e-9
            square = one if square is None else square & one
    return finite & affine & square & (F.abs(determinant(m) - 1) < 1e-9)


def valid_placement(m: Column) -> Column:
    """Finite, affine and not singular; reflections and scales may be."""
    return F.forall(m, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.slice(m, 13, 4) == doubles([0, 0, 0, 1])) & (determinant(m) != 0)


def scale_bound(m: Column) -> Column:
    """At least the spectral norm: root of the greatest absolute row sum of the transpose times the matrix."""
    rows = []
    for i in range(3):
        dots = [sum((entry(m, k, i) * entry(m, k, j) for k in (1, 2)), entry(m, 0, i) * entry(m, 0, j)) for j in range(3)]
        rows.append(sum((F.abs(d) for d in dots[1:]), F.abs(dots[0])))
    return F.sqrt(F.greatest(*rows)) * (1 + 1e-14)


def roll_pitch_yaw(m: Column) -> Column:
    """struct(roll, pitch, yaw) of Rz(yaw) Ry(pitch) Rx(roll); at the poles roll is 0."""
    s = -entry(m, 2, 0)
    free = F.abs(s) < 1 - 1e-9
    return F.struct(
        F.when(free, F.atan2(entry(m, 2, 1), entry(m, 2, 2))).otherwise(0.0).alias("roll"),
        F.asin(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0))).alias("pitch"),
        F.when(free, F.atan2(entry(m, 1, 0), entry(m, 0, 0))).otherwise(F.atan2(-entry(m, 0, 1), entry(m, 1, 1))).alias("yaw"),
    )


def quaternion(m: Column) -> Column:
    """[x, y, z, w] of a rotation; where the trace isn't positive, from the greatest diagonal entry."""
    e = lambda i, j: entry(m, i, j)
    trace = e(0, 0) + e(1, 1) + e(2, 2)
    s = F.sqrt(F.greatest(trace + 1, F.lit(1e-300))) * 2
    plain = F.array((e(2, 1) - e(1, 2)) / s, (e(0, 2) - e(2, 0)) / s, (e(1, 0) - e(0, 1)) / s, 0.25 * s)

    def around(i: int) -> Column:
        j, k = (i + 1) % 3, (i + 2) % 3
        t = F.sqrt(F.greatest(1 + e(i, i) - e(j, j) - e(k, k), F.lit(1e-300))) * 2
        q: list = [None] * 4
        q[i], q[j], q[k], q[3] = 0.25 * t, (e(j, i) + e(i, j)) / t, (e(k, i) + e(i, k)) / t, (e(k, j) - e(j, k)) / t
        return F.array(*q)

    first = (e(0, 0) >= e(1, 1)) & (e(0, 0) >= e(2, 2))
    return F.when(trace > 0, plain).when(first, around(0)).when(e(1, 1) >= e(2, 2), around(1)).otherwise(around(2))


def placement(origin: Column, z: Column, x: Column) -> Column:
    """Matrix of an origin and two axes (arrays of 3; axes may be null): z normed, x made square to z, y their product."""
    zz = F.coalesce(z, doubles([0, 0, 1]))
    along = F.abs(F.get(zz, F.lit(0)) / _norm(zz)) < 0.9
    xx = F.coalesce(x, F.when(along, doubles([1, 0, 0])).otherwise(doubles([0, 1, 0])))
    zn = _scaled(zz, 1 / _norm(zz))
    dot = sum((F.get(zn, F.lit(k)) * F.get(xx, F.lit(k)) for k in (1, 2)), F.get(zn, F.lit(0)) * F.get(xx, F.lit(0)))
    flat = F.zip_with(xx, zn, lambda a, b: a - b * dot)
    xn = _scaled(flat, 1 / _norm(flat))
    g = lambda v, k: F.get(v, F.lit(k))
    y = [g(zn, 1) * g(xn, 2) - g(zn, 2) * g(xn, 1), g(zn, 2) * g(xn, 0) - g(zn, 0) * g(xn, 2), g(zn, 0) * g(xn, 1) - g(zn, 1) * g(xn, 0)]
    return F.array(*[c for i in range(3) for c in (g(xn, i), y[i], g(zn, i), g(origin, i))], *[F.lit(float(v)) for v in (0, 0, 0, 1)])


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def projected_error(error: Column, depth: Column, height: Column, fov: Column) -> Column:
    """Pixels that an error takes at a depth, in a view of some height and vertical angle."""
    return error * height / (2 * depth * F.tan(fov / 2))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def corners(low: Column, high: Column) -> Column:
    """The 8 corners of a box: bit j of a corner's number says which end of axis j."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.array(*[F.when(F.getbit(c, F.lit(j)) == 0, F.get(low, F.lit(j))).otherwise(F.get(high, F.lit(j))) for j in range(3)]))


def classify_box(inner: list[tuple[Column, Column]], outer: list[tuple[Column, Column]]) -> Column:
    """'unbounded', 'contained', 'straddling' or 'outside' of a whole box against a region; bounds are closed. Pairs: (low, high) per axis."""
    contained = meets = missing = None
    for (a, b), (lo, hi) in zip(inner, outer):
        c, m, n = (a >= lo) & (b <= hi), (b >= lo) & (a <= hi), a.isNull() | b.isNull()
        contained, meets, missing = (c, m, n) if contained is None else (contained & c, meets & m, missing | n)
    return F.when(missing, "unbounded").when(contained, "contained").when(meets, "straddling").otherwise("outside")


def overlaps(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    """Boxes share area: touching is none."""
    out = None
    for (a0, a1), (b0, b1) in zip(a, b):
        one = F.least(a1, b1) > F.greatest(a0, b0)
        out = one if out is None else out & one
    return out


def grid_cell(x: Column, low: float, high: float, cell: float) -> Column:
    """Cell number along an axis; the upper end belongs to the last cell, outside is an error."""
    n = math.ceil((high - low) / cell)
    inside = (x >= low) & (x <= high)
    return F.when(inside, F.least(F.floor((x - low) / cell), F.lit(n - 1))).otherwise(F.raise_error(F.lit("outside the grid"))).cast("int")


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    u, v = F.zip_with(b, a, lambda x, y: x - y), F.zip_with(c, a, lambda x, y: x - y)
    g = lambda w, k: F.get(w, F.lit(k))
    cross = [g(u, 1) * g(v, 2) - g(u, 2) * g(v, 1), g(u, 2) * g(v, 0) - g(u, 0) * g(v, 2), g(u, 0) * g(v, 1) - g(u, 1) * g(v, 0)]
    return F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2


def centroid(a: Column, b: Column, c: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), lambda t: (t["a"] + t["b"] + t["c"]) / 3)


def least_rotation(values: Column) -> Column:
    """The least of an array's rotations: one form for all starts of a loop, winding kept."""
    n = F.size(values)
    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice(values, k + 1, n), F.slice(values, F.lit(1), k))))


def quantised(x: Column, quantum: float) -> Column:
    return F.rint(x / quantum).cast("bigint")


def height_over(px: Column, py: Column, a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """z of a triangle's plane at (px, py) if that point is in it (its edges count) and it isn't upright, else null."""
    side = lambda u, v: (v[0] - u[0]) * (py - u[1]) - (v[1] - u[1]) * (px - u[0])
    d = [side(a, b), side(b, c), side(c, a)]
    inside = ((d[0] >= 0) & (d[1] >= 0) & (d[2] >= 0)) | ((d[0] <= 0) & (d[1] <= 0) & (d[2] <= 0))
    u, v = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.when(inside & (F.abs(n[2]) > 1e-12), a[2] - (n[0] * (px - a[0]) + n[1] * (py - a[1])) / n[2])


def first_match(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first case that holds, in order."""
    out = F.lit(otherwise)
    for test, name in reversed(cases):
        out = F.when(test, name).otherwise(out)
    return out


def all_matches(cases: list[tuple[Column, str]]) -> Column:
    """Names of all cases that hold, in order."""
    return F.filter(F.array(*[F.when(test, name) for test, name in cases]), lambda x: x.isNotNull())
