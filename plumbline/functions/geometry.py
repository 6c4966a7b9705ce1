"""Planar geometry as column expressions (all stay inside whole-stage code generation).

Points, boxes and matrices are separate double columns. Angles of undirected lines
lie in [0, pi).
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Drawing scales that a measured scale may snap to (fixed values).
STANDARD_SCALES = (10, 20, 25, 50, 100, 200, 250, 500, 1000)
#: A measured scale snaps within this share of a standard one.
SNAP = 0.02
MM_PER_PT = 25.4 / 72


def c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def distance(ax, ay, bx, by) -> Column:
    dx, dy = c(bx) - c(ax), c(by) - c(ay)
    return F.sqrt(dx * dx + dy * dy)


def undirected_angle(dx: Column, dy: Column) -> Column:
    """Direction of a line modulo pi."""
    raw = F.atan2(dy, dx)
    up = F.when(raw < 0, raw + pi).otherwise(raw)
    return F.when(up >= pi, up - pi).otherwise(up)


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle between two undirected directions."""
    d = F.abs(a - b)
    return F.least(d, F.lit(pi) - d)


def page_matrix(rotate, width, height, user_unit) -> Column:
    """Struct a..f, width, height that maps crop-box points of a page to its upright view; error on other rotations."""
    u, w, h = F.coalesce(c(user_unit), F.lit(1.0)), c(width), c(height)
    rows = {0: (u, 0, 0, u, 0, 0, w * u, h * u), 90: (0, u, -u, 0, h * u, 0, h * u, w * u), 180: (-u, 0, 0, -u, w * u, h * u, w * u, h * u), 270: (0, -u, u, 0, 0, w * u, h * u, w * u)}
    names = ("a", "b", "c", "d", "e", "f", "width", "height")
    turn = F.pmod(c(rotate).cast("int"), F.lit(360))
    # checked once, not in each field: the generated method stays short enough to be compiled
    known = F.when(turn % 90 == 0, turn).otherwise(F.raise_error(F.concat(F.lit("no such page rotation: "), turn.cast("string"))).cast("int"))
    fields = []
    for k, name in enumerate(names):
        value = c(rows[270][k]).cast("double")
        for angle in (0, 90, 180):
            value = F.when(known == angle, c(rows[angle][k]).cast("double")).otherwise(value)
        fields.append(value.alias(name))
    return F.struct(*fields)


def apply_matrix(m: str, x, y) -> tuple[Column, Column]:
    g = lambda k: F.col(f"{m}.{k}")
    return g("a") * c(x) + g("c") * c(y) + g("e"), g("b") * c(x) + g("d") * c(y) + g("f")


def invert_matrix(m: str, x, y) -> tuple[Column, Column]:
    """The point that the matrix maps to (x, y); an error where it is singular."""
    g = lambda k: F.col(f"{m}.{k}")
    det = g("a") * g("d") - g("b") * g("c")
    det = F.when(F.abs(det) < 1e-12, F.raise_error(F.lit("singular page matrix")).cast("double")).otherwise(det)
    px, py = c(x) - g("e"), c(y) - g("f")
    return (g("d") * px - g("c") * py) / det, (g("a") * py - g("b") * px) / det


def apply_matrix_box(m: str, x0, y0, x1, y1) -> tuple[Column, Column, Column, Column]:
    """The upright box around a transformed box: x0, y0, x1, y1."""
    corners = [apply_matrix(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def scale_factor(m: str) -> Column:
    g = lambda k: F.col(f"{m}.{k}")
    return F.sqrt(F.abs(g("a") * g("d") - g("b") * g("c")))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = c(bx) - c(ax), c(by) - c(ay)
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c(px) - c(ax)) * dx + (c(py) - c(ay)) * dy) / square)))
    x, y = c(px) - c(ax) - t * dx, c(py) - c(ay) - t * dy
    return F.sqrt(x * x + y * y)


def lateral_offset(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from the infinite line; from the point itself where the line is one."""
    dx, dy = c(bx) - c(ax), c(by) - c(ay)
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n <= 0, distance(px, py, ax, ay)).otherwise(F.abs((c(px) - c(ax)) * dy - (c(py) - c(ay)) * dx) / n)


def grid_cell(x, size) -> Column:
    """Floor division as Python does it on doubles (1.0 // 0.1 is 9)."""
    x, size = c(x), c(size)
    return F.rint((x - F.pmod(x, size)) / size).cast("bigint")


def rounded(x, digits: int) -> Column:
    """``round`` of a double, in plain arithmetic where that can't differ: a scaled value under a thousand million and no millionth from a half."""
    scaled = c(x) * 10.0**digits
    whole = F.floor(scaled + 0.5)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - whole) < 0.5 - 1e-6)
    return F.when(plain, whole / 10.0**digits).otherwise(F.round(c(x), digits))


def node_key(x, eps) -> Column:
    """Nearest grid node, halves to even."""
    return F.rint(c(x) / c(eps)).cast("bigint")


def box_area(x0, y0, x1, y1) -> Column:
    return F.greatest(F.lit(0.0), c(x1) - c(x0)) * F.greatest(F.lit(0.0), c(y1) - c(y0))


def box_middle(x0, y0, x1, y1) -> tuple[Column, Column]:
    return (c(x0) + c(x1)) / 2, (c(y0) + c(y1)) / 2


def box_inside(inner: tuple, outer: tuple) -> Column:
    """Whether a box lies in another with all four sides."""
    ix0, iy0, ix1, iy1 = map(c, inner)
    ox0, oy0, ox1, oy1 = map(c, outer)
    return (ix0 >= ox0) & (iy0 >= oy0) & (ix1 <= ox1) & (iy1 <= oy1)


def middle_inside(inner: tuple, outer: tuple) -> Column:
    """Whether a box's middle lies in another box."""
    mx, my = box_middle(*inner)
    ox0, oy0, ox1, oy1 = map(c, outer)
    return mx.between(ox0, ox1) & my.between(oy0, oy1)


def overlap_fraction(inner: tuple, outer: tuple) -> Column:
    """Share of the inner box inside the outer; a box without area counts by its middle."""
    ix0, iy0, ix1, iy1 = map(c, inner)
    ox0, oy0, ox1, oy1 = map(c, outer)
    area = box_area(ix0, iy0, ix1, iy1)
    common = box_area(F.greatest(ix0, ox0), F.greatest(iy0, oy0), F.least(ix1, ox1), F.least(iy1, oy1))
    mid = ((ix0 + ix1) / 2).between(ox0, ox1) & ((iy0 + iy1) / 2).between(oy0, oy1)
    return F.when(area > 0, common / area).otherwise(mid.cast("double"))


def srgb_to_lab(r, g, b) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* (D65) of sRGB in 0..1."""

    def linear(u: Column) -> Column:
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))

    lr, lg, lb = linear(c(r)), linear(c(g)), linear(c(b))
    x = (lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047
    y = lr * 0.2126729 + lg * 0.7151522 + lb * 0.0721750
    z = (lr * 0.0193339 + lg * 0.1191920 + lb * 0.9503041) / 1.08883

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)

    return f(y) * 116.0 - 16.0, (f(x) - f(y)) * 500.0, (f(y) - f(z)) * 200.0


def delta_e(one: tuple, two: tuple) -> Column:
    return F.sqrt(sum(((c(p) - c(q)) * (c(p) - c(q)) for p, q in zip(one, two, strict=True)), F.lit(0.0)))


def lightness(r, g, b) -> Column:
    return F.coalesce(c(r) * 0.2126 + c(g) * 0.7152 + c(b) * 0.0722, F.lit(0.0))


def snap_scale(scale) -> Column:
    """The first standard scale within SNAP, else null."""
    standard = F.array(*(F.lit(float(s)) for s in STANDARD_SCALES))
    return F.get(F.filter(standard, lambda s: F.abs(c(scale) - s) / s <= SNAP), F.lit(0))


def metres(points, scale) -> Column:
    """Length in metres of a length in points at a scale; an error without a scale."""
    known = F.when(c(scale).isNull(), F.raise_error(F.lit("the scale is not known")).cast("double")).otherwise(c(scale))
    return c(points) * (MM_PER_PT / 1000) * known


def points_of_mm(mm, scale) -> Column:
    """Length in points of a length in millimetres of the real thing at a scale; an error without a scale."""
    known = F.when(c(scale).isNull(), F.raise_error(F.lit("the scale is not known")).cast("double")).otherwise(c(scale))
    return c(mm) / (known * MM_PER_PT)


def bezier_point(p: list[tuple], parts, k) -> tuple[Column, Column]:
    """The point (x, y) at k / parts of a cubic with four control points."""
    xs, ys = [c(q[0]) for q in p], [c(q[1]) for q in p]
    t = c(k) / c(parts)
    s = F.lit(1.0) - t
    w = (s * s * s, s * s * t * 3.0, s * t * t * 3.0, t * t * t)
    return sum((a * b for a, b in zip(w, xs, strict=True)), F.lit(0.0)), sum((a * b for a, b in zip(w, ys, strict=True)), F.lit(0.0))


def polyline_length(points: Column) -> Column:
    """Length of an array of points (x, y); 0 for fewer than two. The points are computed once, whatever expression they are."""

    def walk(p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("len"), F.get(p, F.lit(0))["x"].alias("x"), F.get(p, F.lit(0))["y"].alias("y"))
        step = lambda s, e: F.struct((s["len"] + distance(s["x"], s["y"], e["x"], e["y"])).alias("len"), e["x"].alias("x"), e["y"].alias("y"))
        return F.when(F.size(p) < 2, F.lit(0.0)).otherwise(F.aggregate(p, start, step, lambda s: s["len"]))

    return bound(points, walk)


#: Drawing operations that close their path (fixed values).
CLOSING = ("re", "qu")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
