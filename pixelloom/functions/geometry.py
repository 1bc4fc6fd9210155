"""Plane geometry as Column expressions. A polygon is an array of structs (x, y); a quad is four of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.color import clampf

XY = tuple[Column, Column]


def quad_points(q: Column) -> list[XY]:
    return [(q[i]["x"], q[i]["y"]) for i in range(4)]


def as_quad(points: list[XY]) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))


def dist(a: XY, b: XY) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def cross(o: XY, a: XY, b: XY) -> Column:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def line_through(a: XY, b: XY) -> tuple[XY, XY]:
    """A point and a unit direction; (1, 0) if the points are the same."""
    length = dist(a, b)
    same = length < 1e-9
    return a, (F.when(same, 1.0).otherwise((b[0] - a[0]) / length), F.when(same, 0.0).otherwise((b[1] - a[1]) / length))


def point_line_dist(p: XY, line: tuple[XY, XY]) -> Column:
    (ox, oy), (dx, dy) = line
    return F.abs((p[0] - ox) * dy - (p[1] - oy) * dx)


def perp_dist(p: XY, a: XY, b: XY) -> Column:
    length = dist(a, b)
    return F.when(length < 1e-6, dist(p, a)).otherwise(F.abs(cross(a, b, p)) / length)


def angle_between(u: XY, v: XY) -> Column:
    """Degrees between two directions; 0 if one has no length."""
    n = F.sqrt(u[0] * u[0] + u[1] * u[1]) * F.sqrt(v[0] * v[0] + v[1] * v[1])
    return F.when(n < 1e-9, 0.0).otherwise(F.degrees(F.acos(clampf((u[0] * v[0] + u[1] * v[1]) / n, -1.0, 1.0))))


def turn_from_straight(a: XY, b: XY, c: XY) -> Column:
    return angle_between((b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1]))


def interior_deg(before: XY, at: XY, after: XY) -> Column:
    return angle_between((before[0] - at[0], before[1] - at[1]), (after[0] - at[0], after[1] - at[1]))


def quad_area(p: list[XY]) -> Column:
    twice = sum((p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(4)), F.lit(0.0))
    return F.abs(twice) / 2.0


def convex_quad(p: list[XY], least: float = 1.0) -> Column:
    """All turns the same way, none nearly straight."""
    turns = [cross(p[i], p[(i + 1) % 4], p[(i + 2) % 4]) for i in range(4)]
    return (F.least(*turns) >= least) | (F.greatest(*turns) <= -least)


def distinct_corners(p: list[XY], least: float = 4.0) -> Column:
    return F.least(*(dist(p[i], p[j]) for i in range(4) for j in range(i))) >= least


def inside_convex(x: Column, y: Column, p: list[XY], slack: float = 0.5) -> Column:
    """Within half-planes of a convex quad, moved outward by ``slack``; either orientation."""
    sides = [cross(p[i], p[(i + 1) % 4], (x, y)) / F.greatest(dist(p[i], p[(i + 1) % 4]), F.lit(1e-6)) for i in range(4)]
    return (F.least(*sides) >= -slack) | (F.greatest(*sides) <= slack)


def geometry_ok(p: list[XY], width: Column, height: Column) -> Column:
    """Convex, at least 8 % of the frame, all angles 60 .. 120 degrees, corners within a tenth of the frame around it."""
    angles = [interior_deg(p[(i + 3) % 4], p[i], p[(i + 1) % 4]) for i in range(4)]
    ok = convex_quad(p) & (quad_area(p) >= 0.08 * width * height) & (F.least(*angles) >= 60.0) & (F.greatest(*angles) <= 120.0)
    for x, y in p:
        ok = ok & x.between(-0.1 * width, 1.1 * width) & y.between(-0.1 * height, 1.1 * height)
    return ok


def point_in_poly(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd rule: crossings of a ray with all edges, folded over the array."""
    n = F.size(poly)

    def crossing(i: Column) -> Column:
        a, b = poly[i], poly[(i + n - 1) % n]
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans, (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crossing(i)) % 2 == 1


def on_sheet(x: Column, y: Column, poly: Column, nudge: float = 1.5) -> Column:
    tests = [(0.0, 0.0), (nudge, 0.0), (-nudge, 0.0), (0.0, nudge), (0.0, -nudge)]
    ok = F.lit(False)
    for dx, dy in tests:
        ok = ok | point_in_poly(x + dx, y + dy, poly)
    return ok


def in_sweep(angle: Column, start: Column, end: Column, pad: float = 0.12, widest: float = 3.6) -> Column:
    """Whether an angle is in the sector from start to end, in radians."""
    turn = 6.283185307179586
    wrap = lambda v: v - turn * F.floor(v / turn)
    span = wrap(end - start)
    return (span <= widest) & (wrap(angle - start + pad) <= span + 2 * pad)


def order_corners(q: Column) -> Column:
    """Top left, top right, bottom right, bottom left by sums and differences; the first of equals."""

    def first_least(value) -> Column:
        ranked = F.transform(q, lambda p, i: F.struct(value(p).alias("v"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))
        best = F.array_min(ranked)
        return F.struct(best["x"].alias("x"), best["y"].alias("y"))

    return F.array(first_least(lambda p: p["x"] + p["y"]), first_least(lambda p: p["y"] - p["x"]), first_least(lambda p: -(p["x"] + p["y"])), first_least(lambda p: p["x"] - p["y"]))


def intersect_polar(c1: Column, s1: Column, rho1: Column, c2: Column, s2: Column, rho2: Column) -> Column:
    """Where x cos + y sin = rho meet; null if the lines are less than about 20 degrees apart."""
    det = c1 * s2 - s1 * c2
    return F.when(F.abs(det) >= 0.34, F.struct(((rho1 * s2 - rho2 * s1) / det).alias("x"), ((c1 * rho2 - c2 * rho1) / det).alias("y")))


def intersect_lines(a: tuple[XY, XY], b: tuple[XY, XY]) -> Column:
    (ax, ay), (adx, ady) = a
    (bx, by), (bdx, bdy) = b
    det = adx * bdy - ady * bdx
    t = ((bx - ax) * bdy - (by - ay) * bdx) / det
    return F.when(F.abs(det) >= 1e-8, F.struct((ax + t * adx).alias("x"), (ay + t * ady).alias("y")))


def seg_cross(a: XY, b: XY, c: XY, d: XY, lo: float = 0.08, hi: float = 0.92) -> Column:
    """Where two segments cross well inside both; null if they don't."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    det = ux * vy - uy * vx
    some = F.when(F.abs(det) >= 1e-6, det)
    t = ((c[0] - a[0]) * vy - (c[1] - a[1]) * vx) / some
    u = ((c[0] - a[0]) * uy - (c[1] - a[1]) * ux) / some
    return F.when(t.between(lo, hi) & u.between(lo, hi), F.struct((a[0] + t * ux).alias("x"), (a[1] + t * uy).alias("y")))


def bezier_at(p: list[XY], t: Column) -> XY:
    u = 1.0 - t
    w = [u * u * u, 3.0 * u * u * t, 3.0 * u * t * t, t * t * t]
    return tuple(w[0] * p[0][k] + w[1] * p[1][k] + w[2] * p[2][k] + w[3] * p[3][k] for k in (0, 1))


def corner_pixels(p: list[XY]) -> tuple[Column, Column]:
    """Output size of a quad: the longer of opposite sides."""
    side = lambda i, j: dist(p[i], p[j])
    return F.floor(F.greatest(side(0, 1), side(3, 2)) + 0.5), F.floor(F.greatest(side(0, 3), side(1, 2)) + 0.5)


def clamp_out(ow: Column, oh: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """16 .. twice the source each way, and at most 1.25 times its area."""
    w, h = clampf(ow.cast("double"), 16.0, 2.0 * width), clampf(oh.cast("double"), 16.0, 2.0 * height)
    over = F.sqrt(F.least(F.lit(1.0), 1.25 * width * height / (w * h)))
    return F.greatest(F.lit(16.0), F.floor(w * over)), F.greatest(F.lit(16.0), F.floor(h * over))


def to_source(p: XY, sx: Column, sy: Column) -> XY:
    """Detection grid to source coordinates, by pixel centres."""
    return (p[0] + 0.5) * sx - 0.5, (p[1] + 0.5) * sy - 0.5


def corner_shift(a: list[XY], b: list[XY]) -> Column:
    return F.greatest(*(dist(p, q) for p, q in zip(a, b)))


def nearer_handle(f: XY, knot: XY, tip: XY) -> Column:
    """True if the tip's mirror image about the knot is nearer to the finger than the tip."""
    mirror = (2.0 * knot[0] - tip[0], 2.0 * knot[1] - tip[1])
    return dist(f, mirror) < dist(f, tip)


def image_to_screen(x: Column, y: Column, scale: Column, ox: Column, oy: Column) -> XY:
    return ox + x * scale, oy + y * scale


def fit_scale(image_w: Column, image_h: Column, view_w: Column, view_h: Column) -> Column:
    usable = (image_w > 0) & (image_h > 0) & (view_w > 0) & (view_h > 0)
    return F.when(usable, F.least(view_w / image_w, view_h / image_h)).otherwise(1.0)


def view_rect(image_w: Column, image_h: Column, view_w: Column, view_h: Column) -> tuple[Column, Column, Column, Column]:
    """(x, y, width, height) of an image fitted to a view, centred."""
    scale = fit_scale(image_w, image_h, view_w, view_h)
    width, height = image_w * scale, image_h * scale
    return (view_w - width) / 2.0, (view_h - height) / 2.0, width, height


# How far a dot leads the finger, from where a pull is a curve, how near a dot comes to a corner.
AIM_LEAD, AIM_PULL, AIM_MARGIN, AIM_MARGIN_SHARE = 64.0, 32.0, 12.0, 0.45


def aim_on_segment(f: XY, a: XY, b: XY) -> Column:
    """Where a dot on the segment from a to b goes that leads the finger f to the side with more room, in a struct; null for
    segments shorter than a pixel. perp: the finger's signed distance from the line, which is also the pull."""
    full = dist(a, b)
    length = F.when(full >= 1.0, full)
    ux, uy = (b[0] - a[0]) / length, (b[1] - a[1]) / length
    vx, vy = f[0] - a[0], f[1] - a[1]
    perp = vy * ux - vx * uy
    margin = F.least(AIM_MARGIN_SHARE * length, F.lit(AIM_MARGIN))
    at = F.greatest(margin, F.least(length - margin, vx * ux + vy * uy))
    ahead, behind = length - margin - at, at - margin
    dot = F.when(ahead >= behind, at + F.least(F.lit(AIM_LEAD), ahead)).otherwise(at - F.least(F.lit(AIM_LEAD), behind))
    fields = {"ghost_x": a[0] + ux * dot, "ghost_y": a[1] + uy * dot, "t": dot / length, "perp": perp, "pull_x": -uy * perp, "pull_y": ux * perp}
    fields |= {"curve": F.abs(perp) >= AIM_PULL, "finger": F.hypot(vx - ux * at, vy - uy * at)}
    return F.when(length.isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items())))
