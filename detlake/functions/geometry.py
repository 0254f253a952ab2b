"""Geometry as Column expressions: everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")


def box_iou(a, b, crowd: Column | None = None) -> Column:
    """IoU of boxes (x, y, w, h); for a crowd b the denominator is a's area. 0 where it is 0."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    iw = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    ih = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter, area = iw * ih, aw * ah
    union = area + bw * bh - inter
    if crowd is not None:
        union = F.when(crowd, area).otherwise(union)
    return F.when(union <= 0, 0.0).otherwise(inter / union)


def corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> list[tuple[Column, Column]]:
    """The four corners of a rotated box, in order around it."""
    c, s = F.cos(angle), F.sin(angle)
    return [(cx + c * (w * i) - s * (h * j), cy + s * (w * i) + c * (h * j)) for i, j in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]


def rotated_bounds(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> tuple[Column, Column, Column, Column]:
    """Axis-aligned (x, y, w, h) around a rotated box."""
    points = corners(cx, cy, w, h, angle)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)


def rotated_from_corners(points: list[tuple[Column, Column]]) -> tuple[Column, Column, Column, Column, Column]:
    """(cx, cy, w, h, angle) of four corners: their mean, two edge lengths and the first edge's direction."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = points
    edge = lambda ax, ay, bx, by: F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    return (x0 + x1 + x2 + x3) / 4, (y0 + y1 + y2 + y3) / 4, edge(x0, y0, x1, y1), edge(x1, y1, x2, y2), F.atan2(y1 - y0, x1 - x0)


def every(values: Column, step: int, first: int) -> Column:
    """The elements at positions first, first + step, ... of an array."""
    return F.filter(values, lambda _, i: i % step == first)


def polygon_area(xy: Column) -> Column:
    """Shoelace area of a flat x, y, x, y, ... array; 0 under three points."""
    n = F.floor(F.size(xy) / 2).cast("int")
    at = lambda i: F.element_at(xy, (i + 1).cast("int"))
    term = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(2 * i) * at(2 * ((i + 1) % n) + 1) - at(2 * ((i + 1) % n)) * at(2 * i + 1))
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(term, F.lit(0.0), lambda a, x: a + x)) / 2)


def visible_keypoints(keypoints: Column) -> Column:
    """How many of the x, y, v triples have v over 0; 0 for null."""
    return F.coalesce(F.size(F.filter(keypoints, lambda v, i: (i % 3 == 2) & (v > 0))), F.lit(0))


def oks(dt: Column, gt: Column, gt_box, gt_area: Column, sigmas: list[float], visible: Column | None = None) -> Column:
    """Object keypoint similarity of flat x, y, v arrays.

    Over visible ground-truth keypoints; if none is, over all of them, by the
    distance outside the box grown to three times its size.  0 if either is null.
    One fold over the keypoints: unrolled, 17 terms outgrow a generated method.
    """
    bx, by, bw, bh = gt_box
    visible = visible_keypoints(gt) if visible is None else visible
    zero = F.lit(0.0)
    spread = F.array(*(F.lit((2 * s) ** 2) for s in sigmas))

    def term(total: Column, i: Column) -> Column:
        x, y, gx, gy, seen = (F.get(a, 3 * i + k) for a, k in ((dt, 0), (dt, 1), (gt, 0), (gt, 1), (gt, 2)))
        out_x = F.greatest(zero, bx - bw - x) + F.greatest(zero, x - (bx + 2 * bw))
        out_y = F.greatest(zero, by - bh - y) + F.greatest(zero, y - (by + 2 * bh))
        dx, dy = F.when(visible > 0, x - gx).otherwise(out_x), F.when(visible > 0, y - gy).otherwise(out_y)
        e = (dx * dx + dy * dy) / F.get(spread, i) / (gt_area + EPSILON) / 2
        return total + F.when((visible == 0) | (seen > 0), F.exp(-e)).otherwise(zero)

    mean = F.aggregate(F.sequence(F.lit(0), F.lit(len(sigmas) - 1)), zero, term) / F.when(visible > 0, visible).otherwise(F.lit(len(sigmas)))
    return F.when(dt.isNull() | gt.isNull(), zero).otherwise(mean)


def xyxy_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    return x1, y1, x2 - x1, y2 - y1
