"""Run-length masks: column-major runs that start with zeros.

The functions work on numpy arrays; ``udfs`` wraps them for DataFrames.
A mask is (h, w, counts).
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def encode(mask: np.ndarray):
    """Runs of a 2-D mask; of a 3-D one (h, w, n) a list of n of them."""
    if np.ndim(mask) == 3:
        return [encode(np.asarray(mask)[:, :, i]) for i in range(np.shape(mask)[2])]
    if np.ndim(mask) != 2:
        raise ValueError("a mask has two or three dimensions")
    mask = np.asarray(mask)
    flat = np.asarray(mask, bool).ravel(order="F")
    edge = np.flatnonzero(np.diff(flat, prepend=False))
    return mask.shape[0], mask.shape[1], np.diff(np.concatenate([[0], edge, [flat.size]])).tolist()


def _edges(counts) -> np.ndarray:
    return np.cumsum(np.asarray(counts, np.int64))


def decode(h: int, w: int, counts) -> np.ndarray:
    """The mask as uint8; runs beyond h * w are cut."""
    step = np.zeros(h * w + 1, np.int64)
    np.add.at(step, np.minimum(_edges(counts), h * w), 1)
    return (np.cumsum(step)[:-1] % 2).astype(np.uint8).reshape((h, w), order="F")


def area(counts) -> int:
    return int(sum(counts[1::2]))


def to_bbox(h: int, w: int, counts) -> list[float]:
    """x, y, w, h of the foreground; a run over several columns has full height; zeros for none."""
    end = _edges(counts)
    start = np.concatenate([[0], end[:-1]])[1::2] if len(end) else np.zeros(0, np.int64)
    stop = end[1::2][: len(start)]
    keep = stop > start
    start, last = start[keep], stop[keep] - 1
    if not len(start) or not h:
        return [0.0, 0.0, 0.0, 0.0]
    x0, x1, y0, y1 = start // h, last // h, start % h, last % h
    spans = x1 > x0
    low, high = np.where(spans, 0, y0).min(), np.where(spans, h - 1, y1).max()
    return [float(x0.min()), float(low), float(x1.max() - x0.min() + 1), float(high - low + 1)]


def merge(rles: list[tuple[int, int, list[int]]], intersect: bool = False) -> tuple[int, int, list[int]]:
    """Union or intersection, by how many masks cover each stretch between edges; (0, 0, []) for none."""
    if not rles:
        return 0, 0, []
    h, w, _ = rles[0]
    points, steps = [], []
    for _, _, counts in rles:
        e = _edges(counts)[:-1] if len(counts) else np.zeros(0, np.int64)
        points.append(e)
        steps.append(np.where(np.arange(len(e)) % 2 == 0, 1, -1))
    at, code = np.unique(np.concatenate(points), return_inverse=True)
    depth = np.cumsum(np.bincount(code, np.concatenate(steps), len(at))) if len(at) else np.zeros(0)
    on = depth >= (len(rles) if intersect else 1)
    edge = at[np.flatnonzero(np.diff(on.astype(int), prepend=0))]
    edge = edge[edge < h * w]
    return h, w, np.diff(np.concatenate([[0], edge, [h * w]])).tolist()


def iou(dt, gt, crowd: bool = False) -> float:
    """Intersection over union of two masks; over the detection's area for a crowd."""
    if dt[:2] != gt[:2]:
        return 0.0
    inter = area(merge([dt, gt], intersect=True)[2])
    union = area(dt[2]) if crowd else area(dt[2]) + area(gt[2]) - inter
    return inter / union if union else 0.0


def ious(a: list[np.ndarray], b: list[np.ndarray], crowd: np.ndarray) -> np.ndarray:
    """``iou`` of many pairs of masks, each pair of one size."""
    inter = intersections(a, b)
    one, two = (np.array([int(np.sum(x[1::2])) for x in m], np.int64) for m in (a, b))
    union = np.where(crowd, one, one + two - inter)
    return np.where(union > 0, inter / np.maximum(union, 1), 0.0)


def from_polygon(xy, h: int, w: int) -> tuple[int, int, list[int]]:
    """Scan conversion on a grid five times finer, with the truncating casts of the public algorithm; empty under three points.

    Boundary points that change column flip everything behind them in
    column-major order, so the edges of the mask are the positions that occur
    an odd number of times.
    """
    xy = np.asarray(xy, np.float64)
    if len(xy) // 2 < 3:
        return h, w, [h * w]
    points = np.trunc(5.0 * xy[: len(xy) // 2 * 2].reshape(-1, 2) + 0.5).astype(np.int64)
    us, vs = [], []
    for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, 0)):
        dx, dy = abs(x1 - x0), abs(y1 - y0)
        n, along_x = max(dx, dy), dx >= dy
        major, minor = ((x0, x1), (y0, y1)) if along_x else ((y0, y1), (x0, x1))
        back = major[0] > major[1]
        low = 1 if back else 0
        slope = (minor[1 - low] - minor[low]) / n if n else 0.0
        t = np.arange(n + 1)[:: -1 if back else 1]
        a, b = t + major[low], np.trunc(minor[low] + slope * t + 0.5).astype(np.int64)
        us.append(a if along_x else b)
        vs.append(b if along_x else a)
    u, v = np.concatenate(us), np.concatenate(vs)
    turn = np.flatnonzero(u[1:] != u[:-1])
    column = (np.where(u[turn + 1] < u[turn], u[turn + 1], u[turn + 1] - 1) + 0.5) / 5.0 - 0.5
    row = np.ceil(np.clip((np.minimum(v[turn + 1], v[turn]) + 0.5) / 5.0 - 0.5, 0, h))
    ok = (column == np.floor(column)) & (column >= 0) & (column <= w - 1)
    at, n = np.unique((column[ok] * h + row[ok]).astype(np.int64), return_counts=True)
    edge = at[(n % 2 == 1) & (at < h * w)]
    return h, w, np.diff(np.concatenate([[0], edge, [h * w]])).tolist()


def from_polygons(polygons, h: int, w: int) -> tuple[int, int, list[int]]:
    return merge([from_polygon(p, h, w) for p in polygons]) if polygons else (h, w, [h * w])


def polygon_edges(polygons: list, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``from_polygon`` of many polygons, each of its own size, at once: owner and position of every edge of the masks, in order."""
    none = np.zeros(0, np.int64)
    xy = [np.asarray(p, np.float64) for p in polygons]
    n = np.array([len(p) // 2 for p in xy], np.int64)
    n[n < 3] = 0
    if not n.sum():
        return none, none
    flat = np.concatenate([p[: 2 * k] for p, k in zip(xy, n)]).reshape(-1, 2)
    p = np.trunc(5.0 * flat + 0.5).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    begin = (np.cumsum(n) - n)[owner]
    at = np.arange(len(p))
    q = p[np.where(at + 1 < begin + n[owner], at + 1, begin)]
    d = np.abs(q - p)
    size, along_x = d.max(axis=1), d[:, 0] >= d[:, 1]
    major0, major1 = np.where(along_x, p[:, 0], p[:, 1]), np.where(along_x, q[:, 0], q[:, 1])
    minor0, minor1 = np.where(along_x, p[:, 1], p[:, 0]), np.where(along_x, q[:, 1], q[:, 0])
    back = major0 > major1
    base, minor_base = np.where(back, major1, major0), np.where(back, minor1, minor0)
    slope = np.where(size > 0, (np.where(back, minor0, minor1) - minor_base) / np.maximum(size, 1), 0.0)
    edge = np.repeat(at, size + 1)
    step = np.arange(len(edge)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    t = np.where(back[edge], size[edge] - step, step)
    a, b = t + base[edge], np.trunc(minor_base[edge] + slope[edge] * t + 0.5).astype(np.int64)
    u, v, of = np.where(along_x[edge], a, b), np.where(along_x[edge], b, a), owner[edge]
    turn = np.flatnonzero((u[1:] != u[:-1]) & (of[1:] == of[:-1]))
    of, high, wide = of[turn], h[of[turn]], w[of[turn]]
    column = (np.where(u[turn + 1] < u[turn], u[turn + 1], u[turn + 1] - 1) + 0.5) / 5.0 - 0.5
    row = np.ceil(np.clip((np.minimum(v[turn + 1], v[turn]) + 0.5) / 5.0 - 0.5, 0, high))
    ok = (column == np.floor(column)) & (column >= 0) & (column <= wide - 1)
    of, place = of[ok], (column[ok] * high[ok] + row[ok]).astype(np.int64)
    order = np.lexsort((place, of))
    of, place = of[order], place[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    odd = first[(np.diff(np.append(first, len(of))) % 2 == 1) & (place[first] < (h * w)[of[first]])]
    return of[odd], place[odd]


def edge_extents(owner: np.ndarray, edge: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Area and ``to_bbox`` (a row each) of masks given by their edges in order."""
    n = np.bincount(owner, minlength=len(h))
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    on = np.flatnonzero(at % 2 == 0)
    of, start = owner[on], edge[on]
    has = (on + 1 < len(owner)) & (owner[np.minimum(on + 1, len(owner) - 1)] == of) if len(owner) else np.zeros(0, bool)
    stop = np.where(has, edge[np.minimum(on + 1, len(owner) - 1)], (h * w)[of]) if len(owner) else start
    area_ = np.bincount(of, stop - start, len(h)).astype(np.int64)
    box = np.zeros((len(h), 4))
    if len(of):
        x0, x1, y0, y1 = start // h[of], (stop - 1) // h[of], start % h[of], (stop - 1) % h[of]
        spans = x1 > x0
        head = np.flatnonzero(np.diff(of, prepend=-1))
        who = of[head]
        left, right = np.minimum.reduceat(x0, head), np.maximum.reduceat(x1, head)
        low, high = np.minimum.reduceat(np.where(spans, 0, y0), head), np.maximum.reduceat(np.where(spans, h[of] - 1, y1), head)
        box[who] = np.stack([left, low, right - left + 1, high - low + 1], axis=1)
    return area_, box


def from_bbox(bbox, h: int, w: int) -> tuple[int, int, list[int]]:
    """Mask of the pixels that an x, y, w, h box covers, rounded outwards and cut at the image."""
    x, y, bw, bh = bbox
    x0, y0 = max(0, int(np.floor(x))), max(0, int(np.floor(y)))
    x1, y1 = min(w, int(np.ceil(x + bw))), min(h, int(np.ceil(y + bh)))
    if x1 <= x0 or y1 <= y0:
        return h, w, [h * w]
    # Column by column: what lies above and below merges into one gap.
    counts = [x0 * h + y0, *([y1 - y0, h - (y1 - y0)] * (x1 - x0))]
    counts[-1] = (w - x1) * h + h - y1
    return h, w, counts if counts[-1] else counts[:-1]


def from_objects(segmentation, h: int, w: int):
    """Masks of a segmentation as documents have it: run lengths of one, or a list of those or of polygons, one mask each."""
    def one(s):
        if isinstance(s, dict):
            sh, sw = (int(v) for v in s["size"])
            return from_string(s["counts"], sh, sw) if isinstance(s["counts"], str) else (sh, sw, [int(c) for c in s["counts"]])
        return from_polygon(s, h, w)

    return one(segmentation) if isinstance(segmentation, dict) else [one(s) for s in segmentation]


def of_annotation(segmentation, h: int, w: int) -> np.ndarray:
    """The mask of an annotation as an array: run lengths, or the union of polygons; empty for none."""
    if not segmentation:
        return np.zeros((h, w), np.uint8)
    found = from_objects(segmentation, h, w)
    return decode(*(found if isinstance(segmentation, dict) else merge(found)))


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Pixels that the masks a[i] and b[i] (counts, of one size) share, for all pairs at once.

    The foreground of b up to a position is a step function of its edges; a
    run of a has the difference of that at its two ends.
    """
    def edges(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in runs], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *runs]).astype(np.int64)
        total = np.append(0, np.cumsum(flat))
        first = np.cumsum(size) - size
        at = np.arange(len(flat)) - np.repeat(first, size)
        return np.repeat(np.arange(len(runs)), size), at, total[1:] - np.repeat(total[first], size)

    owner, at, stop = edges(a)
    fore = np.flatnonzero(at % 2 == 1)  # a foreground run goes from the edge before to its own
    owner, low, high = owner[fore], stop[fore - 1], stop[fore]
    of, at, end = edges(b)
    span = int(max(stop.max(initial=0), end.max(initial=0))) + 1
    keys = of * span + end
    begin = np.where(at > 0, np.append(0, end[:-1]), 0)
    own = np.where(at % 2 == 1, end - begin, 0)
    before = np.append(0, np.cumsum(own))  # foreground of all runs before

    def covered(pair: np.ndarray, x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(keys, pair * span + x, "left")
        inside = np.minimum(k, len(keys) - 1)
        part = np.where((k < len(keys)) & (of[inside] == pair) & (at[inside] % 2 == 1), x - begin[inside], 0)
        return before[k] + part

    if not len(keys) or not len(owner):
        return np.zeros(len(a), np.int64)
    return np.bincount(owner, covered(owner, high) - covered(owner, low), len(a)).astype(np.int64)


def to_string(counts) -> str:
    """Counts as printable 6-bit groups, low bits first; from the fourth on as differences to the one two before."""
    out = []
    for i, n in enumerate(counts):
        x = int(n) - (int(counts[i - 2]) if i > 2 else 0)
        while True:
            group, x = x & 31, x >> 5
            done = x == (-1 if group & 16 else 0)
            out.append(chr(48 + group + (0 if done else 32)))
            if done:
                break
    return "".join(out)


def from_string(text: str, h: int, w: int) -> tuple[int, int, list[int]]:
    """Inverse of to_string; ValueError for other characters, negative counts or more than h * w pixels."""
    counts: list[int] = []
    x = shift = 0
    for c in text.encode():
        if c < 48:
            raise ValueError(f"character {c} is below '0'")
        x |= ((c - 48) & 31) << shift
        shift += 5
        if (c - 48) & 32:
            continue
        if x >> (shift - 1) & 1:
            x -= 1 << shift
        x += counts[-2] if len(counts) > 2 else 0
        if x < 0:
            raise ValueError(f"negative count {x}")
        counts.append(x)
        x = shift = 0
    if sum(counts) > h * w:
        raise ValueError("more pixels than h * w")
    return h, w, counts


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one with counter-clockwise corners."""
    out = np.asarray(subject, np.float64)
    for a, b in zip(clip, np.roll(clip, -1, 0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, side_next, kept = np.roll(out, -1, 0), np.roll(side, -1), []
        for p, q, s, t in zip(out, nxt, side, side_next):
            if s >= 0:
                kept.append(p)
            if (s >= 0) != (t >= 0) and abs(s - t) > 1e-12:
                kept.append(p + (q - p) * (s / (s - t)))
        out = np.array(kept)
    return out


def rotated_iou(a, b, crowd: bool = False) -> float:
    """IoU of rotated boxes (cx, cy, w, h, angle); 0 if either has no area."""
    if a[2] * a[3] <= 0 or b[2] * b[3] <= 0:
        return 0.0

    def corners(o):
        c, s = np.cos(o[4]), np.sin(o[4])
        half = np.array([[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5]]) * [o[2], o[3]]
        return half @ np.array([[c, s], [-s, c]]) + [o[0], o[1]]

    p = clip_convex(corners(a), corners(b))
    inter = 0.0 if len(p) < 3 else abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2
    union = a[2] * a[3] if crowd else a[2] * a[3] + b[2] * b[3] - inter
    return float(inter / union) if union > 0 else 0.0


def rotated_ious(a: np.ndarray, b: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """``rotated_iou`` of many pairs, a row of cx, cy, w, h, angle each."""
    def corners(o: np.ndarray) -> np.ndarray:
        c, s = np.cos(o[:, 4]), np.sin(o[:, 4])
        px, py = (np.array(k)[None, :] * o[:, i, None] for k, i in (([-0.5, 0.5, 0.5, -0.5], 2), ([-0.5, -0.5, 0.5, 0.5], 3)))
        return np.stack([c[:, None] * px - s[:, None] * py + o[:, 0, None], s[:, None] * px + c[:, None] * py + o[:, 1, None]], axis=2)

    p, clip = corners(a), corners(b)
    n = np.full(len(a), 4)
    for k in range(4):
        u, v = clip[:, k, None], clip[:, (k + 1) % 4, None]
        side = (v[..., 0] - u[..., 0]) * (p[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (p[..., 0] - u[..., 0])
        at = np.arange(p.shape[1])
        after = np.where(at + 1 < n[:, None], at + 1, 0)
        q, side_q = np.take_along_axis(p, after[..., None], 1), np.take_along_axis(side, after, 1)
        live = at < n[:, None]
        stays, cuts = live & (side >= 0), live & ((side >= 0) != (side_q >= 0)) & (np.abs(side - side_q) > 1e-12)
        share = side / np.where(cuts, side - side_q, 1.0)
        both = np.stack([p, p + (q - p) * share[..., None]], axis=2).reshape(len(a), -1, 2)
        kept = np.stack([stays, cuts], axis=2).reshape(len(a), -1)
        n = kept.sum(axis=1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, : max(1, int(n.max(initial=1)))]
        p = np.take_along_axis(both, order[..., None], 1)
    at = np.arange(p.shape[1])
    q = np.take_along_axis(p, np.where(at + 1 < n[:, None], at + 1, 0)[..., None], 1)
    cross = np.where(at < n[:, None], p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0], 0.0)
    inter = np.where(n < 3, 0.0, np.abs(cross.sum(axis=1)) / 2)
    one, two = a[:, 2] * a[:, 3], b[:, 2] * b[:, 3]
    union = np.where(crowd, one, one + two - inter)
    return np.where((one > 0) & (two > 0) & (union > 0), inter / np.where(union > 0, union, 1.0), 0.0)


def udfs():
    """Arrow UDFs by name: mask_iou(dt counts, gt counts, crowd), obb_iou(a, b, crowd), rle_area, polygon_rle and rle_string."""
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def mask_iou(dt: pd.Series, gt: pd.Series, crowd: pd.Series) -> pd.Series:
        return pd.Series(ious(list(dt), list(gt), crowd.to_numpy(bool)), dtype="float64")

    @F.pandas_udf("double")
    def obb_iou(a: pd.Series, b: pd.Series, crowd: pd.Series) -> pd.Series:
        return pd.Series(rotated_ious(np.array(a.tolist(), float).reshape(-1, 5), np.array(b.tolist(), float).reshape(-1, 5), crowd.to_numpy(bool)))

    @F.pandas_udf("array<bigint>")
    def polygon_rle(polygons: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([from_polygons([list(q) for q in p], x, y)[2] for p, x, y in zip(polygons, h, w)])

    @F.pandas_udf("string")
    def rle_string(counts: pd.Series) -> pd.Series:
        return counts.map(to_string)

    rle_area = lambda c: F.aggregate(F.filter(c, lambda x, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return {"mask_iou": mask_iou, "obb_iou": obb_iou, "polygon_rle": polygon_rle, "rle_string": rle_string, "rle_area": rle_area}


def register(spark) -> None:
    """The Arrow functions under their names in SQL, with rle_area as mask_area."""
    from pyspark.sql import functions as F

    named = udfs()
    for name in ("mask_iou", "obb_iou", "polygon_rle", "rle_string"):
        spark.udf.register(name, named[name])

    @F.pandas_udf("bigint")
    def mask_area(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: int(np.sum(c[1::2])))

    spark.udf.register("mask_area", mask_area)
