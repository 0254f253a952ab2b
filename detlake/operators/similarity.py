"""Pairs of detections and ground truth by masks, keypoints and rotated boxes; each can take the place of ``box_pairs``.

Masks and rotated boxes are bounded by axis-aligned boxes first: shapes whose
bounds don't touch have similarity 0 and never reach the Arrow functions.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.functions import masks
from detlake.functions.geometry import EPSILON, every, oks, rotated_bounds, visible_keypoints
from detlake.operators.matching import Pairs, Values, Within, ignored_always
from detlake.operators.params import OKS_SIGMAS

MASK = "struct<h:int,w:int,counts:array<bigint>,x:double,y:double,bw:double,bh:double,area:bigint>"
#: Polygons that are drawn together.
POLYGONS = 256


def rle_of(segmentation: str | None, bbox: list[float] | None, h: int, w: int) -> tuple[int, int, list[int]] | None:
    """Mask of an annotation: polygons, run lengths (as text or list) or else the box; None for text that is no mask and for neither."""
    if segmentation is not None:
        try:
            s = json.loads(segmentation)
            if isinstance(s, list):
                return masks.from_polygons(s, h, w)
            mh, mw = (int(v) for v in s["size"])
            return masks.from_string(s["counts"], mh, mw) if isinstance(s["counts"], str) else (mh, mw, [int(c) for c in s["counts"]])
        except (ValueError, KeyError, TypeError):
            return None
    return None if bbox is None else masks.from_bbox(bbox, h, w)


def _mask(segmentation: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    rows = []
    for s, *box, ih, iw in zip(segmentation, x, y, w, h, height, width):
        m = rle_of(s, None if any(pd.isna(v) for v in box) else box, int(ih), int(iw))
        rows.append((None,) * 8 if m is None else (m[0], m[1], m[2], *masks.to_bbox(*m), masks.area(m[2])))
    return pd.DataFrame(rows, columns=["h", "w", "counts", "x", "y", "bw", "bh", "area"])


def _lean_mask(segmentation: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """``_mask`` with null counts where a mask fills its box; boxes and single polygons are done for the whole batch."""
    n, ih, iw = len(segmentation), height.to_numpy(np.int64), width.to_numpy(np.int64)
    box = np.stack([v.to_numpy(float) for v in (x, y, w, h)])
    extent, area, known = np.zeros((n, 4)), np.zeros(n, np.int64), np.zeros(n, bool)
    boxed = segmentation.isna().to_numpy() & ~np.isnan(box).any(axis=0)
    bx, by, bw, bh = box[:, boxed]
    x0, y0 = np.maximum(0, np.floor(bx)), np.maximum(0, np.floor(by))
    size = np.maximum(0, np.minimum(iw[boxed], np.ceil(bx + bw)) - x0), np.maximum(0, np.minimum(ih[boxed], np.ceil(by + bh)) - y0)
    some = (size[0] > 0) & (size[1] > 0)
    extent[boxed] = np.where(some, np.stack([x0, y0, *size]), 0).T
    area[boxed], known[boxed] = np.where(some, size[0] * size[1], 0).astype(np.int64), True
    counts = np.empty(n, object)
    rows, single, polygons = [], [], []
    for k in np.flatnonzero(~boxed):
        try:
            s = json.loads(segmentation.iat[k])
            ok = isinstance(s, list) and len(s) == 1 and all(type(v) in (int, float) for v in s[0])
        except (ValueError, TypeError):
            ok = False
        if ok:
            single.append(k)
            polygons.append(s[0])
        else:
            rows.append(k)
    for low in range(0, len(single), POLYGONS):
        at = np.array(single[low : low + POLYGONS])
        owner, edge = masks.polygon_edges(polygons[low : low + POLYGONS], ih[at], iw[at])
        area[at], extent[at] = masks.edge_extents(owner, edge, ih[at], iw[at])
        known[at] = True
        for k in np.flatnonzero(area[at] != extent[at, 2] * extent[at, 3]):
            own = edge[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]
            counts[at[k]] = np.diff(np.concatenate([[0], own, [ih[at[k]] * iw[at[k]]]]))
    mh, mw = ih.copy(), iw.copy()
    for k in rows:
        m = rle_of(segmentation.iat[k], None if np.isnan(box[:, k]).any() else list(box[:, k]), int(ih[k]), int(iw[k]))
        if m is not None:
            mh[k], mw[k], known[k], extent[k], area[k] = m[0], m[1], True, masks.to_bbox(*m), masks.area(m[2])
            if area[k] != extent[k, 2] * extent[k, 3]:
                counts[k] = m[2]
    whole = lambda v, kind: pd.Series(pd.array(np.where(known, v, 0), dtype=kind)).where(pd.Series(known))
    return pd.DataFrame({"h": whole(mh, "Int32"), "w": whole(mw, "Int32"), "counts": counts, **{c: np.where(known, extent[:, i], np.nan) for i, c in enumerate(("x", "y", "bw", "bh"))}, "area": whole(area, "Int64")})


def packed_extent(segmentation: pd.Series) -> pd.DataFrame:
    """Area and box of run lengths given as text; null for any other segmentation."""
    rows = []
    for s in segmentation:
        try:
            doc = json.loads(s) if s else None
            packed = isinstance(doc, dict) and isinstance(doc.get("counts"), str)
        except ValueError:
            packed = False
        m = rle_of(s, None, 0, 0) if packed else None
        rows.append((None, None) if m is None else (float(masks.area(m[2])), masks.to_bbox(*m)))
    return pd.DataFrame(rows, columns=["area", "bbox"])


def with_masks(rows: DataFrame, images: DataFrame, lean: bool = False) -> DataFrame:
    """Rows with their ``mask``. Rows without an image have none; the mask of a bad segmentation has null counts.

    Lean masks have no counts where they fill their box, which says it all.
    """
    if "segmentation" not in rows.columns:
        rows = rows.withColumn("segmentation", F.lit(None).cast("string"))
    dims = images.groupBy(F.col("id").alias("image_id")).agg(F.max("height").alias("_ih"), F.max("width").alias("_iw"))
    joined = rows.join(dims, "image_id", "left")
    made = F.pandas_udf(_lean_mask if lean else _mask, MASK)("segmentation", *"xywh", F.coalesce("_ih", F.lit(0)), F.coalesce("_iw", F.lit(0)))
    return joined.withColumn("mask", F.when(F.col("_ih").isNotNull(), made)).drop("_ih", "_iw")


def _right(gt: DataFrame, *columns: Column) -> DataFrame:
    crowd = F.coalesce("iscrowd", F.lit(False))
    return gt.select("image_id", "category_id", F.col("id").alias("gt_id"), crowd.alias("crowd"), ignored_always(gt).alias("ignore"), F.coalesce("area", F.lit(0.0)).alias("gt_area"), *columns)


def _touch(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (a[0] < b[0] + b[2]) & (b[0] < a[0] + a[2]) & (a[1] < b[1] + b[3]) & (b[1] < a[1] + a[3])


def _mask_iou(dt: pd.Series, dh: pd.Series, dw: pd.Series, gt: pd.Series, gh: pd.Series, gw: pd.Series, crowd: pd.Series) -> pd.Series:
    same = ((dh == gh) & (dw == gw)).to_numpy()
    out = np.zeros(len(dt))
    out[same] = masks.ious(list(dt[same]), list(gt[same]), crowd[same].to_numpy(bool))
    return pd.Series(out)


def _rotated_iou(a: pd.Series, b: pd.Series, crowd: pd.Series) -> pd.Series:
    return pd.Series(masks.rotated_ious(np.array(a.tolist(), float).reshape(-1, 5), np.array(b.tolist(), float).reshape(-1, 5), crowd.to_numpy(bool)), dtype="float64")


def mask_pairs(dt: DataFrame, gt: DataFrame) -> DataFrame:
    """IoU of masks (``with_masks``); a crowd's denominator is the detection's area. Masks of another size don't overlap."""
    right = _right(gt, F.col("mask").alias("g"))
    bound = lambda m: tuple(F.col(f"{m}.{c}") for c in ("x", "y", "bw", "bh"))
    pairs = dt.join(right, ["image_id", "category_id"]).where(_touch(bound("mask"), bound("g")))
    return pairs.withColumn("iou", F.pandas_udf(_mask_iou, "double")("mask.counts", "mask.h", "mask.w", "g.counts", "g.h", "g.w", "crowd"))


_EXTENT = ("x", "y", "bw", "bh", "area", "h", "w")


def _mask_columns(df: DataFrame, own: bool) -> dict[str, Column]:
    filled = F.col("mask.area") == F.col("mask.bw") * F.col("mask.bh")
    return {**{f"m{c}": F.col(f"mask.{c}").cast("double") for c in _EXTENT}, "counts": F.when(~filled, F.col("mask.counts"))}


def _masks_similar(d: Values, g: Values, i: np.ndarray, j: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """IoU of masks: of two that fill their boxes from these, of others from their runs."""
    side = lambda at, size: np.maximum(0.0, np.minimum((d[at] + d[size])[i], (g[at] + g[size])[j]) - np.maximum(d[at][i], g[at][j]))
    inter = side("mx", "mbw") * side("my", "mbh")
    runs = lambda v, k: np.asarray(v["counts"][k] if v["counts"][k] is not None else masks.from_bbox([v[c][k] for c in ("mx", "my", "mbw", "mbh")], int(v["mh"][k]), int(v["mw"][k]))[2], np.int64)
    same = (d["mh"][i] == g["mh"][j]) & (d["mw"][i] == g["mw"][j])
    none = [np.array([x is None for x in v["counts"]], bool) for v in (d, g)]
    odd = np.flatnonzero(same & ~(none[0][i] & none[1][j]))
    if len(odd):
        left, right = ({k: runs(v, k) for k in np.unique(at[odd])} for v, at in ((d, i), (g, j)))
        for low in range(0, len(odd), 4096):
            at = odd[low : low + 4096]
            inter[at] = masks.intersections([left[k] for k in i[at]], [right[k] for k in j[at]])
    one = d["marea"][i]
    union = np.where(crowd, one, one + g["marea"][j] - inter)
    return np.where(same & (union > 0), inter / np.maximum(union, 1), 0.0)


mask_pairs.within = Within(_mask_columns, lambda v, own: (v["mx"], v["my"], v["mx"] + v["mbw"], v["my"] + v["mbh"]), _masks_similar)


def rotated_pairs(dt: DataFrame, gt: DataFrame) -> DataFrame:
    """IoU of rotated boxes (array ``obb`` of cx, cy, w, h, angle); rows without one have no pair."""
    bound = lambda c: rotated_bounds(*(F.col(c)[i] for i in range(5)))
    right = _right(gt.where("obb is not null"), F.col("obb").alias("g"))
    pairs = dt.where("obb is not null").join(right, ["image_id", "category_id"]).where(_touch(bound("obb"), bound("g")))
    return pairs.withColumn("iou", F.pandas_udf(_rotated_iou, "double")("obb", "g", "crowd"))


def _rotated_bounds(v: Values, own: bool) -> tuple[np.ndarray, ...]:
    cx, cy, w, h, angle = (v[f"o{i}"] for i in range(5))
    c, s = np.cos(angle), np.sin(angle)
    x = np.array([cx + c * (w * a) - s * (h * b) for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))])
    y = np.array([cy + s * (w * a) + c * (h * b) for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))])
    return x.min(axis=0), y.min(axis=0), x.max(axis=0), y.max(axis=0)


def _rotated_similar(d: Values, g: Values, i: np.ndarray, j: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    a, b = (np.stack([v[f"o{k}"] for k in range(5)], axis=1) for v in (d, g))
    parts = [masks.rotated_ious(a[i[k : k + 65536]], b[j[k : k + 65536]], crowd[k : k + 65536]) for k in range(0, len(i), 65536)]
    return np.concatenate(parts)


rotated_pairs.within = Within(lambda df, own: {f"o{i}": F.get("obb", F.lit(i)).cast("double") for i in range(5)}, _rotated_bounds, _rotated_similar)


def keypoint_pairs(sigmas: list[float] | None = None, least: float = 0.5) -> Pairs:
    """Pairs by keypoint similarity that may reach ``least``, without Python.

    A mean of exp(-e) is at least ``least`` only if some e is at most
    -ln(least): then a keypoint lies near its counterpart, or near the grown
    box where none is visible.  So the extents of both, grown by that
    distance, touch; the join tests this and loses no such pair.
    """
    chosen = OKS_SIGMAS if sigmas is None else sigmas
    reach = (2 * -math.log(least)) ** 0.5 * 2 * max(chosen) if least > 0 else math.inf

    def pairs(dt: DataFrame, gt: DataFrame) -> DataFrame:
        zero = F.lit(0.0)
        right = _right(gt, F.col("keypoints").alias("g"), visible_keypoints(F.col("keypoints")).alias("seen"), *(F.coalesce(c, zero).alias(f"g{c}") for c in "xywh"))
        gx, gy, gw, gh, seen = (F.col(c) for c in ("gx", "gy", "gw", "gh", "seen"))
        shown = lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(chosen) - 1)), lambda i: F.get("g", 3 * i + 2) > 0), lambda i: F.get("g", 3 * i + k))
        far = reach * F.sqrt(F.col("gt_area") + EPSILON) * 1.001 + 1e-6
        span = lambda k, at, size: (F.when(seen > 0, F.array_min(shown(k))).otherwise(at - size) - far, F.when(seen > 0, F.array_max(shown(k))).otherwise(at + 2 * size) + far)
        (x0, x1), (y0, y1) = span(0, gx, gw), span(1, gy, gh)
        right = right.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1})
        xs, ys = (every(F.slice("keypoints", 1, 3 * len(chosen)), 3, k) for k in (0, 1))
        dt = dt.withColumns({"_dx0": F.array_min(xs), "_dx1": F.array_max(xs), "_dy0": F.array_min(ys), "_dy1": F.array_max(ys)})
        touch = (F.col("_dx0") <= F.col("_x1")) & (F.col("_x0") <= F.col("_dx1")) & (F.col("_dy0") <= F.col("_y1")) & (F.col("_y0") <= F.col("_dy1"))
        near = oks(F.col("keypoints"), F.col("g"), tuple(F.col(f"g{c}") for c in "xywh"), F.col("gt_area"), chosen, F.col("seen"))
        return dt.join(right, ["image_id", "category_id"]).where(touch).withColumn("iou", near)

    n = len(chosen)
    spread = [(2 * s) ** 2 for s in chosen]

    def columns(df: DataFrame, own: bool) -> dict[str, Column]:
        points = {"k": F.col("keypoints").cast("array<double>")}
        return points if own else {**points, "lacks": F.col("keypoints").isNull(), **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in "xywh"}}

    def wide(k: np.ndarray) -> np.ndarray:
        return k if k.shape[1] >= 3 * n else np.concatenate([k, np.full((len(k), 3 * n - k.shape[1]), np.nan)], axis=1)

    def extent(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        x = points[:, k : 3 * n : 3]
        return np.fmin.reduce(x, axis=1), np.fmax.reduce(x, axis=1)

    def bounds(v: Values, own: bool) -> tuple[np.ndarray, ...]:
        k = wide(v["k"])
        if own:
            (x0, x1), (y0, y1) = extent(k, 0), extent(k, 1)
            return x0, y0, x1, y1
        far = reach * np.sqrt(v["area"] + EPSILON) * 1.001 + 1e-6
        shown = np.where(np.repeat(k[:, 2 : 3 * n : 3] > 0, 3, axis=1), k[:, : 3 * n], np.nan)
        seen = (k[:, 2::3] > 0).any(axis=1)
        (x0, x1), (y0, y1) = extent(shown, 0), extent(shown, 1)
        x0, x1 = np.where(seen, x0, v["x"] - v["w"]), np.where(seen, x1, v["x"] + 2 * v["w"])
        y0, y1 = np.where(seen, y0, v["y"] - v["h"]), np.where(seen, y1, v["y"] + 2 * v["h"])
        return x0 - far, y0 - far, x1 + far, y1 + far

    def similar(d: Values, g: Values, i: np.ndarray, j: np.ndarray, crowd: np.ndarray) -> np.ndarray:
        """``oks`` on arrays, summed in the same order."""
        kd, kg = wide(d["k"]), wide(g["k"])
        visible = (kg[:, 2::3] > 0).sum(axis=1)
        some = visible[j] > 0
        bx, by, bw, bh = (g[c][j] for c in "xywh")
        total, size = np.zeros(len(i)), g["area"][j] + EPSILON
        for k in range(n):
            x, y, gx, gy = kd[i, 3 * k], kd[i, 3 * k + 1], kg[j, 3 * k], kg[j, 3 * k + 1]
            dx = np.where(some, x - gx, np.maximum(0.0, bx - bw - x) + np.maximum(0.0, x - (bx + 2 * bw)))
            dy = np.where(some, y - gy, np.maximum(0.0, by - bh - y) + np.maximum(0.0, y - (by + 2 * bh)))
            term = np.exp(-((dx * dx + dy * dy) / spread[k] / size / 2))
            total += np.where(~some | (kg[j, 3 * k + 2] > 0), term, 0.0)
        return np.where(g["lacks"][j], 0.0, total / np.where(some, visible[j], n))

    pairs.within = Within(columns, bounds, similar, closed=True)
    return pairs


def keypoint_ignored(gt: DataFrame) -> DataFrame:
    """Ground truth with ``ignore``: crowds and rows without labelled keypoints."""
    none = F.coalesce("num_keypoints", F.lit(0)) == 0
    return gt.withColumn("ignore", F.coalesce("iscrowd", F.lit(False)) | none)
