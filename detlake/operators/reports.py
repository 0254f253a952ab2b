"""What summaries, dashboards and browsers show: text lines, result documents, gallery order and chart data."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detlake.operators import metrics
from detlake.operators.analysis import BACKGROUND
from detlake.operators.dataset import Dataset, seeded
from detlake.operators.params import Params
from detlake.operators.ranking import numbered

#: Headline metrics in order of preference; the first four present are shown.
HEADLINES = ("AP", "AP50", "AP75", "AR100", "AR10", "AR1")
#: Gallery filters and orders over fp and fn of an image.
ONLY = {"has_fp": "fp > 0", "has_fn": "fn > 0", "has_errors": "fp + fn > 0", "perfect": "fp = 0 and fn = 0"}
SORT = {"worst": "fp + fn", "most_fp": "fp", "most_fn": "fn"}


def shown(value: float) -> str:
    """Three decimals; -1.000 for any negative value."""
    return f"{-1.0 if value < 0 else value:.3f}"


def summary_lines(values: dict[str, float], params: Params, table=metrics.BOX) -> list[str]:
    """The wide text table of box and keypoint metrics."""
    out = []
    for name, precision, thr, area, m in table:
        cap = params.max_dets[m if len(params.max_dets) >= 3 else -1]
        title = "Average Precision (AP)" if precision else "Average Recall (AR)"
        at = "0.50:0.95" if thr is None else f"{thr:.2f}"
        out.append(f" {title:<22} @[ IoU={at:<9} | area={area:>6} | maxDets={cap:>3} ] = {shown(values[name])}")
    return out


def compact_lines(values: dict[str, float]) -> list[str]:
    return [f" {name:>10} = {shown(v)}" for name, v in values.items()]


def results(values: dict[str, float], params: Params, iou_type: str = "bbox", mode: str = "coco", per_class: dict[str, float] | None = None, version: str = "0.1") -> dict:
    """The results document: parameters, metrics and, where asked for, APs by category name."""
    doc = {
        "version": version,
        "params": {"iou_type": iou_type, "iou_thresholds": list(params.iou_thrs), "area_ranges": {n: [lo, hi] for n, lo, hi in params.areas}, "max_dets": list(params.max_dets), "eval_mode": mode},
        "metrics": dict(values),
    }
    return doc if per_class is None else {**doc, "per_class": dict(per_class)}


def save_results(doc: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2)


def named_aps(per_category: DataFrame, categories: DataFrame, prefix: str | None = None) -> DataFrame:
    """metric, value: AP/name (under a prefix) of every category with ground truth; one without a name is cat_ and its id."""
    head = F.lit(f"{prefix}/AP/" if prefix else "AP/")
    names = categories.select(F.col("id").alias("category_id"), "name")
    return per_category.where("ap >= 0").join(names, "category_id", "left").select(F.concat(head, F.coalesce("name", F.concat(F.lit("cat_"), F.col("category_id").cast("string")))).alias("metric"), F.col("ap").alias("value"))


def headlines(summary: DataFrame) -> DataFrame:
    """position, metric, value of the first four headline metrics present."""
    order = F.array_position(F.array(*map(F.lit, HEADLINES)), F.col("metric"))
    w = Window.orderBy("o")  # a handful of metrics
    return summary.withColumn("o", order).where("o > 0").withColumn("position", F.row_number().over(w)).where("position <= 4").select("position", "metric", "value")


def f1_histogram(diagnostics: DataFrame, n_bins: int = 20) -> DataFrame:
    """profile, bin (0 .. n_bins - 1; 1.0 is in the last), n of per-image F1."""
    number = F.least(F.floor(F.col("f1") * n_bins), F.lit(n_bins - 1)).cast("int")
    return diagnostics.groupBy("profile", number.alias("bin")).agg(F.count("*").alias("n"))


def f1_buckets(diagnostics: DataFrame) -> DataFrame:
    """bucket (low: under 0.5, middle, high: over 0.8), n."""
    bucket = F.when(F.col("f1") < 0.5, "low").when(F.col("f1") > 0.8, "high").otherwise("middle")
    return diagnostics.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def worst_images(diagnostics: DataFrame, n: int = 20) -> DataFrame:
    """The n images of least F1, then id."""
    return diagnostics.orderBy("f1", "image_id").limit(n)


def error_classes(label_errors: DataFrame) -> DataFrame:
    """error, dt_category_id, n of suspected label errors."""
    return label_errors.groupBy("error", "dt_category_id").agg(F.count("*").alias("n"))


def mean_curve(samples: DataFrame, npig: DataFrame, params: Params, t: int = 0) -> DataFrame:
    """r, precision, f1: mean over the categories with ground truth at threshold t; recalls that a category doesn't reach count 0 for it."""
    n_r, last = len(params.rec_thrs), len(params.max_dets) - 1
    grid = npig.where("npig > 0 and a = 0").select("category_id", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("r"))
    at = samples.where((F.col("a") == 0) & (F.col("m") == last) & (F.col("t") == t)).select("category_id", "r", "precision")
    p = grid.join(at, ["category_id", "r"], "left").groupBy("r").agg(F.avg(F.coalesce("precision", F.lit(0.0))).alias("precision"))
    recall = F.col("r") / (n_r - 1)
    return p.withColumn("f1", 2 * F.col("precision") * recall / F.greatest(F.col("precision") + recall, F.lit(1e-8)))


def top_confusions(confusion: DataFrame, n: int = 20) -> DataFrame:
    """The n largest cells off the diagonal, the background's included; by n descending, then ids."""
    off = confusion.where("gt_category_id <> dt_category_id").select("gt_category_id", "dt_category_id", "n")
    return off.orderBy(F.col("n").desc(), "gt_category_id", "dt_category_id").limit(n)


def confused_classes(confusion: DataFrame, n: int = 25) -> DataFrame:
    """category_id, mass of the n categories with most confusions among categories, in either direction; ties by id."""
    off = confusion.where(f"gt_category_id <> dt_category_id and gt_category_id <> {BACKGROUND} and dt_category_id <> {BACKGROUND}")
    both = off.select(F.explode(F.array("gt_category_id", "dt_category_id")).alias("category_id"), "n")
    return both.groupBy("category_id").agg(F.sum("n").alias("mass")).orderBy(F.col("mass").desc(), "category_id").limit(n)


def full_confusion(confusion: DataFrame, categories: DataFrame) -> DataFrame:
    """gt_category_id, dt_category_id, n, share of every cell, the background's and empty ones included."""
    ids = categories.select("id").distinct().unionByName(categories.sparkSession.createDataFrame([(BACKGROUND,)], "id bigint"))
    grid = ids.select(F.col("id").alias("gt_category_id")).crossJoin(ids.select(F.col("id").alias("dt_category_id")))  # the matrix itself
    return grid.join(confusion, ["gt_category_id", "dt_category_id"], "left").fillna(0, ["n"]).fillna(0.0, ["share"])


def confusion_matrix(confusion: DataFrame, categories: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The matrix on the driver, ground truth by row, background last, and the categories' ids in order."""
    ids = sorted(r["id"] for r in categories.select("id").distinct().collect())
    place = {i: k for k, i in enumerate([*ids, BACKGROUND])}
    out = np.zeros((len(place), len(place)), np.int64)
    for r in confusion.select("gt_category_id", "dt_category_id", "n").collect():  # at most a row for each cell
        if r["gt_category_id"] in place and r["dt_category_id"] in place:
            out[place[r["gt_category_id"]], place[r["dt_category_id"]]] = r["n"]
    return out, ids


def arrays(points: DataFrame, npig: DataFrame, params: Params) -> dict[str, np.ndarray]:
    """precision and scores [t, r, category, a, m] and recall [t, category, a, m] on the driver; -1 without ground truth.

    ``points`` is a curve; at most a row for each recall threshold is taken.
    """
    n_t, n_r, n_a, n_m = len(params.iou_thrs), len(params.rec_thrs), len(params.areas), len(params.max_dets)
    known = [(r["category_id"], r["a"]) for r in npig.where("npig > 0").select("category_id", "a").collect()]
    ids = sorted(r["category_id"] for r in npig.select("category_id").distinct().collect())
    place = {c: k for k, c in enumerate(ids)}
    precision = np.full((n_t, n_r, len(ids), n_a, n_m), -1.0)
    scores, recall = precision.copy(), np.full((n_t, len(ids), n_a, n_m), -1.0)
    for c, a in known:
        precision[:, :, place[c], a] = scores[:, :, place[c], a] = recall[:, place[c], a] = 0.0
    for r in points.select("category_id", "a", "m", "t", "recall", "precision", "score", "low", "high").collect():
        k, a, m, t = place[r["category_id"]], r["a"], r["m"], r["t"]
        precision[t, r["low"] : r["high"], k, a, m], scores[t, r["low"] : r["high"], k, a, m] = r["precision"], r["score"]
        recall[t, k, a, m] = max(recall[t, k, a, m], r["recall"])
    return {"precision": precision, "scores": scores, "recall": recall, "category_ids": np.array(ids)}


def rolled_up(confusion: DataFrame, categories: DataFrame) -> DataFrame:
    """gt_group, dt_group, n: the confusion matrix by supercategory (the name where there is none; ``background``)."""
    group = F.when(F.coalesce("supercategory", F.lit("")) == "", F.col("name")).otherwise(F.col("supercategory"))
    names = categories.select("id", group.alias("g"))
    out = confusion
    for side in ("gt", "dt"):
        out = out.join(names.select(F.col("id").alias(f"{side}_category_id"), F.col("g").alias(f"_{side}")), f"{side}_category_id", "left")
        known = F.coalesce(f"_{side}", F.col(f"{side}_category_id").cast("string"))
        out = out.withColumn(f"{side}_group", F.when(F.col(f"{side}_category_id") == BACKGROUND, "background").otherwise(known))
    return out.groupBy("gt_group", "dt_group").agg(F.sum("n").alias("n"))


def report_counts(d: Dataset, dt: DataFrame) -> DataFrame:
    """category_id, name, n_annotations, n_images, n_detections."""
    n = dt.groupBy("category_id").agg(F.count("*").alias("n_detections"))
    return d.category_stats().join(n, "category_id", "left").select("category_id", "name", "n_annotations", "n_images", F.coalesce("n_detections", F.lit(0)).cast("bigint").alias("n_detections"))


def gallery(d: Dataset, diagnostics: DataFrame | None = None, names: list[str] | None = None, images: DataFrame | None = None, only: str | None = None, sort: str | None = None, seed: int | None = None) -> DataFrame:
    """image_id, position, prev_id, next_id of the images to show.

    images (image_id) is a slice. Unknown names are passed over; if none is
    known, names don't filter. only and sort need diagnostics, in which an
    absent image has no errors. A seed shuffles and overrides sort.
    Positions come from a distributed ranking, and neighbours from a join on them.
    """
    rows = d.images.select("id").distinct()
    if images is not None:
        rows = rows.join(images.select(F.col("image_id").alias("id")), "id", "left_semi")
    wanted = [r[0] for r in d.categories.where(F.col("name").isin(*names)).select("id").collect()] if names else []
    if wanted:
        rows = rows.join(d.annotations.where(F.col("category_id").isin(*wanted)).select(F.col("image_id").alias("id")), "id", "left_semi")
    if diagnostics is not None:
        rows = rows.join(diagnostics.select(F.col("image_id").alias("id"), "fp", "fn"), "id", "left").fillna(0, ["fp", "fn"])
        if only and only != "none":
            rows = rows.where(ONLY[only])
    key = F.col("id")
    if seed is not None:
        key = seeded(seed)
    elif diagnostics is not None and sort and sort != "default":
        top = rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        key = F.col("id") - F.expr(SORT[sort]).cast("bigint") * (top + 1)  # ids spread images of equal errors over ranges
    placed = numbered(rows, key).select("id", "number")
    beside = lambda step, name: placed.select(F.col("id").alias(name), (F.col("number") + step).alias("number"))
    both = placed.join(beside(1, "prev_id"), "number", "left").join(beside(-1, "next_id"), "number", "left")
    return both.select(F.col("id").alias("image_id"), F.col("number").alias("position"), "prev_id", "next_id")


def image_view(d: Dataset, dt: DataFrame | None = None, status: tuple[DataFrame, DataFrame] | None = None, score_thr: float = 0.0) -> DataFrame:
    """What is drawn on each image: image_id, position (from 1), source, id, category, box, score, status, matched_id.

    Ground truth first, then by score descending, category and id. Detections
    under score_thr (without a score: 1) and unknown categories are left out.
    status is that of ``analysis.statuses``; ignored rows have none.
    """
    names = d.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    none = lambda t: F.lit(None).cast(t)
    gt = d.annotations.select("image_id", "category_id", "id", *"xywh", none("double").alias("score"))
    if status is not None:
        partner = status[0].where("is_tp").select("image_id", F.col("gt_id").alias("id"), F.col("dt_id").alias("matched_id"))
        known = status[1].select("image_id", "id", F.when(F.col("is_matched"), "tp").otherwise("fn").alias("status"))
        gt = gt.join(known, ["image_id", "id"], "left").join(partner, ["image_id", "id"], "left")
    else:
        gt = gt.withColumn("status", none("string")).withColumn("matched_id", none("bigint"))
    columns = ["image_id", "category_id", "id", *"xywh", "score", "status", "matched_id"]
    rows = gt.select(F.lit("gt").alias("source"), *columns)
    if dt is not None:
        det = dt.where(F.coalesce("score", F.lit(1.0)) >= score_thr).select("image_id", "category_id", "id", *"xywh", "score")
        if status is not None:
            known = status[0].select("image_id", F.col("dt_id").alias("id"), F.when(F.col("is_tp"), "tp").otherwise("fp").alias("status"), F.when(F.col("is_tp"), F.col("gt_id")).alias("matched_id"))
            det = det.join(known, ["image_id", "id"], "left")
        else:
            det = det.withColumn("status", none("string")).withColumn("matched_id", none("bigint"))
        rows = rows.unionByName(det.select(F.lit("dt").alias("source"), *columns))
    order = Window.partitionBy("image_id").orderBy(F.col("source").desc(), F.coalesce("score", F.lit(0.0)).desc(), "category", "id")
    placed = rows.join(names, "category_id").withColumn("position", F.row_number().over(order))
    return placed.select("image_id", "position", "source", "id", "category", *"xywh", F.round("score", 4).alias("score"), "status", "matched_id")
