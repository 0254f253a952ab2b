"""Queries of the detection engine over the derived scene, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.operators import analysis, curve, metrics, reports, similarity
from detlake.operators.dataset import Dataset, detection_health, health, health_summary, merge, near_duplicates
from detlake.operators.hierarchy import Hierarchy, expand
from detlake.operators.matching import evaluate, npig, packed, total
from detlake.operators.params import Params
from detlake.scene import scene
from detlake.sources import coco_json, formats

P = Params()
#: For queries whose SQL counterpart is costly: all categories and images, one threshold and area.
ONE = Params(iou_thrs=(0.5,), areas=(("all", 0.0, 1e10),), max_dets=(100,))


def dataset(spark: SparkSession, sf_dir: str) -> tuple[Dataset, DataFrame]:
    s = scene(spark, sf_dir)
    return Dataset(s["imgs"], s["gt"], s["cats"]), s["dt"]


def _evaluated(spark, sf_dir, params=P):
    s = scene(spark, sf_dir)
    rows, counts = evaluate(s["gt"], s["dt"], params)
    return s, rows, counts


def _curve(spark, sf_dir, params=P):
    s = scene(spark, sf_dir)
    n = npig(s["gt"], params)
    return curve.curve(packed(s["gt"], s["dt"], params), n, params), n


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 8).alias(c) if c in columns else c for c in df.columns))


def det_summary(spark, sf_dir):
    points, n = _curve(spark, sf_dir)
    return _rounded(metrics.summary(curve.cells(points, n, P), P), "value")


def det_pooled_summary(spark, sf_dir):
    p = Params(iou_thrs=P.iou_thrs[:1], use_cats=False)
    points, n = _curve(spark, sf_dir, p)
    return _rounded(metrics.summary(curve.cells(points, n, p), p, metrics.BOX[:2]), "value")


def det_per_category(spark, sf_dir):
    points, n = _curve(spark, sf_dir)
    return _rounded(metrics.per_category(curve.cells(points, n, P), P), "ap")


def det_pr_samples(spark, sf_dir):
    points, _ = _curve(spark, sf_dir)
    got = curve.samples(points, P).where("a = 0 and m = 2").select("category_id", "t", "r", "precision", "score")
    return _rounded(got, "precision", "score")


def det_f_scores(spark, sf_dir):
    points, n = _curve(spark, sf_dir)
    return _rounded(metrics.f_scores(points, n, P), "value")


def det_matches(spark, sf_dir):
    _, rows, _ = _evaluated(spark, sf_dir)
    each = rows.select("image_id", "category_id", "a", "dt_id", F.posexplode(F.arrays_zip("gt", "matched", "ignored")).alias("t", "x"))
    return each.groupBy("category_id", "a", "t").agg(F.count_if("x.matched").alias("n_matched"), F.count_if("x.ignored").alias("n_ignored"), F.sum(F.coalesce("x.gt", F.lit(0))).alias("gt_sum"))


def det_pairs(spark, sf_dir):
    from detlake.operators.matching import box_pairs, ranked

    s = scene(spark, sf_dir)
    pairs = box_pairs(ranked(s["dt"], P), s["gt"])
    return pairs.groupBy("category_id").agg(F.count("*").alias("n"), F.count_if(F.col("iou") >= 0.5).alias("n_half"), F.sum(F.floor(F.col("iou") * 1000000)).cast("bigint").alias("checksum"))


def det_confusion(spark, sf_dir):
    s = scene(spark, sf_dir)
    return _rounded(analysis.confusion(s["gt"], s["dt"]), "share")


def det_calibration(spark, sf_dir):
    _, rows, _ = _evaluated(spark, sf_dir, ONE)
    return _rounded(analysis.calibration(rows, ONE), "confidence", "accuracy")


def det_calibration_errors(spark, sf_dir):
    _, rows, _ = _evaluated(spark, sf_dir, ONE)
    return _rounded(analysis.calibration_errors(analysis.calibration(rows, ONE, by_category=True)), "ece", "mce")


def det_error_types(spark, sf_dir):
    s, rows, counts = _evaluated(spark, sf_dir, ONE)
    typed, missed = analysis.error_types(s["gt"], s["dt"], rows, ONE)
    return _rounded(analysis.error_deltas(typed, missed, total(counts)), "delta_ap")


def det_image_diagnostics(spark, sf_dir):
    s, rows, _ = _evaluated(spark, sf_dir, ONE)
    return _rounded(analysis.image_diagnostics(*analysis.statuses(rows, s["gt"], ONE)), "f1", "ap")


def det_label_errors(spark, sf_dir):
    s, rows, _ = _evaluated(spark, sf_dir, ONE)
    got = analysis.label_errors(s["dt"], *analysis.statuses(rows, s["gt"], ONE))
    return _rounded(got.fillna(-1, ["gt_id", "gt_category_id"]), "score", "iou")


def det_slices(spark, sf_dir):
    s, rows, counts = _evaluated(spark, sf_dir, ONE)
    slices = s["imgs"].select(F.concat(F.lit("s"), F.col("id") % 3).alias("slice"), F.col("id").alias("image_id"))
    return _rounded(analysis.sliced(rows, counts, slices, ONE, metrics.BOX[:2]), "value", "delta")


def det_compare(spark, sf_dir):
    s = scene(spark, sf_dir)
    return _rounded(analysis.compare(s["gt"], s["dt"], s["dt_b"], ONE, table=metrics.BOX[:2]), "a", "b", "delta")


def det_bootstrap(spark, sf_dir):
    s = scene(spark, sf_dir)
    got = analysis.compare(s["gt"], s["dt"], s["dt_b"], ONE, n_bootstrap=5, table=metrics.BOX[:1])
    return _rounded(got, "a", "b", "delta", "lower", "upper", "prob_positive", "std_err")


def det_federated(spark, sf_dir):
    s = scene(spark, sf_dir)
    images = s["imgs"].select("id", F.array(1 + F.col("id") % 4).alias("neg_category_ids"), F.array(1 + (F.col("id") + 1) % 4).alias("not_exhaustive_category_ids"))
    rows, _ = analysis.federated(s["gt"], s["dt"], images, ONE)
    n = npig(s["gt"], ONE).persist()  # a row for each category, read twice
    return _rounded(metrics.per_category(curve.cells(curve.curve(rows, n, ONE), n, ONE), ONE), "ap")


def det_open_images(spark, sf_dir):
    s = scene(spark, sf_dir)
    gt = s["gt"].withColumn("is_group_of", F.col("id") % 31 == 0)
    rows, _ = analysis.open_images(gt, s["dt"], ONE)
    n = npig(gt.where("not is_group_of").withColumn("iscrowd", F.lit(False)), ONE)
    return rows.groupBy("category_id").agg(F.count_if(F.col("matched")[0]).alias("n_matched"), F.count("*").alias("n")).join(n.select("category_id", "npig"), "category_id")


def det_hierarchy(spark, sf_dir):
    s = scene(spark, sf_dir)
    got = expand(s["gt"], Hierarchy({1: 5, 2: 5, 3: 6, 4: 6, 5: 7, 6: 7}))
    return got.groupBy("category_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def _aps(gt, dt, params, pairs, table):
    n = npig(gt, params)
    return _rounded(metrics.summary(curve.cells(curve.curve(packed(gt, dt, params, pairs), n, params), n, params), params, table), "value")


def det_masks(spark, sf_dir):
    """Polygons where a box with an even id lies inside the image, boxes as masks elsewhere."""
    s = scene(spark, sf_dir)
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    inside = (F.col("id") % 2 == 0) & (F.col("x") >= 0) & (F.col("y") >= 0) & (x2 <= 680) & (y2 <= 500)
    polygon = F.to_json(F.array(F.array("x", "y", x2, "y", x2, y2, "x", y2)))
    gt, dt = (similarity.with_masks(s[k].withColumn("segmentation", F.when(inside, polygon)), s["imgs"], lean=True) for k in ("gt", "dt"))
    return _aps(gt, dt.withColumn("area", F.col("mask.area").cast("double")), P, similarity.mask_pairs, metrics.BOX)


def _points(df: DataFrame) -> DataFrame:
    """17 keypoints spread over the box; every seventh id has none visible."""
    at = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.array(F.col("x") + (i * 7) % F.col("w"), F.col("y") + (i * 5) % F.col("h"), F.when(F.col("id") % 7 == 0, 0).otherwise((F.col("id") + i) % 3).cast("double")))
    return df.withColumn("keypoints", F.flatten(at)).withColumn("num_keypoints", F.size(F.filter("keypoints", lambda v, j: (j % 3 == 2) & (v > 0))))


def det_keypoints(spark, sf_dir):
    s = scene(spark, sf_dir)
    return _aps(similarity.keypoint_ignored(_points(s["gt"])), _points(s["dt"]), Params.keypoints(), similarity.keypoint_pairs(), metrics.KEYPOINTS)


def det_rotated(spark, sf_dir):
    s = scene(spark, sf_dir)
    turn = lambda df: df.withColumn("obb", F.array(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, "w", "h", (F.col("id") % 1000 % 12) * F.lit(0.2617993877991494)))
    return _aps(turn(s["gt"]), turn(s["dt"]), P, similarity.rotated_pairs, metrics.BOX)


def det_frequency(spark, sf_dir):
    s = scene(spark, sf_dir)
    points, n = _curve(spark, sf_dir, ONE)
    cats = s["cats"].withColumn("frequency", F.element_at(F.array(F.lit("r"), F.lit("c"), F.lit("f"), F.lit("f")), F.col("id").cast("int")))
    return _rounded(analysis.frequency_ap(curve.cells(points, n, ONE), cats, ONE), "value")


def det_headlines(spark, sf_dir):
    return reports.headlines(det_summary(spark, sf_dir))


def det_named_aps(spark, sf_dir):
    return reports.named_aps(det_per_category(spark, sf_dir), scene(spark, sf_dir)["cats"], "val")


def _diagnosed(spark, sf_dir):
    s, rows, _ = _evaluated(spark, sf_dir, ONE)
    status = analysis.statuses(rows, s["gt"], ONE)
    return s, status, analysis.image_diagnostics(*status)


def det_f1_histogram(spark, sf_dir):
    return reports.f1_histogram(_diagnosed(spark, sf_dir)[2])


def det_f1_buckets(spark, sf_dir):
    return reports.f1_buckets(_diagnosed(spark, sf_dir)[2])


def det_worst_images(spark, sf_dir):
    return _rounded(reports.worst_images(_diagnosed(spark, sf_dir)[2]), "f1", "ap")


def det_error_classes(spark, sf_dir):
    return reports.error_classes(det_label_errors(spark, sf_dir))


def det_mean_curve(spark, sf_dir):
    points, n = _curve(spark, sf_dir, ONE)
    return _rounded(reports.mean_curve(curve.samples(points, ONE), n, ONE), "precision", "f1")


def det_top_confusions(spark, sf_dir):
    return reports.top_confusions(det_confusion(spark, sf_dir), 6)


def det_rolled_confusion(spark, sf_dir):
    return reports.rolled_up(det_confusion(spark, sf_dir), scene(spark, sf_dir)["cats"])


def det_report_counts(spark, sf_dir):
    d, dt = dataset(spark, sf_dir)
    return reports.report_counts(d, dt)


def det_gallery(spark, sf_dir):
    """Images of a slice with errors, most errors first."""
    s, _, found = _diagnosed(spark, sf_dir)
    d = Dataset(s["imgs"], s["gt"], s["cats"])
    chosen = s["imgs"].where("id % 2 = 0").select(F.col("id").alias("image_id"))
    return reports.gallery(d, found, ["cat1", "cat3", "no such name"], chosen, "has_errors", "worst").na.fill(-1, ["prev_id", "next_id"])


def det_image_view(spark, sf_dir):
    s, status, _ = _diagnosed(spark, sf_dir)
    got = reports.image_view(Dataset(s["imgs"], s["gt"], s["cats"]), s["dt"], status, 0.3)
    return got.select("image_id", "position", "source", "id", "category", F.coalesce("score", F.lit(-1.0)).alias("score"), F.coalesce("status", F.lit("none")).alias("status"), F.coalesce("matched_id", F.lit(-1)).alias("matched_id"))


def _named(spark, sf_dir) -> Dataset:
    d, _ = dataset(spark, sf_dir)
    return Dataset(d.images.withColumn("file_name", F.concat(F.lit("im"), F.col("id").cast("string"), F.lit(".jpg"))), d.annotations, d.categories)


def snk_yolo(spark, sf_dir):
    return formats.yolo_rows(_named(spark, sf_dir))


def snk_voc(spark, sf_dir):
    return formats.voc_rows(_named(spark, sf_dir))


def snk_cvat(spark, sf_dir):
    return formats.cvat_rows(_named(spark, sf_dir))


def src_yolo(spark, sf_dir):
    """Label files written and read again: boxes to a hundredth of a pixel, crowds left out."""
    d = _named(spark, sf_dir)
    files = formats.yolo_rows(d)
    lines = files.select("stem", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    got = formats.yolo_boxes(lines, d.images.withColumn("stem", F.regexp_extract("file_name", "([^.]*)", 1)), 4)
    return got.select("image_id", "line", "category_id", *((F.round(c, 2) + 0.0).alias(c) for c in "xywh"))


def src_json(spark, sf_dir):
    """Annotations written as JSON and read again."""
    text = coco_json.elements(dataset(spark, sf_dir)[0])["annotations"]
    rows = coco_json.normalised(text.select(F.from_json("value", coco_json.ANNOTATION).alias("r")).select("r.*"))
    return rows.select("id", "image_id", "category_id", *"xywh", "area", F.col("iscrowd").cast("int").alias("iscrowd"))


def ds_stats(spark, sf_dir):
    d, _ = dataset(spark, sf_dir)
    return _rounded(d.stats(), "value")


def ds_category_stats(spark, sf_dir):
    return dataset(spark, sf_dir)[0].category_stats()


def ds_tree(spark, sf_dir):
    return dataset(spark, sf_dir)[0].tree().select("supercategory", F.array_join("names", ",").alias("names"))


def ds_ann_ids(spark, sf_dir):
    return dataset(spark, sf_dir)[0].ann_ids(cat_ids=[1, 3], area_rng=(1024, 9216), iscrowd=False)


def ds_filter(spark, sf_dir):
    d = dataset(spark, sf_dir)[0].filter(cat_ids=[2], area_rng=(0, 4000))
    return d.annotations.groupBy("image_id").agg(F.count("*").alias("n")).join(d.images.select(F.col("id").alias("image_id")), "image_id")


def ds_split(spark, sf_dir):
    parts = dataset(spark, sf_dir)[0].split(0.2, 0.1)
    out = None
    for name, d in parts.items():
        one = d.images.select(F.lit(name).alias("part"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def ds_sample(spark, sf_dir):
    return dataset(spark, sf_dir)[0].sample(frac=0.3).images.select("id")


def ds_merge(spark, sf_dir):
    d, _ = dataset(spark, sf_dir)
    m = merge([d, d.filter(cat_ids=[1, 2, 3, 4], drop_empty_images=False)])
    return m.annotations.groupBy("category_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.sum("image_id").alias("image_sum"))


def ds_health(spark, sf_dir):
    return health(dataset(spark, sf_dir)[0])


def ds_health_summary(spark, sf_dir):
    return _rounded(health_summary(dataset(spark, sf_dir)[0]), "value")


def ds_detection_health(spark, sf_dir):
    d, dt = dataset(spark, sf_dir)
    return detection_health(dt.withColumn("score", F.when(F.col("id") % 101 == 0, None).when(F.col("id") % 103 == 0, 1.5).otherwise(F.col("score"))), d.filter(cat_ids=[1, 2, 3]))


def ds_near_duplicates(spark, sf_dir):
    return near_duplicates(dataset(spark, sf_dir)[0].annotations, thr=0.85)


_ALL = [det_summary, det_pooled_summary, det_per_category, det_pr_samples, det_f_scores, det_matches, det_pairs, det_confusion, det_calibration, det_calibration_errors, det_error_types, det_image_diagnostics, det_label_errors, det_slices, det_compare, det_bootstrap, det_federated, det_open_images, det_hierarchy, det_masks, det_keypoints, det_rotated, det_frequency, det_headlines, det_named_aps, det_f1_histogram, det_f1_buckets, det_worst_images, det_error_classes, det_mean_curve, det_top_confusions, det_rolled_confusion, det_report_counts, det_gallery, det_image_view, snk_yolo, snk_voc, snk_cvat, src_yolo, src_json, ds_stats, ds_category_stats, ds_tree, ds_ann_ids, ds_filter, ds_split, ds_sample, ds_merge, ds_health, ds_health_summary, ds_detection_health, ds_near_duplicates]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
