"""One evaluation of detections against a dataset, with its metrics and analyses as methods.

    e = Evaluation(dataset, detections, "segm").run()
    e.summary(), e.per_category(), e.confusion(), ...

Everything but ``metrics`` and the text and document forms stays a DataFrame.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.operators import analysis, curve, metrics, reports, similarity
from detlake.operators.dataset import Dataset
from detlake.operators.hierarchy import Hierarchy, expand
from detlake.operators.matching import box_pairs, evaluate, total
from detlake.operators.params import Params

KINDS = ("bbox", "segm", "keypoints", "obb")


class Evaluation:
    """kind is bbox, segm, keypoints or obb; mode is coco, federated or open_images.

    img_ids and cat_ids restrict what is evaluated. In open_images mode a
    hierarchy expands ground truth (and detections with expand_dt).
    """

    def __init__(self, dataset: Dataset, dt: DataFrame, kind: str = "bbox", mode: str = "coco", params: Params | None = None, img_ids=None, cat_ids=None, hierarchy: Hierarchy | None = None, expand_dt: bool = False, sigmas: list[float] | None = None):
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
        defaults = {"coco": Params.keypoints if kind == "keypoints" else Params, "federated": Params.federated, "open_images": Params.open_images}
        if mode not in defaults:
            raise ValueError(f"{mode} is none of {', '.join(defaults)}")
        self.dataset, self.kind, self.mode, self.params = dataset, kind, mode, params or defaults[mode]()
        gt = dataset.annotations
        if mode == "open_images" and hierarchy is not None:
            gt, dt = expand(gt, hierarchy), expand(dt, hierarchy) if expand_dt else dt
        known = dataset.categories.select(F.col("id").alias("category_id"))
        if hierarchy is not None:
            made = [(i,) for i in {*hierarchy.parents, *hierarchy.parents.values()}]
            known = known.unionByName(dt.sparkSession.createDataFrame(made, "category_id bigint")) if made else known
        known = known.distinct()
        for column, values in (("image_id", img_ids), ("category_id", cat_ids)):
            if values:
                gt, dt = (x.where(F.col(column).isin(*values)) for x in (gt, dt))
        gt, dt = (x.join(known, "category_id", "left_semi") for x in (gt, dt))
        self.gt, self.dt, self.pairs = gt, dt, box_pairs
        if kind == "segm":
            self.gt, self.dt = (similarity.with_masks(x, dataset.images) for x in (gt, dt))
            self.pairs = similarity.mask_pairs
        elif kind == "keypoints":
            self.gt, self.pairs = similarity.keypoint_ignored(gt), similarity.keypoint_pairs(sigmas)
        elif kind == "obb":
            self.pairs = similarity.rotated_pairs

    @property
    def table(self):
        if self.mode == "coco":
            return metrics.KEYPOINTS if self.kind == "keypoints" else metrics.BOX
        return metrics.FEDERATED if self.mode == "federated" else metrics.OPEN_IMAGES

    def run(self) -> Evaluation:
        """Matches detections and keeps the matches for what follows (memory, then disk; they can be made again)."""
        if self.mode == "federated":
            rows, counts = analysis.federated(self.gt, self.dt, self.dataset.images, self.params, self.pairs)
        elif self.mode == "open_images":
            rows, counts = analysis.open_images(self.gt, self.dt, self.params, self.pairs)
        else:
            rows, counts = evaluate(self.gt, self.dt, self.params, self.pairs)
        self._rows, self._counts = rows.persist(StorageLevel.MEMORY_AND_DISK), counts.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def close(self) -> None:
        self.matches.unpersist()
        self.counts.unpersist()

    def _done(self, name: str) -> DataFrame:
        if not hasattr(self, name):
            raise RuntimeError("run() comes first")
        return getattr(self, name)

    @property
    def matches(self) -> DataFrame:
        """A row per detection and area range: gt, matched and ignored over thresholds."""
        return self._done("_rows")

    @property
    def counts(self) -> DataFrame:
        return self._done("_counts")

    @cached_property
    def npig(self) -> DataFrame:
        return total(self.counts)

    @cached_property
    def points(self) -> DataFrame:
        return curve.curve(self.matches, self.npig, self.params, bounds=curve.score_bounds(self.matches))

    @cached_property
    def cells(self) -> DataFrame:
        return curve.cells(self.points, self.npig, self.params)

    def samples(self) -> DataFrame:
        """Precision and score at every recall threshold that is reached."""
        return curve.samples(self.points, self.params)

    def summary(self) -> DataFrame:
        """metric, value."""
        got = metrics.summary(self.cells, self.params, self.table)
        if self.mode == "federated" and "frequency" in self.dataset.categories.columns:
            got = got.unionByName(analysis.frequency_ap(self.cells, self.dataset.categories, self.params))
        return got

    @cached_property
    def metrics(self) -> dict[str, float]:
        """The summary on the driver, in the order of display."""
        got = {r["metric"]: r["value"] for r in self.summary().collect()}
        names = metrics.FEDERATED_ORDER if self.mode == "federated" else [t[0] for t in self.table]
        return {n: got[n] for n in names if n in got}

    def lines(self) -> list[str]:
        wide = self.mode == "coco"
        return reports.summary_lines(self.metrics, self.params, self.table) if wide else reports.compact_lines(self.metrics)

    def per_category(self) -> DataFrame:
        return metrics.per_category(self.cells, self.params)

    def named_aps(self, prefix: str | None = None) -> DataFrame:
        return reports.named_aps(self.per_category(), self.dataset.categories, prefix)

    def results(self, per_class: bool = False) -> dict:
        aps = {r["metric"].removeprefix("AP/"): r["value"] for r in self.named_aps().collect()} if per_class else None
        return reports.results(self.metrics, self.params, self.kind, self.mode, aps)

    def save_results(self, path: str, per_class: bool = False) -> None:
        reports.save_results(self.results(per_class), path)

    def f_scores(self, beta: float = 1.0) -> DataFrame:
        return metrics.f_scores(self.points, self.npig, self.params, beta)

    def confusion(self, iou_thr: float = 0.5, max_det: int | None = None, min_score: float | None = None) -> DataFrame:
        """By boxes, whatever the kind."""
        return analysis.confusion(self.gt, self.dt, iou_thr, max_det or self.params.max_dets[-1], min_score)

    def error_types(self, pos_thr: float = 0.5, bg_thr: float = 0.1) -> DataFrame:
        """By boxes, whatever the kind."""
        typed, missed = analysis.error_types(self.gt, self.dt, self.matches, self.params, pos_thr, bg_thr)
        return analysis.error_deltas(typed, missed, self.npig)

    def calibration(self, n_bins: int = 10, iou_threshold: float = 0.5, by_category: bool = False) -> DataFrame:
        return analysis.calibration(self.matches, self.params, n_bins, iou_threshold, by_category)

    def calibration_errors(self, n_bins: int = 10, iou_threshold: float = 0.5, by_category: bool = False) -> DataFrame:
        return analysis.calibration_errors(self.calibration(n_bins, iou_threshold, by_category))

    def _slices(self, slices) -> DataFrame:
        if callable(slices):
            named = self.dataset.images.select(slices(self.dataset.images).alias("slice"), F.col("id").alias("image_id"))
            return named.where("slice is not null")
        return slice_rows(self.gt.sparkSession, slices) if isinstance(slices, dict) else slices

    def sliced(self, slices) -> DataFrame:
        """slices: slice and image_id, image ids by slice name, or a function of images that gives the column of slice names (null: none)."""
        return analysis.sliced(self.matches, self.counts, self._slices(slices), self.params, self.table)

    def slice_sizes(self, slices) -> DataFrame:
        """slice, num_images of the same slices, and of all images as _overall."""
        return analysis.slice_sizes(self._slices(slices), self.dataset.images.select(F.col("id").alias("image_id")))

    def confusion_matrix(self, iou_thr: float = 0.5, max_det: int | None = None, min_score: float | None = None):
        """The whole matrix on the driver with the background last, and the categories' ids."""
        return reports.confusion_matrix(self.confusion(iou_thr, max_det, min_score), self.dataset.categories)

    def arrays(self) -> dict:
        """precision, scores and recall as dense arrays on the driver, and ``stats``, the summary in order."""
        return {**reports.arrays(self.points, self.npig, self.params), "stats": list(self.metrics.values())}

    def statuses(self, iou_thr: float = 0.5) -> tuple[DataFrame, DataFrame]:
        return analysis.statuses(self.matches, self.gt, self.params, iou_thr)

    def image_diagnostics(self, iou_thr: float = 0.5) -> DataFrame:
        return analysis.image_diagnostics(*self.statuses(iou_thr))

    def label_errors(self, iou_thr: float = 0.5, score_thr: float = 0.5) -> DataFrame:
        return analysis.label_errors(self.dt, *self.statuses(iou_thr), score_thr)

    def image_view(self, iou_thr: float = 0.5, score_thr: float = 0.0) -> DataFrame:
        return reports.image_view(self.dataset, self.dt, self.statuses(iou_thr), score_thr)

    def compare(self, other: Evaluation, n_bootstrap: int = 0, seed: int = 42, confidence: float = 0.95) -> DataFrame:
        """This evaluation as a, the other one as b, on the images that both have."""
        if (self.kind, self.params) != (other.kind, other.params):
            raise ValueError("the evaluations differ in kind or parameters")
        return analysis.compare(self.gt, self.dt, other.dt, self.params, n_bootstrap, seed, confidence, self.table, self.pairs)

    def compare_categories(self, other: Evaluation) -> DataFrame:
        """category_id, name, ap_a, ap_b, delta, on the images that both have; least delta first."""
        return analysis.compare_categories(self.gt, self.dt, other.dt, self.dataset.categories, self.params, self.pairs).orderBy("delta", "category_id")


def slice_rows(spark: SparkSession, slices: dict[str, list[int]] | str) -> DataFrame:
    """slice, image_id from image ids by slice name, or a JSON file of them."""
    if isinstance(slices, str):
        with open(slices, encoding="utf-8") as f:
            slices = json.load(f)
    rows = [(name, int(i)) for name, ids in slices.items() for i in ids]
    return spark.createDataFrame(rows, "slice string, image_id bigint")
