"""Summary metrics from the cells of the precision-recall grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.operators.params import Params

#: name, average precision (or recall), threshold, area label, max_det entry.
BOX = (("AP", True, None, "all", -1), ("AP50", True, 0.5, "all", -1), ("AP75", True, 0.75, "all", -1), ("APs", True, None, "small", -1), ("APm", True, None, "medium", -1), ("APl", True, None, "large", -1), ("AR1", False, None, "all", 0), ("AR10", False, None, "all", 1), ("AR100", False, None, "all", -1), ("ARs", False, None, "small", -1), ("ARm", False, None, "medium", -1), ("ARl", False, None, "large", -1))
KEYPOINTS = (("AP", True, None, "all", -1), ("AP50", True, 0.5, "all", -1), ("AP75", True, 0.75, "all", -1), ("APm", True, None, "medium", -1), ("APl", True, None, "large", -1), ("AR", False, None, "all", -1), ("AR50", False, 0.5, "all", -1), ("AR75", False, 0.75, "all", -1), ("ARm", False, None, "medium", -1), ("ARl", False, None, "large", -1))
#: Tables of the federated mode (with APr, APc and APf from ``analysis.frequency_ap`` after the sizes) and the group-of mode.
FEDERATED = (*BOX[:6], ("AR@300", False, None, "all", -1), ("ARs@300", False, None, "small", -1), ("ARm@300", False, None, "medium", -1), ("ARl@300", False, None, "large", -1))
OPEN_IMAGES = (("AP", True, 0.5, "all", -1),)
#: The federated metrics in the order in which they are shown.
FEDERATED_ORDER = ("AP", "AP50", "AP75", "APs", "APm", "APl", "APr", "APc", "APf", "AR@300", "ARs@300", "ARm@300", "ARl@300")


def summary(cells: DataFrame, params: Params, table=BOX, keys: tuple[str, ...] = ()) -> DataFrame:
    """metric, value: means over the cells that have ground truth; -1 where there is none. Decimals: sums don't hang on the order of rows."""
    labels = [x for x, _, _ in params.areas]
    columns = []
    for name, precision, thr, area, m in table:
        a = labels.index(area) if area in labels else 0
        m = (m if len(params.max_dets) >= 3 else -1) % len(params.max_dets)
        cond = (F.col("a") == a) & (F.col("m") == m)
        if thr is not None:
            near = [i for i, x in enumerate(params.iou_thrs) if abs(x - thr) < 1e-9]
            cond = cond & (F.col("t") == (near[0] if near else -1))
        columns.append(F.coalesce(F.avg(F.when(cond, F.col("ap" if precision else "recall").cast("decimal(28,20)"))).cast("double"), F.lit(-1.0)).alias(name))
    wide = cells.groupBy(*keys).agg(*columns) if keys else cells.agg(*columns)
    return wide.select(*keys, F.explode(F.map_from_arrays(F.array(*(F.lit(t[0]) for t in table)), F.array(*(F.col(t[0]) for t in table)))).alias("metric", "value"))


def per_category(cells: DataFrame, params: Params) -> DataFrame:
    """category_id, ap: mean over thresholds in the first area range at the last max_det."""
    return cells.where((F.col("a") == 0) & (F.col("m") == len(params.max_dets) - 1)).groupBy("category_id").agg(F.avg("ap").alias("ap"))


def f_scores(points: DataFrame, npig: DataFrame, params: Params, beta: float = 1.0) -> DataFrame:
    """metric, value: best F over recall thresholds, averaged over thresholds and categories, and at 0.5 and 0.75 (-1 where that is no threshold)."""
    last = len(params.max_dets) - 1
    b = beta * beta
    r = F.col("r") / (len(params.rec_thrs) - 1)
    f = F.when(b * F.col("precision") + r > 0, (1 + b) * F.col("precision") * r / (b * F.col("precision") + r)).otherwise(0.0)
    at = points.where((F.col("a") == 0) & (F.col("m") == last) & (F.col("high") > F.col("low"))).select("category_id", "t", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("r"), "precision")
    best = at.groupBy("category_id", "t").agg(F.max(f).alias("f"))
    grid = npig.where("npig > 0 and a = 0").select("category_id", F.explode(F.sequence(F.lit(0), F.lit(len(params.iou_thrs) - 1))).alias("t"))
    full = grid.join(best, ["category_id", "t"], "left").fillna(0.0, ["f"])
    name = "F1" if abs(beta - 1) < 1e-9 else f"F{beta:.1f}"
    near = lambda thr: next((i for i, x in enumerate(params.iou_thrs) if abs(x - thr) < 1e-9), -1)
    pick = {name: None, f"{name}50": near(0.5), f"{name}75": near(0.75)}
    wide = full.agg(*(F.coalesce(F.avg(F.col("f") if t is None else F.when(F.col("t") == t, F.col("f"))), F.lit(-1.0)).alias(k) for k, t in pick.items()))
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, pick)), F.array(*(F.col(f"`{k}`") for k in pick)))).alias("metric", "value"))
