"""Confusion, calibration, error decomposition, per-image diagnostics, slices and model comparison."""

from __future__ import annotations

from collections import deque

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.functions.geometry import box, box_iou
from detlake.operators import curve, metrics
from detlake.operators.matching import ABSENT, OPEN, Pairs, box_pairs, evaluate, gt_counts, ignored_always, match, packed, pooled, ranked, total
from detlake.operators.params import Params
from detlake.operators.ranking import numbered

#: The background's category id in confusion rows.
BACKGROUND = -1
#: Bootstrap samples whose images are told by one word.
SETS = 60


#: Rows kept for several readers, of the last few calls; older ones are given back.
_kept: deque[DataFrame] = deque()


def _keep(rows: DataFrame) -> DataFrame:
    _kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
    while len(_kept) > 4:
        _kept.popleft().unpersist()
    return rows


def snap(params: Params, thr: float) -> int:
    """Index of the threshold nearest to thr; the first on ties."""
    return min(range(len(params.iou_thrs)), key=lambda i: abs(params.iou_thrs[i] - thr))


def all_pairs(dt: DataFrame, gt: DataFrame) -> DataFrame:
    """Detections with every ground truth of their image that they touch, whatever its category."""
    right = gt.select("image_id", F.col("id").alias("gt_id"), F.col("category_id").alias("gt_category_id"), *(F.col(c).alias(f"g{c}") for c in "xywh"), F.coalesce("iscrowd", F.lit(False)).alias("crowd"), F.coalesce("area", F.lit(0.0)).alias("gt_area"))
    touch = (F.col("x") < F.col("gx") + F.col("gw")) & (F.col("gx") < F.col("x") + F.col("w")) & (F.col("y") < F.col("gy") + F.col("gh")) & (F.col("gy") < F.col("y") + F.col("h"))
    return dt.join(right, "image_id").where(touch)


def confusion(gt: DataFrame, dt: DataFrame, iou_thr: float = 0.5, max_det: int = 100, min_score: float | None = None) -> DataFrame:
    """gt_category_id, dt_category_id, n, share (of the row's sum) of greedy cross-category matches; -1 is the background."""
    gt = gt.where(~F.coalesce("iscrowd", F.lit(False)))
    score = F.coalesce("score", F.lit(0.0))
    if min_score is not None:
        dt = dt.where(score >= min_score)
    dt = dt.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(score.desc(), "category_id", "id"))).where(F.col("rank") <= max_det)
    gt = gt.withColumn("pos", F.row_number().over(Window.partitionBy("image_id").orderBy("category_id", "id")).cast("bigint"))
    pairs = all_pairs(dt, gt.withColumn("id", F.col("pos"))).withColumn("iou", box_iou(box(), box("g"))).withColumn("category_id", F.lit(0).cast("bigint"))
    one = Params(iou_thrs=(iou_thr,), areas=(("all", float("-inf"), float("inf")),), max_dets=(max_det,))
    got = match(pairs, one).select("image_id", "rank", F.col("gt")[0].alias("pos"))
    left = dt.select("image_id", "rank", F.col("category_id").alias("dt_category_id")).join(got, ["image_id", "rank"], "left")
    both = left.join(gt.select("image_id", "pos", F.col("category_id").alias("gt_category_id")), ["image_id", "pos"], "full_outer")
    n = both.groupBy(F.coalesce("gt_category_id", F.lit(BACKGROUND)).alias("gt_category_id"), F.coalesce("dt_category_id", F.lit(BACKGROUND)).alias("dt_category_id")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gt_category_id")))


def calibration(dt_eval: DataFrame, params: Params, n_bins: int = 10, iou_threshold: float = 0.5, by_category: bool = False) -> DataFrame:
    """(category_id,) bin, n, confidence, accuracy of non-ignored detections."""
    near = [i for i, x in enumerate(params.iou_thrs) if abs(x - iou_threshold) < 1e-9]
    if not near:
        raise ValueError(f"{iou_threshold} is none of the evaluated thresholds")
    t = near[0]
    number = F.greatest(F.lit(0), F.least(F.floor(F.col("score") * n_bins), F.lit(n_bins - 1))).cast("int")
    rows = dt_eval.where((F.col("a") == 0) & ~F.col("ignored")[t])
    keys = ["category_id"] if by_category else []
    return rows.groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("matched")[t].cast("double")).alias("accuracy"))


def calibration_errors(bins: DataFrame) -> DataFrame:
    """(category_id,) ece, mce, n of calibration bins."""
    keys = ["category_id"] if "category_id" in bins.columns else []
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.sum("n").alias("n_detections"))


def average_precision(rows: DataFrame, npig: DataFrame, keys: list[str], order: list[str], n_r: int = 101) -> DataFrame:
    """keys, ap of rows with tp and fp (0 or 1), by score descending, then order; recalls over 1 count as reached everywhere. npig: keys and npig."""
    up = Window.partitionBy(*keys).orderBy(F.col("score").desc(), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(F.col("score").asc(), *(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumn("tp_sum", F.sum("tp").over(up)).withColumn("fp_sum", F.sum("fp").over(up))
    p = F.when(F.col("tp_sum") + F.col("fp_sum") == 0, 0.0).otherwise(F.col("tp_sum") / (F.col("tp_sum") + F.col("fp_sum")))
    hits = sums.withColumn("envelope", F.max(p).over(down)).where("tp = 1").join(npig, keys).where("npig > 0")
    low = F.when(F.col("tp_sum") == 1, 0).otherwise(curve.reached((F.col("tp_sum") - 1) / F.col("npig"), n_r))
    high = curve.reached(F.col("tp_sum") / F.col("npig"), n_r)
    ap = hits.groupBy(*keys).agg((F.sum(F.col("envelope") * (high - low)) / n_r).alias("ap"))
    return npig.where("npig > 0").join(ap, keys, "left").fillna(0.0, ["ap"]).select(*keys, "ap")


#: Error type, types whose fix turns a false positive into a true one, and types whose fix drops it.
_SCENARIOS = (("base", (), ()), ("Cls", ("Cls",), ()), ("Loc", ("Loc",), ()), ("Both", (), ("Both",)), ("Dupe", (), ("Dupe",)), ("Bkg", (), ("Bkg",)), ("FP", ("Cls", "Loc"), ("Both", "Dupe", "Bkg")), ("Miss", (), ()))


def error_types(gt: DataFrame, dt: DataFrame, dt_eval: DataFrame, params: Params, pos_thr: float = 0.5, bg_thr: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(detections, missed): each detection's flags and error type (null: none), and per category the missed ground truth."""
    t = snap(params, pos_thr)
    rows = dt_eval.where("a = 0").select("image_id", "category_id", "rank", F.col("dt_id").alias("id"), "score", F.col("matched")[t].alias("matched"), F.col("ignored")[t].alias("ignored"), F.col("gt")[t].alias("gt"))
    rows = _keep(rows)  # matching isn't repeated for each of the joins below
    taken = rows.where("gt is not null").select("image_id", F.col("gt").alias("gt_id"), F.lit(True).alias("taken"))
    wrong = rows.where(~F.col("matched") & ~F.col("ignored")).select("image_id", "id", "category_id")
    boxes = dt.select("image_id", "id", *"xywh").join(wrong, ["image_id", "id"])
    pairs = all_pairs(boxes, gt).join(taken, ["image_id", "gt_id"], "left")
    same = F.col("gt_category_id") == F.col("category_id")
    iou_same, iou_other = box_iou(box(), box("g"), F.col("crowd")), box_iou(box(), box("g"))
    pairs = pairs.where(same | ~F.col("crowd")).withColumn("same", same).withColumn("iou", F.when(same, iou_same).otherwise(iou_other))
    best = lambda c: F.max_by(F.struct("gt_id", "iou"), F.when(c, F.struct("iou", -F.col("gt_id"))))
    found = pairs.groupBy("image_id", "id").agg(best(F.col("same")).alias("s"), best(~F.col("same")).alias("x"), F.max(F.col("same") & (F.col("iou") >= pos_thr) & F.coalesce("taken", F.lit(False))).alias("dupe"))
    s, x = F.coalesce(F.col("s.iou"), F.lit(0.0)), F.coalesce(F.col("x.iou"), F.lit(0.0))
    kind = F.when((s >= bg_thr) & (s <= pos_thr), "Loc").when(x >= pos_thr, "Cls").when(F.coalesce("dupe", F.lit(False)), "Dupe").when(x <= bg_thr, "Bkg").otherwise("Both")
    typed = wrong.select("image_id", "id").join(found, ["image_id", "id"], "left").select("image_id", "id", kind.alias("error"), F.when(kind == "Loc", F.col("s.gt_id")).when(kind == "Cls", F.col("x.gt_id")).alias("covered"))
    typed = _keep(typed)  # read by several aggregates
    out = rows.join(typed, ["image_id", "id"], "left")
    covered = typed.where("covered is not null").select("image_id", F.col("covered").alias("id")).distinct()
    _, lo, hi = params.areas[0]
    countable = gt.where(~ignored_always(gt) & F.coalesce("area", F.lit(0.0)).between(lo, hi)).select("image_id", "id", "category_id")
    free = countable.join(taken.select("image_id", F.col("gt_id").alias("id")), ["image_id", "id"], "left_anti").join(covered, ["image_id", "id"], "left_anti")
    return out, free.groupBy("category_id").agg(F.count("*").alias("missed"))


def error_deltas(typed: DataFrame, missed: DataFrame, npig: DataFrame) -> DataFrame:
    """error, n, delta_ap: what fixing each error type would add to AP, averaged over categories; base has the AP itself.

    One curve does all scenarios: each detection is one row with two bits for
    each, its flags as fixed there, in place of a threshold.
    """
    error = F.coalesce("error", F.lit(""))
    tp, fp = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for i, (_, up, off) in enumerate(_SCENARIOS):
        ignored, hit = F.col("ignored") | error.isin(*off), F.col("matched") | error.isin(*up)
        tp, fp = (x + F.when(c & ~ignored, 1 << i).otherwise(0) for x, c in ((tp, hit), (fp, ~hit)))
    rows = typed.select("category_id", "score", "image_id", "rank", tp.alias("tp0"), fp.alias("fp0")).where("tp0 <> 0 or fp0 <> 0")
    names = [x for x, _, _ in _SCENARIOS]
    fake = missed.select("category_id", F.lit(2.0).alias("score"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("missed"))).alias("image_id"), F.lit(0).alias("rank"), F.lit(1 << names.index("Miss")).cast("bigint").alias("tp0"), F.lit(0).cast("bigint").alias("fp0"))
    n = npig.where("a = 0").select("category_id", "a", "npig")
    each = Params(iou_thrs=tuple(float(i) for i in range(len(names))), max_dets=(2147483647,), areas=(("all", 0.0, 1e10),))
    ap = curve.cells(curve.curve(rows.unionByName(fake), n, each), n, each).withColumn("scenario", F.element_at(F.array(*map(F.lit, names)), F.col("t") + 1))
    mean = ap.groupBy("scenario").agg(F.avg("ap").alias("ap"))
    base = mean.where("scenario = 'base'").select(F.col("ap").alias("base"))
    delta = mean.crossJoin(F.broadcast(base)).select(F.col("scenario").alias("error"), F.when(F.col("scenario") == "base", F.col("ap")).otherwise(F.col("ap") - F.col("base")).alias("delta_ap"))
    delta = delta.unionByName(delta.where("error = 'Miss'").withColumn("error", F.lit("FN")))
    counts = typed.where("error is not null").groupBy("error").agg(F.count("*").alias("n")).unionByName(missed.select(F.lit("Miss").alias("error"), F.col("missed").alias("n")).groupBy("error").agg(F.sum("n").alias("n")))
    return delta.join(counts, "error", "left").select("error", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "delta_ap")


def statuses(dt_eval: DataFrame, gt: DataFrame, params: Params, iou_thr: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(detections with is_tp and gt, ground truth with is_matched), both without ignored ones."""
    t = snap(params, iou_thr)
    rows = dt_eval.where(F.col("a") == 0).where(~F.col("ignored")[t]).select("image_id", "category_id", "dt_id", "score", "rank", F.col("matched")[t].alias("is_tp"), F.col("gt")[t].alias("gt_id"))
    rows = _keep(rows)  # both results read it, and more than once
    _, lo, hi = params.areas[0]
    countable = gt.where(~ignored_always(gt) & F.coalesce("area", F.lit(0.0)).between(lo, hi))
    taken = rows.where("is_tp").select("image_id", F.col("gt_id").alias("id"), F.lit(True).alias("is_matched"))
    return rows, countable.join(taken, ["image_id", "id"], "left").fillna(False, ["is_matched"])


def image_diagnostics(dt_status: DataFrame, gt_status: DataFrame) -> DataFrame:
    """image_id, tp, fp, fn, f1, ap, profile of every image with a countable detection or ground truth."""
    d = dt_status.groupBy("image_id").agg(F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"))
    g = gt_status.groupBy("image_id").agg(F.count_if(~F.col("is_matched")).alias("fn"))
    n = d.join(g, "image_id", "full_outer").fillna(0, ["tp", "fp", "fn"])
    ap = average_precision(dt_status.select("image_id", "category_id", "rank", "score", F.col("is_tp").cast("long").alias("tp"), (~F.col("is_tp")).cast("long").alias("fp")), n.select("image_id", (F.col("tp") + F.col("fn")).alias("npig")), ["image_id"], ["category_id", "rank"])
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    profile = F.when((F.col("fp") == 0) & (F.col("fn") == 0), "perfect").when(F.col("fp") > 2 * F.col("fn"), "fp_heavy").when(F.col("fn") > 2 * F.col("fp"), "fn_heavy").otherwise("mixed")
    empty = F.when(F.col("fp") == 0, 1.0).otherwise(0.0)
    return n.join(ap, "image_id", "left").select("image_id", "tp", "fp", "fn", f1.alias("f1"), F.coalesce("ap", empty).alias("ap"), profile.alias("profile"))


def label_errors(dt: DataFrame, dt_status: DataFrame, gt_status: DataFrame, score_thr: float = 0.5) -> DataFrame:
    """image_id, dt_id, dt_category_id, score, gt_id, gt_category_id, iou, error of confident false positives.

    wrong_label: a missed ground truth of another category at IoU 0.5 or more
    (the best, then the smallest id); missing_annotation: no evaluated ground
    truth at IoU 0.1 or more.
    """
    wrong = dt_status.where(~F.col("is_tp") & (F.col("score") >= score_thr)).select("image_id", F.col("dt_id").alias("id"), "category_id", "score")
    boxes = dt.select("image_id", "id", *"xywh").join(wrong, ["image_id", "id"])
    gts = gt_status.withColumn("iscrowd", F.lit(False))
    pairs = all_pairs(boxes, gts).withColumn("iou", box_iou(box(), box("g"))).join(gts.select("image_id", F.col("id").alias("gt_id"), "is_matched"), ["image_id", "gt_id"])
    other = ~F.col("is_matched") & (F.col("gt_category_id") != F.col("category_id")) & (F.col("iou") > 0)
    best = F.max_by(F.struct("gt_id", "gt_category_id", "iou"), F.when(other, F.struct("iou", -F.col("gt_id"))))
    found = pairs.groupBy("image_id", "id").agg(best.alias("b"), F.max("iou").alias("any_iou"))
    rows = wrong.join(found, ["image_id", "id"], "left")
    is_wrong = F.coalesce(F.col("b.iou") >= 0.5, F.lit(False))
    lone = F.coalesce("any_iou", F.lit(0.0)) < 0.1
    out = rows.where(is_wrong | lone)
    pick = lambda c: F.when(is_wrong, F.col(f"b.{c}"))
    return out.select("image_id", F.col("id").alias("dt_id"), F.col("category_id").alias("dt_category_id"), "score", pick("gt_id").alias("gt_id"), pick("gt_category_id").alias("gt_category_id"), F.coalesce(pick("iou"), F.lit(0.0)).alias("iou"), F.when(is_wrong, "wrong_label").otherwise("missing_annotation").alias("error"))


def sliced(dt_eval: DataFrame, counts: DataFrame, slices: DataFrame, params: Params, table=metrics.BOX) -> DataFrame:
    """slice, metric, value, delta to all images; slices has slice and image_id. delta is 0 where either side is -1.

    Matching isn't repeated: the slice is one more grouping key.
    """
    if not slices.where("slice = '_overall'").isEmpty():
        raise ValueError("the slice name _overall is reserved")
    named = slices.groupBy("image_id").agg(F.collect_set("slice").alias("names"))
    own = F.explode(F.concat(F.array(F.lit("_overall")), F.coalesce("names", F.array().cast("array<string>")))).alias("slice")
    placed = lambda x: x.join(named, "image_id", "left").select(*x.columns, own)  # noqa: E731 (rows are read once for the slices and all images)
    rows, n = placed(curve.narrow(dt_eval, params)), total(placed(counts), "slice")
    points = curve.curve(rows, n, params, ("slice",))
    got = metrics.summary(curve.cells(points, n, params, ("slice",)), params, table, ("slice",))
    base = got.where("slice = '_overall'").select("metric", F.col("value").alias("base"))
    delta = F.when((F.col("value") < 0) | (F.col("base") < 0), 0.0).otherwise(F.col("value") - F.col("base"))
    return got.join(base, "metric").select("slice", "metric", "value", delta.alias("delta"))


def draw(seed: int, sample: Column, number: Column, n: Column) -> Column:
    """A deterministic draw in 0 .. n - 1: two rounds of a congruential generator in 64-bit arithmetic."""
    x = (F.lit(seed) * 7919 + sample * 104729 + number * 1299709 + 12345) % 2147483647
    x = (x * 48271 + 11) % 2147483647
    return (x * 48271 + 11) % 2147483647 % n


def compare(gt: DataFrame, dt_a: DataFrame, dt_b: DataFrame, params: Params, n_bootstrap: int = 0, seed: int = 42, confidence: float = 0.95, table=metrics.BOX, pairs: Pairs = box_pairs) -> DataFrame:
    """metric, a, b, delta (0 where a side is -1) and, from bootstrap samples of images, lower, upper, prob_positive, std_err.

    A sample is the set of distinct images among n draws with replacement.
    Images get numbers by a distributed ranking and draws are made by all
    tasks.  An image carries a bit for each sample it is in, up to ``SETS`` in
    a word, so rows go once through the curve for all of them and neither
    matching nor sorting is repeated.
    """
    images = _shared(gt, dt_a, dt_b)
    if n_bootstrap:
        images = images.persist(StorageLevel.MEMORY_AND_DISK)  # ids alone, read by the ranking
        n = images.count()
        order = numbered(images.withColumnRenamed("image_id", "id"), F.col("id")).withColumnRenamed("id", "image_id")
        size = F.lit(n).cast("bigint")
        draws = images.sparkSession.range(n_bootstrap * n).select((F.col("id") / size).cast("int").alias("boot"), (F.col("id") % size).alias("j"))
        picked = draws.select("boot", draw(seed, F.col("boot"), F.col("j"), size).alias("number"))
        bit = F.expr(f"shiftleft(1L, boot % {SETS})")
        words = [picked.where(F.col("boot").between(low, low + SETS - 1)).groupBy("number").agg(F.bit_or(bit).alias("sets")).select(F.lit(low // SETS + 1).alias("block"), "number", "sets") for low in range(0, n_bootstrap, SETS)]
        drawn = words[0]
        for x in words[1:]:
            drawn = drawn.unionByName(x)
        drawn = drawn.join(order, "number").select("image_id", "block", "sets")
        shared = drawn.unionByName(images.select("image_id", F.lit(0).alias("block"), F.lit(1).cast("bigint").alias("sets")))
        if n_bootstrap < SETS:  # one word for all: the images themselves are its last bit
            shared = images.join(drawn, "image_id", "left").select("image_id", F.lit(1).alias("block"), F.coalesce("sets", F.lit(0).cast("bigint")).bitwiseOR(F.lit(1 << n_bootstrap).cast("bigint")).alias("sets"))
    else:
        shared = images.select("image_id", F.lit(1).alias("block"), F.lit(1).cast("bigint").alias("sets"))
    n_sets = min(SETS, n_bootstrap + 1)
    boot = F.when(F.col("block") == 0, -1).otherwise((F.col("block") - 1) * SETS + F.col("set"))
    if n_bootstrap < SETS:
        boot = F.when(F.col("set") == n_bootstrap, -1).otherwise(F.col("set"))
    keys = ("model", "block", "set")
    model = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model")
    held = gt_counts(pooled(gt, params), params).join(shared, "image_id").groupBy("block", "category_id", "a").agg(F.array(*(F.sum(F.when(F.col("sets").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.col("npig")).otherwise(0)) for i in range(n_sets))).alias("n"))
    n = held.select("block", "category_id", "a", F.posexplode("n").alias("set", "npig")).select("*", model)
    points = curve.curve(_bits(gt, dt_a, dt_b, params, pairs).join(shared, "image_id"), n, params, keys[:2], n_sets=n_sets)
    got = metrics.summary(curve.cells(points, n, params, keys), params, table, keys).select("model", boot.alias("boot"), "metric", "value")
    wide = got.groupBy("boot", "metric").pivot("model", ["a", "b"]).agg(F.first("value"))
    wide = wide.withColumn("delta", F.when((F.col("a") < 0) | (F.col("b") < 0), 0.0).otherwise(F.col("b") - F.col("a")))
    point = wide.where("boot = -1").drop("boot")
    if not n_bootstrap:
        return point
    alpha = 1 - confidence
    low, high = min(int(alpha / 2 * n_bootstrap), n_bootstrap - 1), min(-int(-(1 - alpha / 2) * n_bootstrap // 1), n_bootstrap - 1)
    spread = wide.where(F.col("boot").between(0, n_bootstrap - 1)).groupBy("metric").agg(F.sort_array(F.collect_list("delta")).alias("d"), F.avg((F.col("delta") > 0).cast("double")).alias("prob_positive"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("std_err"))
    return point.join(spread, "metric").select("metric", "a", "b", "delta", F.col("d")[low].alias("lower"), F.col("d")[high].alias("upper"), "prob_positive", "std_err")


def _bits(gt: DataFrame, dt_a: DataFrame, dt_b: DataFrame, params: Params, pairs: Pairs) -> DataFrame:
    """Detections of both models (a and b in column model) as rows of bits."""
    if getattr(pairs, "within", None) is None:
        parts = [curve.narrow(evaluate(gt, d, params, pairs)[0], params) for d in (dt_a, dt_b)]
    else:
        parts = [packed(gt, d, params, pairs) for d in (dt_a, dt_b)]
    return parts[0].withColumn("model", F.lit("a")).unionByName(parts[1].withColumn("model", F.lit("b")))


def _shared(gt: DataFrame, dt_a: DataFrame, dt_b: DataFrame) -> DataFrame:
    """image_id of the images that have rows of both comparisons: ground truth, or detections of both models."""
    sides = [d.select("image_id", F.lit(bit).alias("bit")) for d, bit in ((gt, 3), (dt_a, 1), (dt_b, 2))]
    every = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return every.groupBy("image_id").agg(F.bit_or("bit").alias("bit")).where("bit = 3").select("image_id")


def _both(gt: DataFrame, dt_a: DataFrame, dt_b: DataFrame, params: Params, pairs: Pairs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of bits of both models, counts, and the images that both have."""
    return _bits(gt, dt_a, dt_b, params, pairs), gt_counts(pooled(gt, params), params), _shared(gt, dt_a, dt_b)


def compare_categories(gt: DataFrame, dt_a: DataFrame, dt_b: DataFrame, categories: DataFrame, params: Params, pairs: Pairs = box_pairs) -> DataFrame:
    """category_id, name, ap_a, ap_b, delta of every category that either model has an AP of, on the shared images.

    An absent AP is -1 and counts as 0 in the delta; a category without a
    name has its id in place of it.
    """
    rows, counts, images = _both(gt, dt_a, dt_b, params, pairs)
    n = total(counts.join(images, "image_id"))
    cells = curve.cells(curve.curve(rows.join(images, "image_id"), n.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model")), params, ("model",)), n.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model")), params, ("model",))
    last = cells.where((F.col("a") == 0) & (F.col("m") == len(params.max_dets) - 1))
    ap = last.groupBy("category_id").pivot("model", ["a", "b"]).agg(F.avg("ap")).select("category_id", F.coalesce("a", F.lit(-1.0)).alias("ap_a"), F.coalesce("b", F.lit(-1.0)).alias("ap_b"))
    zero = F.lit(0.0)
    named = ap.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    return named.select("category_id", F.coalesce("name", F.col("category_id").cast("string")).alias("name"), "ap_a", "ap_b", (F.greatest("ap_b", zero) - F.greatest("ap_a", zero)).alias("delta"))


def slice_sizes(slices: DataFrame, images: DataFrame) -> DataFrame:
    """slice, num_images: distinct images named by each slice, and all evaluated ones (image_id) as _overall."""
    named = slices.groupBy("slice").agg(F.count_distinct("image_id").alias("num_images"))
    return named.unionByName(images.agg(F.count_distinct("image_id").alias("num_images")).select(F.lit("_overall").alias("slice"), "num_images"))


def federated(gt: DataFrame, dt: DataFrame, images: DataFrame, params: Params | None = None, pairs: Pairs = box_pairs) -> tuple[DataFrame, DataFrame]:
    """Evaluation with partial annotation: images has id, neg_category_ids and not_exhaustive_category_ids.

    Detections of a category that isn't annotated in their image, and not
    known to be absent either, are dropped; unmatched ones of a category that
    isn't exhaustively annotated are ignored.
    """
    params = params or Params.federated()
    if params.use_cats and hasattr(pairs, "within"):
        marks = [images.select(F.col("id").alias("image_id"), F.explode(c).alias("category_id"), F.lit(m).alias("mark")) for c, m in (("neg_category_ids", ABSENT), ("not_exhaustive_category_ids", OPEN))]
        return evaluate(gt, dt, params, pairs, marks=marks[0].unionByName(marks[1]))
    annotated = gt.select("image_id", "category_id").distinct()
    absent = images.select(F.col("id").alias("image_id"), F.explode("neg_category_ids").alias("category_id"))
    dt = dt.join(annotated.unionByName(absent).distinct(), ["image_id", "category_id"], "left_semi")
    rows, counts = evaluate(gt, dt, params, pairs)
    open_ = images.select(F.col("id").alias("image_id"), F.explode("not_exhaustive_category_ids").alias("category_id")).distinct().withColumn("open", F.lit(True))
    rows = rows.join(open_, ["image_id", "category_id"], "left")
    ignored = F.transform("ignored", lambda x, i: x | (F.coalesce("open", F.lit(False)) & ~F.col("matched")[i]))
    return rows.withColumn("ignored", ignored).drop("open"), counts


def frequency_ap(cells: DataFrame, categories: DataFrame, params: Params) -> DataFrame:
    """metric (APr, APc, APf), value: macro means of category APs by the categories' frequency; -1 for none."""
    ap = metrics.per_category(cells, params).join(categories.select(F.col("id").alias("category_id"), "frequency"), "category_id")
    wide = ap.agg(*(F.coalesce(F.avg(F.when(F.col("frequency") == f, F.col("ap"))), F.lit(-1.0)).alias(f) for f in "rcf"))
    return wide.select(F.explode(F.map_from_arrays(F.array(*(F.lit(f"AP{f}") for f in "rcf")), F.array(*(F.col(f) for f in "rcf")))).alias("metric", "value"))


def group_of(dt_eval: DataFrame, pairs: DataFrame, params: Params) -> DataFrame:
    """Second pass of group-of evaluation: an unmatched detection on a group-of box at the threshold is a match.

    ``pairs`` has image_id, category_id, rank, gt_id, iou of group-of boxes.
    No detection excludes another, so this is a join and an aggregate.
    """
    best = pairs.groupBy("image_id", "category_id", "rank").agg(F.max("iou").alias("iou"), F.max_by("gt_id", F.struct("iou", "gt_id")).alias("group"))
    rows = dt_eval.join(best, ["image_id", "category_id", "rank"], "left")
    thrs = F.array(*map(F.lit, params.iou_thrs))
    now = F.transform("matched", lambda m, i: m | F.coalesce(F.col("iou") >= thrs[i], F.lit(False)))
    gt = F.transform("gt", lambda g, i: F.when(g.isNull() & (F.col("iou") >= thrs[i]), F.col("group")).otherwise(g))
    ignored = F.transform("ignored", lambda x, i: x & ~(~F.col("matched")[i] & F.coalesce(F.col("iou") >= thrs[i], F.lit(False))))
    return rows.select("image_id", "category_id", "a", "rank", "dt_id", "score", gt.alias("gt"), now.alias("matched"), ignored.alias("ignored"))


def open_images(gt: DataFrame, dt: DataFrame, params: Params | None = None, pairs: Pairs = box_pairs) -> tuple[DataFrame, DataFrame]:
    """Evaluation with group-of boxes: they count as no ground truth, absorb any number of detections as matches, and crowds are plain boxes."""
    params = params or Params.open_images()
    if hasattr(pairs, "within"):
        return evaluate(gt.withColumn("iscrowd", F.lit(False)), dt, params, pairs, group_of=True)
    grouped = F.coalesce("is_group_of", F.lit(False))
    plain = gt.where(~grouped).withColumn("iscrowd", F.lit(False))
    rows, counts = evaluate(plain, dt, params, pairs)
    groups = gt.where(grouped).withColumn("iscrowd", F.lit(False))
    return group_of(rows, pairs(ranked(dt, params), groups), params), counts
