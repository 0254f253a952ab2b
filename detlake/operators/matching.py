"""Joins of detections to ground truth, and greedy matching."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.functions.geometry import box, box_iou
from detlake.operators.params import Params, WORD

#: Detections and ground truth to their pairs with similarity.
Pairs = Callable[[DataFrame, DataFrame], DataFrame]
#: Rows that matching takes at a time, more only where a group has more, and pairs that it looks at together.
HELD, PAIRS = 1 << 15, 1 << 19
#: What rows besides plain ground truth and detections are in a group: a group-of box, a category known to be absent, one not annotated exhaustively.
GROUP_OF, ABSENT, OPEN = 1, 2, 3

Values = dict[str, np.ndarray]


@dataclass(frozen=True)
class Within:
    """A similarity as ``pairs``, for detections and ground truth of a group at once, as arrays.

    ``columns`` are what it needs of either side (flag: detections), ``bounds``
    the box (x0, y0, x1, y1) outside of which a row is similar to nothing, and
    ``similar`` takes two sides, the pairs' places in them and whether the
    ground truth is a crowd.  ``closed``: bounds that only touch count.
    """

    columns: Callable[[DataFrame, bool], dict[str, Column]]
    bounds: Callable[[Values, bool], tuple[np.ndarray, ...]]
    similar: Callable[[Values, Values, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    closed: bool = False


def ranked(dt: DataFrame, params: Params) -> DataFrame:
    """Detections with area and rank in their image and category: score descending, then id; cut at the last max_det."""
    score = F.coalesce("score", F.lit(0.0))
    if "area" not in dt.columns:
        dt = dt.withColumn("area", F.col("w") * F.col("h"))
    if not params.use_cats:
        dt = dt.withColumn("category_id", F.lit(-1).cast("bigint"))
    w = Window.partitionBy("image_id", "category_id").orderBy(score.desc(), "id")
    return dt.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= params.max_dets[-1])


def pooled(gt: DataFrame, params: Params) -> DataFrame:
    return gt if params.use_cats else gt.withColumn("category_id", F.lit(-1).cast("bigint"))


def ignored_always(gt: DataFrame) -> Column:
    """Ground truth that is ignored in every area range: column ``ignore`` where there is one, else crowds."""
    return F.col("ignore") if "ignore" in gt.columns else F.coalesce("iscrowd", F.lit(False))


def box_pairs(dt: DataFrame, gt: DataFrame) -> DataFrame:
    """All pairs of an image and category with their IoU: an equi-join, then arithmetic.

    The box overlap test is a filter on the join, so pairs that don't touch
    never become rows.
    """
    right = gt.select("image_id", "category_id", F.col("id").alias("gt_id"), *(F.col(c).alias(f"g{c}") for c in "xywh"), F.coalesce("iscrowd", F.lit(False)).alias("crowd"), ignored_always(gt).alias("ignore"), F.coalesce("area", F.lit(0.0)).alias("gt_area"))
    touch = (F.col("x") < F.col("gx") + F.col("gw")) & (F.col("gx") < F.col("x") + F.col("w")) & (F.col("y") < F.col("gy") + F.col("gh")) & (F.col("gy") < F.col("y") + F.col("h"))
    return dt.join(right, ["image_id", "category_id"]).where(touch).withColumn("iou", box_iou(box(), box("g"), F.col("crowd")))


def _box_similar(d: Values, g: Values, i: np.ndarray, j: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """``box_iou`` on arrays."""
    side = lambda at, size: np.maximum(0.0, np.minimum((d[at] + d[size])[i], (g[at] + g[size])[j]) - np.maximum(d[at][i], g[at][j]))
    inter, area = side("x", "w") * side("y", "h"), (d["w"] * d["h"])[i]
    union = np.where(crowd, area, area + (g["w"] * g["h"])[j] - inter)
    return np.where(union <= 0, 0.0, inter / np.where(union <= 0, 1.0, union))


box_pairs.within = Within(lambda df, own: {c: F.col(c).cast("double") for c in "xywh"}, lambda v, own: (v["x"], v["y"], v["x"] + v["w"], v["y"] + v["h"]), _box_similar)


def assign(det: np.ndarray, group: np.ndarray, gt: np.ndarray, iou: np.ndarray, crowd: np.ndarray, ignored: np.ndarray, n_det: int, thrs: np.ndarray) -> np.ndarray:
    """The pair that each detection takes: [detection, area range, threshold], -1 for none.

    Pairs are sorted by group, detection (in order of rank) and ground truth;
    ``ignored`` is [pair, area range].  Countable ground truth comes first;
    among that at or over the threshold the best IoU is taken, the later one
    on ties.  Crowds can be taken again.  A pair whose detection and ground
    truth have no other partner stands as it is.  All others go in waves: one
    detection of every group at a time, for all ranges and thresholds at once.
    """
    chosen = np.full((n_det, ignored.shape[1], len(thrs)), -1, np.int64)
    if not len(det):
        return chosen
    order = np.lexsort((gt, group))
    new = np.concatenate([[True], (np.diff(group[order]) != 0) | (np.diff(gt[order]) != 0)])
    code = np.empty(len(gt), np.int64)
    code[order] = np.cumsum(new) - 1
    alone = (np.bincount(det)[det] == 1) & (np.bincount(code)[code] == 1)
    easy = np.flatnonzero(alone)
    chosen[det[easy]] = np.where(iou[easy, None] >= thrs, easy[:, None], -1)[:, None, :]
    rest = np.flatnonzero(~alone)
    if not len(rest):
        return chosen
    new_det = np.concatenate([[True], np.diff(det[rest]) != 0])
    first = rest[new_det]
    new_group = np.concatenate([[True], np.diff(group[first]) != 0])
    at = np.arange(len(first))
    turn = at - np.maximum.accumulate(np.where(new_group, at, 0))
    wave = turn[np.cumsum(new_det) - 1]
    by = np.lexsort((iou[rest], det[rest], wave))
    rest, wave = rest[by], wave[by]
    taken = np.zeros((code.max() + 1, *chosen.shape[1:]), bool)
    edges = np.searchsorted(wave, np.arange(wave[-1] + 2))
    for low, high in zip(edges[:-1], edges[1:]):
        pairs = rest[low:high]
        start = np.flatnonzero(np.concatenate([[True], np.diff(det[pairs]) != 0]))
        can = (iou[pairs, None] >= thrs)[:, None, :] & (crowd[pairs, None, None] | ~taken[code[pairs]])
        place = np.arange(1, len(pairs) + 1)[:, None, None]
        plain = np.maximum.reduceat(np.where(can & ~ignored[pairs, :, None], place, 0), start)
        best = np.where(plain > 0, plain, np.maximum.reduceat(np.where(can, place, 0), start))
        got = np.where(best > 0, pairs[best - 1], -1)
        chosen[det[pairs[start]]] = got
        i, a, t = np.nonzero(got >= 0)
        taken[code[got[i, a, t]], a, t] = True
    return chosen


def _by_group(rows: DataFrame, order: list[str | Column], f: Callable[[dict[str, np.ndarray], np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over whole groups of an image and category: columns as arrays, sorted, and the number of each row's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def done(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            new = (np.diff(t["image_id"]) != 0) | (np.diff(t["category_id"]) != 0)
            return f(t, np.concatenate([[0], np.cumsum(new)]))

        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            held = {c: np.concatenate([held[c], new[c]]) for c in new} if held else new
            n = len(held["rank"])
            if not n:
                continue
            last = np.flatnonzero((held["image_id"] != held["image_id"][-1]) | (held["category_id"] != held["category_id"][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from done({c: x[:cut] for c, x in held.items()})
                held = {c: x[cut:] for c, x in held.items()}
        if held and len(held["rank"]):
            yield from done(held)

    # By a hash of the two: a union of inputs that are dealt by both columns would count as dealt already, though each is coalesced in its own way.
    return rows.repartition(F.xxhash64("image_id", "category_id")).sortWithinPartitions("image_id", "category_id", "rank", *order).mapInArrow(run, schema)


def _lists(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """A row of a matrix as a list each."""
    offset = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(offset, pa.array(values.ravel(), mask=None if mask is None else mask.ravel()))


def _pair_rows(pairs: DataFrame, params: Params) -> DataFrame:
    """The columns that matching needs; only pairs at the least threshold or over can match."""
    ignore = F.col("ignore" if "ignore" in pairs.columns else "crowd").alias("ignore")
    long = [F.col(c).cast("bigint").alias(c) for c in ("image_id", "category_id")]
    return pairs.where(F.col("iou") >= min(params.iou_thrs)).select(*long, "rank", F.col("gt_id").cast("bigint").alias("gt_id"), F.col("iou").cast("double").alias("iou"), "crowd", ignore, F.col("gt_area").cast("double").alias("gt_area"))


def _ignored(t: dict[str, np.ndarray], areas: np.ndarray) -> np.ndarray:
    return t["ignore"][:, None] | (t["gt_area"][:, None] < areas[:, 0]) | (t["gt_area"][:, None] > areas[:, 1])


def match(pairs: DataFrame, params: Params) -> DataFrame:
    """Matches of each area range: image_id, category_id, a, rank, gt (array over thresholds, 0-based ground truth id or null), gt_ignored.

    ``pairs`` has image_id, category_id, rank, gt_id, iou, crowd (can be taken
    again), ignore (in every range; as crowd where it lacks) and gt_area.
    Pairs under the least threshold are dropped before the shuffle; a
    detection without any other pair has no row.
    """
    thrs, areas = np.array(params.iou_thrs), np.array([(lo, hi) for _, lo, hi in params.areas])

    def found(t: dict[str, np.ndarray], group: np.ndarray) -> Iterator[pa.RecordBatch]:
        det = np.concatenate([[0], np.cumsum((np.diff(group) != 0) | (np.diff(t["rank"]) != 0))])
        ignored = _ignored(t, areas)
        chosen = assign(det, group, t["gt_id"], t["iou"], t["crowd"], ignored, det[-1] + 1, thrs)
        first = np.flatnonzero(np.diff(det, prepend=-1))
        ids = [pa.array(t[c][first]) for c in ("image_id", "category_id")]
        for a in range(len(areas)):
            pair = chosen[:, a]
            yield pa.record_batch([*ids, pa.array(np.full(len(first), a, np.int32)), pa.array(t["rank"][first].astype(np.int32)), _lists(t["gt_id"][pair], pair < 0), _lists((pair >= 0) & ignored[pair, a])], names=["image_id", "category_id", "a", "rank", "gt", "gt_ignored"])

    return _by_group(_pair_rows(pairs, params), ["gt_id"], found, "image_id bigint, category_id bigint, a int, rank int, gt array<bigint>, gt_ignored array<boolean>")


def evaluated(dt: DataFrame, pairs: DataFrame, params: Params) -> DataFrame:
    """One row per detection and area range: image_id, category_id, a, rank, dt_id, score, gt, matched and ignored over thresholds.

    A matched detection is ignored as its ground truth is; an unmatched one
    if its own area is out of range.  Detections travel with their pairs, so
    one shuffle by image and category does it all; those without an image or
    category are left out.
    """
    thrs, areas = np.array(params.iou_thrs), np.array([(lo, hi) for _, lo, hi in params.areas])
    zero, no = F.lit(0.0), F.lit(False)
    rows = _pair_rows(pairs, params).select("*", no.alias("own"), F.lit(0).cast("bigint").alias("dt_id"), zero.alias("score"), zero.alias("area"))
    long = [F.col(c).cast("bigint").alias(c) for c in ("image_id", "category_id")]
    marks = dt.where("image_id is not null and category_id is not null").select(*long, "rank", F.lit(0).cast("bigint").alias("gt_id"), zero.alias("iou"), no.alias("crowd"), no.alias("ignore"), zero.alias("gt_area"), F.lit(True).alias("own"), F.col("id").cast("bigint").alias("dt_id"), F.col("score").cast("double").alias("score"), F.coalesce(F.col("area").cast("double"), zero).alias("area"))

    def found(t: dict[str, np.ndarray], group: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = t["own"]
        mine, theirs = {c: x[own] for c, x in t.items()}, {c: x[~own] for c, x in t.items()}
        det = (np.cumsum(own) - 1)[~own]
        ignored = _ignored(theirs, areas)
        chosen = assign(det, group[~own], theirs["gt_id"], theirs["iou"], theirs["crowd"], ignored, int(own.sum()), thrs)
        ids = [pa.array(mine[c]) for c in ("image_id", "category_id")]
        some = [pa.array(mine["rank"].astype(np.int32)), pa.array(mine["dt_id"]), pa.array(mine["score"])]
        gt_id = np.append(theirs["gt_id"], 0)  # the last entry, -1, stands for none
        ignored = np.concatenate([ignored, np.zeros((1, len(areas)), bool)])
        for a, (low, high) in enumerate(areas):
            pair = chosen[:, a]
            none = pair < 0
            out = (mine["area"] < low) | (mine["area"] > high)
            yield pa.record_batch([*ids, pa.array(np.full(len(out), a, np.int32)), *some, _lists(gt_id[pair], none), _lists(~none), _lists(np.where(none, out[:, None], ignored[pair, a]))], names=["image_id", "category_id", "a", "rank", "dt_id", "score", "gt", "matched", "ignored"])

    schema = "image_id bigint, category_id bigint, a int, rank int, dt_id bigint, score double, gt array<bigint>, matched array<boolean>, ignored array<boolean>"
    return _by_group(marks.unionByName(rows), [F.col("own").desc(), "gt_id"], found, schema)


def gt_counts(gt: DataFrame, params: Params) -> DataFrame:
    """image_id, category_id, a, npig: countable ground truth; sums of it give npig of any set of images."""
    counts = [F.count_if(~ignored_always(gt) & F.coalesce("area", F.lit(0.0)).between(lo, hi)) for _, lo, hi in params.areas]
    return gt.groupBy("image_id", "category_id").agg(F.array(*counts).alias("n")).select("image_id", "category_id", F.posexplode("n").alias("a", "npig"))


def total(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys, "category_id", "a").agg(F.sum("npig").alias("npig"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of an image and category."""
    held: list[pa.RecordBatch] = []
    n, goal = 0, HELD
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < goal:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        image, category = (table.column(c).to_numpy() for c in ("image_id", "category_id"))
        last = np.flatnonzero((image != image[-1]) | (category != category[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).combine_chunks().to_batches()
        n = len(table) - cut
        goal = max(HELD, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows, filled up with NaN."""
    lists = lists.combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy()
    out = np.full((len(size), int(size.max(initial=0))), np.nan)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _similar_pairs(d: Values, g: Values, group_d: np.ndarray, group_g: np.ndarray, crowd: np.ndarray, within: Within, least: float) -> tuple[np.ndarray, ...]:
    """Places of detection and ground truth, and similarity, of the pairs of a group at the least threshold or over; both sides are sorted by group."""
    n = np.bincount(group_g, minlength=int(group_d[-1]) + 1) if len(group_d) else np.zeros(0, np.int64)
    count, first = n[group_d], (np.cumsum(n) - n)[group_d]
    a, b = within.bounds(d, True), within.bounds(g, False)
    less = np.less_equal if within.closed else np.less
    out = []
    edge = np.append(0, np.cumsum(count))
    low = 0
    while low < len(group_d):
        high = max(low + 1, int(np.searchsorted(edge, edge[low] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(low, high), count[low:high])
        j = np.arange(len(i)) - (edge[i] - edge[low]) + first[i]
        touch = less(a[0][i], b[2][j]) & less(b[0][j], a[2][i]) & less(a[1][i], b[3][j]) & less(b[1][j], a[3][i])
        i, j = i[touch], j[touch]
        if len(i):
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                x = within.similar(d, g, i, j, crowd[j])
            ok = x >= least
            out.append((i[ok], j[ok], x[ok]))
        low = high
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _in_groups(gt: DataFrame, dt: DataFrame, params: Params, within: Within, finish: Callable[[Values, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, group_of: bool = False, marks: DataFrame | None = None) -> DataFrame:
    """Ranks, pairs and matches of every group in one shuffle of both sides, without a row for any pair.

    ``finish`` gets the detections in order, the pair that each takes, the
    pairs' ground truth ids and whether it is ignored in each area range.
    With ``group_of`` or ``marks`` (as ``evaluate`` has them) the detections
    have group_iou and group_id, or open, besides.
    """
    zero, no = F.lit(0.0), F.lit(False)
    if not params.use_cats:
        gt, dt = (x.withColumn("category_id", F.lit(-1).cast("bigint")) for x in (gt, dt))
    area = F.col("area") if "area" in dt.columns else F.col("w") * F.col("h")
    long = [F.col(c).cast("bigint").alias(c) for c in ("image_id", "category_id")]
    extra = [within.columns(dt, True), within.columns(gt, False)]
    names = list(dict.fromkeys([*extra[0], *extra[1]]))
    kind = {**extra[0], **extra[1]}
    own = lambda x: [x[c].alias(f"_{c}") if c in x else F.lit(None).cast(_type(dt, gt, kind[c], c in extra[0])).alias(f"_{c}") for c in names]
    known = "image_id is not null and category_id is not null"
    id_ = F.col("id").cast("bigint").alias("id")
    left = dt.where(known).select(*long, F.lit(True).alias("own"), id_, F.coalesce(F.col("score").cast("double"), zero).alias("score"), F.coalesce(area.cast("double"), zero).alias("area"), no.alias("crowd"), no.alias("ignore"), *own(extra[0]))
    right_columns = [*long, no.alias("own"), id_, zero.alias("score"), F.coalesce(F.col("area").cast("double"), zero).alias("area"), F.coalesce("iscrowd", no).alias("crowd"), ignored_always(gt).alias("ignore"), *own(extra[1])]
    right = gt.where(known).select(*right_columns)
    rows = left.unionByName(right)
    marked = marks is not None
    special = group_of or marked
    if special:
        mark = lambda x: x.cast("tinyint").alias("mark")
        grouped = F.coalesce("is_group_of", no) if group_of else no
        rows = left.select("*", mark(F.lit(0))).unionByName(gt.where(known).select(*right_columns, mark(F.when(grouped, GROUP_OF).otherwise(0))))
    if marked:
        rows = rows.unionByName(marks.where(known).select(*long, mark(F.col("mark"))).withColumn("own", no), allowMissingColumns=True).fillna(False, ["crowd", "ignore"]).fillna(0, ["id"]).fillna(0.0, ["score", "area"])
    thrs, areas = np.array(params.iou_thrs), np.array([(lo, hi) for _, lo, hi in params.areas])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            t = {c: table.column(c).to_numpy() for c in ("image_id", "category_id", "own", "id", "score", "area", "crowd", "ignore", *["mark"] * special)}
            new = (np.diff(t["image_id"]) != 0) | (np.diff(t["category_id"]) != 0)
            group = np.concatenate([[0], np.cumsum(new)])
            d, g = np.flatnonzero(t["own"]), np.flatnonzero(~t["own"] & (t["mark"] == 0) if special else ~t["own"])
            if marked:
                open_, seen = np.zeros((2, int(group[-1]) + 1), bool)
                open_[group[t["mark"] == OPEN]] = True
                seen[group[g]] = seen[group[t["mark"] == ABSENT]] = True
                d = d[seen[group[d]]]
            score = t["score"][d]
            d = d[np.lexsort((t["id"][d], np.where(np.isnan(score), -np.inf, -score), group[d]))]
            start = np.flatnonzero(np.diff(group[d], prepend=-1))
            rank = np.arange(len(d)) - np.repeat(start, np.diff(np.append(start, len(d)))) + 1
            d, rank = d[rank <= params.max_dets[-1]], rank[rank <= params.max_dets[-1]]
            g = g[np.lexsort((t["id"][g], group[g]))]
            h = np.flatnonzero(t["mark"] == GROUP_OF) if group_of else g[:0]
            values = {}
            for c in names:
                x = table.column(f"_{c}")
                values[c] = x.to_numpy() if not pa.types.is_list(x.type) else matrix(x) if pa.types.is_floating(x.type.value_type) else np.array(x.to_pandas(), object)
            *sides, many = [{**{c: x[at] for c, x in values.items()}, "area": t["area"][at]} for at in (d, g, h)]
            i, j, similar = _similar_pairs(*sides, group[d], group[g], t["crowd"][g], within, float(thrs.min()))
            at = g[j]
            ignored = _ignored({"ignore": t["ignore"][at], "gt_area": t["area"][at]}, areas)
            chosen = assign(i, group[d][i], t["id"][at], similar, t["crowd"][at], ignored, len(d), thrs)
            more = {"open": open_[group[d]]} if marked else {}
            if group_of:
                i, j, similar = _similar_pairs(sides[0], many, group[d], group[h], np.zeros(len(h), bool), within, float(thrs.min()))
                by = np.lexsort((t["id"][h[j]], similar, i))
                i, j, similar = i[by], j[by], similar[by]
                best = np.flatnonzero(np.diff(i, append=-1))
                more |= {"group_iou": np.full(len(d), -np.inf), "group_id": np.zeros(len(d), np.int64)}
                more["group_iou"][i[best]], more["group_id"][i[best]] = similar[best], t["id"][h[j[best]]]
            yield from finish({**{c: t[c][d] for c in ("image_id", "category_id", "id", "score", "area")}, "rank": rank, **more}, chosen, t["id"][at], ignored)

    return rows.repartition(F.xxhash64("image_id", "category_id")).sortWithinPartitions("image_id", "category_id").mapInArrow(run, schema)


def _type(dt: DataFrame, gt: DataFrame, column: Column, own: bool) -> str:
    return (dt if own else gt).select(column).schema[0].dataType.simpleString()


def _outcome(mine: Values, chosen: np.ndarray, ignored: np.ndarray, params: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each area range whether detections are unmatched and whether they are ignored, over thresholds."""
    ignored = np.concatenate([ignored, np.zeros((1, ignored.shape[1]), bool)])  # the last entry, -1, stands for none
    for a, (_, low, high) in enumerate(params.areas):
        none = chosen[:, a] < 0
        out = (mine["area"] < low) | (mine["area"] > high)
        yield none, np.where(none, out[:, None], ignored[chosen[:, a], a])


def evaluate(gt: DataFrame, dt: DataFrame, params: Params, pairs: Pairs = box_pairs, group_of: bool = False, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dt_eval, counts): detections as ``evaluated`` gives them, and ``gt_counts``; ``pairs`` gives the similarity.

    With ``group_of``, ground truth whose is_group_of is true counts as none
    and makes matches of unmatched detections on it, as many as there are.
    ``marks`` (image_id, category_id, mark) say what is known of a group:
    detections of groups without ground truth or an ABSENT mark are dropped,
    unmatched ones of an OPEN group are ignored.  Both need pairs that have
    ``within``.
    """
    counts = gt_counts(pooled(gt.where(~F.coalesce("is_group_of", F.lit(False))) if group_of else gt, params), params)
    within = getattr(pairs, "within", None)
    if within is None:
        if group_of or marks is not None:
            raise TypeError("these pairs have no similarity within groups")
        gt, dt = pooled(gt, params), ranked(dt, params)
        return evaluated(dt, pairs(dt, gt), params), counts

    thrs, marked = np.array(params.iou_thrs), marks is not None

    def finish(mine: Values, chosen: np.ndarray, gt_id: np.ndarray, ignored: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = [pa.array(mine[c]) for c in ("image_id", "category_id")]
        some = [pa.array(mine["rank"].astype(np.int32)), pa.array(mine["id"]), pa.array(mine["score"])]
        gt_id = np.append(gt_id, 0)
        for a, (none, skip) in enumerate(_outcome(mine, chosen, ignored, params)):
            taken = gt_id[chosen[:, a]]
            if marked:
                skip = skip | mine["open"][:, None] & none
            if group_of:
                now = none & (mine["group_iou"][:, None] >= thrs)
                taken, none, skip = np.where(now, mine["group_id"][:, None], taken), none & ~now, skip & ~now
            yield pa.record_batch([*ids, pa.array(np.full(len(none), a, np.int32)), *some, _lists(taken, none), _lists(~none), _lists(skip)], names=["image_id", "category_id", "a", "rank", "dt_id", "score", "gt", "matched", "ignored"])

    schema = "image_id bigint, category_id bigint, a int, rank int, dt_id bigint, score double, gt array<bigint>, matched array<boolean>, ignored array<boolean>"
    return _in_groups(gt, dt, params, within, finish, schema, group_of, marks), counts


def packed(gt: DataFrame, dt: DataFrame, params: Params, pairs: Pairs = box_pairs) -> DataFrame:
    """image_id, category_id, rank, score of the detections that count anywhere, and a bit for each area range and threshold: tp0, ... and fp0, ... in words.

    What a curve needs of ``evaluate``, in one narrow row for all area ranges.
    """
    n = len(params.areas) * len(params.iou_thrs)
    names = [f"{x}{i}" for x in ("tp", "fp") for i in range(-(-n // WORD))]

    def finish(mine: Values, chosen: np.ndarray, gt_id: np.ndarray, ignored: np.ndarray) -> Iterator[pa.RecordBatch]:
        tp, fp = (np.concatenate(x, axis=1) for x in zip(*((~none & ~skip, none & ~skip) for none, skip in _outcome(mine, chosen, ignored, params))))
        packed_ = [x[:, i : i + WORD] @ (1 << np.arange(min(WORD, n - i), dtype=np.int64)) for x in (tp, fp) for i in range(0, n, WORD)]
        some = np.flatnonzero(np.any(packed_, axis=0))
        ids = [mine["image_id"], mine["category_id"], mine["rank"].astype(np.int32), mine["score"]]
        yield pa.record_batch([pa.array(x[some]) for x in (*ids, *packed_)], names=["image_id", "category_id", "rank", "score", *names])

    within = getattr(pairs, "within", None)
    if within is None:
        raise TypeError("these pairs have no similarity within groups")
    return _in_groups(gt, dt, params, within, finish, "image_id bigint, category_id bigint, rank int, score double, " + ", ".join(f"{x} bigint" for x in names))


def npig(gt: DataFrame, params: Params) -> DataFrame:
    """category_id, a, npig: ``total`` of ``gt_counts`` without a row for each image in between."""
    counts = [F.count_if(~ignored_always(gt) & F.coalesce("area", F.lit(0.0)).between(lo, hi)) for _, lo, hi in params.areas]
    return pooled(gt, params).groupBy("category_id").agg(F.array(*counts).alias("n")).select("category_id", F.posexplode("n").alias("a", "npig"))
