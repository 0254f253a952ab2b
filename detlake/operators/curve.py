"""Precision and recall from matched detections: totals of ranges of scores, then one pass over each range from its end."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.operators.params import Params, WORD

#: Ranges of scores that a category is cut into, and how many there are of all categories together.
RANGES, GROUPS = 64, 4096
#: Rows that a task holds at a time.
HELD = 1 << 16
#: Rows kept for the second pass, of the last few curves; older ones are given back.
_kept: deque[DataFrame] = deque()


def reached(recall: Column, n: int = 101) -> Column:
    """How many of the recall thresholds i / (n - 1) are at most ``recall``, compared as doubles."""
    top = n - 1
    f = F.floor(recall * top)
    up = (f + 1).cast("double") / top <= recall
    down = f.cast("double") / top > recall
    return F.least(F.lit(n), f + 1 + up.cast("int") - down.cast("int")).cast("int")


def score_bounds(rows: DataFrame, ranges: int = RANGES) -> list[float]:
    """Bounds that cut the scores of rows into ranges of about equal size; worth a pass where rows are kept."""
    return sorted(set(rows.approxQuantile("score", [i / ranges for i in range(1, ranges)], 0.5 / ranges)))


def narrow(dt_eval: DataFrame, params: Params, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, category_id, a, score, image_id, rank and a bit for each threshold: tp0, tp1, ... and fp0, ... in words. Rows that change no sum are left out."""
    n_t = len(params.iou_thrs)

    def bits(f, low: int) -> Column:
        return sum((F.when(f(t), F.lit(1 << t - low).cast("bigint")).otherwise(0) for t in range(low, min(low + WORD, n_t))), F.lit(0).cast("bigint"))

    n_w = -(-n_t // WORD)
    tp = [bits(lambda t: F.col("matched")[t] & ~F.col("ignored")[t], i * WORD).alias(f"tp{i}") for i in range(n_w)]
    fp = [bits(lambda t: ~F.col("matched")[t] & ~F.col("ignored")[t], i * WORD).alias(f"fp{i}") for i in range(n_w)]
    return dt_eval.select(*keys, "category_id", "a", "score", "image_id", "rank", *tp, *fp).where(" or ".join(f"tp{i} <> 0 or fp{i} <> 0" for i in range(n_w)))


def _flags(table: pa.Table, name: str, n: int) -> np.ndarray:
    """The bits of name0, name1, ...: [flag, row]."""
    out, i = [], 0
    while i * WORD < n:
        word = np.ascontiguousarray(table.column(f"{name}{i}").to_numpy())
        bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(bits[:, : min(WORD, n - i * WORD)].T)
        i += 1
    return np.ascontiguousarray(np.concatenate(out)).astype(bool)


def _held(batches: Iterator[pa.RecordBatch], rows: int = HELD) -> Iterator[pa.Table]:
    """Batches put together to tables of about as many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _segments(table: pa.Table, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """key, start and stop of each stretch of rows that agree in the columns."""
    new = np.zeros(len(table), bool)
    new[0] = True
    for c in columns:
        x = table.column(c)
        x = x.to_numpy() if not pa.types.is_string(x.type) else x.combine_chunks().dictionary_encode().indices.to_numpy() if x.num_chunks == 1 else np.array(x.to_pylist(), object)
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    heads = [table.column(c).take(pa.array(first)).to_pylist() for c in columns]
    for i, key in enumerate(zip(*heads)):
        yield key, int(first[i]), int(first[i + 1]) if i + 1 < len(first) else len(table)


def _reached(recall: np.ndarray, n: int) -> np.ndarray:
    """``reached`` on arrays."""
    top = n - 1
    f = np.floor(recall * top)
    return np.minimum(n, f + 1 + ((f + 1) / top <= recall) - (f / top > recall)).astype(np.int32)


def _keep(rows: DataFrame) -> DataFrame:
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    while len(_kept) > 4:
        _kept.popleft().unpersist()
    return kept


def curve(dt_eval: DataFrame, npig: DataFrame, params: Params, keys: tuple[str, ...] = (), bounds: list[float] | None = None, n_sets: int = 0) -> DataFrame:
    """keys, category_id, a, m, t, tp, npig, recall, precision (envelope), score, low, high of the detections that the curve turns on.

    These are the ones at which a recall threshold is first reached, those
    numbered low (inclusive) to high (exclusive), so the as-of lookup of each
    threshold is this interval and no join; and the first and last true
    positive of each range of scores.  ``bounds`` cut the scores (``score_bounds``).

    dt_eval is as ``matching.evaluated`` gives it, ``narrow``, or ``packed``
    (all area ranges in one row).  Detections rank by score, then image and
    rank in it.  Rows are cut into ranges of scores, so that a category is
    dealt over many tasks, and kept sorted from the last to the first.  One
    pass counts each range; these totals go through the driver.  With them the
    other pass knows the sums at every row, and carries the largest precision
    so far: neither holds more than ``HELD`` rows.

    With n_sets, rows have a bigint ``sets`` whose bit i says whether the row
    is in set i, and each set has a curve: column ``set``, in npig as well.
    """
    own_area = "a" in dt_eval.columns
    rows = dt_eval if "tp0" in dt_eval.columns else narrow(dt_eval, params, keys)
    n_a, n_m, n_t, n_r, n_s = 1 if own_area else len(params.areas), len(params.max_dets), len(params.iou_thrs), len(params.rec_thrs), max(n_sets, 1)
    caps, n_w = list(params.max_dets), -(-n_a * n_t // WORD)
    head = [*keys, "category_id", *(["a"] if own_area else [])]
    sets = ["set"] if n_sets else []
    known: dict[tuple, np.ndarray] = {}
    of = [k for k in keys if k in npig.columns]
    place = [i for i, k in enumerate(head) if k in of or k in ("category_id", "a")]
    for r in npig.where("npig > 0").select(*of, "category_id", "a", *sets, "npig").collect():  # a row for each category and area range
        key = (*(r[k] for k in of), r["category_id"], *([r["a"]] if own_area else []))
        known.setdefault(key, np.zeros((n_s, n_a), np.int64))[r["set"] if n_sets else 0, 0 if own_area else r["a"]] = r["npig"]
    if bounds is None:
        ranges = max(1, min(RANGES, GROUPS // max(1, len(known))))
        bounds = [i / ranges for i in range(1, ranges)]
    part = [*head, "range"]
    number = F.lit(len(bounds)) - (F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col("score") >= b)) if bounds else F.lit(0))
    if len(bounds) > 1 and bounds == [i / (len(bounds) + 1) for i in range(1, len(bounds) + 1)]:
        number = F.lit(len(bounds)) - F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")) * (len(bounds) + 1))
        number = F.greatest(F.lit(0), number)
    flags = [f"{x}{i}" for x in ("tp", "fp") for i in range(n_w)]
    rows = rows.select(*head, number.cast("int").alias("range"), "score", "image_id", "rank", *flags, *(["sets"] if n_sets else []))
    kept = _keep(rows.repartition(*part).sortWithinPartitions(*part, "score", F.col("image_id").desc(), F.col("rank").desc()))

    def members(table: pa.Table) -> np.ndarray:
        if not n_sets:
            return np.ones((1, len(table)), bool)
        word = np.ascontiguousarray(table.column("sets").to_numpy())
        return np.ascontiguousarray(np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :n_sets].T).astype(bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for table in _held(batches):
            both = [_flags(table, x, n_a * n_t) for x in ("tp", "fp")]
            rank, inside = table.column("rank").to_numpy(), members(table)
            for key, start, stop in _segments(table, part):
                sums = found.setdefault(key, np.zeros((2, n_s, n_m, n_a * n_t), np.int64))
                for s in range(n_s):
                    for m, cap in enumerate(caps):
                        chosen = inside[s, start:stop] & (rank[start:stop] <= cap)
                        for i in (0, 1):
                            sums[i, s, m] += np.count_nonzero(both[i][:, start:stop] & chosen, axis=1)
        if found:
            columns = [pa.array(x, type=f.type) for x, f in zip(zip(*found), fields_of(table, part))]
            yield pa.record_batch([*columns, pa.array([x.ravel().tolist() for x in found.values()], pa.list_(pa.int64()))], names=[*part, "sums"])

    def fields_of(table: pa.Table, names: list[str]) -> list[pa.Field]:
        return [table.schema.field(c) for c in names]

    named = {c: rows.schema[c].dataType.simpleString() for c in part}
    parts = kept.mapInArrow(count, ", ".join(f"`{c}` {t}" for c, t in named.items()) + ", sums array<bigint>").collect()
    totals: dict[tuple, dict[int, np.ndarray]] = {}
    for r in parts:
        at = totals.setdefault(tuple(r[c] for c in head), {})
        sums = np.array(r["sums"], np.int64).reshape(2, n_s, n_m, n_a * n_t)
        at[r["range"]] = at[r["range"]] + sums if r["range"] in at else sums
    ends: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for key, at in totals.items():
        n = known.get(tuple(key[i] for i in place))
        if n is None:
            continue
        before = np.zeros((2, n_s, n_m, n_a * n_t), np.int64)
        for i in sorted(at):
            ends[*key, i] = (n, before, before + at[i])
            before = before + at[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, best = None, None, None
        for table in _held(batches):
            tp_flags, fp_flags = (_flags(table, x, n_a * n_t) for x in ("tp", "fp"))
            rank, score, inside = table.column("rank").to_numpy(), table.column("score").to_numpy(), members(table)
            for key, start, stop in _segments(table, part):
                if key not in ends:
                    continue
                n, before, end = ends[key]
                if key != last:
                    last, seen, best = key, np.zeros((2, n_s, n_m, n_a * n_t), np.int64), np.zeros((n_s, n_m, n_a * n_t))
                out: list[tuple] = []
                for s in range(n_s):
                    for m, cap in enumerate(caps):
                        rows_in = np.flatnonzero(inside[s, start:stop] & (rank[start:stop] <= cap)) + start
                        if not len(rows_in):
                            continue
                        for b in range(n_a * n_t):
                            a, t = divmod(b, n_t)
                            true = tp_flags[b, rows_in]
                            at = np.flatnonzero(true)
                            false = fp_flags[b, rows_in]
                            n_false = np.count_nonzero(false)
                            if len(at) and n[s, a]:
                                behind = np.cumsum(false)[at] if n_false else 0
                                tp = end[0, s, m, b] - seen[0, s, m, b] - np.arange(len(at))
                                fp = end[1, s, m, b] - seen[1, s, m, b] - behind
                                env = np.maximum.accumulate(np.maximum(tp / (tp + fp), best[s, m, b]))
                                best[s, m, b] = env[-1]
                                high = _reached(tp / n[s, a], n_r)
                                low = np.where(tp == 1, 0, _reached((tp - 1) / n[s, a], n_r))
                                turn = np.flatnonzero((high > low) | (tp == end[0, s, m, b]) | (tp == before[0, s, m, b] + 1))
                                if len(turn):
                                    out.append((np.full((len(turn), 4), (s, a, m, t), np.int32), tp[turn], np.full(len(turn), n[s, a]), tp[turn] / n[s, a], env[turn], score[rows_in[at[turn]]], low[turn], high[turn]))
                            seen[0, s, m, b] += len(at)
                            seen[1, s, m, b] += n_false
                if out:
                    cells_, *values = (np.concatenate(x) for x in zip(*out))
                    size = len(cells_)
                    heads = [pa.array([v] * size, f.type) for v, f in zip(key, fields_of(table, head))]
                    area = [] if own_area else [pa.array(cells_[:, 1])]
                    names = [*head, *([] if own_area else ["a"]), *sets, "m", "t", "tp", "npig", "recall", "precision", "score", "low", "high"]
                    ids = [*area, *([pa.array(cells_[:, 0])] if n_sets else []), pa.array(cells_[:, 2]), pa.array(cells_[:, 3])]
                    kinds = [np.int64, np.int64, float, float, float, np.int32, np.int32]
                    yield pa.record_batch([*heads, *ids, *(pa.array(v.astype(k)) for v, k in zip(values, kinds))], names=names)

    shape = ", ".join(f"`{c}` {named[c]}" for c in head) + ("" if own_area else ", a int") + (", set int" if n_sets else "")
    points = kept.mapInArrow(run, f"{shape}, m int, t int, tp bigint, npig bigint, recall double, precision double, score double, low int, high int")
    behind = Window.partitionBy(*keys, "category_id", "a", *sets, "m", "t").orderBy(F.col("tp").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("precision", F.max("precision").over(behind))


def cells(points: DataFrame, npig: DataFrame, params: Params, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, category_id, a, m, t, ap, recall of every cell with ground truth; 0 where no detection matched."""
    n_r = len(params.rec_thrs)
    part = [*keys, "category_id", "a", "m", "t"]
    # Summed in order of recall, so that every run gives the same bits.
    steps = F.array_sort(F.collect_list(F.when(F.col("high") > F.col("low"), F.struct("low", (F.col("precision") * (F.col("high") - F.col("low"))).alias("x")))))
    ap = points.groupBy(*part).agg((F.aggregate(steps, F.lit(0.0), lambda total, s: total + s["x"]) / n_r).alias("ap"), F.max("recall").alias("recall"))
    grid = npig.where("npig > 0").select(*keys, "category_id", "a", F.explode(F.sequence(F.lit(0), F.lit(len(params.max_dets) - 1))).alias("m")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(params.iou_thrs) - 1))).alias("t"))
    return grid.join(ap, part, "left").fillna(0.0, ["ap", "recall"])


def samples(points: DataFrame, params: Params) -> DataFrame:
    """category_id, a, m, t, r, precision, score at every recall threshold that is reached."""
    return points.where("high > low").select("category_id", "a", "m", "t", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("r"), "precision", "score")
