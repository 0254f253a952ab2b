"""DuckDB SQL for the detection queries, by a different route: greedy matching is recursion over ranks."""

from __future__ import annotations

from detlake.operators.params import OKS_SIGMAS
from detlake.scene import CTES

_AREAS = "(VALUES (0, 0.0::DOUBLE, 1e10::DOUBLE), (1, 0.0::DOUBLE, 1024.0::DOUBLE), (2, 1024.0::DOUBLE, 9216.0::DOUBLE), (3, 9216.0::DOUBLE, 1e10::DOUBLE)) v(a, lo, hi)"
_IOU = "(greatest(0.0::DOUBLE, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * greatest(0.0::DOUBLE, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y)))"


def _iou(crowd: str = "false") -> str:
    inter = _IOU.format(a="d.", b="g.")
    return f"(CASE WHEN {crowd} THEN {inter} / (d.w * d.h) ELSE {inter} / (d.w * d.h + g.w * g.h - {inter}) END)"


def evaluation(n_t: int = 10, n_a: int = 4, dt: str = "dt", gt: str = "gt", s: str = "", cap: int = 100, pairs: str = "", ignore: str = "iscrowd", only: str = "true") -> str:
    """CTEs dtr, ev (a row per detection, area and threshold) and npig, with a suffix to their names.

    pairs replaces the box pairs, ignore says what ground truth counts nowhere, only picks area ranges.
    """
    pairs = pairs or f"SELECT d.image_id, d.category_id, d.rank, g.id AS gt_id, g.iscrowd AS crowd, g.{ignore} AS skip, g.area AS gt_area, {_iou('g.iscrowd')} AS iou FROM dtr{s} d JOIN {gt} g ON d.image_id = g.image_id AND d.category_id = g.category_id WHERE d.x < g.x + g.w AND g.x < d.x + d.w AND d.y < g.y + g.h AND g.y < d.y + d.h"
    return f"""
dtr{s} AS (SELECT * FROM (SELECT *, w * h AS area, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, id) AS rank FROM {dt}) q WHERE rank <= {cap}),
ar{s} AS (SELECT * FROM {_AREAS} WHERE a < {n_a} AND {only}), th{s} AS (SELECT t::INTEGER AS t, 0.5::DOUBLE + 0.05::DOUBLE * t AS thr FROM range({n_t}) q(t)),
pr{s} AS ({pairs}),
cd{s} AS (SELECT image_id, category_id, rank, a, list({{'gt': gt_id, 'iou': iou, 'crowd': crowd, 'ig': skip OR gt_area < lo OR gt_area > hi}} ORDER BY (skip OR gt_area < lo OR gt_area > hi), iou DESC, gt_id DESC) AS c FROM pr{s}, ar{s} WHERE iou >= 0.5 GROUP BY ALL),
nx{s} AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id, a ORDER BY rank) AS n FROM cd{s}),
mt{s} AS (SELECT image_id, category_id, a, t, thr, 0::BIGINT AS n, 0::BIGINT AS rank, []::BIGINT[] AS used, NULL::BIGINT AS gt, false AS ig FROM (SELECT DISTINCT image_id, category_id, a FROM nx{s}), th{s}
 UNION ALL SELECT image_id, category_id, a, t, thr, n, rank, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.gt) END, p.gt, coalesce(p.ig, false)
 FROM (SELECT m.image_id, m.category_id, m.a, m.t, m.thr, x.n, x.rank, m.used, list_filter(x.c, lambda e: e.iou >= m.thr AND (e.crowd OR NOT list_contains(m.used, e.gt)))[1] AS p FROM mt{s} m JOIN nx{s} x ON x.image_id = m.image_id AND x.category_id = m.category_id AND x.a = m.a AND x.n = m.n + 1) q),
ev{s} AS (SELECT d.image_id, d.category_id, d.rank, d.id AS dt_id, d.score, ar.a, th.t, m.gt, m.gt IS NOT NULL AS matched, CASE WHEN m.gt IS NULL THEN d.area < ar.lo OR d.area > ar.hi ELSE m.ig END AS ignored
 FROM dtr{s} d CROSS JOIN ar{s} ar CROSS JOIN th{s} th LEFT JOIN (SELECT * FROM mt{s} WHERE gt IS NOT NULL) m ON m.image_id = d.image_id AND m.category_id = d.category_id AND m.rank = d.rank AND m.a = ar.a AND m.t = th.t),
npig{s} AS (SELECT category_id, a, count(*) FILTER (NOT {ignore} AND area BETWEEN lo AND hi) AS npig FROM {gt}, ar{s} GROUP BY category_id, a)"""


def points(keys: str = "", s: str = "", ev: str = "ev", npig: str = "npig", caps: str = "(0, 1), (1, 10), (2, 100)") -> str:
    """CTE pt (true positives with recall, envelope and thresholds reached) and cell."""
    k = f"{keys}, " if keys else ""
    kj = "".join(f"n.{x.strip()} = p.{x.strip()} AND " for x in keys.split(",") if x.strip())
    return f"""
rk{s} AS (SELECT {k}category_id, a, m, t, score, image_id, rank, matched AND NOT ignored AS tp, NOT matched AND NOT ignored AS fp FROM {ev}, (VALUES {caps}) c(m, cap) WHERE rank <= cap),
sm{s} AS (SELECT *, sum(tp::INT) OVER w AS tps, sum(fp::INT) OVER w AS fps FROM rk{s} WINDOW w AS (PARTITION BY {k}category_id, a, m, t ORDER BY score DESC, image_id, rank)),
en{s} AS (SELECT *, max(CASE WHEN tps + fps = 0 THEN 0.0::DOUBLE ELSE tps::DOUBLE / (tps + fps) END) OVER (PARTITION BY {k}category_id, a, m, t ORDER BY score DESC, image_id, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM sm{s}),
pt{s} AS (SELECT {''.join('p.' + x.strip() + ', ' for x in keys.split(',') if x.strip())}p.category_id, p.a, p.m, p.t, p.score, tps, npig, tps::DOUBLE / npig AS recall, (tps - 1)::DOUBLE / npig AS before, env FROM en{s} p JOIN {npig} n ON {kj}n.category_id = p.category_id AND n.a = p.a WHERE tp AND npig > 0),
sa{s} AS (SELECT pt.*, r.r FROM pt{s} pt JOIN (SELECT r::INTEGER AS r, r::DOUBLE / 100.0::DOUBLE AS rt FROM range(101) q(r)) r ON r.rt <= pt.recall AND (r.rt > pt.before OR pt.tps = 1)),
cell{s} AS (SELECT {''.join('n.' + x.strip() + ', ' for x in keys.split(',') if x.strip())}n.category_id, n.a, c.m, th.t, coalesce(any_value(x.ap), 0) AS ap, coalesce(any_value(y.recall), 0) AS recall FROM {npig} n CROSS JOIN (VALUES {caps}) c(m, cap) CROSS JOIN (SELECT DISTINCT t FROM {ev}) th
 LEFT JOIN (SELECT {k}category_id, a, m, t, sum(env) / 101 AS ap FROM sa{s} GROUP BY ALL) x ON {kj.replace('p.', 'x.')}x.category_id = n.category_id AND x.a = n.a AND x.m = c.m AND x.t = th.t
 LEFT JOIN (SELECT {k}category_id, a, m, t, max(recall) AS recall FROM pt{s} GROUP BY ALL) y ON {kj.replace('p.', 'y.')}y.category_id = n.category_id AND y.a = n.a AND y.m = c.m AND y.t = th.t WHERE npig > 0 GROUP BY ALL)"""


_W = f"WITH RECURSIVE {CTES}"
_ONE = evaluation(1, 1)
_SUMMARY = {"AP": "avg(ap) FILTER (a = 0 AND m = 2)", "AP50": "avg(ap) FILTER (a = 0 AND m = 2 AND t = 0)", "AP75": "avg(ap) FILTER (a = 0 AND m = 2 AND t = 5)", "APs": "avg(ap) FILTER (a = 1 AND m = 2)", "APm": "avg(ap) FILTER (a = 2 AND m = 2)", "APl": "avg(ap) FILTER (a = 3 AND m = 2)", "AR1": "avg(recall) FILTER (a = 0 AND m = 0)", "AR10": "avg(recall) FILTER (a = 0 AND m = 1)", "AR100": "avg(recall) FILTER (a = 0 AND m = 2)", "ARs": "avg(recall) FILTER (a = 1 AND m = 2)", "ARm": "avg(recall) FILTER (a = 2 AND m = 2)", "ARl": "avg(recall) FILTER (a = 3 AND m = 2)"}


def _table(expressions: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, round(coalesce({v}, -1), 8) AS value FROM {source}" for k, v in expressions.items())


_BINS = "least(greatest(floor(score * 10), 0), 9)::INTEGER"
_LAST = points(caps="(0, 100)")
_STATUS = """d AS (SELECT image_id, category_id, dt_id, score, rank, matched AS is_tp, gt FROM ev WHERE NOT ignored), g AS (SELECT gt.*, u.gt IS NOT NULL AS is_matched FROM gt LEFT JOIN (SELECT image_id, gt FROM ev WHERE NOT ignored AND matched) u ON u.image_id = gt.image_id AND u.gt = gt.id WHERE NOT iscrowd)"""
_STEPS = ("Cls", "Loc", "Both", "Dupe", "Bkg")
#: Boxes cut at the image.
_CLIP = "greatest(x, 0) AS x, greatest(y, 0) AS y, greatest(0, least(x + w, 680) - greatest(x, 0)) AS w, greatest(0, least(y + h, 500) - greatest(y, 0)) AS h"
#: Keypoint pairs of the scene: point i lies at (7 i mod w, 5 i mod h) in its box.
_OKS = """SELECT d.image_id, d.category_id, d.rank, g.id AS gt_id, g.iscrowd AS crowd, g.skip, g.area AS gt_area, CASE WHEN g.id % 7 = 0
 THEN list_sum(list_transform(range(17), lambda i: exp(-(pow(greatest(0, g.x - g.w - (d.x + (i * 7) % d.w)) + greatest(0, d.x + (i * 7) % d.w - (g.x + 2 * g.w)), 2) + pow(greatest(0, g.y - g.h - (d.y + (i * 5) % d.h)) + greatest(0, d.y + (i * 5) % d.h - (g.y + 2 * g.h)), 2)) / pow(2 * k.s[i + 1], 2) / (g.area + 2.220446049250313e-16) / 2))) / 17
 ELSE list_sum(list_transform(range(17), lambda i: CASE WHEN (g.id + i) % 3 > 0 THEN exp(-(pow(d.x + (i * 7) % d.w - g.x - (i * 7) % g.w, 2) + pow(d.y + (i * 5) % d.h - g.y - (i * 5) % g.h, 2)) / pow(2 * k.s[i + 1], 2) / (g.area + 2.220446049250313e-16) / 2) ELSE 0 END)) / len(list_filter(range(17), lambda i: (g.id + i) % 3 > 0)) END AS iou
 FROM dtr d JOIN gtk g ON d.image_id = g.image_id AND d.category_id = g.category_id, (SELECT """ + f"{OKS_SIGMAS}" + """::DOUBLE[] AS s) k"""
ORACLES = {
    "det_summary": f"{_W}, {evaluation()}, {points()} {_table(_SUMMARY, 'cell')}",
    "det_pooled_summary": f"{_W}, gtp AS (SELECT * REPLACE (-1 AS category_id) FROM gt), dtp AS (SELECT * REPLACE (-1 AS category_id) FROM dt), {evaluation(1, 4, 'dtp', 'gtp')}, {points()} {_table({k: _SUMMARY[k] for k in ('AP', 'AP50')}, 'cell')}",
    "det_per_category": f"{_W}, {evaluation(10, 1)}, {_LAST} SELECT category_id, round(avg(ap), 8) AS ap FROM cell GROUP BY category_id",
    "det_pr_samples": f"{_W}, {evaluation(10, 1)}, {_LAST} SELECT category_id, t, r, round(env, 8) AS precision, round(score, 8) AS score FROM sa",
    "det_f_scores": f"{_W}, {evaluation(10, 1)}, {_LAST}, fb AS (SELECT category_id, t, max(CASE WHEN env + r / 100.0::DOUBLE > 0 THEN 2 * env * (r / 100.0::DOUBLE) / (env + r / 100.0::DOUBLE) ELSE 0 END) AS f FROM sa GROUP BY ALL), ff AS (SELECT c.t, coalesce(f, 0) AS f FROM cell c LEFT JOIN fb USING (category_id, t)) {_table({'F1': 'avg(f)', 'F150': 'avg(f) FILTER (t = 0)', 'F175': 'avg(f) FILTER (t = 5)'}, 'ff')}",
    "det_matches": f"{_W}, {evaluation()} SELECT category_id, a, t, count(*) FILTER (matched) AS n_matched, count(*) FILTER (ignored) AS n_ignored, sum(coalesce(gt, 0))::BIGINT AS gt_sum FROM ev GROUP BY ALL",
    "det_pairs": f"{_W}, {_ONE} SELECT category_id, count(*) AS n, count(*) FILTER (iou >= 0.5) AS n_half, sum(floor(iou * 1000000))::BIGINT AS checksum FROM pr GROUP BY category_id",
    "det_confusion": f"""{_W}, gx AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY category_id, id) AS pos FROM gt WHERE NOT iscrowd), dx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, category_id, id) AS rank FROM dt) q WHERE rank <= 100),
 px AS (SELECT d.image_id, d.rank, list({{'pos': g.pos, 'iou': {_iou()}}} ORDER BY {_iou()} DESC, g.pos DESC) AS c FROM dx d JOIN gx g ON d.image_id = g.image_id WHERE {_iou()} >= 0.5 GROUP BY ALL), nx AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rank) AS n FROM px),
 mx AS (SELECT image_id, 0::BIGINT AS n, 0::BIGINT AS rank, []::BIGINT[] AS used, NULL::BIGINT AS pos FROM (SELECT DISTINCT image_id FROM nx) UNION ALL SELECT image_id, n, rank, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.pos) END, p.pos FROM (SELECT m.image_id, x.n, x.rank, m.used, list_filter(x.c, lambda e: NOT list_contains(m.used, e.pos))[1] AS p FROM mx m JOIN nx x ON x.image_id = m.image_id AND x.n = m.n + 1) q),
 bx AS (SELECT coalesce(g.category_id, -1) AS gt_category_id, coalesce(d.category_id, -1) AS dt_category_id FROM (SELECT dx.image_id, dx.category_id, mx.pos FROM dx LEFT JOIN mx ON mx.image_id = dx.image_id AND mx.rank = dx.rank AND mx.pos IS NOT NULL) d FULL JOIN gx g ON g.image_id = d.image_id AND g.pos = d.pos)
 SELECT gt_category_id, dt_category_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY gt_category_id), 8) AS share FROM bx GROUP BY gt_category_id, dt_category_id""",
    "det_calibration": f"{_W}, {_ONE} SELECT {_BINS} AS bin, count(*) AS n, round(avg(score), 8) AS confidence, round(avg(matched::INT), 8) AS accuracy FROM ev WHERE NOT ignored GROUP BY 1",
    "det_calibration_errors": f"{_W}, {_ONE}, b AS (SELECT category_id, {_BINS} AS bin, count(*) AS n, abs(avg(score) - avg(matched::INT)) AS gap FROM ev WHERE NOT ignored GROUP BY ALL) SELECT category_id, round(sum(n * gap) / sum(n), 8) AS ece, round(max(gap), 8) AS mce, sum(n)::BIGINT AS n_detections FROM b GROUP BY category_id",
    "det_error_types": f"""{_W}, {_ONE}, fps AS (SELECT e.image_id, e.dt_id, e.category_id, d.x, d.y, d.w, d.h FROM ev e JOIN dt d ON d.image_id = e.image_id AND d.id = e.dt_id WHERE NOT matched AND NOT ignored),
 qs AS (SELECT d.image_id, d.dt_id, g.id AS gt_id, g.category_id = d.category_id AS same, {_iou('g.iscrowd AND g.category_id = d.category_id')} AS iou, u.gt IS NOT NULL AS taken FROM fps d JOIN gt g ON g.image_id = d.image_id AND (g.category_id = d.category_id OR NOT g.iscrowd) LEFT JOIN (SELECT image_id, gt FROM ev WHERE gt IS NOT NULL GROUP BY ALL) u ON u.image_id = g.image_id AND u.gt = g.id),
 qt AS (SELECT image_id, dt_id, max(iou) FILTER (same) AS s, arg_max(gt_id, [iou, -gt_id]) FILTER (same AND iou > 0) AS sg, max(iou) FILTER (NOT same) AS x, arg_max(gt_id, [iou, -gt_id]) FILTER (NOT same AND iou > 0) AS xg, bool_or(same AND iou >= 0.5 AND taken) AS dupe FROM qs GROUP BY ALL),
 qe AS (SELECT f.image_id, f.dt_id, CASE WHEN coalesce(q.s, 0) >= 0.1 AND coalesce(q.s, 0) <= 0.5 THEN 'Loc' WHEN coalesce(q.x, 0) >= 0.5 THEN 'Cls' WHEN coalesce(dupe, false) THEN 'Dupe' WHEN coalesce(q.x, 0) <= 0.1 THEN 'Bkg' ELSE 'Both' END AS error, sg, xg FROM fps f LEFT JOIN qt q USING (image_id, dt_id)),
 ms AS (SELECT category_id, count(*) AS n FROM gt g WHERE NOT iscrowd AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.image_id = g.image_id AND ev.gt = g.id) AND NOT EXISTS (SELECT 1 FROM qe WHERE qe.image_id = g.image_id AND (error = 'Loc' AND sg = g.id OR error = 'Cls' AND xg = g.id)) GROUP BY category_id),
 sc AS (SELECT * FROM (VALUES ('base', [''], ['']), ('Cls', ['Cls'], ['']), ('Loc', ['Loc'], ['']), ('Both', [''], ['Both']), ('Dupe', [''], ['Dupe']), ('Bkg', [''], ['Bkg']), ('FP', ['Cls', 'Loc'], ['Both', 'Dupe', 'Bkg']), ('Miss', [''], [''])) v(scenario, up, off)),
 eb AS (SELECT scenario, e.category_id, 0 AS a, 0 AS t, e.score, e.image_id, e.rank, e.matched OR list_contains(up, coalesce(error, '-')) AS matched, e.ignored OR list_contains(off, coalesce(error, '-')) AS ignored FROM ev e LEFT JOIN qe USING (image_id, dt_id) CROSS JOIN sc UNION ALL SELECT 'Miss', category_id, 0, 0, 2.0, unnest(range(n)), 0, true, false FROM ms),
 ns AS (SELECT scenario, category_id, a, npig FROM npig, sc), {points('scenario', 'x', 'eb', 'ns', '(0, 100)')},
 av AS (SELECT scenario, avg(ap) AS ap FROM cellx GROUP BY scenario), dl AS (SELECT scenario AS error, CASE WHEN scenario = 'base' THEN ap ELSE ap - (SELECT ap FROM av WHERE scenario = 'base') END AS d FROM av),
 ct AS (SELECT error, count(*) AS n FROM qe GROUP BY error UNION ALL SELECT 'Miss', sum(n)::BIGINT FROM ms)
 SELECT error, coalesce(n, 0)::BIGINT AS n, round(d, 8) AS delta_ap FROM (SELECT * FROM dl UNION ALL SELECT 'FN', d FROM dl WHERE error = 'Miss') q LEFT JOIN ct USING (error)""",
    "det_image_diagnostics": f"""{_W}, {_ONE}, {_STATUS}, n AS (SELECT image_id, count(*) FILTER (k = 1) AS tp, count(*) FILTER (k = 2) AS fp, count(*) FILTER (k = 3) AS fn FROM (SELECT image_id, CASE WHEN is_tp THEN 1 ELSE 2 END AS k FROM d UNION ALL SELECT image_id, CASE WHEN is_matched THEN 0 ELSE 3 END FROM g) q GROUP BY image_id),
 r AS (SELECT d.*, sum(is_tp::INT) OVER w AS tps, sum((NOT is_tp)::INT) OVER w AS fps FROM d WINDOW w AS (PARTITION BY image_id ORDER BY score DESC, category_id, rank)), e AS (SELECT *, max(tps::DOUBLE / (tps + fps)) OVER (PARTITION BY image_id ORDER BY score DESC, category_id, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r),
 p AS (SELECT e.image_id, sum(env) / 101 AS ap FROM e JOIN n USING (image_id) JOIN (SELECT r::DOUBLE / 100.0::DOUBLE AS rt FROM range(101) q(r)) t ON rt <= tps::DOUBLE / (tp + fn) AND (rt > (tps - 1)::DOUBLE / (tp + fn) OR tps = 1) WHERE is_tp GROUP BY e.image_id)
 SELECT image_id, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 8) AS f1, round(CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(ap, 0) END, 8) AS ap, CASE WHEN fp = 0 AND fn = 0 THEN 'perfect' WHEN fp > 2 * fn THEN 'fp_heavy' WHEN fn > 2 * fp THEN 'fn_heavy' ELSE 'mixed' END AS profile FROM n LEFT JOIN p USING (image_id)""",
    "det_label_errors": f"""{_W}, {_ONE}, {_STATUS}, f AS (SELECT s.image_id, s.dt_id, s.category_id, s.score, x.x, x.y, x.w, x.h FROM d s JOIN dt x ON x.image_id = s.image_id AND x.id = s.dt_id WHERE NOT is_tp AND s.score >= 0.5),
 q AS (SELECT d.image_id, d.dt_id, g.id AS gt_id, g.category_id AS gt_category_id, NOT g.is_matched AND g.category_id <> d.category_id AS other, {_iou()} AS iou FROM f d JOIN g ON g.image_id = d.image_id),
 b AS (SELECT image_id, dt_id, arg_max({{'g': gt_id, 'c': gt_category_id, 'i': iou}}, [iou, -gt_id]) FILTER (other AND iou > 0) AS b, max(iou) AS top FROM q GROUP BY ALL), r AS (SELECT f.*, b, top FROM f LEFT JOIN b USING (image_id, dt_id))
 SELECT image_id, dt_id, category_id AS dt_category_id, round(score, 8) AS score, CASE WHEN b.i >= 0.5 THEN b.g ELSE -1 END AS gt_id, CASE WHEN b.i >= 0.5 THEN b.c ELSE -1 END AS gt_category_id, round(CASE WHEN b.i >= 0.5 THEN b.i ELSE 0 END, 8) AS iou, CASE WHEN b.i >= 0.5 THEN 'wrong_label' ELSE 'missing_annotation' END AS error FROM r WHERE coalesce(b.i >= 0.5, false) OR coalesce(top, 0) < 0.1""",
    "det_slices": f"""{_W}, {_ONE}, sl AS (SELECT 's' || id % 3 AS slice, id AS image_id FROM imgs UNION ALL SELECT '_overall', id FROM imgs), es AS (SELECT slice, ev.* FROM ev JOIN sl USING (image_id)), ns AS (SELECT slice, category_id, 0 AS a, count(*) FILTER (NOT iscrowd) AS npig FROM gt JOIN sl USING (image_id) GROUP BY ALL), {points('slice', 'x', 'es', 'ns', '(0, 100)')},
 v AS (SELECT slice, unnest(['AP', 'AP50']) AS metric, avg(ap) AS value FROM cellx GROUP BY slice) SELECT v.slice, v.metric, round(v.value, 8) AS value, round(v.value - o.value, 8) AS delta FROM v JOIN v o ON o.metric = v.metric AND o.slice = '_overall'""",
    "det_compare": f"{_W}, {_ONE}, {evaluation(1, 1, 'dt_b', 'gt', 'b')}, {_LAST}, {points('', 'b', 'evb', 'npigb', '(0, 100)')} SELECT unnest(['AP', 'AP50']) AS metric, round(x, 8) AS a, round(y, 8) AS b, round(y - x, 8) AS delta FROM (SELECT (SELECT avg(ap) FROM cell) AS x, (SELECT avg(ap) FROM cellb) AS y) q",
    "det_bootstrap": f"""{_W}, {_ONE}, {evaluation(1, 1, 'dt_b', 'gt', 'b')},
 im AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS number, count(*) OVER () AS n FROM ((SELECT image_id FROM gt UNION SELECT image_id FROM dt) INTERSECT (SELECT image_id FROM gt UNION SELECT image_id FROM dt_b)) q),
 dw AS (SELECT DISTINCT b.b, ((((42 * 7919 + b.b * 104729 + im.number * 1299709 + 12345) % 2147483647 * 48271 + 11) % 2147483647) * 48271 + 11) % 2147483647 % im.n AS number FROM range(5) b(b), im),
 sp AS (SELECT dw.b AS boot, im.image_id FROM dw JOIN im USING (number) UNION ALL SELECT -1, image_id FROM im),
 e1 AS (SELECT boot, ev.* FROM ev JOIN sp USING (image_id)), e2 AS (SELECT boot, evb.* FROM evb JOIN sp USING (image_id)), nb AS (SELECT boot, category_id, 0 AS a, count(*) FILTER (NOT iscrowd) AS npig FROM gt JOIN sp USING (image_id) GROUP BY ALL),
 {points('boot', 'x', 'e1', 'nb', '(0, 100)')}, {points('boot', 'y', 'e2', 'nb', '(0, 100)')},
 ap AS (SELECT boot, x.ap AS a, y.ap AS b, y.ap - x.ap AS delta FROM (SELECT boot, avg(ap) AS ap FROM cellx GROUP BY boot) x JOIN (SELECT boot, avg(ap) AS ap FROM celly GROUP BY boot) y USING (boot))
 SELECT 'AP' AS metric, round(p.a, 8) AS a, round(p.b, 8) AS b, round(p.delta, 8) AS delta, round(min(s.delta), 8) AS lower, round(max(s.delta), 8) AS upper, round(avg((s.delta > 0)::INT), 8) AS prob_positive, round(stddev_samp(s.delta), 8) AS std_err
 FROM ap p JOIN ap s ON p.boot = -1 AND s.boot >= 0 GROUP BY p.a, p.b, p.delta""",
    "snk_yolo": f"""{_W} SELECT 'im' || i.id AS stem, coalesce(string_agg(printf('%d %.6f %.6f %.6f %.6f', category_id - 1, (x + w / 2) / 680, (y + h / 2) / 500, w / 680, h / 500), chr(10) ORDER BY gt.id) FILTER (NOT iscrowd), '') AS text FROM imgs i LEFT JOIN gt ON gt.image_id = i.id GROUP BY i.id""",
    "snk_voc": f"""{_W} SELECT 'im' || i.id AS stem, '<annotation><filename>im' || i.id || '.jpg</filename><size><width>680</width><height>500</height><depth>3</depth></size>' || coalesce(string_agg(printf('<object><name>cat%d</name><difficult>%d</difficult><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>', category_id, iscrowd::INT, x::BIGINT, y::BIGINT, (x + w)::BIGINT, (y + h)::BIGINT), '' ORDER BY gt.id), '') || '</annotation>' AS text FROM imgs i LEFT JOIN gt ON gt.image_id = i.id GROUP BY i.id""",
    "snk_cvat": f"""{_W} SELECT i.id AS image_id, '<image id="' || i.id || '" name="im' || i.id || '.jpg" width="680" height="500">' || coalesce(string_agg(printf('<box label="cat%d" xtl="%.2f" ytl="%.2f" xbr="%.2f" ybr="%.2f" occluded="0"/>', category_id, x, y, x + w, y + h), '' ORDER BY gt.id), '') || '</image>' AS text FROM imgs i LEFT JOIN gt ON gt.image_id = i.id GROUP BY i.id""",
    "src_yolo": f"""{_W} SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY id) - 1)::INTEGER AS line, category_id, x, y, w, h FROM gt WHERE NOT iscrowd""",
    "src_json": f"""{_W} SELECT id, image_id, category_id, x, y, w, h, area, iscrowd::INTEGER AS iscrowd FROM gt""",
    "det_federated": f"""{_W}, dk AS (SELECT * FROM dt WHERE (image_id, category_id) IN (SELECT image_id, category_id FROM gt UNION ALL SELECT id, 1 + id % 4 FROM imgs)), {evaluation(1, 1, 'dk')}, eo AS (SELECT * REPLACE (ignored OR (NOT matched AND category_id = 1 + (image_id + 1) % 4) AS ignored) FROM ev), {points('', 'x', 'eo', 'npig', '(0, 100)')} SELECT category_id, round(avg(ap), 8) AS ap FROM cellx GROUP BY category_id""",
    "det_open_images": f"""{_W}, gp AS (SELECT * REPLACE (false AS iscrowd) FROM gt WHERE id % 31 <> 0), gg AS (SELECT * FROM gt WHERE id % 31 = 0), {evaluation(1, 1, 'dt', 'gp')}, gm AS (SELECT DISTINCT d.image_id, d.category_id, d.rank FROM dtr d JOIN gg g ON d.image_id = g.image_id AND d.category_id = g.category_id WHERE {_iou()} >= 0.5)
 SELECT ev.category_id, count(*) FILTER (matched OR gm.rank IS NOT NULL) AS n_matched, count(*) AS n, any_value(npig) AS npig FROM ev LEFT JOIN gm ON gm.image_id = ev.image_id AND gm.category_id = ev.category_id AND gm.rank = ev.rank JOIN npig ON npig.category_id = ev.category_id GROUP BY ev.category_id""",
    "det_masks": f"""{_W}, gtm AS (SELECT id, image_id, category_id, {_CLIP}, area, iscrowd FROM gt), dtm AS (SELECT id, image_id, category_id, {_CLIP}, score FROM dt), {evaluation(dt="dtm", gt="gtm")}, {points()} {_table(_SUMMARY, 'cell')}""",
    "det_keypoints": f"""{_W}, gtk AS (SELECT *, iscrowd OR id % 7 = 0 AS skip FROM gt), {evaluation(dt="dt", gt="gtk", cap=20, pairs=_OKS, ignore="skip", only="a <> 1")}, {points(caps="(0, 20)")}
 {_table({'AP': 'avg(ap) FILTER (a = 0)', 'AP50': 'avg(ap) FILTER (a = 0 AND t = 0)', 'AP75': 'avg(ap) FILTER (a = 0 AND t = 5)', 'APm': 'avg(ap) FILTER (a = 2)', 'APl': 'avg(ap) FILTER (a = 3)', 'AR': 'avg(recall) FILTER (a = 0)', 'AR50': 'avg(recall) FILTER (a = 0 AND t = 0)', 'AR75': 'avg(recall) FILTER (a = 0 AND t = 5)', 'ARm': 'avg(recall) FILTER (a = 2)', 'ARl': 'avg(recall) FILTER (a = 3)'}, 'cell')}""",
    "det_frequency": f"{_W}, {_ONE}, {_LAST}, f AS (SELECT CASE category_id WHEN 1 THEN 'r' WHEN 2 THEN 'c' ELSE 'f' END AS f, avg(ap) AS ap FROM cell GROUP BY category_id) SELECT 'AP' || f AS metric, round(avg(ap), 8) AS value FROM f GROUP BY f",
    "det_hierarchy": f"{_W}, anc AS (SELECT * FROM (VALUES (1, 5), (2, 5), (3, 6), (4, 6), (1, 7), (2, 7), (3, 7), (4, 7)) v(c, up)), ex AS (SELECT DISTINCT image_id, up, x, y, w, h FROM gt JOIN anc ON c = category_id) SELECT category_id, count(*) AS n, count(DISTINCT id) AS n_ids FROM gt GROUP BY 1 UNION ALL SELECT up, count(*), count(*) FROM ex GROUP BY 1",
    "ds_stats": f"{_W} SELECT unnest(['images', 'width_min', 'width_max', 'width_mean', 'width_median', 'height_min', 'height_max', 'height_mean', 'height_median', 'annotations', 'crowds', 'area_min', 'area_max', 'area_mean', 'area_median', 'categories']) AS metric, round(unnest([ni, 680, 680, 680, 680, 500, 500, 500, 500, na, nc, a1, a2, a3, a4, 4]::DOUBLE[]), 8) AS value FROM (SELECT (SELECT count(*) FROM imgs) AS ni, count(*) AS na, count(*) FILTER (iscrowd) AS nc, min(area) AS a1, max(area) AS a2, avg(area) AS a3, median(area) AS a4 FROM gt) q",
    "ds_category_stats": f"{_W} SELECT c.id AS category_id, c.name, count(gt.id) AS n_annotations, count(DISTINCT gt.image_id) AS n_images, count(*) FILTER (gt.iscrowd) AS n_crowds FROM cats c LEFT JOIN gt ON gt.category_id = c.id GROUP BY ALL",
    "ds_tree": f"{_W} SELECT supercategory, string_agg(name, ',' ORDER BY name) AS names FROM cats GROUP BY supercategory",
    "ds_ann_ids": f"{_W} SELECT id FROM gt WHERE category_id IN (1, 3) AND area BETWEEN 1024 AND 9216 AND NOT iscrowd",
    "ds_filter": f"{_W} SELECT image_id, count(*) AS n FROM gt WHERE category_id = 2 AND area <= 4000 GROUP BY image_id",
    "ds_split": f"{_W}, k AS (SELECT id, row_number() OVER (ORDER BY (((id % 2147483647) * 48271 + 42 * 7919 + 11) % 2147483647 * 48271 + 11) % 2147483647, id) AS r, floor(count(*) OVER () * 0.2 + 0.5) AS v, floor(count(*) OVER () * 0.1 + 0.5) AS t FROM imgs) SELECT CASE WHEN r <= v THEN 'val' WHEN r <= v + t THEN 'test' ELSE 'train' END AS part, id FROM k",
    "ds_sample": f"{_W} SELECT id FROM (SELECT id, row_number() OVER (ORDER BY (((id % 2147483647) * 48271 + 42 * 7919 + 11) % 2147483647 * 48271 + 11) % 2147483647, id) AS r, count(*) OVER () AS n FROM imgs) q WHERE r <= floor(n * 0.3)",
    "ds_merge": f"{_W} SELECT category_id, 2 * count(*) AS n, 2 * count(DISTINCT id) AS n_ids, (2 * sum(image_id) + count(*) * (SELECT max(id) FROM imgs))::BIGINT AS image_sum FROM gt GROUP BY category_id",
    "ds_health": f"""{_W}, e AS (SELECT gt.*, (SELECT count(*) FROM gt o WHERE o.image_id = gt.image_id AND o.category_id = gt.category_id AND o.id <> gt.id AND o.w > 0 AND o.h > 0 AND {_IOU.format(a='gt.', b='o.')} / (gt.w * gt.h + o.w * o.h - {_IOU.format(a='gt.', b='o.')}) > 0.95) AS dup FROM gt)
 SELECT 'duplicate_ann_id' AS code, 'structure' AS layer, id FROM (SELECT id, row_number() OVER (PARTITION BY id) AS r FROM gt) q WHERE r > 1 UNION ALL SELECT 'bbox_out_of_bounds', 'quality', id FROM gt WHERE x + w > 680 OR y + h > 500 UNION ALL SELECT 'extreme_aspect_ratio', 'quality', id FROM gt WHERE greatest(w, h) / least(w, h) > 20 UNION ALL SELECT DISTINCT 'near_duplicate', 'quality', id FROM e WHERE dup > 0""",
    "ds_health_summary": f"{_W}, c AS (SELECT category_id, count(*) AS n FROM gt GROUP BY 1) SELECT unnest(['images', 'annotations', 'categories', 'images_without_annotations', 'imbalance']) AS metric, round(unnest([(SELECT count(*) FROM imgs), (SELECT count(*) FROM gt), 4, (SELECT count(*) FROM imgs WHERE id NOT IN (SELECT image_id FROM gt)), (SELECT max(n) / min(n) FROM c)]::DOUBLE[]), 8) AS value",
    "ds_detection_health": f"{_W}, x AS (SELECT id, image_id, category_id, CASE WHEN id % 101 = 0 THEN NULL WHEN id % 103 = 0 THEN 1.5 ELSE score END AS score FROM dt) SELECT 'dt_orphan_image_id' AS code, id FROM x WHERE image_id NOT IN (SELECT image_id FROM gt WHERE category_id <> 4) UNION ALL SELECT 'dt_orphan_category_id', id FROM x WHERE category_id = 4 UNION ALL SELECT 'dt_missing_score', id FROM x WHERE score IS NULL UNION ALL SELECT 'dt_score_out_of_range', id FROM x WHERE score < 0 OR score > 1",
    "ds_near_duplicates": f"{_W} SELECT DISTINCT a.id FROM gt a JOIN gt b ON a.image_id = b.image_id AND a.category_id = b.category_id AND a.id <> b.id WHERE {_IOU.format(a='a.', b='b.')} / (a.w * a.h + b.w * b.h - {_IOU.format(a='a.', b='b.')}) > 0.85",
}
_UNROUNDED = ORACLES["det_image_diagnostics"].replace(", 8) AS f1", ", 20) AS f1")
_FLIP = ORACLES["det_confusion"], ORACLES["det_image_diagnostics"], ORACLES["det_label_errors"]
_GALLERY = f"(SELECT *, row_number() OVER (ORDER BY fp + fn DESC, image_id) - 1 AS position FROM ({_FLIP[1]}) q WHERE image_id % 2 = 0 AND fp + fn > 0 AND image_id IN ({_W} SELECT image_id FROM gt WHERE category_id IN (1, 3)))"
ORACLES |= {
    "det_headlines": f"SELECT row_number() OVER (ORDER BY o) AS position, metric, value FROM (SELECT list_position(['AP', 'AP50', 'AP75', 'AR100'], metric) AS o, * FROM ({ORACLES['det_summary']}) q) r WHERE o > 0",
    "det_named_aps": f"SELECT 'val/AP/cat' || category_id AS metric, ap AS value FROM ({ORACLES['det_per_category']}) q",
    "det_f1_histogram": f"SELECT profile, least(floor(f1 * 20), 19)::INT AS bin, count(*) AS n FROM ({_UNROUNDED}) q GROUP BY ALL",
    "det_f1_buckets": f"SELECT CASE WHEN f1 < 0.5 THEN 'low' WHEN f1 > 0.8 THEN 'high' ELSE 'middle' END AS bucket, count(*) AS n FROM ({_UNROUNDED}) q GROUP BY ALL",
    "det_worst_images": f"SELECT * REPLACE (round(f1, 8) AS f1) FROM ({_UNROUNDED}) q ORDER BY q.f1, image_id LIMIT 20",
    "det_error_classes": f"SELECT error, dt_category_id, count(*) AS n FROM ({_FLIP[2]}) q GROUP BY ALL",
    "det_mean_curve": f"{_W}, {_ONE}, {_LAST}, g AS (SELECT r::INTEGER AS r, category_id FROM range(101) q(r), npig WHERE npig > 0), p AS (SELECT g.r, avg(coalesce(env, 0)) AS p FROM g LEFT JOIN sa ON sa.r = g.r AND sa.category_id = g.category_id GROUP BY g.r) SELECT r, round(p, 8) AS precision, round(2 * p * (r / 100.0::DOUBLE) / greatest(p + r / 100.0::DOUBLE, 1e-8), 8) AS f1 FROM p",
    "det_top_confusions": f"SELECT gt_category_id, dt_category_id, n FROM ({_FLIP[0]}) q WHERE gt_category_id <> dt_category_id ORDER BY n DESC, 1, 2 LIMIT 6",
    "det_rolled_confusion": f"SELECT CASE WHEN gt_category_id < 0 THEN 'background' WHEN gt_category_id % 2 = 0 THEN 'even' ELSE 'odd' END AS gt_group, CASE WHEN dt_category_id < 0 THEN 'background' WHEN dt_category_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dt_group, sum(n)::BIGINT AS n FROM ({_FLIP[0]}) q GROUP BY ALL",
    "det_report_counts": f"{_W} SELECT id AS category_id, name, (SELECT count(*) FROM gt WHERE category_id = cats.id) AS n_annotations, (SELECT count(DISTINCT image_id) FROM gt WHERE category_id = cats.id) AS n_images, (SELECT count(*) FROM dt WHERE category_id = cats.id) AS n_detections FROM cats",
    "det_gallery": f"SELECT image_id, position, coalesce(lag(image_id) OVER (ORDER BY position), -1) AS prev_id, coalesce(lead(image_id) OVER (ORDER BY position), -1) AS next_id FROM {_GALLERY} q",
    "det_image_view": f"""{_W}, {_ONE}, u AS (SELECT * FROM ev WHERE NOT ignored), v AS (SELECT 'gt' AS source, gt.image_id, gt.category_id, gt.id, NULL::DOUBLE AS score, CASE WHEN gt.iscrowd THEN 'none' WHEN u.gt IS NULL THEN 'fn' ELSE 'tp' END AS status, coalesce(u.dt_id, -1) AS matched_id FROM gt LEFT JOIN (SELECT * FROM u WHERE matched) u ON u.image_id = gt.image_id AND u.gt = gt.id
 UNION ALL SELECT 'dt', dt.image_id, dt.category_id, dt.id, dt.score, CASE WHEN u.dt_id IS NULL THEN 'none' WHEN u.matched THEN 'tp' ELSE 'fp' END, coalesce(CASE WHEN u.matched THEN u.gt END, -1) FROM dt LEFT JOIN u ON u.image_id = dt.image_id AND u.dt_id = dt.id WHERE dt.score >= 0.3)
 SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY source DESC, coalesce(score, 0) DESC, category_id, id) AS position, source, id, 'cat' || category_id AS category, coalesce(round(score, 4), -1) AS score, status, matched_id FROM v""",
}
