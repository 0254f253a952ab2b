"""Golden values of the public protocol, formats, dense forms and the vectorised geometry."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlake.evaluation import Evaluation
from detlake.functions import masks
from detlake.operators import analysis, curve, matching, metrics, reports, similarity
from detlake.operators.dataset import merge
from detlake.operators.params import Params
from detlake.sources import coco_json, formats

#: A fixture of edge cases: image, category, box (area is w * h); crowd in image 1, ties in 3, only false in 4, only missed in 5, area bounds in 6.
EDGE_GT = [(1, 1, 10, 10, 50, 50), (2, 1, 0, 0, 20, 20), (3, 1, 5, 5, 20, 20), (3, 1, 60, 60, 20, 20), (5, 1, 10, 10, 30, 30), (5, 1, 50, 50, 30, 30), (6, 1, 0, 0, 32, 32), (6, 1, 0, 0, 96, 96)]
EDGE_DT = [(1, 1, 10, 10, 50, 50, 0.9), (1, 1, 12, 12, 48, 48, 0.8), (1, 1, 15, 15, 45, 45, 0.7), (2, 1, 0, 0, 20, 20, 0.95), (3, 1, 5, 5, 20, 20, 0.5), (3, 1, 60, 60, 20, 20, 0.5), (4, 2, 10, 10, 20, 20, 0.6), (4, 2, 50, 50, 20, 20, 0.4), (6, 1, 0, 0, 32, 32, 0.85), (6, 1, 0, 0, 96, 96, 0.75)]
EDGE = dict(zip([t[0] for t in metrics.BOX], [0.712871, 0.712871, 0.712871, 0.663366, 1, 1, 0.428571, 0.714286, 0.714286, 0.666667, 1, 1]))


def document(gt, n_images=6, crowd=()):
    anns = [{"id": i + 1, "image_id": im, "category_id": c, "bbox": [x, y, w, h], "area": w * h, "iscrowd": int(i in crowd)} for i, (im, c, x, y, w, h) in enumerate(gt)]
    return {"info": {"year": 2020}, "licenses": [{"id": 1}], "images": [{"id": i + 1, "file_name": f"{i + 1}.jpg", "height": 100, "width": 100} for i in range(n_images)], "annotations": anns, "categories": [{"id": i, "name": n, "supercategory": "animal"} for i, n in ((1, "cat"), (2, "dog"), (3, "bird"))]}


def found(spark, rows):
    return coco_json.detections_from(spark, [{"image_id": im, "category_id": c, "bbox": [x, y, w, h], "score": s} for im, c, x, y, w, h, s in rows])


@pytest.fixture(scope="module")
def edge(spark):
    e = Evaluation(coco_json.from_dict(spark, document(EDGE_GT, crowd=(0,))), found(spark, EDGE_DT)).run()
    yield e
    e.close()


def test_edge_cases_have_the_published_values(edge):
    assert edge.metrics == pytest.approx(EDGE, abs=1e-4)


def test_dense_forms(edge, spark):
    out = edge.arrays()
    assert out["precision"].shape == (10, 101, 1, 4, 3) and out["stats"] == pytest.approx(list(EDGE.values()), abs=1e-4)
    assert out["precision"][:, :, 0, 0, 2].mean() == pytest.approx(EDGE["AP"], abs=1e-4) and out["recall"][:, 0, 0, 0].mean() == pytest.approx(EDGE["AR1"], abs=1e-4)
    matrix, ids = edge.confusion_matrix()
    assert ids == [1, 2, 3] and matrix.shape == (4, 4) and matrix[0, 0] == 5 and matrix[3, 1] == 2 and matrix[0, 3] == 2
    full = {(r[0], r[1]): r[2] for r in reports.full_confusion(edge.confusion(), edge.dataset.categories).select("gt_category_id", "dt_category_id", "n").collect()}
    assert len(full) == 16 and full[(1, 1)] == 5 and full[(2, 3)] == 0
    rows = spark.createDataFrame([(1, 2, 5), (2, 1, 1), (3, 1, 2), (-1, 3, 50), (3, 3, 9)], "gt_category_id bigint, dt_category_id bigint, n bigint")
    assert [tuple(r) for r in reports.confused_classes(rows, 2).collect()] == [(1, 8), (2, 6)]


def test_ignored_ground_truth_takes_one_detection_only(spark):
    gt = [(1, 1, 10, 10, 20, 20), (1, 1, 50, 50, 100, 100)]
    dt = [(1, 1, 10, 10, 20, 20, 0.9), (1, 1, 10, 10, 25, 20, 0.8), (1, 1, 50, 50, 100, 100, 0.7)]
    params = Params(areas=(("all", 500.0, 1e10),))
    e = Evaluation(coco_json.from_dict(spark, document(gt, 1)), found(spark, dt), params=params)
    rows, counts = matching.evaluate(e.gt, e.dt, params)
    n = matching.total(counts)
    got = {r["metric"]: r["value"] for r in metrics.summary(curve.cells(curve.curve(rows, n, params), n, params), params).collect()}
    assert got["AP50"] == pytest.approx(0.5, abs=0.01)


def test_crowds_take_any_number(spark):
    e = Evaluation(coco_json.from_dict(spark, document([(1, 1, 10, 10, 50, 50)], 1, crowd=(0,))), found(spark, [(1, 1, 10, 10, 50, 50, 0.9), (1, 1, 12, 12, 48, 48, 0.8), (1, 1, 15, 15, 45, 45, 0.7)])).run()
    assert all(all(r["ignored"]) for r in e.matches.where("a = 0").collect()) and e.metrics["AP"] == -1


def test_waves_match_as_one_detection_at_a_time():
    rnd = np.random.default_rng(3)
    thrs = np.array([0.3, 0.5, 0.7])
    for _ in range(60):
        n = rnd.integers(1, 60)
        rows = sorted({(int(g), int(d), int(x)) for g, d, x in zip(rnd.integers(0, 4, n), rnd.integers(0, 6, n), rnd.integers(0, 5, n))})
        group, rank, gt = (np.array(x) for x in zip(*rows))
        det = np.cumsum(np.concatenate([[0], (np.diff(group) != 0) | (np.diff(rank) != 0)]))
        iou = rnd.choice([0.2, 0.4, 0.6, 0.8], len(gt))
        crowds, areas = rnd.random((4, 5)) < 0.2, rnd.random((2, 4, 5)) < 0.3
        crowd, ignored = crowds[group, gt], np.stack([a[group, gt] for a in areas], 1)
        got = matching.assign(det, group, gt, iou, crowd, ignored, det[-1] + 1, thrs)
        for a in range(2):
            for t, thr in enumerate(thrs):
                used = set()
                for d in range(det[-1] + 1):
                    best = -1
                    for j in np.flatnonzero(det == d):
                        if iou[j] >= thr and (crowd[j] or (group[j], gt[j]) not in used) and (best < 0 or (not ignored[j, a], iou[j]) >= (not ignored[best, a], iou[best])):
                            best = j
                    assert got[d, a, t] == best
                    if best >= 0:
                        used.add((group[best], gt[best]))


def test_score_ranges_do_not_change_the_curve(edge):
    key = ["category_id", "a", "m", "t"]
    cells = [sorted(map(tuple, curve.cells(curve.curve(edge.matches, edge.npig, edge.params, bounds=b), edge.npig, edge.params).select(*key, F.round("ap", 9), F.round("recall", 9)).collect())) for b in ([], [0.5], [0.45, 0.72, 0.9, 2.0], [i / 50 for i in range(50)])]
    assert all(c == cells[0] for c in cells)


def test_f_scores_look_thresholds_up(edge):
    names = {r["metric"] for r in edge.f_scores(2.0).collect()}
    assert names == {"F2.0", "F2.050", "F2.075"}
    one = Params(iou_thrs=(0.75,))
    rows, counts = matching.evaluate(edge.gt, edge.dt, one)
    n = matching.total(counts)
    got = {r["metric"]: r["value"] for r in metrics.f_scores(curve.curve(rows, n, one), n, one).collect()}
    assert got["F150"] == -1 and got["F175"] == got["F1"] > 0


def test_comparison_by_category_and_slices(edge, spark):
    other = Evaluation(edge.dataset, found(spark, EDGE_DT[3:]))
    got = edge.compare_categories(other).collect()
    assert [(r["category_id"], r["name"]) for r in got] == [(1, "cat")] and got[0]["delta"] == pytest.approx(got[0]["ap_b"] - got[0]["ap_a"])
    by = lambda images: F.when(images["id"] < 5, F.when(images["id"] % 2 == 0, "even").otherwise("odd"))
    assert {r["slice"]: r["num_images"] for r in edge.slice_sizes(by).collect()} == {"even": 2, "odd": 2, "_overall": 6}
    assert {r["slice"] for r in edge.sliced(by).collect()} == {"even", "odd", "_overall"}


def test_documents_keep_info_and_merge_of_nothing_is_empty(edge, spark, tmp_path):
    coco_json.save(edge.dataset, str(tmp_path / "d.json"))
    back = json.loads((tmp_path / "d.json").read_text())
    assert back["info"] == {"year": 2020} and back["licenses"] == [{"id": 1}] and len(back["annotations"]) == 8
    assert json.loads(coco_json.read(spark, str(tmp_path / "d.json")).info) == {"year": 2020}
    coco_json.write_lines(edge.dataset, str(tmp_path / "lines"))
    again = coco_json.read_lines(spark, str(tmp_path / "lines"))
    assert sorted(map(str, again.annotations.collect())) == sorted(map(str, edge.dataset.annotations.collect())) and again.categories.count() == 3
    assert merge([]).images.count() == 0 and merge([edge.dataset, edge.dataset]).annotations.count() == 16


def test_lookups(edge):
    d = edge.dataset
    assert [r["id"] for r in d.ann_ids(img_ids=[5, 3, 3]).collect()] == [3, 3, 4, 4, 5, 6]
    assert {(r["image_id"], tuple(r["ids"])) for r in d.postings().collect()} >= {(3, (3, 4)), (6, (7, 8))} and d.pairs().count() == 5


def test_category_order_comes_back(spark, tmp_path):
    doc = document([(1, 2, 1, 1, 5, 5), (1, 1, 2, 2, 6, 6)], 1)
    doc["categories"] = [{"id": 1, "name": "zebra"}, {"id": 2, "name": "ant"}]
    d = coco_json.from_dict(spark, doc)
    voc, cvat = tmp_path / "voc", tmp_path / "c.xml"
    formats.write_files(formats.voc_rows(d), str(voc), ".xml")
    names = lambda x: [r["name"] for r in x.categories.orderBy("id").collect()]
    assert names(formats.read_voc(spark, str(voc))) == ["ant", "zebra"]
    (voc / "labels.txt").write_text("zebra\nant\n")
    back = formats.read_voc(spark, str(voc))
    assert names(back) == ["zebra", "ant"] and sorted((r["category_id"], r["x"], r["w"]) for r in back.annotations.collect()) == [(1, 2.0, 6.0), (2, 1.0, 5.0)]
    formats.write_cvat(d, str(cvat))
    assert names(formats.read_cvat(spark, str(cvat))) == ["zebra", "ant"]
    assert formats._listed("""cat, "a, b", 'c'""") == ["cat", "a, b", "c"]


def test_sizes_from_image_headers(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 31, 17) + b"\x08\x02")
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 23, 45) + b"\0" * 12)
    (tmp_path / "c.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 5, 6))
    (tmp_path / "d.png").write_bytes(b"broken")
    assert {tuple(r) for r in formats.image_sizes(spark, str(tmp_path)).collect()} == {("a", 31, 17), ("b", 45, 23), ("c", 5, 6)}


def test_masks_of_boxes_objects_and_many_pairs(spark):
    rnd = np.random.default_rng(5)
    for _ in range(200):
        h, w = (int(x) for x in rnd.integers(1, 9, 2))
        x, y, bw, bh = (float(v) for v in rnd.uniform(-3, 9, 4))
        grid = np.zeros((h, w), np.uint8)
        grid[max(0, math.floor(y)) : max(0, min(h, math.ceil(y + bh))), max(0, math.floor(x)) : max(0, min(w, math.ceil(x + bw)))] = 1
        got = masks.from_bbox([x, y, bw, bh], h, w)
        assert (masks.decode(*got) == grid).all() and sum(got[2]) == h * w
    assert masks.from_bbox([1, 0, 3, 4], 4, 5)[2] == [4, 4, 0, 4, 0, 4, 4]
    pairs = [(rnd.random((6, 7)) < rnd.random(), rnd.random((6, 7)) < rnd.random()) for _ in range(100)]
    a, b = ([np.array(masks.encode(p[i])[2]) for p in pairs] for i in (0, 1))
    crowd = rnd.random(100) < 0.5
    assert masks.intersections(a, b).tolist() == [int((x & y).sum()) for x, y in pairs]
    want = [masks.iou((6, 7, list(x)), (6, 7, list(y)), c) for x, y, c in zip(a, b, crowd)]
    assert masks.ious(a, b, crowd) == pytest.approx(want) and masks.intersections([], []).tolist() == []
    cube = np.stack([p[0] for p in pairs[:3]], 2)
    assert masks.encode(cube) == [masks.encode(p[0]) for p in pairs[:3]]
    rle = {"size": [6, 7], "counts": masks.to_string(a[0])}
    assert masks.from_objects(rle, 6, 7)[2] == a[0].tolist() and masks.from_objects([rle, rle], 6, 7)[1][2] == a[0].tolist()
    square = [2, 2, 8, 2, 8, 8, 2, 8]
    assert masks.of_annotation([square, square], 12, 12).sum() == 36 and masks.of_annotation(rle, 6, 7).sum() == pairs[0][0].sum() and masks.of_annotation(None, 3, 3).sum() == 0
    masks.register(spark)
    row = spark.sql("SELECT mask_iou(array(0, 4), array(2, 2), false) AS iou, rle_string(array(2, 2)) AS s, mask_area(array(1, 3)) AS n").first()
    assert row["iou"] == 0.5 and row["n"] == 3 and masks.from_string(row["s"], 2, 2)[2] == [2, 2]


def test_the_keypoint_bound_loses_no_pair(spark):
    rnd = np.random.default_rng(6)

    def rows(n, near):
        for i in range(n):
            x, y, w, h = rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.uniform(1, 30), rnd.uniform(1, 30)
            seen = rnd.integers(0, 3, 17) * (rnd.random() < 0.8)
            pts = [v for k in range(17) for v in (x + rnd.uniform(-near, w + near), y + rnd.uniform(-near, h + near), float(seen[k]))]
            yield (i + 1, 1, 1, float(x), float(y), float(w), float(h), float(w * h), pts, int((seen > 0).sum()), float(rnd.random()))

    schema = "id bigint, image_id bigint, category_id bigint, x double, y double, w double, h double, area double, keypoints array<double>, num_keypoints int, score double"
    gt, dt = (spark.createDataFrame(list(rows(n, near)), schema) for n, near in ((25, 0), (60, 4)))
    gt = similarity.keypoint_ignored(gt.withColumn("iscrowd", F.lit(False)))
    got, every = (similarity.keypoint_pairs(least=x)(dt, gt).where("iou >= 0.5").select("id", "gt_id").collect() for x in (0.5, 0.0))
    assert sorted(map(tuple, got)) == sorted(map(tuple, every)) and len(got) > 5


def test_rows_without_a_category_name(spark):
    ap = spark.createDataFrame([(1, 0.5), (9, 0.25)], "category_id bigint, ap double")
    cats = spark.createDataFrame([(1, "cat")], "id bigint, name string")
    assert {tuple(r) for r in reports.named_aps(ap, cats).collect()} == {("AP/cat", 0.5), ("AP/cat_9", 0.25)}


def test_bootstrap_samples_are_those_of_brute_force(edge, spark):
    other = found(spark, [*EDGE_DT[:5], (5, 1, 10, 10, 30, 30, 0.99)])
    params = Params(iou_thrs=(0.5,), areas=(("all", 0.0, 1e10),), max_dets=(100,))
    n_boot, seed = 6, 3
    got = {r["metric"]: r for r in analysis.compare(edge.gt, edge.dt, other, params, n_boot, seed, table=metrics.BOX[:1]).collect()}["AP"]
    ids = [1, 2, 3, 4, 5, 6]  # images of either side that have annotations or detections on both
    ids = sorted({r[0] for r in edge.gt.select("image_id").union(edge.dt.select("image_id")).collect()} & {r[0] for r in edge.gt.select("image_id").union(other.select("image_id")).collect()})

    def ap(dt, images):
        rows, counts = matching.evaluate(edge.gt.where(F.col("image_id").isin(*images)), dt.where(F.col("image_id").isin(*images)), params)
        n = matching.total(counts)
        return metrics.summary(curve.cells(curve.curve(rows, n, params), n, params), params, metrics.BOX[:1]).first()["value"]

    def drawn(b, j, n):
        x = (seed * 7919 + b * 104729 + j * 1299709 + 12345) % 2147483647
        x = (x * 48271 + 11) % 2147483647
        return (x * 48271 + 11) % 2147483647 % n

    deltas = []
    for b in range(n_boot):
        images = sorted({ids[drawn(b, j, len(ids))] for j in range(len(ids))})
        one, two = ap(edge.dt, images), ap(other, images)
        deltas.append(0.0 if one < 0 or two < 0 else two - one)
    assert got["lower"] == pytest.approx(min(deltas)) and got["upper"] == pytest.approx(max(deltas)) and got["prob_positive"] == pytest.approx(np.mean([d > 0 for d in deltas]))
