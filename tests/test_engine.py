"""The detection engine on small fixtures with closed-form answers, and against its SQL counterparts."""

import json

import numpy as np
import pytest

from detlake.functions import masks
from detlake.operators import analysis, curve, metrics
from detlake.operators.dataset import health, merge
from detlake.operators.hierarchy import Hierarchy, expand
from detlake.operators.matching import evaluate, total
from detlake.operators.params import Params
from detlake.sources import coco_json, formats

ANN = "id bigint, image_id bigint, category_id bigint, x double, y double, w double, h double, area double, iscrowd boolean"
DET = "id bigint, image_id bigint, category_id bigint, x double, y double, w double, h double, score double"


def summary(spark, gt, dt, params=None):
    params = params or Params()
    g = spark.createDataFrame([(*r, r[5] * r[6]) if len(r) == 7 else r for r in gt], ANN.replace(", iscrowd boolean", "")).selectExpr("*", "false AS iscrowd") if all(len(r) == 7 for r in gt) else spark.createDataFrame(gt, ANN)
    rows, counts = evaluate(g, spark.createDataFrame(dt, DET), params)
    n = total(counts)
    return {r["metric"]: r["value"] for r in metrics.summary(curve.cells(curve.curve(rows, n, params), n, params), params).collect()}


def test_perfect_detections_score_one(spark):
    gt = [(i, i, 1, 10.0, 10.0, 40.0, 40.0) for i in range(1, 4)]
    got = summary(spark, gt, [(i, i, 1, 10.0, 10.0, 40.0, 40.0, 0.9) for i in range(1, 4)])
    assert got["AP"] == got["AR1"] == 1.0 and got["APs"] == -1.0 and got["APm"] == 1.0


def test_crowd_absorbs_all_and_false_positives_count(spark):
    gt = [(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 100.0, False), (2, 1, 1, 50.0, 50.0, 40.0, 40.0, 1600.0, True)]
    dt = [(1, 1, 1, 50.0, 50.0, 20.0, 20.0, 0.95), (2, 1, 1, 60.0, 60.0, 20.0, 20.0, 0.94), (3, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.5)]
    assert summary(spark, gt, dt)["AP"] == 1.0
    assert summary(spark, gt, [*dt, (4, 1, 1, 200.0, 0.0, 9.0, 9.0, 0.99)])["AP"] == pytest.approx(0.5)


def test_empty_max_dets_are_an_error():
    with pytest.raises(ValueError):
        Params(max_dets=())


def test_confusion_of_a_swapped_class(spark):
    gt = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 100.0, False), (2, 1, 2, 50.0, 0.0, 10.0, 10.0, 100.0, False)], ANN)
    dt = spark.createDataFrame([(1, 1, 2, 0.0, 0.0, 10.0, 10.0, 0.9), (2, 1, 1, 90.0, 90.0, 5.0, 5.0, 0.8)], DET)
    got = {(r["gt_category_id"], r["dt_category_id"]): r["n"] for r in analysis.confusion(gt, dt).collect()}
    assert got == {(1, 2): 1, (-1, 1): 1, (2, -1): 1}


def test_masks_round_trip():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        m = rnd.random((rnd.integers(1, 9), rnd.integers(1, 9))) < 0.4
        h, w, counts = masks.encode(m)
        assert (masks.decode(h, w, counts) == m).all() and masks.area(counts) == m.sum()
        assert masks.from_string(masks.to_string(counts), h, w)[2] == counts
        n = rnd.random(m.shape) < 0.5
        other = masks.encode(n)
        assert (masks.decode(*masks.merge([(h, w, counts), other])) == (m | n)).all()
        assert (masks.decode(*masks.merge([(h, w, counts), other], intersect=True)) == (m & n)).all()
        if m.any():
            y, x = np.nonzero(m)
            box = masks.to_bbox(h, w, counts)
            assert box[0] == x.min() and box[2] == x.max() - x.min() + 1
    with pytest.raises(ValueError):
        masks.from_string("!", 3, 3)


def test_polygons_and_rotated_boxes():
    assert masks.area(masks.from_polygon([2, 2, 8, 2, 8, 8, 2, 8], 12, 12)[2]) == 36
    assert masks.from_polygon([1, 1], 4, 5) == (4, 5, [20]) and masks.from_polygons([], 4, 5) == (4, 5, [20])
    a = [5, 5, 4, 2, 0.3]
    assert masks.rotated_iou(a, a) == pytest.approx(1) and masks.rotated_iou(a, [50, 5, 4, 2, 0]) == 0
    assert masks.rotated_iou([0, 0, 4, 4, 0], [2, 0, 4, 4, 0]) == pytest.approx(1 / 3)


def test_json_in_and_out(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "height": 50, "width": 60}], "annotations": [{"id": 0, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 1, "segmentation": [[1, 2, 3, 4, 5, 6]]}], "categories": [{"id": 1, "name": "cat"}]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc))
    d = coco_json.read(spark, str(path))
    row = d.annotations.first()
    assert (row["id"], row["w"], row["iscrowd"]) == (0, 3.0, True) and coco_json.empty(spark).images.count() == 0
    coco_json.write(d, str(tmp_path / "out"))
    back = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert back["annotations"][0]["bbox"] == [1, 2, 3, 4] and back["annotations"][0]["iscrowd"] is True
    (tmp_path / "r.json").write_text(json.dumps([{"image_id": 1, "category_id": 1, "bbox": [0, 0, 2, 3], "score": 0.5}]))
    dt = coco_json.read_detections(spark, str(tmp_path / "r.json")).first()
    assert (dt["id"], dt["area"], dt["iscrowd"]) == (1, 6.0, False) and json.loads(dt["segmentation"]) == [[0, 0, 0, 3, 2, 3, 2, 0]]
    assert coco_json.detections_from(spark, np.array([[1, 0, 0, 2, 3, 0.5]])).first()["category_id"] == 1
    with pytest.raises(ValueError):
        coco_json.detections_from(spark, np.zeros((2, 5)))


def test_yolo_round_trip(spark, tmp_path):
    (tmp_path / "data.yaml").write_text("nc: 2\nnames: [cat, dog]\n")
    (tmp_path / "a.txt").write_text("1 0.500000 0.500000 0.200000 0.400000\n")
    (tmp_path / "b.txt").write_text("")
    dims = spark.createDataFrame([("a", 100, 50), ("b", 10, 10)], "stem string, width int, height int")
    d = formats.read_yolo(spark, str(tmp_path), dims)
    row = d.annotations.first()
    assert (row["category_id"], row["x"], row["y"], row["w"], row["h"]) == (2, 40.0, 15.0, 20.0, 20.0)
    assert {r["stem"]: r["text"] for r in formats.yolo_rows(d).collect()} == {"a": "1 0.500000 0.500000 0.200000 0.400000", "b": ""}


def test_merge_split_and_health(spark):
    d = coco_json.from_dict(spark, {"images": [{"id": i, "height": 10, "width": 10} for i in (1, 1, 2)], "annotations": [{"id": 1, "image_id": 9, "category_id": 7, "bbox": [0, 0, 0, 3]}], "categories": [{"id": 1, "name": "a", "supercategory": "s"}]})
    codes = {r["code"] for r in health(d).collect()}
    assert {"duplicate_image_id", "orphan_image_id", "orphan_category_id", "degenerate_bbox", "zero_instance_category"} <= codes
    parts = d.split(0.5)
    assert parts["train"].images.count() + parts["val"].images.count() == 3
    other = coco_json.from_dict(spark, {"categories": [{"id": 1, "name": "b", "supercategory": "s"}]})
    with pytest.raises(ValueError):
        merge([d, other])


def test_hierarchy_expansion_is_idempotent_and_finds_cycles(spark):
    gt = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 5.0, 5.0, 25.0, False), (2, 1, 2, 0.0, 0.0, 5.0, 5.0, 25.0, False)], ANN)
    h = Hierarchy({1: 3, 2: 3})
    once = expand(gt, h)
    assert once.where("category_id = 3").count() == 1 and expand(once, h).count() == once.count() == 3
    with pytest.raises(ValueError):
        Hierarchy({1: 2, 2: 1})


@pytest.mark.parametrize("name", ["det_summary", "det_confusion", "det_error_types", "ds_health", "ds_split"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
