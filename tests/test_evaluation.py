"""Evaluation by kind, formats, reports, streaming and the command line on small fixtures."""

import json
import math

import numpy as np
import pytest

from detlake.__main__ import main
from detlake.evaluation import Evaluation, slice_rows
from detlake.functions import masks
from detlake.operators import reports
from detlake.operators.hierarchy import Hierarchy
from detlake.operators.params import OKS_SIGMAS, Params
from detlake.operators.similarity import rle_of
from detlake.sources import coco_json, formats
from detlake.streaming import detections as stream

IMAGES = [{"id": 1, "file_name": "a.jpg", "height": 40, "width": 50}, {"id": 2, "file_name": "b.jpg", "height": 40, "width": 50}]
CATS = [{"id": 1, "name": "cat", "supercategory": "pet"}, {"id": 2, "name": "dog & co", "supercategory": "pet"}]


def rle(m):
    h, w, counts = masks.encode(m)
    return {"size": [h, w], "counts": masks.to_string(counts)}


def disc(cx, cy, r):
    y, x = np.mgrid[:40, :50]
    return (x - cx) ** 2 + (y - cy) ** 2 <= r * r


def dataset(spark, anns, images=IMAGES, cats=CATS):
    return coco_json.from_dict(spark, {"images": images, "annotations": anns, "categories": cats})


def test_masks_match_by_their_pixels(spark):
    a, b = disc(15, 15, 8), disc(19, 15, 8)
    want = (a & b).sum() / (a | b).sum()
    d = dataset(spark, [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [7, 7, 17, 17], "area": int(a.sum()), "segmentation": rle(a)}])
    dt = coco_json.detections_from(spark, [{"image_id": 1, "category_id": 1, "segmentation": rle(b), "score": 0.9}])
    row = dt.first()
    assert (row["area"], row["x"], row["w"]) == (float(b.sum()), 11.0, 17.0)
    e = Evaluation(d, dt, "segm").run()
    assert e.metrics["AP"] == pytest.approx(sum(want >= t for t in Params().iou_thrs) / 10)
    crowd = dataset(spark, [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 50, 40], "area": 2000, "iscrowd": 1}, {"id": 2, "image_id": 2, "category_id": 1, "bbox": [0, 0, 5, 5], "area": 25, "segmentation": [[0, 0, 5, 0, 5, 5, 0, 5]]}])
    more = [{"image_id": 1, "category_id": 1, "segmentation": rle(b), "score": 0.9}, {"image_id": 2, "category_id": 1, "segmentation": rle(disc(2, 2, 60)), "score": 0.1}, {"image_id": 2, "category_id": 1, "segmentation": {"size": [40, 50], "counts": "!"}, "score": 0.8}]
    got = Evaluation(crowd, coco_json.detections_from(spark, more), "segm").run()
    assert got.metrics["AR100"] == 0.0 and got.matches.where("a = 0 and ignored[0]").count() == 1


def test_a_mask_comes_from_polygon_runs_or_box():
    assert masks.area(rle_of("[[2,2,8,2,8,8,2,8]]", None, 12, 12)[2]) == 36
    assert rle_of('{"size": [2, 3], "counts": [1, 2, 3]}', None, 9, 9) == (2, 3, [1, 2, 3])
    assert masks.area(rle_of(None, [1, 1, 3, 2], 9, 9)[2]) == 6
    assert rle_of("no json", [1, 1, 3, 2], 9, 9) is None and rle_of(None, None, 9, 9) is None


def similarity_of_keypoints(dt, gt, box, area):
    d, g = np.reshape(dt, (-1, 3)), np.reshape(gt, (-1, 3))
    seen = g[:, 2] > 0
    x, y, w, h = box
    dx, dy = d[:, 0] - g[:, 0], d[:, 1] - g[:, 1]
    if not seen.any():
        dx = np.maximum(0, x - w - d[:, 0]) + np.maximum(0, d[:, 0] - (x + 2 * w))
        dy = np.maximum(0, y - h - d[:, 1]) + np.maximum(0, d[:, 1] - (y + 2 * h))
    e = (dx**2 + dy**2) / (2 * np.array(OKS_SIGMAS)) ** 2 / (area + np.spacing(1)) / 2
    return float(np.mean(np.exp(-e[seen] if seen.any() else -e)))


def test_keypoints_by_brute_force(spark):
    rnd = np.random.default_rng(4)
    anns, dets = [], []
    for i in range(1, 13):
        x, y = rnd.integers(0, 20, 2)
        shape = rnd.integers(5, 30, (17, 2))
        seen = np.zeros(17) if i % 4 == 0 else rnd.integers(0, 3, 17)
        g = np.c_[shape, seen].ravel().tolist()
        d = np.c_[shape + rnd.normal(0, 1.5, (17, 2)), np.ones(17)].ravel().tolist()
        anns.append({"id": i, "image_id": 1 + i % 2, "category_id": 1, "bbox": [int(x), int(y), 25, 20], "area": 500.0, "keypoints": g, "num_keypoints": int((seen > 0).sum())})
        dets.append({"image_id": 1 + i % 2, "category_id": 1, "keypoints": d, "score": float(rnd.random())})
    e = Evaluation(dataset(spark, anns), coco_json.detections_from(spark, dets), "keypoints")
    got = {(r["id"], r["gt_id"]): r["iou"] for r in e.pairs(e.dt, e.gt).collect()}
    want = {(j, a["id"]): similarity_of_keypoints(d["keypoints"], a["keypoints"], a["bbox"], a["area"]) for j, d in enumerate(dets, 1) for a in anns if a["image_id"] == d["image_id"]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert e.run().npig.where("a = 0").first()["npig"] == sum(a["num_keypoints"] > 0 for a in anns)
    assert list(e.metrics) == ["AP", "AP50", "AP75", "APm", "APl", "AR", "AR50", "AR75", "ARm", "ARl"]


def test_rotated_boxes_against_a_grid(spark):
    rnd = np.random.default_rng(2)
    y, x = np.mgrid[0:60:600j, 0:60:600j]

    def inside(o):
        c, s = math.cos(o[4]), math.sin(o[4])
        u, v = (x - o[0]) * c + (y - o[1]) * s, -(x - o[0]) * s + (y - o[1]) * c
        return (abs(u) <= o[2] / 2) & (abs(v) <= o[3] / 2)

    boxes = [[*rnd.uniform(20, 40, 2), *rnd.uniform(5, 20, 2), rnd.uniform(-3, 3)] for _ in range(10)]
    d = dataset(spark, [{"id": i, "image_id": 1, "category_id": 1, "obb": b, "area": b[2] * b[3]} for i, b in enumerate(boxes[:5], 1)])
    dt = coco_json.detections_from(spark, [{"image_id": 1, "category_id": 1, "obb": b, "score": 0.5} for b in boxes[5:]])
    e = Evaluation(d, dt, "obb")
    got = {(r["id"], r["gt_id"]): r["iou"] for r in e.pairs(e.dt, e.gt).collect()}
    for i, a in enumerate(boxes[5:], 1):
        for j, b in enumerate(boxes[:5], 1):
            m, n = inside(a), inside(b)
            assert got.get((i, j), 0.0) == pytest.approx((m & n).sum() / (m | n).sum(), abs=0.02)
    same = coco_json.detections_from(spark, [{"image_id": 1, "category_id": 1, "obb": b, "score": 0.5} for b in boxes[:5]])
    assert Evaluation(d, same, "obb").run().metrics["AP50"] == 1.0


BOXES = [{"id": i, "image_id": 1 + i % 2, "category_id": 1 + i % 2, "bbox": [3 * i, 2, 10, 12], "area": 120, "segmentation": [[3 * i, 2, 3 * i + 10, 2, 3 * i + 10, 14, 3 * i, 14]]} for i in range(1, 5)]
DETS = [{"image_id": a["image_id"], "category_id": a["category_id"], "bbox": a["bbox"], "score": 0.2 * a["id"]} for a in BOXES[:3]] + [{"image_id": 2, "category_id": 1, "bbox": [40, 30, 5, 5], "score": 0.95}]


def test_modes_reports_and_documents(spark, tmp_path):
    cats = [dict(c, frequency=f) for c, f in zip(CATS, "rf")]
    images = [dict(i, neg_category_ids=[1, 2], not_exhaustive_category_ids=[]) for i in IMAGES]
    d, dt = dataset(spark, BOXES, images, cats), coco_json.detections_from(spark, DETS)
    e = Evaluation(d, dt).run()
    lines = e.lines()
    assert len(lines) == 12 and lines[0] == f" Average Precision (AP) @[ IoU=0.50:0.95 | area=   all | maxDets=100 ] = {e.metrics['AP']:.3f}"
    assert lines[-1].endswith("maxDets=100 ] = -1.000")
    e.save_results(str(tmp_path / "r.json"), per_class=True)
    doc = json.loads((tmp_path / "r.json").read_text())
    assert doc["metrics"]["AP50"] == e.metrics["AP50"] and set(doc["per_class"]) == {"cat", "dog & co"}
    f = Evaluation(d, dt, mode="federated").run()
    assert list(f.metrics)[6:9] == ["APr", "APc", "APf"] and f.metrics["APc"] == -1.0
    o = Evaluation(d, dt, mode="open_images", hierarchy=Hierarchy({1: 3, 2: 3}), expand_dt=True).run()
    assert list(o.metrics) == ["AP"] and o.npig.count() == 3
    assert Evaluation(d, dt, cat_ids=[2]).run().npig.where("a = 0").count() == 1
    view = e.image_view().where("image_id = 2").orderBy("position").collect()
    assert [(r["source"], r["status"]) for r in view] == [("gt", "fn" if r["matched_id"] is None else "tp") if r["source"] == "gt" else ("dt", "fp" if r["matched_id"] is None else "tp") for r in view] and view[-1]["source"] == "dt"
    order = reports.gallery(d, e.image_diagnostics(), sort="most_fp").orderBy("position").collect()
    assert [r["image_id"] for r in order] in ([1, 2], [2, 1]) and order[0]["next_id"] == order[1]["image_id"] and order[0]["prev_id"] is None
    assert reports.gallery(d, names=["nothing"], seed=3).count() == 2
    assert {r["slice"] for r in e.sliced({"one": [1]}).collect()} == {"one", "_overall"}
    assert all(r["delta"] == pytest.approx(0, abs=1e-12) for r in e.compare(Evaluation(d, dt)).collect())
    with pytest.raises(ValueError):
        e.sliced(slice_rows(spark, {"_overall": [1]}))
    with pytest.raises(ValueError):
        Evaluation(d, dt, "cube")
    with pytest.raises(RuntimeError):
        Evaluation(d, dt).matches


def test_nothing_to_evaluate(spark):
    d = coco_json.empty(spark)
    for kind in ("bbox", "segm", "keypoints", "obb"):
        assert set(Evaluation(d, coco_json.detections_from(spark, []), kind).run().metrics.values()) == {-1.0}


def test_cvat_voc_and_dota_round_trips(spark, tmp_path):
    plain = [{k: v for k, v in a.items() if k != "segmentation"} for a in BOXES[2:]]
    d = dataset(spark, BOXES[:2] + plain)
    boxes = lambda s: sorted((r["x"], r["y"], r["w"], r["h"], r["area"]) for r in s.annotations.collect())
    formats.write_cvat(d, str(tmp_path / "c.xml"))
    text = (tmp_path / "c.xml").read_text()
    assert text.count("<polygon ") == 2 and text.count("<box ") == 2 and 'label="dog &amp; co"' in text
    back = formats.read_cvat(spark, str(tmp_path / "c.xml"))
    assert boxes(back) == boxes(d) and back.images.count() == 2
    formats.write_files(formats.voc_rows(d), str(tmp_path / "voc"), ".xml")
    back = formats.read_voc(spark, str(tmp_path / "voc"), ["cat", "dog & co"])
    assert boxes(back) == boxes(d)
    turned = dataset(spark, [{"id": 1, "image_id": 1, "category_id": 1, "obb": [20, 20, 10, 4, 0.5], "area": 40}])
    formats.write_files(formats.dota_rows(turned), str(tmp_path / "dota"), ".txt")
    obb = formats.read_dota(spark, str(tmp_path / "dota")).annotations.where("obb is not null").first()["obb"]
    assert obb == pytest.approx([20, 20, 10, 4, 0.5], abs=0.1)


def test_a_stream_of_detections(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, part in (("1", DETS[:2]), ("2", DETS[2:])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, part)) + "\nbroken\n")
        stream.append(stream.lines(spark, str(tmp_path / "in"), 1), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = stream.appended(spark, str(tmp_path / "t"))
    assert got.count() == len(DETS) and got.select("image_id", "id").distinct().count() == len(DETS)
    d = dataset(spark, BOXES)
    assert Evaluation(d, got).run().metrics == Evaluation(d, coco_json.detections_from(spark, DETS)).run().metrics


def test_command_line(spark, tmp_path, capsys):
    gt, dt, out = (str(tmp_path / n) for n in ("gt.json", "dt.json", "out"))
    (tmp_path / "gt.json").write_text(json.dumps({"images": IMAGES, "annotations": BOXES, "categories": CATS}))
    (tmp_path / "dt.json").write_text(json.dumps(DETS))
    (tmp_path / "s.json").write_text(json.dumps({"one": [1]}))

    def run(*argv):
        main([*argv, "--json"])
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    got = run("eval", "--gt", gt, "--dt", dt, "--tide", "--calibration", "--diagnostics", "--healthcheck", "--slices", str(tmp_path / "s.json"), "-o", out)
    assert got["metrics"] == json.loads((tmp_path / "out").read_text())["metrics"] and {"errors", "bins", "worst images", "slices"} <= set(got)
    assert run("eval", "--gt", gt, "--dt", dt, "--no-cats")["metrics"]["AP50"] >= 0
    main(["eval", "--gt", gt, "--dt", dt])
    assert "Average Precision (AP) @[" in capsys.readouterr().out
    assert run("healthcheck", gt, "--dt", dt)["summary"] and run("stats", gt)["categories"][0]["n_annotations"] == 2
    run("filter", gt, "-o", out, "--cat-ids", "2")
    kept = json.loads((tmp_path / "out").read_text())
    assert [c["id"] for c in kept["categories"]] == [2] and kept["annotations"][0]["segmentation"] == BOXES[0]["segmentation"]
    run("merge", gt, gt, "-o", out)
    assert len(json.loads((tmp_path / "out").read_text())["annotations"]) == 8
    main(["split", gt, "-o", out, "--val-frac", "0.5"])
    assert (tmp_path / "out_train.json").exists() and (tmp_path / "out_val.json").exists()
    run("sample", gt, "-o", out, "--n", "1")
    assert len(json.loads((tmp_path / "out").read_text())["images"]) == 1
    for fmt in ("yolo", "voc", "cvat"):
        main(["convert", "--from", "coco", "--to", fmt, "--input", gt, "--output", str(tmp_path / fmt)])
        main(["convert", "--from", fmt, "--to", "coco", "--input", str(tmp_path / fmt), "--output", out])
        assert len(json.loads((tmp_path / "out").read_text())["annotations"]) == 4
    with pytest.raises(SystemExit):
        main(["convert", "--from", "yolo", "--to", "voc", "--input", out, "--output", out])
    assert run("compare", "--gt", gt, "--dt-a", dt, "--dt-b", dt, "--bootstrap", "3")["categories"][0]["delta"] == 0
