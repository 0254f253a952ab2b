"""Steps that were mended for larger tables: the forms in groups against the plain ones, and plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlake import scene as module
from detlake.functions import masks
from detlake.operators import analysis, curve, matching, similarity
from detlake.operators.dataset import Dataset, detection_health
from detlake.operators.params import Params
from detlake.plans import queries
from detlake.scene import BASE, DT, GT, scene

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def same(a, b) -> bool:
    key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    return key(a) == key(b)


@pytest.fixture(scope="module")
def few(spark):
    s = scene(spark, SF)
    return {k: (v.where("image_id % 7 = 0") if "image_id" in v.columns else v).cache() for k, v in s.items()}


def turned(df):
    return df.withColumn("obb", F.when(F.col("id") % 50 != 0, F.array(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, "w", "h", (F.col("id") % 12) * F.lit(0.26))))


def masked(df, images):
    corners = F.to_json(F.array(F.array("x", "y", F.col("x") + F.col("w"), "y", "x", F.col("y") + F.col("h"))))
    return similarity.with_masks(df.withColumn("segmentation", F.when(F.col("id") % 3 == 0, corners)), images, lean=True)


def test_the_scene_in_one_pass_is_the_scene_of_the_sql(spark):
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet")
    base = spark.sql(BASE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    s = scene(spark, SF)
    for name, sql in (("gt", GT), ("dt", DT)):
        want = spark.sql(sql.replace("FROM scene_base", "FROM {base}"), base=base)
        assert s[name].schema == want.schema and same(s[name], want)
        assert plan(s[name]).count("Window") == 1


@pytest.mark.parametrize("kind", ["boxes", "pooled", "rotated", "keypoints"])
def test_pairs_within_groups_give_the_matches_of_joined_pairs(few, kind):
    gt, dt, params = few["gt"], few["dt"], Params()
    pairs = {"boxes": matching.box_pairs, "pooled": matching.box_pairs, "rotated": similarity.rotated_pairs, "keypoints": similarity.keypoint_pairs()}[kind]
    if kind == "pooled":
        params = Params(use_cats=False, max_dets=(1, 3))
    elif kind == "rotated":
        gt, dt = turned(gt), turned(dt)
    elif kind == "keypoints":
        gt, dt, params = similarity.keypoint_ignored(queries._points(gt)), queries._points(dt), Params.keypoints()
    got = matching.evaluate(gt, dt, params, pairs)
    want = matching.evaluate(gt, dt, params, lambda d, g: pairs(d, g))
    assert same(got[0], want[0]) and same(got[1], want[1])
    bits = matching.packed(gt, dt, params, pairs)
    n = matching.npig(gt, params)
    assert same(n, matching.total(got[1]))
    a, b = (curve.cells(curve.curve(x, n, params), n, params) for x in (bits, want[0]))
    assert same(a, b) and "Join" not in plan(bits)


def test_many_thresholds_take_several_words(few):
    many = Params(iou_thrs=tuple(0.5 + 0.01 * i for i in range(40)))
    n = matching.npig(few["gt"], many)
    rows = matching.evaluate(few["gt"], few["dt"], many)[0]
    a, b = (curve.cells(curve.curve(x, n, many), n, many) for x in (matching.packed(few["gt"], few["dt"], many), rows))
    assert same(a, b)


def test_masks_that_fill_their_boxes_need_no_runs(few):
    gt, dt = masked(few["gt"], few["imgs"]), masked(few["dt"], few["imgs"])
    assert dt.where("segmentation is null and mask.counts is not null").isEmpty() and not dt.where("mask.counts is not null").isEmpty()
    whole = [similarity.with_masks(x.drop("mask"), few["imgs"]) for x in (gt, dt)]
    assert same(dt.selectExpr("id", "mask.area", "mask.x", "mask.y", "mask.bw", "mask.bh"), whole[1].selectExpr("id", "mask.area", "mask.x", "mask.y", "mask.bw", "mask.bh"))
    got = matching.evaluate(gt, dt, Params(), similarity.mask_pairs)[0]
    want = matching.evaluate(*whole, Params(), lambda d, g: similarity.mask_pairs(d, g))[0]
    assert same(got, want)


def test_edges_of_many_polygons():
    rnd = random.Random(3)
    polygons = [[round(rnd.uniform(-20, 90), rnd.choice([0, 2])) for _ in range(2 * rnd.choice([1, 2, 3, 4, 7]))] for _ in range(300)]
    h, w = (np.array([rnd.choice([40, 64]) for _ in polygons]) for _ in "hw")
    owner, edge = masks.polygon_edges(polygons, h, w)
    area, box = masks.edge_extents(owner, edge, h, w)
    for k, p in enumerate(polygons):
        m = masks.from_polygon(p, int(h[k]), int(w[k]))
        assert np.diff(np.concatenate([[0], edge[owner == k], [h[k] * w[k]]])).tolist() == m[2]
        assert area[k] == masks.area(m[2]) and box[k].tolist() == masks.to_bbox(*m)


def test_rotated_boxes_as_arrays():
    rng = np.random.default_rng(5)
    a, b = (np.column_stack([rng.uniform(0, 20, (2000, 2)), rng.uniform(-1, 20, (2000, 2)), rng.uniform(-4, 4, 2000)]) for _ in "ab")
    b[::5] = a[::5]
    crowd = rng.random(2000) < 0.2
    assert masks.rotated_ious(a, b, crowd) == pytest.approx([masks.rotated_iou(x, y, c) for x, y, c in zip(a, b, crowd)], abs=1e-9)


def test_samples_are_bits_of_an_image(few):
    one = Params(iou_thrs=(0.5,), areas=(("all", 0.0, 1e10),), max_dets=(100,))
    small, large = (analysis.compare(few["gt"], few["dt"], few["dt_b"], one, n, table=(("AP", True, None, "all", -1),)).first() for n in (1, 70))
    assert small["a"] == large["a"] and small["b"] == large["b"] and large["lower"] <= small["lower"] <= large["upper"]


def test_masks_of_text_are_refused(few):
    df = few["dt"].limit(4).withColumn("segmentation", F.lit("no mask"))
    assert similarity.with_masks(df, few["imgs"], lean=True).where("mask.area is not null").isEmpty()


def test_numbers_come_from_rows_that_are_made_once(spark):
    from detlake.operators.ranking import numbered

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("id")).mapInArrow(count, "id bigint")
    got = numbered(rows, F.floor(F.col("id") / 10) % 3)
    want = {i: n for n, (_, i) in enumerate(sorted((i // 10 % 3, i) for i in range(5000)))}
    assert {r["id"]: r["number"] for r in got.collect()} == want
    assert got.where("number % 2 = 0").count() == 2500 and made.value <= 10000  # once for the bounds, once for the rows
    assert numbered(spark.range(0).select("id"), F.col("id")).isEmpty()


def test_error_scenarios_are_bits_of_one_row(few):
    one = Params(iou_thrs=(0.5,), areas=(("all", 0.0, 1e10),), max_dets=(100,))
    rows, counts = matching.evaluate(few["gt"], few["dt"], one)
    n = matching.total(counts)
    typed, missed = analysis.error_types(few["gt"], few["dt"], rows, one)
    got = {r["error"]: r["delta_ap"] for r in analysis.error_deltas(typed, missed, n).collect()}
    flags = typed.select("category_id", "score", "image_id", "rank", (F.col("matched") & ~F.col("ignored")).cast("long").alias("tp"), (~F.col("matched") & ~F.col("ignored")).cast("long").alias("fp"))
    fixed = flags.where("true").join(typed.select("image_id", "category_id", "rank", "error"), ["image_id", "category_id", "rank"]).where("error is null or error <> 'Bkg'")
    npig = n.where("a = 0").select("category_id", "npig")
    ap = [analysis.average_precision(x, npig, ["category_id"], ["image_id", "rank"]).agg(F.avg("ap")).first()[0] for x in (flags, fixed)]
    assert got["base"] == pytest.approx(ap[0], abs=1e-12) and got["Bkg"] == pytest.approx(ap[1] - ap[0], abs=1e-12)


def test_group_of_and_federated_marks_in_groups_are_the_plain_forms(spark, few):
    plain = lambda dt, gt: matching.box_pairs(dt, gt)  # noqa: E731 (without ``within``: joins)
    p = Params(iou_thrs=(0.3, 0.5, 0.75), max_dets=(3,))
    gt = few["gt"].withColumn("is_group_of", F.col("id") % 5 == 0)
    for use_cats in (True, False):
        q = Params(iou_thrs=p.iou_thrs, max_dets=p.max_dets, use_cats=use_cats)
        got, want = (analysis.open_images(gt if use_cats else matching.pooled(gt, q), few["dt"], q, x) for x in (matching.box_pairs, plain))
        assert same(got[0], want[0]) and same(got[1], want[1])
    assert "Join" not in plan(got[0])
    images = few["imgs"].where("id % 7 = 0").select("id", F.when(F.col("id") % 3 > 0, F.array(1 + F.col("id") % 4)).alias("neg_category_ids"), F.array(1 + (F.col("id") + 1) % 4, F.lit(None)).alias("not_exhaustive_category_ids"))
    gt = few["gt"].where("id % 4 = 0")
    got, want = (analysis.federated(gt, few["dt"], images, p, x) for x in (matching.box_pairs, plain))
    assert same(got[0], want[0]) and same(got[1], want[1])
    assert 0 < got[0].count() < few["dt"].count() * len(p.areas) and "Join LeftSemi" not in plan(got[0])


def test_detection_health_is_one_pass_and_counts_each_row(spark, few):
    dt = few["dt"].select("id", F.when(F.col("id") % 13 > 0, F.col("image_id")).alias("image_id"), "category_id", F.when(F.col("id") % 11 > 0, F.col("score") + (F.col("id") % 3)).alias("score"))
    dt = dt.unionByName(dt.where("id % 5 = 0")).unionByName(spark.createDataFrame([(7, 1, None, float("nan"))], "id long, image_id long, category_id long, score double"))
    d = Dataset(few["imgs"].where("id % 3 > 0").unionByName(few["imgs"].limit(5)), few["gt"], few["cats"].where("id <> 2"))
    got = detection_health(dt, d)
    images, cats = ({r["id"] for r in x.collect()} for x in (d.images, d.categories))
    want = []
    for r in dt.collect():
        s = r["score"]
        codes = ["dt_orphan_image_id"] * (r["image_id"] not in images) + ["dt_orphan_category_id"] * (r["category_id"] not in cats)
        codes += ["dt_missing_score"] if s is None else ["dt_score_out_of_range"] * (not 0.0 <= s <= 1.0)
        want += [(c, r["id"]) for c in codes]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Union" not in plan(queries.ds_detection_health(spark, SF))


def test_shuffle_partitions_follow_the_rows(spark, monkeypatch):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        scene(spark, SF)
        assert spark.conf.get(name) == before
        monkeypatch.setattr(module, "ROWS", 100)
        scene(spark, SF)
        assert int(spark.conf.get(name)) == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    finally:
        spark.conf.set(name, before)
