"""Command line: python -m detlake COMMAND; see --help."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.evaluation import KINDS, Evaluation, slice_rows
from detlake.operators.dataset import Dataset, detection_health, health, health_summary, merge
from detlake.operators.params import Params
from detlake.sources import coco_json, formats


def _ids(text: str | None) -> list[int] | None:
    return None if text is None else [int(x) for x in text.split(",")]


def _range(text: str | None) -> tuple[float, float] | None:
    if text is None:
        return None
    low, high = text.split(",")
    return float(low), float(high)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _show(title: str, rows: list[dict]) -> None:
    print(f"\n{title}")
    for r in rows:
        print("  " + "  ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in r.items()))


def _report(args, sections: dict) -> None:
    """Sections as one JSON object, or as text; a list of lines is printed as it is."""
    if args.json:
        print(json.dumps(sections))
        return
    for name, rows in sections.items():
        if isinstance(rows, list) and rows and isinstance(rows[0], dict):
            _show(name, rows)
        else:
            print("\n".join(rows) if isinstance(rows, list) else f"{name}: {rows}")


def evaluate(spark: SparkSession, args) -> None:
    d, dt = coco_json.read(spark, args.gt), coco_json.read_detections(spark, args.dt)
    coco_json.warn_unknown(dt, d)
    mode = "federated" if args.federated else "coco"
    params = None
    if args.no_cats:
        base = Params.federated() if args.federated else Params.keypoints() if args.kind == "keypoints" else Params()
        params = Params(base.iou_thrs, base.rec_thrs, base.max_dets, base.areas, use_cats=False)
    e = Evaluation(d, dt, args.kind, mode, params, _ids(args.img_ids), _ids(args.cat_ids)).run()
    out: dict = {}
    if args.healthcheck:
        out["health"] = _rows(health(d).groupBy("code", "layer").count()) + _rows(detection_health(dt, d).groupBy("code").count())
    out["metrics"] = e.metrics if args.json else e.lines()
    if args.errors:
        out["errors"] = _rows(e.error_types(args.pos_thr, args.bg_thr))
    if args.calibration:
        out["calibration"] = _rows(e.calibration_errors(args.bins, args.cal_iou_thr))
        out["bins"] = _rows(e.calibration(args.bins, args.cal_iou_thr).orderBy("bin"))
    if args.diagnostics:
        found = e.image_diagnostics(args.diag_iou_thr)
        out["worst images"] = _rows(found.orderBy("f1", "image_id").limit(20))
        out["label errors"] = _rows(e.label_errors(args.diag_iou_thr, args.diag_score_thr).orderBy(F.col("score").desc(), "dt_id").limit(20))
    if args.slices:
        out["slices"] = _rows(e.sliced(slice_rows(spark, args.slices)).orderBy("slice", "metric"))
        out["slice sizes"] = _rows(e.slice_sizes(slice_rows(spark, args.slices)).orderBy("slice"))
    if args.output:
        e.save_results(args.output, per_class=True)
    _report(args, out)


def healthcheck(spark: SparkSession, args) -> None:
    d = coco_json.read(spark, args.file)
    out = {"findings": _rows(health(d).groupBy("code", "layer").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("id")), 1, 10).alias("first_ids")).orderBy("layer", "code")), "summary": _rows(health_summary(d))}
    if args.dt:
        out["detections"] = _rows(detection_health(coco_json.read_detections(spark, args.dt), d).groupBy("code").count())
    _report(args, out)


def stats(spark: SparkSession, args) -> None:
    d = coco_json.read(spark, args.file)
    cats = d.category_stats().orderBy(F.col("n_annotations").desc(), "category_id")
    _report(args, {"dataset": _rows(d.stats()), "categories": _rows(cats if args.all_cats else cats.limit(20))})


def _saved(args, d: Dataset, path: str) -> None:
    coco_json.save(d, path)
    _report(args, {"written": path})


def filter_(spark: SparkSession, args) -> None:
    d = coco_json.read(spark, args.file)
    _saved(args, d.filter(_ids(args.cat_ids), _ids(args.img_ids), _range(args.area_rng), not args.keep_empty_images), args.output)


def merge_(spark: SparkSession, args) -> None:
    _saved(args, merge([coco_json.read(spark, f) for f in args.files]), args.output)


def split(spark: SparkSession, args) -> None:
    for name, part in coco_json.read(spark, args.file).split(args.val_frac, args.test_frac, args.seed).items():
        _saved(args, part, f"{args.output}_{name}.json")


def sample(spark: SparkSession, args) -> None:
    if (args.n is None) == (args.frac is None):
        raise SystemExit("give one of --n and --frac")
    _saved(args, coco_json.read(spark, args.file).sample(args.n, args.frac, args.seed), args.output)


def convert(spark: SparkSession, args) -> None:
    if (args.source == "coco") == (args.target == "coco"):
        raise SystemExit(f"unsupported conversion: {args.source} to {args.target}")
    if args.target == "coco":
        dims = None
        if args.dims:
            dims = spark.read.csv(args.dims, "stem string, width int, height int", header=True)
        elif args.images:
            dims = formats.image_sizes(spark, args.images)
        reader = {"yolo": lambda: formats.read_yolo(spark, args.input, dims), "dota": lambda: formats.read_dota(spark, args.input, dims), "voc": lambda: formats.read_voc(spark, args.input), "cvat": lambda: formats.read_cvat(spark, args.input)}
        coco_json.save(reader[args.source](), args.output)
        return
    d = coco_json.read(spark, args.input)
    if args.target == "cvat":
        formats.write_cvat(d, args.output)
        return
    os.makedirs(args.output, exist_ok=True)
    rows, suffix = {"yolo": (formats.yolo_rows, ".txt"), "voc": (formats.voc_rows, ".xml"), "dota": (formats.dota_rows, ".txt")}[args.target]
    formats.write_files(rows(d), args.output, suffix)
    names = [r["name"] for r in d.categories.orderBy("id").select("name").collect()]
    if args.target == "yolo":
        with open(os.path.join(args.output, "data.yaml"), "w", encoding="utf-8") as f:
            f.write(f"nc: {len(names)}\nnames: [{', '.join(names)}]\n")
    if args.target == "voc":
        with open(os.path.join(args.output, "labels.txt"), "w", encoding="utf-8") as f:
            f.write("\n".join(names) + "\n")


def compare(spark: SparkSession, args) -> None:
    d = coco_json.read(spark, args.gt)
    a, b = (Evaluation(d, coco_json.read_detections(spark, p), args.kind, "federated" if args.federated else "coco") for p in (args.dt_a, args.dt_b))
    _report(args, {f"{args.name_a} and {args.name_b}": _rows(a.compare(b, args.bootstrap, args.seed, args.confidence)), "categories": _rows(a.compare_categories(b))})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="detlake", description="Object-detection annotation data: evaluate, check, cut and convert.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, text):
        p = sub.add_parser(name, help=text)
        p.set_defaults(run=run)
        p.add_argument("--json", action="store_true", help="print JSON")
        return p

    def scored(p):
        p.add_argument("--iou-type", dest="kind", default="bbox", choices=KINDS)
        p.add_argument("--lvis", dest="federated", action="store_true", help="federated evaluation: 300 detections, frequency groups")

    p = command("eval", evaluate, "evaluate detections")
    p.add_argument("--gt", required=True)
    p.add_argument("--dt", required=True)
    scored(p)
    p.add_argument("--img-ids")
    p.add_argument("--cat-ids")
    p.add_argument("--no-cats", action="store_true", help="pool all categories")
    p.add_argument("--tide", dest="errors", action="store_true", help="error types and what their fix would add")
    p.add_argument("--tide-pos-thr", dest="pos_thr", type=float, default=0.5)
    p.add_argument("--tide-bg-thr", dest="bg_thr", type=float, default=0.1)
    p.add_argument("--calibration", action="store_true")
    p.add_argument("--cal-bins", dest="bins", type=int, default=10)
    p.add_argument("--cal-iou-thr", type=float, default=0.5)
    p.add_argument("--diagnostics", action="store_true")
    p.add_argument("--diag-iou-thr", type=float, default=0.5)
    p.add_argument("--diag-score-thr", type=float, default=0.5)
    p.add_argument("--slices", help="JSON file of image ids by slice name")
    p.add_argument("--healthcheck", action="store_true")
    p.add_argument("-o", "--output", help="write the results document here")
    p = command("healthcheck", healthcheck, "check a dataset")
    p.add_argument("file")
    p.add_argument("--dt")
    p = command("stats", stats, "statistics of a dataset")
    p.add_argument("file")
    p.add_argument("--all-cats", action="store_true")
    for name, run, text in (("filter", filter_, "keep some annotations"), ("split", split, "cut into train, val and test"), ("sample", sample, "draw images")):
        p = command(name, run, text)
        p.add_argument("file")
        p.add_argument("-o", "--output", required=True)
        if name == "filter":
            p.add_argument("--cat-ids")
            p.add_argument("--img-ids")
            p.add_argument("--area-rng")
            p.add_argument("--keep-empty-images", action="store_true")
        else:
            p.add_argument("--seed", type=int, default=42)
        if name == "split":
            p.add_argument("--val-frac", type=float, default=0.2)
            p.add_argument("--test-frac", type=float)
        if name == "sample":
            p.add_argument("--n", type=int)
            p.add_argument("--frac", type=float)
    p = command("merge", merge_, "join datasets of the same categories")
    p.add_argument("files", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p = command("convert", convert, "from or to the JSON format")
    p.add_argument("--from", dest="source", required=True, choices=["coco", "yolo", "voc", "cvat", "dota"])
    p.add_argument("--to", dest="target", required=True, choices=["coco", "yolo", "voc", "cvat", "dota"])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--images", help="folder of image files to read sizes from")
    p.add_argument("--dims", help="CSV of stem, width, height for formats without image sizes")
    p = command("compare", compare, "compare two models")
    p.add_argument("--gt", required=True)
    p.add_argument("--dt-a", required=True)
    p.add_argument("--dt-b", required=True)
    scored(p)
    p.add_argument("--bootstrap", type=int, default=0)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--confidence", type=float, default=0.95)
    p.add_argument("--name-a", default="Model A")
    p.add_argument("--name-b", default="Model B")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("detlake").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
