"""Annotation documents in JSON: one object of images, annotations and categories, or an array of detections."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.functions.geometry import every, rotated_bounds
from detlake.operators.dataset import Dataset

IMAGE = "id bigint, file_name string, height int, width int, license bigint, coco_url string, flickr_url string, date_captured string, neg_category_ids array<bigint>, not_exhaustive_category_ids array<bigint>"
ANNOTATION = "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, segmentation string, iscrowd string, keypoints array<double>, num_keypoints int, obb array<double>, score double, is_group_of boolean"
CATEGORY = "id bigint, name string, supercategory string, skeleton array<array<int>>, keypoints array<string>, frequency string"
DOCUMENT = f"info string, licenses string, images array<struct<{IMAGE.replace(' ', ':').replace(',:', ',')}>>, annotations array<struct<{ANNOTATION.replace(' ', ':').replace(',:', ',')}>>, categories array<struct<{CATEGORY.replace(' ', ':').replace(',:', ',')}>>"


def _crowd(c: Column) -> Column:
    """True, 1 or any other integer but 0."""
    low = F.lower(c)
    return F.coalesce((low == "true") | (low.try_cast("int") != 0), F.lit(False))


def normalised(annotations: DataFrame) -> DataFrame:
    """Box corners as columns; area and crowd defaults."""
    b = F.col("bbox")
    return annotations.select("id", "image_id", "category_id", *(F.get(b, F.lit(i)).alias(c) for i, c in enumerate("xywh")), "area", _crowd(F.col("iscrowd")).alias("iscrowd"), "segmentation", "keypoints", "num_keypoints", "obb", "score", F.coalesce("is_group_of", F.lit(False)).alias("is_group_of"))


def read(spark: SparkSession, path: str, image_dir: str | None = None) -> Dataset:
    """A dataset from a document; missing sections are empty, unknown keys are dropped."""
    return _dataset(spark.read.schema(DOCUMENT).json(path, multiLine=True), image_dir)


def _dataset(doc: DataFrame, image_dir: str | None) -> Dataset:
    section = lambda name: doc.select(F.explode(name).alias("r")).select("r.*")
    head = doc.select("info", "licenses").first()
    return Dataset(section("images"), normalised(section("annotations")), section("categories"), image_dir, *(head or (None, None)))


def from_dict(spark: SparkSession, data: dict, image_dir: str | None = None) -> Dataset:
    if not isinstance(data, dict):
        raise TypeError("a dict of images, annotations and categories is needed")
    return _dataset(spark.createDataFrame([(json.dumps(data),)], "j string").select(F.from_json("j", DOCUMENT).alias("d")).select("d.*"), image_dir)


def empty(spark: SparkSession) -> Dataset:
    return from_dict(spark, {})


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections from an array of them or from a document's annotations, normalised, with ids 1 .. n in file order."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{ANNOTATION.replace(' ', ':').replace(',:', ',')}>>")).otherwise(F.from_json("value", DOCUMENT)["annotations"]).alias("a"))
    return detections(rows.select(F.posexplode("a").alias("pos", "r")).select("pos", "r.*"))


def detections_from(spark: SparkSession, data) -> DataFrame:
    """Detections from a list of dicts, or a matrix of image, x, y, w, h, score (, category; else 1)."""
    if hasattr(data, "shape"):
        if data.ndim != 2 or data.shape[1] not in (6, 7):
            raise ValueError("6 or 7 columns are needed")
        data = [{"image_id": int(r[0]), "bbox": [float(v) for v in r[1:5]], "score": float(r[5]), "category_id": int(r[6]) if len(r) > 6 else 1} for r in data]
    doc = spark.createDataFrame([(json.dumps(data),)], "j string").select(F.from_json("j", f"array<struct<{ANNOTATION.replace(' ', ':').replace(',:', ',')}>>").alias("a"))
    return detections(doc.select(F.posexplode("a").alias("pos", "r")).select("pos", "r.*"))


def detections(rows: DataFrame) -> DataFrame:
    """Detections as loaded results: kind by the first row; area and box follow from it; ids by ``pos``; never crowds."""
    first = rows.orderBy("pos").select("bbox", "segmentation", "keypoints", "obb").limit(1).collect()
    rows = rows.withColumn("id", F.col("pos").cast("bigint") + 1)
    if first and first[0]["bbox"] is not None:
        b = F.col("bbox")
        rows = rows.withColumn("area", F.get(b, F.lit(2)) * F.get(b, F.lit(3))).withColumn("iscrowd", F.lit("false"))
        x, y, x2, y2 = b[0], b[1], b[0] + b[2], b[1] + b[3]
        rows = rows.withColumn("segmentation", F.coalesce("segmentation", F.to_json(F.array(F.array(x, y, x, y2, x2, y2, x2, y)))))
    elif first and first[0]["segmentation"] is not None and first[0]["keypoints"] is None:
        from detlake.operators.similarity import packed_extent

        found = F.pandas_udf(packed_extent, "area double, bbox array<double>")("segmentation")
        rows = rows.withColumn("_f", found).withColumn("area", F.coalesce("_f.area", "area")).withColumn("bbox", F.coalesce("bbox", "_f.bbox")).drop("_f").withColumn("iscrowd", F.lit("false"))
    elif first and first[0]["keypoints"] is not None:
        xs, ys = every(F.col("keypoints"), 3, 0), every(F.col("keypoints"), 3, 1)
        x, y = F.array_min(xs), F.array_min(ys)
        w, h = F.array_max(xs) - x, F.array_max(ys) - y
        rows = rows.withColumn("bbox", F.array(x, y, w, h)).withColumn("area", w * h).withColumn("iscrowd", F.lit("false"))
    elif first and first[0]["obb"] is not None:
        o = [F.col("obb")[i] for i in range(5)]
        rows = rows.withColumn("bbox", F.array(*rotated_bounds(*o))).withColumn("area", o[2] * o[3]).withColumn("iscrowd", F.lit("false"))
    return normalised(rows)


def warn_unknown(dt: DataFrame, d: Dataset) -> None:
    for table, column in (("images", "image_id"), ("categories", "category_id")):
        if not dt.join(getattr(d, table).select(F.col("id").alias(column)), column, "left_anti").isEmpty():
            warnings.warn(f"detections name ids that {table} lacks", stacklevel=2)


def elements(d: Dataset) -> dict[str, DataFrame]:
    """JSON text of every row by section; segmentations as JSON, absent options as null."""
    anns = d.annotations
    box = F.when(F.col("x").isNotNull(), F.array(*"xywh")).alias("bbox")
    shape = [F.try_parse_json("segmentation").alias("segmentation")] if "segmentation" in anns.columns else []
    anns = anns.select(*(c for c in anns.columns if c not in (*"xywh", "segmentation")), box, *shape)
    pack = lambda df: df.select("id", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    return {"images": pack(d.images), "annotations": pack(anns), "categories": pack(d.categories)}


def _head(d: Dataset) -> str:
    """The sections info and licenses, where there are any, each with a comma behind it."""
    return "".join(f'"{name}":{text},' for name, text in (("info", d.info), ("licenses", d.licenses)) if text)


def write_lines(d: Dataset, path: str) -> None:
    """A folder of JSON lines for each section, written by all tasks; ``read_lines`` reads it."""
    for name, rows in elements(d).items():
        rows.select("value").write.mode("overwrite").text(f"{path}/{name}")


def read_lines(spark: SparkSession, path: str) -> Dataset:
    anns = spark.read.schema(ANNOTATION).json(f"{path}/annotations")
    return Dataset(spark.read.schema(IMAGE).json(f"{path}/images"), normalised(anns), spark.read.schema(CATEGORY).json(f"{path}/categories"))


def write(d: Dataset, path: str) -> None:
    """A folder with one JSON document.

    The document is one object, so its sections are gathered; a dataset that
    one task can't hold goes to JSON lines (``write_lines``) or Parquet
    (``write_tables``).
    """
    gathered = [df.agg(F.collect_list("value").alias(name)) for name, df in elements(d).items()]
    row = gathered[0].crossJoin(gathered[1]).crossJoin(gathered[2])
    text = F.concat(F.lit("{" + _head(d) + '"images":['), F.array_join("images", ","), F.lit('],"annotations":['), F.array_join("annotations", ","), F.lit('],"categories":['), F.array_join("categories", ","), F.lit("]}"))
    row.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save(d: Dataset, path: str) -> None:
    """One JSON file on the driver's disk, in order of ids; rows stream there a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("{" + _head(d))
        for i, (name, rows) in enumerate(elements(d).items()):
            f.write("," * bool(i) + json.dumps(name) + ":[\n")
            for j, r in enumerate(rows.orderBy("id").toLocalIterator()):
                f.write((",\n" if j else "") + r["value"])
            f.write("]")
        f.write("}\n")


def write_tables(d: Dataset, path: str) -> None:
    for name in ("images", "annotations", "categories"):
        getattr(d, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> Dataset:
    return Dataset(*(spark.read.parquet(f"{path}/{name}") for name in ("images", "annotations", "categories")))
