"""YOLO, Pascal VOC, CVAT and DOTA annotation folders as datasets, and text rows for writing them."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detlake.functions.geometry import corners, every, polygon_area, rotated_bounds, rotated_from_corners
from detlake.operators.dataset import Dataset
from detlake.operators.ranking import numbered, numbered_names

_STEM = r"([^/]*?)(\.[^./]*)?$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, stem, line number and text of all lines of text files."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("file_name"), F.decode("content", "UTF-8").alias("value"))
    return files.select("file_name", F.regexp_extract("file_name", _STEM, 1).alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


def _with_ids(files: DataFrame, order: str = "stem") -> DataFrame:
    """Image ids from 1 in order of a name, ranked by all tasks; only names are sorted, the rest is joined to them."""
    return files.join(numbered_names(files, order).withColumnRenamed("number", "id"), order)


def _categories(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(i + 1, n, None) for i, n in enumerate(names)], "id bigint, name string, supercategory string")


def _in_order(known: list[str], seen: list[str]) -> list[str]:
    """Known names first, as given, then the others as seen; all by name where none is known."""
    return [*known, *(n for n in seen if n not in set(known))] if known else sorted(seen)


def _listed(text: str) -> list[str]:
    """Items of a comma-separated list; quoted ones may hold commas."""
    found = re.findall(r"""\s*(?:"([^"]*)"|'([^']*)'|([^,]+?))\s*(?:,|$)""", text)
    return [x for x in (a or b or c.strip() for a, b, c in found) if x]


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """stem, width, height from the headers of the PNG, JPEG, GIF and BMP files of a folder; others have no row.

    Only the head of a file is parsed; that of a JPEG file ends where its
    frame starts, wherever that is.
    """
    def size(data: bytes) -> tuple[int, int] | None:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:3] == b"GIF":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        at = 2 if data[:2] == b"\xff\xd8" else len(data)
        while at + 9 <= len(data):
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + length
        return None

    @F.pandas_udf("struct<width:int,height:int>")
    def sizes(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([size(x) or (None, None) for x in content], columns=["width", "height"], dtype="Int32")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,PNG,jpg,JPG,jpeg,JPEG,gif,GIF,bmp,BMP}").load(path)
    rows = files.select(F.regexp_extract(F.regexp_extract("path", "[^/]*$", 0), _STEM, 1).alias("stem"), sizes("content").alias("s"))
    return rows.select("stem", "s.*").where("width is not null")


def read_yolo(spark: SparkSession, path: str, dims: DataFrame | None = None) -> Dataset:
    """A folder of ``data.yaml`` and one text file per image with ``class cx cy w h`` lines.

    dims (stem, width, height) gives the sizes; images without are 0 x 0.
    A line that isn't five numbers or names an unknown class is an error.
    """
    yaml = "\n".join(r["value"] for r in spark.read.text(f"{path}/data.yaml").collect())
    names = _listed(re.search(r"names:\s*\[(.*?)\]", yaml, re.S)[1])
    cats = _categories(spark, names)
    lines = _lines(spark, f"{path}/*.txt")
    stems = lines.select("stem")
    if dims is not None:  # Spark doesn't list empty files; dims names their images
        stems = stems.unionByName(dims.select("stem"))
    images = _with_ids(stems.distinct())
    if dims is not None:
        images = images.join(dims, "stem", "left")
    else:
        images = images.withColumn("width", F.lit(0)).withColumn("height", F.lit(0))
    images = images.select("id", "stem", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), F.concat("stem", F.lit(".jpg")).alias("file_name"))
    return Dataset(images.drop("stem"), _numbered(yolo_boxes(lines, images, len(names))), cats)


def yolo_boxes(lines: DataFrame, images: DataFrame, n_classes: int) -> DataFrame:
    """image_id, line, category_id, box, area and iscrowd of label lines (file_name, stem, line, text); images have id, stem, width, height."""
    parts = F.split(F.trim("text"), r"\s+")
    ok = (F.size(parts) == 5) & (parts[0].try_cast("int").between(0, n_classes - 1))
    rows = lines.where(F.trim("text") != "").withColumn("p", F.when(ok, parts).otherwise(F.raise_error(F.concat(F.lit("bad line in "), "stem", F.lit(": "), "text")))).join(images.select("id", "stem", "width", "height"), "stem")
    n = [F.col("p")[i].cast("double") for i in range(5)]
    w, h = n[3] * F.col("width"), n[4] * F.col("height")
    return rows.select(F.col("id").alias("image_id"), "line", (n[0].cast("bigint") + 1).alias("category_id"), (n[1] * F.col("width") - w / 2).alias("x"), (n[2] * F.col("height") - h / 2).alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"), F.lit(False).alias("iscrowd"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Annotation ids from 1 by image and line."""
    keyed = rows.withColumn("id", F.col("image_id") * (1 << 24) + F.col("line"))
    return numbered(keyed, F.col("id")).withColumn("id", F.col("number") + 1).drop("number", "line")


def yolo_rows(d: Dataset) -> DataFrame:
    """stem, text: the label file of every image, empty ones too. Crowds, boxless and unknown ones are left out."""
    classes = d.categories.select(F.col("id").alias("category_id"), (F.row_number().over(Window.orderBy("id")) - 1).alias("c"))
    six = lambda x: F.format_string("%.6f", x)
    im = d.images.select(F.col("id").alias("image_id"), F.regexp_extract("file_name", _STEM, 1).alias("stem"), "width", "height")
    rows = d.annotations.where(~F.coalesce("iscrowd", F.lit(False)) & F.col("w").isNotNull()).join(classes, "category_id").join(im, "image_id")
    rows = rows.withColumn("_z", F.when((F.col("width") > 0) & (F.col("height") > 0), 1).otherwise(F.raise_error(F.lit("an image has no size"))))
    line = F.concat_ws(" ", F.col("c").cast("string"), six((F.col("x") + F.col("w") / 2) / F.col("width")), six((F.col("y") + F.col("h") / 2) / F.col("height")), six(F.col("w") / F.col("width")), six(F.col("h") / F.col("height")))
    text = rows.where("_z = 1").groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("t")))), lambda s: s["t"]), "\n").alias("text"))
    return im.join(text, "image_id", "left").select("stem", F.coalesce("text", F.lit("")).alias("text"))


def read_voc(spark: SparkSession, path: str, labels: list[str] | None = None) -> Dataset:
    """A folder of XML files (or its ``Annotations``) with objects; part boxes are ignored, images are numbered by file.

    Categories in the order of labels, or of ``labels.txt`` in the folder,
    then others as first seen; by name where there is no list.
    """
    folder, listed = _voc_folder(spark, path)
    labels = labels or listed
    schema = "filename string, size struct<width:int,height:int>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(f"{folder}/*.xml").select("*", F.col("_metadata.file_name").alias("_file"))
    images = _with_ids(rows.select("_file", F.col("filename").alias("file_name"), F.coalesce("size.width", F.lit(0)).alias("width"), F.coalesce("size.height", F.lit(0)).alias("height"), "object"), "_file")
    each = images.select(F.col("id").alias("image_id"), F.posexplode("object").alias("line", "o"))
    seen = each.where("o.name is not null").groupBy("o.name").agg(F.min(F.struct("image_id", "line")).alias("at")).orderBy("at")
    cats = _categories(spark, _in_order(labels, [r["name"] for r in seen.collect()]))
    b = "o.bndbox."
    w, h = F.col(b + "xmax") - F.col(b + "xmin"), F.col(b + "ymax") - F.col(b + "ymin")
    rows = each.join(cats.select(F.col("id").alias("category_id"), "name"), F.col("o.name") == F.col("name"))
    rows = rows.select("image_id", "line", "category_id", F.col(b + "xmin").alias("x"), F.col(b + "ymin").alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"), F.lit(False).alias("iscrowd"), (F.coalesce("o.difficult", F.lit(0)) != 0).alias("difficult"))
    return Dataset(images.select("id", "file_name", "width", "height"), _numbered(rows), cats)


def _voc_folder(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """Where the XML files are, and the names in ``labels.txt``."""
    files = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    exists = lambda p: files.Path(p).getFileSystem(conf).exists(files.Path(p))
    listed = [r["value"].strip() for r in spark.read.text(f"{path}/labels.txt").collect()] if exists(f"{path}/labels.txt") else []
    return (f"{path}/Annotations" if exists(f"{path}/Annotations") else path), [n for n in listed if n]


def voc_rows(d: Dataset) -> DataFrame:
    """stem, text: an XML file for every image; coordinates rounded half away from zero, crowds as difficult."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    whole = lambda c: F.round(c).cast("bigint").cast("string")
    im = d.images.select(F.col("id").alias("image_id"), "file_name", "width", "height")
    rows = d.annotations.where("w is not null").join(d.categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    obj = tag("object", F.concat(tag("name", esc(F.col("name"))), tag("difficult", F.col("iscrowd").cast("int").cast("string")), tag("bndbox", F.concat(tag("xmin", whole(F.col("x"))), tag("ymin", whole(F.col("y"))), tag("xmax", whole(F.col("x") + F.col("w"))), tag("ymax", whole(F.col("y") + F.col("h")))))))
    objs = rows.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", obj.alias("t")))), lambda s: s["t"]), "").alias("objects"))
    out = im.join(objs, "image_id", "left")
    text = tag("annotation", F.concat(tag("filename", esc(F.col("file_name"))), tag("size", F.concat(tag("width", F.col("width").cast("string")), tag("height", F.col("height").cast("string")), F.lit("<depth>3</depth>"))), F.coalesce("objects", F.lit(""))))
    return out.select(F.regexp_extract("file_name", _STEM, 1).alias("stem"), text.alias("text"))


def read_dota(spark: SparkSession, path: str, dims: DataFrame | None = None) -> Dataset:
    """A folder of text files with eight corner numbers, a class and a difficulty on each line; other lines are skipped.

    Categories are numbered in the order in which files and lines name them.
    """
    lines = _lines(spark, f"{path}/*.txt")
    images = _with_ids(lines.select("stem").distinct())
    images = images.join(dims, "stem", "left") if dims is not None else images.withColumn("width", F.lit(0)).withColumn("height", F.lit(0))
    p = F.split(F.trim("text"), r"\s+")
    n = [F.get(p, F.lit(i)).try_cast("double") for i in range(8)]
    rows = lines.where(F.size(p) >= 9).select("stem", "line", F.get(p, F.lit(8)).alias("name"), F.coalesce(F.get(p, F.lit(9)).try_cast("int"), F.lit(0)).alias("difficult"), *(c.alias(f"c{i}") for i, c in enumerate(n)))
    rows = rows.where(" and ".join(f"c{i} is not null" for i in range(8))).join(images.select(F.col("id").alias("image_id"), "stem"), "stem")
    first = rows.groupBy("name").agg(F.min(F.struct("image_id", "line")).alias("at"))
    cats = first.select(F.row_number().over(Window.orderBy("at")).cast("bigint").alias("id"), "name", F.lit(None).cast("string").alias("supercategory"))
    obb = rotated_from_corners([(F.col(f"c{2 * i}"), F.col(f"c{2 * i + 1}")) for i in range(4)])
    rows = rows.join(cats.select(F.col("id").alias("category_id"), "name"), "name").select("image_id", "line", "category_id", "difficult", F.array(*obb).alias("obb"))
    x, y, w, h = rotated_bounds(*(F.col("obb")[i] for i in range(5)))
    rows = rows.select("image_id", "line", "category_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (F.col("obb")[2] * F.col("obb")[3]).alias("area"), (F.col("difficult") != 0).alias("iscrowd"), "obb")
    return Dataset(images.select("id", F.concat("stem", F.lit(".png")).alias("file_name"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height")), _numbered(rows), cats)


def read_cvat(spark: SparkSession, path: str, labels: list[str] | None = None) -> Dataset:
    """A CVAT-for-images file with boxes and polygons; other shapes are skipped.

    Categories in the order of labels, or of the file's own label list, then
    others by name; images are numbered by their ids.
    """
    schema = "_id bigint, _name string, _width int, _height int, box array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double>>, polygon array<struct<_label:string,_points:string>>"
    rows = spark.read.format("xml").option("rowTag", "image").schema(schema).load(path)
    keyed = rows.withColumn("_key", F.concat(F.lpad(F.coalesce("_id", F.lit(0)).cast("string"), 20, "0"), F.lit(" "), F.coalesce("_name", F.lit(""))))
    images = _with_ids(keyed, "_key").select("id", F.col("_name").alias("file_name"), F.col("_width").alias("width"), F.col("_height").alias("height"), "box", "polygon")
    boxes = images.select(F.col("id").alias("image_id"), F.posexplode("box").alias("line", "b")).select("image_id", "line", F.col("b._label").alias("name"), F.col("b._xtl").alias("x"), F.col("b._ytl").alias("y"), (F.col("b._xbr") - F.col("b._xtl")).alias("w"), (F.col("b._ybr") - F.col("b._ytl")).alias("h"), F.lit(None).cast("array<double>").alias("xy"))
    numbers = F.transform(F.split(F.regexp_replace("p._points", ";", ","), ","), lambda v: F.trim(v).cast("double"))
    polys = images.select(F.col("id").alias("image_id"), F.posexplode("polygon").alias("line", "p")).select("image_id", (F.col("line") + (1 << 20)).alias("line"), F.col("p._label").alias("name"), numbers.alias("xy"))
    xs, ys = every(F.col("xy"), 2, 0), every(F.col("xy"), 2, 1)
    polys = polys.select("image_id", "line", "name", F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"), "xy")
    shapes = boxes.unionByName(polys)
    meta = spark.read.format("xml").option("rowTag", "labels").schema("label array<struct<name:string>>").load(path)
    known = labels or [r["name"].strip() for r in meta.select(F.posexplode("label").alias("i", "l")).select("i", "l.name").orderBy("i").collect() if r["name"]]
    cats = _categories(spark, _in_order(known, sorted(r[0] for r in shapes.select("name").distinct().collect())))
    area = F.when(F.col("xy").isNull(), F.col("w") * F.col("h")).otherwise(polygon_area(F.coalesce("xy", F.array().cast("array<double>"))))
    shapes = shapes.join(cats.select(F.col("id").alias("category_id"), "name"), "name")
    rows = shapes.select("image_id", "line", "category_id", *"xywh", area.alias("area"), F.lit(False).alias("iscrowd"), F.when(F.col("xy").isNotNull(), F.to_json(F.array("xy"))).alias("segmentation"))
    return Dataset(images.drop("box", "polygon"), _numbered(rows), cats)


def cvat_rows(d: Dataset) -> DataFrame:
    """image_id, text: an ``image`` element with its shapes for every image.

    Polygons are preferred to the box; those of under four numbers, unknown
    categories and annotations without geometry are left out.
    """
    two = lambda x: F.format_string("%.2f", x)
    attr = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))

    def esc(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    label = attr("label", esc(F.col("name")))
    end = F.lit(' occluded="0"/>')
    point = lambda p, i: F.concat_ws(",", two(F.get(p, 2 * i)), two(F.get(p, 2 * i + 1)))
    points = lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), lambda i: point(p, i)), ";")
    anns = d.annotations if "segmentation" in d.annotations.columns else d.annotations.withColumn("segmentation", F.lit(None).cast("string"))
    rows = anns.join(d.categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    rows = rows.withColumn("polygons", F.when(F.ltrim("segmentation").startswith("["), F.from_json("segmentation", "array<array<double>>")))
    polygon = F.transform(F.filter("polygons", lambda p: F.size(p) >= 4), lambda p: F.concat(F.lit("<polygon"), label, attr("points", points(p)), end))
    box = F.concat(F.lit("<box"), label, attr("xtl", two(F.col("x"))), attr("ytl", two(F.col("y"))), attr("xbr", two(F.col("x") + F.col("w"))), attr("ybr", two(F.col("y") + F.col("h"))), end)
    shape = F.when(F.col("polygons").isNotNull(), F.array_join(polygon, "")).when(F.col("w").isNotNull(), box)
    shapes = rows.withColumn("t", shape).where("t is not null").groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "t"))), lambda s: s["t"]), "").alias("shapes"))
    im = d.images.select(F.col("id").alias("image_id"), "file_name", "width", "height").join(shapes, "image_id", "left")
    head = F.concat(F.lit("<image"), attr("id", F.col("image_id").cast("string")), attr("name", esc(F.coalesce("file_name", F.lit("")))), attr("width", F.col("width").cast("string")), attr("height", F.col("height").cast("string")), F.lit(">"))
    return im.select("image_id", F.concat(head, F.coalesce("shapes", F.lit("")), F.lit("</image>")).alias("text"))


def write_cvat(d: Dataset, path: str) -> None:
    """One document. Images stream to the driver, which writes it, a partition at a time."""
    from xml.sax.saxutils import escape

    names = [r["name"] for r in d.categories.orderBy("id").select("name").collect()]
    labels = "".join(f"<label><name>{escape(n)}</name></label>" for n in names)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<annotations><version>1.1</version><meta><task><labels>{labels}</labels></task></meta>\n")
        for r in cvat_rows(d).orderBy("image_id").toLocalIterator():
            f.write(r["text"] + "\n")
        f.write("</annotations>\n")


def dota_rows(d: Dataset) -> DataFrame:
    """stem, text: corner lines of every image with rotated boxes (column obb)."""
    one = lambda x: F.format_string("%.1f", x)
    im = d.images.select(F.col("id").alias("image_id"), F.regexp_extract("file_name", _STEM, 1).alias("stem"))
    rows = d.annotations.where("obb is not null").join(d.categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    line = F.concat_ws(" ", *(one(v) for p in corners(*(F.col("obb")[i] for i in range(5))) for v in p), F.coalesce("name", F.lit("unknown")), F.col("iscrowd").cast("int").cast("string"))
    text = rows.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("t")))), lambda s: s["t"]), "\n").alias("text"))
    return im.join(text, "image_id", "left").select("stem", F.coalesce("text", F.lit("")).alias("text"))


def write_files(rows: DataFrame, path: str, suffix: str) -> None:
    """One file per row under path, by the partition that has the row; path is in storage that all executors share."""

    def put(part) -> None:
        import os

        os.makedirs(path, exist_ok=True)
        for r in part:
            with open(os.path.join(path, r["stem"] + suffix), "w", encoding="utf-8") as f:
                f.write(r["text"])

    rows.foreachPartition(put)
