"""Dataset operations: look-ups, filters, merge, split, sample, statistics and health checks.

A dataset is three DataFrames: images (id, width, height, ...), annotations
(id, image_id, category_id, x, y, w, h, area, iscrowd, ...) and categories
(id, name, supercategory, ...).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detlake.functions.geometry import box, box_iou
from detlake.operators.ranking import numbered


@dataclass(frozen=True)
class Dataset:
    images: DataFrame
    annotations: DataFrame
    categories: DataFrame
    image_dir: str | None = None
    #: Free-form sections of a document, small and kept as JSON text.
    info: str | None = None
    licenses: str | None = None

    # Look-ups. Empty arguments don't filter.
    def ann_ids(self, img_ids=(), cat_ids=(), area_rng=None, iscrowd: bool | None = None) -> DataFrame:
        """Ids in order; an image that is named twice gives its annotations twice."""
        out = self.annotations
        if img_ids:
            out = out.join(self.images.sparkSession.createDataFrame([(int(i),) for i in img_ids], "image_id bigint"), "image_id")
        if cat_ids:
            out = out.where(F.col("category_id").isin(*cat_ids))
        if area_rng is not None:
            out = out.where(F.coalesce("area", F.lit(0.0)).between(*area_rng))
        if iscrowd is not None:
            out = out.where(F.coalesce("iscrowd", F.lit(False)) == iscrowd)
        return out.select("id").orderBy("id")

    def postings(self) -> DataFrame:
        """image_id, category_id, ids (in order): the annotations of every image and category that have any."""
        return self.annotations.groupBy("image_id", "category_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def pairs(self) -> DataFrame:
        """image_id, category_id that have annotations."""
        return self.annotations.select("image_id", "category_id").distinct()

    def cat_ids(self, names=(), supernames=(), ids=()) -> DataFrame:
        out = self.categories
        for column, values in (("name", names), ("supercategory", supernames), ("id", ids)):
            if values:
                out = out.where(F.col(column).isin(*values))
        return out.select("id")

    def img_ids(self, img_ids=(), cat_ids=()) -> DataFrame:
        """Ids given pass through even if unknown; categories keep images with any of them."""
        spark = self.images.sparkSession
        out = spark.createDataFrame([(i,) for i in sorted(set(img_ids))], "id bigint") if img_ids else self.images.select("id")
        if cat_ids:
            out = out.join(self.annotations.where(F.col("category_id").isin(*cat_ids)).select(F.col("image_id").alias("id")), "id", "left_semi")
        return out

    def load(self, table: str, ids: list[int]) -> DataFrame:
        """Rows of a table in the order of ids; unknown ids are dropped, repeated ones repeat."""
        wanted = self.images.sparkSession.createDataFrame(list(enumerate(ids)), "pos bigint, id bigint")
        return getattr(self, table).join(wanted, "id").orderBy("pos").drop("pos")

    def filter(self, cat_ids=None, img_ids=None, area_rng=None, drop_empty_images: bool = True) -> Dataset:
        """Keeps matching annotations, their categories, and their images (or, if empty ones stay, the images asked for)."""
        anns = self.annotations
        if cat_ids is not None:
            anns = anns.where(F.col("category_id").isin(*cat_ids))
        if img_ids is not None:
            anns = anns.where(F.col("image_id").isin(*img_ids))
        if area_rng is not None:
            anns = anns.where(F.coalesce("area", F.lit(0.0)).between(*area_rng))
        images, named = self.images, lambda column: anns.select(F.col(column).alias("id")).distinct()  # counted where they are: a task of a join by category would hold all of one
        if drop_empty_images:
            images = images.join(named("image_id"), "id", "left_semi")
        elif img_ids is not None:
            images = images.where(F.col("id").isin(*img_ids))
        return replace(self, images=images, annotations=anns, categories=self.categories.join(named("category_id"), "id", "left_semi"))

    def subset(self, images: DataFrame) -> Dataset:
        return replace(self, images=images, annotations=self.annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi"))

    def split(self, val_frac: float = 0.2, test_frac: float | None = None, seed: int = 42) -> dict[str, Dataset]:
        """train, val (and test) by a seeded order of image ids; counts are rounded, all categories stay."""
        n = self.images.count()
        n_val = min(n, int(n * val_frac + 0.5))
        n_test = min(n - n_val, int(n * test_frac + 0.5)) if test_frac is not None else 0
        placed = numbered(self.images, seeded(seed))
        parts = {"train": F.col("number") >= n_val + n_test, "val": F.col("number") < n_val}
        if test_frac is not None:
            parts["test"] = (F.col("number") >= n_val) & (F.col("number") < n_val + n_test)
        return {k: self.subset(placed.where(c).drop("number")) for k, c in parts.items()}

    def sample(self, n: int | None = None, frac: float | None = None, seed: int = 42) -> Dataset:
        """n images, or that share of them (rounded down), or all."""
        if n is None and frac is not None:
            n = int(self.images.count() * frac)
        if n is None:
            return self
        return self.subset(numbered(self.images, seeded(seed)).where(F.col("number") < n).drop("number"))

    def stats(self) -> DataFrame:
        """metric, value: counts, and least, greatest, mean and median width, height and annotation area (0 if empty)."""
        four = lambda c: [f(c) for f in (F.min, F.max, F.avg, F.median)]
        im, an = self.images, self.annotations
        one = im.agg(F.count("*"), *four("width"), *four("height"))
        two = an.agg(F.count("*"), F.count_if(F.coalesce("iscrowd", F.lit(False))), *four("area"))
        three = self.categories.agg(F.count("*"))
        of = lambda c: [f"{c}_{x}" for x in ("min", "max", "mean", "median")]
        names = ["images", *of("width"), *of("height"), "annotations", "crowds", *of("area"), "categories"]
        row = one.crossJoin(two).crossJoin(three).toDF(*names)
        return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in names)))).alias("metric", "value"))

    def category_stats(self) -> DataFrame:
        n = self.annotations.groupBy("category_id").agg(F.count("*").alias("n_annotations"), F.countDistinct("image_id").alias("n_images"), F.count_if(F.coalesce("iscrowd", F.lit(False))).alias("n_crowds"))
        return self.categories.select(F.col("id").alias("category_id"), "name").join(n, "category_id", "left").fillna(0, ["n_annotations", "n_images", "n_crowds"])

    def tree(self) -> DataFrame:
        """supercategory (``_ungrouped`` for none), names in order."""
        group = F.when(F.coalesce("supercategory", F.lit("")) == "", "_ungrouped").otherwise(F.col("supercategory"))
        return self.categories.groupBy(group.alias("supercategory")).agg(F.array_sort(F.collect_list("name")).alias("names"))


def seeded(seed: int) -> Column:
    """A deterministic pseudo-random key of the id, in arithmetic that other engines share."""
    x = (F.pmod(F.col("id"), F.lit(2147483647)) * 48271 + F.lit(seed) * 7919 + 11) % 2147483647
    return (x * 48271 + 11) % 2147483647


def merge(datasets: list[Dataset]) -> Dataset:
    """All datasets as one: categories of the first, image and annotation ids moved behind those before.

    Category names with supercategories must be the same in all; ids are
    mapped by them.  info and licenses are the first's.  No datasets merge
    into an empty one, in the active session.
    """
    if not datasets:
        from detlake.sources.coco_json import empty

        return empty(SparkSession.active())
    first = datasets[0]
    pair = lambda d: {(r["name"], r["supercategory"]): r["id"] for r in d.categories.select("id", "name", "supercategory").collect()}  # noqa: E731 (taxonomies are small)
    known, at_image, at_ann = pair(first), 0, 0
    images, anns = [], []
    for d in datasets:
        own = pair(d)
        if len(own) != len(known) or not own.keys() <= known.keys():
            raise ValueError("categories differ")
        ids = F.create_map(*(x for k, v in own.items() for x in (F.lit(v), F.lit(known[k]))))
        images.append(d.images.withColumn("id", F.col("id") + at_image))
        anns.append(d.annotations.withColumn("id", F.col("id") + at_ann).withColumn("image_id", F.col("image_id") + at_image).withColumn("category_id", F.element_at(ids, F.col("category_id"))))
        at_image += d.images.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        at_ann += d.annotations.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    join = lambda parts: parts[0] if len(parts) == 1 else join([parts[0].unionByName(parts[1], allowMissingColumns=True), *parts[2:]])
    return Dataset(join(images), join(anns), first.categories, info=first.info, licenses=first.licenses)


def near_duplicates(annotations: DataFrame, thr: float = 0.95, most: int = 100) -> DataFrame:
    """id of annotations that overlap another of their image and category by more than thr; larger groups than ``most`` are left out."""
    rows = annotations.where("w > 0 and h > 0").withColumn("_n", F.count("*").over(Window.partitionBy("image_id", "category_id"))).where((F.col("_n") <= most) & (F.col("_n") > 1))
    left = rows.select("image_id", "category_id", "id", *"xywh")
    right = rows.select("image_id", "category_id", F.col("id").alias("id_b"), *(F.col(c).alias(f"g{c}") for c in "xywh"))
    pairs = left.join(right, ["image_id", "category_id"]).where((F.col("id") < F.col("id_b")) & (box_iou(box(), box("g")) > thr))
    return pairs.select(F.explode(F.array("id", "id_b")).alias("id")).distinct()


def health(d: Dataset) -> DataFrame:
    """code, layer, id: a row for every finding."""
    images, anns, cats = d.images, d.annotations, d.categories

    def again(df: DataFrame, code: str) -> DataFrame:
        n = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        return n.select(F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("n"))), "id").select(F.lit(code).alias("code"), F.lit("structure").alias("layer"), "id")

    def found(df: DataFrame, code: str, layer: str = "quality", column: str = "id") -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(layer).alias("layer"), F.col(column).cast("bigint").alias("id"))

    boxed = anns.where("w is not null")
    degenerate = (F.col("w") <= 0) | (F.col("h") <= 0)
    sound = boxed.where(~degenerate)
    dims = images.groupBy(F.col("id").alias("image_id")).agg(F.max("width").alias("iw"), F.max("height").alias("ih"))
    n = anns.groupBy("category_id").agg(F.count("*").alias("n"))
    per_cat = cats.select(F.col("id").alias("category_id")).join(n, "category_id", "left").fillna(0, ["n"])
    big = sound.groupBy("image_id", "category_id").count().where("count > 100").select("image_id").distinct()
    parts = [
        again(images, "duplicate_image_id"), again(anns, "duplicate_ann_id"), again(cats, "duplicate_category_id"),
        found(anns.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti"), "orphan_image_id", "structure"),
        found(anns.join(F.broadcast(cats.select(F.col("id").alias("category_id"))), "category_id", "left_anti"), "orphan_category_id", "structure"),
        found(anns.where("w is null"), "missing_geometry", "structure"),
        found(images.where("width = 0 or height = 0"), "zero_dimensions", "structure"),
        found(boxed.where(degenerate), "degenerate_bbox"), found(sound.where("area = 0"), "zero_area"),
        found(sound.join(dims, "image_id").where("x + w > iw or y + h > ih"), "bbox_out_of_bounds"),
        found(sound.where(F.greatest("w", "h") / F.least("w", "h") > 20), "extreme_aspect_ratio"),
        found(near_duplicates(anns), "near_duplicate"), found(big, "near_duplicate_check_skipped", column="image_id"),
        found(per_cat.where("n = 0"), "zero_instance_category", "distribution", "category_id"), found(per_cat.where("n > 0 and n < 10"), "low_instance_category", "distribution", "category_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detection_health(dt: DataFrame, d: Dataset) -> DataFrame:
    """code, id of detections without a known image or category, and without a score from 0 to 1.

    One pass over the detections: they meet the images in one shuffle, and
    categories, a small table, are broadcast, so no task holds all of one.
    """
    known = lambda df, column: df.select(F.col("id").alias(column), F.lit(True).alias(f"_{column}")).distinct()
    rows = dt.select("id", "image_id", "category_id", "score").join(known(d.images, "image_id"), "image_id", "left").join(F.broadcast(known(d.categories, "category_id")), "category_id", "left")
    found = {
        "dt_orphan_image_id": F.col("_image_id").isNull(),
        "dt_orphan_category_id": F.col("_category_id").isNull(),
        "dt_missing_score": F.col("score").isNull(),
        "dt_score_out_of_range": ~F.col("score").between(0.0, 1.0) | F.isnan("score"),
    }
    return rows.select(F.explode(F.array_compact(F.array(*(F.when(bad, code) for code, bad in found.items())))).alias("code"), "id")


def health_summary(d: Dataset) -> DataFrame:
    """metric, value: counts, images without annotations, imbalance (largest over smallest category that isn't empty; 1 for fewer than two)."""
    empty = d.images.join(d.annotations.select(F.col("image_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("images_without_annotations"))
    n = d.category_stats().where("n_annotations > 0").agg(F.when(F.count("*") < 2, 1.0).otherwise(F.max("n_annotations") / F.min("n_annotations")).alias("imbalance"))
    row = d.images.agg(F.count("*").alias("images")).crossJoin(d.annotations.agg(F.count("*").alias("annotations"))).crossJoin(d.categories.agg(F.count("*").alias("categories"))).crossJoin(empty).crossJoin(n)
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, row.columns)), F.array(*(F.col(c).cast("double") for c in row.columns)))).alias("metric", "value"))
