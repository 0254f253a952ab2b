"""Detections that arrive as a stream: JSON lines are appended to a table, which is evaluated as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from detlake.sources import coco_json


def lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of detections from a folder of JSON lines files; lines that can't be parsed are left out."""
    reader = spark.readStream.schema(f"{coco_json.ANNOTATION}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).where("_corrupt_record is null and image_id is not null").drop("_corrupt_record")


def append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there and stops. The file sink's log gives each row exactly once, restarts included."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, table: str) -> DataFrame:
    """The table's detections, normalised. Ids count from 1 within an image by content, so they don't depend on arrival."""
    rows = spark.read.schema(coco_json.ANNOTATION).parquet(table)
    order = Window.partitionBy("image_id").orderBy("category_id", F.col("score").desc(), F.to_json(F.struct("bbox", "obb", "keypoints", "segmentation", "area")))
    return coco_json.detections(rows.withColumn("pos", F.row_number().over(order) - 1))
