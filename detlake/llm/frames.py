"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are ordered: after all others.
NO_ID = (1 << 63) - 1
#: Keys with at least one in so many of all rows are joined by broadcast; there are at most as many.
HEAVY = 1_000
#: Bytes of an Arrow batch, which a task holds several times, in the JVM and in Python.
BATCH_BYTES = 2 << 20


_model: dict = {}


def model(key, make: Callable):
    """What ``make`` gives, kept by this Python worker until it needs a model under another key: workers outlive stages."""
    if key not in _model:
        forget()
        _model[key] = make()
    return _model[key]


def release() -> None:
    """Gives back to the system what earlier tasks of this worker have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def forget() -> None:
    """Drops the model that an earlier stage has left in this worker, and freed memory."""
    _model.clear()
    release()


def small_batches(spark: SparkSession) -> None:
    """Settings of the session that bound memory and disk.

    Texts are handed to Python in batches of at most BATCH_BYTES instead of
    64 MB; narrow rows aren't affected.  Shuffle files go as soon as a query
    has ended: what is read again is written to a table.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id (bigint) and text only, so that no other column's name can clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def _shared(spark: SparkSession) -> str:
    """The folder for tables in between: the checkpoint folder, set by the cluster or by SparkContext.setCheckpointDir.

    Only a local session without one (a test) takes a folder under its
    warehouse; on a cluster that would be no shared one, so it is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a compressed Parquet table in the shared folder, where it is read more than once or its lineage is cut.

    Its result may be read at any later time, so the table stays until
    ``discard`` is called or the driver ends.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(discard)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard() -> None:
    """Deletes the tables that ``written`` has made in this driver; DataFrames over them can't be read any more."""
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is None:
            continue  # the session has ended
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        except (Py4JError, OSError):
            pass  # the driver's end is no time to fail


def join_spread(rows: DataFrame, by_key: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to by_key (one row a key, with n, its number of rows), without n; no key's rows meet in one task for it.

    Keys that hold a HEAVY-th or more of the rows are at most HEAVY: these
    are broadcast.  All others are joined by key.
    """
    total = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    heavy, light = (by_key.where(x).drop("n") for x in (F.col("n") * HEAVY >= total, F.col("n") * HEAVY < total))
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions that the cluster's settings ask for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def sized(batches: Iterator[pa.RecordBatch], size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column holds about ``size`` bytes in each, or one row."""
    for batch in batches:
        at, n, lengths = 0, 0, pc.binary_length(batch.column(name)).to_pylist()
        for i, x in enumerate(lengths):
            if i > at and n + (x or 0) > size:
                yield batch.slice(at, i - at)
                at, n = i, 0
            n += x or 0
        if at < len(lengths):
            yield batch.slice(at)


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch], size: int = 8 << 20) -> Callable:
    """f over size-bounded batches, as mapInArrow wants it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in sized(batches, size):
            yield f(batch)

    return run
