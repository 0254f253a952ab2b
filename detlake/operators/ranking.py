"""A global ranking without a task that sees all rows."""

from __future__ import annotations

from collections import deque

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Numbered rows that are kept, of the last few rankings; older ones are given back.
_kept: deque[DataFrame] = deque()


def numbered(rows: DataFrame, key: Column) -> DataFrame:
    """rows with ``number``: 0 .. n - 1 by key (numeric), then id.

    Rows are dealt by ranges of key and id, sorted and kept; each range starts
    at the sizes of the ranges before it, which are all that the driver gets:
    one row for each range.  So the rows are made once, however many read the numbers.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_key", key).repartitionByRange(parts, "_key", "id").sortWithinPartitions("_key", "id")
    kept = dealt.drop("_key").withColumn("_at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    while len(_kept) > 4:
        _kept.popleft().unpersist()
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = [sum(n for p, n in sizes.items() if p < q) for q in range(max(sizes, default=0) + 1)]
    start = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in starts)), part + 1)
    return kept.withColumn("number", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("_at")


def numbered_names(rows: DataFrame, name: str) -> DataFrame:
    """name, number: the distinct texts of a column as 1 .. n in their order (null has none).

    Bounds come from a sample of bounded size, the texts of least hash, so
    every run cuts alike; the driver gets these and one count for each range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.select(name).where(F.col(name).isNotNull()).distinct()
    some = sorted(r[0] for r in names.orderBy(F.xxhash64(name), name).limit(16 * parts).collect())
    bounds = some[16::16]
    placed = names.withColumn("_part", sum(((F.col(name) >= b).cast("int") for b in bounds), F.lit(0)))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    start = F.element_at(F.array(*(F.lit(sum(n for p, n in sizes.items() if p < q)).cast("bigint") for q in range(len(bounds) + 1))), F.col("_part") + 1)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(name))
    return placed.select(name, (within + start).alias("number"))
