"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.llm.frames import written


def _stars(pairs: DataFrame) -> DataFrame:
    """Links every pair's far node v to the least of the near node's star: (u, v) becomes (v, least)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return pairs.join(least, "u")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) of every node in a link (a, b).

    Each round links larger neighbours to the least of a node's whole star,
    then smaller ones to the least of its smaller star, until nothing
    changes; rounds grow with the logarithm of the longest path.  Each round
    is written to the shared folder.  Repeated links, both directions and
    self links are fine; no links give no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u and v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = _stars(large)
        small = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.where("u <> least").select("u", F.col("least").alias("v"))).distinct()
        edges = written(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = now
    raise RuntimeError("components did not settle")
