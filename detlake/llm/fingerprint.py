"""Bottom-k fingerprints of word shingles (operator 10)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.llm.flat import rolling, words_of
from detlake.llm.frames import NO_ID, documents, partitions, sized

SHINGLE = 5
SIZE = 64


class BottomK:
    """The ``size`` smallest distinct shingle hashes of a text or of several.

    Sketches of parts merge into the sketch of the whole.  As long as no more
    than ``size`` distinct hashes went in, every estimate is exact.
    """

    def __init__(self, hashes: np.ndarray, size: int = SIZE):
        self.size, self.hashes = size, np.unique(hashes)[:size]

    @classmethod
    def of(cls, text: str, shingle: int = SHINGLE, size: int = SIZE) -> BottomK:
        return sketches([text.encode()], shingle, size)[0]

    @classmethod
    def parse(cls, text: str) -> BottomK:
        size, _, data = text.partition(":")
        return cls(np.frombuffer(base64.b64decode(data), ">u8").astype(np.uint64), int(size))

    def __str__(self) -> str:
        return f"{self.size}:{base64.b64encode(self.hashes.astype('>u8').tobytes()).decode()}"

    def merge(self, other: BottomK) -> BottomK:
        return BottomK(np.concatenate([self.hashes, other.hashes]), min(self.size, other.size))

    def distinct(self) -> float:
        """Estimated number of distinct shingles."""
        if len(self.hashes) < self.size:
            return float(len(self.hashes))
        return (self.size - 1) / ((float(self.hashes[-1]) + 1) / 2.0**64)

    def resemblance(self, other: BottomK) -> float:
        """Estimated Jaccard similarity of the shingle sets; 1 for two empty ones."""
        both = self.merge(other).hashes
        if not len(both):
            return 1.0
        shared = np.isin(both, self.hashes, assume_unique=True) & np.isin(both, other.hashes, assume_unique=True)
        return float(shared.sum()) / len(both)

    def containment(self, other: BottomK) -> float:
        """Estimated share of this text's shingles that the other has; 1 if this has none."""
        if not len(self.hashes):
            return 1.0
        r, n = self.resemblance(other), self.distinct()
        return min(1.0, r * (n + other.distinct()) / (1 + r) / n)


def sketches(texts: list[bytes], shingle: int = SHINGLE, size: int = SIZE) -> list[BottomK]:
    """A sketch for each text; one of fewer words than a shingle has its whole word sequence as one."""
    words = words_of(texts)
    h = rolling(words.hash, shingle)
    first, out = words.first.tolist(), []
    for a, b in zip(first, first[1:]):
        if b - a >= shingle:
            out.append(BottomK(h[a : b - shingle + 1], size))
        else:
            out.append(BottomK(rolling(words.hash[a:b], b - a) if b > a else words.hash[:0], size))
    return out


def fingerprints(docs: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint of each row's whole text, as a string that BottomK.parse reads.

    Null and empty texts have the empty sketch.  Merging the fingerprints of
    parts is BottomK.merge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 4 << 20):
            some = sketches([(x or "").encode() for x in batch.column("text").to_pylist()], shingle, size)
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(str, some), pa.string())], names=["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


def in_descending_order(docs: DataFrame) -> DataFrame:
    """Rows dealt into buckets of consecutive doc_ids, each sorted, with a copy of the row that follows the bucket.

    Bucket bounds are quantiles of the ids.  One shuffle moves every text
    once; besides, the first row of each bucket goes to the bucket before it
    (the very first one to the last bucket), as ``tail``.  What the driver
    gets is two ids for each bucket.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_key"), "doc_id", "text")
    bounds = sorted(set(rows.select(F.col("_key").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    edges = np.array(bounds, np.float64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, key.to_numpy().astype(np.float64), "right")).astype("int32")

    rows = rows.withColumn("_bucket", bucket("_key"))
    tops = rows.groupBy("_bucket").agg(F.max("_key").alias("top")).orderBy("_bucket").collect()
    if not tops:
        return rows.withColumn("_tail", F.lit(False)).withColumn("_hash", F.lit(0).cast("bigint"))
    follows = [(tops[i]["top"], tops[i - 1]["_bucket"]) for i in range(len(tops))]
    copies = spark.createDataFrame(follows, "_key bigint, _before int")
    hashed = rows.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_tail", F.lit(False))
    # Several rows can share the id on a bucket's edge; the first by text hash is the one that follows.
    edge = hashed.join(F.broadcast(copies), "_key").groupBy("_key", "_before").agg(F.min_by(F.struct("doc_id", "text", "_hash"), "_hash").alias("r"))
    tail = edge.select("_key", "r.doc_id", "r.text", F.col("_before").alias("_bucket"), "r._hash", F.lit(True).alias("_tail"))
    return hashed.unionByName(tail).repartitionById(n, F.col("_bucket")).sortWithinPartitions(F.col("_bucket"), F.col("_tail"), F.col("_key").desc(), F.col("_hash"))


def compare_edited(docs: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint of each text, of an edited text, and its likeness to that and to the next document's.

    The edited text has its last floor(n_chars/2) code points replaced by as
    many from the start of the next document (or all of it), in descending
    order of doc_id; the first document follows the last.  A single document
    is its own next.  Null texts are empty; rows with equal doc_id follow
    each other by a hash of the text, null doc_ids come first of all.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def flush(ids: list, own: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(own, following)]
        both = [x.encode() for x in [*own, *edited]]
        some = sketches([*both, following[-1].encode()], shingle, size)
        mine, theirs = some[: len(own)], some[len(own) : -1]
        after = [*mine[1:], some[-1]]
        columns = [
            pa.array(ids, pa.int64()), pa.array(map(len, own), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in both[len(own) :]], pa.string()),
            pa.array(map(str, mine), pa.string()), pa.array(map(str, theirs), pa.string()),
            pa.array([a.resemblance(b) for a, b in zip(mine, theirs)], pa.float64()), pa.array([a.resemblance(b) for a, b in zip(mine, after)], pa.float64()),
        ]
        return pa.record_batch(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, n = [], [], 0
        for batch in batches:
            for doc_id, text, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_tail"))):
                text = text or ""
                if own and (tail or n > 2 << 20):
                    yield flush(ids, own, [*own[1:], text])
                    ids, own, n = [], [], 0
                if not tail:
                    ids.append(doc_id)
                    own.append(text)
                    n += len(text)

    return in_descending_order(documents(docs)).select("doc_id", "text", "_tail").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
