"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from detlake.llm.frames import by_batch, documents, forget, held_out

#: Lengths of the n-grams, and bits of their hashed index.
ORDERS, BITS = (4, 5, 6), 20
#: Bound of the labelled sample: documents of each class, by smallest hash of their ids.
TRAIN_ROWS = 3_000
#: A feature is kept if it is in so many training documents and among the strongest.
LEAST_DOCS, FEATURES = 3, 8_000
#: Parts of the sample that are scored by the others' fit to set the final slope and bias.
FOLDS = 4
THRESHOLD = 0.3


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order the text number and the hashed index of every n-gram, lower-cased."""
    low = [x.lower() for x in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) for x in low], np.int64)
    text = np.repeat(np.arange(len(low), dtype=np.int32), size)
    end = np.repeat(np.cumsum(size), size)
    left = end - np.arange(len(codes))  # symbols from here to the text's end
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] if n > 1 else h
        if not len(codes[n - 1 :]):
            return
        h = h * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in ORDERS:
            inside = left[: len(h)] >= n
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x85EBCA6B)
            yield text[: len(h)][inside], (x >> np.uint32(32 - BITS))[inside]


def counted(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, index and log2(1 + occurrences) of every n-gram of each order, only of the indices to keep."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text, index in grams(texts):
        if keep is not None:
            hit = keep[index]
            text, index = text[hit], index[hit]
        key, n = np.unique((text.astype(np.int64) << BITS) | index, return_counts=True)
        keys.append(key)
        counts.append(n)
    key = np.concatenate(keys)
    return key >> BITS, key & ((1 << BITS) - 1), np.log2(1 + np.concatenate(counts))


def slices(texts: list[str], size: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``size`` characters together, with the number of the first."""
    at = n = 0
    for i, x in enumerate(texts):
        if i > at and n + len(x) > size:
            yield at, texts[at:i]
            at, n = i, 0
        n += len(x)
    if at < len(texts):
        yield at, texts[at:]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift that make margins log-odds: Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    features = np.stack([margin, np.ones(len(y))])
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(ab @ features)
        g = features @ (weight * (p - target)) + 1e-6 * ab
        h = (features * (weight * np.maximum(p * (1 - p), 1e-9))) @ features.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        ab = ab - step * min(1.0, 2.0 / (1e-9 + np.abs(step).max()))
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


@dataclass
class Classifier:
    """Weights by hashed n-gram (0: not a feature) and the bias."""

    weight: np.ndarray
    bias: float

    @classmethod
    def constant(cls, rate: float) -> Classifier:
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return cls(np.zeros(1 << BITS, np.float32), float(np.log(rate / (1 - rate))))

    @classmethod
    def fit(cls, texts: list[str], toxic: list[int], weight: list[float], steps: int = 60, penalty: float = 2e-4) -> Classifier:
        """Naive Bayes ratios of n-gram occurrences scale the features of a logistic regression.

        An n-gram that a text repeats says more than one that it has once, so
        features are log2(1 + occurrences), and ratios (add-one smoothed)
        those of their sums.  Both classes weigh alike in the regression,
        full-batch gradient steps with momentum, so the result does not
        depend on chance; ``weight`` restores the classes' real shares where
        slope and bias turn margins into log-odds.
        """
        y, share = np.array(toxic, np.float64), np.array(weight, np.float64)
        if not len(y) or y.min() == y.max():
            return cls.constant(float(np.average(y, weights=share)) if len(y) else 0.5)
        width = 1 << BITS
        of_class, n_docs = [np.zeros(width), np.zeros(width)], np.zeros(width)
        for at, some in slices(texts):  # only sums are kept of all n-grams, pairs only of the chosen
            row, col, value = counted(some)
            n_docs += np.bincount(col, minlength=width)
            for k in (0, 1):
                of_class[k] += np.bincount(col, value * (y[row + at] == k), width)
        n1, n0 = y.sum(), len(y) - y.sum()
        ratio = np.log((of_class[1] + 1) / (n1 + 2)) - np.log((of_class[0] + 1) / (n0 + 2))
        strength = np.where(n_docs >= LEAST_DOCS, np.abs(ratio) * np.sqrt(of_class[0] + of_class[1]), 0)
        chosen = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
        chosen = chosen[strength[chosen] > 0]
        keep = np.zeros(width, bool)
        keep[chosen] = True
        place = np.cumsum(keep, dtype=np.int32) - 1
        rows, cols, values = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for at, some in slices(texts):
            row, col, value = counted(some, keep)
            rows.append((row + at).astype(np.int32))
            cols.append(place[col])
            values.append((value * ratio[col]).astype(np.float32))
        row, col, value = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
        scale = np.where(y == 1, 0.5 / n1, 0.5 / n0)
        blocks = [slice(i, i + (1 << 20)) for i in range(0, len(row), 1 << 20)]  # bounds what one step allocates

        def by_text(w: np.ndarray) -> np.ndarray:
            return sum((np.bincount(row[b], w[col[b]] * value[b], len(y)) for b in blocks), np.zeros(len(y)))

        def by_feature(gap: np.ndarray) -> np.ndarray:
            return sum((np.bincount(col[b], gap[row[b]] * value[b], len(chosen)) for b in blocks), np.zeros(len(chosen)))

        norm = sum((np.bincount(row[b], value[b].astype(np.float64) ** 2, len(y)) for b in blocks), np.zeros(len(y)))
        rate = 4.0 / (1e-9 + np.quantile(norm, 0.9))

        def descend(part: np.ndarray) -> tuple[np.ndarray, float]:
            w, b, move, move_b = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0
            for _ in range(steps):
                gap = (sigmoid(by_text(w) + b) - y) * scale * part
                move = 0.9 * move + by_feature(gap) + penalty * w
                move_b = 0.9 * move_b + gap.sum()
                w, b = w - rate * move, b - rate * move_b
            return w, b

        fold = np.zeros(len(y), np.int64)
        for k in (0, 1):
            fold[y == k] = np.arange((y == k).sum()) % FOLDS
        margin = np.zeros(len(y))
        for k in range(FOLDS):
            w, b = descend(fold != k)
            margin[fold == k] = (by_text(w) + b)[fold == k]
        w, b = descend(np.ones(len(y), bool))
        slope, shift = calibrate(margin, y, share)
        out = np.zeros(width, np.float32)
        out[chosen] = (slope * w * ratio[chosen]).astype(np.float32)
        return cls(out, float(slope * b + shift))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of the toxic label for each text; for an empty one it is the bias alone."""
        z = np.full(len(texts), self.bias)
        for at, some in slices(texts):
            row, index, value = counted(some, self.weight != 0)
            z[at : at + len(some)] += np.bincount(row, self.weight[index] * value, len(some))
        return sigmoid(z)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Fits on at most ``rows`` labelled documents of each class from outside the held-out fold.

    They are those with the smallest hashes of their ids; only ids are ranked.
    A document labelled several times counts by its largest label; null
    labels, ids and texts teach nothing.  Where one class, or all, is
    missing, every score is the known share of toxic labels, or 0.5.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    total = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows) for y in total]
    if not picked:
        return Classifier.constant(0.5)
    some = picked[0].unionByName(picked[-1]).distinct()
    got = documents(docs).where("text is not null").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text").toArrow().sort_by([("_id", "ascending"), ("text", "ascending")])
    y = got.column("_y").to_pylist()
    weight = {k: n / max(1, y.count(k)) for k, n in total.items()}
    return Classifier.fit(got.column("text").to_pylist(), y, [weight[k] for k in y])


def score_documents(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= threshold) of each row's whole text.

    Null texts score as empty ones, very long ones in one piece.  Only the
    text is looked at, so equal texts score alike; repeated rows and null
    doc_ids stay, a null one not held out.
    """
    rows = documents(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return _scored(rows, model, threshold)


def without_toxic(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose own text the model doesn't reject, with all their columns.

    Each row is judged by its text alone, so rows with a null or a repeated
    doc_id go or stay for themselves and no row moves.  Null and empty texts
    score by the bias and stay unless most labels are toxic.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"))
    kept = _scored(rows, model, threshold).where("predicted = 0")
    return kept.select("row.*")


def _scored(rows: DataFrame, model: Classifier, threshold: float) -> DataFrame:
    """rows with score and predicted in place of text."""
    used = np.flatnonzero(model.weight)
    shipped = rows.sparkSession.sparkContext.broadcast((used.astype(np.int32), model.weight[used], model.bias))  # at most FEATURES entries
    cache: dict[str, Classifier] = {}
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "model" not in cache:
            forget()
            index, values, bias = shipped.value
            weight = np.zeros(1 << BITS, np.float32)
            weight[index] = values
            cache["model"] = Classifier(weight, bias)
        score = cache["model"].score([x or "" for x in batch.column("text").to_pylist()])
        columns = [batch.column(f.name) for f in others]
        return pa.record_batch([*columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*(f.name for f in others), "score", "predicted"])

    schema = StructType([*others, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(by_batch(run, 1 << 20), schema)
