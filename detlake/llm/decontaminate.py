"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from detlake.llm.flat import Words, mix, rolling, words_of
from detlake.llm.frames import documents, forget, sized, texts

#: Edits in words that still make a window a copy of an item, as a share of the item's words; shorter items are found verbatim.
MOST_EDITS, LEAST_WORDS = 0.2, 8
#: Share of copies with as many edits that are to be found, and embedded symbols sampled in each random walk.
RECALL, SAMPLES = 0.99, 3
#: Simulated copies behind the number of walks.
TRIALS = 400
#: Words of items looked for at once; more items are done in several blocks.
BLOCK_WORDS = 2_000_000
#: Text looked at at once.
CUT_BYTES = 1 << 20
_END = np.uint64(0x1234567)


@dataclass
class Items:
    """Benchmark items as word hashes, and the tables that windows are looked up in."""

    ids: list[int]
    words: list[np.ndarray]
    repeats: int | None = None  # random walks; None: as many as RECALL takes
    edits: list[int] = field(init=False)
    grams: dict[int, np.ndarray] = field(init=False)  # sorted run hashes, by run length
    walks: list[Walk] = field(init=False)

    def __post_init__(self):
        self.edits = [int(MOST_EDITS * len(w)) if len(w) >= LEAST_WORDS else 0 for w in self.words]
        runs: dict[int, list[np.ndarray]] = {}
        for w, e in zip(self.words, self.edits):
            runs.setdefault(len(w) // (e + 1), []).append(rolling(w, len(w) // (e + 1)))
        self.grams = {q: np.unique(np.concatenate(r)) for q, r in runs.items()}
        if self.repeats is None:
            worst: dict[int, tuple[float, int]] = {}  # of each size class the length with the largest share of edits
            for w, e in zip(self.words, self.edits):
                size = len(w).bit_length()
                worst[size] = max(worst.get(size, (0.0, 0)), (e / len(w), -len(w)))
            self.repeats = max((walks_needed(-n) for share, n in worst.values() if share), default=1)
        self.walks = [Walk(i, self.words) for i in range(self.repeats)]

    @property
    def longest(self) -> int:
        return max(len(w) + e for w, e in zip(self.words, self.edits))


class Walk:
    """One CGK random walk and its bit samples, for items by size class.

    The walk reads a word, appends it to the embedding and moves on by a
    random bit that depends on the step and the word.  After an edit two
    walks over otherwise equal words come together again by chance, so a few
    edits leave most embedded symbols in place.  A class of items has the
    largest power of two up to their size as its number of steps: so no walk
    leaves an item-sized window.
    """

    def __init__(self, number: int, items: list[np.ndarray]):
        self.rng = np.random.default_rng(1000 + number)
        longest = max(map(len, items))
        self.steps = 1 << max(0, longest.bit_length() - 1)
        self.bits = self.rng.integers(0, 2, (self.steps, 256)).astype(np.int8)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.array([1 << (len(w).bit_length() - 1) for w in items])
        for size in np.unique(sizes):
            sample = np.sort(self.rng.choice(size, min(SAMPLES, size), replace=False))
            which = np.flatnonzero(sizes == size)
            flat = np.concatenate([items[i] for i in which])
            start = np.cumsum([0, *(len(items[i]) for i in which)])[:-1]
            keys = self.key(self.embed(flat, start, np.cumsum([len(items[i]) for i in which]), int(size)), sample)
            order = np.argsort(keys, kind="stable")
            self.classes[int(size)] = (sample, keys[order], which[order])

    def embed(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray, steps: int) -> np.ndarray:
        """steps x windows: the embedded symbols of the windows; past a text's end a fixed symbol."""
        at, out = start.copy(), np.empty((steps, len(start)), np.uint64)
        for j in range(steps):
            inside = at < stop
            out[j] = np.where(inside, words[np.minimum(at, len(words) - 1)], _END)
            at += self.bits[j][(out[j] >> np.uint64(50)).astype(np.int64) & 255]
        return out

    @staticmethod
    def key(embedded: np.ndarray, sample: np.ndarray) -> np.ndarray:
        key = np.full(embedded.shape[1], len(sample), np.uint64)
        for j in sample:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + embedded[j])
        return key

    def candidates(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and items that fall in one bucket of this walk."""
        embedded, window, item = self.embed(words, start, stop, max(self.classes)), [], []
        for sample, keys, which in self.classes.values():
            key = self.key(embedded, sample)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(high > low)
            n = (high - low)[hit]
            window.append(np.repeat(hit, n))
            item.append(which[np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        return np.concatenate(window), np.concatenate(item)


@cache
def walks_needed(size: int) -> int:
    """Repetitions after which RECALL of the copies with MOST_EDITS of their words edited have met their item in a bucket.

    Taken from TRIALS random items of ``size`` words, each with one copy with
    random inserted, deleted and replaced words.  Some copies are harder than
    others, so walks are added until enough copies are found.
    """
    rng = np.random.default_rng(size)
    edits, steps = max(1, int(MOST_EDITS * size)), 1 << (size.bit_length() - 1)
    items = rng.integers(0, 2**64, (TRIALS, size), dtype=np.uint64)
    copies = [x.tolist() for x in items]
    for copy in copies:
        for j, kind in zip(rng.integers(0, size, edits).tolist(), rng.integers(0, 3, edits).tolist()):
            j, new = j % len(copy), int(rng.integers(0, 2**64, dtype=np.uint64))
            copy[j : j + 1] = ([], [new], [copy[j], new])[kind]
    both = [*items, *(np.array(x, np.uint64) for x in copies)]
    flat, stop, found = np.concatenate(both), np.cumsum([len(x) for x in both]), np.zeros(TRIALS, bool)
    for number in count():
        walk = Walk(number, [items[0]])
        key = walk.key(walk.embed(flat, np.append(0, stop[:-1]), stop, steps), walk.classes[steps][0])
        found |= key[:TRIALS] == key[TRIALS:]
        if found.mean() >= RECALL:
            return number + 1


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between the item and any part of the text, and that part's start and end."""
    column = np.arange(len(text) + 1)
    cost, begin = np.zeros(len(text) + 1, np.int64), column.copy()
    for i, w in enumerate(item):
        diagonal = cost[:-1] + (text != w)
        up = cost[1:] + 1
        best = np.minimum(diagonal, up)
        source = np.where(diagonal <= up, begin[:-1], begin[1:])
        row = np.concatenate([[i + 1], best])
        origin = np.concatenate([[begin[0]], source])
        # Words of the text that the item lacks: each costs one more than its left neighbour.
        slack = row - column
        low = np.minimum.accumulate(slack)
        last = np.maximum.accumulate(np.where(slack == low, column, 0))
        cost, begin = low + column, origin[last]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def near_items(words: Words, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end in words): the best match of each item in each text that is near enough.

    Words that stand too far from any run of words that a near copy must have
    in common with its item (an item of n words with k edits keeps a run of
    n // (k + 1) words) start no window.
    """
    if not len(words.start):
        return []
    near = np.zeros(len(words.start) + 1, np.int64)
    reach = items.longest
    for q, grams in items.grams.items():
        h = rolling(words.hash, q)
        spot = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
        hit = np.flatnonzero((grams[spot] == h) & words.windows(q)[: len(h)])
        np.add.at(near, np.maximum(hit - reach, 0), 1)
        np.add.at(near, hit + 1, -1)
    start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    if not len(start):
        return []
    owner = words.text[start]
    pairs: dict[tuple[int, int], set[int]] = {}
    for at in range(0, len(start), 100_000):
        some, text = start[at : at + 100_000], owner[at : at + 100_000]
        for walk in items.walks:
            window, item = walk.candidates(words.hash, some, words.first[text + 1])
            for w, i, t in zip(some[window].tolist(), item.tolist(), text[window].tolist()):
                pairs.setdefault((t, i), set()).add(w)
    out = []
    for (t, i), starts in sorted(pairs.items()):
        item, k, best, seen = items.words[i], items.edits[i], None, -1
        for s in sorted(starts):
            if s <= seen:
                continue  # the last verified part has this window
            low, high = max(words.first[t], s - k), min(words.first[t + 1], s + 2 * len(item) + k)
            seen = s + len(item) - k
            d, a, b = nearest(item, words.hash[low:high])
            if d <= k and (best is None or d < best[2]):
                best = (t, i, d, int(low + a - words.first[t]), int(low + b - words.first[t]))
        if best:
            out.append(best)
    return out


def benchmark_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Items in blocks of at most BLOCK_WORDS words, so that what is broadcast has a bound."""
    rows, n = [], 0
    source = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null").orderBy("item_id", "text")
    for row in source.toLocalIterator():
        words = words_of([row["text"].encode()]).hash
        if not len(words):
            continue
        if rows and n + len(words) > BLOCK_WORDS:
            yield Items([i for i, _ in rows], [w for _, w in rows])
            rows, n = [], 0
        rows.append((row["item_id"], words))
        n += len(words)
    if rows:
        yield Items([i for i, _ in rows], [w for _, w in rows])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item with at most 20 % of its words edited: a row for each such pair.

    Returns doc_id, item_id, n_edits and start, end (words of the whole text)
    of the item's nearest part in the document; of equally near ones the
    first.  Windows the size of an item at every word go through repetitions
    of the embedding, as many as find RECALL of the copies with 20 % edits;
    what falls in a bucket is verified by exact edit distance.  Exact copies
    are never missed.  Items of fewer than LEAST_WORDS words are found
    verbatim only, since a few shared words make no copy.  Null and empty
    texts hold nothing; items without words, and null ones, are in nothing;
    an empty benchmark gives no rows.  Repeated rows give repeated results,
    null doc_ids null ones.
    """
    found = None
    for items in benchmark_blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast((items.ids, items.words, items.repeats))
        part = _leaks(documents(docs), shipped)
        found = part if found is None else found.unionByName(part)
    schema = "doc_id bigint, item_id bigint, n_edits int, start int, end int"
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; each row is judged by its own text."""
    for items in benchmark_blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast((items.ids, items.words, items.repeats))
        docs = _clean(docs, shipped)
    return docs


def _looked_up(shipped) -> Callable[[], Items]:
    made: dict[str, Items] = {}

    def items() -> Items:
        if "items" not in made:
            forget()
            made["items"] = Items(*shipped.value)
        return made["items"]

    return items


def _clean(docs: DataFrame, shipped) -> DataFrame:
    look_up = _looked_up(shipped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, CUT_BYTES):
            clean = np.ones(len(batch), bool)
            clean[[t for t, *_ in near_items(words_of(texts(batch)), look_up())]] = False
            yield pa.record_batch([batch.column("row").filter(pa.array(clean))], names=["row"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["row"]])).select("row.*")


def _leaks(docs: DataFrame, shipped) -> DataFrame:
    look_up = _looked_up(shipped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, CUT_BYTES):
            items = look_up()
            got = near_items(words_of(texts(batch)), items)
            t, i, d, a, b = zip(*got) if got else ((),) * 5
            yield pa.record_batch([batch.column("doc_id").take(pa.array(t, pa.int64())), pa.array([items.ids[x] for x in i], pa.int64()), pa.array(d, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "item_id", "n_edits", "start", "end"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, n_edits int, start int, end int")
