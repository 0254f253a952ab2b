"""Repeated passages by sparse suffix arrays (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.llm.flat import Words, gather, rolling, runs, sliding_min, words_of
from detlake.llm.frames import NO_ID, by_batch, documents, forget, join_spread, partitions, texts, written
from detlake.llm.windows import covered

#: Words of the least passage, of a minimiser, and runs of words in a minimiser window.
PASSAGE, MINIMISER, SPREAD = 50, 6, 36
#: A passage's first retained suffix starts among its first SPREAD words, so this many of its words stand right of it.
RIGHT = PASSAGE - SPREAD + 1
#: Suffixes under one head that a task sorts and compares; windows of more are dealt over all tasks by their digests.
COMPARED = 20_000
#: Text looked at, and bytes of suffixes compared, at once.
CUT_BYTES, COMPARED_BYTES = 1 << 20, 2 << 20


def retained(words: Words) -> np.ndarray:
    """Word positions whose run of MINIMISER words has the least hash of some SPREAD consecutive runs of a text."""
    h = rolling(words.hash, MINIMISER)
    least = sliding_min(h, SPREAD)
    if not len(least):
        return np.zeros(0, np.int64)
    inside = words.windows(SPREAD + MINIMISER - 1)[: len(least)]
    bound = np.where(inside, least, 0)  # the largest minimum of the windows over a position is its own hash iff it is one
    largest = sliding_min(np.concatenate([np.zeros(SPREAD - 1, np.uint64), bound, np.zeros(SPREAD - 1, np.uint64)]), SPREAD, np.maximum)
    return np.flatnonzero((largest[: len(h)] == h) & (h > 0))


def suffix_heads(docs: DataFrame) -> DataFrame:
    """key, doc_id, h, at: a hash of the first RIGHT words of every retained suffix."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(texts(batch))
        at = retained(words)
        at = at[words.windows(RIGHT)[at]]
        key, owner = rolling(words.hash, RIGHT)[at] if len(at) else at.astype(np.uint64), words.text[at]
        return pa.record_batch([pa.array(key.view(np.int64)), batch.column("doc_id").take(pa.array(owner)), batch.column("h").take(pa.array(owner)), pa.array((at - words.first[owner]).astype(np.int32))], names=["key", "doc_id", "h", "at"])

    return docs.select("doc_id", "h", "text").mapInArrow(by_batch(run, CUT_BYTES), "key bigint, doc_id bigint, h bigint, at int")


def _placed(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch, and the row, position in its text and position in all words of each of the suffixes ``ats``."""
    words = words_of(texts(batch))
    lists = batch.column("ats")
    owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
    at = lists.flatten().to_numpy().astype(np.int64)
    return words, owner, at, at + words.first[owner]


def _slices(words: Words, order: slice, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    """Words low..high (in this order of all words) of each item, each word followed by one blank."""
    data, offset = gather(words.buf, words.start[order], words.end[order] + 1)  # a separator follows every word
    data = data.copy()
    data[offset[1:] - 1] = 0x20
    flat = data.tobytes()
    return [flat[a:b] for a, b in zip(offset[low].tolist(), offset[high].tolist())]


def suffix_rows(docs: DataFrame) -> DataFrame:
    """key, suffix, before, doc_id, h, at of the suffixes that the array ``ats`` of docs names.

    ``suffix`` has up to PASSAGE words from the position on, ``before`` up to
    SPREAD - 1 words left of it, nearest first.  Every word ends in a blank,
    so byte order brings equal first words together.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, owner, at, here = _placed(batch)
        n = len(words.hash)
        right = _slices(words, slice(None), here, np.minimum(here + PASSAGE, words.first[owner + 1]))
        left = _slices(words, slice(None, None, -1), n - here, n - np.maximum(here - SPREAD + 1, words.first[owner]))
        key = rolling(words.hash, RIGHT)[here] if len(here) else here.astype(np.uint64)
        take = pa.array(owner)
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(right, pa.binary()), pa.array(left, pa.binary()), batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(at.astype(np.int32))], names=["key", "suffix", "before", "doc_id", "h", "at"])

    return docs.mapInArrow(by_batch(run, CUT_BYTES), "key bigint, suffix binary, before binary, doc_id bigint, h bigint, at int")


def window_rows(docs: DataFrame) -> DataFrame:
    """digest, doc_id, h, at of every window of PASSAGE words around the suffixes ``ats`` that starts at most SPREAD - 1 words left of one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, owner, _, here = _placed(batch)
        lead = np.tile(np.arange(SPREAD), len(here))
        owner = np.repeat(owner, SPREAD)
        start = np.repeat(here, SPREAD) - lead
        whole = (start >= words.first[owner]) & (start + PASSAGE <= words.first[owner + 1])
        start, first = np.unique(start[whole], return_index=True)
        owner = owner[whole][first]
        digests = [hashlib.blake2b(x, digest_size=16).digest() for x in _slices(words, slice(None), start, start + PASSAGE)]
        take = pa.array(owner)
        return pa.record_batch([pa.array(digests, pa.binary()), batch.column("doc_id").take(take), batch.column("h").take(take), pa.array((start - words.first[owner]).astype(np.int32))], names=["digest", "doc_id", "h", "at"])

    return docs.mapInArrow(by_batch(run, CUT_BYTES), "digest binary, doc_id bigint, h bigint, at int")


def _codes(column: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """codes[i, j]: a number for word j of item i, equal for equal bytes and no others; 0 where it has fewer. And the numbers of words."""
    flat = b"".join(column.to_pylist())
    end = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20) + 1
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(end), [None, pa.py_buffer(np.concatenate([[0], end]).astype(np.int64)), pa.py_buffer(flat)])
    code = words.dictionary_encode().indices.to_numpy() + 1
    stop = np.searchsorted(end, np.cumsum(pc.binary_length(column).to_numpy()), "right")
    size = np.diff(stop, prepend=0)
    grid = np.zeros((len(column), most), np.int32)
    grid[np.arange(most)[None, :] < size[:, None]] = code
    return grid, size


def _common(codes: np.ndarray) -> np.ndarray:
    """First words that each item has in common with the one before it."""
    out = np.zeros(len(codes), np.int64)
    out[1:] = np.logical_and.accumulate((codes[1:] == codes[:-1]) & (codes[1:] > 0), axis=1).sum(1)
    return out


def compare(suffix: pa.Array, before: pa.Array, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of PASSAGE words among sorted suffixes: suffix number, words left of it, and if a smaller doc has it.

    Neighbours in suffix order give the common first words, and so the
    intervals of suffixes that go on alike for any number of words.
    Neighbours in the order of what stands before give the same to the left.
    A window that starts ``lead`` words left of a suffix is repeated where
    others lie in the same interval of PASSAGE - lead words to the right and
    of lead words to the left.
    """
    codes, n_right = _codes(suffix, PASSAGE)
    to_right = _common(codes)
    codes, n_left = _codes(before, SPREAD - 1)
    by_left = pc.array_sort_indices(before).to_numpy().astype(np.int64)
    to_left = _common(codes[by_left])
    longest = np.maximum(to_right, np.append(to_right[1:], 0))
    found = []
    for lead in range(SPREAD):
        can = np.flatnonzero((n_left >= lead) & (longest >= PASSAGE - lead))
        interval = np.empty(len(doc), np.int64)
        interval[by_left] = np.cumsum(to_left < lead)
        r, l = np.cumsum(to_right < PASSAGE - lead)[can], interval[can]
        order = np.lexsort((doc[can], l, r))
        can, r, l = can[order], r[order], l[order]
        first = runs([r, l])
        size = np.diff(np.append(first, len(can)))
        least = np.repeat(doc[can[first]], size)
        hit = least != np.repeat(doc[can[first + size - 1]], size)
        found.append((can[hit], np.full(hit.sum(), lead), (doc[can] > least)[hit]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _joined(item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of an item: item, first window, number of windows."""
    order = np.lexsort((at, item))
    item, at = item[order], at[order]
    first = runs([item, at - np.arange(len(at))])
    return item[first], at[first], np.diff(np.append(first, len(at)))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, h, at, windows, again: runs of windows of PASSAGE words that other documents have too.

    Rows with ``again`` are of those that a smaller doc_id has.  Suffixes are
    dealt by a hash of their first words, their head.  A head of more than
    COMPARED suffixes is not sorted in one task: the windows around its
    suffixes are counted by their digests over all tasks.
    """
    spark = docs.sparkSession
    heads = written(suffix_heads(docs))
    several = written(heads.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n", (F.col("n") > COMPARED).alias("crowded")))
    at = lambda crowded: F.collect_set(F.when(F.col("crowded") == crowded, F.col("at")))
    ats = join_spread(heads, several, ["key"]).groupBy("doc_id", "h").agg(at(False).alias("sorted"), at(True).alias("counted"))
    both = docs.select("doc_id", "h", "text").join(ats, ["doc_id", "h"])  # texts are shuffled once for both ways

    def chosen(which: str) -> DataFrame:
        return both.where(F.size(which) > 0).select("doc_id", "h", "text", F.col(which).alias("ats"))

    def spans(columns: list[pa.Array]) -> pa.RecordBatch:
        suffix, before, *numbers = columns
        doc, h, at = (x.to_numpy(zero_copy_only=False) for x in numbers)
        which, lead, again = compare(suffix, before, doc)
        parts = [_joined(which[some], at[which[some]] - lead[some]) for some in (slice(None), again)]
        row, start, size = (np.concatenate(x) for x in zip(*parts))
        return pa.record_batch([pa.array(doc[row]), pa.array(h[row]), pa.array(start), pa.array(size), pa.array(np.repeat([False, True], [len(p[0]) for p in parts]))], names=["doc_id", "h", "at", "windows", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if rows >= COMPARED or size >= COMPARED_BYTES:  # all whole keys; the last one may go on
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))
                if cut:
                    yield spans([table.slice(0, cut).column(c).combine_chunks() for c in table.column_names[1:]])
                    held = table.slice(cut).to_batches()
                    rows, size = len(table) - cut, sum(b.nbytes for b in held)
        if rows:
            table = pa.Table.from_batches(held)
            yield spans([table.column(c).combine_chunks() for c in table.column_names[1:]])

    schema = "doc_id bigint, h bigint, at bigint, windows bigint, again boolean"
    rows = suffix_rows(chosen("sorted"))
    dealt = rows.repartition(partitions(spark), "key").sortWithinPartitions("key", "suffix")
    out = dealt.mapInArrow(run, schema)
    if several.where("crowded").isEmpty():
        return out
    windows = window_rows(chosen("counted"))
    counts = windows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest", "lo")
    found = windows.join(counts, "digest")
    one = found.select("doc_id", "h", F.col("at").cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("windows"), F.explode(F.when(F.col("doc_id") > F.col("lo"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("again"))
    return out.unionByName(one)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of PASSAGE or more words that several documents share: a row for each document that has one.

    Returns doc_id, n_repeated (words in windows of PASSAGE words
    that another doc_id has too), n_removable (in those that a smaller doc_id
    has), passages and removable (``start:end`` in words, end exclusive,
    comma-joined).  The windows found are exactly those of a brute-force
    comparison: words are compared by their bytes, the windows of crowded
    heads by 128-bit digests.  Null, empty and short texts share nothing; a null doc_id
    sorts after all others; rows of one doc_id don't count as several.
    """
    docs = documents(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    marks = repeated_windows(docs).groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "windows", "again")).alias("marks"))

    def passages(gone: np.ndarray) -> str:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        return ",".join(f"{a}:{b}" for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for marks in batch.column("marks").to_pylist():
                n = max(m["at"] + m["windows"] for m in marks) + PASSAGE - 1
                one, two = (covered(n, [m["at"] for m in some], [m["windows"] for m in some], PASSAGE) for some in (marks, [m for m in marks if m["again"]]))
                out.append((int(one.sum()), int(two.sum()), passages(one), passages(two)))
            columns = list(zip(*out))
            yield pa.record_batch([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["doc_id", "n_repeated", "n_removable", "passages", "removable"])

    schema = "doc_id bigint, n_repeated bigint, n_removable bigint, passages string, removable string"
    out = marks.select("doc_id", "marks").mapInArrow(run, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
