"""Substring deduplication by super-k-mer partitioning (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, groupby, tee

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detlake.llm.flat import Words, gather, rolling, runs, sliding_min, words_of
from detlake.llm.frames import NO_ID, documents, partitions, sized, texts

WINDOW, MINIMISER = 13, 3
#: Text cut up at once, and words of a bucket sorted at once.
CUT_BYTES, SORT_WORDS = 4 << 20, 2_000_000
#: Packed strings that a task takes of one bucket; the windows of a larger one are counted by their digests over all tasks.
BUCKET_BYTES = 512 << 20
#: Columns of a packet's heads: minimiser (its low bits), document, text hash, first window, windows, bytes carried (-1: none).
_HEADS = {"key": "<u4", "doc": "<i8", "h": "<i8", "start": "<i4", "windows": "<i4", "bytes": "<i4"}


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank after each: bytes, starts and ends of the words."""
    data, offset = gather(words.buf, words.start, words.end + 1)  # a separator follows every word
    data = data.copy()
    data[offset[1:] - 1] = 0x20
    return data, offset[:-1], offset[1:] - 1


def super_kmers(words: Words, window: int = WINDOW, k: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each run of consecutive windows that share it.

    The minimiser of a window is the least hash of its runs of k words.
    """
    ok = words.windows(window)[: max(0, len(words.start) - window + 1)]
    least = sliding_min(rolling(words.hash, k), window - k + 1)[: len(ok)]
    at = np.flatnonzero(ok)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    text = words.text[at]
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return at[head], np.diff(np.append(head, len(at))), least[at[head]]


def _pack(docs: np.ndarray, hs: np.ndarray, batch_texts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    """A compressed packet for each bucket. Equal packed strings of several rows travel once.

    Of equal strings the one of the smallest doc_id travels; the others'
    windows all start in that document too, so their heads go without bytes.
    """
    words = words_of(batch_texts)
    at, n, least = super_kmers(words)
    if not len(at):
        return
    data, start, end = spaced(words)
    packed, offset = gather(data, start[at], end[at + n + WINDOW - 2])
    owner = words.text[at]
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offset), pa.py_buffer(packed)])
    code = strings.dictionary_encode().indices.to_numpy()
    order = np.lexsort((at, docs[owner], code))
    first = runs([code[order]])
    lead = np.repeat(docs[owner[order[first]]], np.diff(np.append(first, len(order))))
    travels = np.zeros(len(at), bool)
    travels[order[first]] = True
    same_doc = np.zeros(len(at), bool)
    same_doc[order] = docs[owner[order]] == lead
    heads = {"key": (least >> np.uint64(32)).astype("<u4"), "doc": docs[owner], "h": hs[owner], "start": at - words.first[owner], "windows": n, "bytes": np.where(travels | same_doc, np.diff(offset), -1)}
    bucket = (least % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cut = runs([bucket[by]])
    for a, b in zip(cut, np.append(cut[1:], len(by))):
        some = by[a:b]
        carried = some[heads["bytes"][some] >= 0]
        body, _ = gather(packed, offset[carried], offset[carried + 1])
        yield int(bucket[some[0]]), zstandard.compress(len(some).to_bytes(8, "little") + b"".join(heads[c][some].astype(kind).tobytes() for c, kind in _HEADS.items()) + body.tobytes(), 3)


def _unpack(blob: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    n, at, heads = int.from_bytes(raw[:8], "little"), 8, {}
    for c, kind in _HEADS.items():
        heads[c] = np.frombuffer(raw, kind, n, at)
        at += heads[c].nbytes
    return heads, raw[at:]


def _repeats(blobs: list[bytes], part: int, parts: int) -> Iterator[np.ndarray]:
    """Windows of a bucket that also start under a smaller doc_id: rows (doc, h, window number)."""
    packets = [_unpack(x) for x in blobs]
    heads = {c: np.concatenate([h[c] for h, _ in packets]) for c in _HEADS}
    if part == 0:
        yield _away(heads)
    # A minimiser that only one document has can't share a window.
    order = np.lexsort((heads["doc"], heads["key"]))
    first = runs([heads["key"][order]])
    size = np.diff(np.append(first, len(order)))
    doc = heads["doc"][order]
    several = np.zeros(len(order), bool)
    several[order] = np.repeat(doc[first] != doc[first + size - 1], size)
    use = several & (heads["bytes"] >= 0)
    texts_of_records, at = [], 0
    for h, body in packets:
        cut = np.append(0, np.cumsum(np.maximum(h["bytes"], 0).astype(np.int64)))
        for i in np.flatnonzero(use[at : at + len(h["bytes"])]).tolist():
            texts_of_records.append(body[cut[i] : cut[i + 1]])
        at += len(h["bytes"])
    del packets
    heads = {c: x[use] for c, x in heads.items()}
    words = words_of(texts_of_records)
    all_hashes = rolling(words.hash, WINDOW)
    at = np.flatnonzero(words.windows(WINDOW)[: len(all_hashes)])
    h = all_hashes[at]
    if parts > 1:
        at = at[h % np.uint64(parts) == part]
        h = all_hashes[at]
    record = np.searchsorted(words.first, at, "right") - 1
    doc = heads["doc"][record]
    order = np.argsort(h, kind="stable")
    h, doc, at, record = h[order], doc[order], at[order], record[order]
    first = runs([h])
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    flat, out = words.buf.tobytes(), []
    begin, end, docs = words.start[at].tolist(), words.end[at + WINDOW - 1].tolist(), doc.tolist()
    for a, b in zip(first[several].tolist(), np.append(first[1:], len(h))[several].tolist()):
        # Hashes only bring windows together; bytes decide.
        same = [flat[begin[i] : end[i]] for i in range(a, b)]
        least: dict[bytes, int] = {}
        for text, d in zip(same, docs[a:b]):
            if least.setdefault(text, d) > d:
                least[text] = d
        out += [i for i, text in zip(range(a, b), same) if least[text] < docs[i]]
    out = np.array(out, np.int64)
    r = record[out]
    yield _rows(doc[out], heads["h"][r], heads["start"][r] + at[out] - words.first[r])


def _away(heads: dict[str, np.ndarray]) -> np.ndarray:
    """Windows whose strings didn't travel, since a smaller document of the same batch has them."""
    away = heads["bytes"] < 0
    n = heads["windows"][away]
    return _rows(np.repeat(heads["doc"][away], n), np.repeat(heads["h"][away], n), np.repeat(heads["start"][away], n) + _count(n))


def _digests(blob: bytes) -> pa.RecordBatch:
    """A 128-bit digest of every window that travels in a packet, with its document and place."""
    heads, body = _unpack(blob)
    heads = {c: x[heads["bytes"] >= 0] for c, x in heads.items()}
    cut = np.append(0, np.cumsum(heads["bytes"].astype(np.int64))).tolist()
    out = []
    for i, n in enumerate(heads["windows"].tolist()):
        words = body[cut[i] : cut[i + 1]].split(b" ")
        out += [hashlib.blake2b(b" ".join(words[j : j + WINDOW]), digest_size=16).digest() for j in range(n)]
    n = heads["windows"]
    at = np.repeat(heads["start"], n) + _count(n)
    return pa.record_batch([pa.array(out, pa.binary()), pa.array(np.repeat(heads["doc"], n)), pa.array(np.repeat(heads["h"], n)), pa.array(at.astype(np.int64))], names=["digest", "doc_id", "h", "at"])


def _count(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _rows(doc: np.ndarray, h: np.ndarray, window: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), [("doc", "<i8"), ("h", "<i8"), ("at", "<i8")])
    out["doc"], out["h"], out["at"] = doc, h, window
    return out


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, h (text hash), at, windows: runs of windows that also start in a document with a smaller doc_id."""
    n = partitions(docs.sparkSession)
    buckets = 4 * n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, CUT_BYTES):
            got = list(_pack(batch.column("doc_id").to_numpy(), batch.column("h").to_numpy(), texts(batch), buckets))
            yield pa.record_batch([pa.array([b for b, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["bucket", "packet"])

    def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[bytes, int]]]:
        """The packets of each bucket, one by one, with the bytes of this and all before it."""
        rows = ((b, x) for batch in batches for b, x in zip(batch.column("bucket").to_pylist(), batch.column("packet").to_pylist()))
        for _, group in groupby(rows, lambda r: r[0]):
            blobs, sizes = tee(x for _, x in group)
            yield zip(blobs, accumulate(zstandard.get_frame_parameters(x).content_size for x in sizes))

    def joined(found: np.ndarray) -> pa.RecordBatch:
        found.sort()
        head = np.flatnonzero(np.concatenate([[True], (np.diff(found["at"]) != 1) | (found["doc"][1:] != found["doc"][:-1]) | (found["h"][1:] != found["h"][:-1])])) if len(found) else np.zeros(0, np.int64)
        return pa.record_batch([pa.array(found["doc"][head]), pa.array(found["h"][head]), pa.array(found["at"][head]), pa.array(np.diff(np.append(head, len(found))))], names=["doc_id", "h", "at", "windows"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packets in buckets_of(batches):
            held, size = [], 0
            for blob, size in packets:
                held.append(blob)
                if size > most:  # only what the packets themselves tell; ``spill`` does the rest
                    yield from (joined(_away(_unpack(x)[0])) for x in held)
                    held = []
            if size <= most:
                # A large bucket is sorted part by part, by the windows' hashes; its packets stay compressed meanwhile.
                for part in range(parts := 1 + size // (6 * SORT_WORDS)):
                    yield from map(joined, _repeats(held, part, parts))

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packets in buckets_of(batches):
            held = []
            for blob, size in packets:
                held.append(blob)
                if size > most:
                    yield from map(_digests, held)
                    held = []

    most = BUCKET_BYTES
    packets = docs.select("doc_id", "h", "text").mapInArrow(cut, "bucket int, packet binary")
    dealt = packets.repartition(n, "bucket").sortWithinPartitions("bucket")  # shuffled once, read by both
    found = dealt.mapInArrow(count, "doc_id bigint, h bigint, at bigint, windows bigint")
    rest = dealt.mapInArrow(spill, "digest binary, doc_id bigint, h bigint, at bigint")
    lead = F.min("doc_id").over(Window.partitionBy("digest"))
    again = rest.withColumn("lead", lead).where("doc_id > lead").select("doc_id", "h", "at", F.lit(1).cast("bigint").alias("windows"))
    return found.unionByName(again)


def covered(n_words: int, at: list[int], windows: list[int], width: int) -> np.ndarray:
    """Which words the windows cover; each run has ``windows`` of them from word ``at`` on."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, np.array(at, np.int64), 1)
    np.add.at(step, np.array(at, np.int64) + np.array(windows, np.int64) + width - 1, -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Drops every word covered by a 13-word window that also starts under a smaller doc_id.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words
    joined by a blank); ``keep_text`` adds that text.  Windows are judged on
    the input.  Null and empty texts have no words.  A null doc_id sorts
    after all others, so it never is the smaller one; rows that share a
    doc_id don't remove each other's words.
    """
    rows = documents(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("h", F.lit(0).cast("bigint"))
    else:  # only then a text hash must tell the texts of one doc_id apart
        rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    marks = repeated_windows(rows).groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "windows")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, CUT_BYTES >> 1, "packed"):
            n_words, n_removed, kept = [], [], []
            for packed, marks in zip(batch.column("packed").to_pylist(), batch.column("marks").to_pylist()):
                words = zstandard.decompress(packed).split()
                n_words.append(len(words))
                if marks:
                    gone = covered(len(words), [m["at"] for m in marks], [m["windows"] for m in marks], WINDOW)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array([x.decode() for x in kept], pa.string())], [*names, "kept"]
            yield pa.record_batch(columns, names=names)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, CUT_BYTES):
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array([zstandard.compress(x, 3) for x in texts(batch)], pa.binary())], names=["doc_id", "h", "packed"])

    # Texts move once, compressed better than a shuffle would.
    packed = rows.select("doc_id", "h", "text").mapInArrow(shrink, "doc_id bigint, h bigint, packed binary")
    out = packed.join(marks, ["doc_id", "h"], "left").select("doc_id", "packed", "marks").mapInArrow(run, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
