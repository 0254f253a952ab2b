"""MinHash near-duplicates with sequential Bayesian verification (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.llm.components import components
from detlake.llm.flat import mix, rolling, words_of
from detlake.llm.frames import NO_ID, documents, forget, join_spread, partitions, sized, texts, written

#: Bands and hashes in each: a pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 1e-7.
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
#: Signature entries compared before the posterior is looked at again, and the chance of pruning a true pair each time.
STEP, MISS = 16, 1e-7
#: Members of a lead compared at once, and text looked at at once.
GROUP, CUT_BYTES = 1024, 1 << 20
_RANDOM = np.random.default_rng(7)
_XOR = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch_texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, flat and sorted within a text, and their offsets.

    Words are lower-cased in A-Z only.  A text of fewer words than a shingle
    has its whole sequence as its one shingle; one without words has none.
    """
    words = words_of([x.lower() for x in batch_texts])
    h, first = rolling(words.hash, shingle), words.first.tolist()
    sets = []
    for a, b in zip(first, first[1:]):
        if b - a >= shingle:
            sets.append(np.unique(h[a : b - shingle + 1]))
        else:
            sets.append(rolling(words.hash[a:b], b - a) if b > a else words.hash[:0])
    offset = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offset[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offset


def signatures(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """MinHash signature (uint32) of each set that isn't empty; rows of empty ones are zero."""
    full = np.flatnonzero(np.diff(offset))
    out = np.zeros((len(offset) - 1, PERMUTATIONS), np.uint32)
    if len(full):
        at = offset[:-1][full]
        for i in range(PERMUTATIONS):
            out[full, i] = np.minimum.reduceat(((values ^ _XOR[i]) * _TIMES[i]) >> np.uint64(32), at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    halves = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS // 2)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), halves.shape[:2])
    for i in range(halves.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + halves[:, :, i])
    return key.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def features(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text hash, size and 128-bit digest of the shingle set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in sized(batches, CUT_BYTES):
            values, offset = shingle_sets(texts(batch), shingle)
            full = np.flatnonzero(np.diff(offset))
            digests = []
            for salt in (0x5BD1E995, 0x2545F4914F6CDD1D):
                d = np.zeros(len(offset) - 1, np.uint64)
                if len(full):
                    d[full] = np.add.reduceat(mix(values ^ np.uint64(salt)), offset[:-1][full])
                digests.append(pa.array(d.view(np.int64)))
            keys = band_keys(signatures(values, offset))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(np.diff(offset)), *digests, bands], names=["doc_id", "h", "n", "d1", "d2", "bands"])

    return keyed(docs).mapInArrow(run, "doc_id bigint, h bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """rep, n, items (the full set) and sig (its signature) of the documents with these ids.

    The texts are shuffled to the ids at every size: ids follow the input,
    so they are never assumed to be small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in sized(batches, CUT_BYTES):
            values, offset = shingle_sets(texts(batch), shingle)
            sig = signatures(values, offset)
            items = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offset)), items, pa.array([x.tobytes() for x in sig], pa.binary())], names=["rep", "n", "items", "sig"])

    rows = docs.join(ids.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    return rows.mapInArrow(run, "rep bigint, n bigint, items array<bigint>, sig binary")


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """For each number n of compared entries the fewest matches that don't prune.

    With a uniform prior, similarity after m matches of n is Beta(m + 1,
    n - m + 1); it is at least t with the probability that Binomial(n + 1, t)
    is at most m.
    """
    t, out = percent / 100, []
    for n in range(STEP, PERMUTATIONS + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                out.append((n, m))
                break
    return out


def unpruned(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two arrays of signatures sequential comparison doesn't prune, as row numbers."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in steps:
        seen[alive] += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(1)
        alive = alive[seen[alive] >= least]
    return alive


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sequential comparison of their signatures doesn't prune.

    Batches of entries are compared one after the other; a pair ends as soon
    as the posterior of reaching the threshold falls under the miss chance.
    """
    steps = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for c in ("sig_a", "sig_b"))
            kept = pa.array(unpruned(a, b, steps))
            yield pa.record_batch([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    both = _with_side(pairs, sets, "a", "b", "n", "sig").join(_side(sets, "b", "n", "sig"), "b")
    near_in_size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(near_in_size).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def _side(sets: DataFrame, x: str, *columns: str) -> DataFrame:
    return sets.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))


def _with_side(pairs: DataFrame, sets: DataFrame, x: str, other: str, *columns: str) -> DataFrame:
    """pairs with columns of x's set; a set that many pairs need is copied once for every GROUP of them, so none is a hot key."""
    n = written(pairs.groupBy(x).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / GROUP).cast("int")))
    dealt = join_spread(pairs, n, [x]).withColumn("part", F.pmod(F.xxhash64(other), F.col("blocks")).cast("int")).drop("blocks")
    side = _side(sets, x, *columns).join(n.select(x, "blocks"), x)
    copies = side.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.join(copies, [x, "part"]).drop("part")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    both = _with_side(pairs, sets, "a", "b", "items").join(_side(sets, "b", "items"), "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(100 * shared >= percent * (F.size("items_a") + F.size("items_b") - shared)).select("a", "b")


def candidates(root: np.ndarray, n: np.ndarray, block: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (i < j) of members of several components that their sizes and the sequential comparison of signatures leave.

    Where there are two blocks only pairs across them count.
    """
    steps, two = least_matches(percent), block.min() != block.max()
    out = [np.zeros((0, 2), np.int64)]
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        open_ = (root[rest] != root[i]) & (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest]))
        if two:
            open_ &= block[rest] != block[i]
        j = np.flatnonzero(open_) + i + 1
        if len(j):
            left = j[unpruned(np.broadcast_to(sig[i], (len(j), PERMUTATIONS)), sig[j], steps)]
            out.append(np.stack([np.full(len(left), i), left], 1))
    return np.concatenate(out)


def spanning(root: np.ndarray, n: np.ndarray, differences: list[np.ndarray], pairs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of one group's members as all of its candidate pairs at the threshold would.

    ``differences`` has each member's symmetric difference with the group's
    lead.  That of two members is the symmetric difference of these, so what
    two have in common follows from the overlap of two short sets; overlaps
    of members with candidates are one matrix product, in slices of elements.
    """
    part, pairs = np.unique(pairs, return_inverse=True)
    pairs, root, n, differences = pairs.reshape(-1, 2), root[part], n[part], [differences[i] for i in part]
    d = np.array([len(x) for x in differences])
    owner = np.repeat(np.arange(len(d)), d)
    _, code, count = np.unique(np.concatenate([np.zeros(0, np.int64), *differences]), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    keep = count[code] > 1
    owner, code = owner[keep], place[code[keep]]
    overlap = np.zeros((len(d), len(d)), np.float32)
    for low in range(0, int(code.max()) + 1 if len(code) else 0, 2048):
        here = (code >= low) & (code < low + 2048)
        m = np.zeros((len(d), 2048), np.float32)
        m[owner[here], code[here] - low] = 1
        overlap += m @ m.T
    total = n[:, None] + n[None, :]
    apart = d[:, None] + d[None, :] - 2 * overlap.astype(np.int64)
    linked = np.zeros(overlap.shape, bool)
    linked[pairs[:, 0], pairs[:, 1]] = linked[pairs[:, 1], pairs[:, 0]] = True
    linked &= 100 * (total - apart) >= percent * (total + apart)
    same = root[:, None] == root[None, :]
    out, waiting = [], np.ones(len(d), bool)
    for seed in range(len(d)):
        reached = [seed] if waiting[seed] else []
        waiting[seed] = False
        while reached:
            i = reached.pop()
            for j in np.flatnonzero(waiting & (linked[i] | same[i])).tolist():
                waiting[j] = False
                reached.append(j)
                if not same[i, j]:
                    out.append((int(part[i]), int(part[j])))
    return out


def remaining_links(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share buckets under one lead.

    Only leads whose members aren't in one component take part.  A member
    travels as its signature and its difference from the lead.  Groups of
    more than GROUP members are cut into blocks, and every pair of blocks is
    a group of its own, so no task holds more than two blocks.  Pairs of
    different components go through the sequential comparison; what it leaves
    is confirmed on the sets.
    """
    placed = members.select("lead", "rep").distinct().join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("lead", "rep", F.coalesce("root", "rep").alias("root"))
    placed = written(placed)
    n = F.count("*").alias("n")
    is_open = written(placed.groupBy("lead").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), n).where("lo < hi").select("lead", "n", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    rest = join_spread(placed, is_open, ["lead"]).withColumnRenamed("rep", "x").withColumn("own", own)
    leads = _side(sets, "lead", "items").join(is_open.select("lead", "blocks"), "lead").select("lead", "items_lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    both = rest.join(_side(sets, "x", "n", "items", "sig"), "x").join(leads, ["lead", "own"])
    difference = F.concat(F.array_except("items_x", "items_lead"), F.array_except("items_lead", "items_x"))
    groups = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("own", other).alias("low"), F.greatest("own", other).alias("high")))
    rows = both.select("lead", "x", "root", F.col("n_x").alias("n"), "own", F.col("sig_x").alias("sig"), difference.alias("difference"), F.explode(groups).alias("g")).select("lead", "g.*", "x", "root", "n", "own", "sig", "difference")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: list[tuple]) -> pa.RecordBatch:
            x, root, n, block, sig, difference = (list(c) for c in zip(*(r[3:] for r in group)))
            root, n = np.array(root), np.array(n)
            pairs = candidates(root, n, np.array(block), np.frombuffer(b"".join(sig), np.uint32).reshape(-1, PERMUTATIONS), percent)
            got = spanning(root, n, [np.array(v, np.int64) for v in difference], pairs, percent) if len(pairs) else []
            return pa.record_batch([pa.array([x[i] for i, _ in got], pa.int64()), pa.array([x[j] for _, j in got], pa.int64())], names=["a", "b"])

        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for _, group in groupby(rows, lambda r: r[:3]):
            yield links(list(group))

    keys = ["lead", "low", "high"]
    return rows.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def one_text_each(rows: DataFrame) -> DataFrame:
    """Of rows that share a doc_id the one with the smallest text hash; rows as they are if there is none such."""
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return rows.join(rows.groupBy("doc_id").agg(F.min("h").alias("h")), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id"])


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """Components of documents linked by Jaccard similarity of word shingles, one row per document.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and
    kept (doc_id = component_id).  Steps:

    1. Documents with equal sets form a class under the smallest doc_id; from
       here on classes stand for their members, so copies cost nothing.
    2. Signatures are cut into bands.  In each bucket of a band every class
       is paired with the bucket's first class, its lead; pairs are
       deduplicated over bands, pruned by sequential Bayesian comparison of
       signatures and confirmed on the full sets.
    3. Leads whose members aren't in one component by then may hide links
       between members.  There, and only there, members of a lead are
       compared among themselves, in blocks, by the same sequential test and
       on their sets (``remaining_links``).  So all candidate pairs that could
       join components are tested.

    Null and empty texts have n_shingles 0 and are alone.  A null doc_id
    sorts after all others and is returned as null.  Of several texts under
    one doc_id the one with the smallest hash stands for it in links.
    """
    docs = documents(docs)
    rows = written(features(docs, shingle))
    single, texts_of = one_text_each(rows), keyed(docs)
    if single is not rows:
        texts_of = texts_of.join(single.select("doc_id", "h"), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id"])
    reps = written(single.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    buckets = reps.select("rep", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("band", "lead")
    members = written(buckets.join(shared, "band").select("lead", "rep").distinct())
    sets = written(full_sets(texts_of, members.select("rep").distinct(), shingle))
    star = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    roots = components(confirmed(written(likely(star, sets, percent)), sets, percent))
    found = remaining_links(members, roots, sets, percent)
    roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found))
    classes = reps.select("d1", "d2", "n", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("root", "rep").alias("root"))
    out = rows.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    root = F.coalesce("root", "doc_id")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(root, F.lit(NO_ID)).alias("component_id"), (F.col("doc_id") == root).alias("kept"))
