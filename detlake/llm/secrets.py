"""Secret scans with corpus-wide ownership frequency (operator 2): DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detlake.llm.frames import NO_ID, join_spread, written


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value, and the least length of that group."""

    name: str
    pattern: str
    group: int
    least: int


#: Base kinds in the order in which spans are listed. Letters of the keywords match in either case, A-Z only.
BASE = (
    Kind("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Long bare tokens. Ownership over the corpus decides which of them are spans.
BARE = Kind("bare", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
KINDS = (*BASE, BARE)
#: A value of so many owners is an example that is widely copied; one of a single owner and few repositories is its own.
WIDE_OWNERS, OWN_REPOSITORIES = 3, 20
#: Words that mark a value as a placeholder.
PLACEHOLDER = "example|sample|changeme|placeholder|dummy|test|xxxx|0000|1234"


def found(text: Column, kind: Kind, number: int) -> Column:
    """Array of all leftmost matches: kind number, position, gap before the match, its length and value.

    Gaps are the pieces between matches, so that the running sum of gaps and
    matches gives every start in code points.  Texts without a match cost one
    pass of the pattern.
    """
    pattern = F.lit(kind.pattern)
    pieces = F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x))
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = matches if not kind.group else F.regexp_extract_all(text, pattern, F.lit(kind.group))
    rows = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("gap"), matches.alias("found"), values.alias("value")),
        lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("at"), x["gap"].alias("gap"), F.length(x["found"]).alias("size"), x["value"].alias("value")),
    )
    return F.when(F.regexp(text, pattern), rows)


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """doc_id, h (text hash), owner, repository and every match of any length, with the hash of its value as key.

    ``counts`` says whether a match is long enough and, if it is a bare
    token, looks live: only these are spans or are counted for ownership.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    arrays = [F.coalesce(found(F.col("text"), k, i), F.array()) for i, k in enumerate(KINDS)]
    hits = rows.select("doc_id", F.xxhash64("text").alias("h"), "owner", "repository", F.explode(F.concat(*arrays)).alias("m")).select("doc_id", "h", "owner", "repository", "m.*")
    least = F.element_at(F.array(*(F.lit(k.least) for k in KINDS)), F.col("kind") + 1)
    counts = (F.length("value") >= least) & ((F.col("kind") < len(BASE)) | live_looking(F.col("value")))
    return hits.withColumn("counts", counts).withColumn("key", F.when(counts, F.sha2("value", 256)))


def placed(hits: DataFrame) -> DataFrame:
    """doc_id, h, kind, start, end, value, key of the matches that count; those of repeated rows once.

    Rows that agree in doc_id and text have the same matches whoever owns
    them, so their owners play no part here.
    """
    once = hits.select("doc_id", "h", "kind", "at", "gap", "size", "value", "counts", "key").distinct()
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ended = once.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(w))
    return ended.where("counts").select("doc_id", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value", "key")


def live_looking(value: Column) -> Column:
    """Mixed letters and digits, many distinct characters, and no placeholder in it."""
    mixed = F.regexp(value, F.lit("[A-Za-z]")) & F.regexp(value, F.lit("[0-9]"))
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= 9) & ~F.regexp(F.lower(value), F.lit(PLACEHOLDER))


def ownership(hits: DataFrame) -> DataFrame:
    """key (hash of a value), n, n_owners, n_repositories and standing of every candidate value.

    Values are hashed before they move.  Owners and repositories are counted
    distinct over all rows; nulls count as none.  Distinct pairs of a value
    and an owner or repository are found first, dealt by both, so a value in
    a third of all documents reaches its task as partial counts.
    """
    n = hits.where("counts").groupBy("key").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"), F.count("*").alias("n"))
    standing = F.when(F.col("n_owners") >= WIDE_OWNERS, "copied").when((F.col("n_owners") <= 1) & (F.col("n_repositories") <= OWN_REPOSITORIES), "own").otherwise("shared")
    return n.withColumn("standing", standing)


def judged(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """All spans with their value's ownership: base spans, and bare tokens that look live, are one owner's own and overlap no base span."""
    hits = written(candidates(docs, owner, repository))
    joined = join_spread(written(placed(hits)), written(ownership(hits)), ["key"])
    joined = joined.withColumn("live", live_looking(F.col("value")))
    w = Window.partitionBy("doc_id", "h").orderBy("start", "kind")
    base = F.col("kind") < len(BASE)
    before = F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & F.coalesce(after >= F.col("end"), F.lit(True))
    return joined.withColumn("free", free).where(base | (F.col("free") & (F.col("standing") == "own")))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Secrets of each whole text, with what ownership over the corpus says of them.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base
    spans ``kind:start:end``), spans (those and the added bare ones), and
    n_bare, n_copied, n_shared, n_own, n_live (own ones that look live).
    ``owner`` and ``repository`` name the columns that say whose a document
    is; documents has no repository, so each document counts as one.
    Null and empty texts have no spans.  Null owners and repositories count
    as none.  A null doc_id is returned as null; rows equal in doc_id and
    text each get the same result, and each of their owners counts.  Of
    spans that start alike the kind listed first comes first.
    """
    spans = judged(docs, owner, repository)
    name = F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), F.col("kind") + 1)
    item = F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("text"))
    counts = [F.count_if(F.col("kind") == i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    counts += [F.count_if(F.col("standing") == s).alias(f"n_{s}") for s in ("copied", "shared", "own")]
    counts += [F.count_if((F.col("standing") == "own") & F.col("live")).alias("n_live")]
    by_doc = spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(item)).alias("items"), *counts)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    all_rows = rows.join(by_doc, ["doc_id", "h"], "left")

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(F.coalesce(items, F.array()), lambda x: x["text"]), ",")

    base = F.filter("items", lambda x: x["kind"] < len(BASE))
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    more = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("n_bare", "n_copied", "n_shared", "n_own", "n_live")]
    return all_rows.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), *numbers, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("items")).alias("spans"), *more)


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """docs with every span of their texts replaced: ``<secret>``, or ``<example>`` where the value is widely copied.

    Spans that overlap are replaced as one; it is an example only if all of
    them are.  n_chars follows the text if there is such a column.  Other
    columns stay as they are, whatever their names.
    """
    spans = judged(docs, owner, repository).select("doc_id", "h", "start", "end", (F.col("standing") == "copied").alias("example"))
    w = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(before > F.col("start"), 0).otherwise(1)).over(w)
    merged = spans.withColumn("_before", before).withColumn("_group", group).groupBy("doc_id", "h", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("example").alias("example"))
    marks = merged.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "example"))).alias("_marks")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "_marks")
    key = [F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == marks["_id"], F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == marks["_h"]]
    out = docs.join(marks, key[0] & key[1], "left")
    ends = F.concat(F.array(F.lit(0)), F.transform(marks["_marks"], lambda m: m["end"].cast("int")))
    starts = F.concat(F.transform(marks["_marks"], lambda m: m["start"].cast("int")), F.array(F.length(docs["text"])))
    words = F.concat(F.transform(marks["_marks"], lambda m: F.when(m["example"], "<example>").otherwise("<secret>")), F.array(F.lit("")))
    parts = F.transform(F.sequence(F.lit(1), F.size(marks["_marks"]) + 1), lambda i: F.concat(F.substring(docs["text"], F.element_at(ends, i) + 1, F.element_at(starts, i) - F.element_at(ends, i)), F.element_at(words, i)))
    text = F.when(marks["_marks"].isNull(), docs["text"]).otherwise(F.array_join(parts, ""))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias("text"))
        elif c == "n_chars":
            columns.append(F.when(marks["_marks"].isNull(), docs[c]).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(docs[c])
    return out.select(*columns)
