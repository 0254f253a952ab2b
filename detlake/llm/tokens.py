"""Token counts by heap-and-linked-list byte-pair merging (operator 5)."""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from detlake.llm.frames import by_batch, documents, model

#: How byte-level vocabularies split a text before merging: the published pattern, with \s as Unicode white space,
#: which is what it stands for in the libraries' own engines.
SPLIT = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
#: Pieces whose result a worker remembers, in each of two generations.
REMEMBERED = 200_000


class Memory:
    """A bounded map: two generations of entries, the older dropped when the newer is full."""

    def __init__(self, make, size: int = REMEMBERED):
        self.make, self.size, self.new, self.old = make, size, {}, {}

    def __getitem__(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class HeapCounter:
    """Number of tokens of a text under a byte-level BPE vocabulary file (.json).

    Each piece of a text starts as a doubly linked list of its bytes.  A heap
    holds the adjacent pairs that can merge, by rank and then position; the
    lowest is popped and merged until none is left.  The count is the number
    of initial symbols minus the number of merges; no ids are looked up.
    Strings of added special tokens inside a text count as one token, as the
    library's default has it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        unhandled = self.unhandled(spec)
        if unhandled:
            raise ValueError(f"a vocabulary with {', '.join(unhandled)} isn't handled")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.symbol = byte_symbols()
        self.split = regex.compile(SPLIT)
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memory = Memory(self.piece)

    @staticmethod
    def unhandled(spec: dict) -> list[str]:
        """Settings of a vocabulary file that would change counts in a way this counter doesn't know."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        out = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        out += ["normalizer"] * bool(spec.get("normalizer"))
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            out.append("pre_tokenizer")
        return out + [k for k in ("lstrip", "rstrip", "single_word") if any(t.get(k) for t in spec.get("added_tokens", ()))]

    def piece(self, piece: str) -> int:
        value = [self.symbol[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(value)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, value[i], value[i + 1]) for i in range(n - 1) if (r := rank.get((value[i], value[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if value[i] != left or j >= n or value[j] != right:
                continue  # one side has merged meanwhile
            merges += 1
            value[i], value[j] = left + right, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((value[i], value[k]))) is not None:
                    heappush(heap, (r, i, value[i], value[k]))
            if (h := before[i]) >= 0 and (r := rank.get((value[h], value[i]))) is not None:
                heappush(heap, (r, h, value[h], value[i]))
        return n - merges

    def plain(self, text: str) -> int:
        known, make = self.memory.new.get, self.memory.__getitem__
        total = 0
        for x in self.split.findall(text):
            total += known(x) or make(x)
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


def counter(path: str) -> HeapCounter:
    """One counter for each worker and vocabulary."""
    return model(("merges", path), lambda: HeapCounter(path))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row's whole text.

    A null or empty text has 0 bytes and 0 tokens.  Rows keep their doc_id,
    null and repeated ones included; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(vocabulary).count
        text = [x or "" for x in batch.column("text").to_pylist()]
        n = [count(x) for x in text]
        return pa.record_batch([batch.column("doc_id"), pa.array([len(x.encode("utf-8")) for x in text], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).mapInArrow(by_batch(run), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
