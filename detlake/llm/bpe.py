"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 6)."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from detlake.llm.frames import by_batch, documents, model
from detlake.llm.tokens import SPLIT, Memory

#: Pieces (in each of two generations) and token pairs whose result a worker remembers, and the longest piece whose entries are found on demand.
PIECES, PAIRS, SHORT = 260_000, 200_000, 64
#: Tokens whose texts are put together at a time, and last bytes by which the sizes of the tokens that may end there are looked up.
TAKEN, TAIL = 1 << 18, 3


class Vocabulary:
    """A rank file, and which tokens may stand next to each other.

    Tokens are what byte-pair merging yields exactly if each merges to itself
    and each adjacent pair is ``compatible``: merging the bytes of both leaves the
    boundary between them in place.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.split = regex.compile(SPLIT)
        self._halves = {token: self._last_merge(text, token) for token, text in self.bytes.items()}
        self.ending = {text: token for text, token in self.rank.items() if self._halves[token] is not False}
        self.ends = ahocorasick.Automaton()  # finds all tokens that end at each byte, bytes taken as Latin-1
        for text, token in self.ending.items():
            self.ends.add_word(text.decode("latin-1"), (token, len(text)))
        self.ends.make_automaton()
        sizes: dict[bytes, set[int]] = {}
        for text in self.ending:
            sizes.setdefault(text[-TAIL:], set()).add(len(text))
        self._sizes = {tail: tuple(sorted({*found, *range(1, TAIL)}, reverse=True)) for tail, found in sizes.items() if len(tail) == TAIL}
        self.pairs: dict[int, bool] = {}
        self._last_token = self._finder()
        self.pieces = Memory(self._piece, PIECES)
        every = range(max(self.bytes) + 1)
        self.texts = pa.array([self.bytes.get(i) for i in every], pa.large_binary())
        self.decimals = pa.array([b" %d" % i for i in every], pa.large_binary())

    def _last_merge(self, text: bytes, own: int) -> tuple[int, int] | None | bool:
        """The last merge of a token; None for a byte, False if merging its bytes never makes it."""
        parts = [text[i : i + 1] for i in range(len(text))]
        if len(parts) < 2:
            return None
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, own) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least >= own:
                return False
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 24 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 24 | b] = self._compatible(a, b)
        return known

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as 32-bit numbers."""
        data = piece.encode("utf-8")
        if data in self.rank:
            ids = [self.rank[data]]
        elif len(data) > SHORT:
            ids = Prefixes(self, data).tokens()
        else:
            ids, end, last, find, texts = [], len(data), {}, self._last_token, self.bytes
            while end:
                token = last.get(end)
                if token is None:
                    token = find(data, end, last)
                ids.append(token)
                end -= len(texts[token])
            ids.reverse()
        return array("i", ids).tobytes()

    def _finder(self) -> Callable[[bytes, int, dict[int, int]], int]:
        """The unique valid last token of a prefix: f(data, end, last); ``last`` keeps it and those of the shorter prefixes it asks for.

        Only sizes of tokens that end in the prefix's last bytes are tried.
        """
        ending, pairs, compatible, sizes = self.ending.get, self.pairs.get, self.compatible, self._sizes.get
        few, short = tuple(range(TAIL - 1, 0, -1)), [tuple(range(end, 0, -1)) for end in range(TAIL)]

        def find(data: bytes, end: int, last: dict[int, int]) -> int:
            for size in sizes(data[end - TAIL : end], few) if end >= TAIL else short[end]:
                start = end - size
                if start > 0:
                    token = ending(data[start:end])
                    if token is None:
                        continue
                    before = last.get(start)
                    if before is None:
                        before = find(data, start, last)
                    fits = pairs(before << 24 | token)
                    if fits or fits is None and compatible(before, token):
                        last[end] = token
                        return token
                elif not start:
                    token = ending(data[:end])
                    if token is not None:
                        last[end] = token
                        return token
            raise ValueError(f"no token for byte {data[end - 1]!r}")

        return find

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the merges on both sides, the latest first, and look for one across the boundary that comes sooner."""
        text, rank, halves, before = self.bytes, self.rank.get, self._halves, len(self.rank) + 1
        left, right, x, y = halves[a], halves[b], text[a], text[b]
        while True:
            if rank(x + y, before) < before:
                return False
            if left and (a > b or not right):
                before, a = a, left[1]  # among equal ranks the leftmost pair merges first: a's own
                left, x = halves[a], text[a]
            elif right:
                before, b = b + 1, right[0]
                right, y = halves[b], text[b]
            else:
                return True

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text; repeated pieces are encoded once while remembered."""
        known, make = self.pieces.new.get, self.pieces.__getitem__
        return np.frombuffer(b"".join([known(piece) or make(piece) for piece in self.split.findall(text)]), np.intc)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])


class Prefixes:
    """The unique valid last token of every prefix of a byte string.

    Prefix i ends in the one token whose bytes are its suffix and which is
    compatible with the last token of what stands before.  Bytes can be
    appended, or a part replaced, and only the entries that change are
    computed again.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> Prefixes:
        at = len(self.data)
        self.data += data
        for _ in self._entries(at):
            pass
        return self

    def _entries(self, at: int) -> Iterator[int]:
        """Adds the entries from prefix ``at + 1`` on one by one.

        The automaton names the tokens that end at each byte; exactly one of
        them is compatible with the last token of the prefix before it.
        """
        v, last = self.vocabulary, self.last
        base = max(0, at + 1 - v.longest)  # no token that ends later starts before this byte
        for end, (token, size) in v.ends.iter(self.data[base:].decode("latin-1")):
            end += base
            if end != at:
                if end < at:
                    continue  # found already
                break
            start = end + 1 - size
            if start and not v.compatible(last[start - 1], token):
                continue
            last.append(token)
            at += 1
            yield token
        if at < len(self.data):
            raise ValueError(f"no token for byte {self.data[at]!r}")

    def replace(self, start: int, end: int, data: bytes) -> Prefixes:
        """Replace bytes start..end.  Entries after the edit are kept once as many as the longest token agree again."""
        old, shift, fresh = self.last, len(data) - (end - start), start + len(data)
        self.data, self.last = self.data[:start] + data + self.data[end:], self.last[:start]
        agree = 0
        for token in self._entries(start):
            at = len(self.last)
            if at > fresh:
                agree = agree + 1 if token == old[at - 1 - shift] else 0
                if agree >= self.vocabulary.longest:
                    self.last += old[at - shift :]
                    break
        return self

    def tokens(self) -> list[int]:
        """Tokens of the whole string; one that is itself in the vocabulary is that token, as the library has it."""
        if self.data in self.vocabulary.rank:
            return [self.vocabulary.rank[self.data]]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker and file."""
    return model(("ranks", path), lambda: Vocabulary(path))


def _joined(table: pa.Array, ids: np.ndarray) -> Iterator[memoryview]:
    """The table's bytes of all ids, one after the other, in parts."""
    for low in range(0, len(ids), TAKEN):
        _, offsets, data = table.take(pa.array(ids[low : low + TAKEN])).buffers()
        edge = np.frombuffer(offsets, np.int64)
        yield memoryview(data)[edge[0] : edge[min(TAKEN, len(ids) - low)]]


def digests(v: Vocabulary, ids: np.ndarray) -> tuple[str, str]:
    """Hashes of the ids in decimals, joined by a space, and of the bytes that they decode to."""
    decimals, decoded = hashlib.sha256(), hashlib.sha256()
    for i, part in enumerate(_joined(v.decimals, ids)):
        decimals.update(part if i else part[1:])
    for part in _joined(v.texts, ids):
        decoded.update(part)
    return decimals.hexdigest(), decoded.hexdigest()


def encode_documents(docs: DataFrame, ranks: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the decoded bytes of each row's whole text.

    ids_sha256 is over the decimal ids joined by a space, decoded_sha256 over
    the bytes that the ids decode to.  ``keep_ids`` adds the ids themselves.
    A null or empty text has no tokens; null and repeated doc_ids stay as
    they are, and other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(ranks)
        all_ids = [v.ids(text or "") for text in batch.column("text").to_pylist()]
        n = np.array([len(ids) for ids in all_ids], np.int64)
        ids_hash, text_hash = zip(*(digests(v, ids) for ids in all_ids)) if len(n) else ((), ())
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
        if keep_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *all_ids])))
        return pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return documents(docs).mapInArrow(by_batch(run), schema)
