"""Language identification by cross-parsing with suffix automata (operator 8)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detlake.llm.frames import documents, held_out, model, sized

#: Bound of the labelled sample: documents of a language, and characters of one, which is taken whole or not at all.
TRAIN_DOCS, TRAIN_DOC_CHARS = 24, 10_000
#: Long texts are parsed from so many symbols on in step, and the parses joined afterwards.
BLOCK = 512
#: Entries of an automaton's transition table; with more (a large alphabet) only those that exist are kept.
DENSE = 1 << 23


def symbols(text: str) -> str:
    """Lower case, with every run of other characters than letters as one blank."""
    return re.sub(r"[\W\d_]+", " ", text.lower())


class SuffixAutomaton:
    """The smallest automaton of all substrings of a text; each state's transitions are a dict."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[state] = twin
            last = state

    def match(self, text: str, at: int = 0) -> int:
        """Length of the longest match that starts there."""
        state, n = 0, 0
        while at + n < len(text) and (state := self.next[state].get(text[at + n], -1)) >= 0:
            n += 1
        return n

    def phrases(self, text: str) -> int:
        """Phrases of the cross-parse: each is the longest match, or one unknown symbol."""
        at = n = 0
        while at < len(text):
            at += max(1, self.match(text, at))
            n += 1
        return n


class Transitions:
    """The transitions of an automaton as arrays: state and symbol number to the next state, or -1."""

    def __init__(self, automaton: SuffixAutomaton, column: dict[str, int], width: int, dense: int = DENSE):
        edges = sorted((state * width + column[c], to) for state, some in enumerate(automaton.next) for c, to in some.items())
        key, to = (np.array(x, np.int64) for x in (zip(*edges) if edges else ((), ())))
        self.width, self.table = width, None
        if len(automaton.next) * width <= dense:
            self.table = np.full(len(automaton.next) * width, -1, np.int32)
            self.table[key] = to
        else:
            self.key, self.to = key, to

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = state * self.width + symbol
        if self.table is not None:
            return self.table[at].astype(np.int64)
        spot = np.minimum(np.searchsorted(self.key, at), len(self.key) - 1)
        return np.where(self.key[spot] == at, self.to[spot], -1)

    def walk(self, codes: np.ndarray, at: np.ndarray, stop: np.ndarray, starts: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Parses from each position ``at`` to the first phrase that starts at ``stop`` or later, all in step.

        Marks where phrases start; returns where each parse has ended.  With
        ``known`` a parse also ends where a known phrase starts.  Symbol 0 is
        unknown to every state, and one follows each text.
        """
        final, lane, at, state = at.copy(), np.arange(len(at)), at.copy(), np.zeros(len(at), np.int64)
        while len(lane):
            fresh = state == 0
            done = fresh & (at >= stop)
            if known is not None:
                done |= fresh & known[at]
            if done.any():
                final[lane[done]] = at[done]
                going = ~done
                lane, at, state, stop, fresh = lane[going], at[going], state[going], stop[going], fresh[going]
            starts[at[fresh]] = True
            to = self.step(state, codes[at])
            miss = to < 0
            at = at + (~miss | fresh)  # a phrase ends before a symbol that doesn't go on, or is one unknown symbol
            state = np.where(miss, 0, to)
        return final

    def phrase_starts(self, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Where the phrases of whole texts start: blocks are parsed from their begin on, and again where a phrase enters them.

        A block's first parse holds from where it meets the one that comes
        from the block before (``follows``: there is one in the same text).
        """
        starts = np.zeros(len(codes) + 1, bool)
        final, entry = self.walk(codes, begin, stop, starts), begin.copy()
        while True:
            wrong = np.flatnonzero(follows & (np.append(0, final[:-1]) != entry))
            if not len(wrong):
                return starts
            old, fresh = entry[wrong], np.zeros(len(codes) + 1, bool)
            entry[wrong] = final[wrong - 1]
            met = self.walk(codes, entry[wrong], stop[wrong], fresh, starts)
            inside = met < stop[wrong]
            edge = np.zeros(len(codes) + 2, np.int64)
            np.add.at(edge, begin[wrong], 1)
            np.add.at(edge, np.where(inside, met, stop[wrong]), -1)
            starts &= np.cumsum(edge[:-1]) == 0
            starts |= fresh
            final[wrong[~inside]] = met[~inside]


class CrossParser:
    """Suffix automata of all languages over one alphabet; number 0 stands for symbols of no language."""

    def __init__(self, training: dict[str, str], dense: int = DENSE):
        self.langs = sorted(training)
        alphabet = sorted({c for x in training.values() for c in x})
        column = {c: i + 1 for i, c in enumerate(alphabet)}
        self.automata = [Transitions(SuffixAutomaton(training[x]), column, len(alphabet) + 1, dense) for x in self.langs]
        self.column = np.zeros(0x110000, np.uint8 if len(alphabet) < 255 else np.int32)
        for c, i in column.items():
            self.column[ord(c)] = i
        self.log = np.array([math.log(max(2, len(training[x]))) for x in self.langs])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (of symbols only) under each language."""
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        size = np.array([len(x) for x in texts], np.int64)
        if not size.sum():
            return out
        joined = "\0".join(texts) + "\0"  # never a symbol, so it is number 0
        codes = self.column[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        first = np.append(0, np.cumsum(size + 1))
        blocks = (size + BLOCK - 1) // BLOCK
        text = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[text] + number * BLOCK
        stop = np.minimum(begin + BLOCK, first[text] + size[text])
        for k, automaton in enumerate(self.automata):
            total = np.append(0, np.cumsum(automaton.phrase_starts(codes, begin, stop, number > 0)))
            out[k] = total[first[1:]] - total[first[:-1]]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each; ``und`` with score 0 without a letter.

        The winner has the least phrases times log of its training length, in
        nats.  The score is its share of exp(-cost) over all languages.
        """
        plain = [symbols(x) if x else "" for x in texts]
        cost = self.counts(plain) * self.log[:, None]
        out = []
        for i, x in enumerate(plain):
            if not self.langs or not any(map(str.isalpha, x)):
                out.append(("und", 0.0))
                continue
            best = int(np.argmin(cost[:, i]))
            out.append((self.langs[best], float(1 / np.exp(np.maximum(cost[best, i] - cost[:, i], -700)).sum())))
        return out


def training_text(docs: DataFrame) -> dict[str, str]:
    """A bounded sample of labelled documents of each language, from outside the held-out fold.

    Of the TRAIN_DOCS documents of a language with the smallest hashes of
    their ids those of at most TRAIN_DOC_CHARS characters teach, whole; if
    all are longer, the shortest does.  Only ids and languages are ranked,
    the texts are then joined to those few ids.
    """
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = labelled.withColumn("_rank", rank).where(F.col("_rank") <= TRAIN_DOCS).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    texts = documents(docs, F.col("lang").cast("string").alias("lang")).where("text is not null").join(some.distinct(), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    size = F.length("text")
    least = F.min(F.struct(size.alias("n"), "doc_id", F.xxhash64("text").alias("h"))).over(Window.partitionBy("lang"))
    taken = (size <= TRAIN_DOC_CHARS) | ((least["n"] > TRAIN_DOC_CHARS) & (least["doc_id"] == F.col("doc_id")) & (least["h"] == F.xxhash64("text")))
    rows = texts.withColumn("_taken", taken).where("_taken").select("lang", F.xxhash64("doc_id").alias("_rank"), "text").distinct().collect()
    out: dict[str, str] = {}
    for row in sorted(rows):
        out[row["lang"]] = out.get(row["lang"], "") + symbols(row["text"]) + " "
    return out


def identify(docs: DataFrame, training: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of each row's whole text.

    Learns from ``training`` (text by language), or from a bounded sample of
    docs' own labelled rows outside the held-out fold.  Null texts and texts
    without a letter are ``und`` with score 0, as is everything if nothing
    can be learned.  Of languages that cost equally little the first by name
    wins.  A null doc_id is not held out; repeated rows stay.
    """
    training = training_text(docs) if training is None else training
    key = hash(tuple(sorted(training.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = model(("parser", key), lambda: CrossParser(training))  # the text is small; each worker makes the tables from it once
        for batch in sized(batches, 1 << 20):
            found = parser.predict(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
