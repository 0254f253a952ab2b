"""Every operator on awkward rows, against brute force where SQL can't say what it does."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("detlake.llm.queries")
import public_tokenizers as P  # noqa: E402

from detlake.llm import bpe, decontaminate, fingerprint, language, minhash, secrets, suffixes, tokens, toxicity, windows  # noqa: E402

RND = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


SHARED, LONG = prose(60), prose(30_000)
NEAR = prose(200)
TEXTS = {
    0: prose(100) + " " + SHARED, 1: None, 2: "", 3: " \n\t ", 4: "one", 5: "one", 6: NEAR, 7: NEAR, 8: NEAR.replace(NEAR.split()[50], "zz", 1),
    9: LONG, 10: SHARED + " " + prose(80), 11: "ñandú 😀 \u0085 don't  <|endoftext|>", 12: 'token = "abcdefghijkl0123" AKIA' + "A1" * 8 + " " + "0f" * 10, 13: prose(12), 14: "For " * 300, 15: " ".join(LONG.split()[:500]),
}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_tokens int, a int, h int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or ""), "x", 1, 2, 3, "y") for i, t in TEXTS.items()]
    rows += [rows[7], rows[1], (None, "no id " + SHARED, None, None, 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_token_counts_match_the_library(docs, nothing):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = rows_of(tokens.count_tokens(docs, path))
    assert len(got) == len(TEXTS) + 3 and tokens.count_tokens(nothing, path).count() == 0
    for r in got:
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]] or ""
            assert (r["n_tokens"], r["n_bytes"]) == (len(library.encode(text, add_special_tokens=False).ids), len(text.encode()))
            assert r["over_limit"] == (r["n_tokens"] > 1024)


def test_bpe_matches_the_library_and_comes_back(docs, nothing):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(bpe.encode_documents(docs, path, keep_ids=True))
    assert bpe.encode_documents(nothing, path).count() == 0
    for r in got:
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]] or ""
            ids = library.encode_ordinary(text)
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_tokens_of_random_code_points_match_the_libraries():
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    ranks, merges = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
    with open(ranks, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    other, v, counter, rnd = Tokenizer.from_file(merges), bpe.vocabulary(ranks), tokens.HeapCounter(merges), random.Random(21)
    pools = [lambda: chr(rnd.randrange(0x80)), lambda: chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)])), lambda: rnd.choice("the of'sll \n\x1c\u0085\u00a0\u3000\u200b09"), lambda: rnd.choice("abcdefghij")]
    for i in range(400):
        text = "".join(pools[i % 4]() for _ in range(rnd.randrange(0, 300)))
        ids = library.encode_ordinary(text)
        assert v.encode(text) == ids and v.decode(ids) == text.encode()
        assert counter.count(text) == len(other.encode(text, add_special_tokens=False).ids)


def test_a_remembered_piece_is_its_ids_and_few_sizes_are_tried():
    v = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    piece = " unwahrscheinlichkeiten"
    assert v.pieces[piece] == np.array(v.encode(piece), np.intc).tobytes()
    tried = [len(v._sizes.get(piece.encode()[end - 3 : end], (2, 1))) for end in range(3, len(piece) + 1)]
    assert sum(tried) < 9 * len(tried)
    for text in v.ending:
        assert len(text) < 3 or len(text) in v._sizes[text[-3:]]
    long = "ab" * 200_000  # more tokens than are put together at a time
    ids = bpe.Prefixes(v, long.encode()).tokens() + v.encode(" of the" * 150_000)
    text = v.decode(ids)
    assert len(ids) > bpe.TAKEN and bpe.digests(v, np.array(ids, np.intc)) == (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_vocabularies_that_are_not_handled_are_refused():
    spec = {"model": {"end_of_word_suffix": "</w>"}, "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True}, "added_tokens": [{"lstrip": True}]}
    assert tokens.HeapCounter.unhandled(spec) == ["end_of_word_suffix", "normalizer", "lstrip"]
    with pytest.raises(ValueError):
        tokens.HeapCounter(P.path("word_bpe_49k.json"))


def test_prefixes_append_and_replace_as_if_encoded_anew():
    v, rnd = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")), random.Random(3)
    for _ in range(300):
        s = bytes(rnd.choice(b"the ranking of it") for _ in range(rnd.randrange(60)))
        a = rnd.randrange(len(s) + 1)
        b, new = rnd.randrange(a, len(s) + 1), bytes(rnd.choice(b"abe ") for _ in range(rnd.randrange(5)))
        assert bpe.Prefixes(v, s).replace(a, b, new).last == bpe.Prefixes(v, s[:a] + new + s[b:]).last
        assert bpe.Prefixes(v, s[:a]).append(s[a:]).last == bpe.Prefixes(v, s).last


def word_list(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_near_duplicates_are_those_of_brute_force(docs, nothing):
    def items(text):
        w = word_list(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()

    sets = {i: items(t) for i, t in TEXTS.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = rows_of(minhash.near_duplicates(docs, 80, 2))
    assert len(got) == len(TEXTS) + 3 and minhash.near_duplicates(nothing).count() == 0
    for r in got:
        if r["doc_id"] is not None:
            i = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), root[i], root[i] == i)
    assert root[8] == 6


def test_links_that_no_lead_shows_are_found(spark):
    # A chain: each text is near the next, not near those further on.
    words, rows = NEAR.split(), []
    for i in range(40):
        words = words[:]
        for j in range(4):
            words[(i * 5 + j) % 200] = f"new{i}_{j}"
        rows.append((1000 - i, " ".join(words)))
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 80, 2))
    assert {r["component_id"] for r in got} == {961}


def test_repeated_windows_are_those_of_brute_force(docs, nothing, monkeypatch):
    lists = {i: word_list(t) for i, t in TEXTS.items()} | {1 << 60: word_list("no id " + SHARED)}
    for width, name in ((13, "windows"), (50, "passages")):
        first, several = {}, {}
        for i, w in sorted(lists.items()):
            for a in range(len(w) - width + 1):
                key = tuple(w[a : a + width])
                first.setdefault(key, i)
                several.setdefault(key, set()).add(i)
        gone = {i: {j for a in range(len(w) - width + 1) if first[tuple(w[a : a + width])] < i for j in range(a, a + width)} for i, w in lists.items()}
        again = {i: {j for a in range(len(w) - width + 1) if len(several[tuple(w[a : a + width])]) > 1 for j in range(a, a + width)} for i, w in lists.items()}
        if name == "windows":
            got = rows_of(windows.remove_repeats(docs))
            assert len(got) == len(TEXTS) + 3 and windows.remove_repeats(nothing).count() == 0
            for r in got:
                i = (1 << 60) if r["doc_id"] is None else r["doc_id"]
                kept = " ".join(w for j, w in enumerate(lists[i]) if j not in gone[i])
                assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(lists[i]), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest()), i
            for most in (0, 2_000):  # larger buckets go by the windows' digests
                monkeypatch.setattr(windows, "BUCKET_BYTES", most)
                assert sorted(map(str, rows_of(windows.remove_repeats(docs)))) == sorted(map(str, got))
        else:
            got = {(1 << 60) if r["doc_id"] is None else r["doc_id"]: r for r in rows_of(suffixes.repeated_passages(docs))}
            assert set(got) == {i for i in lists if again[i]} and suffixes.repeated_passages(nothing).count() == 0
            for i, r in got.items():
                assert (r["n_repeated"], r["n_removable"]) == (len(again[i]), len(gone[i])), i
            for crowd in (1, 3):  # heads of more suffixes go by the windows' digests
                monkeypatch.setattr(suffixes, "COMPARED", crowd)
                assert {(1 << 60) if r["doc_id"] is None else r["doc_id"]: r for r in rows_of(suffixes.repeated_passages(docs))} == got


def test_repeated_passages_of_random_texts_are_those_of_brute_force(spark):
    # Few words, so that passages overlap, repeat within a text and differ in a single word.
    rnd = random.Random(9)
    pool = [" ".join(rnd.choice("ab\x01c") for _ in range(70)) for _ in range(4)]
    texts = []
    for i in range(60):
        words = []
        while len(words) < rnd.randrange(0, 400):
            some = rnd.choice(pool).split(" ")
            a = rnd.randrange(0, 40)
            some = some[a : a + rnd.randrange(1, 70)]
            if rnd.random() < 0.5:
                some[rnd.randrange(len(some))] = rnd.choice("ab")
            words += some
        texts.append(words)
    have = {}
    for i, w in enumerate(texts):
        for a in range(len(w) - 49):
            have.setdefault(tuple(w[a : a + 50]), set()).add(i)
    got = {r["doc_id"]: r for r in rows_of(suffixes.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")))}
    for i, w in enumerate(texts):
        both = [{j for a in range(len(w) - 49) if test(have[tuple(w[a : a + 50])]) for j in range(a, a + 50)} for test in (lambda s: len(s) > 1, lambda s: min(s) < i)]
        assert both[0] or i not in got
        if both[0]:
            spans = [{j for x in got[i][c].split(",") if x for j in range(*map(int, x.split(":")))} for c in ("passages", "removable")]
            assert spans == both and (got[i]["n_repeated"], got[i]["n_removable"]) == (len(both[0]), len(both[1]))


def test_spans_of_secrets(docs, nothing):
    got = {r["doc_id"]: r for r in rows_of(secrets.scan(docs))}
    assert secrets.scan(nothing).count() == 0 and secrets.scan(docs).count() == len(TEXTS) + 3
    r, text = got[12], TEXTS[12]
    spans = [x.split(":") for x in r["spans"].split(",")]
    assert [k for k, _, _ in spans] == ["assign", "access", "hex"] and (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    assert text[int(spans[1][1]) : int(spans[1][2])] == "AKIA" + "A1" * 8
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == ""


def test_ownership_separates_examples_from_own_values(spark):
    own, wide = "qW9zX8cV7bN6mK5jH4gF", "aB1cD2eF3gH4iJ5kL6mN"
    rows = [(i, f"see {wide} here", f"s{i}") for i in range(4)] + [(9, f"see {own} ñ {own}", "s9")]
    got = {r["doc_id"]: r for r in rows_of(secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")))}
    assert got[0]["spans"] == "" and got[9]["spans"] == "bare:4:24,bare:27:47" and got[9]["n_live"] == 2


BASE_PATTERNS = {
    "assign": (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 1, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 0, 18),
    "hex": ("[0-9a-f]+", 0, 0, 16),
}


def base_spans(text):
    """(start, kind, end) of the base spans, by Python's own engine."""
    out = []
    for k, (pattern, flags, group, least) in enumerate(BASE_PATTERNS.values()):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    names = list(BASE_PATTERNS)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_are_those_of_brute_force(spark):
    rnd = random.Random(8)
    parts = ["password", "Passwd ", "SECRET", "token", "api_key", "ApiKey", "=", ": ", "'", '"', " ", "\n", "AKIA", "AKIAAB12" * 3, "deadbeef", "0123456789abcdef0", "ñ", "😀", "x_y.z-", "Zz9+/=", "abcABC123456", "12"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 80))) for _ in range(300)]
    got = {r["doc_id"]: r for r in rows_of(secrets.scan(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")))}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert ",".join(x for x in got[i]["spans"].split(",") if x and not x.startswith("bare")) == want, t
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_every_owner_of_a_repeated_row_counts(spark):
    token, other = "qW9zX8cV7bN6mK5jH4gF", "Zz1yY2xX3wW4vV5uU6tT"
    rows = [(1, f"see {token}", s) for s in ("a", "b", "c")] + [(None, f"see {other}", None), (None, f"see {other}", "a")]
    got = rows_of(secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")))
    assert [(r["n_bare"], r["n_copied"], r["n_own"]) for r in got if r["doc_id"] == 1] == [(0, 0, 0)] * 3
    assert [(r["n_bare"], r["n_own"]) for r in got if r["doc_id"] is None] == [(1, 1)] * 2
    based = [(i, f'token = "{token}"', s) for i, s in ((1, "a"), (1, "b"), (1, "c"), (2, "a"))]
    assert all(r["n_copied"] == 1 for r in rows_of(secrets.scan(spark.createDataFrame(based, "doc_id bigint, text string, source string"))))


def test_redaction_keeps_rows_and_columns(docs, nothing):
    got = secrets.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count() and secrets.redact(nothing).count() == 0
    texts = {r["doc_id"]: r for r in rows_of(got)}
    assert texts[12]["text"] == "<secret> <secret> <secret>" or texts[12]["text"] == '<secret>" <secret> <secret>'
    assert texts[12]["n_chars"] == len(texts[12]["text"]) and texts[9]["text"] == LONG and texts[1]["text"] is None


def test_leaks_by_edit_distance(spark, docs, nothing):
    item = [f"b{i}" for i in range(40)]
    edited = item[:10] + ["x"] + item[11:20] + item[21:30] + ["y"] + item[30:]
    far = [w if i % 3 else "z" for i, w in enumerate(item)]
    rows = [(1, prose(50) + " " + " ".join(item) + " " + prose(50)), (2, prose(20) + " " + " ".join(edited)), (3, prose(10) + " " + " ".join(far)), (4, prose(500)), (5, None), (6, "")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in rows_of(decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench))}
    assert set(got) == {1, 2} and (got[1]["n_edits"], got[1]["start"], got[1]["end"]) == (0, 50, 90) and got[2]["n_edits"] == 3
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size, share", [(10, 0.2), (40, 0.1), (40, 0.2), (90, 0.2)])
def test_recall_of_the_embedding(size, share):
    from detlake.llm.flat import words_of

    rnd, found, n = random.Random(11), 0, 100
    for _ in range(n):
        item = [rnd.choice(WORDS) for _ in range(size)]
        text = item[:]
        for _ in range(int(share * size)):
            j = rnd.randrange(len(text))
            text[j : j + 1] = rnd.choice([[], ["new"], [text[j], "in"]])
        items = decontaminate.Items([1], [words_of([" ".join(item).encode()]).hash])
        found += bool(decontaminate.near_items(words_of([(prose(30, rnd) + " " + " ".join(text) + " " + prose(30, rnd)).encode()]), items))
    assert found >= 0.97 * n


def test_short_items_null_ids_and_repeated_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "lone"), (3, " "), (4, "one two three four five six seven"), (5, None), (None, "x y")], "item_id bigint, text string")
    rows = [(1, "so alpha beta gamma it is"), (1, "so alpha beta gamma it is"), (2, "alpha beta delta"), (None, "a lone word"), (3, "one two three four five six other"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id bigint, text string, start int, row string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["n_edits"], r["start"], r["end"]) for r in rows_of(decontaminate.leaks(docs, bench)))
    assert got == [(0, 2, 0, 1, 2), (1, 1, 0, 1, 4), (1, 1, 0, 1, 4)]
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in rows_of(kept)) == [2, 3, 4, 5]


def test_nearest_is_the_least_edit_distance_to_any_part():
    import numpy as np

    def brute(a, b):
        return min(edit(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rnd = random.Random(2)
    for _ in range(60):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(1, 7))] for _ in range(2))
        d, i, j = decontaminate.nearest(np.array(a), np.array(b))
        assert d == brute(a, b) == edit(a, b[i:j])


def test_language_of_texts(spark, docs, nothing):
    text = {"xx": "abra kadabra alakazam ", "yy": "lorem ipsum dolor sit "}
    rows = [(i, text["xx" if i % 2 else "yy"] * 5, "xx" if i % 2 else "yy") for i in range(60)] + [(100, None, "xx"), (101, "123 !?", "yy"), (102, "", None)]
    got = {r["doc_id"]: r for r in rows_of(language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))}
    assert all(got[i]["lang_pred"] == ("xx" if i % 2 else "yy") and 0 <= got[i]["score"] <= 1 for i in range(60))
    assert all(got[i]["lang_pred"] == "und" for i in (100, 101, 102))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language.identify(nothing).count() == 0 and language.identify(docs).count() == docs.count()


@pytest.mark.parametrize("dense", [1 << 23, 0])
def test_cross_parsing_counts_longest_matches(dense):
    rnd = random.Random(4)
    training = {x: "".join(rnd.choice("abcd ") for _ in range(300)) for x in ("p", "q")} | {"one": "a" * 40}
    parser = language.CrossParser(training, dense)
    texts = ["".join(rnd.choice("abcdez ") for _ in range(rnd.randrange(0, 3000))) for _ in range(20)] + ["a" * 5000, "z" * 2000, "", (training["p"] * 9)[7:]]
    got = parser.counts(texts)
    for i, t in enumerate(texts):
        for k, x in enumerate(parser.langs):
            at = n = 0
            while at < len(t):
                size = 1
                while at + size < len(t) and t[at : at + size + 1] in training[x]:
                    size += 1
                at, n = at + size, n + 1
            assert got[k, i] == n


def test_a_large_alphabet_and_held_out_accuracy(spark):
    rnd = random.Random(12)
    letters = {"zh": [chr(0x4E00 + i) for i in range(5000)], "ko": [chr(0xAC00 + i) for i in range(5000)], "en": list("abcdefghij")}
    rows = [(i, "".join(rnd.choice(letters[x]) if rnd.random() < 0.8 else " " for _ in range(rnd.randrange(60, 400))), x) for i, x in enumerate(["zh", "ko", "en"] * 60)]
    got = {r["doc_id"]: r for r in rows_of(language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))}
    right = [got[i]["lang_pred"] == x for i, _, x in rows if got[i]["held_out"]]
    assert sum(right) >= 0.95 * len(right) > 20


def test_held_out_accuracy_of_language_and_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in rows_of(language.identify(docs)) if r["held_out"] and r["lang_pred"] != "und" and truth[r["doc_id"]]]
    assert sum(right) >= 0.98 * len(right) > 100
    toxic = {r["doc_id"]: r["toxic"] for r in labels.where("toxic is not null").collect()}
    scored = [(toxic[r["doc_id"]], r["predicted"]) for r in rows_of(toxicity.score_documents(docs, toxicity.train(docs, labels))) if r["held_out"] and r["doc_id"] in toxic]
    caught = [p for y, p in scored if y == 1]
    assert sum(caught) >= 0.7 * len(caught) and sum(p for y, p in scored if y == 0) <= 0.02 * len(scored)


def test_toxicity_learns_and_takes_awkward_rows(spark, docs, nothing):
    rnd = random.Random(6)
    rows = [(i, prose(60, rnd) + (" vile scoundrel " if i % 4 == 0 else " ") + prose(20, rnd), 1 if i % 4 == 0 else 0) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    labels = frame.select("doc_id", F.col("y").alias("toxic")).unionByName(spark.createDataFrame([(None, 1), (5000, None)], "doc_id bigint, toxic int"))
    model = toxicity.train(frame, labels)
    got = {r["doc_id"]: r for r in rows_of(toxicity.score_documents(frame, model))}
    right = [got[i]["predicted"] == y for i, _, y in rows if got[i]["held_out"]]
    assert sum(right) >= 0.95 * len(right)
    odd = rows_of(toxicity.score_documents(docs, model))
    kept = toxicity.without_toxic(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in rows_of(kept)} == {i for i in got if not got[i]["predicted"]}
    assert toxicity.without_toxic(docs, model).count() > 0 and toxicity.without_toxic(nothing, model).count() == 0
    assert len(odd) == len(TEXTS) + 3 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_documents(nothing, toxicity.train(nothing, labels.limit(0))).count() == 0


def test_fingerprints_and_edited_texts(docs, nothing):
    order = sorted(((i, t or "") for i, t in TEXTS.items()), reverse=True)
    got = rows_of(fingerprint.compare_edited(docs.where("doc_id is not null").dropDuplicates(["doc_id"])))
    assert len(got) == len(TEXTS) and fingerprint.compare_edited(nothing).count() == 0 and fingerprint.compare_edited(docs).count() == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    for k, (i, t) in enumerate(order):
        nxt, r = order[(k + 1) % len(order)][1], by_id[i]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        one, two = (fingerprint.BottomK.of(x) for x in (t, edited))
        assert r["fingerprint"] == str(one) and r["near_edited"] == one.resemblance(two)
        assert str(fingerprint.BottomK.parse(r["fingerprint"])) == r["fingerprint"]
    assert by_id[4]["fingerprint"] == by_id[5]["fingerprint"]


def test_sketches_merge_and_estimate():
    a, b = prose(3000), prose(3000)
    one, two, both = (fingerprint.BottomK.of(x) for x in (a, b, a + " " + b))
    merged = one.merge(two)
    assert abs(merged.distinct() / both.distinct() - 1) < 0.05 and one.resemblance(one) == 1 and one.containment(both) > 0.7


def test_small_sketches_are_exact():
    rnd = random.Random(14)
    for _ in range(200):
        words = [rnd.choice("abc") for _ in range(rnd.randrange(0, 60))]
        a, b = words[: rnd.randrange(0, 60)], words[rnd.randrange(0, 30) :]
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in (a, b)]
        one, two = (fingerprint.BottomK.of(" ".join(w)) for w in (a, b))
        both = sets[0] | sets[1]
        assert one.distinct() == len(sets[0]) and one.merge(two).distinct() == len(both) < 64
        assert one.resemblance(two) == (len(sets[0] & sets[1]) / len(both) if both else 1.0)
        assert one.containment(two) == pytest.approx(len(sets[0] & sets[1]) / len(sets[0]) if sets[0] else 1.0)


def test_sketches_estimate_large_sets():
    rnd, off = random.Random(15), []
    for _ in range(40):
        words = [str(rnd.randrange(10**6)) for _ in range(1500)]
        cut = rnd.randrange(100, 1400)
        one, two = fingerprint.BottomK.of(" ".join(words)), fingerprint.BottomK.of(" ".join(words[:cut]))
        off.append(abs(one.resemblance(two) - (cut - 4) / 1496))
        assert abs(one.distinct() / 1496 - 1) < 0.5
    assert sum(off) / len(off) < 0.06


@pytest.mark.parametrize("name", ["op1_suffix_array_dedup", "op2_secret_scan", "op7_minhash_dedup", "op9_substring_dedup"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from detlake.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, folder).select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_stages_on_awkward_rows(spark, tmp_path, docs, nothing):
    import corpus_pipeline

    spark.createDataFrame([(1, "no such passage in here at all today")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in TEXTS], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = docs.withColumns({"row": F.lit(1), "_id": F.lit("x"), "predicted": F.lit(2), "root": F.lit(3)})
    all_rows = more.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, str(tmp_path))
        assert got.columns == more.columns, name
        ids = [r["doc_id"] for r in got.select("doc_id").collect()]
        assert None in ids and {1, 2, 3, 13} <= set(ids) and (len(ids) == all_rows) == (name != "near_duplicates"), name
        empty = stage(spark, nothing, str(tmp_path))
        assert empty.count() == 0 and empty.columns == nothing.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, more, str(tmp_path))
    assert last.count() == all_rows and corpus_pipeline.STAGES[-1][1](spark, nothing, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    bench = prose(40)
    extra = [(50, "lead " + bench + " tail", "en", "s", 1), (51, prose(90), "en", "s", 1)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in TEXTS.items()] + extra
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in TEXTS], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in rows_of(corpus_pipeline.run(spark, str(tmp_path)))}
    assert set(got) == (set(TEXTS) | {51}) - {5, 7, 8} and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.values())
