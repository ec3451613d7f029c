"""Spelling variants, periodic runs and window packing against brute force, and their edge cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlift.llm import periodic_runs, queries, spelling, window_packing

CLASHES = ("row", "runs", "n_words", "collapsed", "part", "rest", "rank", "ids", "full", "rows", "word", "n", "key", "id", "run", "h", "g", "words", "a", "p")
TOKENIZER = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
LONG = " ".join(f"word{i} of{i % 7}" for i in range(30_000))
ROWS = [
    (1, LONG), (2, LONG), (3, None), (3, None), (None, ""), (None, "x"), (4, ""), (5, "   \n\t "), (6, "a b c"), (6, "a b c"),
    (7, "b " * 9), (8, "a b a b a b a b"), (9, "é" * 5000), (10, "x y z\x1cw " * 5), (11, "\0 <|endoftext|>. İ. á, o'clock's"),
    (12, "naïveté Naïveté naïvete naïvetés NAÏVETÉ"),
]


@pytest.fixture(scope="module")
def dirty(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return df.withColumns({c: F.lit(f"{c} column") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def documents(sf_dir):
    return {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


# --- spelling ---------------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spellings(counts, factor=10):
    out = set()
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_op11(spark, sf_dir, documents):
    """Counting and slips by plain Python; near words of all words by brute force."""
    counts = Counter()
    for doc_id, text in documents.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    found = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.QUERIES["op11_spelling"](spark, sf_dir).collect()}
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    assert {r[0]: r[3] for r in found} == counts
    sample = {w for w in counts if zlib.crc32(w.encode()) % 8 == 0} | {r[0] for r in found if r[1]}
    for word, form, root, n, n_near, form_n in found:
        if word in sample:
            others = [v for k in (-1, 0, 1) for v in by_length[len(word) + k] if one_edit(word, v)]
            best = min(others, key=lambda v: (-counts[v], v), default=None)
            has = best is not None and counts[best] >= 10 * n
            assert (n_near, form, form_n) == (len(others), best if has else None, counts[best] if has else None)
            assert root == word or form
    assert any(r[1] for r in found)


@pytest.mark.parametrize("alphabet, size", [("ab", 4), ("abé", 7), ("abcd", 12)])
def test_spelling_is_whole(spark, alphabet, size):
    """Dense vocabularies, where every bucket is full: every edit at every place is found."""
    rng = random.Random(size)
    counts = {"".join(rng.choices(alphabet, k=rng.randint(size, size + 2))): rng.choice([1, 1, 2, 10, 100, 1000]) for _ in range(250)}
    for w in list(counts)[:60]:
        at = rng.randrange(len(w))
        for v in (w[:at] + w[at + 1:], w[:at] + "z" + w[at:], w[:at] + "z" + w[at + 1:], w + "y", "y" + w):
            if len(v) >= 4:
                counts.setdefault(v, rng.choice([1, 20, 400]))
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").withColumn("key", F.lit("x"))
    found = [tuple(r) for r in spelling.group_spellings(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(counts) and set(found) == spellings(counts)


def test_spelling_edges(spark, dirty):
    rows = [("straße", 5), ("straße", 6), (None, 4), ("abc", 9), ("strasse", None), ("", 1), ("strafe", 200), ("Strafe", 3000), ("strade", 200)]
    done = spelling.group_spellings(spark.createDataFrame(rows, "word string, n bigint"))
    assert {tuple(r) for r in done.select("word", "form", "root", "n", "n_near", "form_n").collect()} == {
        ("straße", "strade", "strade", 11, 2, 200), ("strafe", "Strafe", "Strafe", 200, 3, 3000), ("Strafe", None, "Strafe", 3000, 1, None),
        ("strade", None, "strade", 200, 2, None),
    }
    chain = [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaabbbb", 10**4), ("aabbbbb", 10**5)]
    done = spelling.group_spellings(spark.createDataFrame(chain, "word string, n bigint"))
    assert {r.root for r in done.collect()} == {"aabbbbb"}
    assert spelling.group_spellings(done.where("1 = 0")).collect() == []
    words = {r.word: r.n for r in spelling.count_words(dirty).collect()}
    assert words == {"naïveté": 2}
    assert {r.word: r.n for r in spelling.count_words(dirty, slip=1).collect()} == {}
    assert spelling.count_words(dirty.where("1 = 0")).collect() == []


# --- periodic runs ------------------------------------------------------------------------------------

def brute_runs(words):
    """Every stretch of equal neighbours at every lag, of smallest period."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i:i + length]
            smaller = any(own[p:] == own[:-p] for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        words = rng.choices(letters, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 4)):
            unit = rng.choices(letters, k=rng.randint(1, 9))
            size = rng.randint(3 * len(unit), 7 * len(unit))
            words += (unit * 8)[:size] + rng.choices(letters, k=rng.randint(0, 5))
        texts.append(words)
    texts += [list("a" * n) for n in range(12)] + [list("ab" * n) for n in range(9)] + [list("aab" * 4 + "aab" * 3 + "ab" * 8)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    texts += [list(fib[-1]), (rng.choices("abc", k=50) * 5)[:230], list("abab" * 20 + "ababa" * 20 + "ab" * 30)]
    codes = np.array([ord(w) for t in texts for w in t], np.int64)
    found = periodic_runs.find_runs(codes, np.array([len(t) for t in texts]))
    assert found == [brute_runs(t) for t in texts]


def test_op12(spark, sf_dir, documents):
    planted = 0
    found = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert found.keys() == documents.keys()
    for doc_id, text in documents.items():
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        names = {w: i for i, w in enumerate(words)}
        # Brute force up to a few thousand words; longer ones by the operator's own plain part on one segment.
        coded = [names[w] for w in words]
        runs = brute_runs(coded) if n <= 3000 else sorted(periodic_runs.scan_lags(np.array(coded), 4, 6), key=lambda r: (r[0], r[2]))
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        r = found[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (top or (None,) * 3)
        assert r.exponent_milli == (top and 1000 * top[1] // top[2])
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert planted > 10 and any(r.n_runs for r in found.values())


def test_runs_edges(dirty):
    done = periodic_runs.periodic_runs(dirty)
    assert sorted(done.columns) == sorted(dirty.columns)
    by_id = {}
    for r in done.collect():
        assert r.row == "row column" and r.rest == "rest column"
        by_id[r.doc_id] = ([tuple(x) for x in r.runs], r.n_words, r.collapsed)
    assert by_id[7] == ([(0, 9, 1)], 9, "b") and by_id[8] == ([(0, 8, 2)], 8, "a b")
    assert by_id[3] == by_id[4] == by_id[5] == ([], 0, "") and by_id[1] == ([], 60_000, LONG)
    assert by_id[10] == ([(0, 10, 2)], 10, "x y z\x1cw")
    assert done.count() == len(ROWS) and periodic_runs.periodic_runs(dirty.where("1 = 0")).collect() == []


def test_planting_on_texts_without_words(spark, tmp_path):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:30]
    rows = [(i, t) for i, t in zip(ids, [None, "", " \n", "a", "a b"] * 6, strict=True)] + [(None, "a b"), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).count() == 32


def test_long_runs_take_no_quadratic_time():
    rng = np.random.default_rng(0)
    unit = rng.integers(0, 50_000, 40_000)
    codes = np.concatenate([np.zeros(300_000, np.int64), np.tile(unit, 6)[:230_000], np.tile([1, 2, 3], 60_000)])
    found = periodic_runs.find_runs(codes, np.array([len(codes)]))[0]
    assert found == [(0, 300_000, 1), (300_000, 230_000, 40_000), (530_000, 180_000, 3)]


# --- window packing -----------------------------------------------------------------------------------

def check_packing(rows, texts, window, tokens=None):
    """Every id of every text in exactly one piece, sequences without gaps; returns the padding and all tokens."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids = tokens[doc_id] if tokens else None
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            if ids is not None:
                assert r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == own[0].doc_tokens
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding, sum(r.length for r in rows)


def test_op13(spark, sf_dir, documents):
    tokenizer = Tokenizer.from_str(TOKENIZER)
    tokens = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in documents.items()}
    rows = queries.QUERIES["op13_window_packing"](spark, sf_dir).collect()
    padding, total = check_packing(rows, documents, 4096, tokens)
    assert total == sum(map(len, tokens.values())) and padding < 0.01 * total


def test_packing_edges(spark, dirty):
    tokenizer = Tokenizer.from_str(TOKENIZER)
    done = window_packing.pack_windows(dirty, TOKENIZER, end=2, window=64, unit=4, depth=3).collect()
    expected = Counter()
    for i, t in ROWS:
        expected[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    total = Counter()
    for r in done:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        total[r.doc_id] += r.length
    assert total == expected
    assert window_packing.pack_windows(dirty.where("1 = 0"), TOKENIZER, end=2).collect() == []


def test_equal_lengths_over_many_tasks(spark):
    """Ranks within a length stay apart when a third of all rows has it and tasks count on their own."""
    rng = random.Random(3)
    texts = {i: "a " * (20 if i % 3 == 0 else rng.randint(0, 150)) for i in range(3000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(13)
    rows = window_packing.pack_windows(df, TOKENIZER, end=2, window=128, unit=1, depth=3, with_ids=False).collect()
    padding, total = check_packing(rows, texts, 128)
    assert padding == 0 and total == sum(t.count("a") + 1 for t in texts.values())


def test_encoder_keeps_case_where_it_counts(documents):
    """A tokenizer that does not lower-case gets its words as they are."""
    described = json.loads(TOKENIZER)
    described["normalizer"]["normalizers"] = [n for n in described["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    encoder = window_packing.WordEncoder(json.dumps(described))
    texts = [t for t in documents.values() if t][:40] + ["The END, the end. Été ÉTÉ!", "", "A a, B."]
    ids, counts = encoder.encode(pa.array(texts))
    expected = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_encoder_equals_whole_texts(documents):
    tokenizer = Tokenizer.from_str(TOKENIZER)
    texts = [t for _, t in ROWS if t is not None] + list(documents.values())[:60] + ["ÀÉ, ß. ǅ. ſ! ﬁ. ≠ é. 한국어. Ω. 12.5% -- ..."]
    encoder = window_packing.WordEncoder(TOKENIZER)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("total, depth", [(1, 1), (6, 2), (12, 3), (9, 4)])
def test_combinations(total, depth):
    def every(left, smallest, places):
        if left == 0:
            yield ()
        if places:
            for x in range(smallest, left + 1):
                yield from ((x, *rest) for rest in every(left - x, x, places - 1))

    found = [tuple(x for x in row if x) for row in window_packing.combinations(total, depth).tolist()]
    assert len(found) == len(set(found)) and set(found) == set(every(total, 1, depth))


def test_counts_solve_the_histogram():
    """A histogram made of known combinations is used up; at the optimum no combination lowers the squares."""
    rng = np.random.default_rng(1)
    parts = window_packing.combinations(32, 3)
    made = np.zeros(33, np.int64)
    for row in parts[rng.choice(len(parts), 12, replace=False)]:
        np.add.at(made, row[row > 0], int(rng.integers(50, 500)))
    rows, times = window_packing.solve_counts(parts, made)
    used = np.zeros(33)
    for row, n in zip(parts[rows], times, strict=True):
        np.add.at(used, row[row > 0], n)
    assert (times > 0).all() and np.abs(used - made)[1:].max() < 1e-3 * made.max()
    rough = rng.integers(0, 300, 33)
    rough[0] = 0
    rows, times = window_packing.solve_counts(parts, rough)
    used = np.zeros(33)
    for row, n in zip(parts[rows], times, strict=True):
        np.add.at(used, row[row > 0], n)
    gradient = (rough - used) * (np.arange(33) / 32) ** 2
    gradient[0] = 0
    assert gradient[parts].sum(axis=1).max() < 1e-4 * rough.max() and (times > 0).all()
