"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import heapq
import math
import random
import uuid
from collections import Counter
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from ledgerlift.llm import chat, exact_dedup, grid_join, jaccard_join, line_dedup, packing, pieces, sharding, suffix_dedup
from ledgerlift.llm import toxicity
from ledgerlift.llm.common import Scratch, min_labels, stored
from ledgerlift.llm.queries import QUERIES
from ledgerlift.sources.shared import work_dir
from pyspark.sql import functions as F

# Names that the operators use inside.
CLASHES = (
    "k", "row", "h", "p", "rank", "ends", "shard", "slot", "block", "digest", "key", "features", "score", "margin",
    "prediction", "n_lines", "kept", "spans", "hits", "copies", "marked", "ids", "starts", "run_id", "first", "length",
    "part", "cluster", "label", "toxic", "group", "size", "class", "weight", "_text_hash",
)
STAGE_CLASHES = (*CLASHES, "first_id", "first_k", "n_bytes", "predicted", "kept_sha256", "n_removed", "carried", "document")
LONG = " ".join(f"word{i} of{i % 7}" for i in range(30_000))
LINES = "first line here\nsecond line here\nthird line here\nfourth line here"
ROWS = [
    (1, LONG), (2, LONG), (3, None), (3, None), (None, ""), (None, "x"), (4, ""), (5, "   \n\t "), (6, "a b c"),
    (6, "a b c"), (7, LINES), (8, f"new start\n{LINES}"), (9, "é" * 500), (10, "é" * 500 + "tail"), (11, "a  b\tc"),
    (None, LINES), (12, "<|im_end|> \\ <\\| \0"),
]


@pytest.fixture(scope="module")
def dirty(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    df = df.withColumns({c: F.lit(f"{c} column") for c in CLASHES})
    return df.withColumns({
        "source": F.when(F.col("doc_id") % 3 == 0, "s"), "lang": F.lit(None).cast("string"), "n_chars": F.length("text"),
    }).cache()


@pytest.fixture
def empty(dirty):
    return dirty.where("1 = 0")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_sharding(dirty, empty):
    done = sharding.shard_rows(dirty, 24)
    assert set(done.columns) == set(dirty.columns)
    assert rows_of(done, "doc_id", "text", "k") == rows_of(dirty, "doc_id", "text", "k")
    assert len({r.shard for r in done.collect()}) == len(ROWS)
    again = sharding.shard_rows(dirty, 3, rows_per_block=2).collect()
    assert sorted((r.shard, r.slot) for r in again) == [(s, i) for s, n in ((0, 6), (1, 6), (2, 5)) for i in range(n)]
    assert sharding.shard_rows(empty, 24).collect() == []


def test_communication_matrix():
    matrix = sharding.communication_matrix([5, 0, 9, 2], [4, 4, 8], 1)
    assert [sum(r) for r in matrix] == [5, 0, 9, 2] and [sum(c) for c in zip(*matrix, strict=True)] == [4, 4, 8]
    big = sharding.communication_matrix([3 * 10**9, 10**9], [2 * 10**9] * 2, 1)
    assert [sum(r) for r in big] == [3 * 10**9, 10**9] and abs(big[0][0] - 1.5e9) < 1e6


def test_toxicity(spark, dirty, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    for model in (
        toxicity.fit_toxicity(dirty, labels, trees=2), toxicity.fit_toxicity(dirty, labels.where("1 = 0")),
        toxicity.fit_toxicity(empty, labels),
    ):
        scored = model.score(dirty, dirty.columns)
        assert rows_of(scored, "doc_id", "text", "k") == rows_of(dirty, "doc_id", "text", "k")
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.collect())
        assert model.score(empty, ["doc_id"]).collect() == []


def test_toxic_word_joined_to_a_longer_one():
    lexicon = {"idiot": 3.0, "moro*": 2.5}
    for token, hits in {
        "idiot.However": (1.0, 0.0, 3.0), "everybody-idiot": (1.0, 0.0, 3.0), "morons/wonderful": (0.0, 1.0, 2.5),
        "idiot/moronic": (1.0, 1.0, 3.0), "However.wonderful": (0.0, 0.0, 0.0), "1d1ot": (0.0, 0.0, 3.0), "...": (0.0, 0.0, 0.0),
    }.items():
        assert toxicity._traits(token, lexicon)[:3] == hits, token


def test_line_dedup(dirty, empty):
    done = line_dedup.dedupe_lines(dirty)
    assert [c for c in dirty.columns if c != "n_lines"] + ["n_lines", "n_removed"] == done.columns
    found = rows_of(done, "doc_id", "text", "n_removed")
    left = {(i, t): (t, 0) for i, t in ROWS}
    left[(7, LINES)], left[(8, f"new start\n{LINES}")] = ("", 4), ("new start", 4)  # the null id comes first
    assert found == sorted(((i, *left[(i, t)]) for i, t in ROWS), key=str)
    assert line_dedup.dedupe_lines(empty).collect() == []


def test_packing(dirty, empty):
    own = dict(length=F.octet_length("text"), source=F.col("source"), cluster=F.col("text"))
    done = packing.pack_documents(dirty, **own, capacity=1000).collect()
    assert sum(r.length for r in done) == sum(len((t or "").encode()) for _, t in ROWS)
    assert sum(r.length == 0 and r.bin_id is None for r in done) == sum(not t for _, t in ROWS)
    bins = {}
    for r in done:
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.length
    assert max(bins.values()) <= 1000
    assert packing.pack_documents(empty, **own).collect() == []


def test_packing_of_repeated_rows(spark):
    """Copies of one row are dealt over all groups, each once, and share no bin."""
    docs = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1, "other")], "doc_id bigint, text string"))
    done = packing.pack_documents(
        docs, length=F.octet_length("text"), source=F.lit("s"), cluster=F.col("text"), capacity=100, per_group=100
    ).collect()
    assert sorted(r.doc_id for r in done) == [1] + [7] * 10_000
    assert len({r.bin_id for r in done}) == len(done)
    groups = Counter(r.bin_id >> 40 for r in done)
    assert len(groups) == 101 and max(groups.values()) < 200


def test_scratch(spark, tmp_path):
    work = Scratch(spark)
    with pytest.raises(ValueError), work:
        kept = stored(work.stored(spark.range(5), "gone"), "stays")
        assert Path(work.paths[0].removeprefix("file:")).exists()
        raise ValueError
    assert not Path(work.paths[0].removeprefix("file:")).exists() and kept.count() == 5


def test_pack():
    """Against trying every bin, tightest first."""
    items = sorted(((i * 7919 % 97 + 1, f"s{i % 5}" if i % 3 else None, f"c{i % 11}") for i in range(300)), reverse=True,
                   key=lambda x: x[0])
    bins, expected = [], []
    for length, source, cluster in items:
        fits = [
            (b["left"], n) for n, b in enumerate(bins)
            if b["left"] >= length and source not in b["s"] - {None} and cluster not in b["c"]
        ]
        if fits:
            number = min(fits)[1]
        else:
            number = len(bins)
            bins.append({"left": 250, "s": set(), "c": set()})
        own = bins[number]
        expected.append((number, 250 - own["left"]))
        own["left"] -= length
        own["s"].add(source)
        own["c"].add(cluster)
    assert packing.pack(items, 250) == expected


def test_jaccard_join(dirty, empty):
    found = {(r.doc_id, r.k): r for r in jaccard_join.near_duplicates(dirty).collect()}
    assert len(jaccard_join.near_duplicates(dirty).collect()) == len(ROWS)
    links = sorted((i, r.group_id, r.n_links) for (i, _), r in found.items() if r.n_links and i)
    # Split at white space, "a b c" and "a  b\tc" are equal.
    assert [x for x in links if x[0] in (1, 2, 6, 11)] == [(1, 1, 1), (2, 1, 1), (6, 6, 2), (11, 6, 2)]
    assert all(r.n_links == 0 and r.group_id == i for (i, _), r in found.items() if i in (3, 4, 5))
    assert jaccard_join.near_duplicates(empty).collect() == []


def test_hot_bucket(spark):
    """A group larger than a block, in which each text differs from the next by one word."""
    words = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1:])) for i in range(60)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), block=8).collect()
    assert {(r.group_id, r.n_links) for r in found} == {(0, 59)}


def test_grid_join(spark, empty):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [0.9, 0.1]), (4, None), (5, []),
        (6, [0.0, 0.0]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]),
        (11, [0.0, -5e300]), (12, [0.0, -1e-300]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({
        c: F.lit("x") for c in ("digest", "unit", "dim", "size", "first", "class")
    })
    found = rows_of(grid_join.vector_links(df), "vec_id", "n_links", "component_id")
    assert found == sorted(
        [(i, 4, 1) for i in (1, 2, 3, 3, None)] + [(11, 1, 11), (12, 1, 11)] + [(i, 0, i) for i in (4, 5, 6, 7, 8, 9, 10)],
        key=str,
    )
    assert grid_join.vector_links(df.where("1 = 0")).collect() == []


def test_suffix_dedup(dirty, empty):
    done = suffix_dedup.remove_repeats(dirty)
    assert sorted(done.columns) == sorted({*dirty.columns, "n_bytes", "spans", "kept_sha256"})
    found = rows_of(done, "doc_id", "text", "kept_sha256")
    repeated = {"é" * 500: "", "é" * 500 + "tail": "tail", LONG: ""}
    left = [(i, repeated.get(t, t)) for i, t in ROWS]
    assert found == sorted(((i, t, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in left), key=str)
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_suffix_groups_are_split(spark, monkeypatch):
    """Many different neighbours of one passage: shorter than a window, just as long, and longer."""
    passage = "".join(chr(97 + i * 7919 % 26) for i in range(440))
    texts = []
    for i in range(40):
        size = (300, 400, 440)[i % 3]
        flank = hashlib.sha512(str(i).encode()).hexdigest() * 4
        texts.append((i, flank + passage[:size] + flank[::-1]))
    monkeypatch.setattr(suffix_dedup, "GROUP_SEGMENTS", 3)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.remove_repeats(df).collect()}
    counts = {}
    for _, t in texts:
        for i in range(len(t) - 399):
            counts[t[i:i + 400]] = counts.get(t[i:i + 400], 0) + 1
    for i, t in texts:
        gone = sorted({j for s in range(len(t) - 399) if counts[t[s:s + 400]] > 1 for j in range(s, s + 400)})
        assert found[i] == ([(gone[0], gone[-1] + 1)] if gone else []), i


def test_suffix_groups_stay_whole(spark):
    """Passages between different neighbours, where the join of groups turns into a broadcast at run time."""
    some = random.Random(11)
    texts = []
    for i in range(120):
        passage = some.randbytes(220).hex()
        texts += [(2 * i + j, some.randbytes(200).hex() + passage + some.randbytes(200).hex()) for j in (0, 1)]
    settings = {
        # Below what the plan expects of a count by group, above what it turns out to be.
        "spark.sql.autoBroadcastJoinThreshold": "12k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(8)
        found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.remove_repeats(df).collect()}
    finally:
        for key in settings:
            spark.conf.unset(key)
    counts = Counter(t[i:i + 400] for _, t in texts for i in range(len(t) - 399))
    for i, t in texts:
        starts = [s for s in range(len(t) - 399) if counts[t[s:s + 400]] > 1]
        assert found[i] == [(starts[0], starts[-1] + 400)], i


def test_suffix_index_takes_possible_pairs(monkeypatch):
    """Of segments that share their anchor, those with the same bytes beside it are indexed, the others not."""
    some = random.Random(5)
    rows, pairs = [], []
    for g in (1, 2):
        gram, part = some.randbytes(16), some.randbytes(190)
        blobs = [some.randbytes(384) + gram + some.randbytes(384) for _ in range(60)]
        blobs += [some.randbytes(20 * i) + part[:20] + part + gram + part + part[:9] + some.randbytes(20 * i) for i in (1, 2)]
        blobs += [gram + some.randbytes(384), some.randbytes(384) + gram]
        anchor = int(suffix_dedup.gram_hashes(gram, 0, 16).view("i8")[0])
        rows += [(anchor, g, b"%d %d" % (g, i), 1, blob) for i, blob in enumerate(blobs) for _ in range(2)]
        pairs += blobs[60:62]
    batch = pa.RecordBatch.from_pylist([
        dict(zip(("anchor", "group", "segment", "weight", "blob"), r, strict=True)) for r in rows])
    seen = []

    def noted(own, weights, length, find=suffix_dedup.repeated_starts):
        seen.extend(own)
        return find(own, weights, length)

    monkeypatch.setattr(suffix_dedup, "repeated_starts", noted)
    batches = [batch.slice(i, 50) for i in range(0, len(batch), 50)]
    found = [tuple(r.values()) for b in suffix_dedup._index_groups(400)(iter(batches)) for r in b.to_pylist()]
    assert seen == pairs
    assert sorted(found) == [(b"%d %d" % (g, 59 + i), 20 * i, 20 * i + 25) for g in (1, 2) for i in (1, 2)]


def test_suffix_dedup_of_few_letters(spark):
    """Texts in which grams repeat much oftener than whole windows."""
    some = random.Random(7)
    stock = ["".join(some.choices("ab", k=some.choice((9, 17, 26, 41)))) for _ in range(24)]
    texts = [(i, "".join(some.choice(stock) for _ in range(some.randrange(1, 9)))) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {r.doc_id: r.kept_sha256 for r in suffix_dedup.remove_repeats(df, min_bytes=40).collect()}
    counts = Counter(t[i:i + 40] for _, t in texts for i in range(len(t) - 39))
    for i, t in texts:
        gone = {j for s in range(len(t) - 39) if counts[t[s:s + 40]] > 1 for j in range(s, s + 40)}
        assert found[i] == hashlib.sha256("".join(c for j, c in enumerate(t) if j not in gone).encode()).hexdigest(), i


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, None, "x"), (2, None, "user", "q"),
        (2, 5, "assistant", "<|im_end|>\n<|im_start|>assistant\n<\\|"), (3, 0, "sys\n\\n<|im_end|>", "text\n"),
        (4, 0, "user", ""), (4, 1, "assistant", "word " * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("turns", "segments", "problem", "formatted")})
    done = chat.format_conversations(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"),
                                                chat.trained_text(F.col("segments")).alias("trained"))
    found = {r.conv_id: r for r in done.collect()}
    for conv, r in found.items():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.trained == "".join(t for role, t in own if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
    assert {c: r.problem for c, r in found.items()} == {
        1: "turn 2: assistant", None: "turn 0: ", 2: None, 3: "turn 0: sys\n\\n<|im_end|>", 4: None,
    }
    assert chat.format_conversations(df.where("1 = 0")).collect() == []


def test_pieces(dirty, empty):
    own = pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    done = pieces.decode(pieces.encode_nbest(dirty, own, n=3, keep=("doc_id", "text", "k")), own)
    for r in done.collect():
        assert r.decoded == (r.text or "") and len(r.alternatives) <= 2
        scores = [r.score, *(a.score for a in r.alternatives)]
        assert scores == sorted(scores, reverse=True)
        for a in r.alternatives:
            ids = list(r.ids)
            for c in sorted(a.changes, key=lambda c: -c.at):
                ids[c.at:c.at + c.drop] = c.ids
            assert ids != list(r.ids) and pieces.decode_ids(ids, own) == r.text
    assert pieces.encode_nbest(empty, own).collect() == []
    assert pieces.encode_nbest(dirty.where("doc_id = 6"), own, n=1).first().alternatives == []


@pytest.mark.parametrize("size", [50, 3000, 100_000])
def test_pieces_of_long_units(size):
    """One unbroken unit, of one letter (nothing but ties) and of random letters, against lists of the best."""
    own = pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(size)
    for unit in ("a" * size, "ab" * (size // 2), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))):
        found = pieces.n_best(unit, own, 4)
        tops = [[0.0]]
        for arcs in pieces.arcs_of(unit, own)[1:]:
            tops.append(heapq.nlargest(4, (s + score for start, _, score in arcs for s in tops[start])))
        assert [s for s, _ in found] == pytest.approx(tops[-1], rel=1e-9)
        assert len({ids for _, ids in found}) == len(found) and all(pieces.decode_ids(ids, own) == unit for _, ids in found)
        _, ids, counts, best, gap = pieces.Viterbi(own).best([unit])
        assert best[0] == pytest.approx(tops[-1][0], rel=1e-9) and gap[0] == pytest.approx(tops[-1][0] - tops[-1][1], abs=1e-6 * size)
        assert pieces.decode_ids(ids.tolist(), own) == unit and counts[0] == len(ids)


def test_exact_dedup(spark, dirty, empty):
    def index():
        return exact_dedup.DigestIndex(spark, work_dir(spark, "index"), name=f"t{uuid.uuid4().hex}", buckets=4)

    found = rows_of(exact_dedup.dedupe_exact(dirty, index()), "doc_id", "keep_id", "group_size", "kept")
    assert [x for x in found if x[0] in (1, 2, 3, 4, 6, 11)] == sorted([
        (1, 1, 2, True), (2, 1, 2, False), (3, 3, 4, True), (3, 3, 4, True), (4, 3, 4, False), (6, 6, 3, True), (6, 6, 3, True),
        (11, 6, 3, False),
    ], key=str)
    assert exact_dedup.dedupe_exact(empty, index()).collect() == []


def test_index_outlives_batches(spark):
    path, name = work_dir(spark, "index"), f"t{uuid.uuid4().hex}"
    first = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id bigint, text string")
    second = spark.createDataFrame([(1, "a"), (7, "c"), (8, "c"), (6, "b")], "doc_id bigint, text string")
    exact_dedup.dedupe_exact(first, exact_dedup.DigestIndex(spark, path, name=name, buckets=4), batch=0)
    spark.sql(f"drop table {name}")  # the files stay
    index = exact_dedup.DigestIndex(spark, path, name=f"{name}x", buckets=4)
    found = rows_of(exact_dedup.dedupe_exact(second, index, batch=1), "doc_id", "keep_id", "group_size", "kept")
    assert found == [(1, 5, 1, False), (6, 6, 1, True), (7, 7, 2, True), (8, 7, 2, False)]
    index.append(second.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest")), 2)
    assert index.rows().count() == 3
    plan = index.candidates(second.select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id", "digest")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "LeftAnti" in text and text.count("Exchange hashpartitioning") == 1


def test_index_in_two_batches(spark):
    """The second half meets what the first left in the index, in the order in which it lies there."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id") % 300).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "t 5"), (None, "new")], "doc_id bigint, text string"))
    index = exact_dedup.DigestIndex(spark, work_dir(spark, "index"), name=f"t{uuid.uuid4().hex}", buckets=4)
    rows = exact_dedup.digests(docs)
    early, late = exact_dedup.halves(rows)
    assert early.agg(F.max("doc_id")).first()[0] < late.agg(F.min("doc_id")).first()[0]
    index.append(early, 0, "doc_id", "text_sha256")
    with exact_dedup.ordered_scans(spark):
        plan = index.candidates(late, "doc_id", "text_sha256")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Sort [digest" not in plan  # the index neither moves nor is sorted,
    assert plan.count("Sort [text_sha256") == 1 and plan.count("Exchange hashpartitioning") == 1  # the batch does
    index.append(late, 1, "doc_id", "text_sha256")
    assert {r.first_batch: r["count"] for r in index.rows().groupBy("first_batch").count().collect()} == {0: 300, 1: 1}
    found = rows_of(exact_dedup.resolved(rows, index), "doc_id", "keep_id", "group_size", "kept")
    size = Counter(i % 300 for i in range(1000))
    assert found == sorted(
        [(i, i % 300, size[i % 300] + (i % 300 == 5), i < 300) for i in range(1000)]
        + [(None, 5, size[5] + 1, False), (None, None, 1, True)], key=str)
    assert len(exact_dedup.halves(rows.where("doc_id is null"))) == 1


def test_index_follows_shuffle_partitions(spark, sf_dir, monkeypatch):
    """With more shuffle partitions than 64 a task of the write still has a bucket of its own, and nothing moves the index."""
    made, number = [], spark.conf.get("spark.sql.shuffle.partitions")
    start, deal = exact_dedup.DigestIndex.__init__, type(spark.range(0)).repartition

    def noted(self, *a, **b):
        start(self, *a, **b)
        made.append(self)

    monkeypatch.setattr(exact_dedup.DigestIndex, "__init__", noted)
    # As on a cluster that is told to deal out by keys to no fewer partitions than these.
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *c: deal(self, max(n, 80) if c else n, *c))
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        found = QUERIES["op10_exact_dedup"](spark, sf_dir)
        rows = spark.range(10).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
        plan = made[0].candidates(rows, "id", "digest")._jdf.queryExecution().executedPlan().toString()
        assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", number)
    assert len(made[0].rows().inputFiles()) <= 2 * made[0].buckets == 160
    assert plan.count("Exchange hashpartitioning") == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (50, 3)]
    found = dict(min_labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {**{i: 1 for i in [*range(1, 41), 50]}, 100: 100, 101: 100, 102: 100}


def test_pipeline_stages(spark, dirty, empty, tmp_path):
    spark.createDataFrame([(1, 0), (6, 1)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    more = {c: F.lit(f"{c} column") for c in STAGE_CLASHES}
    for docs in (dirty.withColumns(more), empty.withColumns(more)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            kept = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                assert all(r[c] == f"{c} column" for r in kept for c in STAGE_CLASHES)
                assert {(r["doc_id"], r["n_chars"], r["source"]) for r in kept} <= {
                    (i, None if t is None else len(t), "s" if i is not None and i % 3 == 0 else None) for i, t in ROWS}
