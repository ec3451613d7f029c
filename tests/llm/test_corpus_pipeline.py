"""Each stage against a brute-force version on its own input, and the whole run."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from ledgerlift.llm.common import stored
from tests.llm.brute import components, shingle_set


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(name, input rows, output rows) of every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        found[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()], docs.columns, out.columns)
        docs = out
    return found


def test_stages_are_those_dealt():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]


def test_columns_stay(stages):
    for name, (_, _, before, after) in list(stages.items())[:-1]:
        assert before == after, name


def test_toxicity(stages, spark, sf_dir):
    before, after, *_ = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    known = [r["doc_id"] for r in before if r["doc_id"] in labels]
    assert {r["text"] for r in after} <= {r["text"] for r in before}
    assert sum((i in kept) == (labels[i] == 0) for i in known) / len(known) > 0.9


def test_line_dedup(stages):
    before, after, *_ = stages["line dedup"]
    seen, expected = set(), {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        lines = r["text"].split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        gone = set()
        for j in range(len(solid) - 2):
            run = tuple(lines[i] for i in solid[j:j + 3])
            if run in seen:
                gone |= set(solid[j:j + 3])
            seen.add(run)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or left.strip():
            expected[r["doc_id"]] = left
    assert {r["doc_id"]: r["text"] for r in after} == expected


def test_near_dedup(stages):
    before, after, *_ = stages["n-gram Jaccard join"]
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in before}
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    top = components(ids, links)
    assert sorted(r["doc_id"] for r in after) == [i for i in ids if top[i] == i]


def without_passages(texts, size=corpus_pipeline.PASSAGE_BYTES, least=corpus_pipeline.PASSAGE_WORDS):
    """Brute force: runs of bytes of strings that stand twice go where they hold enough whole words."""
    data = {i: t.encode() for i, t in texts.items()}
    counts = Counter(t[i:i + size] for t in data.values() for i in range(len(t) - size + 1))
    expected = {}
    for doc_id, t in data.items():
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if counts[t[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        for run in re.finditer(b"\1+", bytes(gone)):
            words = sum(1 for w in re.finditer(rb"\S+", t) if run.start() <= w.start() and w.end() <= run.end())
            if words < least:
                gone[run.start():run.end()] = bytes(len(run.group()))
        left = bytes(x for x, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or left.strip():
            expected[doc_id] = left
    return expected


def test_suffix_dedup(stages):
    before, after, *_ = stages["suffix-array dedup"]
    assert {r["doc_id"]: r["text"] for r in after} == without_passages({r["doc_id"]: r["text"] for r in before})


def test_planted_passages(spark, sf_dir):
    """Passages of 51 words from 203 bytes on, on one line of documents that share nothing else."""
    rng = random.Random(1)

    def words(n, letters):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=letters)) for _ in range(n))

    passages = [words(51, n) for n in (3, 4, 5, 6)]
    assert [len(p) for p in passages] == [203, 254, 305, 356]
    planted = {2 * k + side: p for k, p in enumerate(passages) for side in (0, 1)}
    texts = {i: f"{words(90, 8)} {p} {words(90, 8)}" for i, p in planted.items()}
    short = words(50, 5)
    for i in range(20, 24):  # 50 words in common stay
        texts[i] = f"{words(80, 7)} {short} {words(80, 7)}"
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id bigint, text string, source string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left == without_passages(texts)
    assert all((planted[i] not in left[i]) if i in planted else left[i] == t for i, t in texts.items())


def test_packing(stages, spark, sf_dir):
    before, after, *_ = stages["best-fit packing"]
    length = defaultdict(int)
    for r in after:
        length[r["doc_id"]] += r["length"]
    assert length == {r["doc_id"]: len(r["text"].encode()) for r in before}
    assert {tuple(r.values()) for r in after} == {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()}
