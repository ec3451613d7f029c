"""Registered queries: against their SQL twins, or a brute-force version on whole tables."""

import hashlib
import heapq
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest

from ledgerlift.llm.pieces import arcs_of, load_pieces, units_of
from ledgerlift.llm.queries import QUERIES, SQL
from tests.llm.brute import components, shingle_set

TABLES = ("documents", "embeddings", "labels", "conversations")


@pytest.fixture(scope="module")
def tables(sf_dir):
    return {t: pq.read_table(f"{sf_dir}/{t}.parquet").to_pylist() for t in TABLES}


@pytest.mark.parametrize("name", SQL)
def test_sql_twin(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    expected = connection.execute(SQL[name])
    names = [c[0] for c in expected.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    found = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(found, key=str) == sorted(expected.fetchall(), key=str)


def test_op1(spark, sf_dir, tables):
    rows = QUERIES["op1_sharding"](spark, sf_dir).collect()
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in tables["documents"]}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_op2(spark):
    """Accuracy on held-out labels at the size where there are enough of them."""
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf_dir).collect()}
    ids = pq.read_table(f"{sf_dir}/documents.parquet").column("doc_id").to_pylist()
    assert sorted(found) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    labels = [x for x in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist() if found[x["doc_id"]].held_out]
    right = [x["toxic"] == found[x["doc_id"]].predicted for x in labels]
    assert len(right) > 50 and sum(right) / len(right) > 0.9


def test_op4(spark, sf_dir, tables):
    documents = {d["doc_id"]: d for d in tables["documents"]}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_packing"](spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        bins[r.bin_id].append(r)
    assert set(pieces) == set(documents)
    for doc_id, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) == len(documents[doc_id]["text"].encode())
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 8192
        for key in ("source", "text"):
            held = [documents[r.doc_id][key] for r in own]
            assert len(set(held)) == len(held)


def test_op5(spark, sf_dir, tables):
    sets = {d["doc_id"]: shingle_set(d["text"]) for d in tables["documents"]}
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    degree = defaultdict(int)
    for pair in links:
        for x in pair:
            degree[x] += 1
    top = components(ids, links)
    found = {tuple(r) for r in QUERIES["op5_jaccard_join"](spark, sf_dir).collect()}
    assert links and found == {(i, top[i], degree[i]) for i in ids}


def test_op6(spark, sf_dir, tmp_path):
    """The table holds no linked vectors: copies with noise are added."""
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    rng = np.random.default_rng(0)
    for _ in range(300):
        near = np.array(rows[rng.integers(0, 40)]["embedding"])
        noise = rng.normal(size=len(near)) * rng.choice([0, 0.02, 0.05])
        rows.append({"vec_id": len(rows), "embedding": (near + noise).tolist(), "label": 0})
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "embeddings.parquet")
    vectors = {v["vec_id"]: np.array(v["embedding"], float) for v in rows}
    ids = sorted(vectors)
    m = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    close = np.triu(m @ m.T >= 0.9, 1)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close), strict=True)]
    degree = (close | close.T).sum(axis=1)
    top = components(ids, links)
    found = {tuple(r) for r in QUERIES["op6_grid_join"](spark, str(tmp_path)).collect()}
    assert links and found == {(i, int(degree[n]), top[i], top[i] == i) for n, i in enumerate(ids)}


def test_op7(spark, sf_dir, tables):
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in tables["documents"]}
    counts = defaultdict(int)
    for t in texts.values():
        for i in range(len(t) - 399):
            counts[t[i:i + 400]] += 1
    expected = set()
    for doc_id, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if counts[t[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        left = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        expected.add((doc_id, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
    assert {tuple(r) for r in QUERIES["op7_suffix_dedup"](spark, sf_dir).collect()} == expected
    assert any(r[2] and r[2] < r[1] for r in expected)


def test_op9(spark, sf_dir, tables):
    """The round trip, and the scores of all texts against a brute-force search of every unit."""
    own = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))

    def segmentations(unit):
        """All of them, best first, by dynamic programming over lists of the 4 best."""
        tops = [[(0.0, ())]]
        for arcs in arcs_of(unit, own)[1:]:
            tops.append(sorted(
                ((s + score, ids + more) for start, more, score in arcs for s, ids in tops[start]), reverse=True
            )[:4])
        return tops[-1]

    known = {}
    for r in QUERIES["op9_pieces"](spark, sf_dir).collect():
        text = tables["documents"][r.doc_id]["text"]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        best = [0.0]
        for unit in units_of(text):
            if unit not in known:
                known[unit] = [s for s, _ in segmentations(unit)]
            best = heapq.nlargest(4, (a + b for a in best for b in known[unit]))
        assert r.nbest_scores == pytest.approx(best, abs=1e-4)
