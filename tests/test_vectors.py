import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlift.operators.embedding import embed_texts
from ledgerlift.operators.search import _group_cells, _side_rows, knn_join, nearest, semantic_search
from ledgerlift.plans.pipeline import search_store
from ledgerlift.sources.layers import read_vectors, write_vectors

DIM = 8


def brute_force(queries, corpus, k, metric):
    found = []
    for q_id, q in queries:
        ranked = []
        for c_id, c in corpus:
            a, b = np.asarray(q, "f4").astype("f8"), np.asarray(c, "f4").astype("f8")
            if metric == "l2":
                d = float(np.sqrt(((a - b) ** 2).sum()))
            else:
                n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                d = None if n == 0 else float(1 - (a * b).sum() / n)
            ranked.append((d is None, d or 0.0, c_id, d))
        found += [(q_id, c_id, d, i + 1) for i, (_, _, c_id, d) in enumerate(sorted(ranked)[:k])]
    return sorted(found)


@pytest.fixture(scope="module")
def points():
    """A third of the corpus is one vector; some rows are zero, some nearly equal."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((400, DIM)).astype("f4")
    base[::3] = base[0]
    base[5] = base[8] = 0.0
    base[11] = base[10] + np.float32(1e-6)
    corpus = [(f"id{i:03}", [float(x) for x in v]) for i, v in enumerate(base)]
    probes = np.vstack([base[[0, 3, 5, 10, 50]], rng.standard_normal((60, DIM))]).astype("f4")
    queries = [(i, [float(x) for x in v]) for i, v in enumerate(probes)]
    return queries, corpus


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("limits", [{}, {"queries_per_block": 16, "rows_per_part": 50}])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_knn_join_equals_brute_force(spark, points, metric, limits, k):
    queries, corpus = points
    q = spark.createDataFrame(queries, "q long, v array<float>")
    c = spark.createDataFrame(corpus, "c string, w array<float>").repartition(5)
    found = knn_join(q, c, k, query_id="q", id="c", query_vector="v", vector="w", dim=DIM, metric=metric, **limits)
    got = sorted(tuple(r) for r in found.collect())
    expected = brute_force(queries, corpus, k, metric)
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in expected]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in expected], abs=1e-9)


def test_knn_join_with_nothing_to_compare(spark, points):
    queries, corpus = points
    q = spark.createDataFrame(queries, "q long, v array<float>")
    c = spark.createDataFrame(corpus, "c string, w array<float>")
    names = {"query_id": "q", "id": "c", "query_vector": "v", "vector": "w", "dim": DIM}
    assert knn_join(q.where("false"), c, 3, **names).collect() == []
    assert knn_join(q, c.where("false"), 3, **names).collect() == []


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("limits", [{}, {"queries_per_block": 2, "rows_per_part": 2}])
def test_knn_join_ranks_what_has_no_distance_last(spark, metric, limits):
    nan, one = float("nan"), [1.0] * DIM
    corpus = [(1, [nan] + one[1:]), (2, one), (3, [None] + one[1:]), (4, [float("inf")] * DIM), (5, [2.0] * DIM), (5, one)]
    queries = [(1, one), (2, [nan] * DIM), (3, [None] * DIM), (4, [1.0, 2.0] * (DIM // 2))]
    q = spark.createDataFrame(queries, "q long, v array<float>")
    c = spark.createDataFrame(corpus, "c long, w array<float>")
    found = knn_join(q, c, 4, query_id="q", id="c", query_vector="v", vector="w", dim=DIM, metric=metric, **limits)
    by_query = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        by_query.setdefault(r["q"], []).append((r["c"], r["distance"] is not None and r["distance"] == r["distance"]))
    assert by_query[1][:3] == [(2, True), (5, True), (5, True)] and by_query[1][3] == (1, False)
    assert [i for i, _ in by_query[4]] == [2, 5, 5, 1]
    assert by_query[2] == by_query[3] == [(1, False), (2, False), (3, False), (4, False)]


@pytest.mark.parametrize("limits", [{}, {"queries_per_block": 1}])
def test_wrong_width_is_an_error(spark, limits):
    q = spark.createDataFrame([(1, [0.0] * DIM), (2, [0.0] * DIM)], "q long, v array<float>")
    c = spark.createDataFrame([(1, [0.0] * DIM), (2, [0.0] * (DIM // 2)), (3, [0.0] * (DIM // 2))], "c long, w array<float>")
    with pytest.raises(PySparkException, match="vector length is not 8: 4"):
        knn_join(q, c, 1, query_id="q", id="c", query_vector="v", vector="w", dim=DIM, **limits).collect()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_equals_brute_force(spark, points, metric):
    queries, corpus = points
    c = spark.createDataFrame(corpus, "c string, w array<float>")
    for number, query in (queries[0], queries[3], queries[20]):
        found = nearest(c, query, 7, id="c", vector="w", metric=metric).select("c").collect()
        assert [r["c"] for r in found] == [r[1] for r in sorted(brute_force([(number, query)], corpus, 7, metric), key=lambda r: r[3])]


def test_search_drops_null_text_after_the_limit(spark):
    df = spark.createDataFrame(
        [(None, "t", [0.0, 0.0]), ("a", "t", [1.0, 0.0]), ("b", "t", [2.0, 0.0])], "text string, table_name string, vector array<float>"
    )
    assert [r["text"] for r in semantic_search(df, [0.0, 0.0], 2).collect()] == ["a"]


def test_equal_distances_are_ties_by_text(spark):
    """The cells are added up in another order, which leaves distances a bit apart."""
    rows = [("b", "t", [0.7, 0.2, 0.9]), ("a", "t", [0.7, 0.9, 0.2])]
    df = spark.createDataFrame(rows, "text string, table_name string, vector array<double>")
    found = semantic_search(df, [0.0, 0.0, 0.0], 2, digits=6).collect()
    assert [r["text"] for r in found] == ["a", "b"] and len({r["distance"] for r in found}) == 1


def test_default_embedding(spark):
    df = spark.createDataFrame([("Late, late ROUTE",), ("route late late",), ("",), (None,), ("Größe",)], "text string")
    late, same, empty, null, word = (np.asarray(r["vector"]) for r in embed_texts(df, dim=64).collect())
    assert late.shape == (64,) and np.array_equal(late, same)
    assert sorted(late[late > 0]) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert not empty.any() and not null.any() and word.max() == 1.0


def test_given_embedder(spark):
    def embedder(texts):
        return [[len(t), t.count("a")] for t in texts]

    df = spark.createDataFrame([("banana",), ("x",)], "text string")
    assert [r["vector"] for r in embed_texts(df, embedder=embedder, dim=2).collect()] == [[6.0, 3.0], [1.0, 0.0]]
    with pytest.raises(PySparkException, match="expected .*, 3"):
        embed_texts(df, embedder=embedder, dim=3).collect()


def test_vector_table(spark, tmp_path):
    path = str(tmp_path / "vectors")
    assert read_vectors(spark, path).collect() == []
    df = spark.createDataFrame([("a", "t", [1.0, 2.0]), ("b", "t", [0.0, 1.0])], "text string, table_name string, vector array<float>")
    write_vectors(df, path, dim=2)
    write_vectors(df.where("text = 'a'"), path, dim=2)
    assert read_vectors(spark, path).count() == 1
    with pytest.raises(PySparkException):
        write_vectors(df, str(tmp_path / "bad"), dim=3)

    def broken(texts):
        raise RuntimeError("no model")

    assert search_store(spark, "a", path, 3, embedder=broken, dim=2).collect() == []
    found = search_store(spark, "a", path, 3, embedder=lambda texts: [[1.0, 2.0]] * len(texts), dim=2)
    assert [(r["text"], r["distance"]) for r in found.collect()] == [("a", 0.0)]
    assert found.schema == search_store(spark, "a", str(tmp_path / "none"), 3, dim=2).schema
    assert found.where(F.col("distance") > 0).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_far_cells_are_not_compared(spark, metric):
    """On clustered vectors a small part of all pairs is compared, and the result is that of all."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, DIM)) * 20
    corpus = [(i, (centres[i % 40] + rng.standard_normal(DIM) * 0.1).tolist()) for i in range(4000)]
    queries = [(i, (centres[i % 7] + rng.standard_normal(DIM) * 0.1).tolist()) for i in range(50)]
    q = spark.createDataFrame(queries, "q long, v array<double>")
    c = spark.createDataFrame(corpus, "c long, w array<double>")
    counts = {}
    found = knn_join(q, c, 5, query_id="q", id="c", query_vector="v", vector="w", dim=DIM, metric=metric, counts=counts).collect()
    vectors = {i: np.array(v) for i, v in corpus}
    for i, v in queries[:10]:
        a, m = np.array(v), np.array(list(vectors.values()))
        d = np.sqrt(((m - a) ** 2).sum(axis=1)) if metric == "l2" else 1 - (m @ a) / np.linalg.norm(m, axis=1) / np.linalg.norm(a)
        assert [r["c"] for r in sorted((r for r in found if r["q"] == i), key=lambda r: r["rank"])] == list(np.argsort(d, kind="stable")[:5])
    assert counts["all"] == 200_000 and counts["compared"] < 0.2 * counts["all"]


def test_vectors_are_sent_to_few_parts_however_small_the_limits():
    rows = np.random.default_rng(3).integers(0, 200, 1024)
    rows[7] = 20_000
    per_part = _side_rows(200, int(rows.sum()), 64)
    first, n_parts, cells = _group_cells(rows, per_part)
    assert len(cells) <= 2 * 16 and n_parts[7] > 1
    for cell in np.flatnonzero(rows):
        assert [p for p, own in enumerate(cells) if cell in own] == list(range(first[cell], first[cell] + n_parts[cell]))
    assert all(rows[own].sum() <= per_part for own in cells if 7 not in own)
    assert _side_rows(20_000, 10**9, 768) * 768 * 4 <= 32 * 1024**2


def test_embedding_counts_a_bounded_number_of_rows_at_once(spark, monkeypatch):
    """A batch of many rows is counted in pieces, with the vectors of single rows."""
    from ledgerlift.operators import embedding

    sizes = []
    real = embedding.np.bincount
    monkeypatch.setattr(embedding.np, "bincount", lambda a, minlength: sizes.append(minlength) or real(a, minlength=minlength))
    monkeypatch.setattr(embedding, "_ROWS_AT_ONCE", 2, raising=False)
    monkeypatch.setattr(embedding.F, "arrow_udf", lambda _: lambda f: f)
    words = embedding.pa.array([["a", "b", "a"], [], ["b"], ["c", "a"], ["a"]])
    found = embedding._bucket_vectors(8)(words).to_pylist()
    assert max(sizes) == 2 * 8 and len(found) == 5
    assert found[4] == embedding._bucket_vectors(8)(embedding.pa.array([["a"]])).to_pylist()[0]
    assert not any(found[1]) and found[2].index(1.0) != found[4].index(1.0)
