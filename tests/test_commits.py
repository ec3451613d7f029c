"""Publishing by several writers at a time, and by writers that die."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException

from ledgerlift.schemas import REQUIRED_TYPES
from ledgerlift.sources.commits import CommitLog, Conflict, create_if_absent
from ledgerlift.sources.layers import (
    confirm_mapping, current_run, drop_runs, load_mapping, publish, read_vectors, run_path, save_mapping, write_vectors,
)

VECTORS = "text string, table_name string, vector array<float>"


def test_a_name_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "log" / "x.json")
    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda i: create_if_absent(spark, path, f"content {i}" * 100), range(64)))
    assert sum(won) == 1
    assert (tmp_path / "log" / "x.json").read_text() == f"content {won.index(True)}" * 100
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["x.json"]


def test_writers_at_a_time_get_numbers_of_their_own(spark, tmp_path):
    folder = str(tmp_path / "silver")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: publish(spark, folder, f"run{i}"), range(16)))
    assert sorted(numbers) == list(range(1, 17))
    assert current_run(spark, folder) == f"run{numbers.index(16)}"
    listed = [json.loads(c)["run_id"] for _, c in CommitLog(spark, f"{folder}/published").entries()]
    assert listed == [f"run{numbers.index(n)}" for n in range(1, 17)]


def test_an_entry_that_was_never_finished_is_passed_over(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.entries() == [] and log.last() is None
    assert log.add("a") == 1
    (tmp_path / "log" / "000000000002.json").write_text("")  # a writer died here
    (tmp_path / "log" / ".aside").write_text("half")
    assert log.last() == (1, "a")
    assert log.add("b", after=1) == 3 and log.entries() == [(1, "a"), (3, "b")]
    with pytest.raises(Conflict):
        log.add("c", after=1)
    with pytest.raises(ValueError, match="content"):
        log.add("")


def test_a_failed_vector_build_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "vectors")
    old = spark.createDataFrame([("a", "t", [1.0, 2.0])], VECTORS)
    first = write_vectors(old, path, dim=2)
    reader = read_vectors(spark, path)
    with pytest.raises(PySparkException):
        write_vectors(old.union(spark.createDataFrame([("b", "t", [1.0])], VECTORS)), path, dim=2)
    assert current_run(spark, path) == first and read_vectors(spark, path).count() == 1
    # A build that died before it was published is not seen.
    old.write.parquet(run_path(path, "dead", "vectors"))
    assert current_run(spark, path) == first
    second = write_vectors(old.union(old), path, dim=2)
    assert read_vectors(spark, path).count() == 2 and reader.count() == 1 and read_vectors(spark, path, first).count() == 1
    assert drop_runs(spark, path, keep=1) == [first] and read_vectors(spark, path).count() == 2
    assert second == current_run(spark, path)


def test_reviewers_at_a_time_lose_nothing(spark, tmp_path):
    config = str(tmp_path / "config")
    with ThreadPoolExecutor(5) as pool:
        versions = list(pool.map(lambda t: confirm_mapping(spark, config, t, f"{t}.csv", [("H", "order_id")]), REQUIRED_TYPES))
    assert sorted(versions) == list(range(1, len(REQUIRED_TYPES) + 1))
    assert sorted(r["data_type"] for r in load_mapping(spark, config).collect()) == sorted(REQUIRED_TYPES)
    with pytest.raises(Conflict):
        save_mapping(load_mapping(spark, config), config, after=1)
    (tmp_path / "config" / "field_mapping.versions" / "000000000009.json").write_text("")
    assert load_mapping(spark, config).count() == len(REQUIRED_TYPES)
