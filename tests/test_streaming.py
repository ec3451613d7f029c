import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ledgerlift.operators.sales import dedupe_first
from ledgerlift.sources.bronze import land_bronze, read_bronze
from ledgerlift.sources.commits import Conflict
from ledgerlift.streaming import landing
from ledgerlift.streaming.landing import compact_landed, drop_gathered, land_bronze_stream


def test_every_file_is_landed_once(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out.parquet"), str(tmp_path / "cp")
    source.mkdir()
    (source / "1.csv").write_text("id,v\n001,a\n002,b\n")
    (source / "2.csv").write_text("id,v\n003,c\n")

    def land(**options):
        query = land_bronze_stream(spark, str(source), target, checkpoint, **options)
        query.awaitTermination()
        return sorted((r["id"], r["v"]) for r in read_bronze(spark, target).collect())

    assert land(max_files_per_batch=1) == [("001", "a"), ("002", "b"), ("003", "c")]
    assert sorted(p.name for p in (tmp_path / "out.parquet").iterdir() if p.is_dir()) == ["ledgerlift_batch=0", "ledgerlift_batch=1"]
    assert land() == [("001", "a"), ("002", "b"), ("003", "c")]
    (source / "3.csv").write_text("id,v\n001,later\n")
    assert land() == [("001", "a"), ("001", "later"), ("002", "b"), ("003", "c")]

    landed = read_bronze(spark, target, with_position=True)
    first = dedupe_first(landed.select("id", "v", "_pos"), "id").collect()
    assert {r["id"]: r["v"] for r in first} == {"001": "a", "002": "b", "003": "c"}


def test_stream_and_batch_land_the_same_table(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.csv").write_text('id, batch ,"note"\n001,B7,"two, cells"\n002,B8\n')
    land_bronze_stream(spark, str(source), str(tmp_path / "s.parquet"), str(tmp_path / "cp")).awaitTermination()
    name = land_bronze(spark, str(source / "1.csv"), str(tmp_path / "bronze"))
    streamed, landed = read_bronze(spark, str(tmp_path / "s.parquet")), read_bronze(spark, str(tmp_path / "bronze" / name))
    assert streamed.columns == landed.columns == ["id", "batch", "note"]
    assert sorted(streamed.collect()) == sorted(landed.collect()) == [("001", "B7", "two, cells"), ("002", "B8", None)]


def test_stream_refuses_records_that_lose_data(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.csv").write_text("id,v\n1,a,EXTRA\n")
    query = land_bronze_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    with pytest.raises(StreamingQueryException, match="more cells"):
        query.awaitTermination()


def test_small_files_are_gathered(spark, tmp_path, monkeypatch):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out.parquet"), str(tmp_path / "cp")
    source.mkdir()

    def land(first, last):
        for i in range(first, last):
            (source / f"{i}.csv").write_text(f"id,v\n{i:03},a{i}\n{i:03},b{i}\n")
        land_bronze_stream(spark, str(source), target, checkpoint, max_files_per_batch=1).awaitTermination()

    def found():
        return sorted((r["id"], r["v"]) for r in read_bronze(spark, target).collect())

    def expected(n):
        return [(f"{i:03}", f"{x}{i}") for i in range(n) for x in "ab"]

    land(0, 1)
    assert compact_landed(spark, target) is None  # the newest batch stays
    land(1, 6)
    reader = read_bronze(spark, target)
    before = reader.count()
    assert compact_landed(spark, target) == 4 and compact_landed(spark, target) is None
    assert found() == expected(6) and reader.count() == before == 12
    files = list((tmp_path / "out.parquet.compacted").glob("*/part-*"))
    assert len(files) == 1 and read_bronze(spark, target).select(F.input_file_name()).distinct().count() == 2
    first = dedupe_first(read_bronze(spark, target, with_position=True), "id").collect()
    assert {r["id"]: r["v"] for r in first} == {f"{i:03}": f"a{i}" for i in range(6)}

    # The newest batch repeated after a failure replaces itself; a compaction that dies lists nothing.
    again = spark.read.parquet(f"{target}/ledgerlift_batch=5")
    again.write.parquet(f"{target}.compacted/dead")
    spark.createDataFrame(again.collect(), again.schema).write.mode("overwrite").parquet(f"{target}/ledgerlift_batch=5")
    assert found() == expected(6)
    land(6, 9)
    assert found() == expected(9)
    state = landing.compacted(spark, target)
    assert compact_landed(spark, target) == 7
    monkeypatch.setattr(landing, "compacted", lambda *_: state)
    with pytest.raises(Conflict):
        compact_landed(spark, target)
    monkeypatch.undo()
    assert found() == expected(9) and drop_gathered(spark, target) == 8 and found() == expected(9)
    land(9, 10)
    assert found() == expected(10)
