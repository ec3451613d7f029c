"""CSV reading keeps every cell or fails."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlift.schemas import ContractError
from ledgerlift.sources.bronze import csv_options, extract_headers, land_bronze, read_bronze
from ledgerlift.sources.quoted import end_state, quoted_records


def read(spark, tmp_path, text, **options):
    (tmp_path / "x.csv").write_text(text)
    return read_bronze(spark, str(tmp_path / "x.csv"), **options)


def test_short_records_are_filled(spark, tmp_path):
    df = read(spark, tmp_path, 'a,b,c\n1,"x ""y"", z",3\n2\n3,,\n4,"",5,,\n')
    assert sorted(map(tuple, df.collect())) == [("1", 'x "y", z', "3"), ("2", None, None), ("3", None, None), ("4", "", "5")]
    assert df.count() == 4 and df.select("b").where("b is null").count() == 2


def test_surplus_cells_are_an_error(spark, tmp_path):
    df = read(spark, tmp_path, "a,b,c\n1,2,3\n1,a,b,EXTRA,MORE\n")
    for wanted in (df, df.select("a"), df.groupBy("b").count()):
        with pytest.raises(PySparkException, match="more cells than the header"):
            wanted.collect()
    with pytest.raises(PySparkException, match="more cells than the header"):
        df.count()
    with pytest.raises(PySparkException, match="more cells than the header"):
        land_bronze(spark, str(tmp_path / "x.csv"), str(tmp_path / "bronze"))


def test_line_breaks_in_quotes(spark, tmp_path):
    text = 'a,b,c\n1,"two\nlines",x\n2,y,z\n'
    with pytest.raises(PySparkException, match="a quote is not closed"):
        read(spark, tmp_path, text).collect()
    assert sorted(map(tuple, read(spark, tmp_path, text, multiline=True).collect())) == [("1", "two\nlines", "x"), ("2", "y", "z")]
    name = land_bronze(spark, str(tmp_path / "x.csv"), str(tmp_path / "bronze"), multiline=True)
    assert read_bronze(spark, str(tmp_path / "bronze" / name)).count() == 2


def test_surplus_cells_in_multiline(spark, tmp_path):
    with pytest.raises(PySparkException, match="more cells than the header"):
        read(spark, tmp_path, 'a,b\n1,"two\nlines",x\n', multiline=True).collect()


def test_header_bytes(spark, tmp_path):
    (tmp_path / "old.csv").write_bytes(b"A,B\r1,2\r")
    (tmp_path / "odd.csv").write_bytes(b"A\xff,B\n1,2\n")
    found = sorted((r.file.rsplit("/", 1)[1], r.header) for r in extract_headers(spark, str(tmp_path)).collect())
    assert found == [("old.csv", "A"), ("old.csv", "B")]
    (tmp_path / "none.csv").write_bytes(b"x" * (3 << 20))
    with pytest.raises(PySparkException, match="no line break in the first"):
        extract_headers(spark, str(tmp_path)).collect()


# --- line breaks in quotes, files split ---------------------------------------------------------------

@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "997b")
    spark.conf.set("spark.sql.files.openCostInBytes", "997b")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


CELLS = ["", "plain", "two\nlines", "a,b", 'say ""hi""', "\n\n", "x\r\ny", "é\n\"\"\n,", 'open""', "\n", ",", "long " * 40 + "\n" + "tail " * 30]


def quoted_file(seed, rows, end="\n"):
    rng = random.Random(seed)
    lines = ['id,"first\ncell",last']
    for i in range(rows):
        cells = [rng.choice(CELLS) for _ in range(2)]
        # A quote within an unquoted cell is a character like any other.
        lines.append(",".join([str(i), *(f'"{c}"' if c or rng.random() < 0.5 else rng.choice(["", '5" pipe', "a\"b"]) for c in cells)]))
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + (end if seed % 2 else "")


@pytest.mark.parametrize("seed", [2, 3])
def test_split_reading_equals_one_task(spark, tmp_path, small_splits, seed):
    end = "\r\n" if seed == 3 else "\n"
    for n in range(2):
        (tmp_path / f"{n}.csv").write_bytes(quoted_file(10 * n + seed, 70, end).encode())
    path = str(tmp_path)
    one_task = spark.read.options(**csv_options(multiline=True), lineSep=end).csv(path)
    assert one_task.rdd.getNumPartitions() <= 2 and spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 6
    found = read_bronze(spark, path, multiline=True, with_position=True)
    assert sorted(map(str, found.drop("_pos").collect())) == sorted(map(str, one_task.collect()))
    for file in "01":
        own = found.where(F.col("_pos.file_path").endswith(f"/{file}.csv")).orderBy("_pos").select("id").collect()
        assert [int(r["id"]) for r in own] == list(range(70))


def test_a_quote_that_stays_open_is_an_error(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text("a,b\n" + '1,"2\n' + "3,4\n" * 200)
    with pytest.raises(ValueError, match="a quote is not closed"):
        list(quoted_records(spark, str(tmp_path / "x.csv"), max_record_bytes=500).collect())
    (tmp_path / "y.csv").write_text("a,c\n1,2\n")
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ContractError, match="differ in their header"):
        read_bronze(spark, str(tmp_path), multiline=True)


@pytest.mark.parametrize("line, outside, inside", [
    ("", False, True), ("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""', True, False), ('"a"""', False, False),
    ('x,"', True, False), ('",""', True, False), ('a"",b', False, True), ('"a" b,"c', True, True), ('""', False, True), ('"",",', True, False),
])
def test_end_state(line, outside, inside):
    assert (end_state(line, False), end_state(line, True)) == (outside, inside)
