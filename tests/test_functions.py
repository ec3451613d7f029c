import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.headers import header_names, normalize_header, strip_space
from ledgerlift.functions.money import is_margin_squeeze, is_unknown_currency, margin_pct, to_usd
from ledgerlift.functions.text import fmt_fixed, fmt_value
from ledgerlift.functions.vectors import check_dim, cosine_distance, l2_distance
from ledgerlift.schemas import SYNONYMS


def test_margin_pct(spark, rows):
    df = spark.createDataFrame(
        [(100.0, 94.0), (100.0, 98.0), (100.0, 72.0), (0.0, 50.0), (-0.0, 50.0), (100.0, 0.0)], "n double, c double"
    )
    found = [r[0] for r in rows(df.select(margin_pct(F.col("n"), F.col("c"))))]
    assert found == pytest.approx([6.0, 2.0, 28.0, 0.0, 0.0, 100.0])


def test_squeeze_is_strictly_below_the_limit(spark, rows):
    df = spark.createDataFrame(
        [(5.9,), (2.0,), (0.0,), (6.0,), (6.1,), (28.0,), (math.nan,)], "m double"
    )
    found = [r[0] for r in rows(df.select(is_margin_squeeze(F.col("m"))))]
    assert found == [True, True, True, False, False, False, False]


def test_squeeze_of_computed_margins(spark, rows):
    df = spark.createDataFrame([(100.0, 98.0), (100.0, 94.0)], "n double, c double")
    assert rows(df.select(is_margin_squeeze(margin_pct(F.col("n"), F.col("c"))))) == [(True,), (False,)]


def test_to_usd(spark, rows):
    df = spark.createDataFrame([("USD",), ("EUR",), ("GBP",), ("JPY",), ("eur",), (None,)], "c string")
    found = rows(df.select(to_usd(F.lit(100.0), F.col("c")), is_unknown_currency(F.col("c"))))
    assert [r[0] for r in found] == pytest.approx([100.0, 108.0, 127.0, 100.0, 100.0, 100.0])
    assert [r[1] for r in found] == [False, False, False, True, True, False]


def test_to_usd_with_given_rates(spark, rows):
    df = spark.createDataFrame([("JPY",), ("EUR",)], "c string")
    assert [r[0] for r in rows(df.select(to_usd(F.lit(100.0), F.col("c"), {"JPY": 0.5})))] == [50.0, 100.0]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fmt_fixed_rounds_the_exact_value(spark, digits):
    rng = random.Random(digits)
    values = [0.15, 0.25, 0.125, 2.5, 3.5, 1.005, 2.675, -0.04, 0.0, -0.0, 9.995, 999999.995, 1e15 + 0.5, -2.5]
    values += [rng.uniform(-1e3, 1e3) for _ in range(3000)]
    values += [rng.randint(-10**6, 10**6) / 1000 for _ in range(3000)]
    values += [rng.randint(0, 10**9) / 8 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", fmt_fixed(F.col("x"), digits).alias("text")).collect():
        assert row["text"] == f"{row['x']:.{digits}f}"


def test_fmt_fixed_without_a_number(spark, rows):
    df = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double")
    assert [r[0] for r in rows(df.select(fmt_fixed(F.col("x"), 1)))] == [None, "NaN", "inf", "-inf"]


def test_fmt_value(spark, rows):
    def shown(kind, *values):
        df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", kind)]))
        return [r[0] for r in rows(df.select(fmt_value(F.col("x"), kind)))]

    assert shown(T.DoubleType(), 3.0, 2.345, 0.125, -0.0, None, math.nan) == ["3", "2.35", "0.12", "0", "N/A", "N/A"]
    assert shown(T.LongType(), 7, None) == ["7", "N/A"]
    assert shown(T.StringType(), "2.50", "", None) == ["2.50", "", "N/A"]
    assert shown(T.BooleanType(), True, None) == ["true", "N/A"]


def test_normalize_header(spark, rows):
    df = spark.createDataFrame([("Order_Number",), ("ORDER-NUMBER",), ("  Größe (ÄB) 2 ",), ("!!!",)], "h string")
    assert [r[0] for r in rows(df.select(normalize_header(F.col("h"))))] == ["ordernumber", "ordernumber", "größeÄb2", ""]


def test_strip_space_knows_unicode_blanks(spark, rows):
    df = spark.createDataFrame([(" \t VBELN　",)], "h string")
    assert rows(df.select(strip_space(F.col("h")))) == [("VBELN",)]


@pytest.mark.parametrize("text, names", [
    ("\ufeffVBELN,KUNNR\r\n1,2", ["VBELN", "KUNNR"]),
    (' "Order Number" , ,MATNR,', ["Order Number", "MATNR"]),
    ('"a,b",c', ["a", "b", "c"]),
    ("", []),
    ("\nA,B", []),
])
def test_header_names(spark, rows, text, names):
    assert rows(spark.createDataFrame([(text,)], "t string").select(header_names(F.col("t")))) == [(names,)]


def test_synonyms_are_unambiguous():
    words = [w for synonyms in SYNONYMS.values() for w in synonyms]
    assert len(words) == len(set(words))
    assert all(w == "".join(c for c in w if c.isalnum()).lower() for w in words)


def test_distances(spark, rows):
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    assert rows(df.select(l2_distance(a, b), cosine_distance(a, b))) == [(5.0, 1.0), (1.0, None)]


def test_check_dim(spark, rows):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    assert rows(df.select(check_dim(F.col("v"), 2))) == [([1.0, 2.0],)]
    with pytest.raises(PySparkException, match="vector length is not 3: 2"):
        df.select(check_dim(F.col("v"), 3)).collect()
