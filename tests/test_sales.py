import math

import pytest
from pyspark.sql import Observation

from ledgerlift.operators.sales import add_margins, conform, dedupe_first, enrich_sales, equi_join
from ledgerlift.schemas import ContractError
from ledgerlift.sources.bronze import read_bronze


def test_dedupe_keeps_the_first_row_whole(spark, rows):
    df = spark.createDataFrame(
        [("a", None, "late", 3), ("a", "x", None, 1), ("b", "y", "q", 2), (None, "n1", "z", 5), (None, "n2", "z", 4)],
        "k string, v string, w string, pos long",
    )
    assert sorted(rows(dedupe_first(df, "k", "pos")), key=str) == [("a", "x", None), ("b", "y", "q"), (None, "n2", "z")]


def test_dedupe_follows_file_order_over_files_and_splits(spark, tmp_path):
    for part in range(3):
        lines = [f"K{i % 50},{part}-{i}" for i in range(4000)]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(["key,val", *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = read_bronze(spark, str(tmp_path), with_position=True)
        assert df.rdd.getNumPartitions() > 3
        found = dedupe_first(df, "key").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["key"]: r["val"] for r in found} == {f"K{i}": f"0-{i}" for i in range(50)}


def test_join_renames_clashes_and_keeps_column_order(spark, rows):
    left = spark.createDataFrame([("USD", 1, "S1"), ("EUR", None, "S2")], "currency string, id long, sales_org string")
    right = spark.createDataFrame([(1, "GBP", "S9"), (None, "JPY", "S8")], "id long, Currency string, sales_org string")
    joined = equi_join(left, right, "id", "left")
    assert joined.columns == ["currency", "id", "sales_org", "Currency_right", "sales_org_right"]
    assert sorted(rows(joined)) == [("EUR", None, "S2", None, None), ("USD", 1, "S1", "GBP", "S9")]


def test_join_refuses_keys_of_different_type(spark):
    with pytest.raises(ContractError, match="id is bigint on one side, string on the other"):
        equi_join(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([("1",)], "id string"), "id", "inner")


def test_conform_turns_unreadable_numbers_into_null(spark, rows):
    df = spark.createDataFrame([("001", "1.5"), ("002", "n/a"), ("003", None)], "order_id string, net_value string")
    assert rows(conform(df)) == [("001", 1.5), ("002", None), ("003", None)]


def test_margins_on_edge_amounts(spark):
    df = spark.createDataFrame(
        [
            (1, None, 5.0, "EUR", "MAT-01"),   # null amount counts as zero
            (2, 100.0, None, None, None),      # null currency is USD
            (3, 100.0, 50.0, "eur", "MAT-01"),  # codes are case-sensitive
            (4, 0.0, 1.0, "USD", "MAT-02"),
            (5, -0.0, 1.0, "USD", "MAT-02"),
            (6, math.nan, 1.0, "USD", "MAT-01"),
            (7, -100.0, 50.0, "GBP", "MAT-01"),
        ],
        "order_id long, net_value double, estimated_cost double, currency string, material_id string",
    )
    found = {r["order_id"]: r for r in add_margins(df).collect()}
    assert (found[1]["netwr_usd"], found[1]["margin_pct"], found[1]["is_mat01_squeeze"]) == (0.0, 0.0, True)
    assert (found[2]["netwr_usd"], found[2]["estimated_cost_usd"], found[2]["margin_pct"]) == (100.0, 0.0, 100.0)
    assert found[2]["is_mat01_squeeze"] is False
    assert (found[3]["netwr_usd"], found[3]["margin_pct"]) == (100.0, 50.0)
    assert found[4]["margin_pct"] == found[5]["margin_pct"] == 0.0 and found[4]["is_margin_squeeze"]
    assert math.isnan(found[6]["margin_pct"]) and found[6]["is_margin_squeeze"] is False
    assert found[7]["margin_pct"] == pytest.approx(150.0)


def test_enrich_sales(spark):
    header = spark.createDataFrame(
        [(1, "c1", "EUR", "D1", "S1"), (2, "c9", "USD", "D2", "S1"), (3, "c1", "CHF", "D1", "S2"), (4, None, "USD", "D1", "S1")],
        "order_id long, customer_id string, currency string, distribution_channel string, sales_org string",
    )
    items = spark.createDataFrame(
        [(1, "MAT-01", 100.0, 97.0), (1, "MAT-02", 50.0, 20.0), (2, "MAT-01", 10.0, 1.0), (3, "MAT-03", 1.0, 0.5),
         (4, None, 1.0, 0.5), (5, "MAT-01", 1.0, 0.5), (None, "MAT-01", 1.0, 0.5)],
        "order_id long, material_id string, net_value double, estimated_cost double",
    )
    customer = spark.createDataFrame([("c1", "Auto", "North", "DE")], "customer_id string, industry string, region_group string, currency string")
    material = spark.createDataFrame([("MAT-01", "bolt")], "material_id string, material_description string")
    observe = {step: Observation() for step in ("items", "customer", "material", "sales")}
    sales = enrich_sales(header, items, customer, material, observe=observe)
    found = {(r["order_id"], r["material_id"]): r for r in sales.collect()}
    assert set(found) == {(1, "MAT-01"), (1, "MAT-02"), (2, "MAT-01"), (3, "MAT-03"), (4, None)}
    assert found[1, "MAT-01"]["industry"] == "Auto" and found[2, "MAT-01"]["industry"] is None
    assert found[1, "MAT-01"]["currency"] == "EUR" and found[1, "MAT-01"]["currency_right"] == "DE"
    assert found[1, "MAT-01"]["material_description"] == "bolt" and found[1, "MAT-02"]["material_description"] is None
    assert found[1, "MAT-01"]["is_mat01_squeeze"] and not found[2, "MAT-01"]["is_mat01_squeeze"]
    assert [observe[s].get["rows"] for s in ("items", "customer", "material", "sales")] == [5, 5, 5, 5]
    assert observe["sales"].get["unknown_currency_rows"] == 1


def test_enrich_sales_names_missing_columns(spark):
    empty = spark.createDataFrame([], "order_id long")
    with pytest.raises(ContractError, match="sales_header lacks column.*customer_id, currency"):
        enrich_sales(empty, empty, empty)


def test_customers_meet_headers_before_items(spark):
    """A customer table too large for a broadcast moves the headers, not their items, and gives the same rows."""
    header = spark.createDataFrame(
        [(1, 7, "EUR", "web", "S1", "h"), (2, None, "USD", "web", "S1", "h"), (3, 9, None, "shop", "S2", None), (4, 8, "GBP", "web", "S1", "h")],
        "order_id long, customer_id long, currency string, distribution_channel string, sales_org string, note string")
    items = spark.createDataFrame(
        [(1, "MAT-01", 10.0, 9.8, "i"), (1, "MAT-02", 5.0, 1.0, None), (2, "MAT-01", 0.0, 0.0, "i"), (3, None, None, 2.0, "i"), (5, "X", 1.0, 1.0, "i")],
        "order_id long, material_id string, net_value double, estimated_cost double, Industry string")
    customer = spark.createDataFrame([(7, "Tools", "East", "c"), (8, "Wood", "West", "c")],
                                     "customer_id long, industry string, region_group string, Note string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = enrich_sales(header, items, customer)
        step_by_step = enrich_sales(header, items, customer, observe={"items": Observation()})
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.columns == step_by_step.columns and {"industry_right", "Note_right"} <= set(joined.columns)
        assert sorted(joined.collect(), key=str) == sorted(step_by_step.collect(), key=str) != []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.index("[order_id") < text.index("Inner") < text.index("LeftOuter")  # the customers' join is the lower one
