import math

import pytest
from pyspark.sql import functions as F

from ledgerlift.operators.gold import (
    GOLD_BUILDERS, GOLD_TABLES, MARGIN_TABLES, budget_variance, delivery_performance, margin_by_material,
    margin_by_segment, margins_by_cut, pick_cut,
)

SALES = (
    "order_id long, material_id string, distribution_channel string, sales_org string, industry string, "
    "region_group string, net_value double, estimated_cost double, netwr_usd double, estimated_cost_usd double, "
    "margin_pct double, is_margin_squeeze boolean"
)


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [
            (1, "M1", "D1", "S1", "Auto", "North", 100.0, 90.0, 108.0, 97.2, 10.0, False),
            (1, "M1", "D2", "S1", "Auto", None, 50.0, 49.0, 50.0, 49.0, 2.0, True),
            (None, "M2", "D1", "S2", None, None, 10.0, 5.0, 10.0, 5.0, math.nan, False),
            (3, "M2", "D1", "S2", "Chem", "South", 20.0, 5.0, 20.0, 5.0, 50.0, None),
            (4, None, None, "S2", "Chem", "South", None, None, None, None, None, None),
            (5, "M3", "D3", "S3", "Chem", "South", 1.0, 1.0, 1.0, 1.0, 6.0, False),
        ],
        SALES,
    )


def test_margin_by_material(sales):
    found = margin_by_material(sales).collect()
    assert [r["material_id"] for r in found] == [None, "M1", "M3", "M2"]  # null average first, NaN last
    unknown, m1, m3, m2 = found
    assert unknown["avg_margin_pct"] is None and unknown["total_net_value_usd"] == 0.0 and unknown["order_count"] == 1
    assert (m1["avg_margin_pct"], m1["min_margin_pct"], m1["max_margin_pct"]) == (6.0, 2.0, 10.0)
    assert (m1["total_net_value_usd"], m1["total_cost_usd"], m1["squeeze_count"], m1["order_count"]) == (150.0, 139.0, 1, 2)
    assert math.isnan(m2["avg_margin_pct"]) and (m2["min_margin_pct"], m2["max_margin_pct"]) == (50.0, 50.0)
    assert m2["order_count"] == 1 and m2["squeeze_count"] == 0


def test_basis_usd_adds_up_converted_amounts(sales):
    m1 = margin_by_material(sales, basis="usd").where("material_id = 'M1'").first()
    assert (m1["total_net_value_usd"], m1["total_cost_usd"]) == pytest.approx((158.0, 146.2))


def test_null_keys_are_groups_of_their_own(sales):
    found = {(r["industry"], r["region_group"]): r["order_count"] for r in margin_by_segment(sales).collect()}
    assert found == {("Auto", "North"): 1, ("Auto", None): 1, (None, None): 0, ("Chem", "South"): 3}


@pytest.mark.parametrize("name", MARGIN_TABLES)
@pytest.mark.parametrize("basis", ["local", "usd"])
def test_one_pass_gives_the_same_tables(sales, name, basis):
    separate, together = GOLD_BUILDERS[name](sales, basis), pick_cut(margins_by_cut(sales, basis), name)
    assert separate.columns == together.columns == [*GOLD_TABLES[name].keys, *GOLD_TABLES[name].measures]
    assert [str(r) for r in separate.collect()] == [str(r) for r in together.collect()]


def test_ties_are_ordered_by_key(spark):
    df = spark.createDataFrame(
        [("B", "2024", 5.0, 5.0, 0.0, 1), ("A", "2024", 5.0, 5.0, 0.0, 2), ("C", "2023", 1.0, 5.0, -4.0, None)],
        "department string, fiscal_year string, actual_cost double, budget_amount double, budget_variance double, order_id long",
    )
    found = budget_variance(df).collect()
    assert [(r["department"], r["total_variance"], r["record_count"]) for r in found] == [("C", -4.0, 0), ("A", 0.0, 1), ("B", 0.0, 1)]


def test_delivery_performance(spark, rows):
    df = spark.createDataFrame(
        [("R1", "AIR", 2.0, 10.0, 1), ("R1", "AIR", 4.0, None, 2), ("R1", "SEA", None, None, None)],
        "route string, transport_type string, days_late double, freight_cost_usd double, delivery_id long",
    )
    assert rows(delivery_performance(df)) == [("R1", "SEA", None, None, 0.0, 0), ("R1", "AIR", 3.0, 10.0, 10.0, 2)]


def test_totals_do_not_depend_on_the_order_of_rows(spark):
    rows = [("R", "T", 0.0, v, float(i)) for i, v in enumerate([1e15, *[0.05] * 1000, -1e15, *[0.1] * 10])]
    delivery = spark.createDataFrame(rows, "route string, transport_type string, days_late double, freight_cost_usd double, i double")
    delivery = delivery.withColumn("delivery_id", F.col("i").cast("long"))
    for order in (F.col("i"), F.col("i").desc(), F.col("freight_cost_usd")):
        one = delivery.coalesce(1).sortWithinPartitions(order)
        assert delivery_performance(one).first()["total_freight_cost"] == pytest.approx(51.0, abs=1e-9)


@pytest.mark.parametrize("value", [math.inf, -math.inf, math.nan])
def test_totals_keep_what_is_no_number(spark, value):
    rows = [("R", "T", 0.0, v, 1) for v in (1.5, value, None)]
    delivery = spark.createDataFrame(rows, "route string, transport_type string, days_late double, freight_cost_usd double, delivery_id long")
    assert str(delivery_performance(delivery).first()["total_freight_cost"]) == str(value)
