import math

from ledgerlift.operators.context import budget_context, context_text, context_lines
from ledgerlift.operators.insights import (
    insights_budget, insights_channel, insights_delivery, insights_material, insights_sales_org, insights_segment,
)


def texts(df):
    return [r["text"] for r in df.collect()]


MATERIAL = "material_id string, avg_margin_pct double, squeeze_count long, total_net_value_usd double"


def test_material(spark):
    df = spark.createDataFrame([("M1", 5.99, 3, 1234.5), ("M2", 6.0, 0, 1235.5), (None, None, None, None)], MATERIAL)
    assert texts(insights_material(df)) == [
        "M1 has an average margin of 6.0% with 3 squeeze orders and $1234 total revenue — critically below the 6% threshold.",
        "M2 has an average margin of 6.0% with 0 squeeze orders and $1236 total revenue.",
        " has an average margin of 0.0% with 0 squeeze orders and $0 total revenue — critically below the 6% threshold.",
    ]


def test_channel_org_segment(spark):
    df = spark.createDataFrame(
        [("D1", "S1", "Auto", "North", 12.25, 7, 2.5)],
        "distribution_channel string, sales_org string, industry string, region_group string, avg_margin_pct double, order_count long, total_net_value_usd double",
    )
    assert texts(insights_channel(df)) == ["The D1 channel has an average margin of 12.2% across 7 orders with $2 total revenue."]
    assert texts(insights_sales_org(df)) == ["Sales org S1 has an average margin of 12.2% across 7 orders."]
    assert texts(insights_segment(df)) == ["The Auto segment in North has an average margin of 12.2% with $2 revenue."]


def test_budget(spark):
    df = spark.createDataFrame(
        [("IT", "2024", 100000.0), ("HR", "2023", 100000.5), ("PR", None, 0.0), ("QA", "2022", -7.5), ("XX", "2021", math.nan)],
        "department string, fiscal_year string, total_variance double",
    )
    assert texts(insights_budget(df)) == [
        "The IT department is $100000 over budget in fiscal year 2024.",
        "The HR department is $100000 over budget in fiscal year 2023 — critical overspend.",
        "The PR department is $0 under budget in fiscal year .",
        "The QA department is $8 under budget in fiscal year 2022.",
        "The XX department is $NaN under budget in fiscal year 2021.",
    ]


def test_delivery(spark):
    df = spark.createDataFrame(
        [("R1", 5.0, 9, 10.0), ("R2", 5.5, 1, 0.5), ("R3", None, None, None)],
        "route string, avg_days_late double, delivery_count long, total_freight_cost double",
    )
    assert texts(insights_delivery(df)) == [
        "Route R1 averages 5 days late across 9 deliveries with $10 total freight cost.",
        "Route R2 averages 6 days late across 1 deliveries with $0 total freight cost — critical delay.",
        "Route R3 averages 0 days late across 0 deliveries with $0 total freight cost.",
    ]


BUDGET = "department string, fiscal_year string, total_budget double, total_actual_cost double, total_variance double"


def budget_lines(df):
    ordered = budget_context(df).orderBy("part", "rank", "tie_key")
    return context_text(ordered).splitlines()


def test_budget_blocks(spark):
    df = spark.createDataFrame(
        [("IT", "2023", 10.0, 12.5, 2.5), ("HR", "2024", 10.0, 19.999, 9.999), (None, "n/a", 5.0, 5.0, 0.0), ("PR", None, None, None, -3.125), ("XX", "1", 1.0, 1.0, math.nan)],
        BUDGET,
    )
    assert budget_lines(df) == [
        "OVER BUDGET (actual > planned — cost overrun, action required):",
        "  HR 2024: budget=$10.00 | actual=$20.00 | overrun=$10.00",
        "  IT 2023: budget=$10.00 | actual=$12.50 | overrun=$2.50",
        "",
        "UNDER BUDGET (actual < planned — savings, on track):",
        "  XX 1: budget=$1.00 | actual=$1.00 | savings=$0.00",
        "  ? 0: budget=$5.00 | actual=$5.00 | savings=$0.00",
        "  PR 0: budget=$0.00 | actual=$0.00 | savings=$3.12",
        "",
    ]


def test_budget_block_without_rows_has_no_heading(spark):
    df = spark.createDataFrame([("IT", "2023", 10.0, 8.0, -2.0)], BUDGET)
    assert budget_lines(df)[0].startswith("UNDER BUDGET") and len(budget_lines(df)) == 3


def test_context_line(spark):
    df = spark.createDataFrame(
        [("R1", None, 2.125, math.nan, 10.0, 3)],
        "route string, transport_type string, avg_days_late double, avg_freight_cost double, total_freight_cost double, delivery_count long",
    )
    assert context_lines(df, "delivery_performance").first()["line"] == (
        "avg_days_late: 2.12 | avg_freight_cost: N/A | delivery_count: 3 | route: R1 | total_freight_cost: 10 | transport_type: N/A"
    )


def test_context_text_never_cuts(spark):
    df = spark.range(20).selectExpr("cast(id as string) as line")
    try:
        context_text(df, max_lines=19)
    except ValueError as problem:
        assert "more than 19 lines" in str(problem)
    else:
        raise AssertionError("cut off silently")
