import math

import pytest

from ledgerlift.operators.checks import (
    ChecksFailed, combine_reports, require_passed, validate_controlling, validate_delivery, validate_sales,
)

SALES = (
    "order_id string, customer_id string, material_id string, netwr_usd double, estimated_cost_usd double, "
    "margin_pct double, is_margin_squeeze boolean"
)
GOOD = {"order_id": "o", "customer_id": "c", "material_id": "m", "netwr_usd": 100.0, "estimated_cost_usd": 70.0,
        "margin_pct": 30.0, "is_margin_squeeze": False}


def failed(report):
    return sorted((r["name"], r["column"], r["bad_rows"]) for r in report.collect() if not r["passed"])


def sales_with(spark, **changes):
    rows = [tuple(GOOD.values())] * 4 + [tuple({**GOOD, **changes}.values())]
    return validate_sales(spark.createDataFrame(rows, SALES), min_rows=2, max_rows=10)


def test_good_sales_pass(spark):
    report = sales_with(spark)
    assert report.count() == 13 and failed(report) == []
    require_passed(combine_reports(sales=report))


@pytest.mark.parametrize("low, high, ok", [(5, 5, True), (6, 10, False), (1, 4, False), (5, None, True)])
def test_row_bounds(spark, low, high, ok):
    df = spark.createDataFrame([tuple(GOOD.values())] * 5, SALES)
    line = validate_sales(df, low, high).where("name = 'row_count_range'").first()
    assert line["passed"] is ok and line["bad_rows"] is None and line["message"].startswith("5 rows")


@pytest.mark.parametrize("changes, names", [
    ({"order_id": None}, {"join_key_no_nulls"}),
    ({"customer_id": None}, {"join_key_no_nulls"}),
    ({"material_id": None}, {"join_key_no_nulls"}),
    ({"netwr_usd": 0.0, "margin_pct": 0.0}, {"netwr_usd_positive"}),
    ({"netwr_usd": None}, {"netwr_usd_positive", "enrichment_col_no_nulls"}),
    ({"estimated_cost_usd": -1.0, "margin_pct": 101.0}, {"estimated_cost_usd_positive", "margin_pct_not_above_100"}),
    ({"margin_pct": 30.02}, {"margin_cross_validation"}),
    ({"margin_pct": None}, {"enrichment_col_no_nulls"}),
    ({"is_margin_squeeze": None}, {"enrichment_col_no_nulls"}),
])
def test_each_check_fails_on_its_fixture(spark, changes, names):
    report = sales_with(spark, **changes)
    assert {f[0] for f in failed(report)} == names
    with pytest.raises(ChecksFailed, match=next(iter(names))):
        require_passed(combine_reports(sales=report))


@pytest.mark.parametrize("changes", [
    {"margin_pct": 30.009}, {"margin_pct": math.nan}, {"netwr_usd": math.nan, "margin_pct": math.nan},
])
def test_small_drift_and_nan_pass(spark, changes):
    assert failed(sales_with(spark, **changes)) == []


def test_negative_margins_only_warn(spark):
    report = sales_with(spark, estimated_cost_usd=150.0, margin_pct=-50.0)
    assert failed(report) == [("negative_margins", "margin_pct", 1)]
    require_passed(combine_reports(sales=report))


CONTROLLING = "actual_cost double, budget_amount double, budget_variance double"


@pytest.mark.parametrize("row, names", [
    ((900.0, 1000.0, -100.0), []), ((900.0, 1000.0, -99.9), ["budget_variance_cross_validation"]),
    ((900.0, 1000.0, None), ["budget_variance_no_nulls"]), ((None, 1000.0, 5.0), []),
    ((math.nan, 1000.0, 5.0), []),
])
def test_controlling(spark, row, names):
    df = spark.createDataFrame([row, (1.0, 1.0, 0.0)], CONTROLLING)
    assert [f[0] for f in failed(validate_controlling(df, min_rows=2))] == names
    assert "controlling_row_count" in [f[0] for f in failed(validate_controlling(df))]


@pytest.mark.parametrize("row, names", [
    (("2", "150.0"), []), (("-1", "150.0"), ["days_late_non_negative"]), ((None, "1"), []), (("x", "1"), []),
    (("1", "0"), ["freight_cost_positive"]), (("1", None), ["freight_cost_positive"]), (("1", "x"), ["freight_cost_positive"]),
])
def test_delivery_reads_text_and_numbers(spark, row, names):
    df = spark.createDataFrame([row, ("1", "1")], "days_late string, freight_cost_usd string")
    assert [f[0] for f in failed(validate_delivery(df, min_rows=2))] == names
    assert "delivery_row_count" in [f[0] for f in failed(validate_delivery(df))]


def test_all_failures_are_named_together(spark):
    with pytest.raises(ChecksFailed, match="2 check.*delivery.delivery_row_count.*sales.row_count_range"):
        require_passed(combine_reports(
            sales=validate_sales(spark.createDataFrame([tuple(GOOD.values())], SALES)),
            delivery=validate_delivery(spark.createDataFrame([(1.0, 1.0)], "days_late double, freight_cost_usd double")),
        ))
