"""Data checks. Each table is checked in one aggregation; the report is one row per check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAIL, WARN = "fail", "warn"


class ChecksFailed(RuntimeError):
    """At least one hard check failed, so nothing may be published."""


@dataclass(frozen=True)
class _Rule:
    """``bad`` marks the rows that break the rule, ``says`` describes them."""

    name: str
    column: str
    bad: Column
    says: str
    severity: str = FAIL


def _exceeds(x: Column, limit: float) -> Column:
    """``x > limit`` where NaN, which Spark sorts above every number, exceeds nothing."""
    return (x > limit) & ~F.isnan(x)


def _no_nulls(name: str, *columns: str) -> list[_Rule]:
    return [_Rule(name, c, F.col(c).isNull(), "null") for c in columns]


def _positive(name: str, column: str) -> _Rule:
    value = F.col(column).try_cast("double")
    return _Rule(name, column, value.isNull() | (value <= 0.0), "null, zero or negative")


def _report(df: DataFrame, count_name: str, low: int, high: int | None, rules: list[_Rule]) -> DataFrame:
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(r.bad).alias(f"bad_{i}") for i, r in enumerate(rules)),
    )
    rows = F.col("rows")
    in_range = (rows >= low) if high is None else rows.between(low, high)
    allowed = f"at least {low}" if high is None else f"{low} to {high}"

    def line(name, column, passed, bad_rows, message, severity):
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(column).cast("string").alias("column"),
            passed.alias("passed"),
            bad_rows.cast("bigint").alias("bad_rows"),
            message.alias("message"),
            F.lit(severity).alias("severity"),
        )

    count_line = line(
        count_name, None, in_range, F.lit(None),
        F.concat(rows.cast("string"), F.lit(f" rows, allowed {allowed}")), FAIL,
    )
    rule_lines = [
        line(
            r.name, r.column, F.col(f"bad_{i}") == 0, F.col(f"bad_{i}"),
            F.concat(F.col(f"bad_{i}").cast("string"), F.lit(f" rows with {r.column} {r.says}")),
            r.severity,
        )
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(count_line, *rule_lines)))


def validate_sales(df: DataFrame, min_rows: int = 500, max_rows: int | None = None) -> DataFrame:
    """Check the enriched sales table. Negative margins only warn; without ``max_rows`` any number of rows is right."""
    net, cost, margin = (F.col(c) for c in ("netwr_usd", "estimated_cost_usd", "margin_pct"))
    drift = F.abs((net - cost) / F.when(net > 0.0, net) * 100.0 - margin)
    rules = [
        *_no_nulls("join_key_no_nulls", "order_id", "customer_id", "material_id"),
        _positive("netwr_usd_positive", "netwr_usd"),
        _Rule("margin_pct_not_above_100", "margin_pct", _exceeds(margin, 100.0), "above 100"),
        _Rule("negative_margins", "margin_pct", margin < 0.0, "below 0", WARN),
        _positive("estimated_cost_usd_positive", "estimated_cost_usd"),
        _Rule("margin_cross_validation", "margin_pct", _exceeds(drift, 0.01), "not matching the amounts"),
        *_no_nulls(
            "enrichment_col_no_nulls", "netwr_usd", "estimated_cost_usd", "margin_pct", "is_margin_squeeze"
        ),
    ]
    return _report(df, "row_count_range", min_rows, max_rows, rules)


def validate_controlling(df: DataFrame, min_rows: int = 50) -> DataFrame:
    """Check the controlling table."""
    actual, budget, variance = (F.col(c) for c in ("actual_cost", "budget_amount", "budget_variance"))
    drift = F.abs((actual - budget) - variance)
    rules = [
        *_no_nulls("budget_variance_no_nulls", "budget_variance"),
        _Rule(
            "budget_variance_cross_validation", "budget_variance", _exceeds(drift, 0.01),
            "not matching actual minus budget",
        ),
    ]
    return _report(df, "controlling_row_count", min_rows, None, rules)


def validate_delivery(df: DataFrame, min_rows: int = 50) -> DataFrame:
    """Check the delivery table."""
    rules = [
        _Rule("days_late_non_negative", "days_late", F.col("days_late").try_cast("double") < 0.0, "below 0"),
        _positive("freight_cost_positive", "freight_cost_usd"),
    ]
    return _report(df, "delivery_row_count", min_rows, None, rules)


def combine_reports(**reports: DataFrame) -> DataFrame:
    """Reports of several tables as one, with the table's name in front."""
    named = (report.select(F.lit(table).alias("table"), "*") for table, report in reports.items())
    return reduce(DataFrame.unionByName, named)


def failed_checks(report: DataFrame) -> DataFrame:
    """The failed hard checks of a combined report."""
    return report.where(~F.col("passed") & (F.col("severity") == FAIL))


def require_passed(report: DataFrame) -> None:
    """Raise ``ChecksFailed`` naming every failed hard check of a combined report.

    Only the failed lines, at most a dozen per table, come to the driver.
    """
    lines = failed_checks(report).orderBy("table", "name", "column").collect()
    if lines:
        failed = "; ".join(f"{r['table']}.{r['name']} ({r['message']})" for r in lines)
        raise ChecksFailed(f"{len(lines)} check(s) failed, nothing published: {failed}")
