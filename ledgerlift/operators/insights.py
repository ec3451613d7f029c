"""Gold rows as English sentences, one per row."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions.money import SQUEEZE_LIMIT_PCT
from ledgerlift.functions.text import fmt_fixed

# Limits and phrases of the sentences.
OVERSPEND_LIMIT = 100_000.0
LATE_LIMIT_DAYS = 5.0
LOW_MARGIN_TAG = " — critically below the 6% threshold"
OVERSPEND_TAG = " — critical overspend"
LATE_TAG = " — critical delay"


def _num(name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def _int(name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("bigint"), F.lit(0)).cast("string")


def _str(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _when(condition: Column, tag: str) -> Column:
    return F.when(condition, tag).otherwise("")


def _sentence(table: str, *parts: Column | str) -> tuple[Column, Column]:
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.lit(table).alias("table_name"), text.alias("text")


def insights_material(gold: DataFrame) -> DataFrame:
    avg = _num("avg_margin_pct")
    return gold.select(*_sentence(
        "margin_by_material",
        _str("material_id"), " has an average margin of ", fmt_fixed(avg, 1), "% with ",
        _int("squeeze_count"), " squeeze orders and $", fmt_fixed(_num("total_net_value_usd"), 0),
        " total revenue", _when(avg < SQUEEZE_LIMIT_PCT, LOW_MARGIN_TAG), ".",
    ))


def insights_channel(gold: DataFrame) -> DataFrame:
    return gold.select(*_sentence(
        "margin_by_channel",
        "The ", _str("distribution_channel"), " channel has an average margin of ",
        fmt_fixed(_num("avg_margin_pct"), 1), "% across ", _int("order_count"), " orders with $",
        fmt_fixed(_num("total_net_value_usd"), 0), " total revenue.",
    ))


def insights_sales_org(gold: DataFrame) -> DataFrame:
    return gold.select(*_sentence(
        "margin_by_sales_org",
        "Sales org ", _str("sales_org"), " has an average margin of ",
        fmt_fixed(_num("avg_margin_pct"), 1), "% across ", _int("order_count"), " orders.",
    ))


def insights_segment(gold: DataFrame) -> DataFrame:
    return gold.select(*_sentence(
        "margin_by_segment",
        "The ", _str("industry"), " segment in ", _str("region_group"), " has an average margin of ",
        fmt_fixed(_num("avg_margin_pct"), 1), "% with $", fmt_fixed(_num("total_net_value_usd"), 0),
        " revenue.",
    ))


def insights_budget(gold: DataFrame) -> DataFrame:
    """A variance of zero is under budget."""
    variance = _num("total_variance")
    above_zero = (variance > 0.0) & ~F.isnan(variance)
    critical = (variance > OVERSPEND_LIMIT) & ~F.isnan(variance)
    return gold.select(*_sentence(
        "budget_variance",
        "The ", _str("department"), " department is $", fmt_fixed(F.abs(variance), 0), " ",
        F.when(above_zero, "over budget").otherwise("under budget"), " in fiscal year ",
        _str("fiscal_year"), _when(critical, OVERSPEND_TAG), ".",
    ))


def insights_delivery(gold: DataFrame) -> DataFrame:
    """One sentence per Gold row, so a route has one per transport type."""
    late = _num("avg_days_late")
    critical = (late > LATE_LIMIT_DAYS) & ~F.isnan(late)
    return gold.select(*_sentence(
        "delivery_performance",
        "Route ", _str("route"), " averages ", fmt_fixed(late, 0), " days late across ",
        _int("delivery_count"), " deliveries with $", fmt_fixed(_num("total_freight_cost"), 0),
        " total freight cost", _when(critical, LATE_TAG), ".",
    ))


INSIGHT_BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "margin_by_material": insights_material,
    "margin_by_channel": insights_channel,
    "margin_by_sales_org": insights_sales_org,
    "margin_by_segment": insights_segment,
    "budget_variance": insights_budget,
    "delivery_performance": insights_delivery,
}


def insights_all(gold: Mapping[str, DataFrame]) -> DataFrame:
    """The sentences of all six Gold tables, given by name."""
    return reduce(DataFrame.unionByName, (build(gold[name]) for name, build in INSIGHT_BUILDERS.items()))
