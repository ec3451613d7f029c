"""Deduplicated masters, the joined sales table and its computed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlift.functions.money import (
    WATCHED_MATERIAL, is_margin_squeeze, is_unknown_currency, margin_pct, to_usd,
)
from ledgerlift.schemas import MEASURES, POSITION, ContractError, require_columns


def conform(df: DataFrame) -> DataFrame:
    """Cast the measure columns to double; text that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in df.columns if c in MEASURES})


def dedupe_first(df: DataFrame, key: str, order: str | Sequence[str] = POSITION) -> DataFrame:
    """Keep the first row per key in ``order``, which must be unique; the order columns are dropped.

    ``min_by`` combines on the map side, so each task sends at most one row per key and a key that
    holds a third of the table costs no more than any other. Grouping also tells the optimizer that
    the key is unique, so a later left join is removed when nothing of this table is used.
    """
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c != key and c not in order]
    if not rest:
        return df.select(key).distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(first.alias("_first")).select(key, "_first.*")


def equi_join(left: DataFrame, right: DataFrame, key: str, how: str, taken: Sequence[str] | None = None) -> DataFrame:
    """Join on one shared key: left columns, then right ones. Right columns whose name is ``taken``, by default in the
    left table, get the suffix ``_right``. Keys of different type are an error rather than silently cast."""
    types = [dict((f.name, f.dataType) for f in side.schema.fields)[key] for side in (left, right)]
    if types[0] != types[1]:
        raise ContractError(f"{key} is {types[0].simpleString()} on one side, {types[1].simpleString()} on the other")
    names = {c.lower() for c in (left.columns if taken is None else taken)}
    clashes = {c: f"{c}_right" for c in right.columns if c != key and c.lower() in names}
    renamed = right.withColumnsRenamed(clashes)
    added = [c for c in renamed.columns if c != key]
    return left.join(renamed, key, how).select(*left.columns, *added)


def add_margins(joined: DataFrame, rates: Mapping[str, float] | None = None) -> DataFrame:
    """Add USD amounts, margin and squeeze flags. A null amount counts as 0, a null currency as USD."""
    currency = F.coalesce(F.col("currency"), F.lit("USD"))
    amounts = joined.withColumns({
        "netwr_usd": to_usd(F.coalesce(F.col("net_value"), F.lit(0.0)), currency, rates),
        "estimated_cost_usd": to_usd(F.coalesce(F.col("estimated_cost"), F.lit(0.0)), currency, rates),
    })
    margins = amounts.withColumn("margin_pct", margin_pct(F.col("netwr_usd"), F.col("estimated_cost_usd")))
    squeeze = is_margin_squeeze(F.col("margin_pct"))
    watched: Column = F.coalesce(F.col("material_id"), F.lit("")) == WATCHED_MATERIAL
    return margins.withColumns({"is_margin_squeeze": squeeze, "is_mat01_squeeze": watched & squeeze})


def enrich_sales(
    header: DataFrame,
    items: DataFrame,
    customer: DataFrame,
    material: DataFrame | None = None,
    *,
    rates: Mapping[str, float] | None = None,
    observe: Mapping[str, Observation] | None = None,
) -> DataFrame:
    """Header joined with items, deduplicated customers and (optional) materials, plus margins.

    ``customer`` and ``material`` must be unique per key, see ``dedupe_first``. No join is hinted:
    a master below the session's broadcast threshold is broadcast, a larger one is shuffled, and
    adaptive execution splits the partitions of a hot order, customer or null key. Customers are joined with the
    headers, before each is repeated for its items; only where the rows of these steps are observed, step by step.

    ``observe`` takes observations named ``items``, ``customer``, ``material`` and ``sales``; they
    receive the row count after each step (``sales`` also the rows with an unknown currency) without
    a further job. They are for logs: a recomputed shuffle stage may count twice.
    """
    observe = observe or {}

    def counted(df: DataFrame, step: str, *more: Column) -> DataFrame:
        if step not in observe:
            return df
        return df.observe(observe[step], F.count(F.lit(1)).alias("rows"), *more)

    header, items = require_columns(header, "sales_header"), require_columns(items, "sales_items")
    customer = require_columns(customer, "customer_master")
    lines = counted(equi_join(header, items, "order_id", "inner"), "items")
    if "items" in observe or "customer" in observe:
        sales = counted(equi_join(lines, customer, "customer_id", "left"), "customer")
    else:
        known = equi_join(header, customer, "customer_id", "left", taken=lines.columns)
        sales = equi_join(known, items, "order_id", "inner", taken=header.columns).select(
            *lines.columns, *known.columns[len(header.columns):])
    if material is not None:
        sales = counted(
            equi_join(sales, require_columns(material, "material_master"), "material_id", "left"), "material"
        )
    unknown = F.count_if(is_unknown_currency(F.col("currency"), rates)).alias("unknown_currency_rows")
    return counted(add_margins(sales, rates), "sales", unknown)
