"""Gold aggregates: margins by four cuts, budget variance, delivery performance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.schemas import ContractError


def _without_nan(name: str) -> Column:
    return F.nanvl(F.col(name), F.lit(None))


def _with_parts(df: DataFrame, *names: str) -> DataFrame:
    """The rows with the parts of each amount that ``_sum`` adds up: whole part, first 20 binary places, rest."""
    def rest(value: Column, part: Column) -> Column:
        return F.nanvl(value - part, F.lit(0.0))  # infinity and NaN are in the whole part

    parts = {}
    for name in names:
        whole = F.rint(name)
        places = rest(F.col(name), whole)
        first = F.rint(places * float(1 << 20)) / float(1 << 20)
        parts |= {f"{name}_whole": whole, f"{name}_first": first, f"{name}_rest": rest(places, first)}
    return df.withColumns(parts)


def _sum(name: str) -> Column:
    """The sum of doubles without the error that grows with the rows, so it does not depend on their order; of rows ``_with_parts``.

    Whole parts and the first 20 binary places of the rests add up exactly, and what is left is too small to
    matter. A sum above 2^53 is rounded as any other.
    """
    return F.sum(f"{name}_whole") + (F.sum(f"{name}_first") + F.sum(f"{name}_rest"))


def _total(name: str) -> Column:
    """Sum of the non-null values; 0 where a group has none."""
    return F.coalesce(_sum(name), F.lit(0.0))


def _margin_measures(net: str, cost: str) -> dict[str, Column]:
    return {
        "avg_margin_pct": F.avg("margin_pct"),
        "min_margin_pct": F.min(_without_nan("margin_pct")),
        "max_margin_pct": F.max(_without_nan("margin_pct")),
        "total_net_value_usd": _total(net),
        "total_cost_usd": _total(cost),
        "squeeze_count": F.count_if(F.col("is_margin_squeeze")),
        "order_count": F.count("order_id"),
    }


@dataclass(frozen=True)
class GoldTable:
    """What one Gold table is made of: its Silver source, keys, measures and sort column."""

    source: str
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    sort: str


_BY_CUT = (
    "avg_margin_pct", "min_margin_pct", "max_margin_pct", "total_net_value_usd", "squeeze_count",
    "order_count",
)

GOLD_TABLES: dict[str, GoldTable] = {
    "margin_by_material": GoldTable(
        "sales_enriched", ("material_id",),
        ("avg_margin_pct", "min_margin_pct", "max_margin_pct", "total_net_value_usd", "total_cost_usd",
         "squeeze_count", "order_count"),
        "avg_margin_pct",
    ),
    "margin_by_channel": GoldTable("sales_enriched", ("distribution_channel",), _BY_CUT, "avg_margin_pct"),
    "margin_by_sales_org": GoldTable("sales_enriched", ("sales_org",), _BY_CUT, "avg_margin_pct"),
    "margin_by_segment": GoldTable(
        "sales_enriched", ("industry", "region_group"),
        ("avg_margin_pct", "total_net_value_usd", "squeeze_count", "order_count"), "avg_margin_pct",
    ),
    "budget_variance": GoldTable(
        "controlling_enriched", ("department", "fiscal_year"),
        ("total_actual_cost", "total_budget", "total_variance", "avg_variance", "record_count"),
        "total_variance",
    ),
    "delivery_performance": GoldTable(
        "delivery_enriched", ("route", "transport_type"),
        ("avg_days_late", "avg_freight_cost", "total_freight_cost", "delivery_count"), "avg_days_late",
    ),
}


def _amounts(source: str, basis: str = "local") -> tuple[str, ...]:
    """The columns that the measures of a Silver table add up."""
    if source == "sales_enriched":
        return {"local": ("net_value", "estimated_cost"), "usd": ("netwr_usd", "estimated_cost_usd")}[basis]
    return ("actual_cost", "budget_amount", "budget_variance") if source == "controlling_enriched" else ("freight_cost_usd",)


def _measures(source: str, basis: str = "local") -> dict[str, Column]:
    if source == "sales_enriched":
        return _margin_measures(*_amounts(source, basis))
    if source == "controlling_enriched":
        return {
            "total_actual_cost": _total("actual_cost"),
            "total_budget": _total("budget_amount"),
            "total_variance": _total("budget_variance"),
            "avg_variance": F.avg("budget_variance"),
            "record_count": F.count("order_id"),
        }
    return {
        "avg_days_late": F.avg("days_late"),
        "avg_freight_cost": F.avg("freight_cost_usd"),
        "total_freight_cost": _total("freight_cost_usd"),
        "delivery_count": F.count("delivery_id"),
    }


def sorted_gold(df: DataFrame, name: str) -> DataFrame:
    """The table's order: its sort column ascending, nulls first, ties by key."""
    table = GOLD_TABLES[name]
    return df.orderBy(F.col(table.sort).asc_nulls_first(), *(F.col(k).asc_nulls_first() for k in table.keys))


def unsorted_gold(df: DataFrame, name: str, basis: str = "local") -> DataFrame:
    """One Gold table in no order, as it is written; ``metric`` sorts when it reads."""
    table = GOLD_TABLES[name]
    measures = _measures(table.source, basis)
    rows = _with_parts(df, *_amounts(table.source, basis))
    return rows.groupBy(*table.keys).agg(*(measures[m].alias(m) for m in table.measures))


def _aggregate(df: DataFrame, name: str, basis: str = "local") -> DataFrame:
    return sorted_gold(unsorted_gold(df, name, basis), name)


def margin_by_material(sales: DataFrame, basis: str = "local") -> DataFrame:
    """Margins per material.

    With ``basis='local'`` the ``total_*_usd`` columns add up the amounts as booked, whatever their
    currency; that is what their established consumers expect. ``basis='usd'`` adds up the converted
    amounts. ``order_count`` counts joined lines. The same holds for the other three margin tables.
    """
    return _aggregate(sales, "margin_by_material", basis)


def margin_by_channel(sales: DataFrame, basis: str = "local") -> DataFrame:
    """Margins per distribution channel."""
    return _aggregate(sales, "margin_by_channel", basis)


def margin_by_sales_org(sales: DataFrame, basis: str = "local") -> DataFrame:
    """Margins per sales organisation."""
    return _aggregate(sales, "margin_by_sales_org", basis)


def margin_by_segment(sales: DataFrame, basis: str = "local") -> DataFrame:
    """Margins per industry and region."""
    return _aggregate(sales, "margin_by_segment", basis)


def budget_variance(controlling: DataFrame) -> DataFrame:
    """Cost against budget per department and year; a positive ``total_variance`` is over budget."""
    return _aggregate(controlling, "budget_variance")


def delivery_performance(delivery: DataFrame) -> DataFrame:
    """Lateness and freight per route and transport type."""
    return _aggregate(delivery, "delivery_performance")


GOLD_BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "margin_by_material": margin_by_material,
    "margin_by_channel": margin_by_channel,
    "margin_by_sales_org": margin_by_sales_org,
    "margin_by_segment": margin_by_segment,
    "budget_variance": budget_variance,
    "delivery_performance": delivery_performance,
}

MARGIN_TABLES = tuple(n for n, t in GOLD_TABLES.items() if t.source == "sales_enriched")
_CUT_KEYS = tuple(k for n in MARGIN_TABLES for k in GOLD_TABLES[n].keys)


def margins_by_cut(sales: DataFrame, basis: str = "local") -> DataFrame:
    """All four margin cuts from one pass over the sales table, told apart by ``gold_table``.

    One row per key of each cut, so the result is as small as the four Gold tables together. The map
    side aggregates every cut before the shuffle, whatever the number of key combinations.
    """
    cut_bit = {k: 1 << (len(_CUT_KEYS) - 1 - i) for i, k in enumerate(_CUT_KEYS)}
    all_bits = sum(cut_bit.values())
    # A set bit in grouping_id() marks a key that is not part of the row's cut.
    cut_id = {n: all_bits - sum(cut_bit[k] for k in GOLD_TABLES[n].keys) for n in MARGIN_TABLES}
    label = F.lit(None).cast("string")
    for name, number in cut_id.items():
        label = F.when(F.grouping_id() == number, name).otherwise(label)
    sets = [[F.col(k) for k in GOLD_TABLES[n].keys] for n in MARGIN_TABLES]
    measures = [c.alias(m) for m, c in _measures("sales_enriched", basis).items()]
    rows = _with_parts(sales, *_amounts("sales_enriched", basis))
    return rows.groupingSets(sets, *_CUT_KEYS).agg(label.alias("gold_table"), *measures)


def _partial_measures(basis: str) -> list[Column]:
    """What the margin measures can be put together from, group by group; an average is kept as sum and count."""
    measures = _measures("sales_enriched", basis)
    net, cost = _amounts("sales_enriched", basis)
    return [
        F.sum("margin_pct").alias("margin_sum"), F.count("margin_pct").alias("margin_count"),
        _sum(net).alias("net_sum"), _sum(cost).alias("cost_sum"),
        *(measures[m].alias(m) for m in ("min_margin_pct", "max_margin_pct", "squeeze_count", "order_count")),
    ]


def _final_measures() -> dict[str, Column]:
    return {
        "avg_margin_pct": F.sum("margin_sum") / F.nullif(F.sum("margin_count"), F.lit(0)),
        "min_margin_pct": F.min("min_margin_pct"), "max_margin_pct": F.max("max_margin_pct"),
        "total_net_value_usd": _total("net_sum"), "total_cost_usd": _total("cost_sum"),
        "squeeze_count": F.sum("squeeze_count"), "order_count": F.sum("order_count"),
    }


_SEGMENT = GOLD_TABLES["margin_by_segment"].keys


def _by_segment(partial: DataFrame, customers: DataFrame) -> DataFrame:
    """Partial measures per customer, joined with the customers' segments and put together by these."""
    segments = customers.select("customer_id", *_SEGMENT)
    measures = [c.alias(m) for m, c in _final_measures().items()]
    joined = _with_parts(partial.join(segments, "customer_id", "left"), "net_sum", "cost_sum")
    return joined.groupBy(*_SEGMENT).agg(*measures)


def _without_segment(lines: DataFrame, basis: str) -> DataFrame:
    """The lines, which must not have their segment yet, with the parts of their amounts."""
    present = [c for c in _SEGMENT if c in lines.columns]
    if present:
        raise ContractError(f"the lines have {', '.join(present)} already; aggregate them with margins_by_cut")
    return _with_parts(lines, *_amounts("sales_enriched", basis))


def segment_margins(lines: DataFrame, customers: DataFrame, basis: str = "local") -> DataFrame:
    """``margin_by_segment`` from lines that were not joined with the customers (unique per id).

    Lines are aggregated per customer first, so one row per customer and task is shuffled, not each line; a
    customer with a third of all lines is a row like any other. An average is made of sum and count.
    """
    partial = _without_segment(lines, basis).groupBy("customer_id").agg(*_partial_measures(basis))
    table = GOLD_TABLES["margin_by_segment"]
    return sorted_gold(_by_segment(partial, customers).select(*table.keys, *table.measures), "margin_by_segment")


def margins_of_lines(lines: DataFrame, customers: DataFrame, basis: str = "local") -> DataFrame:
    """``margins_by_cut`` from lines that were not joined with the customers (unique per id).

    One pass aggregates the lines by material, channel, sales organisation and customer; what the
    customers' rows leave is then joined with the customers. See ``segment_margins``.
    """
    own = [n for n in MARGIN_TABLES if n != "margin_by_segment"]
    keys = [*(k for n in own for k in GOLD_TABLES[n].keys), "customer_id"]
    place = {n: len(keys) - 1 - i for i, n in enumerate([*own, "margin_by_segment"])}
    all_bits = (1 << len(keys)) - 1
    label = F.lit(None).cast("string")
    for name, bit in place.items():
        label = F.when(F.grouping_id() == all_bits - (1 << bit), name).otherwise(label)
    sets = [[F.col(k)] for k in keys]
    partial = _without_segment(lines, basis).groupingSets(sets, *keys).agg(label.alias("gold_table"), *_partial_measures(basis))
    measures = _final_measures()
    whole = partial.where(F.col("gold_table") != "margin_by_segment").select(
        *keys[:-1], *(F.lit(None).cast(customers.schema[k].dataType).alias(k) for k in _SEGMENT), "gold_table",
        (F.col("margin_sum") / F.nullif(F.col("margin_count"), F.lit(0))).alias("avg_margin_pct"),
        "min_margin_pct", "max_margin_pct", F.coalesce("net_sum", F.lit(0.0)).alias("total_net_value_usd"),
        F.coalesce("cost_sum", F.lit(0.0)).alias("total_cost_usd"), "squeeze_count", "order_count",
    )
    by_segment = _by_segment(partial.where(F.col("gold_table") == "margin_by_segment"), customers).select(
        *(F.lit(None).cast(lines.schema[k].dataType).alias(k) for k in keys[:-1]), *_SEGMENT,
        F.lit("margin_by_segment").alias("gold_table"), *measures,
    )
    return whole.unionByName(by_segment)


def pick_cut(cuts: DataFrame, name: str, *, ordered: bool = True) -> DataFrame:
    """One margin table out of ``margins_by_cut``, in its order or in none."""
    table = GOLD_TABLES[name]
    rows = cuts.where(F.col("gold_table") == name).select(*table.keys, *table.measures)
    return sorted_gold(rows, name) if ordered else rows
