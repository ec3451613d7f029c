"""Gold rows as the lines of a prompt context."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions.text import fmt_fixed, labelled
from ledgerlift.operators.gold import GOLD_TABLES

# Sections in order, and the budget headings.
SECTIONS: dict[str, str] = {
    "margin_by_material": "MARGIN BY MATERIAL",
    "margin_by_channel": "MARGIN BY CHANNEL",
    "budget_variance": "BUDGET VARIANCE",
    "delivery_performance": "DELIVERY PERFORMANCE",
    "margin_by_sales_org": "MARGIN BY SALES ORG",
    "margin_by_segment": "MARGIN BY SEGMENT",
}
OVER_HEADING = "OVER BUDGET (actual > planned — cost overrun, action required):"
UNDER_HEADING = "UNDER BUDGET (actual < planned — savings, on track):"

# Parts of a section, in order: title, then lines (budget: two headed blocks), then a blank line.
_TITLE, _OVER_HEAD, _OVER, _OVER_END, _UNDER_HEAD, _UNDER, _LINES, _END = range(8)
# Every context table has these columns. Lines sort by part, then rank, then tie_key; this order
# needs no running number, so no task has to see the whole section.
_ORDER = ("part", "rank", "tie_key")


def _fixed_lines(df: DataFrame, *lines: tuple[int, str]) -> DataFrame:
    rows = [(part, None, None, text) for part, text in lines]
    return df.sparkSession.createDataFrame(rows, "part int, rank double, tie_key string, line string")


def _tie_key(*names: str) -> Column:
    return F.to_json(F.struct(*names))


def context_lines(gold: DataFrame, name: str) -> DataFrame:
    """One line per row: ``column: value`` joined by `` | ``, columns in alphabetical order."""
    table = GOLD_TABLES[name]
    return gold.select(
        F.lit(_LINES).alias("part"), F.col(table.sort).cast("double").alias("rank"),
        _tie_key(*table.keys).alias("tie_key"), labelled(gold, sorted(gold.columns), " | ").alias("line"),
    )


def budget_context(gold: DataFrame) -> DataFrame:
    """Budget lines: over-budget rows first, each block by falling variance, with its heading.

    A heading (and the blank line that ends a block) appears only when its block has rows.
    """
    amount = {
        c: F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(0.0))
        for c in ("total_budget", "total_actual_cost", "total_variance")
    }
    variance = amount["total_variance"]
    over = variance > 0.0
    rows = gold.select(
        over.alias("_over"), (-variance).alias("rank"), _tie_key("department", "fiscal_year").alias("tie_key"),
        F.concat(
            F.lit("  "), F.coalesce(F.col("department"), F.lit("?")), F.lit(" "),
            F.coalesce(F.col("fiscal_year").try_cast("bigint"), F.lit(0)).cast("string"),
            F.lit(": budget=$"), fmt_fixed(amount["total_budget"], 2),
            F.lit(" | actual=$"), fmt_fixed(amount["total_actual_cost"], 2),
            F.when(over, " | overrun=$").otherwise(" | savings=$"), fmt_fixed(F.abs(variance), 2),
        ).alias("line"),
    )
    lines = rows.select(F.when(F.col("_over"), _OVER).otherwise(_UNDER).alias("part"), *_ORDER[1:], "line")

    def frame(head: int, heading: str, end: int) -> Column:
        return F.array(
            F.struct(F.lit(head).alias("part"), F.lit(heading).alias("line")),
            F.struct(F.lit(end).alias("part"), F.lit("").alias("line")),
        )

    # At most two rows: one per block that exists.
    blocks = rows.select("_over").distinct()
    framed = F.when(F.col("_over"), frame(_OVER_HEAD, OVER_HEADING, _OVER_END)).otherwise(
        frame(_UNDER_HEAD, UNDER_HEADING, _END)
    )
    headings = blocks.select(F.inline(framed)).select(
        "part", F.lit(None).cast("double").alias("rank"), F.lit(None).cast("string").alias("tie_key"), "line"
    )
    return lines.unionByName(headings)


def gold_context(gold: Mapping[str, DataFrame]) -> DataFrame:
    """All context lines in order: ``section``, the order columns, ``line``."""
    sections = []
    for number, (name, title) in enumerate(SECTIONS.items(), start=1):
        if name == "budget_variance":
            body, fixed = budget_context(gold[name]), [(_TITLE, f"=== {title} ===")]
        else:
            body, fixed = context_lines(gold[name], name), [(_TITLE, f"=== {title} ==="), (_END, "")]
        whole = body.unionByName(_fixed_lines(body, *fixed))
        sections.append(whole.select(F.lit(number).alias("section"), "*"))
    return reduce(DataFrame.unionByName, sections).orderBy(
        "section", "part", F.col("rank").asc_nulls_first(), F.col("tie_key").asc_nulls_first()
    )


def context_text(context: DataFrame, max_lines: int | None = None) -> str:
    """The context as one string, for a prompt: all of it, on the driver.

    ``max_lines`` makes a context of more lines an error, not a cut. ``write_context`` takes any size.
    """
    wanted = context.select("line") if max_lines is None else context.select("line").limit(max_lines + 1)
    lines = [row["line"] for row in wanted.collect()]
    if max_lines is not None and len(lines) > max_lines:
        raise ValueError(f"context has more than {max_lines} lines")
    return "".join(f"{line}\n" for line in lines)


def write_context(context: DataFrame, path: str) -> None:
    """The context as text files whose names follow its order, whatever its size."""
    context.select("line").write.mode("overwrite").text(path)
