"""Number-to-text expressions with exact, ties-to-even rounding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Splits a double into two halves whose products with small integers are exact.
_SPLIT = 134217729.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once and named once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scaled(frac: Column, scale: float, tie_up: Callable[[Column], Column]) -> Column:
    """``frac * scale`` rounded to a whole number by the exact product; ``tie_up`` settles ties.

    The floating-point product is compared together with its rounding error, which the halves of
    ``frac`` give exactly.
    """
    def with_error(product: Column) -> Column:
        def settle(high: Column) -> Column:
            error = (high * scale - product) + (frac - high) * scale
            low = F.floor(product)
            rest = product - low.cast("double")
            up = (
                F.when(rest != 0.5, rest > 0.5).when(error != 0.0, error > 0.0).otherwise(tie_up(low))
            )
            return low + up.cast("bigint")

        return _let(frac * _SPLIT - (frac * _SPLIT - frac), settle)

    return _let(frac * scale, with_error)


def fmt_fixed(x: Column, digits: int) -> Column:
    """``x`` with a fixed number of decimals and no thousands separator.

    Rounds the exact binary value, ties to even. Both ``format_string`` and ``bround`` round the
    shortest decimal form instead, so they turn 0.15 (which is stored just below the tie) into 0.2.
    """
    limit = 10**digits

    def show(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size)
        last = (lambda low: low % 2 == 1) if digits else (lambda low: whole % 2 == 1)
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")

        def join(cents: Column) -> Column:
            carried = (whole + F.when(cents == limit, 1).otherwise(0)).cast("string")
            if not digits:
                return F.concat(sign, carried)
            return F.concat(sign, carried, F.lit("."), F.lpad((cents % limit).cast("string"), digits, "0"))

        number = _let(_scaled(size - whole.cast("double"), float(limit), last), join)
        return F.when(F.isnan(v), "NaN").when(size == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(number)

    return _let(x.cast("double"), show)


def fmt_number(x: Column) -> Column:
    """A double as text: null ``N/A``, whole numbers without decimals, others with two."""
    def show(v: Column) -> Column:
        no_value = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        whole = F.when(v == F.rint(v), F.floor(v).cast("string"))
        return F.when(no_value, "N/A").otherwise(F.coalesce(whole, fmt_fixed(v, 2)))

    return _let(x.cast("double"), show)


def fmt_value(x: Column, data_type: T.DataType) -> Column:
    """A cell as text: numbers by ``fmt_number``, other values as they are, null ``N/A``."""
    if isinstance(data_type, T.NumericType):
        return fmt_number(x)
    return F.coalesce(x.cast("string"), F.lit("N/A"))


def labelled(df: DataFrame, columns: Sequence[str], separator: str) -> Column:
    """``name: value`` of the columns, joined; values as in ``fmt_value``.

    The cells go through one expression as an array, so the plan does not grow with the columns.
    """
    cells = []
    for name in columns:
        numeric = isinstance(df.schema[name].dataType, T.NumericType)
        cells.append(F.struct(
            F.lit(f"{name}: ").alias("label"),
            (F.col(name).cast("double") if numeric else F.lit(None).cast("double")).alias("number"),
            (F.lit(None) if numeric else F.col(name)).cast("string").alias("text"),
        ))
    shown = F.transform(
        F.array(*cells), lambda c: F.concat(c["label"], F.coalesce(c["text"], fmt_number(c["number"])))
    )
    return F.array_join(shown, separator)
