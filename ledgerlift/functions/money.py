"""Currency, margin and squeeze expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates to USD, the squeeze limit in percent, the watched material.
USD_RATES: dict[str, float] = {"EUR": 1.08, "GBP": 1.27, "USD": 1.0}
SQUEEZE_LIMIT_PCT = 6.0
WATCHED_MATERIAL = "MAT-01"


def to_usd(amount: Column, currency: Column, rates: Mapping[str, float] | None = None) -> Column:
    """Amount in USD. Codes are case-sensitive; an unknown or null code leaves the amount as it is."""
    rate = F.lit(1.0)
    for code, value in (USD_RATES if rates is None else rates).items():
        rate = F.when(currency == code, F.lit(float(value))).otherwise(rate)
    return amount * rate


def is_unknown_currency(currency: Column, rates: Mapping[str, float] | None = None) -> Column:
    """True where a currency code is present but has no rate."""
    known = list(USD_RATES if rates is None else rates)
    return F.coalesce(~currency.isin(known), F.lit(False))


def margin_pct(net: Column, cost: Column) -> Column:
    """Margin in percent of ``net``, 0.0 where ``net`` is zero."""
    return F.when(net == 0.0, F.lit(0.0)).otherwise((net - cost) / net * 100.0)


def is_margin_squeeze(margin: Column) -> Column:
    """True strictly below the limit; NaN is not below it."""
    return margin < SQUEEZE_LIMIT_PCT
