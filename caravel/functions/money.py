"""Exact money arithmetic: decimals only, rounding half up, division safe against zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Totals get all the digits there are: a third of a few trillion lines no longer fits decimal(18,2).
MONEY = "decimal(38,2)"
PERCENT = "decimal(18,2)"


def rounded_money(total: Column) -> Column:
    return F.round(total, 2).cast(MONEY)


def safe_ratio(total: Column, n: Column) -> Column:
    """``total / n`` to the cent, NULL when ``n`` is zero.

    ``total`` must be a decimal sum: decimal division keeps 18 digits, so the only rounding
    that shows is the final one (an ``avg`` would round twice).
    """
    return F.round(total / F.nullif(n, F.lit(0)), 2).cast(MONEY)


def percent_of(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to two digits, NULL when ``whole`` is zero."""
    hundred = F.lit(100).cast("decimal(4,1)")
    return F.round(hundred * part / F.nullif(whole, F.lit(0)), 2).cast(PERCENT)


def line_amount(quantity: Column, unit_price: Column) -> Column:
    return (quantity.cast("decimal(10,0)") * unit_price).cast("decimal(14,2)")
