"""Growth arithmetic over a first and a last sale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25
MIN_YEARS = 0.5
RECONCILE_TOLERANCE = 1e-4


def years_held(first_date: Column, last_date: Column) -> Column:
    return F.datediff(last_date, first_date) / F.lit(DAYS_PER_YEAR)


def total_growth(first_price: Column, last_price: Column) -> Column:
    return F.try_divide(last_price - first_price, first_price)


def cagr(first_price: Column, last_price: Column, years: Column) -> Column:
    """Compound annual growth; 0 for holdings under half a year or when the power overflows.

    NULL where no real growth rate exists: a first price of 0, or prices of opposite sign.
    """
    ratio = F.try_divide(last_price, first_price)
    rate = F.pow(ratio, F.try_divide(F.lit(1.0), years)) - 1.0
    return (F.when(years < MIN_YEARS, F.lit(0.0))
            .when(ratio >= 0.0, F.when(rate == float("inf"), F.lit(0.0)).otherwise(rate)))


def reconcile_status(stored: Column, computed: Column) -> Column:
    return F.when(F.abs(stored - computed) < RECONCILE_TOLERANCE, "PASS").otherwise("FAIL")
