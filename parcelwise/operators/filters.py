"""Filters of the sales list and the dashboard's rules for its parameters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PRICE_SHOWN = 10_000_000


def between_dates(sales: DataFrame, start_date: date | str | None = None,
                  end_date: date | str | None = None) -> DataFrame:
    if start_date:
        sales = sales.filter(F.col("contract_date") >= F.lit(start_date).cast("date"))
    if end_date:
        sales = sales.filter(F.col("contract_date") <= F.lit(end_date).cast("date"))
    return sales


def in_year(sales: DataFrame, year: int) -> DataFrame:
    """Sales contracted in a calendar year, as a date range so that file statistics can prune."""
    return between_dates(sales, f"{year:04d}-01-01", f"{year:04d}-12-31")


def matching(sales: DataFrame, *, suburb: str | None = None, street: str | None = None,
             property_type: str | None = None, min_area: float | None = None, max_area: float | None = None,
             min_price: float | None = None, max_price: float | None = None,
             start_date: date | str | None = None, end_date: date | str | None = None) -> DataFrame:
    """Sales that pass every given filter. A bound of 0 or an empty text means "not given"; the
    suburb is a part of the name in any case, where % and _ are wildcards."""
    if suburb:
        sales = sales.filter(F.col("property_locality").ilike(f"%{suburb}%"))
    if street:
        sales = sales.filter(F.col("property_street_name") == street)
    if property_type:
        sales = sales.filter(F.col("primary_purpose") == property_type)
    if min_area:
        sales = sales.filter(F.col("area") >= float(min_area))
    if max_area:
        sales = sales.filter(F.col("area") <= float(max_area))
    if min_price:
        sales = sales.filter(F.col("purchase_price") >= float(min_price))
    if max_price:
        sales = sales.filter(F.col("purchase_price") <= float(max_price))
    return between_dates(sales, start_date, end_date)


def dashboard_filters(year: int, price_min: float = 0, price_max: float = MAX_PRICE_SHOWN,
                      property_type: str = "", suburb: str | None = None, street: str | None = None) -> dict:
    """Arguments of the sales list for the dashboard's controls: a whole year, no lower bound at 0,
    no upper bound at the slider's end."""
    return {
        "limit": 100,
        "start_date": f"{year:04d}-01-01",
        "end_date": f"{year:04d}-12-31",
        "property_type": property_type or None,
        "min_price": price_min or None,
        "max_price": None if price_max >= MAX_PRICE_SHOWN else price_max,
        "suburb": suburb,
        "street": street,
    }
