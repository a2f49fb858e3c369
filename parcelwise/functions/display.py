"""Values as the dashboard shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(share: Column, places: int) -> Column:
    return F.round(share * 100.0, places)


def first_word(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def first_count(*counts: Column) -> Column:
    """First count that is given; 0 counts as not given unless it is the last one."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in counts[:-1]], counts[-1])


def comparison_label(cagr: Column, street_avg: Column, suburb_avg: Column) -> Column:
    """Property growth against its street and suburb; an average of 0 counts as unknown."""
    street, suburb = F.nullif(street_avg, F.lit(0.0)), F.nullif(suburb_avg, F.lit(0.0))
    above = (street.isNull() | (cagr > street)) & (suburb.isNull() | (cagr > suburb))
    below = F.coalesce((cagr < street) & (cagr < suburb), F.lit(False))
    return (F.when(F.coalesce(cagr, F.lit(0.0)) == 0.0, "N/A")
            .when(above, "Above Average")
            .when(below, "Below Average")
            .otherwise("Mixed Performance"))


def short_price(price: Column) -> Column:
    """1.2M, 350K, or the plain number under a thousand."""
    plain = F.when(price == F.floor(price), F.floor(price).cast("string")).otherwise(price.cast("string"))
    return (F.when(price >= 1e6, F.format_string("%.1fM", price / 1e6))
            .when(price >= 1e3, F.format_string("%.0fK", price / 1e3))
            .otherwise(plain))


def growth_bar(cagr: Column) -> Column:
    """Bar width in percent, between 5 and 100."""
    return F.greatest(F.lit(5.0), F.least(F.lit(100.0), F.coalesce(cagr, F.lit(0.0)) * 800.0))


def entity_id(street: Column, suburb: Column) -> Column:
    return F.concat(street, F.lit("_"), suburb)


def entity_label(street: Column, suburb: Column) -> Column:
    return F.concat(street, F.lit(", "), suburb)
