"""Means that do not depend on the order of summation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums count in units of 2**-30, about a billionth: a tenth of a millimetre of a coordinate.
BITS, HALF = 30, 15
#: Greater values are no prices or coordinates.
MOST = 1e18


def exact_parts(column: str) -> dict[str, Column]:
    """Sum (exact, in units of 2**-BITS) and number of the values that are numbers.

    A value is a whole part and two halves of its fraction, each summed up as a long, so that adding up neither rounds nor leaves
    machine arithmetic; the halves keep their sums in range for 2**48 values."""
    value = F.when(~F.isnan(column) & (F.abs(column) < MOST), F.col(column).cast("double"))
    whole = F.floor(value)
    units = F.round((value - whole) * float(1 << BITS)).cast("bigint")
    high, low = F.shiftright(units, HALF), units.bitwiseAND((1 << HALF) - 1)
    total = ((F.sum(whole).cast("decimal(20,0)") * F.lit(1 << HALF).cast("decimal(6,0)") + F.sum(high)).cast("decimal(30,0)")
             * F.lit(1 << HALF).cast("decimal(6,0)") + F.sum(low)).cast("decimal(38,0)")
    return {"sum": total, "n": F.count(value)}


def mean_of(total: Column, n: Column) -> Column:
    """The mean from a sum and a number of `exact_parts`; NULL if there are no values."""
    return F.try_divide(total.cast("double") / float(1 << BITS), n)


def exact_mean(column: str) -> Column:
    """Mean of the values that are numbers, summed up exactly; NULL if there are none."""
    parts = exact_parts(column)
    return mean_of(parts["sum"], parts["n"])
