"""Exact quantiles without gathering a column, or a group's values, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the sketches, as a share: it decides how many values are ranked, never which is found.
ACCURACY = 10_000


def exact_quantile(df: DataFrame, column: str, share: float, accuracy: int = ACCURACY) -> Column:
    """Linearly interpolated quantile of the non-null values, as a scalar subquery (NULL if none).

    A mergeable sketch, whose rank error is at most n / accuracy, gives two values that surely
    enclose the wanted ranks once n is over `accuracy`; fewer values are ranked without bounds. Equal
    values are counted together, everything under the lower bound collapses into one row, everything
    over the upper bound is dropped, and only what lies between (about 4 n / accuracy values) is ranked.
    """
    values = df.select(F.col(column).alias("v")).filter("v IS NOT NULL")
    slack = 2.0 / accuracy
    bounds = values.agg(F.struct(
        F.count("*").alias("n"),
        F.percentile_approx("v", max(share - slack, 0.0), accuracy).alias("low"),
        F.percentile_approx("v", min(share + slack, 1.0), accuracy).alias("high"))).scalar()
    many = F.col("b.n") > accuracy
    under = many & (F.col("v") < F.col("b.low")) if share > slack else F.lit(False)
    over = many & (F.col("v") > F.col("b.high")) if share < 1.0 - slack else F.lit(False)

    near = (values.withColumn("b", bounds).filter(~over)
            .groupBy(F.when(~under, F.col("v")).alias("v"), F.col("b.n").alias("n"))
            .agg(F.count("*").alias("c")))
    upto = near.withColumn("upto", F.sum("c").over(Window.orderBy(F.col("v").asc_nulls_first())))
    position = (F.col("n") - 1) * F.lit(share)
    ends = upto.agg(
        F.min(F.when(F.col("upto") > F.floor(position), F.struct("upto", "v"))).alias("a"),
        F.min(F.when(F.col("upto") > F.ceil(position), F.struct("upto", "v"))).alias("z"),
        F.max(position - F.floor(position)).alias("part"))
    lower, upper = F.col("a.v"), F.col("z.v")
    return ends.select(lower + (upper - lower) * F.col("part")).scalar()


def exact_quantiles(df: DataFrame, keys: list[str], column: str, share: float, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, n, lower, upper) per group: the number of its non-null values, and the values at the two ranks around `share`.

    As in `exact_quantile`, with a sketch per group, however many groups: sketches combine before the shuffle, and so do the
    counts of equal values. What is ordered within a group is what lies between its bounds. Keys are not null; the bounds are
    joined as the planner finds best, which splits a group that is too large for a task."""
    values = df.select(*keys, F.col(column).alias("v")).filter("v IS NOT NULL")
    slack = 2.0 / accuracy
    bounds = values.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile_approx("v", max(share - slack, 0.0), accuracy).alias("low"),
        F.percentile_approx("v", min(share + slack, 1.0), accuracy).alias("high"))
    many = F.col("n") > accuracy
    under = many & (F.col("v") < F.col("low")) if share > slack else F.lit(False)
    over = many & (F.col("v") > F.col("high")) if share < 1.0 - slack else F.lit(False)
    near = (values.join(bounds, keys).filter(~over).groupBy(*keys, "n", F.when(~under, F.col("v")).alias("v"))
            .agg(F.count("*").alias("c")))
    upto = near.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())))
    position = (F.col("n") - 1) * F.lit(share)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return upto.groupBy(*keys, "n").agg(at(F.floor(position)).alias("lower"), at(F.ceil(position)).alias("upper"))


def nth_bound(df: DataFrame, column: str, skip: int, accuracy: int = ACCURACY) -> tuple[int, object]:
    """A value of a column without nulls that has at most `skip` values below it, and nearly as many: their number, and the value.
    One pass makes a sketch, one counts; nothing is sorted."""
    n = df.count()
    share = max(skip / n - 2.0 / accuracy, 0.0) if n else 0.0
    if share == 0.0:
        return 0, None
    value = df.agg(F.percentile_approx(column, share, accuracy)).first()[0]
    return df.filter(F.col(column) < value).count(), value
