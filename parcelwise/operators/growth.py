"""Repeat-sale growth per property and its averages per street and suburb.

Every step is a grouped aggregate whose map side combines first, so a property, street or suburb
holding a large share of the sales reaches its reducer as a few partial rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import growth as fn
from .quantile import exact_quantile

START_YEAR = 2001
TOP_SHARE = 0.9

STREET = ["street_name", "suburb", "post_code"]
SUBURB = ["suburb"]


def valid_sales(sales: DataFrame) -> DataFrame:
    """Sales with a contract date and a price that is a number."""
    return sales.filter(F.col("contract_date").isNotNull() & F.col("purchase_price").isNotNull()
                        & ~F.isnan("purchase_price"))


PLACE = ["property_street_name", "property_locality", "property_post_code"]


def _order() -> Column:
    """The order of a property's sales, by date and then id (none: first), as one number of fixed width."""
    day = F.unix_date("contract_date").cast("decimal(10,0)") * F.lit(Decimal(1 << 64))
    return day + F.coalesce("id", F.lit(-(1 << 63))).cast("decimal(20,0)")


def property_spans(sales: DataFrame) -> DataFrame:
    """The one pass over sales: per property and address the number of valid sales and the first and the last of them. Both the
    growth figures and the summaries are read from it. All that is aggregated has a fixed width, so that it is hashed in
    place; the spans of more sales are merged into it (merged_spans)."""
    sales = valid_sales(sales).withColumn("_order", _order())
    return sales.groupBy("property_id", *PLACE).agg(
        F.count("*").alias("n"), F.count("id").alias("ids"),
        F.min("_order").alias("f_order"), F.min("contract_date").alias("f_date"), F.min_by("purchase_price", "_order").alias("f_price"),
        F.max("_order").alias("l_order"), F.max("contract_date").alias("l_date"), F.max_by("purchase_price", "_order").alias("l_price"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """Spans of all sales from spans of some."""
    return spans.groupBy("property_id", *PLACE).agg(
        F.sum("n").alias("n"), F.sum("ids").alias("ids"),
        F.min_by("f_date", "f_order").alias("f_date"), F.min_by("f_price", "f_order").alias("f_price"), F.min("f_order").alias("f_order"),
        F.max_by("l_date", "l_order").alias("l_date"), F.max_by("l_price", "l_order").alias("l_price"), F.max("l_order").alias("l_order"))


def repeat_sales(sales: DataFrame) -> DataFrame:
    return repeat_sales_of(property_spans(sales))


def repeat_sales_of(spans: DataFrame) -> DataFrame:
    """One row per property with two or more valid sales: growth figures, the address of its first
    sale, the year of its last, and how many there are. Same-day sales are ordered by id."""
    ends = (spans.filter(F.col("property_id").isNotNull()).groupBy("property_id")
            .agg(F.sum("n").alias("sales"), F.min(F.struct("f_order", "f_date", "f_price", *PLACE)).alias("f"),
                 F.max(F.struct("l_order", "l_date", "l_price")).alias("l"))
            .filter(F.col("sales") >= 2))
    first_price, last_price = F.col("f.f_price"), F.col("l.l_price")
    return (ends.withColumn("years_held", fn.years_held(F.col("f.f_date"), F.col("l.l_date")))
            .select("property_id",
                    fn.cagr(first_price, last_price, F.col("years_held")).alias("cagr"),
                    fn.total_growth(first_price, last_price).alias("total_growth"),
                    "years_held",
                    last_price.alias("last_sale_price"),
                    first_price.alias("first_sale_price"),
                    F.year("l.l_date").alias("last_sale_year"),
                    F.col("f.property_street_name").alias("street_name"),
                    F.col("f.property_locality").alias("suburb"),
                    F.coalesce("f.property_post_code", F.lit(0)).alias("post_code"),
                    "sales"))


FIGURES = ["cagr", "total_growth", "years_held", "last_sale_price", "first_sale_price"]


def property_growth(repeats: DataFrame) -> DataFrame:
    return repeats.select("property_id", *FIGURES)


def latest_growth(rows: DataFrame) -> DataFrame:
    """Growth per property from rows of several states of it: those after the most `sales` hold."""
    return rows.groupBy("property_id").agg(*[F.max_by(c, "sales").alias(c) for c in FIGURES])


def growth_cube(repeats: DataFrame, end_year: int | None = None) -> DataFrame:
    """Growth totals per street and last active year (up to `end_year`, if given): the small table that the per-year and the
    all-time averages are both read from."""
    year = F.col("last_sale_year") if end_year is None else F.least("last_sale_year", F.lit(end_year))
    return (repeats.withColumn("active_to", year)
            .groupBy(*STREET, "active_to")
            .agg(F.sum("cagr").alias("cagr_sum"), F.count("cagr").alias("cagr_n"),
                 F.count("*").alias("properties")))


def summed(added: DataFrame, taken: DataFrame | None, keys: list[str]) -> DataFrame:
    """Totals (all columns but `keys`) with others added and taken away; what comes to nothing goes."""
    totals = [c for c in added.columns if c not in keys]
    if taken is not None:
        added = added.unionByName(taken.select(*keys, *[(-F.col(c)).alias(c) for c in totals]))
    return added.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in totals])


def _totals(cube: DataFrame, keys: list[str]) -> DataFrame:
    return (cube.dropna(subset=[k for k in keys if k != "year"]).groupBy(*keys)
            .agg(F.try_divide(F.sum("cagr_sum"), F.sum("cagr_n")).alias("avg_cagr"),
                 F.sum("properties").alias("property_count")))


def _by_year(cube: DataFrame, keys: list[str], start_year: int) -> DataFrame:
    # A property counts in every year up to its last sale. Years are spread over the grouped totals,
    # never over the properties.
    active = cube.filter(F.col("active_to") >= start_year)
    years = F.explode(F.sequence(F.lit(start_year), F.col("active_to")))
    return _totals(active.withColumn("year", years), [*keys, "year"])


def street_growth(cube: DataFrame, start_year: int = START_YEAR) -> DataFrame:
    return _by_year(cube, STREET, start_year)


def suburb_growth(cube: DataFrame, start_year: int = START_YEAR) -> DataFrame:
    per_suburb = cube.groupBy("suburb", "active_to").agg(
        *[F.sum(c).alias(c) for c in ("cagr_sum", "cagr_n", "properties")])
    return _by_year(per_suburb, SUBURB, start_year)


def place_counts(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct properties and sales per street or suburb; streets without a postcode are left out. Properties are counted by way
    of one row per key and property, so that a key with very many is no single task's. For streets `spans`, which have one
    row per property and address, are these rows already."""
    pairs = _by_place(spans, keys) if keys == STREET else place_properties(spans, keys)
    return pairs.groupBy(*keys).agg(F.count("property_id").alias("unique_properties"), F.sum("ids").alias("total_sales"))


def more_place_counts(counts: DataFrame, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts after spans of `new` sales; `old` are the spans, before these, of the properties that they are of."""
    known = place_properties(old, keys).select(*keys, "property_id", F.lit(1).alias("known"))
    is_new = F.col("property_id").isNotNull() & F.col("known").isNull()
    more = place_properties(new, keys).join(known, [*keys, "property_id"], "left").groupBy(*keys).agg(
        F.sum(is_new.cast("bigint")).alias("unique_properties"), F.sum("ids").alias("total_sales"))
    return summed(counts.unionByName(more), None, keys)


def _by_place(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.withColumnsRenamed(dict(zip(PLACE, STREET))).dropna(subset=keys)


def place_properties(spans: DataFrame, keys: list[str]) -> DataFrame:
    return _by_place(spans, keys).groupBy(*keys, "property_id").agg(F.sum("ids").alias("ids"))


def rated(counts: DataFrame, cube: DataFrame, keys: list[str]) -> DataFrame:
    """All-time figures per street or suburb."""
    return counts.join(_totals(cube, keys).drop("property_count"), keys, "left")


def with_top_flag(rated: DataFrame) -> DataFrame:
    """Mark the entities whose average reaches the 0.9 quantile of all averages."""
    threshold = F.coalesce(exact_quantile(rated, "avg_cagr", TOP_SHARE), F.lit(0.0))
    return rated.withColumn("is_top_performer",
                            F.coalesce(F.col("avg_cagr") >= threshold, F.lit(False)).cast("int"))


def street_summary(sales: DataFrame, cube: DataFrame) -> DataFrame:
    return with_top_flag(rated(place_counts(property_spans(sales), STREET), cube, STREET))


def suburb_summary(sales: DataFrame, cube: DataFrame) -> DataFrame:
    return with_top_flag(rated(place_counts(property_spans(sales), SUBURB), cube, SUBURB))
