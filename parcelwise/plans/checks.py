"""Checks of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display, growth as fn
from ..operators.growth import repeat_sales


def reconcile_growth(stored: DataFrame, sales: DataFrame) -> DataFrame:
    """Stored against recomputed growth of every property; a property on one side only fails."""
    computed = repeat_sales(sales).select("property_id", F.col("cagr").alias("computed_cagr"))
    both = stored.select("property_id", F.col("cagr").alias("stored_cagr")).join(computed, "property_id", "full")
    status = F.when(F.col("stored_cagr").isNull() & F.col("computed_cagr").isNull(), "PASS").otherwise(
        fn.reconcile_status(F.col("stored_cagr"), F.col("computed_cagr")))
    return both.withColumn("status", status)


def completeness(sales: DataFrame) -> DataFrame:
    """How many sales lack coordinates or were never checked for listings."""
    def share(part):
        return F.coalesce(display.percent(F.try_divide(F.col(part).cast("double"), F.col("total")), 1), F.lit(0.0))

    counts = sales.agg(F.count("*").alias("total"),
                       F.count_if(F.col("latitude").isNull()).alias("missing_coords"),
                       F.count_if(F.col("listings_last_checked").isNull()).alias("missing_listings"))
    return counts.select("*", share("missing_coords").alias("missing_coords_pct"),
                         share("missing_listings").alias("missing_listings_pct"))


def derived_counts(street_growth: DataFrame, suburb_growth: DataFrame, street_summary: DataFrame,
                   suburb_summary: DataFrame) -> DataFrame:
    """Rows of the derived tables and the suburb with the highest average growth."""
    best = (suburb_summary.orderBy(F.col("avg_cagr").desc_nulls_last(), "suburb").limit(1)
            .agg(F.first(F.struct("suburb", "avg_cagr", "unique_properties", "total_sales"))).scalar())
    counted = [(street_growth, "street_years"), (suburb_growth, "suburb_years"),
               (street_summary, "streets"), (suburb_summary, "suburbs")]
    return suburb_summary.sparkSession.range(1).select(
        *[df.agg(F.count("*")).scalar().alias(name) for df, name in counted], best.alias("best")).select(
        *[name for _, name in counted], F.col("best.suburb").alias("top_suburb"),
        display.percent(F.col("best.avg_cagr"), 2).alias("top_avg_cagr_pct"),
        F.col("best.unique_properties").alias("top_properties"), F.col("best.total_sales").alias("top_sales"))


def coordinate_sample(sales: DataFrame, n: int = 5) -> DataFrame:
    """A few sales that have coordinates."""
    return (sales.filter("latitude IS NOT NULL").orderBy("id").limit(n)
            .select("id", "property_house_number", "property_street_name", "property_locality",
                    "latitude", "longitude"))
