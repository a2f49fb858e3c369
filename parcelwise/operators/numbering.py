"""Consecutive numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT_ROWS = 200_000


def number_sales(sales: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add sale_number: 1, 2, ... per property in order of (contract_date, id), NULL dates first.

    A property may hold a large share of all sales, so no task sorts a whole property. Sales are
    counted per property, day and slot, a slot being a range of ids that holds about `slot_rows`
    sales. Windows then run over a property's days, over the slots of one day, and over the sales of
    one slot; what was counted before is added up.
    """
    ids = sales.agg(F.struct(
        F.min("id").alias("low"),
        F.ceil((F.max("id") - F.min("id") + 1.0) / F.ceil(F.count("*") / slot_rows)).alias("width"))).scalar()
    no_day = F.lit(-(1 << 31))
    placed = (sales.withColumn("_ids", ids)
              .withColumn("_slot", F.floor((F.col("id") - F.col("_ids.low")) / F.col("_ids.width")))
              .withColumn("_day", F.coalesce(F.unix_date("contract_date"), no_day)).drop("_ids"))

    def before(keys: list[str], order: str):
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    slots = placed.groupBy("property_id", "_day", "_slot").agg(F.count("*").alias("n"))
    days = (slots.groupBy("property_id", "_day").agg(F.sum("n").alias("n"))
            .select("property_id", "_day", before(["property_id"], "_day").alias("before_day")))
    counted = _join(slots.select("property_id", "_day", "_slot",
                                 before(["property_id", "_day"], "_slot").alias("before_slot")),
                    days, ["property_id", "_day"])
    within = F.row_number().over(Window.partitionBy("property_id", "_day", "_slot").orderBy("id"))
    return (_join(placed, counted, ["property_id", "_day", "_slot"])
            .withColumn("sale_number", F.col("before_day") + F.col("before_slot") + within)
            .select(*sales.columns, "sale_number"))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    # property_id, the first key, may be NULL and is compared NULL-safely; the others never are.
    renamed = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    first, *others = keys
    same = [F.col(first).eqNullSafe(F.col(f"_r{first}")), *[F.col(k) == F.col(f"_r{k}") for k in others]]
    return left.join(renamed, same).drop(*[f"_r{k}" for k in keys])


def latest_sales(sales: DataFrame) -> DataFrame:
    """The last sale of every property by (contract_date, id); a NULL date ranks lowest. Each task
    keeps one sale per property before the shuffle."""
    order = Window.partitionBy("property_id").orderBy(F.col("contract_date").desc_nulls_last(), F.col("id").desc())
    return sales.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
