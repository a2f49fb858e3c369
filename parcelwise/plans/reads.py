"""The read surface: every query takes DataFrames and returns one."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display, text
from ..functions.mean import exact_mean
from ..operators import quantile, spatial
from ..operators.filters import between_dates, in_year, matching
from ..operators.numbering import latest_sales

DEFAULT_YEAR = 2024

RESPONSE_COLUMNS = [
    "id", "district_code", "property_id", "property_name", "property_unit_number",
    "property_house_number", "property_street_name", "property_locality", "property_post_code",
    "area", "area_type", "contract_date", "settlement_date", "purchase_price", "zoning",
    "nature_of_property", "primary_purpose", "latitude", "longitude", "cagr", "total_growth",
    "years_held", "nearest_station", "distance_to_station", "realestate_url", "domain_url",
]
GROWTH_COLUMNS = ["property_id", "cagr", "total_growth", "years_held"]

#: A page of up to so many sales is held by the driver while growth and stations are looked up.
HELD_ROWS = 1_000
#: Rows that may be skipped by sorting them.
SHALLOW_SKIP = 10_000


# --- sales ---------------------------------------------------------------------------------------

def sales_list(sales: DataFrame, growth: DataFrame, stations: DataFrame, skip: int = 0, limit: int = 100,
               min_growth: float | None = None, **filters) -> DataFrame:
    """A page of sales, latest contract first, with growth and the nearest station.

    `min_growth` is in percent and, unlike the other bounds, applies at 0 too. The page is cut as early as the filters allow:
    a page of up to HELD_ROWS rows is fetched once, and growth is then read for its properties alone. A deep page is found by
    way of the numbers of sales per day (see `_from_rank`). A negative limit means no limit, a negative skip none skipped.
    """
    growth = growth.select(*GROWTH_COLUMNS)
    rows = matching(sales, **filters)
    if min_growth is not None:
        rows = rows.join(growth.filter(F.col("cagr") >= min_growth / 100.0), "property_id")
    order = [F.col("contract_date").desc_nulls_last(), F.col("id")]
    if skip > SHALLOW_SKIP:
        rows, skip = _from_rank(rows, skip, limit)
    rows = rows.orderBy(*order)
    if skip > 0:
        rows = rows.offset(skip)
    if limit >= 0:
        rows = rows.limit(limit)
    if 0 <= limit <= HELD_ROWS:
        rows = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    if min_growth is None:
        if 0 <= limit <= HELD_ROWS:
            growth = growth.filter(F.col("property_id").isin([r[0] for r in rows.select("property_id").distinct().collect()]))
        rows = rows.join(growth, "property_id", "left").orderBy(*order)
    return spatial.with_nearest_station(rows, stations).select(*RESPONSE_COLUMNS)


def _from_rank(rows: DataFrame, skip: int, limit: int) -> tuple[DataFrame, int]:
    """Rows from shortly before the rank `skip` on (latest contract first, then by id) to the page's end, and how many are left to skip.

    Sales are counted per day, which gives the days of the page: a date range that files are pruned by. Of the first day, ids
    before the rank are left out by way of a sketch. So what is sorted is the page's days, less what is skipped."""
    days = rows.groupBy("contract_date").agg(F.count("*").alias("n"))  # a row per day
    upto = F.sum("n").over(Window.orderBy(F.col("contract_date").desc_nulls_last()))
    last = skip + limit if limit >= 0 else None
    ends = days.withColumn("upto", upto).filter(F.col("upto") > skip)
    if last is not None:
        ends = ends.filter(F.col("upto") - F.col("n") < last)
    page = ends.orderBy("upto").agg(
        F.min(F.struct("upto", "n", "contract_date")).alias("first"), F.max(F.struct("upto", "contract_date")).alias("last")).first()
    if page["first"] is None:
        return rows.limit(0), 0
    day, end = page["first"]["contract_date"], page["last"]["contract_date"]
    skip -= page["first"]["upto"] - page["first"]["n"]
    date_of = F.col("contract_date")
    if day is None:
        rows = rows.filter(date_of.isNull())
    else:
        until = date_of >= F.lit(end) if end is not None else F.lit(True)
        rows = rows.filter(((date_of <= F.lit(day)) & until) | (date_of.isNull() if end is None else F.lit(False)))
    if skip > SHALLOW_SKIP:
        of_day = date_of.eqNullSafe(F.lit(day))
        below, value = quantile.nth_bound(rows.filter(of_day).select("id"), "id", skip)
        if below:
            rows, skip = rows.filter(~of_day | (F.col("id") >= value)), skip - below
    return rows, skip


def property_history(sales: DataFrame, growth: DataFrame, stations: DataFrame, property_id: str) -> DataFrame:
    """All sales of one property, earliest first, numbered; empty for an unknown id."""
    order = Window.partitionBy("property_id").orderBy(F.col("contract_date").asc_nulls_first(), "id")
    rows = sales.filter(F.col("property_id") == property_id).withColumn("sale_number", F.row_number().over(order).cast("bigint"))
    figures = (growth.filter(F.col("property_id") == property_id)
               .agg(F.first(F.struct(*GROWTH_COLUMNS[1:]))).scalar())
    rows = rows.withColumn("_g", figures).select("*", *[f"_g.{c}" for c in GROWTH_COLUMNS[1:]])
    return (spatial.with_nearest_station(rows, stations).select("sale_number", *RESPONSE_COLUMNS)
            .orderBy("sale_number"))


def history_links(history: DataFrame) -> DataFrame:
    """Links of each sale of a history, falling back on those of its first sale."""
    first = history.filter("sale_number = 1").agg(F.first(F.struct("realestate_url", "domain_url"))).scalar()
    return history.withColumn("_f", first).withColumns(
        {c: F.coalesce(F.nullif(c, F.lit("")), F.col(f"_f.{c}")) for c in ("realestate_url", "domain_url")}
    ).drop("_f")


def monthly_price(sales: DataFrame, start_date: date | str | None = None,
                  end_date: date | str | None = None) -> DataFrame:
    """Mean price and number of sales per month. Prices that are no numbers count as missing."""
    return (between_dates(sales, start_date, end_date).filter("contract_date IS NOT NULL")
            .groupBy(F.date_format("contract_date", "yyyy-MM").alias("month"))
            .agg(exact_mean("purchase_price").alias("avg_price"), F.count("id").alias("count"))
            .orderBy("month"))


def monthly_median_price(sales: DataFrame, start_date: date | str | None = None,
                         end_date: date | str | None = None) -> DataFrame:
    """Median price per month, exact: the middle price, or the mean of the two in the middle. No task orders a month's prices, only
    those close to its middle (see quantile.exact_quantiles)."""
    prices = (between_dates(sales, start_date, end_date).filter("contract_date IS NOT NULL AND NOT isnan(purchase_price)")
              .select(F.date_format("contract_date", "yyyy-MM").alias("month"), "purchase_price"))
    found = quantile.exact_quantiles(prices, ["month"], "purchase_price", 0.5)
    return found.select("month", ((F.col("lower") + F.col("upper")) / 2).alias("median_price"), F.col("n").alias("count")).orderBy("month")


def top_suburbs(sales: DataFrame, limit: int = 10, start_date: date | str | None = None,
                end_date: date | str | None = None) -> DataFrame:
    """Suburbs with the most sales; sales without a suburb form a group of their own."""
    return (between_dates(sales, start_date, end_date)
            .groupBy(F.col("property_locality").alias("suburb"))
            .agg(F.count("id").alias("count"), exact_mean("purchase_price").alias("avg_price"))
            .orderBy(F.desc("count"), "suburb").limit(limit))


# --- growth --------------------------------------------------------------------------------------

def _lookup(found: DataFrame, keys: dict) -> DataFrame:
    """The looked-up figures, or NULL and 0 beside the keys asked for; always one row."""
    row = found.agg(F.first("avg_cagr").alias("avg_cagr"), F.first("property_count").alias("n"))
    return row.select(*[F.lit(v).alias(k) for k, v in keys.items()], "avg_cagr",
                      F.coalesce("n", F.lit(0)).cast("bigint").alias("property_count"))


def suburb_cagr(suburb_growth: DataFrame, suburb: str, year: int = DEFAULT_YEAR) -> DataFrame:
    found = suburb_growth.filter((F.col("suburb") == suburb) & (F.col("year") == year))
    return _lookup(found, {"suburb": suburb, "year": year})


def _over_postcodes(street_growth: DataFrame, keys: list[str]) -> DataFrame:
    """Street averages over several postcodes, weighted by their property counts."""
    rated = F.when(F.col("avg_cagr").isNotNull(), F.col("property_count"))
    return street_growth.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("avg_cagr") * F.col("property_count")), F.sum(rated)).alias("avg_cagr"),
        F.sum("property_count").alias("property_count"))


def street_cagr(street_growth: DataFrame, street_name: str, suburb: str, year: int = DEFAULT_YEAR) -> DataFrame:
    found = street_growth.filter((F.col("street_name") == street_name) & (F.col("suburb") == suburb)
                                 & (F.col("year") == year))
    return _lookup(_over_postcodes(found, ["year"]),
                   {"street_name": street_name, "suburb": suburb, "year": year})


def street_trend(street_growth: DataFrame, street_name: str, suburb: str) -> DataFrame:
    """One row per postcode and year."""
    return (street_growth.filter((F.col("street_name") == street_name) & (F.col("suburb") == suburb))
            .orderBy("year", "post_code").select("year", "avg_cagr", "property_count"))


def suburb_trend(suburb_growth: DataFrame, suburb: str) -> DataFrame:
    return (suburb_growth.filter(F.col("suburb") == suburb).orderBy("year")
            .select("year", "avg_cagr", "property_count"))


def _best(df: DataFrame, names: list[str], k: int) -> DataFrame:
    return df.orderBy(F.col("avg_cagr").desc_nulls_last(), *names).limit(k)


def _best_streets(df: DataFrame, k: int) -> DataFrame:
    return _best(df, ["street_name", "suburb", "post_code"], k)


def global_top_suburbs(suburb_summary: DataFrame, k: int = 5) -> DataFrame:
    return _best(suburb_summary, ["suburb"], k).select("suburb", "avg_cagr", "unique_properties", "total_sales")


def global_top_streets(street_summary: DataFrame, k: int = 5) -> DataFrame:
    return _best_streets(street_summary, k).select("street_name", "suburb", "avg_cagr", "total_sales")


def top_growth_suburbs(suburb_growth: DataFrame, year: int = DEFAULT_YEAR, k: int = 10) -> DataFrame:
    return (_best(suburb_growth.filter(F.col("year") == year), ["suburb"], k)
            .select("suburb", "avg_cagr", "property_count"))


def top_growth_streets(street_growth: DataFrame, year: int = DEFAULT_YEAR, k: int = 10) -> DataFrame:
    return (_best_streets(street_growth.filter(F.col("year") == year), k)
            .select("street_name", "suburb", "avg_cagr", "property_count"))


def _activity(sales: DataFrame, year: int, property_type: str | None, keys: list, k: int) -> DataFrame:
    return (matching(in_year(sales, year), property_type=property_type)
            .groupBy(*keys).agg(F.count("id").alias("sales_count"))
            .orderBy(F.desc("sales_count"), *reversed(keys)).limit(k))


def activity_suburbs(sales: DataFrame, year: int = DEFAULT_YEAR, property_type: str | None = None,
                     k: int = 10) -> DataFrame:
    renamed = sales.withColumnRenamed("property_locality", "suburb")
    return _activity(renamed, year, property_type, ["suburb"], k)


def activity_streets(sales: DataFrame, year: int = DEFAULT_YEAR, property_type: str | None = None,
                     k: int = 10) -> DataFrame:
    renamed = sales.withColumnsRenamed({"property_street_name": "street_name", "property_locality": "suburb"})
    return _activity(renamed, year, property_type, ["street_name", "suburb"], k)


SUBURB_ORDER = ["-avg_cagr", "suburb"]
STREET_ORDER = ["-avg_cagr", "street_name", "suburb", "post_code"]


def _listed(best: DataFrame, order: list[str], columns: list[str]):
    """A short, already limited list as one array value in `order` (- for descending), which may use further columns."""
    by = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c) for c in order]
    ranked = best.withColumn("_rank", F.row_number().over(Window.orderBy(*by)))
    rows = ranked.agg(F.sort_array(F.collect_list(F.struct("_rank", *columns))).alias("rows"))
    return rows.select(F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias("rows")).scalar()


def global_summary(suburb_summary: DataFrame, street_summary: DataFrame, k: int = 5) -> DataFrame:
    """Both top-5 lists as one nested row, in the order of the flat lists."""
    return suburb_summary.sparkSession.range(1).select(
        _listed(_best(suburb_summary, ["suburb"], k), SUBURB_ORDER,
                ["suburb", "avg_cagr", "unique_properties", "total_sales"]).alias("top_suburbs"),
        _listed(_best_streets(street_summary, k), STREET_ORDER,
                ["street_name", "suburb", "avg_cagr", "total_sales"]).alias("top_streets"))


def top_performers(sales: DataFrame, suburb_growth: DataFrame, street_growth: DataFrame,
                   year: int = DEFAULT_YEAR, property_type: str | None = None, k: int = 10) -> DataFrame:
    """Growth and activity lists of a year as one nested row; the type filter is for activity only."""
    of_year = F.col("year") == year
    return sales.sparkSession.range(1).select(
        F.struct(_listed(_best(suburb_growth.filter(of_year), ["suburb"], k), SUBURB_ORDER,
                         ["suburb", "avg_cagr", "property_count"]).alias("suburbs"),
                 _listed(_best_streets(street_growth.filter(of_year), k), STREET_ORDER,
                         ["street_name", "suburb", "avg_cagr", "property_count"]).alias("streets")).alias("growth"),
        F.struct(_listed(activity_suburbs(sales, year, property_type, k), ["-sales_count", "suburb"],
                         ["suburb", "sales_count"]).alias("suburbs"),
                 _listed(activity_streets(sales, year, property_type, k), ["-sales_count", "suburb", "street_name"],
                         ["street_name", "suburb", "sales_count"]).alias("streets")).alias("activity"))


def growth_chart(leaders: DataFrame, name: str, k: int = 5) -> DataFrame:
    """Bars of the growth chart: first word of the name and percent with one place."""
    return (leaders.orderBy(F.col("avg_cagr").desc_nulls_last(), name).limit(k)
            .select(display.first_word(F.col(name)).alias("name"),
                    display.percent(F.col("avg_cagr"), 1).alias("value"), F.col(name).alias("full_name")))


def activity_chart(leaders: DataFrame, name: str, k: int = 5) -> DataFrame:
    """Bars of the activity chart: sales, or properties where no sales count is given."""
    counts = [F.col(c) for c in ("sales_count", "property_count") if c in leaders.columns]
    value = display.first_count(*counts)
    return (leaders.orderBy(value.desc_nulls_last(), name).limit(k)
            .select(display.first_word(F.col(name)).alias("name"), value.alias("value"),
                    F.col(name).alias("full_name")))


# --- space ---------------------------------------------------------------------------------------

def suburb_centroids(sales: DataFrame) -> DataFrame:
    return spatial.centroids(sales, spatial.SUBURB)


def street_centroids(sales: DataFrame) -> DataFrame:
    return spatial.centroids(sales, spatial.STREET)


def first_postcode(street_summary: DataFrame) -> DataFrame:
    """One summary per (street, suburb): that of its lowest postcode."""
    rest = [c for c in street_summary.columns if c not in ("street_name", "suburb")]
    return (street_summary.groupBy("street_name", "suburb")
            .agg(F.min_by(F.struct(*rest), "post_code").alias("s")).select("street_name", "suburb", "s.*"))


def neighbor_suburbs(centroids: DataFrame, suburb_summary: DataFrame, suburb: str, k: int = 10) -> DataFrame:
    """The nearest suburbs that have a summary, nearest first."""
    near = spatial.nearest_entities(centroids, spatial.SUBURB, [suburb], k)
    return (near.join(suburb_summary, "suburb").orderBy("dist", "suburb")
            .select("suburb", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                    "avg_cagr", "total_sales", "unique_properties"))


def neighbor_streets(centroids: DataFrame, street_summary: DataFrame, street_name: str, suburb: str,
                     candidates: int = 20, k: int = 15, fallback: bool = False) -> DataFrame:
    """The first k of the nearest streets that have a summary. With `fallback`, a street without a
    position gets up to ten streets of its suburb, without positions."""
    near = spatial.nearest_entities(centroids, spatial.STREET, [street_name, suburb], candidates)
    found = (near.join(first_postcode(street_summary), ["street_name", "suburb"])
             .orderBy("dist", "suburb", "street_name").limit(k)
             .select("street_name", "suburb", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                     "avg_cagr", "total_sales"))
    if not fallback:
        return found
    positioned = (centroids.filter((F.col("street_name") == street_name) & (F.col("suburb") == suburb)
                                   & (F.col("lat") != 0.0)).agg(F.count("*")).scalar())
    same_suburb = (first_postcode(street_summary)
                   .filter((F.col("suburb") == suburb) & (F.col("street_name") != street_name))
                   .filter(positioned == 0).orderBy("street_name").limit(10)
                   .select("street_name", "suburb", F.lit(None).cast("double").alias("latitude"),
                           F.lit(None).cast("double").alias("longitude"), "avg_cagr", "total_sales"))
    return found.unionByName(same_suburb)


def neighbor_properties(sales: DataFrame, growth: DataFrame, property_id: str, k: int = 20,
                        distinct_property: bool = False) -> DataFrame:
    """The nearest sales of other repeat-sale properties; a property may show with several sales."""
    near = spatial.nearest_sales(sales, growth, property_id, k, distinct_property)
    return near.select(
        "id", "property_id",
        text.street_address(F.col("property_house_number"), F.col("property_street_name")).alias("address"),
        F.col("property_locality").alias("suburb"), "latitude", "longitude",
        F.col("cagr").alias("avg_cagr"), F.col("purchase_price").alias("last_price"))


def _map_targets(leaders: DataFrame, centroids: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked leaders with their position. Ranks are given before leaders without one drop out."""
    names = [c for c in ("street_name", "suburb", "post_code") if c in leaders.columns]
    order = Window.orderBy(F.col("avg_cagr").desc_nulls_last(), *names)
    return (leaders.withColumn("rank", F.row_number().over(order))
            .join(centroids, keys).filter("lat <> 0.0")
            .select("rank", *keys, "lat", "lon", F.col("avg_cagr").alias("cagr")))


def _map_rows(targets: DataFrame, centroids: DataFrame, summary: DataFrame, keys: list[str], k: int) -> DataFrame:
    near = (spatial.nearest_to_targets(centroids, targets, keys, k).join(summary, keys)
            .select("rank", "neighbor_rank", *[F.col(c).alias(f"neighbor_{c}") for c in keys],
                    F.col("lat").alias("neighbor_lat"), F.col("lon").alias("neighbor_lon"),
                    F.col("avg_cagr").alias("neighbor_cagr")))
    return targets.join(near, "rank", "left")


def unified_map_suburbs(suburb_growth: DataFrame, centroids: DataFrame, suburb_summary: DataFrame,
                        year: int = DEFAULT_YEAR, top: int = 10, k: int = 5) -> DataFrame:
    """Flat map data: one row per leading suburb and neighbour, one without neighbour if it has none."""
    leaders = _best(suburb_growth.filter(F.col("year") == year), ["suburb"], top)
    targets = _map_targets(leaders, centroids, ["suburb"])
    rows = _map_rows(targets, centroids, suburb_summary, ["suburb"], k)
    return rows.select("rank", F.col("suburb").alias("id"), F.col("suburb").alias("name"), "lat", "lon", "cagr",
                       "neighbor_rank", F.col("neighbor_suburb").alias("neighbor_name"),
                       "neighbor_lat", "neighbor_lon", "neighbor_cagr")


def unified_map_streets(street_growth: DataFrame, centroids: DataFrame, street_summary: DataFrame,
                        year: int = DEFAULT_YEAR, top: int = 10, k: int = 5) -> DataFrame:
    """As for suburbs, for streets."""
    leaders = _best_streets(street_growth.filter(F.col("year") == year), top)
    targets = _map_targets(leaders, centroids, spatial.STREET)
    rows = _map_rows(targets, centroids, first_postcode(street_summary), spatial.STREET, k)
    street, suburb = F.col("street_name"), F.col("suburb")
    near_street, near_suburb = F.col("neighbor_street_name"), F.col("neighbor_suburb")
    return rows.select("rank", display.entity_id(street, suburb).alias("id"),
                       display.entity_label(street, suburb).alias("name"), "lat", "lon", "cagr",
                       "neighbor_rank", display.entity_label(near_street, near_suburb).alias("neighbor_name"),
                       "neighbor_lat", "neighbor_lon", "neighbor_cagr")


def unified_map(level: str, growth: DataFrame, centroids: DataFrame, summary: DataFrame, year: int = DEFAULT_YEAR,
                top: int = 10, k: int = 5) -> DataFrame:
    """Map data of a level, `suburb` or `street`, from that level's tables; no rows for any other level."""
    if level == "street":
        return unified_map_streets(growth, centroids, summary, year, top, k)
    rows = unified_map_suburbs(growth, centroids, summary, year, top, k)
    return rows if level == "suburb" else rows.limit(0)


def map_clusters(flat: DataFrame) -> DataFrame:
    """Map data with the neighbours nested in their cluster (at most five each)."""
    neighbor = F.when(F.col("neighbor_name").isNotNull(), F.struct(
        "neighbor_rank", F.col("neighbor_name").alias("name"), F.col("neighbor_lat").alias("lat"),
        F.col("neighbor_lon").alias("lon"), F.col("neighbor_cagr").alias("cagr")))
    return (flat.groupBy("rank", "id", "name", "lat", "lon", "cagr")
            .agg(F.array_sort(F.collect_list(neighbor)).alias("neighbors")).orderBy("rank"))


# --- comparison ----------------------------------------------------------------------------------

def property_comparison(sales: DataFrame, growth: DataFrame, street_growth: DataFrame,
                        suburb_growth: DataFrame, year: int = DEFAULT_YEAR,
                        property_id: str | None = None) -> DataFrame:
    """Each property's growth (or one property's) against its street's and suburb's of a year, by the
    address of its latest sale."""
    if property_id is not None:
        sales = sales.filter(F.col("property_id") == property_id)
        growth = growth.filter(F.col("property_id") == property_id)
    place = latest_sales(sales.select("property_id", "contract_date", "id", F.col("property_street_name").alias("street_name"),
                                      F.col("property_locality").alias("suburb")))
    streets = (_over_postcodes(street_growth.filter(F.col("year") == year), ["street_name", "suburb"])
               .withColumnsRenamed({"avg_cagr": "street_avg", "property_count": "street_count"}))
    suburbs = (suburb_growth.filter(F.col("year") == year)
               .select("suburb", F.col("avg_cagr").alias("suburb_avg"), F.col("property_count").alias("suburb_count")))
    return (place.join(growth.select("property_id", "cagr", "years_held"), "property_id", "left")
            .join(streets, ["street_name", "suburb"], "left").join(suburbs, "suburb", "left")
            .select("property_id", "street_name", "suburb", "cagr", "years_held", "street_avg",
                    F.coalesce("street_count", F.lit(0)).alias("street_count"), "suburb_avg",
                    F.coalesce("suburb_count", F.lit(0)).alias("suburb_count"),
                    display.comparison_label(F.col("cagr"), F.col("street_avg"), F.col("suburb_avg")).alias("label")))
