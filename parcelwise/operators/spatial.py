"""Centroids, nearest suburbs, streets and sales, nearest station."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.mean import exact_parts, mean_of
from . import station_tree

#: Stations that may travel with the search function.
MAX_INLINE_STATIONS = 5_000
LAST = (1 << 63) - 1

SUBURB = ["suburb"]
STREET = ["street_name", "suburb"]


def place_sums(sales: DataFrame) -> DataFrame:
    """Exact sums and numbers of coordinates per (street, suburb), over sales with a latitude."""
    return (sales.filter("latitude IS NOT NULL")
            .withColumnsRenamed({"property_street_name": "street_name", "property_locality": "suburb"})
            .groupBy(*STREET)
            .agg(*[part.alias(f"{name}_{kind}") for name, column in (("lat", "latitude"), ("lon", "longitude"))
                   for kind, part in exact_parts(column).items()]))


def centroids_of(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean position per suburb or per (street, suburb)."""
    return sums.groupBy(*keys).agg(*[
        mean_of(F.sum(f"{name}_sum"), F.sum(f"{name}_n")).alias(name) for name in ("lat", "lon")])


def centroids(sales: DataFrame, keys: list[str]) -> DataFrame:
    return centroids_of(place_sums(sales), keys)


def differs(keys: list[str], values: list[Column]) -> Column:
    """Any key differs from its value; rows where that cannot be told (NULL) do not qualify."""
    condition = F.col(keys[0]) != values[0]
    for key, value in zip(keys[1:], values[1:]):
        condition = condition | (F.col(key) != value)
    return condition


def nearest_entities(points: DataFrame, keys: list[str], values: list[str], k: int) -> DataFrame:
    """The k entities closest to the one named by `values`; empty if that one has no position."""
    named = [F.lit(v) for v in values]
    is_target = F.lit(True)
    for key, value in zip(keys, named):
        is_target = is_target & (F.col(key) == value)
    target = points.filter(is_target).agg(F.first(F.struct("lat", "lon"))).scalar()
    return (points.filter(differs(keys, named))
            .withColumn("t", target)
            .filter("t.lat <> 0.0")
            .withColumn("dist", geo.planar_sq(F.col("lat"), F.col("lon"), F.col("t.lat"), F.col("t.lon")))
            .drop("t")
            .orderBy(F.col("dist").asc_nulls_first(), *reversed(keys)).limit(k))


def nearest_to_targets(points: DataFrame, targets: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k closest entities for each of a handful of targets (a top-k list, so bounded).

    The targets travel as one small array; each entity is compared with each of them in place and
    only k rows per target and task are shuffled.
    """
    named = {key: f"target_{key}" for key in keys}
    listed = targets.agg(F.collect_list(F.struct(
        "rank", F.col("lat").alias("target_lat"), F.col("lon").alias("target_lon"),
        *[F.col(key).alias(name) for key, name in named.items()]))).scalar()
    pairs = (points.select("*", F.inline(listed))
             .filter(differs(keys, [F.col(name) for name in named.values()]))
             .withColumn("dist", geo.planar_sq(F.col("lat"), F.col("lon"), F.col("target_lat"), F.col("target_lon"))))
    order = Window.partitionBy("rank").orderBy(F.col("dist").asc_nulls_first(), *reversed(keys))
    return (pairs.withColumn("neighbor_rank", F.row_number().over(order))
            .filter(F.col("neighbor_rank") <= k)
            .select("rank", "neighbor_rank", *keys, "lat", "lon", "dist"))


def nearest_sales(sales: DataFrame, growth: DataFrame, property_id: str, k: int,
                  distinct_property: bool = False) -> DataFrame:
    """The k sales of other repeat-sale properties closest to a property's first located sale."""
    located = sales.filter("latitude IS NOT NULL")
    target = (located.filter(F.col("property_id") == property_id)
              .agg(F.min_by(F.struct("latitude", "longitude"), "id")).scalar())
    others = (located.filter(F.col("property_id") != property_id)
              .withColumn("t", target).filter("t IS NOT NULL")
              .withColumn("dist", geo.planar_sq(F.col("latitude"), F.col("longitude"),
                                                F.col("t.latitude"), F.col("t.longitude")))
              .join(growth.select("property_id", "cagr"), "property_id"))
    order = [F.col("dist").asc_nulls_first(), F.col("id")]
    if distinct_property:
        best = F.struct("dist", "id")
        columns = F.struct("dist", "id", "property_house_number", "property_street_name",
                           "property_locality", "latitude", "longitude", "cagr", "purchase_price")
        others = (others.groupBy("property_id").agg(F.min_by(columns, best).alias("s"))
                  .select("property_id", "s.*"))
    return others.orderBy(*order).limit(k)


def with_nearest_station(df: DataFrame, stations: DataFrame, max_inline: int = MAX_INLINE_STATIONS) -> DataFrame:
    """Add nearest_station and distance_to_station; NULL without coordinates or stations.

    Equal distances (to a micrometre) go to the station listed first, by idx; stations without position do not count. The answer
    is the same at every size. Up to `max_inline` stations, which are counted first, travel with an Arrow function that returns a
    place in the list, so that no row is shuffled; more are put in a tree that the distinct positions walk (see station_tree)."""
    usable = (stations.filter(_known(F.col("latitude"), F.col("longitude")))
              .select(F.coalesce("idx", F.lit(LAST)).cast("bigint").alias("idx"), "station",
                      F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")))
    lat, lon = F.col("latitude"), F.col("longitude")
    there = geo.located(lat, lon) & _known(lat, lon)
    listed = usable.limit(max_inline + 1).collect()
    if len(listed) > max_inline:
        found = station_tree.nearest_of_many(df.filter(there).select("latitude", "longitude").distinct(), usable)
        return _measured(df.join(found, ["latitude", "longitude"], "left").select(*df.columns, F.col("found").alias("_found")))
    found = F.lit(None).cast(FOUND)
    if listed:
        order = sorted(listed, key=lambda s: (s["idx"], s["station"] is not None, s["station"] or "", s["lat"], s["lon"]))
        table = usable.agg(F.sort_array(F.collect_list(F.struct("idx", "station", "lat", "lon")))).scalar()  # in the same order
        find = _finder(np.array([s["lat"] for s in order]), np.array([s["lon"] for s in order]))
        found = F.when(there, F.get(table, find(lat, lon)))
    return _measured(df.withColumn("_found", found))


FOUND = "struct<idx: bigint, station: string, lat: double, lon: double>"


def _known(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat.cast("double")) & ~F.isnan(lon.cast("double"))


def _measured(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "nearest_station": F.col("_found.station"),
        "distance_to_station": geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("_found.lat"), F.col("_found.lon")),
    }).drop("_found")


def _finder(lats: np.ndarray, lons: np.ndarray):
    """The place in the list of the first of the stations nearest to a position. Sales of one building are looked up once a batch."""
    @F.pandas_udf("int")
    def find(lat: pd.Series, lon: pd.Series) -> pd.Series:
        at = np.column_stack([lat.to_numpy(dtype=float, na_value=np.nan), lon.to_numpy(dtype=float, na_value=np.nan)])
        at, place = np.unique(np.where(np.isnan(at).any(axis=1, keepdims=True), 0.0, at), axis=0, return_inverse=True)
        position, station, _ = station_tree.near_pairs(at[:, 0], at[:, 1], lats, lons)
        nearest = np.zeros(len(at), dtype=np.int32)
        nearest[position[::-1]] = station[::-1]  # of several writes the last, the first listed, stays
        return pd.Series(nearest[place.reshape(-1)])

    return find
