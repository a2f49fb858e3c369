"""Entry points for the driver: a flagship query, all registered queries, and their SQL oracles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle import ORACLE_SQL
from parcelwise import fixtures
from parcelwise.functions import display, geo, text
from parcelwise.operators import enrich, growth, quantile, spatial
from parcelwise.operators.filters import dashboard_filters
from parcelwise.operators.neighbors import nearest_sales_of_all
from parcelwise.operators.numbering import latest_sales, number_sales
from parcelwise.plans import checks, jobs, reads
from parcelwise.sources import archive
from parcelwise.sources.listings import extract_cards
from parcelwise.sources.records import parse_records
from parcelwise.sources.stations import load_stations
from parcelwise.sources.tables import add_part, read_table, stored, write_table
from parcelwise.streaming.drops import ingest_drops

try:
    import corpus_pipeline
    from parcelwise.llm import registry as llm
except ModuleNotFoundError as missing:  # only where the training-data operators were taken out
    if missing.name not in ("corpus_pipeline", "parcelwise.llm"):
        raise
    llm = None

YEAR = 2018
SUBURB = "Brand#12"
STREET = "red plate"
PROPERTY = "100-18"
AS_OF = date(2024, 12, 31)
CHECKED_AT = datetime(2019, 1, 8)


class Market:
    """The inputs of one scale folder, and the derived tables as plans over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.sales = fixtures.sales(spark, sf_dir)

    @property
    def stations(self):
        return fixtures.stations(self.spark, self.dir)

    @property
    def repeats(self):
        return growth.repeat_sales(self.sales)

    @property
    def growth(self):
        return growth.property_growth(self.repeats)

    @property
    def cube(self):
        return growth.growth_cube(self.repeats)

    @property
    def street_growth(self):
        return growth.street_growth(self.cube)

    @property
    def suburb_growth(self):
        return growth.suburb_growth(self.cube)

    @property
    def street_summary(self):
        return growth.street_summary(self.sales, self.cube)

    @property
    def suburb_summary(self):
        return growth.suburb_summary(self.sales, self.cube)

    @property
    def suburb_centroids(self):
        return reads.suburb_centroids(self.sales)

    @property
    def street_centroids(self):
        return reads.street_centroids(self.sales)


def rounded(df: DataFrame, *single: str) -> DataFrame:
    """Round every double, so that the order of summation does not show. Means of short decimals would often lie on the edge
    between two roundings; those columns (`single`) are compared at single precision instead."""
    def cell(name: str, kind: str):
        if kind != "double":
            return F.col(name)
        if name not in single:
            return F.round(name, 6).alias(name)
        return F.col(name).cast("float").cast("double").alias(name)

    return df.select(*[cell(name, kind) for name, kind in df.dtypes])


SALE_PRICE = ["avg_price"]
PLACE = ["lat", "lon", "latitude", "longitude", "neighbor_lat", "neighbor_lon"]


def _sales_list(m: Market, **filters) -> DataFrame:
    return rounded(reads.sales_list(m.sales, m.growth, m.stations, **filters), *PLACE)


def _chart(m: Market) -> DataFrame:
    charts = {
        "growth_suburbs": reads.growth_chart(reads.top_growth_suburbs(m.suburb_growth, YEAR), "suburb"),
        "activity_suburbs": reads.activity_chart(reads.activity_suburbs(m.sales, YEAR), "suburb"),
    }
    first, *others = [df.select(F.lit(name).alias("chart"), "name", F.col("value").cast("double").alias("value"),
                                "full_name") for name, df in charts.items()]
    for df in others:
        first = first.unionByName(df)
    return first


def _unnested(lists: dict) -> DataFrame:
    """One row per member of nested lists, with its place; all fields of all lists."""
    fields = {f.name: f.dataType for df, column in lists.values() for f in df.select(column.alias("l")).schema["l"].dataType.elementType}
    first, *others = [
        df.select(F.lit(name).alias("list"), F.posexplode(column).alias("pos", "m")).select(
            "list", (F.col("pos") + 1).cast("bigint").alias("pos"),
            *[(F.col(f"m.{f}") if f in df.select(column.alias("l")).schema["l"].dataType.elementType.names else F.lit(None)).cast(kind).alias(f)
              for f, kind in fields.items()])
        for name, (df, column) in lists.items()]
    for df in others:
        first = first.unionByName(df)
    return rounded(first)


def _nested_clusters(m: Market) -> DataFrame:
    flat = reads.unified_map("suburb", m.suburb_growth, m.suburb_centroids, m.suburb_summary, YEAR)
    members = reads.map_clusters(flat).select("*", F.posexplode_outer("neighbors").alias("pos", "n"))
    return rounded(members.select(
        "rank", "id", "name", "lat", "lon", "cagr", (F.coalesce("pos", F.lit(0)) + 1).cast("bigint").alias("pos"), "n.neighbor_rank",
        F.col("n.name").alias("neighbor_name"), F.col("n.lat").alias("neighbor_lat"), F.col("n.lon").alias("neighbor_lon"),
        F.col("n.cagr").alias("neighbor_cagr")), *PLACE)


def _global_summary(m: Market) -> DataFrame:
    nested = reads.global_summary(m.suburb_summary, m.street_summary)
    return _unnested({"suburbs": (nested, F.col("top_suburbs")), "streets": (nested, F.col("top_streets"))}).select(
        "list", "pos", "suburb", "street_name", "avg_cagr", "unique_properties", "total_sales")


def _top_performers(m: Market) -> DataFrame:
    nested = reads.top_performers(m.sales, m.suburb_growth, m.street_growth, YEAR, "Residence")
    rows = _unnested({f"{kind}_{level}": (nested, F.col(f"{kind}.{level}")) for kind in ("growth", "activity")
                      for level in ("suburbs", "streets")})
    return rows.select("list", "pos", "suburb", "street_name", "avg_cagr", F.coalesce("property_count", "sales_count").alias("n"))


def _near_station(spots: DataFrame, stations: DataFrame) -> DataFrame:
    return rounded(spatial.with_nearest_station(spots, stations).select("id", "nearest_station", "distance_to_station"))


def _geocode_by_ids(m: Market) -> DataFrame:
    asked = m.sales.filter("id % 10 = 3").select("id")
    address = text.street_address(F.lit(None), F.concat_ws(", ", "property_street_name", "property_locality"))
    return rounded(enrich.geocoded(enrich.by_ids(m.sales, asked), fixtures.gazetteer(m.spark, m.dir), address), *PLACE)


def _enrichment_counts(m: Market) -> DataFrame:
    address = F.concat_ws(", ", "property_street_name", "property_locality")
    updates = enrich.geocoded(enrich.coordinates_pending(m.sales), fixtures.gazetteer(m.spark, m.dir), address)
    return enrich.enrichment_counts(updates, "latitude")


def _address_strings(m: Market) -> DataFrame:
    house, street, locality = (F.col(f"property_{c}") for c in ("house_number", "street_name", "locality"))
    return m.sales.select("id", text.local_address(house, street, locality).alias("local"),
                          text.postal_address(house, street, locality, F.col("property_post_code")).alias("postal"),
                          text.street_address(house, street).alias("street"))


def _geocode_join(m: Market) -> DataFrame:
    address = text.street_address(F.lit(None), F.concat_ws(", ", "property_street_name", "property_locality"))
    return rounded(enrich.geocoded(enrich.coordinates_pending(m.sales), fixtures.gazetteer(m.spark, m.dir), address),
                   *PLACE)


def _park():
    return F.concat("property_locality", F.lit(" Park"))


def _listing_match(m: Market) -> DataFrame:
    urls = enrich.listing_urls(m.sales, fixtures.listing_cards(m.spark, m.dir), _park())
    return urls.filter("realestate_url IS NOT NULL OR domain_url IS NOT NULL")


def _listing_refresh(m: Market) -> DataFrame:
    due = enrich.listings_due(latest_sales(m.sales), CHECKED_AT)
    urls = enrich.listing_urls(due, fixtures.listing_cards(m.spark, m.dir), _park())
    return due.select("id", "property_id").join(urls, "id")


def _reconcile(m: Market) -> DataFrame:
    drifted = m.growth.withColumn("cagr", F.when(F.col("property_id").endswith("7"), F.col("cagr") + 0.001)
                                  .otherwise(F.col("cagr")))
    return rounded(checks.reconcile_growth(drifted, m.sales))


def _enrich_callback(m: Market) -> DataFrame:
    def process(sale: dict) -> dict | None:
        if sale["property_house_number"] == "7":
            raise ValueError("no service")
        if sale["property_house_number"] == "6":
            return None
        return {"latitude": -33.0, "longitude": 151.0}

    updates = enrich.enrich(m.sales, F.col("latitude").isNull(), process, "latitude DOUBLE, longitude DOUBLE")
    return updates.agg(F.count("*").alias("processed"), F.count("latitude").alias("updated"),
                       F.count("_error").alias("failed"))


def _updated(m: Market) -> DataFrame:
    address = F.concat_ws(", ", "property_street_name", "property_locality")
    updates = enrich.geocoded(enrich.coordinates_pending(m.sales), fixtures.gazetteer(m.spark, m.dir), address)
    return rounded(enrich.apply_updates(m.sales, updates, ["latitude", "longitude"])
                   .select("id", "latitude", "longitude"), *PLACE)


def _short_prices(m: Market) -> DataFrame:
    return m.sales.filter("purchase_price IS NOT NULL").select(
        "id", display.short_price(F.floor(F.col("purchase_price")).cast("double")).alias("short_price"),
        display.growth_bar(F.col("purchase_price") / 1e6).alias("bar"))


def _ingested(m: Market) -> DataFrame:
    files = stored(fixtures.archives(m.spark, m.dir))  # packed once; read for their lines and for their numbers
    return archive.sales_from_lines(archive.archive_lines(files), AS_OF, archive.numbered_archives(files))


def _bad_files(m: Market) -> DataFrame:
    bad = archive.bad_files(archive.archive_lines(fixtures.archives(m.spark, m.dir)))
    return bad.select(F.startswith("path", F.lit("damaged")).alias("damaged"), "inner").groupBy("damaged", "inner").agg(
        F.count("*").alias("files"))


def _root(m: Market) -> str:
    """A new folder for tables, in the one that the cluster shares."""
    context = m.spark.sparkContext
    folder = m.spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or f"file://{tempfile.mkdtemp()}"
    return f"{folder}/tables-{uuid.uuid4().hex}"


def _with_enrichment(m: Market, compact: bool = False) -> DataFrame:
    """A geocoding job by ids with house numbers, and the sales as read afterwards."""
    root = _root(m)
    write_table(m.sales, root, "sales")
    jobs.geocode_sales(m.spark, root, fixtures.house_gazetteer(m.spark, m.dir), m.sales.filter("id % 10 = 3").select("id"))
    if compact:
        jobs.compact_sales(m.spark, root)
    return rounded(jobs.read_sales(m.spark, root).select("id", "latitude", "longitude"), *PLACE)


def _stored(m: Market) -> DataFrame:
    """The growth build as a job: what the stored tables hold, read back."""
    root = _root(m)
    write_table(m.sales, root, "sales")
    jobs.build_growth(m.spark, root)
    return _growth_tables(m, root)


def _extended(m: Market) -> str:
    """Growth built from a part of the sales and extended by the others."""
    root = _root(m)
    write_table(m.sales.filter("id % 3 = 0"), root, "sales")
    jobs.build_growth(m.spark, root)
    add_part(m.sales.filter("id % 3 <> 0"), root, "sales", "others")
    jobs.extend_growth(m.spark, root)
    return root


def _growth_tables(m: Market, root: str) -> DataFrame:
    summary, places = (read_table(m.spark, root, f"suburb_{n}") for n in ("summary", "centroids"))
    years = read_table(m.spark, root, "suburb_growth").groupBy("suburb").agg(F.count("*").alias("years"))
    return rounded(summary.join(years, "suburb", "left").join(places, "suburb", "left"), *PLACE)


def _archive_columns(sales: DataFrame) -> DataFrame:
    return sales.select("property_id", "sale_counter", "contract_date", "purchase_price", "area", "property_street_name")


def _ingest_job(m: Market) -> DataFrame:
    """The job from archives in a folder, read by seeking, to the stored sales."""
    root = _root(m)
    jobs.ingest(m.spark, fixtures.put_archives(fixtures.archives(m.spark, m.dir), f"{root}/in"), root, as_of=AS_OF)
    return _archive_columns(jobs.read_sales(m.spark, root))


def _ingest_years(m: Market) -> DataFrame:
    """Archives of some years, then those of later ones that are not there yet."""
    root = _root(m)
    folder = fixtures.put_yearly_archives(m.spark, m.dir, f"{root}/in")
    jobs.ingest(m.spark, folder, root, 1993, 1995, AS_OF)
    jobs.ingest(m.spark, folder, root, 1995, 1997, AS_OF, keep_existing=True)
    return _archive_columns(jobs.read_sales(m.spark, root))


def _streamed(m: Market) -> DataFrame:
    """A job reads the first years and builds growth, a stream adds what is dropped later, and growth is extended."""
    root = _root(m)
    folder = fixtures.put_yearly_archives(m.spark, m.dir, f"{root}/in")
    jobs.ingest(m.spark, folder, root, 1992, 1994, AS_OF)
    jobs.build_growth(m.spark, root)
    ingest_drops(m.spark, folder, root, f"{root}/stream", AS_OF).awaitTermination()
    jobs.extend_growth(m.spark, root)
    return read_table(m.spark, root, "suburb_summary").select("suburb", "unique_properties", "total_sales")


def _sales_after_build(m: Market) -> DataFrame:
    return jobs.read_sales(m.spark, _extended(m)).agg(F.count("*").alias("sales"), F.bit_xor("id").alias("ids"), F.sum("purchase_price").cast("decimal(38,2)").alias("paid"))


def _stations_file(m: Market) -> DataFrame:
    return load_stations(m.spark, fixtures.station_file(m.spark, m.dir, f"{_root(m)}/stations"))


def _incomplete_addresses(m: Market) -> DataFrame:
    blank = {name: F.when(F.pmod("id", F.lit(4)) == n, F.lit(value)).otherwise(F.col(name))
             for n, (name, value) in enumerate((("property_house_number", ""), ("property_street_name", None)))}
    return enrich.listing_urls(m.sales.withColumns(blank), fixtures.listing_cards(m.spark, m.dir), _park())


def _listing_job(m: Market) -> DataFrame:
    """The job that looks up listings of sales never checked, and the sales as read afterwards."""
    root = _root(m)
    write_table(m.sales, root, "sales")
    jobs.check_listings(m.spark, root, fixtures.local_cards(m.spark, m.dir), CHECKED_AT)
    return jobs.read_sales(m.spark, root).select("id", "realestate_url", "domain_url", "listings_last_checked")


QUERIES: dict[str, Callable[[Market], DataFrame]] = {
    # growth build
    "property_growth": lambda m: rounded(m.growth),
    "street_growth": lambda m: rounded(m.street_growth),
    "suburb_growth": lambda m: rounded(m.suburb_growth),
    "street_summary": lambda m: rounded(m.street_summary),
    "suburb_summary": lambda m: rounded(m.suburb_summary),
    "top_decile_threshold": lambda m: m.spark.range(1).select(
        F.round(quantile.exact_quantile(m.growth, "cagr", 0.9), 6).alias("threshold")),
    # sales
    "sales_list": lambda m: _sales_list(m, start_date="2016-01-01", end_date="2019-12-31", property_type="Residence",
                                        min_price=1000, max_price=90000, min_area=20, max_area=450),
    "sales_list_page": lambda m: _sales_list(m, skip=40, limit=60),
    "sales_list_deep": lambda m: _sales_list(m, skip=40_000, limit=80),
    "sales_list_min_growth": lambda m: _sales_list(m, min_growth=5, max_price=0),
    "sales_list_suburb_ilike": lambda m: _sales_list(m, suburb="bRAND#1_"),
    "sales_list_street": lambda m: _sales_list(m, **dashboard_filters(YEAR, suburb=SUBURB, street=STREET)),
    "monthly_price": lambda m: rounded(reads.monthly_price(m.sales), *SALE_PRICE),
    "monthly_price_range": lambda m: rounded(reads.monthly_price(m.sales, "2016-03-10", "2018-11-20"), *SALE_PRICE),
    "monthly_median_price": lambda m: reads.monthly_median_price(m.sales),
    "top_suburbs": lambda m: rounded(reads.top_suburbs(m.sales, 10, "2016-01-01", "2018-12-31"), *SALE_PRICE),
    "property_history": lambda m: rounded(reads.property_history(m.sales, m.growth, m.stations, PROPERTY), *PLACE),
    "property_history_unknown": lambda m: reads.property_history(m.sales, m.growth, m.stations, "nonexistent_id"),
    "history_links": lambda m: reads.history_links(
        reads.property_history(m.sales, m.growth, m.stations, PROPERTY)).select("id", "realestate_url", "domain_url"),
    "sale_numbers": lambda m: number_sales(m.sales).select("id", "property_id", "sale_number"),
    "latest_sale": lambda m: latest_sales(m.sales).select("property_id", "id", "contract_date"),
    # growth reads
    "suburb_cagr": lambda m: rounded(reads.suburb_cagr(m.suburb_growth, SUBURB, YEAR)),
    "suburb_cagr_missing": lambda m: reads.suburb_cagr(m.suburb_growth, "Nowhere"),
    "street_cagr": lambda m: rounded(reads.street_cagr(m.street_growth, STREET, SUBURB, YEAR)),
    "street_trend": lambda m: rounded(reads.street_trend(m.street_growth, STREET, SUBURB)),
    "suburb_trend": lambda m: rounded(reads.suburb_trend(m.suburb_growth, SUBURB)),
    "global_top_suburbs": lambda m: rounded(reads.global_top_suburbs(m.suburb_summary)),
    "global_top_streets": lambda m: rounded(reads.global_top_streets(m.street_summary)),
    "global_summary": _global_summary,
    "top_growth_suburbs": lambda m: rounded(reads.top_growth_suburbs(m.suburb_growth, YEAR)),
    "top_growth_streets": lambda m: rounded(reads.top_growth_streets(m.street_growth, YEAR)),
    "activity_suburbs": lambda m: reads.activity_suburbs(m.sales, YEAR),
    "activity_streets": lambda m: reads.activity_streets(m.sales, YEAR),
    "activity_suburbs_by_type": lambda m: reads.activity_suburbs(m.sales, YEAR, "Strata Unit"),
    "activity_streets_by_type": lambda m: reads.activity_streets(m.sales, YEAR, "Strata Unit"),
    "top_performers": _top_performers,
    "comparison_label": lambda m: rounded(reads.property_comparison(m.sales, m.growth, m.street_growth,
                                                                     m.suburb_growth, YEAR)),
    "chart_projection": _chart,
    "short_prices": _short_prices,
    # space
    "suburb_centroids": lambda m: rounded(m.suburb_centroids, *PLACE),
    "street_centroids": lambda m: rounded(m.street_centroids, *PLACE),
    "neighbor_suburbs": lambda m: rounded(reads.neighbor_suburbs(m.suburb_centroids, m.suburb_summary, SUBURB), *PLACE),
    "neighbor_streets": lambda m: rounded(reads.neighbor_streets(m.street_centroids, m.street_summary, STREET, SUBURB),
                                          *PLACE),
    "neighbor_properties": lambda m: rounded(reads.neighbor_properties(m.sales, m.growth, PROPERTY), *PLACE),
    "neighbor_properties_all": lambda m: nearest_sales_of_all(m.sales, m.growth),
    "unified_map_suburb": lambda m: rounded(reads.unified_map_suburbs(
        m.suburb_growth, m.suburb_centroids, m.suburb_summary, YEAR), *PLACE),
    "unified_map_street": lambda m: rounded(reads.unified_map_streets(
        m.street_growth, m.street_centroids, m.street_summary, YEAR), *PLACE),
    "unified_map_clusters": _nested_clusters,
    "unified_map_other_level": lambda m: rounded(reads.unified_map(
        "state", m.suburb_growth, m.suburb_centroids, m.suburb_summary, YEAR), *PLACE),
    "nearest_station_ties": lambda m: _near_station(fixtures.between_stations(m.spark, m.dir),
                                                    fixtures.mirrored_stations(m.spark, m.dir)),
    "nearest_station_large": lambda m: _near_station(fixtures.spots(m.spark, m.dir), fixtures.many_stations(m.spark, m.dir)),
    "nearest_station": lambda m: rounded(spatial.with_nearest_station(m.sales, m.stations)
                                         .select("id", "nearest_station", "distance_to_station")),
    "haversine": lambda m: rounded(m.sales.select("id", geo.haversine_km(
        F.col("latitude"), F.col("longitude"), F.lit(-33.8688), F.lit(151.2093)).alias("km"))),
    # ingest
    "ingest_nested_zip": lambda m: _ingested(m).select("property_id", "sale_counter", "contract_date", "purchase_price", "area",
                                                       "property_street_name"),
    "ingest_ids": lambda m: _ingested(m).agg(F.count("*").alias("sales"), F.countDistinct("id").alias("ids")),
    "ingest_bad_files": _bad_files,
    "ingest_job": _ingest_job,
    "ingest_years": _ingest_years,
    "streamed_growth": _streamed,
    "stations_file": _stations_file,
    "stored_growth": _stored,
    "extended_growth": lambda m: _growth_tables(m, _extended(m)),
    "extended_property_growth": lambda m: rounded(jobs.read_growth(m.spark, _extended(m))),
    "sales_after_build": _sales_after_build,
    "sales_with_enrichment": _with_enrichment,
    "compacted_sales": lambda m: _with_enrichment(m, compact=True),
    "parse_records": lambda m: parse_records(fixtures.dat_lines(m.spark, m.dir), AS_OF),
    "title_case": lambda m: fixtures.raw_names(m.spark, m.dir).select("id", text.title_case(F.col("raw")).alias("name")),
    "listing_cards": lambda m: extract_cards(fixtures.listing_pages(m.spark, m.dir)).drop("_error"),
    # enrichment
    "pending_enrich": lambda m: enrich.coordinates_pending(m.sales).select("id", F.lit("geocoding").alias("kind"))
    .unionByName(enrich.listings_unchecked(m.sales).select("id", F.lit("listings").alias("kind"))),
    "geocode_join": _geocode_join,
    "geocode_by_ids": _geocode_by_ids,
    "enrichment_counts": _enrichment_counts,
    "address_strings": _address_strings,
    "coordinates_updated": _updated,
    "enrich_callback": _enrich_callback,
    "listing_match": _listing_match,
    "incomplete_addresses": _incomplete_addresses,
    "listing_job": _listing_job,
    "listing_refresh_due": lambda m: enrich.listings_due(latest_sales(m.sales), CHECKED_AT).select("id", "property_id"),
    "listing_refresh": _listing_refresh,
    # checks
    "cagr_reconcile": _reconcile,
    "completeness": lambda m: checks.completeness(m.sales),
    "derived_counts": lambda m: checks.derived_counts(m.street_growth, m.suburb_growth, m.street_summary,
                                                      m.suburb_summary),
    "coordinate_sample": lambda m: rounded(checks.coordinate_sample(m.sales), *PLACE),
}


def entry(spark: SparkSession) -> DataFrame:
    market = Market(spark, "/root/testdata/sf0.001")
    return reads.top_growth_suburbs(market.suburb_growth, YEAR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        return lambda spark, sf_dir: query(Market(spark, sf_dir))

    own = {name: bind(query) for name, query in QUERIES.items()}
    return own if llm is None else own | llm.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    if llm is None:
        return dict(ORACLE_SQL)
    staged = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLE_SQL | llm.ORACLE_SQL | staged
