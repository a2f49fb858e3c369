"""Wall times of the headline jobs and queries, as one JSON line.

The jobs write their tables to a scratch folder, as on a cluster; the reads then use those tables.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from parcelwise import fixtures
from parcelwise.operators import enrich, spatial
from parcelwise.operators.neighbors import nearest_sales_of_all
from parcelwise.operators.numbering import latest_sales, number_sales
from parcelwise.plans import checks, jobs, reads
from parcelwise.session import local_session
from parcelwise.sources.records import parse_records
from parcelwise.sources.tables import read_table, write_table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
YEAR, SUBURB, STREET, PROPERTY = 2018, "Brand#12", "red plate", "100-18"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench")
    root = tempfile.mkdtemp(prefix="bench-")
    run(fixtures.sales(spark, SF_DIR).limit(1000))  # start-up is not measured
    times: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.time()
        action()
        times[name] = round(time.time() - start, 3)

    # Inputs are laid down first, in files for all cores: deriving them from the test tables is not measured.
    for name, df in (("raw_sales", fixtures.sales(spark, SF_DIR)), ("raw_lines", fixtures.dat_lines(spark, SF_DIR))):
        write_table(df.repartition(2 * int(CPUS)), root, name)
    stations, cards = fixtures.stations(spark, SF_DIR), fixtures.listing_cards(spark, SF_DIR)
    gazetteer = fixtures.gazetteer(spark, SF_DIR)
    timed("sales_write", lambda: write_table(read_table(spark, root, "raw_sales"), root, "sales",
                                             sort_by=["property_locality", "contract_date"]))
    timed("growth_build", lambda: jobs.build_growth(spark, root))
    t = {name: read_table(spark, root, name) for name in (
        "sales", "street_growth", "suburb_growth", "street_summary", "suburb_summary",
        "suburb_centroids", "street_centroids")}
    sales, growth = t["sales"], jobs.read_growth(spark, root)
    suburbs, streets = t["suburb_centroids"], t["street_centroids"]

    queries = {
        "sales_list": lambda: reads.sales_list(sales, growth, stations, start_date="2016-01-01", end_date="2019-12-31",
                                               property_type="Residence", min_price=1000, max_price=90000),
        "sales_list_min_growth": lambda: reads.sales_list(sales, growth, stations, min_growth=5),
        "monthly_price": lambda: reads.monthly_price(sales),
        "monthly_median_price": lambda: reads.monthly_median_price(sales),
        "top_suburbs": lambda: reads.top_suburbs(sales),
        "property_history": lambda: reads.property_history(sales, growth, stations, PROPERTY),
        "suburb_cagr": lambda: reads.suburb_cagr(t["suburb_growth"], SUBURB, YEAR),
        "street_trend": lambda: reads.street_trend(t["street_growth"], STREET, SUBURB),
        "global_summary": lambda: reads.global_summary(t["suburb_summary"], t["street_summary"]),
        "top_performers": lambda: reads.top_performers(sales, t["suburb_growth"], t["street_growth"], YEAR),
        "neighbor_suburbs": lambda: reads.neighbor_suburbs(suburbs, t["suburb_summary"], SUBURB),
        "neighbor_streets": lambda: reads.neighbor_streets(streets, t["street_summary"], STREET, SUBURB),
        "neighbor_properties": lambda: reads.neighbor_properties(sales, growth, PROPERTY),
        "unified_map_suburb": lambda: reads.unified_map_suburbs(t["suburb_growth"], suburbs, t["suburb_summary"], YEAR),
        "unified_map_street": lambda: reads.unified_map_streets(t["street_growth"], streets, t["street_summary"], YEAR),
        "property_comparison_all": lambda: reads.property_comparison(sales, growth, t["street_growth"],
                                                                     t["suburb_growth"], YEAR),
        "neighbor_properties_all": lambda: nearest_sales_of_all(sales, growth),
        "nearest_station_all": lambda: spatial.with_nearest_station(sales, stations),
        "sale_numbers_all": lambda: number_sales(sales),
        "latest_sale_all": lambda: latest_sales(sales),
        "parse_records": lambda: parse_records(read_table(spark, root, "raw_lines")),
        "geocode_all": lambda: enrich.geocoded(enrich.coordinates_pending(sales), gazetteer,
                                               F.concat_ws(", ", "property_street_name", "property_locality")),
        "listing_match_all": lambda: enrich.listing_urls(sales, cards, F.concat("property_locality", F.lit(" Park"))),
        "cagr_reconcile": lambda: checks.reconcile_growth(growth, sales),
        "completeness": lambda: checks.completeness(sales),
    }
    only = os.environ.get("BENCH_ONLY", "").split()
    for name, query in queries.items():
        if not only or name in only:
            timed(name, lambda: run(query()))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
