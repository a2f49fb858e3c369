"""Table schemas. Money and coordinates are doubles, dates are dates, flags are 0/1 integers."""

from __future__ import annotations

# Columns a raw record yields, in record order.
PARSED_COLUMNS = [
    "district_code", "property_id", "sale_counter", "download_datetime", "property_name",
    "property_unit_number", "property_house_number", "property_street_name", "property_locality",
    "property_post_code", "area", "area_type", "contract_date", "settlement_date", "purchase_price",
    "zoning", "nature_of_property", "primary_purpose", "strata_lot_number", "dealing_number",
]

SALES_DDL = """
    id BIGINT, district_code STRING, property_id STRING, sale_counter STRING, download_datetime STRING,
    property_name STRING, property_unit_number STRING, property_house_number STRING,
    property_street_name STRING, property_locality STRING, property_post_code INT,
    area DOUBLE, area_type STRING, contract_date DATE, settlement_date DATE, purchase_price DOUBLE,
    zoning STRING, nature_of_property STRING, primary_purpose STRING, strata_lot_number STRING,
    dealing_number STRING, property_legal_description STRING, latitude DOUBLE, longitude DOUBLE,
    realestate_url STRING, domain_url STRING, listings_last_checked TIMESTAMP_NTZ
"""

PROPERTY_GROWTH_DDL = """
    property_id STRING, cagr DOUBLE, total_growth DOUBLE, years_held DOUBLE,
    last_sale_price DOUBLE, first_sale_price DOUBLE
"""
STREET_GROWTH_DDL = """
    street_name STRING, suburb STRING, post_code INT, year INT, avg_cagr DOUBLE, property_count BIGINT
"""
SUBURB_GROWTH_DDL = "suburb STRING, year INT, avg_cagr DOUBLE, property_count BIGINT"
STREET_SUMMARY_DDL = """
    street_name STRING, suburb STRING, post_code INT, unique_properties BIGINT, total_sales BIGINT,
    avg_cagr DOUBLE, is_top_performer INT
"""
SUBURB_SUMMARY_DDL = """
    suburb STRING, unique_properties BIGINT, total_sales BIGINT, avg_cagr DOUBLE, is_top_performer INT
"""

# The station file has an unnamed row index first.
STATIONS_DDL = "idx INT, station STRING, latitude DOUBLE, longitude DOUBLE"
GAZETTEER_DDL = "addr_key STRING, latitude DOUBLE, longitude DOUBLE"
CARDS_DDL = """
    portal STRING, suburb_slug STRING, post_code INT, position INT, card_address STRING, href STRING
"""
