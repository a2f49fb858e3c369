"""Raw sale records: one ;-separated line each, parsed with Spark's own functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import PARSED_COLUMNS

MIN_FIELDS = 25

# Field position and kind of each column in a "B" line.
FIELDS = {
    "district_code": (1, "text"), "property_id": (2, "text"), "sale_counter": (3, "text"),
    "download_datetime": (4, "text"), "property_name": (5, "title"), "property_unit_number": (6, "text"),
    "property_house_number": (7, "text"), "property_street_name": (8, "title"),
    "property_locality": (9, "title"), "property_post_code": (10, "int"), "area": (11, "double"),
    "area_type": (12, "text"), "contract_date": (13, "date"), "settlement_date": (14, "date"),
    "purchase_price": (15, "double"), "zoning": (16, "text"), "nature_of_property": (17, "text"),
    "primary_purpose": (18, "title"), "strata_lot_number": (19, "text"), "dealing_number": (23, "text"),
}

CONVERSIONS = {
    "text": lambda c: c,
    "title": text.title_case,
    "int": text.parse_int,
    "double": text.parse_double,
    "date": text.parse_date,
}


def parse_records(lines: DataFrame, as_of: date | None = None, keep: list[str] | None = None) -> DataFrame:
    """Typed sale columns from a `line` column, after the columns named in `keep`.

    Kept are lines that start with "B;", have at least 25 fields, and whose contract date is not
    after `as_of` (today by default); a missing contract date is no reason to drop a line.
    """
    # explode of a single element keeps the filters below from repeating the split for each use.
    fields = F.explode(F.array(text.split_fields(F.col("line"))))
    parsed = (lines.filter(F.col("line").startswith("B;"))
              .select(*(keep or []), fields.alias("_parts"))
              .filter(F.size("_parts") >= MIN_FIELDS)
              .select(*(keep or []), *[_field(name).alias(name) for name in PARSED_COLUMNS]))
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return parsed.filter(F.col("contract_date").isNull() | (F.col("contract_date") <= today))


def _field(name: str) -> Column:
    position, kind = FIELDS[name]
    return CONVERSIONS[kind](text.strip(F.col("_parts")[position]))
