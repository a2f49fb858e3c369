"""Text and number parsing for raw records, address strings and listing links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python strips as white space.
WHITE_SPACE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_DIGITS = "[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def split_fields(line: Column) -> Column:
    """Fields of a ;-separated line, free of white space at their ends apart from plain spaces
    (see `strip`). Only lines with other than printable ASCII characters go through the slower pattern."""
    clean = F.regexp_replace(line, f"[{WHITE_SPACE}]*;[{WHITE_SPACE}]*", ";")
    return F.split(F.when(line.rlike(r"[^\x20-\x7e]"), clean).otherwise(line), ";", -1)


def strip(field: Column) -> Column:
    return F.trim(field)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the others (O'Connor, 1St).

    `initcap` starts words at spaces only, so a marked space is put before every letter that follows
    a non-letter, and taken out again.
    """
    mark = "\u0001 "
    spaced = F.regexp_replace(F.lower(text), r"([^\p{L}])(?=\p{L})", f"$1{mark}")
    return F.replace(F.initcap(spaced), F.lit(mark), F.lit(""))


def parse_date(text: Column) -> Column:
    """Eight digits yyyyMMdd, anything else is NULL."""
    return F.when(text.rlike(r"^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))


def parse_double(text: Column) -> Column:
    """A finite decimal number, anything else is NULL."""
    value = F.translate(text, "_", "").try_cast("double")
    return F.when(text.rlike(_NUMBER) & (F.abs(value) != float("inf")), value)


def parse_int(text: Column) -> Column:
    """Whole number after dropping everything but digits and '-'."""
    return F.regexp_replace(text, "[^0-9-]", "").try_cast("int")


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def street_address(house: Column, street: Column) -> Column:
    return F.concat_ws(" ", _given(house), _given(street))


def local_address(house: Column, street: Column, locality: Column) -> Column:
    return F.concat_ws(", ", _given(street_address(house, street)), _given(locality))


def postal_address(house: Column, street: Column, locality: Column, post_code: Column) -> Column:
    """Local address followed by the state and, where known, the postcode."""
    return F.concat_ws(" ", _given(local_address(house, street, locality)), F.lit("NSW"),
                       post_code.cast("string"))


def geocode_query(address: Column) -> Column:
    return F.concat(address, F.lit(", NSW, Australia"))


def address_key(address: Column) -> Column:
    return F.lower(address)


# The two portals, how each spells a space in a suburb slug, and its link base.
PORTALS = [
    ("rea", "+", "https://www.realestate.com.au"),
    ("domain", "-", "https://www.domain.com.au"),
]


def suburb_slug(suburb: Column, space: str) -> Column:
    return F.replace(F.lower(suburb), F.lit(" "), F.lit(space))


def absolute_link(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))
