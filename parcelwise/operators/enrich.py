"""Enrichment: coordinates from a gazetteer, listing links from crawled cards, user callbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

STALE_DAYS = 7
PAGE = ["portal", "slug", "search_post"]
#: The Bloom filter of a search page: bits per address and places looked at, and its greatest size as a power of two (8 KB).
BITS_PER_ADDRESS, PROBES, MOST_BITS = 16, 3, 16


def apply_updates(sales: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Sales with new values from `updates` (one row per id); a NULL update keeps the old value."""
    fresh = updates.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    merged = sales.join(fresh, "id", "left").withColumns(
        {c: F.coalesce(f"_new_{c}", c) for c in columns})
    return merged.select(*sales.columns)


LISTING = ["realestate_url", "domain_url", "listings_last_checked"]
SIDE_DDL = ("id BIGINT, seq BIGINT, latitude DOUBLE, longitude DOUBLE, realestate_url STRING, domain_url STRING, "
            "listings_last_checked TIMESTAMP_NTZ")


def with_enrichment(sales: DataFrame, side: DataFrame) -> DataFrame:
    """Sales with the latest entries of a side table (SIDE_DDL): of coordinates, and of a listing check with the links it left."""
    latest = side.groupBy("id").agg(
        F.max(F.when(F.col("latitude").isNotNull(), F.struct("seq", "latitude", "longitude"))).alias("_place"),
        F.max(F.when(F.col("listings_last_checked").isNotNull(), F.struct("seq", *LISTING))).alias("_check"))
    placed, checked = F.col("_place").isNotNull(), F.col("_check").isNotNull()
    return sales.join(latest, "id", "left").withColumns(
        {c: F.when(placed, F.col(f"_place.{c}")).otherwise(F.col(c)) for c in ("latitude", "longitude")}
        | {c: F.when(checked, F.col(f"_check.{c}")).otherwise(F.col(c)) for c in LISTING}).select(*sales.columns)


# --- coordinates ---------------------------------------------------------------------------------

def coordinates_pending(sales: DataFrame) -> DataFrame:
    return sales.filter("latitude IS NULL")


def pending_slice(pending: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A run of pending sales in id order, for working off a backlog in portions."""
    return pending.orderBy("id").offset(offset).limit(limit)


def by_ids(sales: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Requested sales that lack a latitude (0.0 counts as lacking). Ids come as a list or, however many, as a table with
    a column `id`; repeated ids count once."""
    if not isinstance(ids, DataFrame):
        ids = sales.sparkSession.createDataFrame([(i,) for i in ids], "id bigint")
    return sales.filter(F.coalesce("latitude", F.lit(0.0)) == 0.0).join(ids, "id", "left_semi")


def geocoded(pending: DataFrame, gazetteer: DataFrame, address: Column) -> DataFrame:
    """id, latitude, longitude for every pending sale, NULL where the gazetteer has no usable entry.

    The gazetteer is reduced to one entry per key. The join is left to the planner: it broadcasts a
    small gazetteer by its size, and splits an address shared by many sales otherwise.
    """
    entry = (gazetteer.filter((F.col("latitude") != 0.0) & (F.col("longitude") != 0.0))
             .groupBy("addr_key").agg(F.min(F.struct("latitude", "longitude")).alias("found")))
    return (pending.select("id", text.address_key(address).alias("addr_key"))
            .join(entry, "addr_key", "left")
            .select("id", F.col("found.latitude").alias("latitude"), F.col("found.longitude").alias("longitude")))


def enrichment_counts(updates: DataFrame, column: str) -> DataFrame:
    return updates.agg(F.count("*").alias("processed"), F.count(column).alias("updated"))


# --- listings ------------------------------------------------------------------------------------

def listings_unchecked(sales: DataFrame) -> DataFrame:
    return sales.filter("listings_last_checked IS NULL")


def listings_due(sales: DataFrame, as_of: datetime) -> DataFrame:
    """Never checked, or checked more than seven days before `as_of`."""
    checked = F.col("listings_last_checked")
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(STALE_DAYS))
    return sales.filter(checked.isNull() | (checked < limit))


def _searches(sales: DataFrame, suburb: Column) -> DataFrame:
    """Search page and address of every sale; all three NULL where the address is incomplete."""
    house, street = F.col("property_house_number"), F.col("property_street_name")
    complete = (house != "") & (street != "") & (F.col("property_locality") != "")
    post_code = F.nullif(F.col("property_post_code"), F.lit(0)).cast("string")
    return sales.select(
        "id",
        F.when(complete, F.lower(suburb)).alias("search_suburb"),
        F.when(complete, F.coalesce(post_code, F.lit(""))).alias("search_post"),
        F.when(complete, F.lower(F.concat(house, F.lit(" "), street))).alias("address"))


def _probes(address: Column, words: Column) -> list[Column]:
    """Places of an address in its page's filter of `words` 64-bit words, a power of two."""
    return [F.shiftrightunsigned(F.xxhash64(address), k * 64 // PROBES).bitwiseAND(words.cast("long") * 64 - 1) for k in range(PROBES)]


def _page_filters(wanted: DataFrame) -> DataFrame:
    """For each page: the lengths and first letters of its wanted addresses and a Bloom filter of them (`bits`), sized by their number.

    A page with more addresses than the largest filter is meant for lets more pieces pass; what is found stays the same."""
    needed = F.ceil(F.log2(F.count("*") * (BITS_PER_ADDRESS / 64)))
    sized = wanted.groupBy(*PAGE).agg(F.collect_set(F.length("address")).alias("lengths"), F.collect_set(F.left("address", F.lit(1))).alias("firsts"),
                                      F.pow(F.lit(2), F.greatest(F.least(needed, F.lit(MOST_BITS - 6)), F.lit(0))).cast("int").alias("words"))
    one = F.lit(1).cast("long")
    probed = (wanted.join(sized.select(*PAGE, "words"), PAGE)
              .select(*PAGE, F.explode(F.array(*_probes(F.col("address"), F.col("words")))).alias("probe"))
              .select(*PAGE, F.shiftright("probe", 6).cast("int").alias("word"),
                      F.call_function("shiftleft", one, F.col("probe").bitwiseAND(63).cast("int")).alias("bits")))
    blank = sized.select(*PAGE, F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = probed.unionByName(blank).groupBy(*PAGE, "word").agg(F.bit_or("bits").alias("bits"))
    bits = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits"))
    return sized.join(bits, PAGE)


def _pieces(wanted: DataFrame, cards: DataFrame) -> DataFrame:
    """The pieces of cards, with a link, that pass the filter of their page: all that equal an address, and few others."""
    body, bits = F.col("body"), F.col("bits")

    def piece(start: Column, n: Column) -> Column:
        return F.substring(body, start, n)

    def passes(start: Column, n: Column) -> Column:
        found = F.lit(True)
        for probe in _probes(piece(start, n), F.size(bits)):
            found = found & (F.getbit(F.get(bits, F.shiftright(probe, 6).cast("int")), probe.bitwiseAND(63).cast("int")) == 1)
        return found

    def passing(starts: Column) -> Column:
        return F.flatten(F.transform("lengths", lambda n: F.transform(
            F.filter(starts, lambda start: (start + n <= F.length(body) + 1) & passes(start, n)), lambda start: piece(start, n))))

    starts = F.filter(F.sequence(F.lit(1), F.length(body)), lambda start: F.array_contains("firsts", piece(start, F.lit(1))))
    pieces = F.array_distinct(F.flatten(F.transform(F.array(starts), passing)))  # so that the starts are found once for all lengths
    return (cards.filter(F.col("href") != "")
            .select("portal", F.col("suburb_slug").alias("slug"),
                    F.coalesce(F.nullif(F.col("post_code"), F.lit(0)).cast("string"), F.lit("")).alias("search_post"),
                    "position", "href", F.lower("card_address").alias("body"))
            .filter("body != ''").join(_page_filters(wanted), PAGE)
            .select(*PAGE, "position", "href", F.explode(pieces).alias("address")))


def first_listings(searches: DataFrame, cards: DataFrame) -> DataFrame:
    """For each (portal, suburb, postcode, address): the link of the first card on that search page
    whose text contains the address and that has a link.

    Containment is turned into equality: a card is cut into its pieces of the lengths asked for on
    its page, and a Bloom filter of the page's addresses drops nearly all of them before anything is
    shuffled. Equal pieces that are left keep their first card, and addresses join them one to one.
    The work is linear in the cards' text, however many sales share a page.
    """
    portals = F.array(*[F.struct(F.lit(name).alias("portal"),
                                 text.suburb_slug(F.col("search_suburb"), space).alias("slug"))
                        for name, space, _ in text.PORTALS])
    wanted = (searches.select("search_suburb", "search_post", "address").dropna().distinct()
              .select("*", F.inline(portals)))
    first = _pieces(wanted, cards).groupBy(*PAGE, "address").agg(F.min(F.struct("position", "href")).alias("card"))

    link = F.lit(None).cast("string")
    for name, _, base in text.PORTALS:
        link = F.when(F.col("portal") == name, text.absolute_link(F.col("card.href"), base)).otherwise(link)
    return (wanted.join(first, [*PAGE, "address"])
            .select("portal", "search_suburb", "search_post", "address", link.alias("url")))


def listing_urls(sales: DataFrame, cards: DataFrame, suburb: Column | None = None) -> DataFrame:
    """id, realestate_url, domain_url for every sale; NULL where nothing matched or the address is
    incomplete."""
    searches = _searches(sales, F.col("property_locality") if suburb is None else suburb)
    search = ["search_suburb", "search_post", "address"]
    found = (first_listings(searches, cards).groupBy(*search)
             .agg(F.max(F.when(F.col("portal") == "rea", F.col("url"))).alias("realestate_url"),
                  F.max(F.when(F.col("portal") == "domain", F.col("url"))).alias("domain_url")))
    return searches.join(found, search, "left").select("id", "realestate_url", "domain_url")


def listing_updates(pending: DataFrame, cards: DataFrame, checked_at: datetime) -> DataFrame:
    """Links plus the check time, which is set whether or not a listing was found."""
    return listing_urls(pending, cards).withColumn(
        "listings_last_checked", F.lit(checked_at).cast("timestamp_ntz"))


# --- user callbacks ------------------------------------------------------------------------------

def enrich(sales: DataFrame, pending: Column, process: Callable[[dict], dict | None],
           schema: str, needs: list[str] | None = None) -> DataFrame:
    """Run a user function on every pending sale: id, the columns of `schema`, and _error. Only id and the columns that
    the function `needs` (all, if not told) are handed to it.

    A sale whose call fails gets its error text and no values; one for which the function returns
    nothing gets neither. The others are not affected.
    """
    columns = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                row = dict.fromkeys(["id", *columns, "_error"])
                row["id"] = record["id"]
                try:
                    row.update({c: v for c, v in (process(record) or {}).items() if c in columns})
                except Exception as error:  # the callback's own failure stays with its record
                    row["_error"] = f"{type(error).__name__}: {error}"
                out.append(row)
            yield pd.DataFrame(out, columns=["id", *columns, "_error"], dtype=object)

    given = sales.filter(pending)
    if needs is not None:
        given = given.select("id", *[c for c in needs if c != "id"])
    return given.mapInPandas(run, f"id BIGINT, {schema}, _error STRING")
