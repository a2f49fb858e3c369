import random
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import enrich, filters, growth, neighbors, numbering, quantile, spatial
from parcelwise.plans import checks, reads
from parcelwise.schemas import CARDS_DDL, GAZETTEER_DDL, SALES_DDL, STATIONS_DDL


def sales_of(spark, rows):
    """Sales from dicts; ids by position, everything not given is NULL."""
    names = [c.split()[0] for c in SALES_DDL.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple({"id": i + 1, **row}.get(n) for n in names) for i, row in enumerate(rows)],
                                 SALES_DDL)


def sale(pid, day, price, street="Kent St", suburb="Sydney", post=2000, **more):
    return {"property_id": pid, "contract_date": day and date.fromisoformat(day), "purchase_price": price,
            "property_street_name": street, "property_locality": suburb, "property_post_code": post, **more}


def test_repeat_sales_edges(spark):
    rows = [
        sale("a", "2010-01-01", 100.0), sale("a", "2010-01-01", 200.0), sale("a", "2015-01-01", 300.0, "Other St"),
        sale("single", "2010-01-01", 100.0), sale("gap", "2010-01-01", None), sale("gap", "2011-01-01", 5.0),
        sale("nan", "2010-01-01", float("nan")), sale("nan", "2011-01-01", 5.0),
        sale("dateless", None, 5.0), sale("dateless", "2011-01-01", 5.0),
        sale(None, "2010-01-01", 1.0), sale(None, "2012-01-01", 2.0),
        sale("", "2010-01-01", 1.0, post=None), sale("", "2012-01-01", 2.0),
        sale("zero", "2010-01-01", 0.0), sale("zero", "2012-01-01", 2.0),
    ]
    got = {r.property_id: r for r in growth.repeat_sales(sales_of(spark, rows)).collect()}
    assert set(got) == {"a", "", "zero"}
    assert got["a"].first_sale_price == 100.0 and got["a"].last_sale_price == 300.0
    assert got["a"].street_name == "Kent St" and got["a"].last_sale_year == 2015
    assert got[""].post_code == 0
    assert got["zero"].cagr is None and got["zero"].total_growth is None


def test_growth_by_year_and_summaries(spark):
    rows = [
        sale("a", "1995-01-01", 100.0), sale("a", "1999-01-01", 200.0),
        sale("b", "2000-01-01", 100.0), sale("b", "2003-01-01", 200.0),
        sale("c", "2020-01-01", 100.0, post=None), sale("c", "2030-01-01", 200.0, post=None),
        sale("d", "2020-01-01", 100.0, street=None),
    ]
    sales = sales_of(spark, rows)
    repeats = growth.repeat_sales(sales)
    cube = growth.growth_cube(repeats)
    per_suburb = {r.year: r.property_count for r in growth.suburb_growth(cube).collect()}
    assert per_suburb == {y: 2 if y <= 2003 else 1 for y in range(2001, 2031)}  # up to the last year with a sale
    until = {r.year: r.property_count for r in growth.suburb_growth(growth.growth_cube(repeats, 2025)).collect()}
    assert until == {y: 2 if y <= 2003 else 1 for y in range(2001, 2026)}
    per_street = {(r.post_code, r.year) for r in growth.street_growth(cube).collect()}
    assert per_street == {(2000, y) for y in range(2001, 2004)} | {(0, y) for y in range(2001, 2031)}
    streets = growth.street_summary(sales, cube).collect()
    assert [(r.post_code, r.unique_properties, r.total_sales) for r in streets] == [(2000, 2, 4)]
    suburb = growth.suburb_summary(sales, cube).first()
    assert (suburb.unique_properties, suburb.total_sales, suburb.is_top_performer) == (4, 7, 1)


def test_no_repeat_sale_leaves_everything_empty_but_the_counts(spark):
    sales = sales_of(spark, [sale("a", "2010-01-01", 1.0), sale("b", "2010-01-01", 1.0)])
    cube = growth.growth_cube(growth.repeat_sales(sales))
    assert growth.suburb_growth(cube).count() == 0
    row = growth.suburb_summary(sales, cube).first()
    assert row.avg_cagr is None and row.is_top_performer == 0 and row.total_sales == 2


@pytest.mark.parametrize("values", [[1.0, 2.0, None, 4.0], [7.0], [], [0.0] * 500 + [1.0, 2.0],
                                    list(np.random.default_rng(1).normal(size=5000)),
                                    list(np.round(np.random.default_rng(2).normal(size=3000), 1))])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, values, share):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(4)
    got = spark.range(1).select(quantile.exact_quantile(df, "x", share, accuracy=100)).first()[0]
    series = pd.Series(values, dtype=float)
    expected = series.quantile(share)
    assert got is None if pd.isna(expected) else got == pytest.approx(expected, abs=1e-12)


def test_numbers_of_a_hot_property(spark):
    rng = np.random.default_rng(3)
    rows = [sale("hot" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"p{rng.integers(5)}",
                 None if rng.random() < 0.1 else f"20{rng.integers(10, 13)}-01-0{rng.integers(1, 4)}", 1.0)
            for _ in range(400)]
    sales = sales_of(spark, rows)
    got = {r.id: r.sale_number for r in numbering.number_sales(sales, slot_rows=7).collect()}
    pdf = sales.select("id", "property_id", "contract_date").toPandas()
    pdf["day"] = pd.to_datetime(pdf.contract_date).fillna(pd.Timestamp("1900-01-01"))
    pdf = pdf.sort_values(["day", "id"])
    pdf["n"] = pdf.groupby(pdf.property_id.fillna("<null>")).cumcount() + 1
    assert got == dict(zip(pdf.id, pdf.n))


def test_latest_sale_prefers_a_date(spark):
    sales = sales_of(spark, [sale("a", "2010-01-01", 1.0), sale("a", None, 2.0), sale("a", "2010-01-01", 3.0)])
    assert [r.id for r in numbering.latest_sales(sales).collect()] == [3]


def stations_of(spark, rows):
    return spark.createDataFrame([(i, f"s{i}", lat, lon) for i, (lat, lon) in enumerate(rows)], STATIONS_DDL)


def test_nearest_station(spark):
    rng = np.random.default_rng(4)
    points = [(-34 + float(a), 151 + float(b)) for a, b in rng.random((60, 2))]
    sales = sales_of(spark, [sale(str(i), "2010-01-01", 1.0, latitude=a, longitude=b) for i, (a, b) in enumerate(points)]
                     + [sale("x", "2010-01-01", 1.0, latitude=0.0, longitude=151.0), sale("y", "2010-01-01", 1.0)])
    spots = [(-34 + float(a), 151 + float(b)) for a, b in rng.random((23, 2))]
    stations = stations_of(spark, spots + spots[:3])
    inline = spatial.with_nearest_station(sales, stations).select("id", "nearest_station", "distance_to_station")
    blocks = spatial.with_nearest_station(sales, stations, max_inline=5).select("id", "nearest_station", "distance_to_station")
    want = {}
    for i, (a, b) in enumerate(points):
        dist = []
        for c, d in spots:
            h = (np.sin(np.radians(c - a) / 2) ** 2
                 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2)
            dist.append(2 * 6371 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)))
        want[i + 1] = (f"s{int(np.argmin(dist))}", round(min(dist), 6))
    want |= {61: (None, None), 62: (None, None)}
    for df in (inline, blocks):
        got = {r.id: (r.nearest_station, r.distance_to_station and round(r.distance_to_station, 6)) for r in df.collect()}
        assert got == want


def test_equally_near_stations(spark):
    """Mirrored east and west: the one listed first is the nearest, however stations reach the search."""
    spots = [(-34 + i * 0.01, 151 + (i * 7 % 100) * 0.01) for i in range(200)]
    sales = sales_of(spark, [sale(str(i), "2010-01-01", 1.0, latitude=a, longitude=b) for i, (a, b) in enumerate(spots)])
    stations = stations_of(spark, [(a, b + side * 0.004) for a, b in spots for side in (1, -1)])
    for most in (5_000, 7):
        found = spatial.with_nearest_station(sales, stations, max_inline=most)
        assert {r.id: r.nearest_station for r in found.collect()} == {i + 1: f"s{2 * i}" for i in range(200)}


def test_stations_without_place_or_number(spark):
    sales = sales_of(spark, [sale("a", "2010-01-01", 1.0, latitude=-34.0, longitude=151.0)])
    stations = spark.createDataFrame([(None, "last", -34.0, 151.0), (5, "first", -34.0, 151.0), (1, "none", None, 151.0)], STATIONS_DDL)
    for most in (5_000, 1):
        assert spatial.with_nearest_station(sales, stations, max_inline=most).first().nearest_station == "first"


def test_no_stations(spark):
    sales = sales_of(spark, [sale("a", "2010-01-01", 1.0, latitude=-34.0, longitude=151.0)])
    row = spatial.with_nearest_station(sales, spark.createDataFrame([], STATIONS_DDL)).first()
    assert row.nearest_station is None and row.distance_to_station is None


def test_neighbors(spark):
    sales = sales_of(spark, [
        sale("a", "2010-01-01", 1.0, "A St", "X", latitude=-34.0, longitude=151.0),
        sale("b", "2010-01-01", 1.0, "B St", "X", latitude=-34.1, longitude=151.0),
        sale("b", "2012-01-01", 2.0, "B St", "X", latitude=-34.1, longitude=151.0),
        sale("c", "2010-01-01", 1.0, "C St", "Y", post=None, latitude=-34.01, longitude=151.0),
        sale("c", "2012-01-01", 2.0, "C St", "Y", post=None, latitude=-34.01, longitude=151.0),
        sale("e", "2010-01-01", 1.0, "E St", "X"),
    ])
    repeats = growth.repeat_sales(sales)
    cube = growth.growth_cube(repeats)
    summary = growth.street_summary(sales, cube)
    streets = reads.street_centroids(sales)
    # C St is nearest but has no postcode, hence no summary.
    assert [r.street_name for r in reads.neighbor_streets(streets, summary, "A St", "X").collect()] == ["B St"]
    assert reads.neighbor_streets(streets, summary, "E St", "X").count() == 0
    fallback = reads.neighbor_streets(streets, summary, "E St", "X", fallback=True).collect()
    assert sorted(r.street_name for r in fallback) == ["A St", "B St"]
    near = reads.neighbor_properties(sales, growth.property_growth(repeats), "a").collect()
    assert [r.id for r in near] == [4, 5, 2, 3]
    one_each = reads.neighbor_properties(sales, growth.property_growth(repeats), "a", distinct_property=True).collect()
    assert [r.property_id for r in one_each] == ["c", "b"]
    assert reads.neighbor_properties(sales, growth.property_growth(repeats), "e").count() == 0
    suburbs = growth.suburb_summary(sales, cube)
    assert [r.suburb for r in reads.neighbor_suburbs(reads.suburb_centroids(sales), suburbs, "X").collect()] == ["Y"]
    flat = reads.unified_map_streets(growth.street_growth(cube), streets, summary, 2012)
    assert [(r.rank, r.name, r.neighbor_name) for r in flat.orderBy("rank", "neighbor_rank").collect()] == [
        (1, "B St, X", "A St, X"), (2, "C St, Y", "A St, X"), (2, "C St, Y", "B St, X")]
    nested = reads.map_clusters(flat).collect()
    assert [[n.name for n in r.neighbors] for r in nested] == [["A St, X"], ["A St, X", "B St, X"]]


def test_filters_and_paging(spark):
    sales = sales_of(spark, [sale("a", f"2010-01-{d:02d}", float(d), area=float(d)) for d in range(1, 11)]
                     + [sale("n", None, 3.0)])
    none = spark.createDataFrame([], "property_id string, cagr double, total_growth double, years_held double")
    stations = spark.createDataFrame([], STATIONS_DDL)

    def ids(**args):
        return [r.id for r in reads.sales_list(sales, none, stations, **args).collect()]

    assert ids(limit=3) == [10, 9, 8]
    assert ids(skip=9) == [1, 11]
    assert ids(limit=-1, skip=-5) == [*range(10, 0, -1), 11]
    assert ids(min_price=0, max_price=0, limit=2, suburb="") == [10, 9]
    assert ids(suburb="yDn_") == ids(suburb="%y") == ids()
    assert ids(min_growth=0) == []
    assert ids(min_area=4, max_area=5) == [5, 4]
    args = filters.dashboard_filters(2010, price_min=2, price_max=10_000_000)
    assert args["max_price"] is None and ids(**args) == list(range(10, 1, -1))


def test_history_of_unknown_property(spark):
    none = spark.createDataFrame([], "property_id string, cagr double, total_growth double, years_held double")
    sales = sales_of(spark, [sale("a", "2010-01-01", 1.0)])
    assert reads.property_history(sales, none, spark.createDataFrame([], STATIONS_DDL), "nonexistent_id").count() == 0


def test_lookups_always_give_one_row(spark):
    table = spark.createDataFrame([("X", 2024, 0.1, 3)], "suburb string, year int, avg_cagr double, property_count bigint")
    assert reads.suburb_cagr(table, "X").collect() == [("X", 2024, 0.1, 3)]
    assert reads.suburb_cagr(table, "Y", 2020).collect() == [("Y", 2020, None, 0)]


def test_geocoding(spark):
    sales = sales_of(spark, [
        sale("a", "2010-01-01", 1.0, property_house_number="1"), sale("b", "2010-01-01", 1.0, property_house_number="2"),
        sale("c", "2010-01-01", 1.0, property_house_number="1", latitude=-30.0, longitude=150.0),
        sale("d", "2010-01-01", 1.0, property_house_number="1", latitude=0.0, longitude=0.0)])
    gazetteer = spark.createDataFrame([("1 kent st, sydney", -33.0, 151.0), ("1 kent st, sydney", -32.0, 151.0),
                                       ("2 kent st, sydney", 0.0, 151.0)], GAZETTEER_DDL)
    from parcelwise.functions import text
    address = text.local_address(F.col("property_house_number"), F.col("property_street_name"), F.col("property_locality"))
    updates = enrich.geocoded(enrich.coordinates_pending(sales), gazetteer, address)
    assert sorted(map(tuple, updates.collect())) == [(1, -33.0, 151.0), (2, None, None)]
    assert enrich.enrichment_counts(updates, "latitude").first() == (2, 1)
    merged = enrich.apply_updates(sales, updates, ["latitude", "longitude"])
    assert {r.id: r.latitude for r in merged.collect()} == {1: -33.0, 2: None, 3: -30.0, 4: 0.0}
    assert sorted(r.id for r in enrich.by_ids(sales, [1, 3, 4]).collect()) == [1, 4]
    assert sorted(r.id for r in enrich.by_ids(sales, [*range(1, 40), 1, 4]).collect()) == [1, 2, 4]
    assert [r.id for r in enrich.by_ids(sales, spark.createDataFrame([(2,), (2,)], "id long")).collect()] == [2]


def test_listing_match_equals_containment(spark):
    rng = np.random.default_rng(5)
    houses, streets, posts = ["1", "12", "2", "22", "3/4"], ["Kent St", "Ken", "A", "Été Rd", ""], [2000, None, 0]
    sales = sales_of(spark, [sale(str(i), "2010-01-01", 1.0, str(rng.choice(streets)), "Potts Point",
                                  posts[rng.integers(3)], property_house_number=str(rng.choice(houses)))
                             for i in range(120)])
    cards = []
    for i in range(60):
        portal = ["rea", "domain"][i % 2]
        body = f"{rng.choice(houses)}{rng.choice(houses)} {rng.choice(streets).upper()}ON, x 2 KENT ST" if i % 3 else "2 kent"
        cards.append((portal, "potts+point" if portal == "rea" else "potts-point", posts[rng.integers(3)], int(60 - i),
                      body, [None, "", f"/c{i}", f"http://h/c{i}"][rng.integers(4)]))
    got = {r.id: (r.realestate_url, r.domain_url)
           for r in enrich.listing_urls(sales, spark.createDataFrame(cards, CARDS_DDL)).collect()}

    def first(portal, base, s):
        address = f"{s.property_house_number} {s.property_street_name}".lower()
        for c in sorted(cards, key=lambda c: c[3]):
            if (s.property_street_name and c[0] == portal and (c[2] or 0) == (s.property_post_code or 0)
                    and address in c[4].lower() and c[5]):
                return c[5] if c[5].startswith("http") else base + c[5]
        return None

    want = {s.id: (first("rea", "https://www.realestate.com.au", s), first("domain", "https://www.domain.com.au", s))
            for s in sales.collect()}
    assert got == want and any(v != (None, None) for v in want.values())


def test_listing_pieces_are_filtered(spark, monkeypatch):
    """A page with many addresses, one of few, odd letters, repeated cards: what contains is found, and little else is shuffled."""
    rnd = random.Random(5)
    streets = ["red plate st", "röd väg", "İstanbul ave", "a", "plate", "ed plate s", "long " * 9 + "way"]
    sales = [("s1" if rnd.random() < 0.95 else "s2", f"{rnd.randint(1, 900)} {rnd.choice(streets)}".lower()) for _ in range(3000)]
    searches = spark.createDataFrame([(suburb, "2000", address) for suburb, address in sales], "search_suburb string, search_post string, address string")
    cards = [(rnd.choice(["rea", "domain"]), rnd.choice(["s1", "s2"]), 2000, k // 2, rnd.choice([None, "", f"/{k}", f"/{k}"]),
              rnd.choice([f"Unit {rnd.randint(1, 9)}/{rnd.randint(1, 900)} {rnd.choice(streets).upper()}, {rnd.random()} Town", "", None]))
             for k in range(1500)]
    shown = spark.createDataFrame([(f"p{k}", *card) for k, card in enumerate(cards)],
                                  "page_url string, portal string, suburb_slug string, post_code int, position int, href string, card_address string")
    lower = {r.card_address: r.low for r in shown.select("card_address", F.lower("card_address").alias("low")).distinct().collect()}
    want = {}
    for portal, slug, _, position, href, body in cards:
        if href and body:
            for suburb, address in {a for a in sales if a[0] == slug and a[1] in lower[body]}:
                key = (portal, suburb, address)
                want[key] = min(want.get(key, (position, href)), (position, href))
    found = {(r.portal, r.search_suburb, r.address): r.url for r in enrich.first_listings(searches, shown).collect()}
    assert len(want) > 50 and found.keys() == want.keys()
    assert all(found[key].endswith(href) for key, (_, href) in want.items())

    wanted = searches.distinct().select("*", F.explode(F.array(F.lit("rea"), F.lit("domain"))).alias("portal"), F.col("search_suburb").alias("slug"))
    linked = shown.filter("href != ''")
    shuffled = enrich._pieces(wanted, shown).agg(F.sum(F.length("address"))).first()[0]
    assert shuffled < linked.agg(F.sum(F.length("card_address"))).first()[0]
    monkeypatch.setattr(enrich, "MOST_BITS", 6)  # a filter that is far too small changes nothing
    assert {(r.portal, r.search_suburb, r.address): r.url for r in enrich.first_listings(searches, shown).collect()} == found


def test_listings_due(spark):
    sales = sales_of(spark, [sale("a", "2010-01-01", 1.0), sale("b", "2010-01-01", 1.0, listings_last_checked=datetime(2024, 1, 1)),
                             sale("c", "2010-01-01", 1.0, listings_last_checked=datetime(2024, 1, 5))])
    assert sorted(r.id for r in enrich.listings_due(sales, datetime(2024, 1, 10)).collect()) == [1, 2]


def test_callback_failures_stay_with_their_record(spark):
    def process(record):
        if record["property_id"] == "bad":
            raise RuntimeError("boom")
        return {"latitude": -33.5, "unknown": 1} if record["property_id"] == "good" else None

    sales = sales_of(spark, [sale("good", "2010-01-01", 1.0), sale("bad", None, 1.0), sale("none", "2010-01-01", 1.0),
                             sale("done", "2010-01-01", 1.0, latitude=1.0)])
    got = enrich.enrich(sales, F.col("latitude").isNull(), process, "latitude DOUBLE").collect()
    assert sorted(map(tuple, got)) == [(1, -33.5, None), (2, None, "RuntimeError: boom"), (3, None, None)]


def test_checks(spark):
    sales = sales_of(spark, [sale("a", "2010-01-01", 100.0, latitude=-34.0), sale("a", "2012-01-01", 200.0),
                             sale("b", "2010-01-01", 100.0)])
    assert checks.completeness(sales).first() == (3, 2, 3, 66.7, 100.0)
    assert checks.completeness(sales.limit(0)).first() == (0, 0, 0, 0.0, 0.0)
    stored = growth.property_growth(growth.repeat_sales(sales))
    assert [r.status for r in checks.reconcile_growth(stored, sales).collect()] == ["PASS"]
    off = stored.withColumn("cagr", F.col("cagr") + 0.01)
    assert [r.status for r in checks.reconcile_growth(off, sales).collect()] == ["FAIL"]


@pytest.mark.parametrize("kind", ["clumps", "moving"])
def test_neighbors_of_all_equal_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(140):
        # A third at one spot, a dense clump, the rest scattered; in the second case one property roams.
        spot = ((-34.0, 151.0) if i % 3 == 0 else (-34.2 + rng.random() * 1e-7, 151.1 + rng.random() * 1e-7) if i % 3 == 1
                else (-34 + float(rng.random()), 151 + float(rng.random())))
        pid = f"p{rng.integers(40)}" if kind == "clumps" or i % 2 else "roamer"
        rows.append(sale(pid, "2010-01-01", 1.0, latitude=float(spot[0]), longitude=float(spot[1])))
    sales = sales_of(spark, rows + [sale("off", "2010-01-01", 1.0)])
    rated = {r["property_id"] for r in rows if r["property_id"] != "p3"}
    growth_rows = spark.createDataFrame([(p,) for p in sorted(rated)], "property_id string")
    for k in (2, 5):
        got = {}
        for r in neighbors.nearest_sales_of_all(sales, growth_rows, k).collect():
            got.setdefault(r.property_id, []).append((r.neighbor_rank, r.id))
        pts = [(i + 1, r["property_id"], r["latitude"], r["longitude"]) for i, r in enumerate(rows)]
        for pid in {p[1] for p in pts}:
            _, _, lat, lon = min(p for p in pts if p[1] == pid)
            near = sorted(((c[2] - lat) * (c[2] - lat) + (c[3] - lon) * (c[3] - lon), c[0]) for c in pts
                          if c[1] != pid and c[1] in rated)
            assert sorted(got[pid]) == [(n + 1, i) for n, (_, i) in enumerate(near[:k])], (kind, k, pid)


def test_neighbors_in_thin_country_meet_few_leaves(spark):
    """A dense square and positions far from it: each meets a bounded number of leaves, not the square."""
    rng = np.random.default_rng(8)
    city = [(-33.5 + float(a) * 0.05, 151 + float(b) * 0.05) for a, b in rng.random((3000, 2))]
    country = [(-36 + float(a) * 6, 145 + float(b) * 12) for a, b in rng.random((40, 2))]
    spots = spark.createDataFrame([(a, b, 1, [(i, str(i))]) for i, (a, b) in enumerate(city + country)],
                                  "lat double, lon double, n long, rows array<struct<id:long,neighbor_property_id:string>>")
    spots = spots.selectExpr("*", "(lat + 36.0) / 12.1 as u", "(lon - 145.0) / 12.1 as v", "12.1 as size")
    levels = F.explode(F.sequence(F.lit(0), F.lit(neighbors.FINEST_LEVEL), F.lit(neighbors.LEVEL_STEP))).alias("level")
    cells = (neighbors._at_level(spots.select("u", "v", "n", levels)).groupBy(*neighbors.CELL).agg(F.sum("n").alias("n"))
             .withColumn("inner", (F.col("n") > neighbors.LEAF_SALES) & (F.col("level") < neighbors.FINEST_LEVEL))).cache()
    placed = neighbors._in_leaves(spots, cells)
    assert placed.count() == len(city) + len(country)
    met = neighbors._walk(spots.select("lat", "lon", "u", "v", "size"), cells, 10).join(placed, neighbors.CELL).groupBy("lat", "lon").count()
    assert met.agg(F.max("count")).first()[0] < 1000 and met.agg(F.avg("count")).first()[0] < 300
