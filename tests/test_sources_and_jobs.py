import io
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from parcelwise.plans import jobs
from parcelwise.schemas import CARDS_DDL, GAZETTEER_DDL
from parcelwise.sources import archive, stations, tables
from parcelwise.sources.listings import extract_cards, search_cards
from parcelwise.sources.records import parse_records
from parcelwise.streaming.drops import ingest_drops

AS_OF = date(2024, 12, 31)


def record(pid, day="20200131", price="100", house="1", street="KENT ST", fields=25, kind="B", name=""):
    parts = [kind, "D1", pid, "1", "20240101 00:00", name, "", house, street, "SYDNEY", "2000", "5.5", "M", day, "",
             price, "R2", "R", "RESIDENCE", "", "", "", "", "AB1", ""]
    return ";".join(parts[:fields])


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def make_archives(folder):
    first = zipped({"a/One.DAT": "\r\n".join([record("p1"), record("p1", "20220131", "200"), "A;x", record("short", fields=24)]),
                    "latin.dat": (record("p2", name="CAFÉ") + "\n").encode("latin-1"),
                    "readme.txt": record("no")})
    damaged = bytearray(zipped({"x.dat": record("lost") * 50}))
    damaged[60:70] = b"\0" * 10
    second = zipped({"two.dat": record("p3", "bad") + "\x85" + record("future", "29990101") + "\n" + record("p1", "20220131", "300")})
    (folder / "2001.zip").write_bytes(zipped({"w1.zip": first, "W2.ZIP": b"no zip", "w3.zip": bytes(damaged),
                                              "direct.dat": record("ignored")}))
    (folder / "2003.zip").write_bytes(zipped({"w1.zip": second}))
    (folder / "2004.zip").write_bytes(b"broken")
    (folder / "2030.zip").write_bytes(zipped({"w1.zip": second}))


def test_parse_record(spark):
    lines = [record("p1", street="O'CONNOR ST ", house=" 12\t"), record("f", "29990101"), record("d", "x"),
             record("s", fields=24), record("k", kind="A"), " " + record("lead")]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = {r.property_id: r for r in parse_records(df, AS_OF).collect()}
    assert set(got) == {"p1", "d"}
    row = got["p1"]
    assert (row.property_street_name, row.property_house_number, row.property_locality) == ("O'Connor St", "12", "Sydney")
    assert (row.contract_date, row.settlement_date, row.purchase_price) == (date(2020, 1, 31), None, 100.0)
    assert (row.property_post_code, row.area, row.property_name, row.dealing_number) == (2000, 5.5, "", "AB1")


def test_archives(spark, tmp_path):
    make_archives(tmp_path)
    lines = archive.archive_lines(archive.read_archives(spark, str(tmp_path))).cache()
    bad = {(r.path[-8:], r.inner, r.member) for r in archive.bad_files(lines).collect()}
    assert ("2001.zip", "W2.ZIP", None) in bad and ("2004.zip", None, None) in bad
    assert any(inner == "w3.zip" for _, inner, _ in bad)
    sales = archive.sales_from_lines(lines, AS_OF).orderBy("id").collect()
    assert [(r.property_id, r.purchase_price) for r in sales] == [
        ("p1", 100.0), ("p1", 200.0), ("p2", 100.0), ("p3", 100.0), ("p1", 300.0), ("p3", 100.0), ("p1", 300.0)]
    assert sales[2].property_name == "Café"
    assert len({r.id for r in sales}) == 7
    one = archive.read_archives(spark, str(tmp_path), 2002, 2003)
    assert [r.path[-8:] for r in one.collect()] == ["2003.zip"]
    rest = archive.read_archives(spark, str(tmp_path), done=one)
    assert sorted(r.path[-8:] for r in rest.collect()) == ["2001.zip", "2004.zip", "2030.zip"]
    assert [r.path[-8:] for r in archive.read_archives(spark, str(tmp_path), start_year=2005).collect()] == ["2030.zip"]


def test_ids_of_any_names(spark, tmp_path):
    """Weekly drops of one year, and names without a year."""
    for name in ("20240101.zip", "20240108.zip", "drop.ZIP", "2024.zip"):
        (tmp_path / name).write_bytes(zipped({"w.zip": zipped({"a.dat": record("p1") + "\n" + record("p2"), "b.dat": record("p3")})}))
    lines = archive.archive_lines(archive.read_archives(spark, str(tmp_path))).cache()
    sales = archive.sales_from_lines(lines, AS_OF)
    assert sales.count() == 12 == sales.select("id").distinct().count()
    assert [r.property_id for r in sales.orderBy("id").collect()] == ["p1", "p2", "p3"] * 4
    known = spark.createDataFrame([("other", 7)], "path string, archive_no long")
    numbers = archive.numbered_archives(lines, known)
    assert sorted(r.archive_no for r in numbers.collect()) == [7, 8, 9, 10, 11]
    assert archive.sales_from_lines(lines, AS_OF, numbers).agg(F.min("id")).first()[0] == 8 << archive.LINE_BITS


def test_lines_across_chunks(monkeypatch):
    text = "a\r\nb\x0bc d\n\ne\r\rf éé"
    body = zipped({"m.dat": text})
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(archive, "CHUNK_BYTES", size)
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            assert archive._encoding(z, "m.dat") == "utf-8"
            assert list(archive._lines(z, "m.dat", "utf-8")) == text.splitlines()


def test_stations(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_bytes(b",Station,Latitude,Longitude\r\n0,Allawah,-33.9697,151.1145\r\n1,\"St Mary's\",-33.7,150.7\r\n")
    assert [tuple(r) for r in stations.load_stations(spark, str(path)).collect()] == [
        (0, "Allawah", -33.9697, 151.1145), (1, "St Mary's", -33.7, 150.7)]
    assert stations.load_stations(spark, str(tmp_path / "none.csv")).count() == 0


def test_table_versions(spark, tmp_path):
    root = str(tmp_path)
    tables.write_table(spark.range(3), root, "t")
    old = tables.read_table(spark, root, "t")
    tables.write_table(old.filter("id > 0"), root, "t")
    (tmp_path / "t" / "v000003").mkdir()  # a write that did not finish
    assert tables.read_table(spark, root, "t").count() == 2 and old.count() == 3
    assert tables.write_table(spark.range(1), root, "t").endswith("v000004")
    tables.write_table(spark.range(3).selectExpr("id", "id AS year").filter("id > 5"), root, "by_year", ["year"])
    assert tables.read_table(spark, root, "by_year").columns == ["id", "year"]
    tables.add_part(spark.range(7, 9), root, "t", "more")
    tables.add_part(spark.range(7, 10), root, "t", "more")
    assert tables.parts(spark, root, "t") == ["more"] and tables.read_table(spark, root, "t").count() == 4
    assert tables.read_table(spark, root, "t", added=[]).count() == 1 and tables.read_table(spark, root, "t", base=False).count() == 3
    tables.write_table(spark.range(2), root, "t")
    assert tables.read_table(spark, root, "t").count() == 2


def test_cards(spark):
    html = ('<p>x<article class="big residential-card"><span class="address">1 A &amp; <i>B</i></span><a href="/no">n</a>'
            '<a class="details-link" href="/yes"></a></article><article class="residential-card"><a class="details-link">'
            '</a><a class="details-link" href="/late"></a></article>')
    pages = spark.createDataFrame([("u", "rea", html), ("v", "other", html), ("w", "domain", None)],
                                  "page_url string, portal string, html string")
    assert sorted(map(tuple, extract_cards(pages).collect())) == [
        ("u", "rea", 0, "1 A & B", "/yes", None), ("u", "rea", 1, None, None, None)]
    odd = spark.createDataFrame([("odd", "rea", html + "<![foo[bar]]>" + html), ("u", "rea", html)], pages.schema)
    got = extract_cards(odd).collect()
    assert sorted(r.position for r in got if r.page_url == "u") == [0, 1]
    assert [r._error.split(":")[0] for r in got if r._error] == ["AssertionError"] and len([r for r in got if r.page_url == "odd"]) == 3
    known = pages.selectExpr("*", "'potts+point' as suburb_slug", "2000 as post_code")
    assert ("rea", "potts+point", 2000, 0, "1 A & B", "/yes") in set(map(tuple, search_cards(known).collect()))


def test_jobs(spark, tmp_path):
    drops, root = tmp_path / "in", str(tmp_path / "out")
    drops.mkdir()
    make_archives(drops)
    counts = jobs.ingest(spark, str(drops), root, end_year=2024, as_of=AS_OF).first()
    assert (counts.archives, counts.sales) == (3, 5)
    bad = {(r.path[-8:], r.inner) for r in tables.read_table(spark, root, "bad_files").collect()}
    assert bad == {("2001.zip", "W2.ZIP"), ("2001.zip", "w3.zip"), ("2004.zip", None)} and counts.bad_files == 3
    jobs.build_growth(spark, root)
    growth = tables.read_table(spark, root, "property_growth").collect()
    assert [(r.property_id, r.first_sale_price, r.last_sale_price) for r in growth] == [("p1", 100.0, 300.0)]
    assert tables.read_table(spark, root, "suburb_growth").count() == 22
    assert tables.read_table(spark, root, "street_summary").first().is_top_performer == 1

    gazetteer = spark.createDataFrame([("1 kent st, sydney nsw 2000", -33.9, 151.2)], GAZETTEER_DDL)
    assert jobs.geocode_sales(spark, root, gazetteer, limit=2, offset=1).first() == (2, 2)
    assert jobs.geocode_sales(spark, root, gazetteer).first() == (3, 3)
    cards = spark.createDataFrame([("rea", "sydney", 2000, 1, "1 KENT ST", "/a")], CARDS_DDL)
    assert jobs.check_listings(spark, root, cards, datetime(2024, 1, 1)).first() == (5, 5)
    assert jobs.refresh_listings(spark, root, cards.limit(0), datetime(2024, 1, 5)).first() == (0, 0)
    assert jobs.refresh_listings(spark, root, cards.limit(0), datetime(2024, 2, 1), "p1").first() == (1, 1)
    sales = jobs.read_sales(spark, root)
    assert tables.current_version(spark, root, "sales") == "v000001"  # enrichment rewrites no sales
    assert spark.read.parquet(f"{root}/enrichment/v000001").groupBy("seq").count().count() == 4
    assert sales.filter("latitude = -33.9").count() == 5
    assert sales.filter("realestate_url IS NULL AND listings_last_checked = timestamp_ntz'2024-02-01'").count() == 1
    assert sales.filter(F.col("realestate_url") == "https://www.realestate.com.au/a").count() == 4

    before = {r.id for r in sales.collect()}
    kept = sales.select("id", *jobs.ENRICHED)
    jobs.ingest(spark, str(drops), root, end_year=2024, as_of=AS_OF, enrichment=kept)
    again = jobs.read_sales(spark, root)
    assert {r.id for r in again.collect()} == before and again.filter("latitude = -33.9").count() == 5
    more = jobs.ingest(spark, str(drops), root, as_of=AS_OF, keep_existing=True).first()
    assert (more.archives, more.sales, more.bad_files) == (4, 7, 3)
    assert tables.read_table(spark, root, "sales").filter("latitude = -33.9").count() == 5
    gazetteer = spark.createDataFrame([("1 kent st, sydney nsw 2000", -33.8, 151.1)], GAZETTEER_DDL)
    assert jobs.geocode_sales(spark, root, gazetteer).first() == (2, 2)
    jobs.ingest(spark, str(drops), root, as_of=AS_OF)
    assert jobs.read_sales(spark, root).filter("latitude IS NOT NULL").count() == 0
    assert len(tables.vacuum(spark, root, "sales")) == 1 and jobs.read_sales(spark, root).count() == 7


def test_stream_of_drops(spark, tmp_path):
    drops = tmp_path / "in"
    drops.mkdir()
    make_archives(drops)
    (drops / "drop.zip").write_bytes(zipped({"w.zip": zipped({"n.dat": record("odd name")})}))
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    ingest_drops(spark, str(drops), root, checkpoint, AS_OF).awaitTermination()
    assert jobs.read_sales(spark, root).count() == 8
    assert tables.read_table(spark, root, "bad_files").count() == 3
    (drops / "2005.zip").write_bytes(zipped({"w.zip": zipped({"n.dat": record("new")})}))
    ingest_drops(spark, str(drops), root, checkpoint, AS_OF).awaitTermination()
    got = jobs.read_sales(spark, root)
    assert got.count() == 9 == got.select("id").distinct().count() and got.filter("property_id = 'new'").count() == 1


def test_streams_and_jobs_share_sales(spark, tmp_path):
    """Whichever reads an archive first adds it to the one table; the other skips it, and growth sees all."""
    drops, root, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    drops.mkdir()

    def drop(year, *records):
        (drops / f"{year}.zip").write_bytes(zipped({"w.zip": zipped({"n.dat": "\n".join(records)})}))

    drop(2001, record("p1", "20010131", "100"))
    assert jobs.ingest(spark, str(drops), root, as_of=AS_OF).first() == (1, 1, 0)
    drop(2002, record("p1", "20020131", "200"))
    ingest_drops(spark, str(drops), root, checkpoint, AS_OF).awaitTermination()
    assert tables.parts(spark, root, "sales") == ["batch-0"] and jobs.read_sales(spark, root).count() == 2
    drop(2003, record("p1", "20030131", "300"), record("p2", "20030131"))
    assert jobs.ingest(spark, str(drops), root, as_of=AS_OF, keep_existing=True).first() == (3, 4, 0)
    assert jobs.ingest(spark, str(drops), root, as_of=AS_OF, keep_existing=True).first() == (3, 4, 0)
    ingest_drops(spark, str(drops), root, checkpoint, AS_OF).awaitTermination()
    assert tables.parts(spark, root, "sales") == ["archives-3", "batch-0", "batch-1"]
    sales = jobs.read_sales(spark, root)
    assert sorted(r.purchase_price for r in sales.collect()) == [100.0, 100.0, 200.0, 300.0] and sales.select("id").distinct().count() == 4
    jobs.build_growth(spark, root)
    assert [r.last_sale_price for r in jobs.read_growth(spark, root).collect()] == [300.0]
    drop(2004, record("p1", "20040131", "50"), record("p3"))
    ingest_drops(spark, str(drops), root, checkpoint, AS_OF).awaitTermination()
    jobs.extend_growth(spark, root)
    assert [(r.first_sale_price, r.last_sale_price) for r in jobs.read_growth(spark, root).collect()] == [(100.0, 50.0)]
    assert tables.read_table(spark, root, "suburb_summary").first().total_sales == 6
    gazetteer = spark.createDataFrame([("1 kent st, sydney nsw 2000", -33.8, 151.1)], GAZETTEER_DDL)
    assert jobs.geocode_sales(spark, root, gazetteer).first() == (6, 6)
    before = {tuple(r) for r in jobs.read_sales(spark, root).collect()}
    jobs.compact_sales(spark, root)
    assert {tuple(r) for r in jobs.read_sales(spark, root).collect()} == before and len(before) == 6
    assert tables.current_version(spark, root, "sales") == "v000002" and not tables.parts(spark, root, "sales")
    assert jobs.ingest(spark, str(drops), root, as_of=AS_OF, keep_existing=True).first().sales == 6
    built = tables.current_version(spark, root, "property_spans")
    jobs.extend_growth(spark, root)  # nothing new
    assert tables.current_version(spark, root, "property_spans") == built
    (drops / "2004.zip").unlink()
    # A range of years replaces all; what it left out is read again when asked for.
    assert jobs.ingest(spark, str(drops), root, 2003, 2003, as_of=AS_OF).first().sales == 2
    assert jobs.ingest(spark, str(drops), root, as_of=AS_OF, keep_existing=True).first().sales == 4


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file whose archive begins after 2.5 GB, stored and packed inner archives: nothing but its ends is read."""
    inner = zipped({"a.dat": record("p1") + "\n" + record("p2")})
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as outer:
        outer.writestr("stored.zip", inner, zipfile.ZIP_STORED)
        outer.writestr("packed.zip", inner, zipfile.ZIP_DEFLATED)
    with open(tmp_path / "2024.zip", "wb") as file:
        file.seek(2_500_000_000)
        file.write(body.getvalue())
    lines = archive.archive_lines(archive.read_archives(spark, str(tmp_path)))
    assert sorted((r.inner, r.line_no, r.error) for r in lines.collect()) == [(n, i, None) for n in ("packed.zip", "stored.zip") for i in (0, 1)]


def test_content_and_seeking_agree(spark, tmp_path, monkeypatch):
    make_archives(tmp_path)
    monkeypatch.setattr(archive, "HELD_BYTES", 0)
    by_path, by_content = (archive.archive_lines(archive.read_archives(spark, str(tmp_path), content=c)) for c in (False, True))
    told = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert told(by_path) == told(by_content)
    assert not archive.seekable("viewfs://store/in") and archive.seekable(str(tmp_path))
