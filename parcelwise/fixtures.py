"""Property-market inputs derived by Spark from the TPC-H-like test tables."""

from __future__ import annotations

import contextlib
import io
import itertools
import shutil
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.archive import store_of
from .sources.tables import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sale per order line; a property is a part sold by a twentieth of the suppliers."""
    lines = _table(spark, sf_dir, "lineitem")
    part = _table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    supplier = _table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    day = "cast(cast(l_shipdate as date) + interval 20 years as date)"
    return lines.join(part, "l_partkey").join(supplier, "l_suppkey").selectExpr(
        "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber as id",
        "concat('D', s_nationkey % 5) as district_code",
        "concat(l_partkey, '-', l_suppkey % 20) as property_id",
        "cast(l_linenumber as string) as sale_counter",
        "'20240101 00:00' as download_datetime",
        "'' as property_name",
        "'' as property_unit_number",
        "cast(l_linenumber as string) as property_house_number",
        "p_name as property_street_name",
        "p_brand as property_locality",
        "case when s_nationkey % 4 = 3 then null else 2000 + s_nationkey % 4 end as property_post_code",
        "l_quantity * 10 as area",
        "'M' as area_type",
        f"case when l_linenumber = 6 and l_quantity = 49 then null else {day} end as contract_date",
        f"date_add({day}, 42) as settlement_date",
        "case when l_linenumber = 7 and l_quantity = 50 then null else l_extendedprice end as purchase_price",
        "'R2' as zoning",
        "'R' as nature_of_property",
        "case l_returnflag when 'R' then 'Residence' when 'A' then 'Strata Unit' else 'Commercial' end"
        " as primary_purpose",
        "'' as strata_lot_number",
        "'AB123' as dealing_number",
        "cast(null as string) as property_legal_description",
        "case when l_partkey % 11 = 0 then null"
        " else -34e0 + cast(substr(p_brand, 7) as int) * 0.017e0 + (l_partkey % 10) * 0.001e0 end as latitude",
        "case when l_partkey % 11 = 0 then null"
        " else 150.5e0 + ((cast(substr(p_brand, 7) as int) * 7) % 25) * 0.021e0 + (l_partkey % 13) * 0.001e0 end"
        " as longitude",
        "case when l_partkey % 3 = 0 then '/old' end as realestate_url",
        "cast(null as string) as domain_url",
        f"case when l_suppkey % 3 > 0 then cast({day} as timestamp_ntz) end as listings_last_checked",
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as idx", "n_name as station", "-34e0 + n_nationkey * 0.017e0 + 0.0005e0 as latitude",
        "150.5e0 + ((n_nationkey * 7) % 25) * 0.021e0 + 0.0005e0 as longitude")


def mirrored_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stations for each spot of `between_stations`, east and west of it and equally far; the western ones are listed later."""
    return _table(spark, sf_dir, "nation").selectExpr(
        "inline(array(named_struct('idx', 2 * n_nationkey, 'station', concat(n_name, ' E'), 'latitude', -34e0 + n_nationkey * 0.017e0,"
        " 'longitude', 150.5e0 + n_nationkey * 0.021e0 + 0.003e0), named_struct('idx', 2 * n_nationkey + 1, 'station',"
        " concat(n_name, ' W'), 'latitude', -34e0 + n_nationkey * 0.017e0, 'longitude', 150.5e0 + n_nationkey * 0.021e0 - 0.003e0)))")


def between_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "-34e0 + c_nationkey * 0.017e0 + (c_custkey % 7) * 0.0001e0 as latitude",
        "150.5e0 + c_nationkey * 0.021e0 as longitude")


def many_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as idx", "concat('S', o_orderkey) as station", "-34e0 + (o_orderkey * 7919 % 9973) * 0.0001e0 as latitude",
        "150.5e0 + (o_orderkey * 3571 % 7907) * 0.0001e0 as longitude")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as many as customers; some lack a coordinate or have 0.0."""
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "case when c_custkey % 50 = 1 then null else -34e0 + (c_custkey * 2579 % 6899) * 0.00013e0 end as latitude",
        "case when c_custkey % 50 = 2 then 0e0 else 150.5e0 + (c_custkey * 1999 % 5003) * 0.00017e0 end as longitude")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of about three quarters of the streets, by street and suburb; keys repeat."""
    return _table(spark, sf_dir, "part").filter("length(p_name) % 5 <> 0").selectExpr(
        "lower(concat(p_name, ', ', p_brand)) as addr_key",
        "-34e0 + (p_partkey % 100) * 0.01e0 as latitude", "150.5e0 + (p_partkey % 70) * 0.01e0 as longitude")


def house_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of houses: one of seven numbers in each street."""
    return _table(spark, sf_dir, "part").selectExpr(
        "lower(concat(1 + p_partkey % 7, ' ', p_name, ', ', p_brand)) as addr_key",
        "-34e0 + (p_partkey % 100) * 0.01e0 as latitude", "150.5e0 + (p_partkey % 70) * 0.01e0 as longitude")


def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(
        "case when p_partkey % 2 = 0 then 'rea' else 'domain' end as portal",
        "replace(lower(concat(p_brand, ' park')), ' ', case when p_partkey % 2 = 0 then '+' else '-' end)"
        " as suburb_slug",
        "cast(2000 + p_partkey % 3 as int) as post_code",
        "cast(p_partkey as int) as position",
        "upper(concat(1 + p_partkey % 7, ' ', p_name, ', ', p_brand)) as card_address",
        "case when p_partkey % 5 = 0 then null"
        " when p_partkey % 3 = 0 then concat('https://x.example/', p_partkey) else concat('/', p_partkey) end as href")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search page per part: a card with a link, one without, and an element that is no card."""
    rea = """concat('<html><body><h1>', p_brand, '</h1><article class="residential-card wide"><div><span class="address">',
        p_partkey, ' <b>', upper(p_name), '</b> &amp; CO</span></div><img src="x"><a class="details-link" href="/p/',
        p_partkey, '">a</a><a class="details-link" href="/later">b</a></article><article class="advert">',
        '<span class="address">no</span></article><article class="residential-card"><span class="address">',
        p_type, '</span></article></body></html>')"""
    domain = """concat('<html><body><div data-testid="listing-card-wrapper"><div><h2 data-testid="address-line1">',
        p_partkey, ' <b>', upper(p_name), '</b> &amp; CO</h2></div><br><a data-testid="listing-card-image-wrapper" href="/p/',
        p_partkey, '">a</a></div><div data-testid="listing-card-wrapper"><h2 data-testid="address-line1">',
        p_type, '</h2><a href="/not-a-card-link">c</a></div></body></html>')"""
    return _table(spark, sf_dir, "part").selectExpr(
        "concat('page-', p_partkey) as page_url",
        "case when p_partkey % 2 = 0 then 'rea' else 'domain' end as portal",
        f"case when p_partkey % 2 = 0 then {rea} else {domain} end as html")


def dat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records: 25 fields as sold, and, per line number, some that must be dropped."""
    lines = _table(spark, sf_dir, "lineitem")
    part = _table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return lines.join(part, "l_partkey").selectExpr(
        """concat_ws(';', case when l_suppkey % 17 = 0 then 'A' else 'B' end, 'D1', cast(l_partkey as string),
        cast(l_linenumber as string), '20240101 00:00', '', '', ' 12 ', upper(p_name), upper(p_brand),
        concat('2,00', l_linenumber), cast(l_quantity as string), 'M',
        case when l_linenumber = 6 then 'bad' when l_linenumber = 5 then '29990101'
             else date_format(l_shipdate, 'yyyyMMdd') end,
        '', cast(l_extendedprice as string), 'R2', 'R', 'RESIDENCE', '', '', '', '', 'AB123',
        case when l_suppkey % 19 > 0 then '' end) as line""")


def _archived(spark: SparkSession, sf_dir: str, number: str = "") -> DataFrame:
    """Lines with the archive, the inner archive and the member that they go to."""
    return _table(spark, sf_dir, "lineitem").selectExpr(
        f"concat(year(l_shipdate), {number}'.zip') as path", "month(l_shipdate) as month", "l_linenumber as number",
        """concat_ws(';', 'B', 'D1', cast(l_partkey as string), cast(l_linenumber as string), '20240101 00:00', '', '', '1', 'KENT ST',
        'SYDNEY', '2000', cast(l_quantity as string), 'M', date_format(l_shipdate, 'yyyyMMdd'), '', cast(l_extendedprice as string),
        'R2', 'R', 'RESIDENCE', '', '', '', '', 'AB1', '') as line""")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of weekly archives, several with the same year, of monthly inner ones with a member per
    line number. Each holds an inner archive that is none, and those of 1995 are each followed by a damaged archive."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        path, outer = pdf["path"].iloc[0], {"broken.zip": b"none"}
        for month, part in pdf.groupby("month"):
            outer[f"{month}.zip"] = _zipped({f"{n}.DAT": "\r\n".join(sorted(some["line"])) for n, some in part.groupby("number")})
        found = [(path, _zipped(outer))]
        if path.startswith("1995"):
            found.append((f"damaged-{path}", b"PK"))
        return pd.DataFrame(found, columns=["path", "content"])

    return _archived(spark, sf_dir, "'-', floor(l_orderkey / 20000), ").groupBy("path").applyInPandas(pack, "path string, content binary")


def put_yearly_archives(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Archives like those of `archives`, but one per year, written into a folder. A year is no row and no group: lines come to a task
    in order and are packed as they come, and a year's archive is copied together from its inner ones, which lie in files."""
    store, place = store_of(folder)
    parts = f"{place}-parts"
    for made in (place, parts):
        store.create_dir(made, recursive=True)

    def inner(batches):
        store, _ = store_of(folder)
        with contextlib.ExitStack() as opened:
            at, archive, entries, member = None, None, contextlib.ExitStack(), None
            for batch in batches:
                for (path, month, number), lines in _runs(batch):
                    if (path, month) != at:
                        entries.close()
                        opened.close()
                        at, member = (path, month), None
                        year = path.removesuffix(".zip")
                        store.create_dir(f"{parts}/{year}", recursive=True)
                        file = opened.enter_context(store.open_output_stream(f"{parts}/{year}/{month}.zip"))
                        archive = opened.enter_context(zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED))
                        yield pd.DataFrame({"path": [path], "month": [month]})
                    if number is None:
                        continue
                    text = "\r\n".join(lines).encode()
                    if number == member:
                        body.write(b"\r\n" + text)
                    else:
                        entries.close()
                        body = entries.enter_context(archive.open(f"{number}.DAT", "w", force_zip64=True))
                        member = number
                        body.write(text)
            entries.close()

    def outer(batches):
        store, _ = store_of(folder)
        for batch in batches:
            for path, months in zip(batch["path"], batch["months"]):
                with store.open_output_stream(f"{place}/{path}") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("broken.zip", b"none")
                    for month in months:
                        with store.open_input_stream(f"{parts}/{path.removesuffix('.zip')}/{month}.zip") as body:
                            with archive.open(f"{month}.zip", "w", force_zip64=True) as entry:
                                shutil.copyfileobj(body, entry, 1 << 20)
                if path.startswith("1995"):
                    with store.open_output_stream(f"{place}/damaged-{path}") as file:
                        file.write(b"PK")
            yield pd.DataFrame({"n": [len(batch)]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = _archived(spark, sf_dir).repartition(tasks, "path", "month").sortWithinPartitions("path", "month", "number", "line")
    made = stored(lines.mapInArrow(_of_pandas(inner), "path string, month int"))
    years = made.groupBy("path").agg(F.sort_array(F.collect_list("month")).alias("months"))
    years.repartition(tasks, "path").mapInPandas(outer, "n long").agg({"n": "sum"}).first()
    return folder


def _of_pandas(frames):
    """Batches made of the data frames that a function of batches yields."""
    def made(batches):
        for frame in frames(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("path", pa.string()), ("month", pa.int32())]), preserve_index=False)

    return made


def _runs(batch: pa.RecordBatch):
    """((path, month, number), lines) of neighbouring rows of a batch that belong to one member."""
    rows = zip(*[batch.column(c).to_pylist() for c in ("path", "month", "number")], batch.column("line").to_pylist())
    for key, run in itertools.groupby(rows, key=lambda row: row[:3]):
        yield key, [row[3] for row in run]


def put_archives(files: DataFrame, folder: str) -> str:
    """Archives (path, content) written into a folder by the tasks that hold them."""
    store, place = store_of(folder)
    store.create_dir(place, recursive=True)

    def put(batches):
        store, place = store_of(folder)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with store.open_output_stream(f"{place}/{path}") as file:
                    file.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    files.mapInPandas(put, "n long").agg({"n": "sum"}).first()
    return folder


def station_file(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The stations as a file with a header and an index."""
    stations(spark, sf_dir).withColumnsRenamed({"station": "Station", "latitude": "Latitude", "longitude": "Longitude"}).coalesce(1).write.option(
        "header", True).csv(folder)
    return folder


def local_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards, on search pages of the localities as they are."""
    return listing_cards(spark, sf_dir).selectExpr("*", "regexp_replace(suburb_slug, '.park$', '') as slug").drop("suburb_slug").withColumnRenamed(
        "slug", "suburb_slug")


def _zipped(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in members.items():
            archive.writestr(name, body)
    return out.getvalue()


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with apostrophes, hyphens and digits, for title casing."""
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", "concat(upper(p_name), '-', p_type, ' o''', p_name, ' ', p_size, 'ST') as raw")
