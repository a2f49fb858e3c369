"""Batch jobs over table versions in a folder: ingest, growth build, enrichment."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import enrich, growth, spatial
from ..operators.numbering import latest_sales
from ..sources import archive
from ..sources.tables import add_part, current_version, has_folder, has_table, next_version, parts, read_table, write_table

#: Within files; suburb, date and growth filters then skip most of them.
SALES_ORDER = ["property_locality", "contract_date"]
ENRICHED = ["latitude", "longitude", "realestate_url", "domain_url", "listings_last_checked"]


def read_sales(spark: SparkSession, root: str, added: list[str] | None = None, base: bool = True) -> DataFrame:
    """Sales with what enrichment jobs have found since they were ingested; of some parts only, if told (see tables.read_table)."""
    sales, side = read_table(spark, root, "sales", None, added, base), _side(spark, root)
    if not has_folder(spark, side):
        return sales
    return enrich.with_enrichment(sales, spark.read.schema(enrich.SIDE_DDL).parquet(side))


def _side(spark: SparkSession, root: str) -> str:
    """The side table of the present version of sales: a new ingest starts an empty one."""
    return f"{root}/enrichment/{current_version(spark, root, 'sales')}"


def _listed(spark: SparkSession, root: str, version: str | None = None) -> str:
    """Where the archives whose sales a version of sales, the present one if not told, holds are listed, by the part that has them."""
    return f"{root}/sales_archives/{version or current_version(spark, root, 'sales')}"


def _list_archives(paths: DataFrame, root: str, part: str, version: str | None = None) -> None:
    paths.select("path").distinct().write.mode("overwrite").parquet(f"{_listed(paths.sparkSession, root, version)}/part={part}")


def archives_read(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, part) of the archives whose sales are in the present version of sales; None if that is not known."""
    if not has_table(spark, root, "sales") or not has_folder(spark, _listed(spark, root)):
        return None
    return spark.read.schema("path STRING, part STRING").parquet(_listed(spark, root))


def _numbered(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    known = read_table(spark, root, "archives") if has_table(spark, root, "archives") else None
    write_table(archive.numbered_archives(files, known), root, "archives")
    return read_table(spark, root, "archives")


def _sales_of(spark: SparkSession, root: str, files: DataFrame, as_of: date | None, enrichment: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Sales and bad files of archives that have numbers."""
    write_table(archive.archive_lines(files), root, "archive_lines")
    lines = read_table(spark, root, "archive_lines")
    sales = archive.sales_from_lines(lines, as_of, read_table(spark, root, "archives"))
    return sales if enrichment is None else enrich.apply_updates(sales, enrichment, ENRICHED), archive.bad_files(lines)


def add_archives(spark: SparkSession, root: str, files: DataFrame, part: str | None = None, as_of: date | None = None,
                 enrichment: DataFrame | None = None) -> None:
    """Add the sales of those of `files` (see archive.read_archives) that are not yet in the present version of sales, as a part of it;
    stored sales are not rewritten. Folder jobs and streams add to the same table, and so never read an archive twice. Work
    that is done again under one name of a part (a stream's batch) replaces what it wrote; without a name the part is
    called after the first new archive's number, so that a run after a failed one replaces its part, too."""
    done = archives_read(spark, root)
    if done is not None:
        files = files.join(done if part is None else done.filter(F.col("part") != part), "path", "left_anti").select(files.columns)
    numbers = _numbered(spark, root, files)
    if part is None:
        first = numbers.join(files.select("path").distinct(), "path").agg(F.min("archive_no")).first()[0]
        if first is None:
            return
        part = f"archives-{first}"
    sales, bad = _sales_of(spark, root, files, as_of, enrichment)
    for name, df in (("sales", sales), ("bad_files", bad)):
        if not has_table(spark, root, name):
            write_table(spark.createDataFrame([], df.schema), root, name)
    add_part(sales, root, "sales", part, SALES_ORDER)
    add_part(bad, root, "bad_files", part)
    _list_archives(files, root, part)


def ingest(spark: SparkSession, archives: str, root: str, start_year: int | None = None,
           end_year: int | None = None, as_of: date | None = None,
           enrichment: DataFrame | None = None, keep_existing: bool = False) -> DataFrame:
    """Replace `sales` by what the archives hold, all of them or those of a range of years; with `keep_existing` only archives
    whose sales are not there yet are read, and their sales are added. Returns the counts of archives, sales and bad files.

    Archives, inner archives and members that cannot be read are listed in the table `bad_files`; whoever needs the sales to be
    complete looks there. Repeated records stay repeated. Enrichment columns start empty unless `enrichment` (id and those
    columns) is given to carry them over. Archives keep their numbers, and so sales their ids, in the table `archives`."""
    files = archive.read_archives(spark, archives, start_year, end_year)
    if keep_existing and archives_read(spark, root) is not None:
        add_archives(spark, root, files, None, as_of, enrichment)
    else:
        _numbered(spark, root, files)
        sales, bad = _sales_of(spark, root, files, as_of, enrichment)
        write_table(sales, root, "sales", sort_by=SALES_ORDER)
        write_table(bad, root, "bad_files")
        _list_archives(files, root, "all")
    counts = {name: read_table(spark, root, name) for name in ("archives", "sales", "bad_files")}
    return spark.range(1).select(*[df.agg(F.count("*")).scalar().alias(name) for name, df in counts.items()])


def compact_sales(spark: SparkSession, root: str) -> None:
    """Write the sales with their parts and with all that enrichment has found as a new version, in order within its files. What is
    read stays the same; parts and side table, which reads have to merge, are empty again, and growth that was up to date
    stays so. `tables.vacuum` then removes the old files."""
    version, added, archives = current_version(spark, root, "sales"), parts(spark, root, "sales"), archives_read(spark, root)
    new = next_version(spark, root, "sales")
    if archives is not None:  # before the sales are there: without it they would count as incomplete
        _list_archives(archives, root, "all", new)
    write_table(read_sales(spark, root, added), root, "sales", sort_by=SALES_ORDER)
    if has_table(spark, root, "growth_state"):
        state = read_table(spark, root, "growth_state")
        sales = state.filter("name = 'sales'").first()
        if sales["version"] == version and sorted(sales["parts"]) == added:
            fresh = spark.createDataFrame([("sales", new, [])], state.schema)
            write_table(state.filter("name <> 'sales'").unionByName(fresh).coalesce(1), root, "growth_state")


def read_growth(spark: SparkSession, root: str) -> DataFrame:
    """Growth per property: as built, and for properties sold since then as last extended."""
    rows = read_table(spark, root, "property_growth")
    return growth.latest_growth(rows) if parts(spark, root, "property_growth") else rows.drop("sales")


def _stored(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """What several tables are read from is written once and read back, so it is neither computed twice nor lost with an executor."""
    write_table(df, root, name, partition_by)
    return read_table(df.sparkSession, root, name)


def _places(root: str, sums: DataFrame) -> None:
    places = _stored(sums, root, "place_sums")
    _stored(spatial.centroids_of(places, spatial.STREET), root, "street_centroids")
    _stored(spatial.centroids_of(places, spatial.SUBURB), root, "suburb_centroids")


LEVELS = {"street": growth.STREET, "suburb": growth.SUBURB}


def _summary(root: str, counts: DataFrame, cube: DataFrame, level: str) -> None:
    counts = _stored(counts, root, f"{level}_counts")
    rated = _stored(growth.rated(counts, cube, LEVELS[level]), root, f"rated_{level}s")
    _stored(growth.with_top_flag(rated), root, f"{level}_summary")


def _derived(pool: ThreadPoolExecutor, root: str, cube: DataFrame, counts: dict[str, DataFrame], start_year: int) -> list:
    """The yearly tables and the summaries, all from small tables."""
    years = {"street_growth": growth.street_growth(cube, start_year), "suburb_growth": growth.suburb_growth(cube, start_year)}
    return [*[pool.submit(_stored, df.hint("rebalance", "year"), root, name, ["year"]) for name, df in years.items()],
            *[pool.submit(_summary, root, df, cube, level) for level, df in counts.items()]]


#: What growth is extended from; the state names the versions that belong together.
STATE = ["property_spans", "growth_cube", "street_counts", "suburb_counts", "place_sums"]


def _note_state(spark: SparkSession, root: str, sales: str, read: list[str], spans: list[str]) -> None:
    rows = [("sales", sales, read), *[(n, current_version(spark, root, n), spans if n == "property_spans" else []) for n in STATE]]
    write_table(spark.createDataFrame(rows, "name STRING, version STRING, parts ARRAY<STRING>").coalesce(1), root, "growth_state")


def build_growth(spark: SparkSession, root: str, start_year: int = growth.START_YEAR, end_year: int | None = None) -> None:
    """Rebuild the derived tables from `sales`, which is left alone: growth per property, per street and suburb and year (up to the
    last year with a sale, or `end_year`), the summaries, and the centroids. Sales are gone through twice, once for prices and
    once for places."""
    version, read = current_version(spark, root, "sales"), parts(spark, root, "sales")
    sales = read_sales(spark, root, read)
    with ThreadPoolExecutor(4) as pool:  # small tables keep few executors busy; those that do not need each other go together
        steps = [pool.submit(_places, root, spatial.place_sums(sales))]
        spans = _stored(growth.property_spans(sales), root, "property_spans")
        repeats = _stored(growth.repeat_sales_of(spans), root, "repeat_sales")
        steps.append(pool.submit(_stored, repeats.select("property_id", *growth.FIGURES, "sales"), root, "property_growth"))
        cube = _stored(growth.growth_cube(repeats, end_year), root, "growth_cube")
        steps += _derived(pool, root, cube, {level: growth.place_counts(spans, keys) for level, keys in LEVELS.items()}, start_year)
        for step in steps:
            step.result()
    _note_state(spark, root, version, read, [])


def extend_growth(spark: SparkSession, root: str, start_year: int = growth.START_YEAR, end_year: int | None = None) -> None:
    """Bring the derived tables up to date with the parts added to `sales` since they were built; they hold what build_growth would
    make of all sales. Only the new parts are read. Of the properties sold in them the spans are merged and growth rows are
    added; what these properties had in the street totals is taken away and what they have now is added. Other properties
    are not written. A run that fails changes nothing that the next one starts from. Positions that enrichment
    found since the build count from the next build on."""
    state = {r["name"]: r for r in read_table(spark, root, "growth_state").collect()} if has_table(spark, root, "growth_state") else {}
    version = current_version(spark, root, "sales")
    if not state or state["sales"]["version"] != version:
        return build_growth(spark, root, start_year, end_year)
    read = list(state["sales"]["parts"])
    new = [part for part in parts(spark, root, "sales") if part not in read]
    if not new:
        return None
    held = {name: read_table(spark, root, name, state[name]["version"], list(state[name]["parts"])) for name in STATE}
    sales = read_sales(spark, root, new, base=False)
    part = f"{len(read):06d}"
    add_part(growth.property_spans(sales), root, "property_spans", part)  # nothing reads it before the state names it
    added = read_table(spark, root, "property_spans", state["property_spans"]["version"], [part], base=False)
    touched = added.select("property_id").distinct()
    old = _stored(growth.merged_spans(held["property_spans"].join(touched, "property_id", "left_semi")), root, "old_spans")
    before = growth.repeat_sales_of(old)
    # Dealt by property once, for the merge and for the figures; spans are few per property.
    spans = old.unionByName(added.filter("property_id IS NOT NULL")).repartition("property_id")
    after = _stored(growth.repeat_sales_of(growth.merged_spans(spans)), root, "repeat_sales_after")
    add_part(after.select("property_id", *growth.FIGURES, "sales"), root, "property_growth", part)
    cube = growth.summed(held["growth_cube"].unionByName(growth.growth_cube(after, end_year)), growth.growth_cube(before, end_year),
                         [*growth.STREET, "active_to"]).filter("properties > 0")
    cube = _stored(cube, root, "growth_cube")
    with ThreadPoolExecutor(4) as pool:
        counts = {level: growth.more_place_counts(held[f"{level}_counts"], old, added, keys) for level, keys in LEVELS.items()}
        steps = [pool.submit(_places, root, growth.summed(held["place_sums"].unionByName(spatial.place_sums(sales)), None, spatial.STREET)),
                 *_derived(pool, root, cube, counts, start_year)]
        for step in steps:
            step.result()
    _note_state(spark, root, version, [*read, *new], [*state["property_spans"]["parts"], part])
    return None


def geocode_sales(spark: SparkSession, root: str, gazetteer: DataFrame, ids: list[int] | DataFrame | None = None,
                  limit: int | None = None, offset: int = 0) -> DataFrame:
    """Find coordinates of all sales that lack them, of the requested ones, or of a slice; returns the counts."""
    sales = read_sales(spark, root)
    place = [F.col("property_house_number"), F.col("property_street_name"), F.col("property_locality")]
    if ids is None:
        pending, address = enrich.coordinates_pending(sales), text.postal_address(*place, F.col("property_post_code"))
    else:
        pending, address = enrich.by_ids(sales, ids), text.local_address(*place)
    if limit is not None:
        pending = enrich.pending_slice(pending, limit, offset)
    return _note(spark, root, enrich.geocoded(pending, gazetteer, address), "longitude")


def check_listings(spark: SparkSession, root: str, cards: DataFrame, checked_at: datetime,
                   limit: int | None = None, offset: int = 0) -> DataFrame:
    """Look up listings of all sales never checked, or of a slice of them; links not found stay as they are. Returns the counts."""
    pending = enrich.listings_unchecked(read_sales(spark, root))
    if limit is not None:
        pending = enrich.pending_slice(pending, limit, offset)
    links = ["realestate_url", "domain_url"]
    found = enrich.listing_updates(pending, cards, checked_at).withColumnsRenamed({c: f"_new_{c}" for c in links})
    updates = found.join(pending.select("id", *links), "id").select(
        "id", *[F.coalesce(f"_new_{c}", c).alias(c) for c in links], "listings_last_checked")
    return _note(spark, root, updates, "listings_last_checked")


def refresh_listings(spark: SparkSession, root: str, cards: DataFrame, checked_at: datetime,
                     property_id: str | None = None) -> DataFrame:
    """Look up listings again for the latest sale of a property (or of every property) where the last
    check is missing or older than a week; links no longer found are cleared."""
    sales = read_sales(spark, root)
    chosen = sales if property_id is None else sales.filter(F.col("property_id") == property_id)
    due = enrich.listings_due(latest_sales(chosen), checked_at)
    return _note(spark, root, enrich.listing_updates(due, cards, checked_at), "listings_last_checked")


def _note(spark: SparkSession, root: str, updates: DataFrame, found: str) -> DataFrame:
    """Append updates to the side table, and so write as many rows as were looked at; sales themselves stay. Returns the counts."""
    write_table(updates, root, "sales_updates")
    updates, side = read_table(spark, root, "sales_updates"), _side(spark, root)
    last = spark.read.schema(enrich.SIDE_DDL).parquet(side).agg(F.max("seq")).first()[0] if has_folder(spark, side) else None
    names = [c.split()[0] for c in enrich.SIDE_DDL.split(", ")]
    rows = updates.filter(F.col(found).isNotNull()).withColumn("seq", F.lit((last or 0) + 1).cast("bigint"))
    kinds = dict(zip(names, (c.split()[1] for c in enrich.SIDE_DDL.split(", "))))
    rows = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names])
    rows.write.mode("append").parquet(side)
    return enrich.enrichment_counts(updates, found)
