"""Nested sale archives: yearly ZIP, inner ZIPs, .dat members, text lines.

Archives are opened in two steps with a shuffle between them, so that the inner ZIPs of one large
yearly file are unpacked by many tasks. The first step reads only the directory at an archive's end, the second seeks
to the inner ZIPs that are its own, so that no task holds an outer archive, however large. Members are streamed. Their lines are
counted before they are passed on, so that every line comes with its place in the archive and no line has to be shuffled for it.
"""

from __future__ import annotations

import codecs
import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import records

CHUNK_BYTES = 1 << 20
BATCH_LINES = 20_000

#: A compressed inner ZIP up to this size is unpacked once and held; a larger one is read through again for each member.
HELD_BYTES = 256 << 20

DIRECTORY_SCHEMA = "path STRING, inner_no INT, inner STRING, error STRING"
COUNTED_SCHEMA = f"{DIRECTORY_SCHEMA}, counts ARRAY<BIGINT>"
INNER_SCHEMA = "path STRING, inner_no INT, inner STRING, body BINARY, error STRING, counts ARRAY<BIGINT>, before BIGINT"
LINE_SCHEMA = ("path STRING, inner_no INT, inner STRING, member_no INT, member STRING, line_no INT, line STRING, error STRING,"
               " before BIGINT")
LINE_FIELDS = pa.schema([
    ("path", pa.string()), ("inner_no", pa.int32()), ("inner", pa.string()), ("member_no", pa.int32()), ("member", pa.string()),
    ("line_no", pa.int32()), ("line", pa.string()), ("error", pa.string()), ("before", pa.int64())])

#: An id is an archive's number, from this bit up, and a line's number within the archive.
LINE_BITS = 40


def read_archives(spark: SparkSession, folder: str, start_year: int | None = None, end_year: int | None = None,
                  done: DataFrame | None = None, content: bool | None = None) -> DataFrame:
    """Archives of a folder, as (path) to be read by seeking: all `.zip` files, or with a bound those named `<year>.zip` within it.
    Paths already listed in `done` are skipped. With `content` (the choice where tasks cannot open the store by
    themselves) as (path, content), a row holding a whole file of at most 2 GiB."""
    columns = ["path", "content"] if (not seekable(folder) if content is None else content) else ["path"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(folder).select(*columns)
    return files_of_years(files, start_year, end_year) if done is None else (
        files_of_years(files, start_year, end_year).join(done.select("path").distinct(), "path", "left_anti"))


def files_of_years(files: DataFrame, start_year: int | None, end_year: int | None) -> DataFrame:
    if start_year is None and end_year is None:
        return files
    year = F.try_to_number(F.regexp_extract("path", r"(?:^|/)(\d{4})\.zip$", 1), F.lit("9999"))
    return files.filter(year.between(start_year or 0, end_year or 9999))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@%"))


def seekable(folder: str) -> bool:
    """Whether tasks can open files of this store by themselves."""
    try:
        store_of(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


@contextmanager
def _outer(path: str) -> Iterator[zipfile.ZipFile]:
    store, place = store_of(path)
    with store.open_input_file(place) as file:
        try:
            outer = zipfile.ZipFile(file)
        except pa.ArrowInvalid as error:  # sought before its begin
            raise zipfile.BadZipFile("File is not a zip file") from error
        with outer:
            yield outer


def numbered_archives(paths: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, archive_no) of all `paths` and `known` ones: these keep their numbers, new ones follow in order of path. An
    archive's number makes its sales' ids, so it must be kept for as long as they are."""
    paths = paths.select("path").distinct()
    if known is None:
        return paths.select("path", F.row_number().over(Window.orderBy("path")).cast("bigint").alias("archive_no"))
    last = known.agg(F.coalesce(F.max("archive_no"), F.lit(0))).scalar()
    new = paths.join(known, "path", "left_anti").select(
        "path", (F.row_number().over(Window.orderBy("path")) + last).cast("bigint").alias("archive_no"))
    return known.select("path", "archive_no").unionByName(new)


def archive_lines(files: DataFrame) -> DataFrame:
    """Every text line with its place in the archives and the number of lines `before` its member in the archive; what could not be
    read has an error and no line. Only .dat members of inner ZIPs count, names in any case. `files` are paths, or paths with
    their content."""
    # A given number of partitions is not merged again at run time: packed bytes are few, work is not.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "content" in files.columns:
        return files.mapInPandas(_inner_zips, INNER_SCHEMA).repartition(tasks, "path", "inner_no").mapInArrow(_member_lines, LINE_SCHEMA)
    inner = files.select("path").repartition(tasks, "path").mapInPandas(_directories, DIRECTORY_SCHEMA)
    counted = inner.repartition(tasks, "path", "inner_no").mapInPandas(_sought_counts, COUNTED_SCHEMA)
    earlier = Window.partitionBy("path").orderBy("inner_no").rowsBetween(Window.unboundedPreceding, -1)
    own = F.aggregate("counts", F.lit(0).cast("bigint"), lambda total, n: total + n)
    placed = counted.withColumn("before", F.coalesce(F.sum(own).over(earlier), F.lit(0)))
    return placed.repartition(tasks, "path", "inner_no").mapInArrow(_sought_lines, LINE_SCHEMA)


def bad_files(lines: DataFrame) -> DataFrame:
    return lines.filter("error IS NOT NULL").select("path", "inner", "member", "error")


def sales_from_lines(lines: DataFrame, as_of=None, numbers: DataFrame | None = None) -> DataFrame:
    """Sales parsed from archive lines, with an id that is unique and keeps the order of archives, members and lines.

    `numbers` (path, archive_no) are the archives' numbers; without them the archives at hand are numbered by path, for which
    `lines` are gone through once more."""
    lines = lines.filter("line IS NOT NULL")
    numbers = numbered_archives(lines) if numbers is None else numbers
    numbered = lines.join(numbers, "path").withColumn(
        "id", F.shiftleft("archive_no", LINE_BITS) + F.col("before") + F.col("line_no"))
    blank = {
        "property_legal_description": "string", "latitude": "double", "longitude": "double",
        "realestate_url": "string", "domain_url": "string", "listings_last_checked": "timestamp_ntz",
    }
    return records.parse_records(numbered, as_of, keep=["id"]).withColumns(
        {name: F.lit(None).cast(kind) for name, kind in blank.items()})


def _inner_names(outer: zipfile.ZipFile) -> list[str]:
    return [n for n in outer.namelist() if n.lower().endswith(".zip")]


def _inner_zips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "inner_no", "inner", "body", "error", "counts", "before"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            before = 0
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as outer:
                    for number, name in enumerate(_inner_names(outer)):
                        try:
                            body = outer.read(name)
                            counts = _counts_of(io.BytesIO(body))
                            row = (path, number, name, body, None, counts, before)
                            before += sum(counts)
                        except Exception as error:
                            row = (path, number, name, None, repr(error), [], before)
                        yield pd.DataFrame([row], columns=columns)
            except Exception as error:
                yield pd.DataFrame([(path, 0, None, None, repr(error), [], 0)], columns=columns)


def _directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The inner ZIPs that the directory of each archive lists; of the file nothing else is read."""
    for batch in batches:
        for path in batch["path"]:
            try:
                with _outer(path) as outer:
                    rows = [(path, number, name, None) for number, name in enumerate(_inner_names(outer))]
            except Exception as error:
                rows = [(path, 0, None, repr(error))]
            yield pd.DataFrame(rows, columns=["path", "inner_no", "inner", "error"])


def _sought_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The inner ZIPs with the lines of each of their members; what cannot be read has none."""
    for batch in batches:
        counts = [[] for _ in range(len(batch))]
        for path, entries in batch.reset_index(drop=True).groupby("path", sort=False):
            entries = entries[entries["inner"].notna()]
            if not len(entries):
                continue
            with _outer(path) as outer:
                listed = [info for info in outer.infolist() if info.filename.lower().endswith(".zip")]
                for at, number in entries["inner_no"].items():
                    try:
                        with _opened(outer, listed[number]) as body:
                            counts[at] = _counts_of(body)
                    except Exception:  # told when the lines are read
                        pass
        yield pd.DataFrame({**{c: batch[c].to_numpy() for c in ("path", "inner_no", "inner", "error")}, "counts": counts})


def _sought_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Lines()
    for batch in batches:
        rows = batch.to_pandas().sort_values(["path", "inner_no"])
        for path, entries in rows.groupby("path", sort=False):
            failed = entries[entries["inner"].isna()]
            if len(failed):
                yield from out.failed((path, 0, None, 0, None), failed["error"].iloc[0])
                continue
            with _outer(path) as outer:
                listed = [info for info in outer.infolist() if info.filename.lower().endswith(".zip")]
                for number, name, counts, before in zip(entries["inner_no"], entries["inner"], entries["counts"], entries["before"]):
                    place = (path, number, name)
                    try:
                        body = _opened(outer, listed[number])
                    except Exception as error:
                        yield from out.failed((*place, 0, None), repr(error))
                        continue
                    with body:
                        yield from _lines_of(out, body, place, counts, before)
    yield from out.rest()


def _opened(outer: zipfile.ZipFile, info: zipfile.ZipInfo):
    """An inner ZIP as a file that can be sought in: where it lies if it is stored as it is, else unpacked."""
    held = info.compress_type != zipfile.ZIP_STORED and info.file_size <= HELD_BYTES
    return io.BytesIO(outer.read(info)) if held else outer.open(info)


def _member_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Lines()
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            place = (row["path"], row["inner_no"], row["inner"])
            if row["body"] is None:
                yield from out.failed((*place, 0, None), row["error"])
            else:
                yield from _lines_of(out, io.BytesIO(row["body"]), place, row["counts"], row["before"])
    yield from out.rest()


def _members(archive: zipfile.ZipFile) -> list[str]:
    return [n for n in archive.namelist() if n.lower().endswith(".dat")]


def _counts_of(body) -> list[int]:
    """Lines of each member of an inner ZIP; none of members, or of an inner ZIP, that cannot be read."""
    counts: list[int] = []
    try:
        with zipfile.ZipFile(body) as archive:
            for member in _members(archive):
                try:
                    counts.append(sum(map(len, _chunks(archive, member))))
                except Exception:
                    counts.append(0)
    except Exception:
        pass
    return counts


def _lines_of(out: _Lines, body, place: tuple, counts, before: int) -> Iterator[pa.RecordBatch]:
    try:
        with zipfile.ZipFile(body) as archive:
            starts = before + np.cumsum([0, *counts])
            for member_no, member in enumerate(_members(archive)):
                at, first = (*place, member_no, member), 0
                try:
                    for lines in _chunks(archive, member):
                        yield from out.add(at, int(starts[member_no]), first, lines)
                        first += len(lines)
                except Exception as error:
                    yield from out.failed(at, repr(error))
    except Exception as error:
        yield from out.failed((*place, 0, None), repr(error))


class _Lines:
    """Lines of many members, small ones too, put together to batches."""

    def __init__(self):
        self.runs: list[tuple] = []  # place, lines before the member, number of the first line, how many, error
        self.lines: list[str | None] = []

    def add(self, place: tuple, before: int, first: int, lines: list[str]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(lines), BATCH_LINES):
            part = lines[at:at + BATCH_LINES]
            self.runs.append((*place, before, first + at, len(part), None))
            self.lines += part
            if len(self.lines) >= BATCH_LINES:
                yield from self.rest()

    def failed(self, place: tuple, error: str) -> Iterator[pa.RecordBatch]:
        self.runs.append((*place, 0, 0, 1, error))
        self.lines.append(None)
        if len(self.lines) >= BATCH_LINES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.lines:
            return
        path, inner_no, inner, member_no, member, before, first, many, error = zip(*self.runs)
        run = np.repeat(np.arange(len(many)), many)
        line_no = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + np.array(first)[run]
        columns = dict(path=path, inner_no=inner_no, inner=inner, member_no=member_no, member=member, error=error, before=before)
        arrays = {name: pa.array(list(map(_plain, values)), LINE_FIELDS.field(name).type).take(pa.array(run)) for name, values in columns.items()}
        arrays |= {"line_no": pa.array(line_no, pa.int32()), "line": pa.array(self.lines, pa.string())}
        self.runs, self.lines = [], []
        yield pa.RecordBatch.from_arrays([arrays[name] for name in LINE_FIELDS.names], schema=LINE_FIELDS)


def _plain(value):
    return value.item() if isinstance(value, np.generic) else value


def _encoding(archive: zipfile.ZipFile, member: str) -> str:
    """UTF-8 if the whole member is valid UTF-8, else Latin-1. Reading to the end also proves the
    member's checksum before any of its lines is passed on."""
    decoder, encoding = codecs.getincrementaldecoder("utf-8")(), "utf-8"
    with archive.open(member) as stream:
        while chunk := stream.read(CHUNK_BYTES):
            if encoding == "utf-8":
                try:
                    decoder.decode(chunk)
                except UnicodeDecodeError:
                    encoding = "latin-1"
    if encoding == "utf-8":
        try:
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            encoding = "latin-1"
    return encoding


def _chunks(archive: zipfile.ZipFile, member: str) -> Iterator[list[str]]:
    """A member's lines, of a chunk at a time. A small member is read once; its checksum is proven before any line is passed on,
    as it is for a large one, which is read through first."""
    if archive.getinfo(member).file_size > CHUNK_BYTES:
        yield from _cut(archive, member, _encoding(archive, member))
        return
    whole = archive.read(member)
    try:
        yield whole.decode("utf-8").splitlines()
    except UnicodeDecodeError:
        yield whole.decode("latin-1").splitlines()


def _cut(archive: zipfile.ZipFile, member: str, encoding: str) -> Iterator[list[str]]:
    """Lines as str.splitlines cuts them, which knows more line ends than \\n and \\r\\n."""
    decoder, rest = codecs.getincrementaldecoder(encoding)(), ""
    with archive.open(member) as stream:
        while chunk := stream.read(CHUNK_BYTES):
            text = rest + decoder.decode(chunk)
            pieces = text.splitlines(keepends=True)
            # The last piece may go on in the next chunk, and a final \r may be half of \r\n.
            rest = pieces[-1] if pieces else ""
            yield text[:len(text) - len(rest)].splitlines()
    yield (rest + decoder.decode(b"", final=True)).splitlines()


def _lines(archive: zipfile.ZipFile, member: str, encoding: str) -> Iterator[str]:
    for lines in _cut(archive, member, encoding):
        yield from lines
