"""Work that must not gather in one task, one group or one row as the input grows."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from parcelwise import fixtures
from parcelwise.operators import growth
from parcelwise.sources import archive


def _lines(spark, folder):
    rows = [(o, p, 1, n, 3.0, 10.0 * o, f"199{o % 2 + 4}-0{1 + o % 3}-11") for o in range(40) for p, n in ((7, 1), (8, 2), (9, None))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                          " l_extendedprice double, day string").withColumn("l_shipdate", F.to_timestamp("day")).drop("day").write.parquet(
        f"{folder}/lineitem.parquet")


def test_yearly_archives_are_packed_as_lines_come(spark, tmp_path):
    """Members of a year's archive hold their lines in order, although no task is given a year, and lines without number go to none."""
    _lines(spark, tmp_path)
    folder = fixtures.put_yearly_archives(spark, str(tmp_path), f"{tmp_path}/in")
    lines = {(r.path, r.month, r.number): r.lines for r in fixtures._archived(spark, str(tmp_path)).filter("number IS NOT NULL").groupBy(
        "path", "month", "number").agg(F.sort_array(F.collect_list("line")).alias("lines")).collect()}
    found = {}
    for path in ("1994.zip", "1995.zip"):
        with zipfile.ZipFile(f"{folder}/{path}") as outer:
            assert outer.namelist() == ["broken.zip", *[f"{m}.zip" for m in sorted({m for p, m, _ in lines if p == path})]]
            assert outer.read("broken.zip") == b"none"
            for month in outer.namelist()[1:]:
                with zipfile.ZipFile(io.BytesIO(outer.read(month))) as inner:
                    found |= {(path, int(month[:-4]), int(n[:-4])): inner.read(n).decode().split("\r\n") for n in inner.namelist()}
    assert found == lines
    assert open(f"{folder}/damaged-1995.zip", "rb").read() == b"PK"


def test_lines_know_how_many_are_before_their_member(spark, tmp_path, monkeypatch):
    """So that neither numbering nor ids need a second pass over the lines or a shuffle of them; the same in both ways of reading,
    and for members in one or several chunks."""
    monkeypatch.setattr(archive, "CHUNK_BYTES", 64)
    inner = [fixtures._zipped({f"{m}.dat": "\n".join(f"B;{i}-{m}-{n}" for n in range(m * 9)) for m in range(3)}) for i in range(3)]
    (tmp_path / "2001.zip").write_bytes(fixtures._zipped({"0.zip": inner[0], "1.zip": b"no", "2.zip": inner[1], "3.zip": inner[2]}))
    for content in (False, True):
        lines = archive.archive_lines(archive.read_archives(spark, str(tmp_path), content=content))
        rows = lines.filter("line IS NOT NULL").orderBy("inner_no", "member_no", "line_no").collect()
        assert [r.before + r.line_no for r in rows] == list(range(81))
        assert [r.line for r in rows] == [f"B;{i}-{m}-{n}" for i in range(3) for m in range(3) for n in range(m * 9)]
        assert [r.inner for r in archive.bad_files(lines).collect()] == ["1.zip"]
        ids = archive.sales_from_lines(lines, numbers=archive.numbered_archives(lines))
        assert "Join" in ids._jdf.queryExecution().optimizedPlan().toString() and "Aggregate [path, inner_no" not in ids._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_small_members_share_batches():
    out = archive._Lines()
    batches = [b for n in range(50) for b in out.add(("a", 0, "i", n, f"{n}.dat"), n, 0, [f"{n}"] * 3)] + list(out.rest())
    assert [b.num_rows for b in batches] == [150]
    rows = pd.DataFrame(batches[0].to_pylist())
    assert (rows["line_no"] == [0, 1, 2] * 50).all() and (rows["before"] == rows["member_no"]).all()


def test_spans_are_dealt_by_property_once(spark):
    """Merging spans and reading figures from them is one shuffle, and counting a street's properties another one only."""
    row = "1L as property_id_no, 'p' as property_id, 's' as property_street_name, 'l' as property_locality, 2000 as property_post_code, date'2001-01-01' as contract_date, 1d as purchase_price, id"
    spans = growth.property_spans(spark.range(9).selectExpr(*row.split(", ")))
    given = spark.createDataFrame(spans.collect(), spans.schema)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    merged = growth.repeat_sales_of(growth.merged_spans(given.repartition("property_id")))
    assert shuffles(merged) == 1 and merged.select("sales").collect() == [(9,)]
    counts = growth.place_counts(given, growth.STREET)
    assert shuffles(counts) == 1 and counts.collect() == [("s", "l", 2000, 1, 9)]
