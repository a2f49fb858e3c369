import pytest
from pyspark.sql import functions as F

from parcelwise.functions import display, geo, growth, text


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("first, last, years, cagr, total", [
    (100.0, 200.0, 1.0, 1.0, 1.0), (100.0, 200.0, 0.4, 0.0, 1.0), (100.0, 150.0, 5.0, 0.08447, 0.5),
    (100.0, 50.0, 1.0, -0.5, -0.5), (100.0, 200.0, 0.0, 0.0, 1.0), (1e6, 2e6, 10.0, 0.0717735, 1.0),
    (100.0, 0.0, 2.0, -1.0, -1.0), (0.0, 100.0, 2.0, None, None), (-5.0, 5.0, 2.0, None, -2.0),
])
def test_growth(spark, first, last, years, cagr, total):
    row = spark.range(1).select(growth.cagr(F.lit(first), F.lit(last), F.lit(years)),
                                growth.total_growth(F.lit(first), F.lit(last))).first()
    assert row[0] == (cagr if cagr is None else pytest.approx(cagr, rel=1e-4))
    assert row[1] == (total if total is None else pytest.approx(total))


def test_years_held(spark):
    assert value(spark, growth.years_held(F.lit("2001-01-01").cast("date"), F.lit("2002-01-01").cast("date"))) \
        == pytest.approx(365 / 365.25)


def test_haversine_between_landmarks(spark):
    km = value(spark, geo.haversine_km(F.lit(-33.8568), F.lit(151.2153), F.lit(-33.8523), F.lit(151.2108)))
    assert 0.6 <= km <= 0.7


@pytest.mark.parametrize("raw", ["MOUNT KURING-GAI", "O'CONNOR ST", "ST MARY'S", "1ST AVE", "école d'été", "a1b 2c",
                                 "", "x  y", "(abc) d"])
def test_title_case_is_that_of_python(spark, raw):
    assert value(spark, text.title_case(F.lit(raw))) == raw.title()


@pytest.mark.parametrize("raw", ["1.5", "1_000", "1__0", "_1", "1d", "1f", "", "abc", "-3", "+.5e3", "5.", ".", "1e5_0"])
def test_double_is_that_of_python(spark, raw):
    try:
        expected = float(raw)
    except ValueError:
        expected = None
    assert value(spark, text.parse_double(F.lit(raw))) == expected


@pytest.mark.parametrize("raw", ["nan", "inf", "-Infinity", "1e999"])
def test_double_keeps_only_finite_numbers(spark, raw):
    assert value(spark, text.parse_double(F.lit(raw))) is None


@pytest.mark.parametrize("raw, expected", [("2,000", 2000), ("2-00", None), ("12.5", 125), ("", None), ("-5", -5),
                                           ("99999999999", None)])
def test_int(spark, raw, expected):
    assert value(spark, text.parse_int(F.lit(raw))) == expected


@pytest.mark.parametrize("raw, expected", [("20240229", "2024-02-29"), ("20230229", None), ("2024115", None),
                                           ("bad", None), ("", None)])
def test_date(spark, raw, expected):
    got = value(spark, text.parse_date(F.lit(raw)))
    assert (got and str(got)) == expected


@pytest.mark.parametrize("line", [" a ;\tb ; c d\x1f; ;;", "a;b", "é ; f"])
def test_fields_are_stripped_like_python(spark, line):
    fields = F.transform(text.split_fields(F.lit(line + ";end")), text.strip)
    assert value(spark, fields)[:-1] == [p.strip() for p in line.split(";")]


def test_addresses(spark):
    house, street, place = F.lit("12"), F.lit("Kent St"), F.lit("Sydney")
    assert value(spark, text.local_address(house, street, place)) == "12 Kent St, Sydney"
    assert value(spark, text.postal_address(house, street, place, F.lit(2000))) == "12 Kent St, Sydney NSW 2000"
    assert value(spark, text.postal_address(F.lit(None), street, place, F.lit(None))) == "Kent St, Sydney NSW"
    assert value(spark, text.geocode_query(F.lit("x"))) == "x, NSW, Australia"


def test_links(spark):
    assert value(spark, text.absolute_link(F.lit("/a"), "https://p")) == "https://p/a"
    assert value(spark, text.absolute_link(F.lit("http://q/a"), "https://p")) == "http://q/a"
    assert value(spark, text.suburb_slug(F.lit("Potts Point"), "+")) == "potts+point"


@pytest.mark.parametrize("cagr, street, suburb, label", [
    (None, 0.1, 0.1, "N/A"), (0.0, 0.1, 0.1, "N/A"), (0.2, 0.1, 0.1, "Above Average"), (0.05, 0.1, 0.1, "Below Average"),
    (0.15, 0.1, 0.2, "Mixed Performance"), (0.05, None, 0.1, "Mixed Performance"), (0.05, None, None, "Above Average"),
    (-0.05, 0.0, 0.0, "Above Average"), (0.2, None, 0.1, "Above Average"),
])
def test_comparison_label(spark, cagr, street, suburb, label):
    args = [F.lit(v).cast("double") for v in (cagr, street, suburb)]
    assert value(spark, display.comparison_label(*args)) == label


@pytest.mark.parametrize("price, shown", [(1250000.0, "1.3M"), (1200000.0, "1.2M"), (350000.0, "350K"), (999.0, "999"),
                                          (12.5, "12.5")])
def test_short_price(spark, price, shown):
    assert value(spark, display.short_price(F.lit(price))) == shown


def test_growth_bar_and_counts(spark):
    assert [value(spark, display.growth_bar(F.lit(c).cast("double"))) for c in (None, 0.05, 1.0)] == [5.0, 40.0, 100.0]
    assert value(spark, display.first_count(F.lit(0), F.lit(7))) == 7
    assert value(spark, display.first_word(F.lit("Potts Point"))) == "Potts"
