import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import spatial, station_tree


def brute(lat, lon, lats, lons):
    h = (np.sin(np.radians(lats - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(np.radians(lons - lon) / 2) ** 2)
    km = 2 * 6371 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    return int(np.flatnonzero(km <= km.min() + 1e-9)[0]), km.min()


def places(kind, n, rng):
    if kind == "globe":  # poles and the date line included
        lat = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
        lat[:3] = 90, -90, 89.9
        return lat, np.r_[180.0, -180.0, rng.uniform(-180, 180, n - 2)]
    if kind == "city":  # nearly all in one place, few in thin country
        far = rng.random(n) < 0.02
        return np.where(far, rng.uniform(-40, -10, n), -33.87 + rng.normal(0, 0.01, n)), np.where(far, rng.uniform(115, 150, n), 151.2 + rng.normal(0, 0.01, n))
    return -34 + rng.integers(0, 12, n) * 0.01, 151 + rng.integers(0, 12, n) * 0.01  # a grid: many at one place, many ties


@pytest.mark.parametrize("kind", ["globe", "city", "grid"])
@pytest.mark.parametrize("bits", [(6, 8), (2, 3)])
def test_equal_to_brute_force(spark, monkeypatch, kind, bits):
    monkeypatch.setattr(station_tree, "NODE_BITS", bits[0])
    monkeypatch.setattr(station_tree, "GROUP_BITS", bits[1])
    rng = np.random.default_rng(3)
    lats, lons = places(kind, 1_500, rng)
    lat, lon = (np.r_[a, b] for a, b in zip(places(kind, 400, rng), places("globe", 100, rng)))
    stations = spark.createDataFrame([(i, f"s{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lats, lons))],
                                     "idx long, station string, latitude double, longitude double")
    spots = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
                                  + [(10_000, None, 151.0), (10_001, 0.0, 151.0), (10_002, float("nan"), 151.0)], "id long, latitude double, longitude double")
    found = {r["id"]: r for r in spatial.with_nearest_station(spots, stations, max_inline=10).collect()}
    same = {r["id"]: r["nearest_station"] for r in spatial.with_nearest_station(spots, stations).collect()}
    assert len(found) == 503 and all(found[i]["nearest_station"] is None for i in (10_000, 10_001, 10_002))
    assert same == {i: r["nearest_station"] for i, r in found.items()}
    for i, (a, b) in enumerate(zip(lat, lon)):
        station, km = brute(a, b, lats, lons)
        assert found[i]["nearest_station"] == f"s{station}" and found[i]["distance_to_station"] == pytest.approx(km, abs=1e-6)


def test_groups_meet_few_leaves(spark, monkeypatch):
    """Pairs of positions and leaves grow with the positions, not with the stations."""
    met = []
    whole = station_tree._opened

    def counted(rows):
        met.append(station_tree.stored(whole(rows)))
        return met[-1]

    monkeypatch.setattr(station_tree, "_opened", counted)
    rng, shares = np.random.default_rng(1), []
    for kind, n in (("globe", 20_000), ("globe", 80_000), ("city", 20_000)):
        lats, lons = places(kind, n, rng)
        stations = spark.createDataFrame([(i, "s", float(a), float(b)) for i, (a, b) in enumerate(zip(lats, lons))], "idx long, station string, lat double, lon double")
        spots = stations.filter("idx % 2 = 0").select(F.col("lat").alias("latitude"), (F.col("lon") * 0.999).alias("longitude"))
        assert station_tree.nearest_of_many(spots, stations).count() == spots.distinct().count()
        groups = met[-1].select("group").distinct().count()
        shares.append(met[-1].count() / groups)
    print(shares)
    assert max(shares) < 150 and shares[1] < 1.3 * shares[0]
