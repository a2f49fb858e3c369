"""The nearest of many stations for many positions: a packed tree of stations, walked by groups of positions.

Stations are put in order of their Morton number on the unit sphere and packed, 64 to a leaf, 64 leaves to a node and so on. Positions
are put in the same order in groups of 256. Leaves and groups are parted where the order jumps, which keeps their boxes small. A group
walks down the tree with a short list of nodes: from the boxes follows a distance within which each of its positions has a
station, and nodes beyond it are dropped. So a group meets the few leaves that can hold its nearest stations, wherever it lies; it
takes them nearest first, and of a leaf only the positions that it may still serve. The work grows with the positions, times the
depth of the tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import stored

#: Stations of a leaf, and nodes of a node, are 2**NODE_BITS; positions of a group 2**GROUP_BITS.
NODE_BITS, GROUP_BITS = 6, 8
#: Distances (km) closer than this are equal: a micrometre, far above rounding.
SAME_KM = 1e-9
#: Chords of the unit sphere may be off by this much, which is also more than SAME_KM.
MARGIN = 1e-12
#: Squared chords of two positions may be off by this much; and so much do those of equal distances differ at most.
CHORD_MARGIN, SAME_CHORD = 1e-14, 1e-12
#: Above any chord.
FARTHEST = 3.0
#: Pairs of positions and stations that are compared at once.
CELLS_AT_ONCE = 2_000_000

AXES = ("x", "y", "z")
FOUND = "latitude double, longitude double, km double, idx bigint, station string, lat double, lon double"


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> list[np.ndarray]:
    lat, lon = np.radians(lat), np.radians(lon)
    return [np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]


def near_pairs(lat: np.ndarray, lon: np.ndarray, lats: np.ndarray, lons: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, station, km) of the nearest station of every position, and of all others that are as near.

    Squared chords narrow the stations down to those that may be nearest, at the cost of a few multiplications; among these
    the distance decides. Pairs are in order of position and station."""
    here, points = on_sphere(lat, lon), on_sphere(lats, lons)
    step, parts = max(1, CELLS_AT_ONCE // max(len(lats), 1)), []
    for start in range(0, len(lat), step):
        rows = slice(start, start + step)
        chords = sum((p[rows, None] - q) ** 2 for p, q in zip(here, points))
        row, station = np.nonzero(chords <= chords.min(axis=1, keepdims=True) + CHORD_MARGIN)
        km = geo.haversine_km_numpy(lat[rows][row], lon[rows][row], lats[station], lons[station])
        least = np.full(len(chords), np.inf)
        np.minimum.at(least, row, km)
        near = km <= least[row] + SAME_KM
        parts.append((row[near] + start, station[near], km[near]))
    if not parts:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _spread(number: Column) -> Column:
    """A number of 20 bits with two zeros between them."""
    out = number
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def _placed(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """`df` with its place on the unit sphere and `pos`, numbers without gaps in order of the Morton number of that place."""
    a, b = F.radians(lat), F.radians(lon)
    df = df.withColumns({"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)})
    step = lambda axis: F.floor((F.col(axis) + 1.0) * float((1 << 19) - 1)).cast("bigint")
    morton = _spread(step("x")) + F.shiftleft(_spread(step("y")), 1) + F.shiftleft(_spread(step("z")), 2)
    order = ["morton", lat, lon]
    own = stored(df.withColumn("morton", morton).repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("n", F.monotonically_increasing_id()))
    own = own.withColumn("part", F.shiftright("n", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("part").agg(F.count("*").alias("rows")).select(  # a row per task
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return own.join(starts, "part").withColumn("pos", F.col("start") + F.col("n") - F.shiftleft("part", 33)).drop("part", "start", "n")


def _box(of_boxes: bool = False) -> list[Column]:
    return [f(f"{edge if of_boxes else ''}{axis}").alias(f"{edge}{axis}") for axis in AXES for edge, f in (("min_", F.min), ("max_", F.max))]


EDGES = [f"{edge}{axis}" for axis in AXES for edge in ("min_", "max_")]


def _bounds(node: Column) -> tuple[Column, Column]:
    """Least and greatest chord between a point in the row's box and one in the node's."""
    least, most = F.lit(0.0), F.lit(0.0)
    for axis in AXES:
        low, high = node[f"min_{axis}"], node[f"max_{axis}"]
        apart = F.greatest(F.lit(0.0), low - F.col(f"max_{axis}"), F.col(f"min_{axis}") - high)
        across = F.greatest(high - F.col(f"min_{axis}"), F.col(f"max_{axis}") - low)
        least, most = least + apart * apart, most + across * across
    return F.sqrt(least), F.sqrt(most)


def _opened(rows: DataFrame) -> DataFrame:
    """(group, box, bound, node): of the nodes in `nodes`, those that may hold the nearest station of a position in the group."""
    told = F.transform("nodes", lambda n: F.struct(n["node"].alias("node"), _bounds(n)[0].alias("least"), _bounds(n)[1].alias("most")))
    rows = rows.select("group", *EDGES, "bound", told.alias("nodes"))
    rows = rows.withColumn("bound", F.least("bound", F.array_min(F.transform("nodes", lambda n: n["most"]))))
    rows = rows.select("group", *EDGES, "bound", F.inline(F.filter("nodes", lambda n: n["least"] <= F.col("bound") + MARGIN)))
    rows = rows.withColumn("bound", F.min("bound").over(Window.partitionBy("group")))
    return rows.filter(F.col("least") <= F.col("bound") + MARGIN).select("group", *EDGES, "bound", "node", "least")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's rows come one after the other, nearest leaf first; its positions keep the least squared chord so far."""
    lat = lon = here = best = None
    for batch in batches:
        listed, stations = _rows_of(batch.column("stations"))
        told, positions = _rows_of(batch.column("positions"))
        lats, lons = (stations.field(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
        lat_all, lon_all = (positions.field(c).to_numpy(zero_copy_only=False) for c in ("latitude", "longitude"))
        all_points, all_here, given = on_sphere(lats, lons), on_sphere(lat_all, lon_all), batch.column("positions").is_valid().to_numpy(zero_copy_only=False)
        parts = []
        for row in range(batch.num_rows):
            if given[row]:
                own = slice(told[row], told[row + 1])
                lat, lon, here = lat_all[own], lon_all[own], [p[own] for p in all_here]
                best = np.full(len(lat), np.inf)
            leaf = slice(listed[row], listed[row + 1])
            points = [q[leaf] for q in all_points]
            apart = sum(np.maximum(np.maximum(q.min() - p, p - q.max()), 0) ** 2 for p, q in zip(here, points))
            open_ = np.flatnonzero(apart <= best + SAME_CHORD)
            if not len(open_):
                continue
            position, station, km = near_pairs(lat[open_], lon[open_], lats[leaf], lons[leaf])
            position = open_[position]
            chord = sum((p[position] - q[station]) ** 2 for p, q in zip(here, points))
            near = chord <= best[position] + SAME_CHORD
            np.minimum.at(best, position, chord)
            position, station, km = position[near], station[near], km[near]
            parts.append((lat[position], lon[position], km, leaf.start + station))
        if parts:
            *columns, station = (np.concatenate([part[i] for part in parts]) for i in range(4))
            found = [stations.field(name).take(pa.array(station)) for name in ("idx", "station", "lat", "lon")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *found], [c.split()[0] for c in FOUND.split(", ")])


def _rows_of(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """Where each row's members begin, and where the last ends, in the members of all rows."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int), lists.flatten()


def _parted(placed: DataFrame, bits: int, columns: list[str], name: str) -> DataFrame:
    """Runs of 2**bits points, parted at the highest place where the Morton numbers of a run differ: box, first point, and points."""
    run = Window.partitionBy("run")
    spread = F.min("morton").over(run).bitwiseXOR(F.max("morton").over(run))
    shift = (F.floor((F.length(F.bin(spread)) - 1) / 3) * 3).cast("int")
    rows = placed.withColumn("run", F.shiftright("pos", bits)).withColumn("shift", shift)
    return rows.groupBy("run", F.expr("shiftright(morton, shift)").alias("cell")).agg(
        *_box(), F.min("pos").alias("node"), F.collect_list(F.struct(*columns)).alias(name))


def nearest_of_many(positions: DataFrame, stations: DataFrame) -> DataFrame:
    """For each of the different `positions` (latitude, longitude: numbers) the nearest of `stations` (idx, station, lat, lon) as
    `found`: the first by idx, then name, of those whose distance is the least, to SAME_KM. No rows without stations."""
    first = F.min(F.struct("idx", "station")).alias("s")
    points = _placed(stations.groupBy("lat", "lon").agg(first).select("lat", "lon", "s.*"), "lat", "lon")
    leaves = stored(_parted(points, NODE_BITS, ["idx", "station", "lat", "lon"], "stations"))
    levels, size, nodes = [leaves.select("node", *EDGES)], points.count(), leaves.count()
    bits = 2 * NODE_BITS  # a leaf goes by its first point, the node above by the range of points that this is in
    while nodes > 1 << NODE_BITS:
        below = levels[-1].withColumn("node", F.shiftright("node", bits if len(levels) == 1 else NODE_BITS))
        levels.append(below.groupBy("node").agg(*_box(of_boxes=True)))
        nodes = -(-size // (1 << NODE_BITS * len(levels)))

    groups = stored(_parted(_placed(positions, "latitude", "longitude"), GROUP_BITS, ["latitude", "longitude"], "positions")
                    .withColumnRenamed("node", "group"))
    node = F.collect_list(F.struct("node", *EDGES)).alias("nodes")
    walk = _opened(groups.select("group", *EDGES, F.lit(FARTHEST).alias("bound"), levels[-1].agg(node).scalar().alias("nodes")))
    for number in range(len(levels) - 2, -1, -1):
        below = levels[number].groupBy(F.shiftright("node", NODE_BITS if number else bits).alias("node")).agg(node)
        walk = _opened(walk.drop("least").join(below, "node"))
    pairs = walk.select("group", "node", "least").join(leaves.select("node", "stations"), "node").join(groups.select("group", "positions"), "group")
    # A group's leaves in order, nearest first; its positions come with the first of them.
    turn = F.row_number().over(Window.partitionBy("group").orderBy("least", "node"))
    near = pairs.select("group", F.when(turn == 1, F.col("positions")).alias("positions"), "stations").mapInArrow(_compared, FOUND)
    here = Window.partitionBy("latitude", "longitude")
    near = near.withColumn("least", F.min("km").over(here)).filter(F.col("km") <= F.col("least") + SAME_KM)
    return near.groupBy("latitude", "longitude").agg(F.min(F.struct("idx", "station", "lat", "lon")).alias("found"))
