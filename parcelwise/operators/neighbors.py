"""The nearest sales for every property at once, exactly.

Sales lie in a tree of cells, each a sixteenth as wide as the one above; a cell with few sales is a leaf.
Every position walks down the tree, level by level, with a short list of cells: from the cells' counts
and corners follows a distance within which there are enough sales, and cells beyond it are dropped.
What is left are the few leaves in which a position's neighbours can be, wherever the position lies:
one in thin country meets the near leaves of a city, never the city. Three more bounds keep dense
places cheap:

* sales at one position are reduced to the few that any property there or elsewhere can need;
* neighbours are found once per position and shared by all properties at it;
* a leaf holds a bounded number of sales, but for a single position's.

A position whose list was cut too short, because one property owns too many of the sales around it,
walks again with four times as many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import stored

FINEST_LEVEL = 28
LEVEL_STEP = 4
#: A cell with more sales than this has cells below it.
LEAF_SALES = 64
CELL = ["level", "x", "y"]


def nearest_sales_of_all(sales: DataFrame, growth: DataFrame, k: int = 20) -> DataFrame:
    """For every property with a located sale (its first one): the k nearest sales of other
    repeat-sale properties as (property_id, neighbor_rank, id, neighbor_property_id, dist)."""
    located = sales.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select(
        "id", "property_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    extent = located.agg(F.struct(
        F.min("lat").alias("lat"), F.min("lon").alias("lon"),
        (F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")) * 1.000001 + 1e-9).alias("size"))).scalar()

    targets = stored(located.filter("property_id IS NOT NULL").groupBy("property_id")
                      .agg(F.min_by(F.struct("lat", "lon"), "id").alias("at")).select("property_id", "at.*"))
    spots = stored(_spots(located.join(growth.select("property_id"), "property_id"), k)
                    .withColumn("e", extent).select("*", *_unit()).drop("e"))
    positions = stored(targets.select("lat", "lon").distinct().withColumn("e", extent).select("*", *_unit()).drop("e"))

    levels = F.explode(F.sequence(F.lit(0), F.lit(FINEST_LEVEL), F.lit(LEVEL_STEP))).alias("level")
    cells = stored(_at_level(spots.select("u", "v", "n", levels)).groupBy(*CELL).agg(F.sum("n").alias("n"))
                    .withColumn("inner", (F.col("n") > LEAF_SALES) & (F.col("level") < FINEST_LEVEL)))
    placed = stored(_in_leaves(spots, cells))
    total = cells.filter("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    found, pending, wanted = None, positions, 2 * k
    while total:
        looked_up = stored(_look_up(_walk(pending, cells, wanted), placed, k, wanted >= total))
        done = looked_up.filter("complete").select("lat", "lon", "id", "neighbor_property_id", "dist")
        found = done if found is None else found.unionByName(done)
        if wanted >= total:
            break
        settled = looked_up.filter("complete").select("lat", "lon").distinct()
        pending, wanted = stored(pending.join(settled, ["lat", "lon"], "left_anti")), 4 * wanted
        if pending.isEmpty():
            break
    if found is None:
        return targets.limit(0).select("property_id", F.lit(0).alias("neighbor_rank"), F.lit(0).cast("long").alias("id"),
                                       F.lit("").alias("neighbor_property_id"), F.lit(0.0).alias("dist"))
    # A position's neighbours are one row for all properties at it: pairs are made last, and never shuffled.
    near = found.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("dist", "id", "neighbor_property_id"))).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["neighbor_property_id"] != F.col("property_id")), 1, k)
    return (targets.join(near, ["lat", "lon"]).select("property_id", F.posexplode(others).alias("place", "n"))
            .select("property_id", (F.col("place") + 1).alias("neighbor_rank"), "n.id", "n.neighbor_property_id", "n.dist"))


def _first_rows(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first rows of each group; Spark cuts groups down in every task before it shuffles them."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= limit).drop("_n")


def _spots(candidates: DataFrame, k: int) -> DataFrame:
    """Distinct positions with the sales that can matter there.

    Of one property no more than its first k can, and of all sales no more than 2 k: taking out the
    at most k of the asking property leaves k.
    """
    per_property = _first_rows(candidates, ["lat", "lon", "property_id"], ["id"], k)
    kept = _first_rows(per_property, ["lat", "lon"], ["id"], 2 * k)
    return kept.groupBy("lat", "lon").agg(
        F.count("*").alias("n"), F.collect_list(F.struct("id", F.col("property_id").alias("neighbor_property_id"))).alias("rows"))


def _unit() -> list[Column]:
    """Position within the extent, from 0 to under 1."""
    return [((F.col(c) - F.col(f"e.{c}")) / F.col("e.size")).alias(a) for c, a in (("lat", "u"), ("lon", "v"))] + [
        F.col("e.size").alias("size")]


def _cells_across(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _at_level(df: DataFrame) -> DataFrame:
    across = _cells_across(F.col("level"))
    return df.withColumns({"x": F.floor(F.col("u") * across), "y": F.floor(F.col("v") * across)})


def _in_leaves(spots: DataFrame, cells: DataFrame) -> DataFrame:
    """Every spot with the leaf it is in: the first cell on its way down that has none below."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(FINEST_LEVEL), F.lit(LEVEL_STEP))).alias("level")
    above = cells.filter("inner").select(
        (F.col("level") + LEVEL_STEP).alias("level"), *[F.col(c).alias(f"_{c}") for c in ("x", "y")])
    wide = 1 << LEVEL_STEP
    below = cells.filter("NOT inner").withColumns({f"_{c}": F.floor(F.col(c) / wide) for c in ("x", "y")})
    leaves = below.filter("level = 0").unionByName(below.join(above, ["level", "_x", "_y"], "left_semi"), allowMissingColumns=True)
    at = _at_level(spots.select(F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), "u", "v", "rows", levels))
    return at.join(leaves.select(*CELL), CELL).select(*CELL, "c_lat", "c_lon", "rows")


def _reach(df: DataFrame) -> DataFrame:
    """Squared distances from a position to the nearest and farthest point of a cell, with a margin for rounding."""
    side = 1.0 / _cells_across(F.col("level"))
    near, far = [], []
    for p, c in (("u", "x"), ("v", "y")):
        low, high = F.col(c) * side - F.col(p), F.col(p) - (F.col(c) + 1) * side
        near.append(F.greatest(low, high, F.lit(0.0)))
        far.append(F.greatest(F.abs(low), F.abs(high)))
    squared = lambda parts: (parts[0] * parts[0] + parts[1] * parts[1]) * F.col("size") * F.col("size")
    return df.withColumns({"near": squared(near) * (1.0 - 1e-6) - 1e-18, "far": squared(far) * (1.0 + 1e-6) + 1e-18})


def _walk(positions: DataFrame, cells: DataFrame, wanted: int) -> DataFrame:
    """The leaves that can hold one of the `wanted` sales nearest to each position, and `bound`, the squared distance within which
    there are so many. All leaves nearer than that are in the list."""
    here = Window.partitionBy("lat", "lon")
    upto = F.sum("n").over(here.orderBy("far").rowsBetween(Window.unboundedPreceding, 0))

    def cut(df: DataFrame) -> DataFrame:
        held = F.coalesce(F.min(F.when(F.col("upto") >= wanted, F.col("far"))).over(here), F.lit(1e300))
        return (_reach(df).withColumn("upto", upto).withColumn("bound", held)
                .filter(F.col("near") <= F.col("bound")).drop("upto"))

    top = {c: F.lit(0).cast(kind) for c, kind in cells.select(*CELL).dtypes}
    listed = cut(positions.withColumns(top).join(cells.filter("level = 0"), CELL))
    for _ in range(0, FINEST_LEVEL, LEVEL_STEP):
        listed = stored(listed.drop("near", "far", "bound"))
        if listed.filter("inner").isEmpty():
            break
        wide = 1 << LEVEL_STEP
        below = cells.select("*", (F.col("level") - LEVEL_STEP).alias("p_level"),
                             *[F.floor(F.col(c) / wide).alias(f"p_{c}") for c in ("x", "y")])
        down = listed.filter("inner").select("lat", "lon", "u", "v", "size", *[F.col(c).alias(f"p_{c}") for c in CELL])
        down = down.join(below, [f"p_{c}" for c in CELL]).drop(*[f"p_{c}" for c in CELL])
        listed = cut(listed.filter("NOT inner").unionByName(down))
    return cut(listed.drop("near", "far", "bound"))


def _look_up(listed: DataFrame, placed: DataFrame, k: int, everything: bool) -> DataFrame:
    """The first 2 k sales around each position, at most k of one property, and whether no sale outside its leaves can be
    nearer."""
    pairs = (listed.select("lat", "lon", "bound", *CELL).join(placed, CELL)
             .select("lat", "lon", "bound", F.inline("rows"),
                     geo.planar_sq(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon")).alias("dist")))
    at = ["lat", "lon"]
    first = _first_rows(_first_rows(pairs, [*at, "neighbor_property_id"], ["dist", "id"], k), at, ["dist", "id"], 2 * k)
    whole = Window.partitionBy(*at)
    enough = (F.count("*").over(whole) >= 2 * k) & (F.max("dist").over(whole) < F.col("bound") * (1.0 - 1e-5))
    return first.withColumn("complete", F.lit(everything) | enough)
