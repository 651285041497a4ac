"""A count-refined cell tree over points on the globe, and k nearest by descending it.

Cells are halved on both axes twice a level step, down to where a cell holds at most ``FULL`` distinct coordinates; there is no
finest cell to crowd, but for ones some 15 cm wide.  The tree is two tables: ``spots``, every distinct coordinate with its leaf,
and ``nodes``, every cell on the way to a leaf with the number of points below it.  Both are written once and kept with the snapshot.

A search descends all asks at once, one join a level.  Each ask holds the cells that may still matter: with the least and the
largest distance to every cell and its count, the distance within which ``k`` points certainly lie is known, and
cells further away than that are dropped before the next step.  Only the leaves that remain are joined with their spots.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import geo
from netloom.operators import common as C

#: Distinct coordinates of a leaf, halvings of a step, and the finest level of the first pass over the points and of all.
FULL, STEP, MIDDLE, FINEST = 32, 2, 16, 28
#: Cells every ask may start with.
START = 64


@dataclass(frozen=True)
class CellTree:
    """spots (kind, lat, lon, copies, level, cx, cy), nodes (kind, level, cx, cy, n, leaf), and the levels a descent goes through."""

    spots: DataFrame
    nodes: DataFrame
    start: int
    deepest: int


def _at(level: int) -> list[Column]:
    return [geo.cell_x(F.col("lon"), level).alias("fx"), geo.cell_y(F.col("lat"), level).alias("fy")]


def _leaves(cells: DataFrame, top: int, bottom: int) -> DataFrame:
    """kind, fx, fy of every cell of level ``bottom`` with the level of its leaf: the coarsest from ``top`` on that is not too
    full, or null.  ``cells``: kind, fx, fy, n."""
    levels = F.explode(F.array(*[F.lit(lv) for lv in range(top, bottom + 1, STEP)]))
    up = cells.withColumn("level", levels)
    up = up.withColumns({"cx": F.expr(f"shiftright(fx, {bottom} - level)"), "cy": F.expr(f"shiftright(fy, {bottom} - level)")})
    free = up.groupBy("kind", "level", "cx", "cy").agg(F.sum("n").alias("held")).where(F.col("held") <= FULL).drop("held")
    found = up.join(free, ["kind", "level", "cx", "cy"]).groupBy("kind", "fx", "fy").agg(F.min("level").alias("level"))
    return cells.join(found, ["kind", "fx", "fy"], "left")


def build(points: DataFrame) -> CellTree:
    """The tree of ``points(kind, lat, lon)``; points without a coordinate are left out.

    Cells are counted at one fine level and summed upwards; only coordinates in cells still too full there are counted again
    below it.
    """
    spots = C.materialize(points.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("kind", "lat", "lon")
                          .agg(F.count(F.lit(1)).alias("copies")), "spots")

    def placed(rows: DataFrame, top: int, bottom: int) -> DataFrame:
        keyed = rows.select("kind", "lat", "lon", "copies", *_at(bottom))
        cells = keyed.groupBy("kind", "fx", "fy").agg(F.count(F.lit(1)).alias("n"))
        return keyed.join(_leaves(cells, top, bottom).drop("n"), ["kind", "fx", "fy"])

    first = C.materialize(placed(spots, STEP, MIDDLE), "placed")
    parts = [(first.where("level IS NOT NULL"), MIDDLE)]
    crowded = first.where("level IS NULL").select("kind", "lat", "lon", "copies")
    if not crowded.isEmpty():
        parts.append((placed(crowded, MIDDLE + STEP, FINEST).withColumn("level", F.coalesce("level", F.lit(FINEST))), FINEST))
    done = None
    for rows, bottom in parts:
        part = rows.select("kind", "lat", "lon", "copies", "level", F.expr(f"shiftright(fx, {bottom} - level)").alias("cx"),
                           F.expr(f"shiftright(fy, {bottom} - level)").alias("cy"))
        done = part if done is None else done.unionByName(part)
    done = C.materialize(done, "cell-spots")
    leaves = done.groupBy("kind", "level", "cx", "cy").agg(F.sum("copies").alias("n"))
    above = leaves.withColumn("up", F.explode(F.expr(f"sequence({STEP}, level, {STEP})")))
    nodes = C.materialize(above.groupBy(
        "kind", F.col("up").alias("level"), F.expr("shiftright(cx, level - up)").alias("cx"), F.expr("shiftright(cy, level - up)").alias("cy"))
        .agg(F.sum("n").alias("n"), F.min(F.col("level") == F.col("up")).alias("leaf")), "cell-nodes")
    sizes = {r.level: (r.cells, r.leaves) for r in nodes.groupBy("level").agg(  # one row a level
        F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("leaf"), 1)).alias("leaves")).collect()}
    start, above_leaves = STEP, 0
    for level in sorted(sizes):
        if sizes[level][0] + above_leaves > START:
            break
        start, above_leaves = level, above_leaves + sizes[level][1]
    return CellTree(done, nodes, start, max(sizes, default=STEP))


#: Added to bounds, in radians (some 60 cm): the angle of a haversine near one is no surer than that.
SLACK = 1e-7


def _angle(hav: Column) -> Column:
    return F.lit(2.0) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), hav))))


def _bounds() -> tuple[Column, Column]:
    """Least and largest distance, in radians, from an ask to a cell: the better of a bound by sides and one by centre and radius,
    which is the sharper one on the far side of the globe."""
    size = F.lit(360.0) / F.expr("shiftleft(1L, level)")
    lat0, lon0 = F.col("cy") * size - 90.0, F.col("cx") * size - 180.0
    lat1 = F.least(lat0 + size, F.lit(90.0))
    turn = F.abs(F.col("qlon") - lon0 - size / 2)
    away = F.least(turn, F.abs(F.lit(360.0) - turn))  # longitudes from -180 to 180
    near_lat = F.greatest(F.lit(0.0), lat0 - F.col("qlat"), F.col("qlat") - lat1)
    far_lat = F.greatest(F.abs(F.col("qlat") - lat0), F.abs(F.col("qlat") - lat1))
    near_lon, far_lon = F.greatest(F.lit(0.0), away - size / 2), F.least(F.lit(180.0), away + size / 2)
    middle = (lat0 + lat1) / 2
    c0, c1 = F.cos(F.radians(lat0)), F.cos(F.radians(lat1))
    widest = F.when((lat0 <= 0) & (lat1 >= 0), 1.0).otherwise(F.greatest(c0, c1))

    def angle(lat: Column, lon: Column, cos: Column) -> Column:
        a, b = F.sin(F.radians(lat) / 2), F.sin(F.radians(lon) / 2)
        return _angle(a * a + F.cos(F.radians(F.col("qlat"))) * cos * b * b)

    centre, radius = angle(F.col("qlat") - middle, away, F.cos(F.radians(middle))), F.radians(size / 2) * math.sqrt(2.0)
    return (F.greatest(angle(near_lat, near_lon, F.least(c0, c1)), centre - radius) - SLACK,
            F.least(angle(far_lat, far_lon, widest), centre + radius) + SLACK)


def _needed(held: DataFrame) -> DataFrame:
    """Cells of each ask that may hold one of its ``k`` nearest, and ``reach``: the angle within which those certainly lie."""
    near, far = _bounds()
    # An ask holds a few dozen cells.
    upto = Window.partitionBy("ask_id").orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy("ask_id")
    return (held.withColumns({"near": near, "far": far}).withColumn("below", F.sum("n").over(upto))
            .withColumn("reach", F.min(F.when(F.col("below") >= F.col("k"), F.col("far"))).over(w))
            .where("reach IS NULL OR near <= reach").drop("near", "far", "below"))


def leaves_in_reach(tree: CellTree, asks: DataFrame) -> DataFrame:
    """ask_id, kind, k, qlat, qlon, level, cx, cy, reach: the leaves that may hold the ``k`` nearest points of each ask."""
    first = tree.nodes.where((F.col("level") == tree.start) | (F.col("level") < tree.start) & F.col("leaf"))
    # At most START cells.
    held = _needed(asks.select("ask_id", "kind", "k", "qlat", "qlon").join(F.broadcast(first), "kind"))
    for level in range(tree.start + STEP, tree.deepest + 1, STEP):
        below = tree.nodes.where(F.col("level") == level).select(
            "kind", F.expr(f"shiftright(cx, {STEP})").alias("px"), F.expr(f"shiftright(cy, {STEP})").alias("py"),
            F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("n").alias("m"), F.col("leaf").alias("is_leaf"))
        # Leaves stay as they are (no cell has a negative place); one reference to the cells held keeps the plan linear in the levels.
        keyed = held.drop("reach").withColumns({"px": F.when(F.col("leaf"), -1 - F.col("cx")).otherwise(F.col("cx")),
                                                "py": F.when(F.col("leaf"), -1 - F.col("cy")).otherwise(F.col("cy"))})
        own = F.col("leaf")
        held = _needed(keyed.join(below, ["kind", "px", "py"], "left").select(
            "ask_id", "kind", "k", "qlat", "qlon", F.when(own, F.col("level")).otherwise(F.lit(level)).alias("level"),
            F.when(own, F.col("cx")).otherwise(F.col("x")).alias("cx"), F.when(own, F.col("cy")).otherwise(F.col("y")).alias("cy"),
            F.when(own, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(own, own).otherwise(F.col("is_leaf")).alias("leaf")))
    return held.drop("n", "leaf")


def nearest_spots(tree: CellTree, asks: DataFrame) -> DataFrame:
    """ask_id, k, kind, lat, lon, distance_km: a superset of the spots of each ask's ``k`` nearest points, all within its reach.

    ``asks(ask_id, kind, qlat, qlon, k)`` with ``k`` of one or more.
    """
    met = leaves_in_reach(tree, asks).join(tree.spots, ["kind", "level", "cx", "cy"])
    found = met.withColumn("distance_km", geo.haversine_km(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")))
    return (found.where(F.col("reach").isNull() | (F.col("distance_km") <= (F.col("reach") + SLACK) * geo.EARTH_RADIUS_KM))
            .select("ask_id", "k", "kind", "lat", "lon", "copies", "distance_km"))
