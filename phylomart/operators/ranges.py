"""Places inside polygons, by cells that divide where edges are many.

A polygon starts in a block of two by two cells about as large as itself. A cell that more than ``max_edges`` edges touch
becomes a block of cells half as large. A cell keeps the edges that touch it and whether its lower right corner is inside;
a cell without edges is wholly inside, or left out. So an edge stands in the cells it touches and nowhere else, no row holds
a whole ring, and a place is tested against the few edges of one cell a polygon.

From a cell's corner a place is reached by going up the right border and then left. Each edge passed on the way turns inside
into outside. Both legs compare a place with an edge by one expression, so rounding cannot make them disagree, and the result
equals the even-odd ray cast over all edges (:func:`phylomart.functions.geo.point_in_rings`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.functions.geo import edge_at
from phylomart.runtime import cut_lineage, lookup_side

# Side of a cell of level 0 in degrees; each level halves it. Level 24 has cells of about seven metres.
WORLD = 1024.0
DEEPEST = 24
MAX_EDGES = 64
CELL = ["shape", "level", "cx", "cy"]
EDGE = ["x0", "y0", "x1", "y1"]


def _side(level: Column) -> Column:
    return F.lit(WORLD) * F.pow(F.lit(2.0), -level)


def _spans(e: dict[str, Column], y: Column) -> Column:
    return (e["y0"] <= y) != (e["y1"] <= y)


def _right_of(e: dict[str, Column], x: Column, y: Column) -> Column:
    """Whether the ray from (x, y) towards growing x meets the edge."""
    one, both = (e["x0"] > x) | (e["x1"] > x), (e["x0"] > x) & (e["x1"] > x)
    return _spans(e, y) & one & (both | F.coalesce(x < edge_at(e, y), F.lit(False)))


def _below(e: dict[str, Column], x: Column, y: Column) -> Column:
    """Whether the edge passes the vertical line at x, and does so at y or below it."""
    passes = (e["x0"] <= x) != (e["x1"] <= x)
    rising = (e["x1"] > e["x0"]) == (e["y1"] > e["y0"])
    at = F.when(_spans(e, y), rising == F.coalesce(x < edge_at(e, y), F.lit(False))).otherwise(F.greatest(e["y0"], e["y1"]) <= y)
    return passes & at


def ring_edges(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per edge of the ``rings`` of each row, with ``keys`` and a number of the row as ``shape``.

    Points with a null, NaN or infinite coordinate are left out, and a ring whose ends differ is closed.
    """
    far = F.lit(float("inf"))

    def usable(p: Column) -> Column:
        return F.coalesce((F.abs(p["x"]) < far) & (F.abs(p["y"]) < far), F.lit(False))

    rings = shapes.withColumn("shape", F.monotonically_increasing_id()).select(*keys, "shape", F.explode("rings").alias("ring"))
    points = rings.withColumn("ring", F.filter("ring", usable)).filter(F.size("ring") > 1)
    # each point with the next one, the last with the first; a closed ring's last edge has no length and turns nothing
    following = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    edge = points.select(*keys, "shape", F.explode(F.arrays_zip(F.col("ring").alias("a"), following.alias("b"))).alias("e"))
    flat = edge.select(
        *keys, "shape", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1")
    )
    return flat.filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))


def _first_blocks(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every edge with the block of its polygon, whose lower right corner is outside."""
    low, high = [F.min(F.least(f"{c}0", f"{c}1")).alias(f"{c}_min") for c in "xy"], [F.max(F.greatest(f"{c}0", f"{c}1")).alias(f"{c}_max") for c in "xy"]
    extent = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")) * 1.000001
    sized = edges.groupBy("shape").agg(*low, *high).withColumn("level", F.least(F.floor(F.log2(F.lit(WORLD) / extent)), F.lit(DEEPEST)).cast("int"))
    side = _side(F.col("level"))
    blocks = sized.select(
        "shape", "level", F.floor(F.col("x_min") / side).alias("cx"), F.floor(F.col("y_min") / side).alias("cy"), F.lit(0).alias("parity")
    )
    return edges.join(lookup_side(blocks), "shape").select(*keys, *CELL, "parity", *EDGE)


def _touches(e: dict[str, Column], x: Column, y: Column, side: Column) -> Column:
    """Whether the edge comes near the cell at (x, y): their boxes meet and the cell's corners are not clearly on one side."""
    boxes = (
        (F.greatest(e["x0"], e["x1"]) >= x) & (F.least(e["x0"], e["x1"]) <= x + side)
        & (F.greatest(e["y0"], e["y1"]) >= y) & (F.least(e["y0"], e["y1"]) <= y + side)
    )
    dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
    sides = [dx * (v - e["y0"]) - dy * (u - e["x0"]) for u in (x, x + side) for v in (y, y + side)]
    near = 1e-6 * (F.abs(dx) + F.abs(dy))
    return boxes & (F.least(*sides) <= near) & (F.greatest(*sides) >= -near)


def _split(blocks: DataFrame, keys: Sequence[str], max_edges: int) -> tuple[DataFrame, DataFrame]:
    """The four cells of every block with their parity and number of edges, and the edges of each cell."""
    e = {c: F.col(c) for c in EDGE}
    side = _side(F.col("level"))
    x1, x2 = (F.col("cx") + 1) * side, (F.col("cx") + 2) * side
    y0, y1 = F.col("cy") * side, (F.col("cy") + 1) * side

    def turns(one: Column, other: Column) -> Column:
        return F.sum((one != other).cast("long"))

    corners = blocks.groupBy(*keys, *CELL, "parity").agg(
        turns(_right_of(e, x1, y0), _right_of(e, x2, y0)).alias("_left_low"),
        turns(_below(e, x2, y0), _below(e, x2, y1)).alias("_up"),
        turns(_right_of(e, x1, y1), _right_of(e, x2, y1)).alias("_left_high"),
    )
    p = F.col("parity")
    found = [(1, 0, p), (0, 0, p + F.col("_left_low")), (1, 1, p + F.col("_up")), (0, 1, p + F.col("_up") + F.col("_left_high"))]
    four = [
        F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), (value % 2).cast("int").alias("parity")) for i, j, value in found
    ]
    cells = corners.select(*keys, "shape", "level", F.explode(F.array(*four)).alias("c")).select(*keys, "shape", "level", "c.*")
    # one row a cell before the test: four tests in one expression were too long for compiled code
    near = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
    spread = blocks.select("shape", "level", F.explode(near).alias("c"), *EDGE).select("shape", "level", "c.*", *EDGE)
    edges = cut_lineage(spread.filter(_touches(e, F.col("cx") * side, F.col("cy") * side, side)))
    counted = cells.join(edges.groupBy(*CELL).agg(F.count("*").alias("edges")), CELL, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    dense = (F.col("edges") > max_edges) & (F.col("level") < DEEPEST)
    return cut_lineage(counted.withColumn("dense", dense)), edges


def range_cover(shapes: DataFrame, keys: Sequence[str], max_edges: int = MAX_EDGES) -> DataFrame:
    """Cells (keys, shape, level, cx, cy, parity, edges) that cover the polygons of ``shapes`` (keys, rings).

    ``edges`` is an array of at most ``max_edges`` edges; only a cell of the deepest level holds as many as pass through its seven
    metres. Empty ``edges`` mark a cell wholly inside.
    """
    keys = list(keys)
    blocks = cut_lineage(_first_blocks(cut_lineage(ring_edges(shapes, keys)), keys))
    parts = []
    while True:
        cells, edges = _split(blocks, keys, max_edges)
        leaves = cells.filter(~F.col("dense") & ((F.col("edges") > 0) | (F.col("parity") == 1))).drop("dense", "edges")
        own = edges.join(leaves.select(*CELL), CELL, "left_semi").groupBy(*CELL).agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
        empty = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
        parts.append(leaves.join(own, CELL, "left").withColumn("edges", F.coalesce("edges", empty)))
        dense = cells.filter("dense").select(*keys, *CELL, "parity")
        if dense.isEmpty():
            break
        inner = edges.join(dense, CELL)
        finer = [(F.col("level") + 1).alias("level"), (F.col("cx") * 2).alias("cx"), (F.col("cy") * 2).alias("cy")]
        blocks = cut_lineage(inner.select(*keys, "shape", *finer, "parity", *EDGE))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def places_inside(places: DataFrame, cover: DataFrame, group: str) -> DataFrame:
    """Rows of ``places`` (``group``, lat, lon, further columns) inside any polygon of their group; equal rows come once.

    A place meets the cell it is in at each level its group has. Where a group's cells reach beyond 180 degrees east or west, its
    places are looked up there too. The place is the streamed side, so AQE splits a cell with very many places.
    """
    side = _side(F.col("level"))
    # a place needs to look only at levels whose cells reach about it, so most pairs of place and level are never shuffled
    bounds = [F.min("cx").alias("left"), F.max("cx").alias("right"), F.min("cy").alias("low"), F.max("cy").alias("high")]
    levels = lookup_side(
        cover.groupBy(group, "level").agg(*bounds).groupBy(group).agg(
            F.collect_list(F.struct("level", "left", "right", "low", "high")).alias("_levels"),
            (F.max((F.col("right") + 1) * side) > 180).alias("_east"),
            (F.min(F.col("left") * side) < -180).alias("_west"),
        )
    )
    known = places.join(levels, group)
    around = F.array_compact(F.array(F.col("lon"), F.when(F.col("_east"), F.col("lon") + 360), F.when(F.col("_west"), F.col("lon") - 360)))
    spread = known.select(*places.columns, F.explode(around).alias("_x"), "_levels").select(*places.columns, "_x", F.explode("_levels").alias("_l"))
    at = spread.select(*places.columns, "_x", F.col("_l.level").alias("level"), "_l")
    at = at.withColumn("cx", F.floor(F.col("_x") / side)).withColumn("cy", F.floor(F.col("lat") / side))
    at = at.filter(F.col("cx").between(F.col("_l.left"), F.col("_l.right")) & F.col("cy").between(F.col("_l.low"), F.col("_l.high"))).drop("_l").alias("p")
    x, y = F.col("p._x"), F.col("p.lat")
    right = (F.col("p.cx") + 1) * _side(F.col("p.level"))
    foot = F.col("p.cy") * _side(F.col("p.level"))

    def turned(total: Column, row: Column) -> Column:
        e = {c: row[c] for c in EDGE}
        meets = _spans(e, y) & F.coalesce(x < edge_at(e, y), F.lit(False))
        up = _below(e, right, foot) != _below(e, right, y)
        return total + up.cast("int") + (meets != _right_of(e, right, y)).cast("int")

    odd = F.aggregate(F.col("c.edges"), F.col("c.parity"), turned) % 2 == 1
    same = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in (group, "level", "cx", "cy")]
    hits = at.join(cover.alias("c"), reduce(lambda a, b: a & b, [*same, odd]), "left_semi")
    return hits.select(*places.columns).distinct()
