"""Walks of trees in logarithmic rounds: sums along root paths and over subtrees, nearest marked ancestors, common ancestors.

A round doubles the reach of every node's pointer, so rounds grow with the logarithm of the depth, and a row keeps scalars only, so
every table is linear in the nodes. Common ancestors rest on the numbers of a depth-first walk, found by ranking its
list of entries and exits. Leaves, the bulk of every tree, take no part; they answer through their parent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylomart.runtime import cut_lineage, with_position

LEVEL_BIN = 32  # numbers of one block of the level minima


class CycleError(ValueError):
    """Parents lead round in a circle."""

    def __init__(self) -> None:
        super().__init__("the tree has a cycle")


def interior(branches: DataFrame, *columns: str) -> DataFrame:
    """(tree_id, node_id, up, columns) of the nodes with children; ``up`` is null where the parent is not in the tree."""
    parents = branches.filter("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    inner = branches.join(parents, ["tree_id", "node_id"], "left_semi").select("tree_id", "node_id", "parent_id", *columns)
    known = inner.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_known"))
    return inner.join(known, ["tree_id", "parent_id"], "left").select(
        "tree_id", "node_id", F.when(F.col("_known"), F.col("parent_id")).alias("up"), *columns
    )


def climb(inner: DataFrame, sums: Sequence[str] = (), below: str | None = None) -> DataFrame:
    """(tree_id, node_id, up, root, level, sums, below) of every row of ``inner`` (tree_id, node_id, up, sums, below).

    level counts the edges to the root. Each of ``sums`` is added up over the path from the root, without the root's
    own value. ``below``, a long, is added up over the node's subtree, itself included: with pointers of one reach, each node hands what it has
    gathered so far to the node it points to.
    """
    own = [F.when(F.col("up").isNotNull(), F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0).alias(c) for c in sums]
    held = F.coalesce(F.col(below).cast("long"), F.lit(0)) if below else F.lit(0).cast("long")
    begin = [F.col("node_id").alias("root"), F.lit(0).cast("long").alias("level"), held.alias("_held")]
    state = cut_lineage(inner.select("tree_id", "node_id", F.col("up").alias("_above"), "up", *begin, *own))
    hop = (F.col("tree_id") == F.col("_tree_id")) & (F.col("up") == F.col("_node_id"))
    more = [(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]

    def double(state: DataFrame) -> DataFrame:
        ahead = state.select(*[F.col(c).alias(f"_{c}") for c in ("tree_id", "node_id", "up", "root", "level", *sums)])
        if below:
            handed = state.filter("up is not null").groupBy("tree_id", F.col("up").alias("node_id")).agg(F.sum("_held").alias("_more"))
            total = F.col("_held") + F.coalesce("_more", F.lit(0))
            state = state.join(handed, ["tree_id", "node_id"], "left").withColumn("_held", total).drop("_more").select(*state.columns)
        level = (F.col("level") + 1 + F.col("_level")).alias("level")
        moved = state.filter("up is not null").join(ahead, hop).select(
            "tree_id", "node_id", "_above", F.col("_up").alias("up"), F.col("_root").alias("root"), level, "_held", *more
        )
        return state.filter("up is null").unionByName(moved)

    state, left = _doubled(state, "up is not null", double)
    if left:
        raise CycleError
    gathered = [F.col("_held").alias(below)] if below else []
    return state.select("tree_id", "node_id", F.col("_above").alias("up"), "root", "level", *sums, *gathered)


def _doubled(state: DataFrame, active: str, double) -> tuple[DataFrame, bool]:
    """The stored ``state`` after steps until no row is active, two to a written table; and whether some stay active for ever."""
    for _ in range(state.count().bit_length() // 2 + 2):
        if state.filter(active).isEmpty():
            return state, False
        state = cut_lineage(double(double(state)))
    return state, True


def nearest_marked(inner: DataFrame, mark: str) -> DataFrame:
    """(tree_id, node_id, near): the nearest strict ancestor with ``mark`` of every row of ``inner`` (tree_id, node_id, up, mark).

    null where there is none. A pointer stops at the first mark, so circles that have one are no hindrance, and nodes below a circle
    without one have none.
    """
    marked = F.coalesce(F.col(mark), F.lit(False))
    goal = inner.filter(marked).select("tree_id", F.col("node_id").alias("up"), F.col("node_id").alias("near"))
    state = cut_lineage(inner.select("tree_id", "node_id", "up").join(goal, ["tree_id", "up"], "left").select("tree_id", "node_id", "up", "near"))
    active = "near is null and up is not null"

    def double(state: DataFrame) -> DataFrame:
        ahead = state.select(F.col("tree_id"), F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("near").alias("_near"))
        moved = state.filter(active).drop("near").join(ahead, ["tree_id", "up"])
        return state.filter(f"not ({active})").unionByName(moved.select("tree_id", "node_id", F.col("_up").alias("up"), F.col("_near").alias("near")))

    return _doubled(state, active, double)[0].select("tree_id", "node_id", "near")


def visits(inner: DataFrame) -> DataFrame:
    """(tree_id, node_id, low, num) of every row of the stored ``inner`` (tree_id, node_id, up).

    num is the node's number in a depth-first walk of its tree, counted from the end of the walk, 1 and up; the subtree of a
    node has the numbers low to num. The walk is a list in which every node has an entry and an exit; ranking the
    list by pointer doubling takes log2 of its length in rounds.
    """
    placed = with_position(inner.select("tree_id", "up", "node_id"), ["tree_id", "up", "node_id"], "pos", stored=True)
    ids = placed.select("tree_id", F.col("node_id").alias("up"), F.col("pos").alias("up_pos"))
    linked = placed.join(ids, ["tree_id", "up"], "left")
    first = linked.filter("up_pos is not null").groupBy(F.col("up_pos").alias("pos")).agg(F.min("pos").alias("first"))
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("tree_id").alias("_tree_id"), F.col("up").alias("_up"))
    sibling = (F.col("tree_id") == F.col("_tree_id")) & F.col("up").eqNullSafe(F.col("_up"))
    enter, leave = F.col("pos") * 2, F.col("pos") * 2 + 1
    follow = F.when(sibling, enter + 2).otherwise(F.col("up_pos") * 2 + 1)
    ends = F.array(
        F.struct(enter.alias("id"), F.coalesce(F.col("first") * 2, leave).alias("next"), F.lit(1).cast("long").alias("n")),
        F.struct(leave.alias("id"), follow.alias("next"), F.lit(0).cast("long").alias("n")),
    )
    state = cut_lineage(linked.join(after, "pos", "left").join(first, "pos", "left").select(F.explode(ends).alias("e")).select("e.*"))

    def double(state: DataFrame) -> DataFrame:
        ahead = state.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        moved = state.filter("next is not null").join(ahead, F.col("next") == F.col("_id"))
        return state.filter("next is null").unionByName(moved.select("id", F.col("_next").alias("next"), (F.col("n") + F.col("_n")).alias("n")))

    state, left = _doubled(state, "next is not null", double)
    if left:
        raise CycleError
    even = F.col("id") % 2 == 0
    numbers = state.groupBy(F.floor(F.col("id") / 2).alias("pos")).agg(
        (F.max(F.when(~even, F.col("n"))) + 1).alias("low"), F.max(F.when(even, F.col("n"))).alias("num")
    )
    return placed.join(numbers, "pos").select("tree_id", "node_id", "low", "num")


def tour(inner: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """``climb`` and ``visits`` of one frame: (tree_id, node_id, up, root, level, sums, low, num), stored."""
    inner = cut_lineage(inner)
    return cut_lineage(climb(inner, sums).join(visits(inner), ["tree_id", "node_id"]))


def common_ancestor(toured: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """``pairs`` (tree_id, x, y: numbers of two interior nodes of one component) with ``value`` of their common ancestor.

    With x < y it is the parent of the shallowest node numbered x to y - 1. Least levels are stored once from both ends of blocks of 32 numbers and
    over 2**j blocks, which is linear in the nodes; an interval within one block is looked through.
    """
    parents = toured.select("tree_id", F.col("node_id").alias("up"), F.col(value).alias("_up_value"))
    cell = F.struct("level", F.col("_up_value").alias("value"))
    cells = toured.select("tree_id", "up", "num", "level").join(parents, ["tree_id", "up"], "left")
    cells = cut_lineage(cells.select("tree_id", "num", F.floor(F.col("num") / LEVEL_BIN).alias("bin"), cell.alias("cell")))
    block = Window.partitionBy("tree_id", "bin")
    upto = F.min("cell").over(block.orderBy("num").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    since = F.min("cell").over(block.orderBy("num").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sides = cells.select("tree_id", "num", upto.alias("upto"), since.alias("since"))
    # at most 32 cells
    blocks = cut_lineage(cells.groupBy("tree_id", "bin").agg(F.collect_list(F.struct("num", "cell")).alias("cells"), F.min("cell").alias("cell")))
    reach = blocks.select("tree_id", "bin", F.lit(0).alias("j"), "cell")
    tables, most = [reach], blocks.agg(F.max("bin")).first()[0] or 0
    for j in range(1, max(int(most), 1).bit_length()):
        right = reach.select("tree_id", (F.col("bin") - (1 << (j - 1))).alias("bin"), F.col("cell").alias("_cell"))
        reach = cut_lineage(reach.join(right, ["tree_id", "bin"]).select("tree_id", "bin", F.lit(j).alias("j"), F.least("cell", "_cell").alias("cell")))
        tables.append(reach)
    sparse = tables[0]
    for more in tables[1:]:
        sparse = sparse.unionByName(more)

    low, high = F.least("x", "y"), F.greatest("x", "y")
    asked = pairs.select(*pairs.columns, low.alias("_lo"), (high - 1).alias("_hi"))
    asked = cut_lineage(asked.select("*", F.floor(F.col("_lo") / LEVEL_BIN).alias("_a"), F.floor(F.col("_hi") / LEVEL_BIN).alias("_b")))
    shape = list(pairs.columns)
    same = asked.filter("_hi < _lo").join(toured.select("tree_id", F.col("num").alias("_lo"), F.col(value)), ["tree_id", "_lo"]).select(*shape, value)
    within = F.filter("cells", lambda c: (c["num"] >= F.col("_lo")) & (c["num"] <= F.col("_hi")))
    near = asked.filter("_hi >= _lo and _a = _b").join(blocks.select("tree_id", F.col("bin").alias("_a"), "cells"), ["tree_id", "_a"])
    near = near.select(*shape, F.array_min(F.transform(within, lambda c: c["cell"]))["value"].alias(value))
    far = asked.filter("_a < _b").withColumn("_n", F.col("_b") - F.col("_a") - 1)
    far = far.withColumn("j", F.when(F.col("_n") > 0, F.length(F.bin("_n")) - 1))
    far = far.withColumn("_m", F.col("_a") + 1).withColumn("_k", F.expr("_b - shiftleft(1L, j)"))
    far = far.join(sides.select("tree_id", F.col("num").alias("_lo"), "since"), ["tree_id", "_lo"]).join(
        sides.select("tree_id", F.col("num").alias("_hi"), "upto"), ["tree_id", "_hi"]
    )
    for key, name in (("_m", "_left"), ("_k", "_right")):
        far = far.join(sparse.select("tree_id", "j", F.col("bin").alias(key), F.col("cell").alias(name)), ["tree_id", "j", key], "left")
    far = far.select(*shape, F.least("since", "upto", "_left", "_right")["value"].alias(value))
    return same.unionByName(near).unionByName(far)
