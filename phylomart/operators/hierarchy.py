"""Taxonomies and trees as adjacency tables (tree_id, node_id, parent_id, branch_length, label).

Walks are loops of joins with a written table per round, and their rounds grow with the logarithm of the nodes, not with the depth:
see :mod:`phylomart.operators.tours`. Whole paths are built only where they are the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.functions.text import rank_label
from phylomart.operators.keys import assign_keys
from phylomart.operators.tours import climb, interior, nearest_marked
from phylomart.runtime import cut_lineage, lookup_side, measured


# --- downward -----------------------------------------------------------------------------------


def expand_taxon(
    branches: DataFrame,
    variants: DataFrame,
    taxa: DataFrame,
    roots: DataFrame,
    level: str = "SPECIES",
    tree_id: int = 11,
    include_start: bool = True,
) -> DataFrame:
    """Taxa of rank ``level`` below the start nodes, descent stopping at the first one met.

    ``roots`` has ``node_id``. With ``include_start`` a start node already at the rank is returned
    and ranks are read from the taxon; without it only children count and ranks are read from the
    variant. Branches that never reach the rank vanish. A node is reached once per root, so cycles end
    the walk.
    """
    rank = "taxon_level" if include_start else "taxonvariant_level"
    nodes = (
        branches.filter(F.col("tree_id") == tree_id)
        .select("node_id", "parent_id", "taxonvariant_id")
        .join(variants.select("taxonvariant_id", "taxonvariant_level", "taxon_id"), "taxonvariant_id")
        .join(taxa.select("taxon_id", "taxon_name", "taxon_level"), "taxon_id")
        .select("node_id", "parent_id", "taxonvariant_id", "taxon_id", "taxon_name", F.col(rank).alias("rank"))
    )
    starts = cut_lineage(roots.select(F.col("node_id").alias("root_id")).distinct())
    # a walk changes only at nodes of the rank and at other starts: all others are skipped, and need no names
    begun = starts.select(F.col("root_id").alias("node_id"), F.lit(True).alias("_start"))
    mark = F.col("rank").eqNullSafe(level) | F.coalesce("_start", F.lit(False))
    shape = nodes.columns
    named = [F.when(mark, F.col(c)).alias(c) for c in shape[2:]]
    told = nodes.join(begun, "node_id", "left").select(F.lit(0).cast("long").alias("tree_id"), "node_id", "parent_id", *named, mark.alias("mark"))
    told = cut_lineage(told)
    near = nearest_marked(cut_lineage(interior(told, "mark")), "mark").select(F.col("node_id").alias("parent_id"), "near")
    above = told.filter("mark").select(F.col("node_id").alias("parent_id"), F.col("node_id").alias("_parent"))
    marked = told.filter("mark").join(near, "parent_id", "left").join(above.distinct(), "parent_id", "left")
    nodes = cut_lineage(marked.select(F.coalesce("_parent", "near").alias("_near"), *shape))
    at = nodes.join(starts, F.col("node_id") == F.col("root_id")).select("root_id", "_near", *shape)
    done = []
    if include_start:
        at = cut_lineage(at)
        done.append(at.filter(F.col("rank") == level))
        at = at.filter(~F.col("rank").eqNullSafe(level))
    seen = at.select("root_id", "node_id")
    while rows := at.count():
        over = measured(at.select("root_id", F.col("node_id").alias("_above")), rows)
        below = nodes.join(over, F.col("_near") == F.col("_above")).select("root_id", *nodes.columns)
        below = cut_lineage(below.join(seen, ["root_id", "node_id"], "left_anti").distinct())
        seen = seen.unionByName(below.select("root_id", "node_id"))
        done.append(below.filter(F.col("rank") == level))
        at = below.filter(~F.col("rank").eqNullSafe(level))
    found = reduce(DataFrame.unionByName, done) if done else at
    return found.drop("rank", "_near")


def descendants(edges: DataFrame, roots: DataFrame, child: str = "child_page", parent: str = "parent_page") -> DataFrame:
    """(root, descendant) for every strict descendant of each root; cycles end the walk.

    One parent of every node (the least) makes trees, in which every node hangs below its nearest ancestor that is a root or has further parents.
    Only these are walked, level by level; all else follows from them in one join. So rounds grow with the roots
    and further parents on a path, not with its length.
    """
    links = cut_lineage(edges.filter(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("above")).distinct())
    chosen = cut_lineage(links.groupBy("node").agg(F.min("above").alias("above"), F.count("*").alias("n")))
    start = cut_lineage(roots.select("root").distinct())
    stops = start.select(F.col("root").alias("node")).unionByName(chosen.filter("n > 1").select("node")).distinct().withColumn("stop", F.lit(True))
    stops = cut_lineage(stops)
    tree = F.lit(0).cast("long").alias("tree_id")
    inner = links.select(F.col("above").alias("node")).distinct().join(chosen, "node", "left").join(stops, "node", "left")
    inner = cut_lineage(inner.select(tree, F.col("node").alias("node_id"), F.col("above").alias("up"), "stop"))
    near = nearest_marked(inner, "stop").join(inner.select("node_id", "stop"), "node_id")
    # what hangs on a parent hangs on the stop that the parent is, or hangs on
    near = near.select(F.col("node_id").alias("above"), F.when(F.col("stop"), F.col("node_id")).otherwise(F.col("near")).alias("under"))
    hung = cut_lineage(links.join(near, "above").filter("under is not null").select("node", "under").distinct())
    steps = cut_lineage(hung.join(stops.select("node"), "node", "left_semi"))
    at = cut_lineage(start.select("root", F.col("root").alias("under")))
    reached, seen = at, None
    while rows := at.count():
        below = steps.join(measured(at, rows, 32), "under").select("root", F.col("node").alias("under")).distinct()
        if seen is not None:
            below = below.join(seen, ["root", "under"], "left_anti")
        at = cut_lineage(below)
        seen = at if seen is None else seen.unionByName(at)
    reached = reached.unionByName(seen).distinct()
    return hung.join(reached, "under").select("root", F.col("node").alias("descendant")).distinct()


def with_subspecies(species: DataFrame, branches: DataFrame, variants: DataFrame, tree_id: int = 11, *columns: str) -> DataFrame:
    """Variants of each species plus all variants of its direct child nodes' taxa.

    Returns distinct (taxon_id, columns, taxonvariant_id, taxonvariant_name) with the species' taxon_id and further ``columns`` of ``species``.
    """
    wanted = species.select("taxon_id").distinct()
    named = variants.select("taxonvariant_id", "taxon_id", "taxonvariant_name")
    # read twice, and small beside all variants
    own = cut_lineage(named.join(wanted, "taxon_id", "left_semi"))
    tree = branches.filter(F.col("tree_id") == tree_id).select("node_id", "parent_id", "taxonvariant_id")
    parents = tree.join(own.select("taxonvariant_id", "taxon_id"), "taxonvariant_id").select(
        F.col("node_id").alias("parent_id"), F.col("taxon_id").alias("species_id")
    )
    child_taxa = (
        tree.select("parent_id", "taxonvariant_id")
        .join(parents, "parent_id")
        .join(named.select("taxonvariant_id", "taxon_id"), "taxonvariant_id")
        .select("species_id", "taxon_id")
        # partitioned as the join below needs it, so that rows move once
        .repartition("taxon_id")
        .distinct()
    )
    below = named.join(child_taxa, "taxon_id").select(
        F.col("species_id").alias("taxon_id"), "taxonvariant_id", "taxonvariant_name"
    )
    found = own.select("taxon_id", "taxonvariant_id", "taxonvariant_name").unionByName(below)
    if columns:
        # first the join: its partitions serve to make the rows distinct
        found = found.join(species.select("taxon_id", *columns).distinct(), "taxon_id")
    return found.select("taxon_id", *columns, "taxonvariant_id", "taxonvariant_name").distinct()


# --- upward -------------------------------------------------------------------------------------


def interior_paths(branches: DataFrame) -> DataFrame:
    """For every node that has children: its root-first node path and the depth at each step.

    Returns (tree_id, node_id, path, depths); ``path`` ends in the node itself, ``depths`` are
    summed branch lengths (a missing length counts 0, the root's own length is left out). A node
    whose parent is not in the tree is a root.
    """
    parents = branches.filter(F.col("parent_id").isNotNull()).select(
        F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p")
    ).distinct()
    inner = branches.join(
        parents, (F.col("tree_id") == F.col("_t")) & (F.col("node_id") == F.col("_p")), "left_semi"
    ).select("tree_id", "node_id", "parent_id", F.coalesce("branch_length", F.lit(0.0)).alias("length"))
    known = inner.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_p"), F.lit(True).alias("_known"))
    state = inner.join(known, (F.col("tree_id") == F.col("_t")) & (F.col("parent_id") == F.col("_p")), "left").select(
        "tree_id",
        "node_id",
        F.when(F.col("_known"), F.col("parent_id")).alias("up"),
        F.array("node_id").alias("path"),
        F.array(F.when(F.col("_known"), F.col("length")).otherwise(0.0)).alias("steps"),
    )
    state = cut_lineage(state)
    while True:
        active = state.filter("up is not null")
        n_active, looped = active.agg(F.count("*"), F.count_if(F.array_contains("path", F.col("up")))).first()
        if looped:
            raise ValueError("the tree has a cycle")
        if n_active == 0:
            break
        ahead = state.select(
            F.col("tree_id").alias("_t"),
            F.col("node_id").alias("_n"),
            F.col("up").alias("_up"),
            F.col("path").alias("_path"),
            F.col("steps").alias("_steps"),
        )
        moved = active.join(ahead, (F.col("tree_id") == F.col("_t")) & (F.col("up") == F.col("_n"))).select(
            "tree_id",
            "node_id",
            F.col("_up").alias("up"),
            F.concat("_path", "path").alias("path"),
            F.concat("_steps", "steps").alias("steps"),
        )
        state = cut_lineage(state.filter("up is null").unionByName(moved))
    running = F.aggregate(
        "steps",
        F.array().cast("array<double>"),
        lambda acc, step: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + step)),
    )
    return state.select("tree_id", "node_id", "path", running.alias("depths"))


def node_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``nodes`` (branch rows) with their own root-first ``path`` and ``depths``."""
    above = paths.select(
        F.col("tree_id").alias("_t"), F.col("node_id").alias("_p"), F.col("path").alias("_path"), F.col("depths").alias("_depths")
    )
    depth = F.element_at("_depths", -1) + F.coalesce("branch_length", F.lit(0.0))
    return nodes.join(above, (F.col("tree_id") == F.col("_t")) & (F.col("parent_id") == F.col("_p")), "left").select(
        *nodes.columns,
        F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), F.array("node_id")).alias("path"),
        F.concat(
            F.coalesce("_depths", F.array().cast("array<double>")), F.array(F.coalesce(depth, F.lit(0.0)))
        ).alias("depths"),
    )


def root_to_tip(branches: DataFrame) -> DataFrame:
    """Depth of every node (summed lengths from its root), its level and whether it is a tip.

    A missing length counts 0, the root's own length is left out, and a node whose parent is not in the tree is a root.
    """
    rows = branches.select("tree_id", "node_id", "parent_id", "branch_length", "label")
    inner = cut_lineage(climb(interior(rows, "branch_length"), ["branch_length"]))
    own = inner.select("tree_id", "node_id", F.col("branch_length").alias("_depth"), F.col("level").alias("_level"))
    above = inner.select("tree_id", F.col("node_id").alias("parent_id"), F.col("branch_length").alias("_above"), F.col("level").alias("_above_level"))
    placed = rows.join(own, ["tree_id", "node_id"], "left").join(above, ["tree_id", "parent_id"], "left")
    # a leaf without a parent in the tree is its own root
    length = F.col("_above") + F.coalesce("branch_length", F.lit(0.0))
    return placed.select(
        *rows.columns,
        F.coalesce("_depth", length, F.lit(0.0)).alias("depth"),
        F.coalesce("_level", F.col("_above_level") + 1, F.lit(0)).cast("int").alias("level"),
        F.col("_depth").isNull().alias("is_tip"),
    )


def is_ultrametric(branches: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Per tree: are all tips equally far from the root, within ``tol``."""
    tips = root_to_tip(branches).filter("is_tip")
    return tips.groupBy("tree_id").agg(((F.max("depth") - F.min("depth")) < tol).alias("ultrametric"))


def roots_and_orphans(branches: DataFrame) -> DataFrame:
    """Nodes without a parent (``root``) and nodes whose parent is not in their tree (``orphan``)."""
    roots = branches.filter(F.col("parent_id").isNull())
    nodes = branches.select("tree_id", F.col("node_id").alias("parent_id"))
    orphans = branches.filter(F.col("parent_id").isNotNull()).join(nodes, ["tree_id", "parent_id"], "left_anti")
    shape = ["tree_id", "node_id", "parent_id", "label"]
    return roots.select(*shape, F.lit("root").alias("kind")).unionByName(
        orphans.select(*shape, F.lit("orphan").alias("kind"))
    )


# --- subtrees -----------------------------------------------------------------------------------


def induced_subtree(branches: DataFrame, tips: DataFrame) -> DataFrame:
    """The nodes joining ``tips`` (tree_id, node_id), rooted at their most recent common ancestor.

    In a forest every component gets its own root. The root's parent and length are null.
    """
    shape = ["tree_id", "node_id", "parent_id", "branch_length", "label"]
    tree = branches.select(*shape)
    wanted = cut_lineage(tips.select("tree_id", "node_id").distinct())
    chosen = cut_lineage(tree.join(wanted, ["tree_id", "node_id"], "left_semi").select("tree_id", "node_id", "parent_id"))
    inner = cut_lineage(interior(tree))
    place = inner.select("tree_id", "node_id", F.lit(True).alias("_inner"))
    chosen = cut_lineage(chosen.join(place, ["tree_id", "node_id"], "left"))
    carrier = F.when(F.col("_inner"), F.col("node_id")).otherwise(F.col("parent_id"))
    hits = lookup_side(chosen.groupBy("tree_id", carrier.alias("node_id")).agg(F.count("*").alias("_held")))
    risen = cut_lineage(climb(inner.join(hits, ["tree_id", "node_id"], "left"), below="_held"))
    above = risen.select("tree_id", F.col("node_id").alias("parent_id"), F.col("level").alias("_up_level"), F.col("root").alias("_up_root"))
    chosen = chosen.join(above, ["tree_id", "parent_id"], "left")
    counted = risen.filter("_held > 0")
    totals = counted.filter("node_id = root").select("tree_id", "root", F.col("_held").alias("_all"))
    counted = counted.join(lookup_side(totals), ["tree_id", "root"])
    # the common ancestor is the deepest node that holds all of the component's tips; a single tip is its own
    leaf = chosen.filter("_inner is null").select("tree_id", "node_id", F.coalesce("_up_root", "node_id").alias("root"), (F.coalesce("_up_level", F.lit(-1)) + 1).alias("level"))
    single = leaf.join(totals.filter("_all > 1").select("tree_id", "root"), ["tree_id", "root"], "left_anti")
    heads = counted.filter("_held = _all").select("tree_id", "root", "level").unionByName(single.select("tree_id", "root", "level"))
    heads = lookup_side(heads.groupBy("tree_id", "root").agg(F.max("level").alias("_head")))
    closure = counted.select("tree_id", "node_id", "root", "level").unionByName(leaf.select("tree_id", "node_id", "root", "level"))
    closure = closure.join(heads, ["tree_id", "root"]).filter("level >= _head")
    inside = F.col("level") > F.col("_head")
    return tree.join(closure, ["tree_id", "node_id"]).select(
        "tree_id",
        "node_id",
        F.when(inside, F.col("parent_id")).alias("parent_id"),
        F.when(inside, F.col("branch_length")).alias("branch_length"),
        "label",
    )


def collapse_unary(branches: DataFrame) -> DataFrame:
    """Remove interior nodes with one child, adding their lengths to the node below.

    Chains shrink by pointer doubling. A root with one child goes too; the node below becomes root.
    """
    tree = branches.select("tree_id", "node_id", "parent_id", "branch_length", "label")
    single = tree.filter("parent_id is not null").groupBy(
        F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p")
    ).agg(F.count("*").alias("_n")).filter("_n = 1").select("_t", "_p")
    is_single = (F.col("tree_id") == F.col("_t")) & (F.col("node_id") == F.col("_p"))
    gone = tree.join(single, is_single, "left_semi").select(
        "tree_id", "node_id", F.col("parent_id").alias("up"), F.coalesce("branch_length", F.lit(0.0)).alias("length")
    )
    gone = cut_lineage(gone.withColumn("open", F.lit(True)))
    # a chain is no longer than the nodes it is made of
    for _ in range(gone.count().bit_length() + 1):
        ahead = gone.select(
            F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("up").alias("_up"), F.col("length").alias("_length")
        )
        moving = gone.filter("open")
        if moving.isEmpty():
            break
        moved = moving.join(ahead, (F.col("tree_id") == F.col("_t")) & (F.col("up") == F.col("_n")), "left").select(
            "tree_id",
            "node_id",
            F.when(F.col("_n").isNotNull(), F.col("_up")).otherwise(F.col("up")).alias("up"),
            (F.col("length") + F.coalesce("_length", F.lit(0.0))).alias("length"),
            F.col("_n").isNotNull().alias("open"),
        )
        gone = cut_lineage(gone.filter("not open").unionByName(moved))
    else:
        raise ValueError("a chain of single children has a cycle")
    skip = gone.select(
        F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("up").alias("_up"), F.col("length").alias("_length")
    )
    kept = tree.join(gone.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti")
    joined = kept.join(skip, (F.col("tree_id") == F.col("_t")) & (F.col("parent_id") == F.col("_n")), "left")
    parent = F.when(F.col("_n").isNotNull(), F.col("_up")).otherwise(F.col("parent_id"))
    length = F.when(F.col("_n").isNotNull(), F.coalesce("branch_length", F.lit(0.0)) + F.col("_length")).otherwise(
        F.col("branch_length")
    )
    return joined.select(
        "tree_id", "node_id", parent.alias("parent_id"), F.when(parent.isNotNull(), length).alias("branch_length"), "label"
    )


def drop_tips(branches: DataFrame, tips: DataFrame) -> DataFrame:
    """Remove the listed tips (tree_id, node_id), then prune and collapse what is left."""
    parents = branches.filter("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    all_tips = branches.select("tree_id", "node_id").join(parents, ["tree_id", "node_id"], "left_anti")
    kept = all_tips.join(tips.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti")
    return collapse_unary(induced_subtree(branches, kept))


# --- rank rows ----------------------------------------------------------------------------------


def ranks_to_adjacency(
    rows: DataFrame, ranks: Sequence[str], id_col: str = "id", line_col: str = "line", label_of=None
) -> DataFrame:
    """Rank rows in file order to (line, id, label, parent_id).

    Each row's path is its non-empty rank labels. The parent is the id of the row that first
    introduced the deepest prefix already seen on an earlier line; a repeated full path therefore
    has the earlier row as parent. A prefix's first row comes from a pre-aggregated minimum, so the
    top rank, shared by every row, is no hot spot.
    """
    label_of = label_of or _own_rank_label
    labels = [F.struct(F.lit(i).alias("rank"), label_of(rank, rows.columns).alias("label")) for i, rank in enumerate(ranks)]
    filled = [F.coalesce(F.col(rank), F.lit("")) != "" for rank in ranks]
    steps = F.array_compact(F.array(*[F.when(has, step) for has, step in zip(filled, labels)]))
    base = rows.select(F.col(line_col).alias("line"), F.col(id_col).alias("id"), steps.alias("steps"))
    names = F.transform("steps", lambda s: s["label"])
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("steps")),
        lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(names, F.lit(1), d), "\u001f").alias("prefix")),
    )
    long = base.filter(F.size("steps") > 0).select("line", "id", F.explode(prefixes).alias("_p")).select(
        "line", "id", "_p.depth", "_p.prefix"
    )
    first = lookup_side(
        long.groupBy("prefix").agg(F.min(F.struct("line", "id")).alias("_f")).select(
            "prefix", F.col("_f.line").alias("_first_line"), F.col("_f.id").alias("_first_id")
        )
    )
    parents = (
        long.select("line", "depth", "prefix")
        .join(first, "prefix")
        .filter(F.col("_first_line") < F.col("line"))
        .groupBy("line")
        .agg(F.max_by("_first_id", "depth").alias("parent_id"))
    )
    named = base.select("line", "id", F.try_element_at("steps", F.lit(-1))["label"].alias("label"))
    return named.join(parents, "line", "left")


def _own_rank_label(rank: str, columns: Sequence[str]):
    part = {c: F.col(c) if c in columns else F.lit(None).cast("string") for c in ("genus", "species", "subspecies")}
    return rank_label(rank, part["genus"], part["species"], part["subspecies"], F.col(rank))


def load_tree(
    nodes: DataFrame, tree_name: str, trees: DataFrame, label_map: DataFrame, branches: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Register a tree: returns (new tree row, its branch rows with keys, tree_id and variant ids)."""
    tree_id = int(trees.agg(F.max("tree_id")).first()[0] or 0) + 1
    spark = nodes.sparkSession
    tree = spark.range(1).select(F.lit(tree_id).cast("long").alias("tree_id"), F.lit(tree_name).alias("tree_name"))
    mapped = label_map.filter("taxonvariant_id is not null").select("label", "taxonvariant_id")
    rows = nodes.select("node_id", "parent_id", "branch_length", "label").join(mapped, "label", "left")
    stamped = rows.withColumn("tree_id", F.lit(tree_id).cast("long"))
    keyed = assign_keys(stamped, branches, "branch_id", ["node_id"])
    return tree, keyed.select("branch_id", "node_id", "parent_id", "taxonvariant_id", "label", "branch_length", "tree_id")
