"""Operators on phylogenies: bifurcation, contrasts and path lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.operators.hierarchy import collapse_unary
from phylomart.operators.tours import climb, common_ancestor, interior, tour
from phylomart.runtime import cut_lineage, lookup_side, ordinal_within


def resolve_polytomies(branches: DataFrame) -> DataFrame:
    """Make every node with more than two children bifurcate through zero-length nodes.

    Any resolution is as good as another; ours is balanced, so k children add log2(k) levels and no
    node's children are ever gathered. The k children take places k..2k-1 of a binary heap whose
    place 1 is the parent, and every place h > 1 hangs below place h // 2. Place h in 2..k-1 becomes
    a new node with id -(id of the child ranked h-2) - 1.
    """
    shape = ["tree_id", "node_id", "parent_id", "branch_length", "label"]
    tree = branches.select(*shape)
    sizes = tree.filter("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.count("*").alias("_k"))
    wide = lookup_side(sizes.filter("_k > 2"))
    many = tree.join(wide, ["tree_id", "parent_id"])
    ranked = cut_lineage(ordinal_within(many, ["tree_id", "parent_id"], ["node_id"], "_rank").withColumn("_rank", F.col("_rank") - 1))
    places = ranked.select(*shape, (F.col("_k") + F.col("_rank")).alias("_place")).unionByName(
        ranked.filter(F.col("_rank") < F.col("_k") - 2).select(
            "tree_id",
            (-F.col("node_id") - 1).alias("node_id"),
            "parent_id",
            F.lit(0.0).alias("branch_length"),
            F.lit("").alias("label"),
            (F.col("_rank") + 2).alias("_place"),
        )
    )
    carriers = ranked.select(
        F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p"), (F.col("_rank") + 2).alias("_h"), (-F.col("node_id") - 1).alias("_new")
    )
    above = F.floor(F.col("_place") / 2)
    hung = places.join(
        carriers, (F.col("tree_id") == F.col("_t")) & (F.col("parent_id") == F.col("_p")) & (above == F.col("_h")), "left"
    ).select(
        "tree_id", "node_id", F.when(above > 1, F.col("_new")).otherwise(F.col("parent_id")).alias("parent_id"), "branch_length", "label"
    )
    rest = tree.join(wide.select("tree_id", "parent_id"), ["tree_id", "parent_id"], "left_anti").select(*shape)
    return rest.unionByName(hung)


# What a node with one child known makes of the other child's (x, v): while v > 0, the ratios a/b = v and c/b = x of a linear
# map of (a, b, c), so that maps of a chain multiply; for v = 0, x becomes za * x + zb and v becomes zg. ``still`` tells that a
# positive v comes out as 0.
_MAP = ("aa", "ab", "ba", "bb", "ca", "cb", "cc", "za", "zb", "zg")


def _beside(x: Column, v: Column, length: Column) -> Column:
    """The map of a node whose known child has (x, v); a known child without values passes the other one on."""
    empty, zero = x.isNull(), v == 0
    made = {
        "aa": length + v, "ab": length * v, "ba": F.lit(1.0), "bb": v, "ca": x, "cb": F.lit(0.0), "cc": v,
        "za": F.when(zero, 0.5).otherwise(1.0), "zb": F.when(zero, x / 2).otherwise(0.0), "zg": length,
    }
    passed = dict(zip(_MAP, (F.lit(1.0), length, *map(F.lit, (0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0)), length), strict=True))
    cells = [F.when(empty, passed[k]).otherwise(made[k]).alias(k) for k in _MAP]
    return F.struct(*cells, (~empty & zero & (length == 0)).alias("still"))


def _after(g: Column, f: Column) -> Column:
    """The map ``g`` after the map ``f``, scaled so that the row of b adds up to 1."""
    out = {}
    for col in "ab":
        fa, fb, fc = f["a" + col], f["b" + col], f["c" + col]
        out["a" + col] = F.when(f["still"], g["zg"] * fb).otherwise(g["aa"] * fa + g["ab"] * fb)
        out["b" + col] = F.when(f["still"], fb).otherwise(g["ba"] * fa + g["bb"] * fb)
        out["c" + col] = F.when(f["still"], g["za"] * fc + g["zb"] * fb).otherwise(g["ca"] * fa + g["cb"] * fb + g["cc"] * fc)
    out["cc"] = F.when(f["still"], g["za"] * f["cc"]).otherwise(g["cc"] * f["cc"])
    scale = out["ba"] + out["bb"]
    cells = [F.coalesce(F.try_divide(out[k], scale), out[k]).alias(k) for k in _MAP[:7]]
    held, under = f["zg"] == 0, g["ba"] * f["zg"] + g["bb"]
    flat = {
        "za": F.when(held, g["za"] * f["za"]).otherwise(F.try_divide(g["cc"] * f["za"], under)),
        "zb": F.when(held, g["za"] * f["zb"] + g["zb"]).otherwise(F.try_divide(g["ca"] * f["zg"] + g["cb"] + g["cc"] * f["zb"], under)),
        "zg": F.when(held, g["zg"]).otherwise(F.try_divide(g["aa"] * f["zg"] + g["ab"], under)),
    }
    still = F.when(f["still"], g["zg"] == 0).otherwise(g["still"])
    return F.struct(*cells, *[v.alias(k) for k, v in flat.items()], still.alias("still"))


def _applied(m: Column, x: Column, v: Column) -> tuple[Column, Column]:
    under = m["ba"] * v + m["bb"]
    out_x = F.when(v == 0, m["za"] * x + m["zb"]).otherwise(F.try_divide(m["ca"] * v + m["cb"] + m["cc"] * x, under))
    out_v = F.when(v == 0, m["zg"]).otherwise(F.try_divide(m["aa"] * v + m["ab"], under))
    return out_x, F.when(x.isNotNull(), out_v)


def _joined(x1: Column, v1: Column, x2: Column, v2: Column) -> tuple[Column, Column]:
    """(x, growth of the length) of a node from both children; a child without values passes the other one on."""
    span = v1 + v2
    x = F.when(span == 0, (x1 + x2) / 2).otherwise(F.try_divide(x1 * v2 + x2 * v1, span))
    grown = F.when(span == 0, 0.0).otherwise(F.try_divide(v1 * v2, span))
    both = x1.isNotNull() & x2.isNotNull()
    return F.when(both, x).otherwise(F.coalesce(x1, x2)), F.when(both, grown).otherwise(F.when(x1.isNotNull(), v1).otherwise(v2))


def independent_contrasts(branches: DataFrame, traits: DataFrame) -> DataFrame:
    """Unscaled contrasts and ancestral values per interior node and trait.

    ``traits`` is long: (tree_id, node_id, trait, value) at tips. One-child nodes are collapsed and
    polytomies resolved first. A child without a value passes its sibling through. Two sisters of zero length give a null
    contrast and the plain mean.

    All traits of all trees contract together. A round gives values to the nodes whose children have them. A node with one such child waits for
    the other with a map from that one's value to its own, and every round doubles how far down such maps reach. So the rounds grow with the logarithm
    of the nodes, on a chain too. Rows are the nodes of a tree times the traits with a value in it.
    """
    tree = cut_lineage(resolve_polytomies(collapse_unary(branches)))
    values = cut_lineage(traits.filter("value is not null").select("tree_id", "node_id", "trait", F.col("value").cast("double").alias("x")))
    lengths = tree.select("tree_id", "node_id", "parent_id", F.coalesce("branch_length", F.lit(0.0)).alias("length"))
    inside = lengths.filter("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("c1"), F.max("node_id").alias("c2"))
    inside = cut_lineage(inside)
    asked = lookup_side(values.select("tree_id", "trait").distinct())
    key = ["tree_id", "trait", "node_id"]
    shape = [*key, "parent_id", "length"]
    # (x, v) of a node; ``two`` tells whether both its children have values, null where a chain ended and only one was met
    found = [*key, "parent_id", "x", "v", "two", "contrast"]
    own = values.select(*[F.col(c).alias(f"_{c}") for c in key], "x")
    leaf = F.col("c1").isNull()
    at_tip = leaf & (F.col("tree_id") == F.col("_tree_id")) & (F.col("trait") == F.col("_trait")) & (F.col("node_id") == F.col("_node_id"))
    nodes = lengths.join(inside, ["tree_id", "node_id"], "left").join(asked, "tree_id").join(own, at_tip, "left")
    # a round is one table: done rows with (x, v), chain rows with (dep, m), wide rows with both children open
    now = cut_lineage(
        nodes.select(
            *shape, "c1", "c2", "x", F.when(F.col("x").isNotNull(), F.col("length")).alias("v"), F.lit(False).alias("two"),
            F.lit(None).cast("double").alias("contrast"), F.when(leaf, "done").otherwise("wide").alias("kind"),
        )
    )
    wide_shape = [*shape, "c1", "c2"]
    new, wide, chain = now.filter("kind = 'done'").select(*found), now.filter("kind = 'wide'").select(*wide_shape), None
    known = [new]

    # the children met, the lower id first, as scalars: structs would be aggregated by sorting
    met_by = [F.count("*").alias("_n"), F.min("node_id").alias("_id")]
    met_by += [by(c, "node_id").alias(f"_{c}{i}") for i, by in ((1, F.min_by), (2, F.max_by)) for c in "xv"]
    x1, v1, x2, v2 = map(F.col, ("_x1", "_v1", "_x2", "_v2"))
    contrast = F.when(v1 + v2 > 0, x1 - x2)
    x, grown = _joined(x1, v1, x2, v2)
    full, half = F.col("_n") == 2, F.col("_n") == 1
    both = full & x1.isNotNull() & x2.isNotNull()
    other = F.when(F.col("_id") == F.col("c1"), F.col("c2")).otherwise(F.col("c1"))
    turned = [
        *wide_shape, F.when(full, x).alias("x"), F.when(full & x.isNotNull(), F.col("length") + grown).alias("v"),
        F.when(full, both).alias("two"), F.when(both, contrast).alias("contrast"),
        F.when(half, other).alias("dep"), F.when(half, _beside(x1, v1, F.col("length"))).alias("m"),
        F.when(full, "done").when(half, "chain").otherwise("wide").alias("kind"),
    ]
    reach = F.when(F.col("_m").isNull(), F.col("m")).otherwise(_after(F.col("m"), F.col("_m")))
    hopped = [*key, "parent_id", F.coalesce("_dep", "dep").alias("dep"), reach.alias("m")]
    out_x, out_v = _applied(F.col("m"), F.col("x"), F.col("v"))
    # a chain over a node without values has what its sisters give by themselves, if any has a value
    alone = F.col("x").isNull() & (F.col("m.ba") > 0)
    out_x = F.when(alone, F.col("m.ca") / F.col("m.ba")).otherwise(out_x)
    out_v = F.when(alone, F.col("m.aa") / F.col("m.ba")).otherwise(out_v)
    moved = [*key, "parent_id", out_x.alias("x"), out_v.alias("v"), "dep", "m", F.when(F.col("_told"), "done").otherwise("chain").alias("kind")]

    while not new.isEmpty():
        met = new.filter("parent_id is not null").groupBy("tree_id", "trait", F.col("parent_id").alias("node_id")).agg(*met_by)
        out = wide.join(met, key, "left").select(*turned)
        if chain is not None:
            ahead = chain.select("tree_id", "trait", F.col("node_id").alias("dep"), F.col("dep").alias("_dep"), F.col("m").alias("_m"))
            hop = chain.join(ahead, ["tree_id", "trait", "dep"], "left").select(*hopped)
            told = new.select("tree_id", "trait", F.col("node_id").alias("dep"), "x", "v", F.lit(True).alias("_told"))
            out = out.unionByName(hop.join(told, ["tree_id", "trait", "dep"], "left").select(*moved), allowMissingColumns=True)
        now = cut_lineage(out)
        new, wide = now.filter("kind = 'done'").select(*found), now.filter("kind = 'wide'").select(*wide_shape)
        chain = now.filter("kind = 'chain'").select(*key, "parent_id", "dep", "m")
        known.append(new)
    done = reduce(DataFrame.unionByName, known)
    # only where a chain ended are the children looked up again
    ended = lookup_side(done.filter("two is null").select("tree_id", "trait", F.col("node_id").alias("parent_id")))
    sisters = done.filter("x is not null").join(ended, ["tree_id", "trait", "parent_id"]).groupBy("tree_id", "trait", F.col("parent_id").alias("node_id")).agg(*met_by)
    late = sisters.filter("_n = 2").select("tree_id", "node_id", "trait", contrast.alias("contrast"), x.alias("ancestor"))
    return done.filter("two").select("tree_id", "node_id", "trait", "contrast", F.col("x").alias("ancestor")).unionByName(late)


def patristic_distance(branches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Path length between the two nodes of every asked pair (tree_id, a, b); null across components.

    A leaf stands with its parent's visit number, and the depth of the common ancestor comes from least levels between two numbers.
    """
    toured = tour(interior(branches.select("tree_id", "node_id", "parent_id", "branch_length"), "branch_length"), ["branch_length"])
    toured = toured.withColumnRenamed("branch_length", "depth")
    asked = pairs.select("tree_id", F.col("a").alias("node_id")).unionByName(pairs.select("tree_id", F.col("b").alias("node_id"))).distinct()
    nodes = branches.select("tree_id", "node_id", "parent_id", "branch_length").join(asked, ["tree_id", "node_id"], "left_semi")
    own = toured.select("tree_id", "node_id", "num", "depth", "root")
    above = toured.select("tree_id", F.col("node_id").alias("parent_id"), F.col("num").alias("_num"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
    placed = cut_lineage(
        nodes.join(own, ["tree_id", "node_id"], "left")
        .join(above, ["tree_id", "parent_id"], "left")
        .select(
            "tree_id",
            "node_id",
            F.coalesce("num", "_num").alias("num"),
            F.coalesce("depth", F.col("_depth") + F.coalesce("branch_length", F.lit(0.0)), F.lit(0.0)).alias("depth"),
            F.coalesce("root", "_root", "node_id").alias("root"),
        )
    )

    def side(name: str, number: str) -> DataFrame:
        return placed.select("tree_id", F.col("node_id").alias(name), F.col("num").alias(number), F.col("depth").alias(f"depth_{name}"), F.col("root").alias(f"root_{name}"))

    joined = cut_lineage(pairs.select("tree_id", "a", "b").join(side("a", "x"), ["tree_id", "a"]).join(side("b", "y"), ["tree_id", "b"]))
    linked = (F.col("root_a") == F.col("root_b")) & (F.col("a") != F.col("b"))
    alone = joined.filter(~linked).select("tree_id", "a", "b", F.when(F.col("a") == F.col("b"), 0.0).alias("distance"))
    met = common_ancestor(toured, joined.filter(linked).select("tree_id", "a", "b", "x", "y", "depth_a", "depth_b"), "depth")
    return met.select("tree_id", "a", "b", (F.col("depth_a") + F.col("depth_b") - 2 * F.col("depth")).alias("distance")).unionByName(alone)


def mean_patristic_distance(branches: DataFrame, tips: DataFrame) -> DataFrame:
    """Per tip: number of other tips in its component and mean path length to them.

    Linear in the tree: an edge shared by a tip and c tips is saved 2c times, so edge counts replace
    the n(n-1) pairs. Counts are sums over subtrees, savings are sums along root paths.
    """
    tree = cut_lineage(branches.select("tree_id", "node_id", "parent_id", F.coalesce("branch_length", F.lit(0.0)).alias("branch_length")))
    inner = cut_lineage(interior(tree, "branch_length"))
    # a tip counts at its parent; one whose parent is not in the tree stands alone
    leaves = cut_lineage(tree.join(tips.select("tree_id", "node_id").distinct(), ["tree_id", "node_id"], "left_semi"))
    hits = lookup_side(leaves.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("below")))
    risen = cut_lineage(climb(inner.join(hits, ["tree_id", "node_id"], "left"), ["branch_length"], "below"))
    above = risen.select("tree_id", F.col("node_id").alias("parent_id"), F.col("branch_length").alias("_depth"), F.col("root").alias("_root"))
    leaves = leaves.join(above, ["tree_id", "parent_id"], "left")
    hung = F.col("_root").isNotNull()
    leaves = cut_lineage(
        leaves.select(
            "tree_id",
            "node_id",
            F.when(hung, F.col("parent_id")).alias("parent_id"),
            F.when(hung, F.col("branch_length")).otherwise(0.0).alias("branch_length"),
            F.coalesce("_root", "node_id").alias("root"),
            F.coalesce(F.col("_depth") + F.col("branch_length"), F.lit(0.0)).alias("depth"),
        )
    )
    weighed = inner.join(risen.select("tree_id", "node_id", "below"), ["tree_id", "node_id"]).withColumn("saved", F.col("below") * F.col("branch_length"))
    saved = climb(weighed.select("tree_id", "node_id", "up", "saved"), ["saved"]).select("tree_id", F.col("node_id").alias("parent_id"), "saved")
    totals = leaves.groupBy("tree_id", "root").agg(F.count("*").alias("n"), F.sum("depth").alias("sum_depth"))
    total = F.col("n") * F.col("depth") + F.col("sum_depth") - 2 * (F.coalesce("saved", F.lit(0.0)) + F.col("branch_length"))
    return (
        leaves.join(lookup_side(saved), ["tree_id", "parent_id"], "left")
        .join(lookup_side(totals), ["tree_id", "root"])
        .select(
            "tree_id",
            "node_id",
            (F.col("n") - 1).alias("partners"),
            F.when(F.col("n") > 1, total / (F.col("n") - 1)).alias("mean_distance"),
        )
    )
