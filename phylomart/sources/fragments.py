"""Branch rows from Newick texts given as numbered pieces, so that a tree's text may be of any size.

No text, path or list of children is gathered. Tokens are numbered by running sums over range partitions; a node's level is the
number of brackets open before it. Sorted by (tree, level, place), the opening bracket of a node comes first, then its
children and its closing bracket, until the next node of that level opens: so one running count of opening brackets in this order
gives children and closing brackets the number of the node they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.runtime import cut_lineage, lookup_side, running_sums

# A comment, a quoted label, a sign, or a bare label or number.
TOKEN = r"\[[^\]]*\]|'[^']*(?:''[^']*)*'|[(),:;]|[^()\[\],:;'\s][^()\[\],:;']*"


def _tokens(df: DataFrame, text_col: str, name_col: str, order_col: str) -> DataFrame:
    """(tree_name, ordinal, pos, sign, token, s, depth): s counts the signs ( ) , and ; up to the token, over all trees, depth the open brackets."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(0))
    rows = df.select(F.col(name_col).cast("string").alias("tree_name"), F.col(order_col).cast("long").alias("ordinal"), F.posexplode(found).alias("pos", "token"))
    rows = rows.filter(F.col("tree_name").isNotNull() & F.col("ordinal").isNotNull() & ~F.col("token").startswith("["))
    sign = F.when(F.col("token").isin("(", ")", ",", ";"), F.col("token"))
    rows = rows.select("tree_name", "ordinal", "pos", "token", sign.alias("sign"), sign.isNotNull().cast("long").alias("s"), _step(sign).alias("depth"))
    return running_sums(rows, ["tree_name", "ordinal", "pos"], ["s", "depth"])


def _step(sign: Column) -> Column:
    return F.when(sign == "(", 1).when(sign == ")", -1).otherwise(0).cast("long")


def _units(tokens: DataFrame) -> DataFrame:
    """One stored row per sign with the label and length after it; text before a tree's first sign has a row with a null sign.

    level is the number of brackets open after the sign; n numbers the tree's nodes: a unit with ``opens`` starts an interior node, one
    with ``leaf`` holds a leaf, which comes second.
    """
    place = F.struct("ordinal", "pos")
    word = F.col("sign").isNull()
    fields = ["s", "sign", "depth", "place", "token", "next"]
    none = F.lit(None)

    def entry(*values: Column) -> Column:
        return F.struct(*[v.alias(f) for v, f in zip(values, fields)])

    gap, blank = none.cast("struct<ordinal:bigint,pos:int>"), none.cast("string")
    mark = entry(F.col("s"), F.col("sign"), F.col("depth"), gap, blank, blank)
    told = entry(F.col("s") - 1, blank, none.cast("long"), gap, blank, F.col("sign"))
    spoken = entry(F.col("s"), blank, F.col("depth"), place, F.col("token"), blank)
    rows = tokens.select("tree_name", F.explode(F.when(word, F.array(spoken)).otherwise(F.array(mark, told))).alias("e")).select("tree_name", "e.*")
    said = F.when(F.col("token") != ":", F.struct("place", "token"))
    units = rows.groupBy("tree_name", "s").agg(
        F.max("sign").alias("sign"),
        F.max("depth").alias("depth"),
        F.max("next").alias("next"),
        F.min(F.when(F.col("token") == ":", F.col("place"))).alias("colon"),
        F.min(said).alias("first"),
        F.max(said).alias("last"),
    )
    payload = F.col("first").isNotNull() | F.col("colon").isNotNull()
    label = F.when(F.col("colon").isNull() | (F.col("first.place") < F.col("colon")), F.col("first.token"))
    length = F.when(F.col("last.place") > F.col("colon"), F.trim("last.token"))
    opens = F.coalesce(F.col("sign") == "(", F.lit(False))
    holds = F.col("sign").isNull() | F.col("sign").isin("(", ",")
    leaf = holds & (payload | F.coalesce(F.col("next").isin(",", ")"), F.lit(False)))
    units = units.select(
        "tree_name", "s", "sign", "depth", payload.alias("payload"), opens.alias("opens"), leaf.alias("leaf"),
        _plain(F.coalesce(label, F.lit(""))).alias("label"), length.try_cast("double").alias("branch_length"),
        (length.isNotNull() & length.try_cast("double").isNull()).alias("bad"),
        (opens.cast("long") + leaf.cast("long")).alias("n"),
    )
    counted = cut_lineage(running_sums(units, ["tree_name", "s"], ["n"]))
    # what was counted in the trees before
    own = F.col("opens").cast("long") + F.col("leaf").cast("long")
    opened = F.min(F.when(F.col("sign").isNotNull(), F.struct("s", (F.col("depth") - _step(F.col("sign"))).alias("depth"))))
    starts = counted.groupBy("tree_name").agg(opened["depth"].alias("_depth"), F.min(F.col("n") - own).alias("_n"))
    level = F.when(F.col("sign").isNull(), F.lit(0)).otherwise(F.col("depth") - F.col("_depth"))
    joined = counted.join(lookup_side(starts), "tree_name")
    return cut_lineage(joined.select("tree_name", "s", "sign", "payload", "opens", "leaf", "label", "branch_length", "bad", level.alias("level"), (F.col("n") - F.col("_n")).alias("n")))


def _plain(token: Column) -> Column:
    quoted = F.replace(token.substr(F.lit(2), F.length(token) - 2), F.lit("''"), F.lit("'"))
    return F.translate(F.when(token.startswith("'"), quoted).otherwise(F.trim(token)), "_", " ")


def _errors(units: DataFrame) -> DataFrame:
    """(tree_name, error) of the texts that are not trees."""
    signs = F.col("sign").isNotNull()
    end = F.col("sign") == ";"
    roots = (F.col("opens") & (F.col("level") == 1)).cast("int") + (F.col("leaf") & (F.col("level") == 0)).cast("int")
    found = units.groupBy("tree_name").agg(
        F.min("level").alias("low"),
        F.max(F.when(signs, F.struct("s", "level"))).alias("last"),
        F.min(F.when(end, F.col("s"))).alias("end"),
        F.max(F.when(end, F.col("payload"))).alias("more"),
        F.sum(roots).alias("roots"),
        F.max("bad").alias("bad"),
    )
    wrong = (
        F.when((F.col("low") < 0) | (F.col("last.level") != 0), "brackets are not balanced")
        .when((F.col("last.s") > F.col("end")) | F.col("more"), "text after the end")
        .when(F.col("roots") > 1, "more than one root")
        .when(F.col("bad"), "a length is not a number")
    )
    return found.select("tree_name", wrong.alias("error")).filter("error is not null")


def fragment_rejects(df: DataFrame, text_col: str = "fragment", name_col: str = "tree_name", order_col: str = "ordinal") -> DataFrame:
    """(tree_name, error) of the trees that :func:`parse_fragments` leaves out."""
    return _errors(_units(_tokens(df, text_col, name_col, order_col)))


def parse_fragments(df: DataFrame, text_col: str = "fragment", name_col: str = "tree_name", order_col: str = "ordinal") -> DataFrame:
    """One row per node of every tree: tree_name, node_id, parent_id, branch_length, label, as ``parse_newick`` gives.

    A tree's text is its pieces in the order of ``order_col``, a number that is unique in the tree. Pieces may end
    anywhere but inside a label, number or comment; rows without name, number or text are left out. Node ids count from 1 in
    depth-first pre-order. Trees with unbalanced brackets, several roots, bad lengths or text after the end give no row;
    :func:`fragment_rejects` has them.
    """
    units = _units(_tokens(df, text_col, name_col, order_col))
    units = units.join(lookup_side(_errors(units)).select("tree_name"), "tree_name", "left_anti")
    node = {"opens": F.col("n") - F.col("leaf").cast("long"), "leaf": F.col("n")}

    def event(level: Column, kind: int, role: str, node_id: Column) -> Column:
        return F.struct(level.cast("long").alias("level"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), node_id.alias("node_id"))

    none, level = F.lit(None).cast("long"), F.col("level")
    events = F.array_compact(
        F.array(
            F.when(F.col("opens"), event(level - 1, 0, "open", node["opens"])),
            F.when(F.col("sign") == ")", event(level, 0, "close", none)),
            F.when(F.col("opens") & (level > 1), event(level - 2, 1, "inner", node["opens"])),
            F.when(F.col("leaf") & (level > 0), event(level - 1, 1, "leaf", node["leaf"])),
        )
    )
    rows = units.select("tree_name", "s", "label", "branch_length", F.explode(events).alias("e")).select("tree_name", "s", "label", "branch_length", "e.*")
    rows = rows.withColumn("g", (F.col("role") == "open").cast("long"))
    owned = cut_lineage(running_sums(rows, ["tree_name", "level", "s", "kind"], ["g"]))

    ends = owned.filter("role = 'close'").select("g", "label", "branch_length")
    inner = lookup_side(owned.filter("role = 'open'").select("g", "tree_name", "node_id").join(ends, "g"))
    parents = inner.select("g", F.col("node_id").alias("parent_id"))
    shape = "tree_name", "node_id", "parent_id", "branch_length", "label"
    leaves = owned.filter("role = 'leaf'").join(parents, "g").select(*shape)
    below = owned.filter("role = 'inner'").select("tree_name", "node_id", "g").join(parents, "g").drop("g")
    nodes = inner.join(below, ["tree_name", "node_id"], "left").select(*shape)
    alone = units.filter("leaf and level = 0").select("tree_name", F.col("n").alias("node_id"), none.alias("parent_id"), "branch_length", "label")
    return nodes.unionByName(leaves).unionByName(alone)
