"""Newick text to branch rows and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.operators.hierarchy import interior_paths, node_paths, root_to_tip
from phylomart.runtime import cut_lineage, lookup_side, ordinal_within

_TOKEN = re.compile(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^()\[\],:;'\s][^()\[\],:;']*")

# Fixed value: a NEXUS tree statement, name and Newick text.
NEXUS_TREE_PATTERN = r"(?i)^\s*u?tree\s+\*?\s*('[^']*'|[^=\s]+)\s*=\s*(.*)$"


def _nodes(text: str) -> tuple[list, list, list]:
    """Parent places, labels and lengths of one tree's nodes in depth-first pre-order."""
    parents: list[int | None] = []
    labels: list[str] = []
    lengths: list[float | None] = []
    inside: list[int] = []
    here, last = None, "("

    def add() -> int:
        parents.append(inside[-1] if inside else None)
        labels.append("")
        lengths.append(None)
        return len(parents) - 1

    for found in _TOKEN.finditer(text):
        token = found[0]
        if token[0] == "[":
            continue
        if token == ";":
            break
        if token == "(":
            inside.append(add())
        elif token in ",)":
            if last in "(,":
                add()  # a leaf without a name
            if token == ")":
                here = inside.pop()
        elif token == ":":
            if last in "(,":
                here = add()
        elif last == ":":
            lengths[here] = float(token)
        else:
            name = token[1:-1].replace("''", "'") if token[0] == "'" else token.strip()
            if last in "(,":
                here = add()
            labels[here] = name.replace("_", " ")
        last = token if token in "(),:" else "name"
    if inside:
        raise ValueError("brackets are not balanced")
    return parents, labels, lengths


def _parsed(df: DataFrame, text_col: str, name_col: str) -> DataFrame:
    """Node rows of all texts, and one row with ``error`` for each text that is not a tree."""

    def explode_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in PARSED]
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                try:
                    parents, labels, lengths = _nodes(text)
                    if parents.count(None) > 1:
                        raise ValueError("more than one root")
                    n, error = len(parents), None
                except (ValueError, IndexError, TypeError) as wrong:
                    n, error = 1, f"{type(wrong).__name__}: {wrong}"
                    parents, labels, lengths = [None], [None], [None]
                columns = ([name] * n, range(1, n + 1), [None if p is None else p + 1 for p in parents], lengths, labels, [error] * n)
                for known, more in zip(rows, columns):
                    known.extend(more)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, PARSED.values())], list(PARSED))

    schema = "tree_name string, node_id long, parent_id long, branch_length double, label string, error string"
    texts = df.filter(F.col(text_col).isNotNull())
    return texts.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text")).mapInArrow(explode_trees, schema)


PARSED = {
    "tree_name": pa.string(), "node_id": pa.int64(), "parent_id": pa.int64(), "branch_length": pa.float64(), "label": pa.string(), "error": pa.string()
}


def parse_newick(df: DataFrame, text_col: str = "newick", name_col: str = "tree_name") -> DataFrame:
    """One row per node of every tree text: tree_name, node_id, parent_id, branch_length, label.

    Node ids count from 1 in depth-first pre-order within the tree. Trees parse in parallel, one
    text per row. Texts that are not trees give no row; :func:`newick_rejects` has them.
    """
    return _parsed(df, text_col, name_col).filter("error is null").drop("error")


def newick_rejects(df: DataFrame, text_col: str = "newick", name_col: str = "tree_name") -> DataFrame:
    """(tree_name, error) of the texts that are not trees: unbalanced brackets, bad lengths, several roots."""
    return _parsed(df, text_col, name_col).filter("error is not null").select("tree_name", "error")


def nexus_trees(lines: DataFrame, col: str = "value") -> DataFrame:
    """(tree_name, newick) of the tree statements among the lines of NEXUS text."""
    hit = lines.filter(F.col(col).rlike(NEXUS_TREE_PATTERN))
    name = F.trim(F.regexp_extract(col, NEXUS_TREE_PATTERN, 1), F.lit("'"))
    return hit.select(name.alias("tree_name"), F.regexp_extract(col, NEXUS_TREE_PATTERN, 2).alias("newick"))


def newick_fragments(branches: DataFrame) -> DataFrame:
    """(tree_id, root_id, ordinal, fragment): each root's Newick text in pieces, to be joined in order.

    An interior node opens with one piece and closes with another, a leaf is one. A piece's place is its
    node's path from the root, a closing one after all paths below it. So a tree of any size is written by one
    distributed numbering, and no text or list of children is gathered.
    """
    tree = branches.select("tree_id", "node_id", "parent_id", "branch_length", "label")
    paths = cut_lineage(interior_paths(tree))
    inner = paths.select("tree_id", "node_id", F.lit(True).alias("_inner"))
    first = tree.filter("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.min("node_id").alias("node_id"))
    first = lookup_side(first.select("tree_id", "node_id", F.lit(True).alias("_first")))
    placed = node_paths(tree, paths).join(inner, ["tree_id", "node_id"], "left").join(first, ["tree_id", "node_id"], "left")
    comma = F.when((F.size("path") == 1) | F.col("_first").isNotNull(), "").otherwise(",")
    own = _own_text(F.when(F.size("path") > 1, F.col("branch_length")))
    # node ids are positive, so a closing key sorts behind every path that continues
    whole = F.struct(F.col("path").alias("key"), F.concat(comma, own).alias("fragment"))
    ends = F.struct(F.concat("path", F.array(F.lit((1 << 63) - 1))).alias("key"), F.concat(F.lit(")"), own).alias("fragment"))
    opens = F.struct(F.col("path").alias("key"), F.concat(comma, F.lit("(")).alias("fragment"))
    root = F.element_at("path", 1).alias("root_id")
    pieces = F.when(F.col("_inner"), F.array(opens, ends)).otherwise(F.array(whole))
    rows = placed.select("tree_id", root, F.explode(pieces).alias("p"), (F.size("path") == 1).alias("_top"), F.col("_inner").alias("_in"))
    closing = F.col("_top") & F.col("p.fragment").startswith(")")
    text = F.when(closing | (F.col("_top") & F.col("_in").isNull()), F.concat("p.fragment", F.lit(";"))).otherwise(F.col("p.fragment"))
    return ordinal_within(rows.select("tree_id", "root_id", F.col("p.key").alias("_key"), text.alias("fragment")), ["tree_id", "root_id"], ["_key"], "ordinal").drop("_key")


def _own_text(length: Column) -> Column:
    label = F.coalesce("label", F.lit(""))
    quoted = F.concat(F.lit("'"), F.replace(label, F.lit("'"), F.lit("''")), F.lit("'"))
    safe = F.when(label.rlike(r"[()\[\],:;']"), quoted).otherwise(label)
    return F.concat(F.translate(safe, " ", "_"), F.coalesce(F.concat(F.lit(":"), length.cast("string")), F.lit("")))


def write_newick(branches: DataFrame, cut_every: int = 8) -> DataFrame:
    """(tree_id, root_id, newick) per root, children in node_id order, spaces in names as ``_``.

    Texts grow from the deepest level up. A tree's text is one cell, so a single tree is limited to
    what a cell holds; many trees build side by side. :func:`newick_fragments` has no such limit.
    """
    nodes = cut_lineage(root_to_tip(branches))
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None:
        return nodes.select("tree_id", F.col("node_id").alias("root_id"), F.lit("").alias("newick"))
    nodes = nodes.select("tree_id", "node_id", "parent_id", "level", _own_text(F.col("branch_length")).alias("own"))
    texts = nodes.filter(F.col("level") == deepest).select("tree_id", "node_id", "parent_id", F.col("own").alias("text"))
    for level in range(deepest - 1, -1, -1):
        inner = texts.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda c: c["text"]), ","
            ).alias("inner")
        )
        texts = (
            nodes.filter(F.col("level") == level)
            .join(inner, ["tree_id", "node_id"], "left")
            .select(
                "tree_id",
                "node_id",
                "parent_id",
                F.concat(F.coalesce(F.concat(F.lit("("), "inner", F.lit(")")), F.lit("")), "own").alias("text"),
            )
        )
        if (deepest - level) % cut_every == 0:
            texts = cut_lineage(texts)
    return texts.select("tree_id", F.col("node_id").alias("root_id"), F.concat("text", F.lit(";")).alias("newick"))
