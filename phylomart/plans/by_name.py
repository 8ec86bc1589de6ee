"""Taxonomy and tree calls by taxon name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.operators.hierarchy import expand_taxon, induced_subtree
from phylomart.operators.joins import taxon_nodes


def expand_by_name(names: DataFrame, tables: Mapping[str, DataFrame], level: str = "SPECIES", tree_id: int = 11) -> DataFrame:
    """Taxa of rank ``level`` below the taxa named in ``names`` (taxon_name): (taxon_name, node_id, expanded_name).

    Each name starts from its first node in the tree; unknown names drop out.
    """
    starts = taxon_nodes(names, tables, tree_id, first_only=True).select("taxon_name", F.col("node_id").alias("root_id"))
    found = expand_taxon(tables["branches"], tables["taxonvariants"], tables["taxa"], starts.select(F.col("root_id").alias("node_id")), level, tree_id)
    below = found.select("root_id", "node_id", F.col("taxon_name").alias("expanded_name"))
    return starts.join(below, "root_id").select("taxon_name", "node_id", "expanded_name")


def make_phylo(names: DataFrame, tables: Mapping[str, DataFrame], tree_id: int) -> DataFrame:
    """The subtree of ``tree_id`` that joins the named taxa (taxon_name): first node of each name, unknown names dropped."""
    tips = taxon_nodes(names, tables, tree_id, first_only=True).select(F.lit(tree_id).cast("long").alias("tree_id"), "node_id")
    return induced_subtree(tables["branches"].filter(F.col("tree_id") == tree_id), tips)
