"""The integrated data set: taxa with metadata, two character matrices and a subtree."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.operators.hierarchy import collapse_unary, expand_taxon, induced_subtree
from phylomart.operators.traits import DEFAULT_KINDS, accepted_branch, character_matrix, filter_characters
from phylomart.runtime import cut_lineage


class Dataset(NamedTuple):
    taxa: DataFrame
    continuous: DataFrame
    discrete: DataFrame
    branches: DataFrame


def build_dataset(
    tables: Mapping[str, DataFrame],
    roots: DataFrame,
    taxonomy: int,
    phylogeny: int,
    source: str,
    kinds: Mapping[str, str] = DEFAULT_KINDS,
    ambiguous: str = "error",
) -> Dataset:
    """Species below the start nodes with their traits and the tree that joins them.

    A taxon without a node in the phylogeny keeps a null node and takes no part in the subtree.
    """
    branches, variants = tables["branches"], tables["taxonvariants"]
    tips = cut_lineage(
        expand_taxon(branches, variants, tables["taxa"], roots, "SPECIES", taxonomy, include_start=False)
    )
    tip_variants = tips.select("taxon_id", "taxonvariant_id", "taxon_name").join(
        variants.select("taxonvariant_id", F.col("taxonvariant_name").alias("msw_taxonvariant_label"),
                        F.col("taxonvariant_level").alias("msw_taxonvariant_level")),
        "taxonvariant_id",
    )
    nodes = accepted_branch(branches, variants.join(tips.select("taxon_id"), "taxon_id", "left_semi"), phylogeny, ambiguous)
    nodes = cut_lineage(nodes.select("taxon_id", "node_id", "branch_id"))
    taxa = (
        tip_variants.withColumnRenamed("taxonvariant_id", "msw_taxonvariant_id")
        .join(tables["taxa"].select("taxon_id", "taxon_level", "msw_id"), "taxon_id")
        .join(nodes, "taxon_id", "left")
        .select("taxon_id", "taxon_name", "taxon_level", "msw_id", "msw_taxonvariant_id", "msw_taxonvariant_label",
                "msw_taxonvariant_level", "node_id", "branch_id")
    )
    owned = variants.select("taxonvariant_id", "taxon_id").join(
        tips.select("taxon_id", "taxon_name").distinct(), "taxon_id"
    )
    states = cut_lineage(
        filter_characters(tables["states"], tables["characters"], source, kinds)
        .join(owned, "taxonvariant_id")
        .select("taxon_name", "character_label", "character_value", "state_id")
    )
    continuous, discrete = character_matrix(states, kinds)
    tree = branches.filter(F.col("tree_id") == phylogeny)
    leaves = nodes.select(F.lit(phylogeny).cast("long").alias("tree_id"), "node_id")
    return Dataset(taxa, continuous, discrete, collapse_unary(induced_subtree(tree, leaves)))
