"""Trait triples of all species below named pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.operators.cleaning import binomials_only, label_with_units
from phylomart.operators.graph import graph_literals, graph_objects, page_by_name
from phylomart.operators.hierarchy import descendants
from phylomart.runtime import lookup_side


def triples_for_taxa(pages: DataFrame, parents: DataFrame, traits: DataFrame, names: DataFrame) -> DataFrame:
    """(taxon, predicate, value) of the binomial descendants of the pages with the given names.

    ``pages`` (page_id, canonical), ``parents`` (child_page, parent_page), ``traits`` as in
    :mod:`phylomart.operators.graph`, ``names`` (canonical).
    """
    roots = page_by_name(pages, names).select(F.col("page_id").alias("root"))
    below = descendants(parents, roots)
    species = binomials_only(
        below.withColumnRenamed("descendant", "page_id").join(pages.select("page_id", "canonical"), "page_id"), "canonical"
    ).select("page_id", F.col("canonical").alias("taxon"))
    species = lookup_side(species)
    traits = traits.join(species.select("page_id").distinct(), "page_id", "left_semi")
    literals = label_with_units(graph_literals(traits), name="label").select(
        "page_id", F.col("label").alias("predicate"), F.col("measurement").cast("string").alias("value")
    )
    objects = graph_objects(traits).select("page_id", "predicate", F.col("object_term").alias("value"))
    return literals.unionByName(objects).join(species, "page_id").select("taxon", "predicate", "value")
