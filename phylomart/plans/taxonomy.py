"""Taxonomy and backbone builds."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.functions.text import rank_label
from phylomart.operators.cleaning import class_names, synonym_links
from phylomart.operators.hierarchy import ranks_to_adjacency
from phylomart.runtime import cut_lineage, with_position

# The three written forms of a synonym field.
ITALIC_WORD = r"<i>([A-Za-z]+)</i>"
CAPITALISED = r"^[A-Z][a-z]+$"
LEADING_WORD = r"^([A-Z][a-z]+)"


class Taxonomy(NamedTuple):
    taxa: DataFrame
    taxonvariants: DataFrame
    branches: DataFrame


def extract_synonyms(rows: DataFrame, synonyms: str = "synonyms", level: str = "taxon_level") -> DataFrame:
    """One row per synonym: all columns plus ``epithet`` and the full ``synonym_name``.

    A trailing full stop goes. The first italic word is one synonym; else a list of capitalised
    words gives all of them; else a leading capitalised word gives one; else none. The name is the
    row's own label with the epithet of its rank replaced.
    """
    line = F.regexp_replace(F.coalesce(F.col(synonyms), F.lit("")), r"\.$", "")
    # a separator at the end begins no further item
    items = F.split(F.regexp_replace(line, "(, )+$", ""), ", ")
    words = (
        F.when(line.rlike(ITALIC_WORD), F.array(F.regexp_extract(line, ITALIC_WORD, 1)))
        .when(F.forall(items, lambda w: w.rlike(CAPITALISED)), items)
        .when(line.rlike(LEADING_WORD), F.array(F.regexp_extract(line, LEADING_WORD, 1)))
    )
    found = rows.withColumn("epithet", F.explode(words))
    rank = F.lower(level)

    def part(name: str):
        own = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        return F.when(rank == name, F.col("epithet")).otherwise(own)

    name = rank_label(F.col(level), part("genus"), part("species"), part("subspecies"), F.col("epithet"))
    return found.withColumn("synonym_name", name)


def build_taxonomy(rows: DataFrame, ranks: Sequence[str], tree_id: int, id_col: str = "id", line_col: str = "line") -> Taxonomy:
    """Rank rows to taxa, their accepted and synonym variants, and the branches of a new tree.

    Keys follow file order: the taxon and branch of the nth row get n, variants count on in line
    order with the accepted name before the synonyms.
    """
    numbered = with_position(rows, [line_col], "taxon_id")
    places = ranks_to_adjacency(numbered, ranks, id_col, line_col)
    named = cut_lineage(
        numbered.withColumnRenamed(line_col, "_line").join(
            places.select(F.col("line").alias("_line"), "label", "parent_id"), "_line"
        )
    )
    taxa = named.select(
        "taxon_id",
        F.col("label").alias("taxon_name"),
        "taxon_level",
        F.col(id_col).cast("long").alias("msw_id"),
        F.lit(None).cast("long").alias("gbif_taxon_key"),
    )
    own = named.select(
        "_line", F.lit(0).alias("_nth"), F.col("label").alias("taxonvariant_name"), F.col("taxon_level").alias("taxonvariant_level"),
        F.lit("accepted").alias("taxonvariant_status"), "taxon_id",
    )
    found = extract_synonyms(named).select(
        "_line", F.lit(1).alias("_nth"), F.col("synonym_name").alias("taxonvariant_name"), F.col("taxon_level").alias("taxonvariant_level"),
        F.lit("synonym").alias("taxonvariant_status"), "taxon_id",
    )
    keyed = with_position(own.unionByName(found), ["_line", "_nth", "taxonvariant_name"], "taxonvariant_id")
    variants = cut_lineage(
        keyed.select("taxonvariant_id", "taxonvariant_name", "taxonvariant_level", "taxonvariant_status", "taxon_id")
    )
    accepted = variants.filter("taxonvariant_status = 'accepted'").select("taxon_id", "taxonvariant_id")
    branches = named.join(accepted, "taxon_id").select(
        F.col("taxon_id").alias("branch_id"),
        F.col(id_col).cast("long").alias("node_id"),
        F.col("parent_id").cast("long").alias("parent_id"),
        "taxonvariant_id",
        "label",
        F.lit(None).cast("double").alias("branch_length"),
        F.lit(tree_id).cast("long").alias("tree_id"),
    )
    return Taxonomy(taxa, variants, branches)


def build_backbone(backbone: DataFrame, cls: str = "Mammalia") -> tuple[DataFrame, DataFrame]:
    """(longnames, synonym_links) of one class of a backbone taxonomy."""
    return class_names(backbone, cls), synonym_links(backbone, cls)
