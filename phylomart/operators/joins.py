"""Relational operators over the star tables.

Joins are plain equi-joins. The fact side (occurrences, states, branches) is always the streamed
left side, the right side has one row per key wherever the rule allows, so AQE can broadcast the
right side when it measures it small and split a skewed left partition when it is not. The right side
of a semi- or anti-join is made distinct first, for a skewed right side cannot be split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.runtime import lookup_side, null_safe
from phylomart.schemas import FOREIGN_KEYS

Tables = Mapping[str, DataFrame]


def taxon_nodes(names: DataFrame, tables: Tables, tree_id: int, first_only: bool = False) -> DataFrame:
    """Nodes of one tree that stand for the given taxon names; unmatched names drop out."""
    taxa = tables["taxa"].join(names.select("taxon_name").distinct(), "taxon_name", "left_semi")
    nodes = (
        tables["branches"]
        .filter(F.col("tree_id") == tree_id)
        .join(tables["taxonvariants"].select("taxonvariant_id", "taxon_id"), "taxonvariant_id")
        .join(taxa.select("taxon_id", "taxon_name", "taxon_level"), "taxon_id")
        .select("taxon_name", "taxon_level", "taxon_id", "taxonvariant_id", "node_id", "parent_id", "branch_length")
    )
    if not first_only:
        return nodes
    best = F.min(F.struct("node_id", "taxon_level", "taxon_id", "taxonvariant_id", "parent_id", "branch_length"))
    return nodes.groupBy("taxon_name").agg(best.alias("n")).select("taxon_name", "n.*")


def taxa_with_occurrences_in_tree(tables: Tables, tree_id: int, level: str = "SPECIES") -> DataFrame:
    """Distinct (taxon, latitude, longitude) of taxa whose same variant occurs and sits in the tree."""
    in_tree = tables["branches"].filter(F.col("tree_id") == tree_id).select("taxonvariant_id").distinct()
    taxa = tables["taxa"].filter(F.col("taxon_level") == level).select("taxon_id", "taxon_name")
    variants = (
        tables["taxonvariants"]
        .select("taxonvariant_id", "taxon_id")
        .join(in_tree, "taxonvariant_id", "left_semi")
        .join(taxa, "taxon_id")
        .select("taxonvariant_id", "taxon_name")
    )
    return (
        tables["occurrences"]
        .select("taxonvariant_id", "decimal_latitude", "decimal_longitude")
        .join(variants, "taxonvariant_id")
        .select("taxon_name", "decimal_latitude", "decimal_longitude")
        .distinct()
        .orderBy("taxon_name", "decimal_latitude", "decimal_longitude")
    )


def trait_lookup(tables: Tables, source: str) -> DataFrame:
    """Every trait value of one data source under its accepted taxon name."""
    characters = (
        tables["characters"]
        .filter(F.col("data_source") == source)
        .select("character_id", "char_id", F.col("label").alias("character_label"))
    )
    variants = tables["taxonvariants"].select("taxonvariant_id", "taxon_id")
    return (
        tables["states"]
        .select("state_id", "character_id", "character_value", "taxonvariant_id")
        .join(characters, "character_id")
        .join(variants, "taxonvariant_id")
        .join(tables["taxa"].select("taxon_id", "taxon_name"), "taxon_id")
        .select("taxon_name", "char_id", "character_label", "state_id", "character_value")
    )


def taxon_fanout(taxa: DataFrame, tables: Tables, target: str) -> DataFrame:
    """Rows of ``target`` attached to any variant of the given taxa, with the taxon they belong to."""
    variants = (
        tables["taxonvariants"]
        .select("taxonvariant_id", "taxon_id", "taxonvariant_name", "taxonvariant_status")
        .join(taxa.select("taxon_id", "taxon_name").distinct(), "taxon_id")
    )
    return tables[target].join(variants, "taxonvariant_id")


def with_parent(child: DataFrame, parent: DataFrame, fk: str, parent_key: str | None = None) -> DataFrame:
    """Child rows with their parent row where there is one; shared column names get ``parent_``."""
    key = parent_key or fk
    renamed = parent.select(
        *[F.col(c).alias(f"parent_{c}" if c in child.columns and c != key else c) for c in parent.columns]
    ).withColumnRenamed(key, "_pk")
    return child.join(renamed, F.col(fk) == F.col("_pk"), "left").drop("_pk")


def map_local_ids(states: DataFrame, characters: DataFrame) -> DataFrame:
    """Replace a file's own character number with the mart's character_id."""
    keys = characters.select(
        F.col("char_id").alias("_local"), F.col("data_source").alias("_source"), F.col("character_id").alias("_global")
    )
    on = F.col("character_id") == F.col("_local")
    if "data_source" in states.columns:
        on = on & (F.col("data_source") == F.col("_source"))
    kept = [c for c in states.columns if c != "character_id"]
    return states.join(keys, on, "left").select(*kept, F.col("_global").alias("character_id"))


def setdiff_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key is absent from ``b``."""
    return a.join(lookup_side(b.select(key).distinct()), key, "left_anti")


def taxa_in_all(tables: Tables, datasets: Sequence[str]) -> DataFrame:
    """Taxa having rows, through any of their variants, in every listed data set."""
    variants = tables["taxonvariants"].select("taxonvariant_id", "taxon_id")
    found = tables["taxa"]
    for name in datasets:
        # distinct before the shuffle: a hot variant is one row per task, not a hot right side
        present = tables[name].select("taxonvariant_id").distinct()
        used = variants.join(present, "taxonvariant_id", "left_semi").select("taxon_id").distinct()
        found = found.join(used, "taxon_id", "left_semi")
    return found


def orphan_audit(tables: Tables) -> DataFrame:
    """Rows whose foreign key names no parent: (child, fk, key value, number of rows)."""
    reports = []
    for child, fk, parent, key in FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        # counting first shrinks a hot orphan key to one row before it meets the parents
        used = tables[child].filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("fk_value")).agg(
            F.count("*").alias("n_rows")
        )
        parents = tables[parent].select(F.col(key).alias("fk_value"))
        orphans = used.join(parents, "fk_value", "left_anti")
        reports.append(orphans.select(F.lit(child).alias("child"), F.lit(fk).alias("fk"), "fk_value", "n_rows"))
    return reduce(DataFrame.unionByName, reports)


def insert_if_absent(new: DataFrame, existing: DataFrame) -> DataFrame:
    """The distinct new rows that equal no stored row, comparing all given columns with nulls equal."""
    fresh = new.dropDuplicates().alias("fresh")
    stored = existing.select(*new.columns).alias("stored")
    return fresh.join(stored, null_safe("fresh", "stored", new.columns), "left_anti")


def backfill_fk(occ: DataFrame, label_map: DataFrame) -> DataFrame:
    """Set taxonvariant_id on every row whose label is in ``label_map`` (label, taxonvariant_id)."""
    mapped = label_map.select("label", F.col("taxonvariant_id").alias("_new"))
    joined = occ.join(lookup_side(mapped), "label", "left")
    kept = [c for c in occ.columns if c != "taxonvariant_id"]
    old = F.col("taxonvariant_id") if "taxonvariant_id" in occ.columns else F.lit(None).cast("long")
    return joined.select(*kept, F.coalesce("_new", old).alias("taxonvariant_id"))
