"""Trait builds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.operators.joins import map_local_ids
from phylomart.operators.keys import assign_keys, first_seen_ids, keep_groups_by_first_value
from phylomart.operators.names import NamesResult, resolve_names
from phylomart.runtime import cut_lineage


def build_triples_traits(
    triples: DataFrame, source: str, status: str = "extinction status", value: str = "extant"
) -> tuple[DataFrame, DataFrame]:
    """Taxon / character / state lines to (characters, states) of one source, extant taxa only."""
    kept = cut_lineage(keep_groups_by_first_value(triples, status, value))
    ids = first_seen_ids(kept)
    characters = ids.select("char_id", F.col("charname").alias("label"), F.lit(source).alias("data_source"))
    states = kept.join(ids, "charname").select(
        F.col("taxon").alias("label"), F.col("char_id").alias("character_id"), F.col("state").alias("character_value"), "line"
    )
    return characters, states


def load_traits(
    characters: DataFrame, states: DataFrame, tables: Mapping[str, DataFrame], resolve: bool = True
) -> tuple[DataFrame, DataFrame, NamesResult | None]:
    """(characters, states, names): file-local tables keyed for the mart, labels resolved to variants.

    ``states`` has label, character_id (the file's own number) and character_value.
    """
    keyed = assign_keys(characters, tables["characters"], "character_id", ["data_source", "char_id"])
    mapped = map_local_ids(states, keyed)
    names = None
    if resolve:
        names = resolve_names(
            states.select("label"), tables["taxonvariants"], tables["taxa"], tables["longnames"], tables["synonym_links"]
        )
        mapped = mapped.join(names.label_map.select("label", "taxonvariant_id"), "label", "left")
    else:
        mapped = mapped.withColumn("taxonvariant_id", F.lit(None).cast("long"))
    # equal rows are told apart by a row number, so that many of them can be split
    mapped = cut_lineage(mapped.withColumn("_row", F.monotonically_increasing_id()))
    rows = assign_keys(mapped, tables["states"], "state_id", ["label", "character_id", "character_value", "_row"], stored=True)
    return keyed, rows.select("state_id", "label", "character_id", "character_value", "taxonvariant_id"), names
