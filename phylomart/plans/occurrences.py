"""Occurrence builds: raw records to the mart, and the per-species extraction."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.functions.text import number
from phylomart.operators.cleaning import (
    DEFAULT_BASIS,
    bool_word_to_int,
    exclude_regex,
    filter_basis,
    filter_dates,
    filter_precision,
    require_fields,
    require_zero,
)
from phylomart.operators.hierarchy import expand_taxon, with_subspecies
from phylomart.operators.joins import backfill_fk, insert_if_absent
from phylomart.operators.keys import assign_keys
from phylomart.operators.names import lookup_name, lookup_rejects, resolve_backbone
from phylomart.operators.occurrences import (
    distinct_coordinates,
    filter_by_range,
    filter_outliers,
    min_records_gate,
    sample_n,
)
from phylomart.runtime import cut_lineage

STORED_COLUMNS = (
    "gbif_id",
    "occurrence_type",
    "basis_of_record",
    "event_date",
    "decimal_latitude",
    "decimal_longitude",
    "latitude_text",
    "longitude_text",
    "dataset_key",
    "has_geospatial_issues",
    "label",
)


# What the extraction reads of an occurrence.
EXTRACTED_COLUMNS = (
    "taxon_name",
    "occurrence_id",
    "gbif_id",
    "basis_of_record",
    "event_date",
    "decimal_latitude",
    "decimal_longitude",
    "latitude_text",
    "longitude_text",
)


class OccurrenceBuild(NamedTuple):
    occurrences: DataFrame  # rows to append
    variants: DataFrame  # new variants
    taxa: DataFrame  # new version
    rejected: DataFrame  # labels the backbone does not know
    rejected_records: DataFrame  # raw records whose key has no name


def clean_occurrences(raw: DataFrame) -> DataFrame:
    """Text records to stored columns: required fields, no geospatial issue, known basis of record.

    All narrow, so the filters run with the scan. Coordinates keep their text beside the number.
    """
    rows = require_fields(raw, ["decimal_longitude", "decimal_latitude", "event_date"])
    rows = exclude_regex(require_zero(rows, "has_geospatial_issues"), "basis_of_record", "UNKNOWN")
    return rows.select(
        F.col("gbif_id").cast("long").alias("gbif_id"),
        "occurrence_type",
        "basis_of_record",
        "event_date",
        number(F.col("decimal_latitude")).alias("decimal_latitude"),
        number(F.col("decimal_longitude")).alias("decimal_longitude"),
        F.col("decimal_latitude").alias("latitude_text"),
        F.col("decimal_longitude").alias("longitude_text"),
        "dataset_key",
        F.col("has_geospatial_issues").cast("int").alias("has_geospatial_issues"),
        "label",
    )


def build_occurrences(raw: DataFrame, tables: Mapping[str, DataFrame], named: bool = True) -> OccurrenceBuild:
    """Raw records to new occurrence rows, keyed and attached to variants through the backbone.

    With ``named`` the label column is already there; otherwise it is looked up by ``taxon_key``, and records
    whose key has no name are reported, not stored.
    """
    rows = bool_word_to_int(raw, "has_geospatial_issues")
    unknown = rows.limit(0)
    if not named:
        unknown = lookup_rejects(rows, tables["longnames"])
        rows = lookup_name(rows, tables["longnames"]).filter("label is not null")
    fresh = insert_if_absent(clean_occurrences(rows).select(*STORED_COLUMNS), tables["occurrences"])
    # numbering starts from a written table and ends in one
    keyed = assign_keys(fresh, tables["occurrences"], "occurrence_id", ["gbif_id", *STORED_COLUMNS[1:]])
    backbone = resolve_backbone(
        keyed.select("label"), tables["longnames"], tables["synonym_links"], tables["taxonvariants"], tables["taxa"]
    )
    return OccurrenceBuild(
        backfill_fk(keyed, backbone.label_map), backbone.variants, backbone.taxa, backbone.rejected, unknown
    )


def species_occurrences(species: DataFrame, tables: Mapping[str, DataFrame], tree_id: int, subspecies: bool = True) -> tuple[DataFrame, DataFrame]:
    """(occurrences, names): the records of each species and the names it goes by.

    Variants are made distinct per species before they meet the records, so a record comes once.
    """
    variants = tables["taxonvariants"]
    wanted = species.select("taxon_id", "taxon_name").distinct()
    if subspecies:
        own = with_subspecies(wanted, tables["branches"], variants, tree_id, "taxon_name")
    else:
        own = variants.select("taxon_id", "taxonvariant_id", "taxonvariant_name").join(wanted, "taxon_id")
    # small beside the records, and used for counting, sampling and range names
    owned = cut_lineage(own.select("taxon_name", "taxonvariant_id", "taxonvariant_name"))
    records = tables["occurrences"].join(owned.select("taxon_name", "taxonvariant_id"), "taxonvariant_id")
    return records, owned.select("taxon_name", F.col("taxonvariant_name").alias("name"))


def extract_occurrences(
    tables: Mapping[str, DataFrame],
    roots: DataFrame,
    ranges: DataFrame | None = None,
    tree_id: int = 11,
    subspecies: bool = True,
    sample: int | None = 1000,
    seed: int = 0,
    basis: Sequence[str] = DEFAULT_BASIS,
    mindate: str | None = None,
    maxdate: str | None = None,
    precision: int | None = 2,
    min_records: int = 10,
    min_in_range: int = 10,
    thresh: float = math.inf,
    finished: DataFrame | None = None,
) -> DataFrame:
    """Filtered records of every species below the start labels: one plan for all species.

    ``roots`` has ``label``. Order of the rules: sample, basis, dates, precision, distinct places,
    gate, ranges, gate, outliers, gate. Species in ``finished`` (species, as files
    name them, see :func:`phylomart.sources.tabular.written_species`) are left out before any record is read.
    """
    starts = (
        tables["branches"].filter(F.col("tree_id") == tree_id).join(roots.select("label").distinct(), "label", "left_semi")
    )
    species = expand_taxon(tables["branches"], tables["taxonvariants"], tables["taxa"], starts.select("node_id"), "SPECIES", tree_id)
    species = species.select("taxon_id", "taxon_name").distinct()
    if finished is not None:
        done = finished.select(F.col("species").alias("_done")).distinct()
        species = species.join(done, F.translate("taxon_name", " ", "_") == F.col("_done"), "left_anti")
    species = cut_lineage(species)
    records, names = species_occurrences(species, tables, tree_id, subspecies)
    records = records.select(*EXTRACTED_COLUMNS)
    # after sampling no species is large, and gates need not evaluate the records twice
    bounded = bool(sample)
    if sample:
        # counted and sampled from one table, so the joins that make the records run once
        records = sample_n(cut_lineage(records), "taxon_name", sample, seed)
    records = filter_basis(records, basis)
    records = filter_dates(records, mindate, maxdate)
    records = filter_precision(records, precision)
    records = distinct_coordinates(records, "taxon_name")
    if not bounded:
        records = cut_lineage(records)
    # every later rule reads the records more than once
    records = cut_lineage(min_records_gate(records, "taxon_name", min_records, bounded))
    if ranges is not None:
        records = filter_by_range(records, ranges, names, min_in_range, stored=True)
        records = min_records_gate(records, "taxon_name", min_records, bounded)
    if not math.isinf(thresh):
        records = min_records_gate(filter_outliers(cut_lineage(records), "taxon_name", thresh), "taxon_name", min_records, bounded)
    return records
