"""Declared schemas of the mart: seven star tables and the two-table synonym store."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType()}


def _schema(key: str, **columns: str) -> StructType:
    fields = [StructField(key, LongType(), False)] if key else []
    return StructType(fields + [StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


# Coordinates keep their source text beside the number: precision is judged on the text.
TABLES: dict[str, StructType] = {
    "taxa": _schema("taxon_id", taxon_name="string", taxon_level="string", msw_id="long", gbif_taxon_key="long"),
    "taxonvariants": _schema(
        "taxonvariant_id",
        taxonvariant_name="string",
        taxonvariant_level="string",
        taxonvariant_status="string",
        taxon_id="long",
    ),
    "trees": _schema("tree_id", tree_name="string"),
    "branches": _schema(
        "branch_id",
        node_id="long",
        parent_id="long",
        taxonvariant_id="long",
        label="string",
        branch_length="double",
        tree_id="long",
    ),
    "occurrences": _schema(
        "occurrence_id",
        gbif_id="long",
        occurrence_type="string",
        basis_of_record="string",
        event_date="string",
        decimal_latitude="double",
        decimal_longitude="double",
        latitude_text="string",
        longitude_text="string",
        dataset_key="string",
        has_geospatial_issues="int",
        label="string",
        taxonvariant_id="long",
    ),
    "characters": _schema("character_id", char_id="int", label="string", data_source="string"),
    "states": _schema(
        "state_id", label="string", character_id="long", character_value="string", taxonvariant_id="long"
    ),
    "longnames": _schema("tsn", completename="string"),
    "synonym_links": _schema("", tsn="long", tsn_accepted="long"),
}

# child table, foreign key, parent table, parent key
FOREIGN_KEYS = (
    ("taxonvariants", "taxon_id", "taxa", "taxon_id"),
    ("branches", "taxonvariant_id", "taxonvariants", "taxonvariant_id"),
    ("branches", "tree_id", "trees", "tree_id"),
    ("occurrences", "taxonvariant_id", "taxonvariants", "taxonvariant_id"),
    ("states", "character_id", "characters", "character_id"),
    ("states", "taxonvariant_id", "taxonvariants", "taxonvariant_id"),
)

RANGE_SCHEMA = "binomial string, legend string, rings array<array<struct<x:double,y:double>>>"
