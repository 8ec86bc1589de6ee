"""Property-graph lookups as edge-table joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_literals(edges: DataFrame) -> DataFrame:
    """(page_id, predicate, units, measurement) of traits that carry a unit."""
    return edges.filter(F.col("units").isNotNull() & F.col("predicate").isNotNull()).select(
        "page_id", "predicate", "units", "measurement"
    )


def graph_objects(edges: DataFrame) -> DataFrame:
    """Distinct (page_id, predicate, object_term) of traits that point to an object term."""
    rows = edges.filter(F.col("object_term").isNotNull() & F.col("predicate").isNotNull())
    return rows.select("page_id", "predicate", "object_term").distinct()


def trait_edges(traits: DataFrame, predicates: DataFrame, units: DataFrame, objects: DataFrame, terms: DataFrame) -> DataFrame:
    """Flatten node-and-edge tables to one row per trait.

    ``traits`` (page_id, trait_id, measurement); ``predicates`` / ``units`` / ``objects``
    (trait_id, term_id); ``terms`` (term_id, name). A trait without a predicate drops out.
    """

    def named(edges: DataFrame, name: str) -> DataFrame:
        return edges.join(terms.select("term_id", F.col("name").alias(name)), "term_id").select("trait_id", name)

    return (
        traits.join(named(predicates, "predicate"), "trait_id")
        .join(named(units, "units"), "trait_id", "left")
        .join(named(objects, "object_term"), "trait_id", "left")
        .select("trait_id", "page_id", "predicate", "units", "object_term", "measurement")
    )


def page_by_name(pages: DataFrame, names: DataFrame) -> DataFrame:
    """All pages carrying one of the given canonical names."""
    return pages.join(names.select("canonical").distinct(), "canonical", "left_semi")


def answer_rows(responses: DataFrame, col: str) -> DataFrame:
    """Rows of stored graph answers: the ``data`` array of each JSON text, one output row per entry."""
    parsed = F.from_json(F.col(col), "struct<data:array<array<string>>>")
    return responses.select(F.explode(parsed["data"]).alias("cells"))
