"""Keys and numbering for new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.runtime import lookup_side, ordinal_within, with_position


def assign_keys(new: DataFrame, existing: DataFrame, key: str, order_by: Sequence[str], stored: bool = False) -> DataFrame:
    """Give ``new`` rows the keys after the highest stored one, in ``order_by`` order.

    ``stored``: ``new`` is a plain read of a table, see :func:`with_position`.
    """
    top = existing.agg(F.max(key)).first()[0] or 0
    kept = [c for c in new.columns if c != key]
    return with_position(new, order_by, "_pos", stored).select((F.col("_pos") + int(top)).cast("long").alias(key), *kept)


def collect_values(
    triples: DataFrame, taxon: str = "taxon", char: str = "charname", line: str = "line"
) -> DataFrame:
    """Values of each taxon and character in file order, as a 1-based ``position`` per value.

    Positions instead of list cells: a pair that holds a third of all lines stays distributed.
    """
    return ordinal_within(triples, [taxon, char], [line], "position", stored=True)


def keep_groups_by_first_value(
    triples: DataFrame, char: str, value: str, taxon: str = "taxon", charname: str = "charname", state: str = "state", line: str = "line"
) -> DataFrame:
    """Keep taxa whose first value (lowest line) of ``char`` equals ``value``."""
    first = triples.filter(F.col(charname) == char).groupBy(taxon).agg(F.min_by(state, line).alias("_first"))
    kept = lookup_side(first.filter(F.col("_first") == value).select(taxon))
    return triples.join(kept, taxon, "left_semi")


def first_seen_ids(
    triples: DataFrame, taxon: str = "taxon", charname: str = "charname", line: str = "line", name: str = "char_id"
) -> DataFrame:
    """(charname, id): dense ids in order of first appearance while scanning taxa by name."""
    seen = triples.groupBy(charname).agg(F.min(F.struct(taxon, line)).alias("_at"))
    seen = seen.select(charname, F.col(f"_at.{taxon}").alias("_taxon"), F.col(f"_at.{line}").alias("_line"))
    return with_position(seen, ["_taxon", "_line", charname], name).select(charname, name)


def match_count(names: DataFrame, variants: DataFrame) -> DataFrame:
    """Distinct names with the number of variants each one matches."""
    counts = variants.groupBy(F.col("taxonvariant_name").alias("name")).agg(F.count("*").alias("n"))
    wanted = names.select("name").distinct()
    return wanted.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_matches"))
