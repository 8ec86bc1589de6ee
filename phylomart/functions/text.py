"""Column functions on names, labels and number-like text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shape of text that counts as a number.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def looks_numeric(column: Column) -> Column:
    """True for plain decimal or scientific text; guards ``try_cast``, which also takes ``1d``."""
    return F.coalesce(column.rlike(NUMBER_PATTERN), F.lit(False))


def number(column: Column) -> Column:
    """Number-like text as double, anything else null."""
    return F.when(looks_numeric(column), F.trim(column).try_cast("double"))


def is_blank(column: Column, zero_is_missing: bool = True) -> Column:
    """Null or empty text; ``'0'`` too when asked (``'0.0'`` is a value)."""
    return F.coalesce(column.cast("string"), F.lit("")).isin(["", "0"] if zero_is_missing else [""])


def rank_label(level: str | Column, genus: Column, species: Column, subspecies: Column, own: Column) -> Column:
    """Binomial for species, trinomial for subspecies, the rank's own name above."""
    rank = F.lower(F.lit(level) if isinstance(level, str) else level)
    return (
        F.when(rank == "species", F.concat_ws(" ", genus, species))
        .when(rank == "subspecies", F.concat_ws(" ", genus, species, subspecies))
        .otherwise(own)
    )
