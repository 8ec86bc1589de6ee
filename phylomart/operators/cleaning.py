"""Row filters and projections. All are narrow: no shuffle, and they reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.functions.text import is_blank, looks_numeric, number, rank_label

# Darwin Core columns kept by the mart, and their names in it.
DARWIN_CORE_COLUMNS = {
    "gbifID": "gbif_id",
    "type": "occurrence_type",
    "basisOfRecord": "basis_of_record",
    "eventDate": "event_date",
    "decimalLatitude": "decimal_latitude",
    "decimalLongitude": "decimal_longitude",
    "datasetKey": "dataset_key",
    "hasGeospatialIssues": "has_geospatial_issues",
}

# Record types accepted by default.
DEFAULT_BASIS = (
    "PRESERVED_SPECIMEN",
    "HUMAN_OBSERVATION",
    "MACHINE_OBSERVATION",
    "FOSSIL_SPECIMEN",
    "OBSERVATION",
    "LITERATURE",
    "MATERIAL_SAMPLE",
)


def project_rename(df: DataFrame, mapping: Mapping[str, str] = DARWIN_CORE_COLUMNS) -> DataFrame:
    """Keep the mapped columns that are present, under their new names."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items() if old in df.columns])


def bool_word_to_int(df: DataFrame, col: str) -> DataFrame:
    """``'true'`` becomes 1, everything else (null too) 0."""
    return df.withColumn(col, F.when(F.col(col) == "true", 1).otherwise(0))


def require_fields(df: DataFrame, cols: Sequence[str], zero_is_missing: bool = True) -> DataFrame:
    """Drop rows where any of ``cols`` is blank; by default ``'0'`` counts as blank."""
    for col in cols:
        df = df.filter(~is_blank(F.col(col), zero_is_missing))
    return df


def require_zero(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose ``col`` is numerically zero; null and words count as zero."""
    return df.filter(F.coalesce(number(F.col(col).cast("string")), F.lit(0.0)) == 0)


def exclude_regex(df: DataFrame, col: str, pat: str) -> DataFrame:
    """Drop rows whose ``col`` contains a match of ``pat``; null stays."""
    return df.filter(~F.coalesce(F.col(col), F.lit("")).rlike(pat))


def class_names(backbone: DataFrame, cls: str = "Mammalia") -> DataFrame:
    """(tsn, completename) of the backbone rows of one class."""
    rows = backbone.filter(F.col("class") == cls)
    return rows.select(F.col("taxonID").try_cast("long").alias("tsn"), F.col("canonicalName").alias("completename"))


def synonym_links(backbone: DataFrame, cls: str = "Mammalia") -> DataFrame:
    """(tsn, tsn_accepted) of the non-accepted rows of one class that name an accepted row."""
    status = F.coalesce(F.col("taxonomicStatus"), F.lit(""))
    rows = backbone.filter(
        (F.col("class") == cls) & (status != "accepted") & ~is_blank(F.col("acceptedNameUsageID"))
    )
    return rows.select(
        F.col("taxonID").try_cast("long").alias("tsn"), F.col("acceptedNameUsageID").try_cast("long").alias("tsn_accepted")
    )


def filter_basis(occ: DataFrame, codes: Sequence[str] = DEFAULT_BASIS) -> DataFrame:
    """Keep the listed record types; a given list replaces the default one."""
    return occ.filter(F.col("basis_of_record").isin(list(codes)))


def filter_dates(
    occ: DataFrame, mindate: str | None = None, maxdate: str | None = None, col: str = "event_date"
) -> DataFrame:
    """Keep dates inside the inclusive bounds; malformed dates go only when a bound is set."""
    if not mindate and not maxdate:
        return occ
    digits = F.regexp_replace(F.substring(col, 1, 10), "-", "")
    day = F.when(digits.rlike(r"^[0-9]{8}$"), digits.try_cast("int"))
    keep: Column = day.isNotNull()
    if mindate:
        keep = keep & (day >= int(mindate.replace("-", "")))
    if maxdate:
        keep = keep & (day <= int(maxdate.replace("-", "")))
    return occ.filter(F.coalesce(keep, F.lit(False)))


def filter_precision(
    occ: DataFrame, digits: int | None = 2, lat: str = "latitude_text", lon: str = "longitude_text"
) -> DataFrame:
    """Keep rows whose coordinate texts both carry at least ``digits`` decimals; 0 or None is off."""
    if not digits:
        return occ
    pattern = rf"^-?[0-9]+\.[0-9]{{{int(digits)}}}"
    return occ.filter(F.col(lat).rlike(pattern) & F.col(lon).rlike(pattern))


def keep_observed(df: DataFrame, col: str, sentinel: float = -999) -> DataFrame:
    """Keep multi-values (holding ``;``) and numbers other than the missing-value sentinel."""
    value = F.col(col)
    return df.filter(value.contains(";") | (looks_numeric(value) & (number(value) != float(sentinel))))


def make_label(rows: DataFrame, level: str = "taxon_level", own: str = "own_name", name: str = "label") -> DataFrame:
    """Add the taxon label of each row's rank, from genus / species / subspecies columns or ``own``."""
    part = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("genus", "species", "subspecies", own)}
    return rows.withColumn(
        name, rank_label(F.col(level), part["genus"], part["species"], part["subspecies"], part[own])
    )


def normalise_label(df: DataFrame, col: str, reverse: bool = False) -> DataFrame:
    """Underscores to spaces, or back with ``reverse``."""
    old, new = (" ", "_") if reverse else ("_", " ")
    return df.withColumn(col, F.translate(col, old, new))


def drop_zero_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows where none of ``cols`` is zero."""
    for col in cols:
        df = df.filter(F.col(col) != 0)
    return df


def binomials_only(df: DataFrame, col: str) -> DataFrame:
    """Keep names that contain white space."""
    return df.filter(F.col(col).rlike(r"\s"))


def label_with_units(df: DataFrame, predicate: str = "predicate", units: str = "units", name: str = "label") -> DataFrame:
    """Add ``predicate (units)``."""
    return df.withColumn(name, F.concat(predicate, F.lit(" ("), units, F.lit(")")))


def to_numeric(df: DataFrame, cols: Sequence[str], integer: bool = False) -> DataFrame:
    """Text states to numbers, bad text to null; ``integer`` truncates toward zero."""
    for col in cols:
        value = number(F.col(col).cast("string"))
        df = df.withColumn(col, value.cast("long") if integer else value)
    return df


def tree_by_name(trees: DataFrame, name: str) -> DataFrame:
    """The tree_id rows of one tree name."""
    return trees.filter(F.col("tree_name") == name).select("tree_id")
