"""Trait tables: long to wide and back, character matrices, accepted branches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.functions.text import number
from phylomart.operators.cleaning import keep_observed
from phylomart.operators.joins import trait_lookup
from phylomart.runtime import cut_lineage, with_position

# Characters that a wide table may have as columns.
MAX_COLUMNS = 2000

# Character labels of the mammal life-history source kept in character matrices.
DISCRETE_CHARACTERS = (
    "1-1_ActivityCycle",
    "6-1_DietBreadth",
    "12-1_HabitatBreadth",
    "12-2_Terrestriality",
    "6-2_TrophicLevel",
)
CONTINUOUS_CHARACTERS = (
    "5-1_AdultBodyMass_g",
    "8-1_AdultForearmLen_mm",
    "13-1_AdultHeadBodyLen_mm",
    "2-1_AgeatEyeOpening_d",
    "3-1_AgeatFirstBirth_d",
    "18-1_BasalMetRate_mLO2hr",
    "5-2_BasalMetRateMass_g",
    "7-1_DispersalAge_d",
    "9-1_GestationLen_d",
    "22-1_HomeRange_km2",
    "22-2_HomeRange_Indiv_km2",
    "14-1_InterbirthInterval_d",
    "15-1_LitterSize",
    "16-1_LittersPerYear",
    "17-1_MaxLongevity_m",
    "5-3_NeonateBodyMass_g",
    "13-2_NeonateHeadBodyLen_mm",
    "21-1_PopulationDensity_n/km2",
    "10-1_PopulationGrpSize",
    "23-1_SexualMaturityAge_d",
    "10-2_SocialGrpSize",
    "24-1_TeatNumber",
    "25-1_WeaningAge_d",
    "5-4_WeaningBodyMass_g",
    "13-3_WeaningHeadBodyLen_mm",
    "5-5_AdultBodyMass_g_EXT",
    "16-2_LittersPerYear_EXT",
    "5-6_NeonateBodyMass_g_EXT",
    "5-7_WeaningBodyMass_g_EXT",
    "26-1_GR_Area_km2",
    "26-2_GR_MaxLat_dd",
    "26-3_GR_MinLat_dd",
    "26-4_GR_MidRangeLat_dd",
    "26-5_GR_MaxLong_dd",
    "26-6_GR_MinLong_dd",
    "26-7_GR_MidRangeLong_dd",
    "27-1_HuPopDen_Min_n/km2",
    "27-2_HuPopDen_Mean_n/km2",
    "27-3_HuPopDen_5p_n/km2",
    "27-4_HuPopDen_Change",
    "28-1_Precip_Mean_mm",
    "28-2_Temp_Mean_01degC",
    "30-1_AET_Mean_mm",
    "30-2_PET_Mean_mm",
)
DEFAULT_KINDS = {**dict.fromkeys(DISCRETE_CHARACTERS, "discrete"), **dict.fromkeys(CONTINUOUS_CHARACTERS, "continuous")}


def filter_characters(states: DataFrame, characters: DataFrame, source: str, kinds: Mapping[str, str] = DEFAULT_KINDS) -> DataFrame:
    """States of one source's whitelisted characters, with the character label and its kind."""
    kind = F.lit(None).cast("string")
    for name in sorted(set(kinds.values())):
        kind = F.when(F.col("character_label").isin([k for k, v in kinds.items() if v == name]), name).otherwise(kind)
    wanted = (
        characters.filter((F.col("data_source") == source) & F.col("label").isin(list(kinds)))
        .select("character_id", F.col("label").alias("character_label"))
        .withColumn("kind", kind)
    )
    return states.join(wanted, "character_id")


def _column_labels(labels: DataFrame, max_columns: int) -> list:
    """The few rows that become columns; more than ``max_columns`` are an error, told before any pivot."""
    found = labels.limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError(f"more than {max_columns} characters for a wide table: use trait_lookup or character_lines, which keep them as rows")
    return found


def trait_set(
    names: DataFrame, tables: Mapping[str, DataFrame], source: str, labels: Sequence[str] | None = None, max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """Wide table: one row per asked name, one column per character of ``source`` in char_id order.

    A missing value is null; of several values the one with the highest state_id counts. The column
    list is the only thing read to the driver: the labels of one source, at most ``max_columns`` of them.
    """
    if labels is None:
        ours = tables["characters"].filter(F.col("data_source") == source)
        found = _column_labels(ours.select("char_id", "label").distinct(), max_columns)
        labels = [r["label"] for r in sorted(found, key=lambda r: tuple((v is not None, v) for v in r))]
    wanted = names.select("taxon_name").distinct()
    found = trait_lookup(tables, source).join(wanted, "taxon_name", "left_semi")
    wide = found.groupBy("taxon_name").pivot("character_label", list(labels)).agg(F.max_by("character_value", "state_id"))
    return wanted.join(wide, "taxon_name", "left").select("taxon_name", *[F.col(f"`{c}`") for c in labels])


def character_matrix(
    states: DataFrame, kinds: Mapping[str, str], row: str = "taxon_name", max_columns: int = MAX_COLUMNS
) -> tuple[DataFrame, DataFrame]:
    """(continuous, discrete) matrices: taxa with any state by sorted characters, ``?`` for missing.

    ``states`` has ``row``, ``character_label``, ``character_value`` and ``state_id``; the last state
    wins. Discrete cells are truncated to integers. Characters no taxon has are left out. More than ``max_columns``
    characters are an error; :func:`character_lines` writes the lines of any number.
    """
    known = states.filter(F.col("character_label").isin(list(kinds))).select("character_label").distinct()
    present = {r[0] for r in _column_labels(known, max_columns)}
    rows = states.select(row).distinct()

    def matrix(kind: str) -> DataFrame:
        labels = sorted(c for c in present if kinds[c] == kind)
        wide = states.groupBy(row).pivot("character_label", labels).agg(F.max_by("character_value", "state_id")) if labels else rows
        cells = []
        for c in labels:
            cell = F.col(f"`{c}`")
            if kind == "discrete":
                cell = number(cell).cast("long").cast("string")
            cells.append(F.coalesce(cell, F.lit("?")).alias(c))
        return wide.select(row, *cells)

    return matrix("continuous"), matrix("discrete")


def matrix_lines(matrix: DataFrame, name_col: str = "taxon_name") -> DataFrame:
    """Text lines of a matrix: the name with ``_`` for spaces, then its cells; ``?`` for missing."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in matrix.columns if c != name_col]
    return matrix.select(F.concat_ws(" ", F.translate(name_col, " ", "_"), *cells).alias("line"))


def character_lines(states: DataFrame, labels: DataFrame, discrete: bool = False, row: str = "taxon_name") -> DataFrame:
    """(line, n_cells): the lines of :func:`matrix_lines` for any number of characters, which stay rows until a line is joined.

    ``states`` is as in :func:`character_matrix`, ``labels`` (character_label) says which characters are columns, in sorted order. A line
    gathers only the cells that its taxon has; missing ones between them are written by their number.
    """
    used = states.join(labels.select("character_label").distinct(), "character_label", "left_semi")
    used = cut_lineage(used.groupBy(row, "character_label").agg(F.max_by("character_value", "state_id").alias("cell")))
    columns = cut_lineage(with_position(used.select("character_label").distinct(), ["character_label"], "_place"))
    n = columns.count()
    cell = number(F.col("cell")).cast("long").cast("string") if discrete else F.col("cell").cast("string")
    placed = used.join(columns, "character_label").select(row, F.struct("_place", F.coalesce(cell, F.lit("?")).alias("cell")).alias("_c"))
    held = placed.groupBy(row).agg(F.sort_array(F.collect_list("_c")).alias("_cells"))
    rows = states.select(row).distinct().join(held, row, "left")
    cells = F.coalesce("_cells", F.array().cast("array<struct<_place:bigint,cell:string>>"))

    def missing(many: Column) -> Column:
        return F.repeat(F.lit(" ?"), many.cast("int"))

    def piece(c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(cells, i - 1)["_place"]).otherwise(0)
        return F.concat(missing(c["_place"] - before - 1), F.lit(" "), c["cell"])

    tail = missing(n - F.coalesce(F.get(cells, F.size(cells) - 1)["_place"], F.lit(0)))
    name = F.coalesce(F.translate(row, " ", "_"), F.lit(""))
    return rows.select(F.concat(name, F.array_join(F.transform(cells, piece), ""), tail).alias("line"), F.lit(n).cast("long").alias("n_cells"))


def label_line(matrix: DataFrame, name_col: str = "taxon_name") -> str:
    """The character-label row of a matrix."""
    return " ".join(f"'{c}'" for c in matrix.columns if c != name_col)


def melt_traits(wide: DataFrame, id_col: str, source: str, sentinel: float = -999) -> tuple[DataFrame, DataFrame]:
    """Wide trait file to (states, characters). Characters count from 1 in column order after ``id_col``."""
    columns = wide.columns[wide.columns.index(id_col) + 1 :]
    spark = wide.sparkSession
    characters = spark.createDataFrame(
        [(i, label, source) for i, label in enumerate(columns, 1)], "char_id int, label string, data_source string"
    )
    place = F.create_map(*[F.lit(x) for i, c in enumerate(columns, 1) for x in (c, i)])
    long = wide.unpivot([id_col], list(columns), "_character", "character_value")
    states = keep_observed(long, "character_value", sentinel).select(
        F.col(id_col).alias("label"), place[F.col("_character")].cast("long").alias("character_id"), "character_value"
    )
    return states, characters


def accepted_branch(branches: DataFrame, variants: DataFrame, tree_id: int, ambiguous: str = "error") -> DataFrame:
    """One node per taxon in a tree: its accepted variant's, else its only one.

    Several nodes left is an error, or with ``ambiguous='drop'`` the taxon is left out. Taxa without
    a node have no row.
    """
    rows = (
        branches.filter(F.col("tree_id") == tree_id)
        .join(variants.select("taxonvariant_id", "taxon_id", "taxonvariant_status"), "taxonvariant_id")
        .select("taxon_id", "node_id", "branch_id", "taxonvariant_id", "branch_length", "taxonvariant_status")
    )
    node = F.struct("node_id", "branch_id", "taxonvariant_id", "branch_length")
    accepted = F.col("taxonvariant_status") == "accepted"
    picked = rows.groupBy("taxon_id").agg(
        F.min(F.when(accepted, node)).alias("_accepted"), F.min(node).alias("_any"), F.count("*").alias("_n")
    )
    clear = F.col("_accepted").isNotNull() | (F.col("_n") == 1)
    if ambiguous == "drop":
        picked = picked.filter(clear)
        chosen = F.coalesce("_accepted", "_any")
    else:
        message = F.concat(F.lit("multiple branches for taxon "), F.col("taxon_id").cast("string"))
        chosen = F.when(clear, F.coalesce("_accepted", "_any")).otherwise(F.raise_error(message))
    return picked.select("taxon_id", chosen.alias("_b")).select("taxon_id", "_b.*")
