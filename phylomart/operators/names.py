"""Name reconciliation over distinct labels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.operators.keys import assign_keys
from phylomart.operators.tours import nearest_marked
from phylomart.runtime import cut_lineage, lookup_side

# Match kinds accepted from a supplied candidate table.
ACCEPTED_MATCH_PATTERN = r"(?:Fuzzy|Exact) match by canonical form"

class BackboneResult(NamedTuple):
    variants: DataFrame  # new variants only
    taxa: DataFrame  # full new version: gbif keys updated, new taxa appended
    label_map: DataFrame  # label, taxonvariant_id
    rejected: DataFrame  # labels the backbone does not know


class NamesResult(NamedTuple):
    variants: DataFrame  # new variants only
    label_map: DataFrame  # label, taxonvariant_id (null where unresolved), rule


def lookup_name(df: DataFrame, longnames: DataFrame, key: str = "taxon_key", name: str = "label") -> DataFrame:
    """Add the canonical name of ``key``; null where the key is unknown."""
    named = longnames.select(F.col("tsn").alias("_tsn"), F.col("completename").alias(name))
    kept = [c for c in df.columns if c != name]
    return df.select(*kept).join(named, F.col(key) == F.col("_tsn"), "left").drop("_tsn")


def lookup_rejects(df: DataFrame, longnames: DataFrame, key: str = "taxon_key") -> DataFrame:
    """Rows whose key has no canonical name: they go to a reject table instead of ending the job."""
    return df.join(longnames.select(F.col("tsn").alias(key)), key, "left_anti")


def _one_tsn(longnames: DataFrame) -> DataFrame:
    """Name to tsn; homonyms take the lowest one."""
    return longnames.groupBy(F.col("completename").alias("label")).agg(F.min("tsn").alias("tsn"))


def _one_link(links: DataFrame) -> DataFrame:
    return links.groupBy("tsn").agg(F.min("tsn_accepted").alias("tsn_accepted"))


def resolve_backbone(
    labels: DataFrame, longnames: DataFrame, links: DataFrame, variants: DataFrame, taxa: DataFrame
) -> BackboneResult:
    """Attach occurrence labels to variants through the backbone's accepted names.

    A label that already is a variant keeps it; else the accepted name's variant is used; else the
    accepted taxon is found or created and the label becomes its variant. When the accepted name is
    itself a label of the same batch, its other labels share that new variant. Running it again
    adds nothing.
    """
    names = longnames.select(F.col("tsn").alias("accepted_tsn"), F.col("completename").alias("accepted_name"))
    wanted = labels.select("label").distinct()
    known = (
        wanted.join(_one_tsn(longnames), "label")
        .join(_one_link(links), "tsn", "left")
        .withColumn("accepted_tsn", F.coalesce("tsn_accepted", "tsn"))
        .join(names, "accepted_tsn")
        .select("label", "accepted_tsn", "accepted_name")
    )
    by_name = variants.groupBy("taxonvariant_name").agg(
        F.min(F.struct("taxonvariant_id", "taxon_id")).alias("_v")
    )
    own = by_name.select(F.col("taxonvariant_name").alias("label"), F.col("_v").alias("_own"))
    accepted = by_name.select(F.col("taxonvariant_name").alias("accepted_name"), F.col("_v").alias("_acc"))
    looked = cut_lineage(
        known.join(own, "label", "left")
        .join(accepted, "accepted_name", "left")
        .withColumn("_v", F.coalesce("_own", "_acc"))
        .select("label", "accepted_tsn", "accepted_name", F.col("_v.taxonvariant_id").alias("taxonvariant_id"),
                F.col("_v.taxon_id").alias("taxon_id"))
    )
    found, missing = looked.filter("taxonvariant_id is not null"), looked.filter("taxonvariant_id is null")

    taxon_of = taxa.groupBy(F.col("taxon_name").alias("accepted_name")).agg(F.min("taxon_id").alias("taxon_id"))
    missing_names = missing.groupBy("accepted_name").agg(F.min("accepted_tsn").alias("accepted_tsn"))
    with_taxon = missing_names.join(taxon_of, "accepted_name", "left")
    new_taxa = assign_keys(
        with_taxon.filter("taxon_id is null").select(
            F.col("accepted_name").alias("taxon_name"),
            F.lit(None).cast("string").alias("taxon_level"),
            F.lit(None).cast("long").alias("msw_id"),
            F.col("accepted_tsn").alias("gbif_taxon_key"),
        ),
        taxa,
        "taxon_id",
        ["taxon_name"],
    )
    taxon_ids = with_taxon.filter("taxon_id is not null").select("accepted_name", "taxon_id").unionByName(
        new_taxa.select(F.col("taxon_name").alias("accepted_name"), "taxon_id")
    )
    accepted_here = missing.filter("label = accepted_name").select("accepted_name")
    carriers = missing.filter("label = accepted_name").unionByName(
        missing.join(accepted_here, "accepted_name", "left_anti")
    )
    new_variants = assign_keys(
        carriers.drop("taxon_id").join(taxon_ids, "accepted_name").select(
            F.col("label").alias("taxonvariant_name"),
            F.lit(None).cast("string").alias("taxonvariant_level"),
            F.when(F.col("label") == F.col("accepted_name"), "accepted").otherwise("synonym").alias("taxonvariant_status"),
            "taxon_id",
        ),
        variants,
        "taxonvariant_id",
        ["taxonvariant_name"],
    )
    new_by_name = new_variants.select(F.col("taxonvariant_name").alias("_name"), "taxonvariant_id", "taxon_id")
    sharing = missing.join(accepted_here, "accepted_name", "left_semi")
    own_new = missing.join(accepted_here, "accepted_name", "left_anti")
    mapped = (
        found.select("label", "accepted_tsn", "taxonvariant_id", "taxon_id")
        .unionByName(_attach(sharing, new_by_name, "accepted_name"))
        .unionByName(_attach(own_new, new_by_name, "label"))
    )
    updates = mapped.groupBy("taxon_id").agg(F.max("accepted_tsn").alias("_key"))
    stored = taxa.join(updates, "taxon_id", "left").select(
        "taxon_id", "taxon_name", "taxon_level", "msw_id", F.coalesce("_key", "gbif_taxon_key").alias("gbif_taxon_key")
    )
    return BackboneResult(
        new_variants,
        stored.unionByName(new_taxa),
        mapped.select("label", "taxonvariant_id"),
        wanted.join(known.select("label"), "label", "left_anti"),
    )


def _attach(missing: DataFrame, new_by_name: DataFrame, on: str) -> DataFrame:
    rows = missing.select("label", "accepted_name", "accepted_tsn")
    return rows.join(new_by_name, F.col(on) == F.col("_name")).select(
        "label", "accepted_tsn", "taxonvariant_id", "taxon_id"
    )


def _without_one(name: Column) -> Column:
    """Array of (place, name without the character at that place)."""
    places = F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(name))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places,
        lambda i: F.struct(
            i.alias("place"),
            F.concat(name.substr(F.lit(1), i - 1), name.substr(i + 1, F.length(name))).alias("rest"),
        ),
    )


def fuzzy_match(labels: DataFrame, taxa: DataFrame, max_edit: int = 1, min_score: float = 0.75) -> DataFrame:
    """Best taxon per label at edit distance 0 or 1: (label, taxon_id, edit_distance, score).

    Two names are one edit apart exactly when one equals the other without a character, or both are
    equal without the character at the same place. Each case is an equality on a derived key, and
    the taxa side keeps only its lowest id per key before the join, so no candidate pair is ever
    produced however alike the names are. Only taxa whose names are within one character of the length of some
    label get keys. The score is 1 - distance / longer length; ties go to the lowest taxon id.
    """
    if max_edit not in (0, 1):
        raise ValueError("max_edit must be 0 or 1")
    named = taxa.filter(F.col("taxon_name").isNotNull())
    wanted = labels.select("label").filter(F.col("label").isNotNull()).distinct()
    exact_of = named.groupBy(F.col("taxon_name").alias("label")).agg(F.min("taxon_id").alias("taxon_id"))
    exact = wanted.join(exact_of, "label").select(
        "label", "taxon_id", F.lit(0).alias("edit_distance"), F.lit(1.0).alias("score")
    )
    if max_edit == 0:
        return exact
    rest = cut_lineage(wanted.join(exact_of.select("label"), "label", "left_anti"))
    # one row per length, at most three for each different length of labels
    length = F.length("label")
    lengths = rest.select(F.explode(F.array(length - 1, length, length + 1)).alias("_length")).distinct()
    near = named.join(F.broadcast(lengths), F.length("taxon_name") == F.col("_length"), "left_semi")

    def keyed(df: DataFrame, name: Column, keep: str, whole: str, cut: str) -> DataFrame:
        swaps = F.transform(
            _without_one(name),
            lambda c: F.array(
                F.struct(F.concat(F.lit("S"), c["place"].cast("string"), F.lit(":"), c["rest"]).alias("key")),
                F.struct(F.concat(F.lit(cut), c["rest"]).alias("key")),
            ),
        )
        all_keys = F.concat(F.flatten(swaps), F.array(F.struct(F.concat(F.lit(whole), name).alias("key"))))
        return df.select(keep, F.explode(all_keys).alias("_k")).select(keep, F.col("_k.key").alias("key"))

    # F: the taxon's whole name (label lost by one cut), D: the taxon's name less one character
    targets = keyed(near, F.col("taxon_name"), "taxon_id", "F", "D").groupBy("key").agg(F.min("taxon_id").alias("taxon_id"))
    # very many names may share a key: the side with one row per key is written before the join
    targets = lookup_side(targets)
    asked = keyed(rest, F.col("label"), "label", "D", "F")
    longer = F.when(F.col("key").startswith("D"), F.length("label") + 1).otherwise(F.length("label"))
    one_off = (
        asked.join(targets, "key")
        .withColumn("score", 1 - 1 / longer)
        .filter(F.col("score") >= min_score)
        .groupBy("label")
        .agg(F.min(F.struct("taxon_id", "score")).alias("_best"))
        .select("label", "_best.taxon_id", F.lit(1).alias("edit_distance"), "_best.score")
    )
    return exact.unionByName(one_off)


def acceptable(candidates: DataFrame, max_edit: int = 1, min_score: float = 0.75) -> DataFrame:
    """Rows of a supplied candidate table (score, match_value, edit_distance) good enough to attach."""
    return candidates.filter(
        (F.col("score") >= min_score)
        & F.col("match_value").rlike(ACCEPTED_MATCH_PATTERN)
        & (F.col("edit_distance") <= max_edit)
    )


def attach_candidates(
    candidates: DataFrame, taxa: DataFrame, id_col: str = "gbif_taxon_key", max_edit: int = 1, min_score: float = 0.75
) -> DataFrame:
    """Labels attached as synonyms through a supplied candidate table: a new-variant row per accepted label.

    ``candidates`` has label, local_id, score, match_value and edit_distance. Of a label's acceptable rows the
    highest score counts, then the fewest edits, then the lowest id. ``id_col`` of ``taxa`` (msw_id or gbif_taxon_key) is
    what local_id means; the lowest taxon wins where several have it, and a label whose id is unknown drops out.
    """
    good = acceptable(candidates.filter("label is not null and local_id is not null"), max_edit, min_score)
    best = good.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("worse"), "edit_distance", "local_id")).alias("_c"))
    owner = F.min(F.struct("taxon_id", "taxon_level")).alias("_t")
    owners = taxa.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_local")).agg(owner)
    return best.join(owners, F.col("_c.local_id") == F.col("_local")).select(
        F.col("label").alias("taxonvariant_name"),
        F.col("_t.taxon_level").alias("taxonvariant_level"),
        F.lit("synonym").alias("taxonvariant_status"),
        F.col("_t.taxon_id").alias("taxon_id"),
        F.col("_c.edit_distance").alias("edit_distance"),
        (-F.col("_c.worse")).alias("score"),
    )


def accept_fuzzy(labels: DataFrame, taxa: DataFrame, max_edit: int = 1, min_score: float = 0.75) -> DataFrame:
    """Labels attached as synonyms of their best fuzzy taxon: a new-variant row per accepted label."""
    best = fuzzy_match(labels, taxa, max_edit, min_score)
    return best.join(taxa.select("taxon_id", "taxon_level"), "taxon_id").select(
        F.col("label").alias("taxonvariant_name"),
        F.col("taxon_level").alias("taxonvariant_level"),
        F.lit("synonym").alias("taxonvariant_status"),
        "taxon_id",
        "edit_distance",
        "score",
    )


def resolve_names(
    labels: DataFrame,
    variants: DataFrame,
    taxa: DataFrame,
    longnames: DataFrame,
    links: DataFrame,
    min_score: float = 0.75,
    candidates: DataFrame | None = None,
    id_col: str = "gbif_taxon_key",
) -> NamesResult:
    """Map labels to variants: one local variant, else a synonym link, else a fuzzy match, else null.

    One set-wise pass over the distinct labels. A variant made for one label can be the accepted name of
    another, so links are followed to the first name that has a variant, by doubling: rounds grow with the
    logarithm of the longest chain, and circles have no end and no variant. The last rule takes matches from ``candidates`` where such a table is
    supplied, with ``id_col`` as in :func:`attach_candidates`, else from the taxa themselves.
    """
    wanted = labels.select("label").filter(F.col("label").isNotNull()).distinct()
    # one pass over the variants serves the local names and the carriers of links
    own = cut_lineage(_carriers(variants, F.count("*").alias("_n")))
    local = own.select(F.col("_accepted").alias("label"), "_n", F.col("_v.taxonvariant_id").alias("_id"))
    looked = cut_lineage(wanted.join(local, "label", "left"))
    mapped = looked.filter("_n = 1").select("label", F.col("_id").alias("taxonvariant_id"), F.lit("local").alias("rule"))
    open_labels = looked.filter("_n is null").select("label")
    ambiguous = looked.filter("_n > 1").select("label")

    # the lowest name where an id has several, so every label has one link
    accepted_names = longnames.groupBy(F.col("tsn").alias("tsn_accepted")).agg(F.min("completename").alias("_accepted"))
    linked = (
        open_labels.join(_one_tsn(longnames), "label")
        .join(_one_link(links), "tsn")
        .join(accepted_names, "tsn_accepted")
        .select("label", "_accepted")
    )
    linked = cut_lineage(linked)
    shape = "taxonvariant_name", "taxonvariant_level", "taxonvariant_status", "taxon_id"
    made = cut_lineage(
        _chain_ends(linked, own.select("_accepted"))
        .join(own.select("_accepted", "_v"), "_accepted")
        .select(
            F.col("label").alias("taxonvariant_name"),
            F.col("_v.taxonvariant_level").alias("taxonvariant_level"),
            F.lit("synonym").alias("taxonvariant_status"),
            F.col("_v.taxon_id").alias("taxon_id"),
        )
    )
    left_over = open_labels.unionByName(ambiguous)
    left_over = left_over.join(made.select(F.col("taxonvariant_name").alias("label")), "label", "left_anti")
    if candidates is None:
        matches = accept_fuzzy(left_over, taxa, 1, min_score)
    else:
        matches = attach_candidates(candidates.join(left_over.distinct(), "label", "left_semi"), taxa, id_col, 1, min_score)
    fuzzy = matches.select(*shape, F.lit("fuzzy").alias("rule"))
    new = made.select(*shape, F.lit("link").alias("rule")).unionByName(fuzzy)
    keyed = assign_keys(new, variants, "taxonvariant_id", ["taxonvariant_name"])
    created = keyed.select(F.col("taxonvariant_name").alias("label"), "taxonvariant_id", "rule")
    label_map = mapped.unionByName(created)
    unresolved = wanted.join(label_map.select("label"), "label", "left_anti").select(
        "label", F.lit(None).cast("long").alias("taxonvariant_id"), F.lit(None).cast("string").alias("rule")
    )
    return NamesResult(keyed.drop("rule"), label_map.unionByName(unresolved))


def _chain_ends(linked: DataFrame, named: DataFrame) -> DataFrame:
    """(label, _accepted): the first of the ``named`` names on the chain of accepted names of every linked label that has one.

    ``linked`` is stored and holds no label that is a ``named`` name.
    """
    step = F.lit(1).alias("tree_id"), F.col("label").alias("node_id"), F.col("_accepted").alias("up")
    ends = named.join(linked.select("_accepted").distinct(), "_accepted", "left_semi")
    stops = ends.select(step[0], F.col("_accepted").alias("node_id"), F.lit(None).cast("string").alias("up"), F.lit(True).alias("mark"))
    chain = linked.select(*step, F.lit(False).alias("mark")).unionByName(stops)
    return nearest_marked(chain, "mark").filter("near is not null").select(F.col("node_id").alias("label"), F.col("near").alias("_accepted"))


def _carriers(variants: DataFrame, *more: Column) -> DataFrame:
    """Name to its lowest variant's level and taxon, with ``more`` aggregates."""
    row = F.min(F.struct("taxonvariant_id", "taxonvariant_level", "taxon_id"))
    return variants.groupBy(F.col("taxonvariant_name").alias("_accepted")).agg(row.alias("_v"), *more)
