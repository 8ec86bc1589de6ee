"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import view
from catalog.registry import query, r6
from phylomart.operators import cleaning as c
from phylomart.operators.occurrences import latitude_summary

RAW = "gbif_id, basis_of_record, event_date, decimal_latitude, decimal_longitude, has_geospatial_issues, label"
RAW_COLUMNS = RAW.split(", ")
OCC = "occurrence_id, basis_of_record, event_date, latitude_text, longitude_text, label"
OCC_COLUMNS = OCC.split(", ")


def raw(spark, sf):
    return view(spark, sf, "fx_occ_raw").select(*RAW_COLUMNS)


def occ(spark, sf):
    return view(spark, sf, "fx_occurrences").select(*OCC_COLUMNS)


@query("b1_project_rename", """select gbif_id, occurrence_type, basis_of_record, event_date, decimal_latitude, decimal_longitude, dataset_key, has_geospatial_issues from fx_occ_raw""")
def _(spark, sf):
    back = {new: old for old, new in c.DARWIN_CORE_COLUMNS.items()}
    return c.project_rename(view(spark, sf, "fx_occ_raw").withColumnsRenamed(back))


@query("b2_bool_word_to_int", "select gbif_id, case when has_geospatial_issues = 'true' then 1 else 0 end as has_geospatial_issues from fx_occ_raw")
def _(spark, sf):
    return c.bool_word_to_int(view(spark, sf, "fx_occ_raw"), "has_geospatial_issues").select("gbif_id", "has_geospatial_issues")


@query("b3_require_fields", f"""select {RAW} from fx_occ_raw where coalesce(decimal_latitude, '') not in ('', '0') and coalesce(decimal_longitude, '') not in ('', '0') and coalesce(event_date, '') not in ('', '0')""")
def _(spark, sf):
    return c.require_fields(raw(spark, sf), ["decimal_longitude", "decimal_latitude", "event_date"])


@query("b4_require_zero", "select gbif_id, case when has_geospatial_issues = 'true' then '1' else 'no' end as flag from fx_occ_raw where has_geospatial_issues <> 'true'")
def _(spark, sf):
    flag = F.when(F.col("has_geospatial_issues") == "true", "1").otherwise("no").alias("flag")
    return c.require_zero(view(spark, sf, "fx_occ_raw").select("gbif_id", flag), "flag")


@query("b5_exclude_regex", f"select {RAW} from fx_occ_raw where basis_of_record not like '%UNKNOWN%'")
def _(spark, sf):
    return c.exclude_regex(raw(spark, sf), "basis_of_record", "UNKNOWN")


@query("b6_class_names", "select cast(taxonID as bigint) as tsn, canonicalName as completename from fx_backbone where class = 'Mammalia'")
def _(spark, sf):
    return c.class_names(view(spark, sf, "fx_backbone"))


@query("b7_synonym_links", """select cast(taxonID as bigint) as tsn, cast(acceptedNameUsageID as bigint) as tsn_accepted from fx_backbone
where class = 'Mammalia' and taxonomicStatus <> 'accepted' and acceptedNameUsageID <> ''""")
def _(spark, sf):
    return c.synonym_links(view(spark, sf, "fx_backbone"))


@query("b8_filter_basis", f"select {OCC} from fx_occurrences where basis_of_record in ('PRESERVED_SPECIMEN', 'HUMAN_OBSERVATION', 'FOSSIL_SPECIMEN', 'OBSERVATION')")
def _(spark, sf):
    return c.filter_basis(occ(spark, sf))


@query("b9_filter_dates", f"""select {OCC} from fx_occurrences where length(replace(substring(event_date, 1, 10), '-', '')) = 8
and try_cast(replace(substring(event_date, 1, 10), '-', '') as integer) between 19960101 and 19991231""")
def _(spark, sf):
    return c.filter_dates(occ(spark, sf), "1996-01-01", "1999-12-31")


@query("b10_filter_precision", f"""select {OCC} from fx_occurrences where length(split_part(latitude_text, '.', 2)) >= 2 and length(split_part(longitude_text, '.', 2)) >= 2""")
def _(spark, sf):
    return c.filter_precision(occ(spark, sf), 2)


@query("b13_make_label", """select line, case when taxon_level = 'SPECIES' then concat(genus, ' ', species) else rank_order end as label from fx_taxonomy_rows""")
def _(spark, sf):
    return c.make_label(view(spark, sf, "fx_taxonomy_rows"), "taxon_level", "rank_order").select("line", "label")


@query("b14_normalise_label", "select node_id, replace(label, '_', ' ') as label from fx_taxonomy")
def _(spark, sf):
    return c.normalise_label(view(spark, sf, "fx_taxonomy").select("node_id", "label"), "label")


SUMMARY = """select taxonvariant_id, avg(abs(decimal_latitude)) as average_absolute_latitude, max(decimal_latitude) - min(decimal_latitude) as latitudinal_range
from fx_occurrences where taxonvariant_id is not null group by taxonvariant_id"""


@query("b15_drop_zero_rows", f"""select taxonvariant_id, round(average_absolute_latitude, 6) as average_absolute_latitude, round(latitudinal_range, 6) as latitudinal_range
from ({SUMMARY}) s where average_absolute_latitude <> 0 and latitudinal_range <> 0""")
def _(spark, sf):
    rows = latitude_summary(view(spark, sf, "fx_occurrences").filter("taxonvariant_id is not null"), "taxonvariant_id")
    kept = c.drop_zero_rows(rows, ["average_absolute_latitude", "latitudinal_range"])
    return kept.select("taxonvariant_id", r6("average_absolute_latitude").alias("average_absolute_latitude"), r6("latitudinal_range").alias("latitudinal_range"))


@query("b16_binomials_only", "select page_id, canonical from fx_pages where canonical like '% %'")
def _(spark, sf):
    return c.binomials_only(view(spark, sf, "fx_pages"), "canonical")


@query("b17_label_with_units", "select trait_id, predicate || ' (' || units || ')' as label from fx_trait_edges where units is not null")
def _(spark, sf):
    return c.label_with_units(view(spark, sf, "fx_trait_edges").filter("units is not null")).select("trait_id", "label")


@query("b20_tree_by_name", "select b.node_id, b.label from fx_branches b where b.tree_id = (select tree_id from fx_trees where tree_name = 'phylogeny')")
def _(spark, sf):
    wanted = c.tree_by_name(view(spark, sf, "fx_trees"), "phylogeny")
    return view(spark, sf, "fx_branches").join(wanted, "tree_id", "left_semi").select("node_id", "label")
