"""Trait-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import base, view
from catalog.registry import query, r6
from phylomart.operators.graph import answer_rows, graph_literals, graph_objects, page_by_name, trait_edges
from phylomart.operators.hierarchy import descendants
from phylomart.plans.triples import triples_for_taxa

# pages of the region and nation names: nested roots, so a page can lie below two of them
ROOTS = "select node_id as page_id from fx_taxonomy where lvl in ('ORDER', 'FAMILY')"
BELOW = f"""walk as (select r.page_id as root, e.child_page as descendant from ({ROOTS}) r join fx_page_edges e on e.parent_page = r.page_id
  union select w.root, e.child_page from walk w join fx_page_edges e on e.parent_page = w.descendant)"""


def edges(spark, sf):
    return trait_edges(*[view(spark, sf, f"fx_{n}") for n in ("traits", "trait_predicates", "trait_units", "trait_objects", "terms")])


@query("c15_graph_literals", "select page_id, predicate, units, measurement from fx_trait_edges where units is not null")
def _(spark, sf):
    return graph_literals(edges(spark, sf))


@query("c16_graph_objects", "select distinct page_id, predicate, object_term from fx_trait_edges where object_term is not null")
def _(spark, sf):
    return graph_objects(edges(spark, sf))


# stored answers of a graph service, one JSON text a trait
@query("c15_stored_answers", """select predicate, coalesce(units, 'none') as units from fx_trait_edges union all select predicate, cast(null as string) from fx_trait_edges""")
def _(spark, sf):
    rows = edges(spark, sf)
    pair = F.concat(F.lit('{"data": [["'), "predicate", F.lit('", "'), F.coalesce("units", F.lit("none")), F.lit('"], ["'), "predicate", F.lit('", null]]}'))
    return answer_rows(rows.select(pair.alias("answer")), "answer").select(F.col("cells")[0].alias("predicate"), F.col("cells")[1].alias("units"))


@query("c17_page_by_name", "select page_id, canonical from fx_pages where canonical in (select r_name from region union all select n_name from nation)")
def _(spark, sf):
    pages = view(spark, sf, "fx_pages")
    names = base(spark, sf, "region").select(F.col("r_name").alias("canonical")).unionByName(base(spark, sf, "nation").select(F.col("n_name").alias("canonical")))
    return page_by_name(pages, names)


@query("e7_descendants", f"with recursive {BELOW} select root, descendant from walk")
def _(spark, sf):
    roots = view(spark, sf, "fx_taxonomy").filter("lvl in ('ORDER', 'FAMILY')").select(F.col("node_id").alias("root"))
    return descendants(view(spark, sf, "fx_page_edges"), roots)


@query("g9_triples_for_taxa", """with recursive walk as (select node_id as descendant from fx_taxonomy where parent_id in (select node_id from fx_taxonomy where lvl = 'ORDER')
  union select t.node_id from walk w join fx_taxonomy t on t.parent_id = w.descendant),
species as (select p.page_id, p.canonical as taxon from fx_pages p join walk w on w.descendant = p.page_id where p.canonical like '% %')
select s.taxon, concat(e.predicate, ' (', e.units, ')') as predicate, round(e.measurement, 6) as value from fx_trait_edges e join species s on s.page_id = e.page_id where e.units is not null
union all select distinct s.taxon, concat(e.predicate, ' ', e.object_term), cast(null as double) from fx_trait_edges e join species s on s.page_id = e.page_id where e.object_term is not null""")
def _(spark, sf):
    names = view(spark, sf, "fx_taxonomy").filter("lvl = 'ORDER'").select(F.col("label").alias("canonical"))
    rows = triples_for_taxa(view(spark, sf, "fx_pages"), view(spark, sf, "fx_page_edges"), edges(spark, sf), names)
    number = F.col("value").try_cast("double")
    term = F.when(number.isNull(), F.concat("predicate", F.lit(" "), "value")).otherwise(F.col("predicate"))
    return rows.select("taxon", term.alias("predicate"), r6(number).alias("value"))
