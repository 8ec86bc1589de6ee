"""Joins, names and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import base, mart, view
from catalog.registry import query
from phylomart.operators import joins as j
from phylomart.operators.hierarchy import ranks_to_adjacency
from phylomart.operators.keys import assign_keys, match_count
from phylomart.operators.names import accept_fuzzy, attach_candidates, lookup_name, lookup_rejects, resolve_backbone, resolve_names
from phylomart.plans.taxonomy import build_backbone, build_taxonomy, extract_synonyms


@query("c1_lookup_name", "select r.gbif_id, r.taxon_key, l.completename as label from fx_occ_raw r left join fx_longnames l on r.taxon_key = l.tsn")
def _(spark, sf):
    return lookup_name(view(spark, sf, "fx_occ_raw").select("gbif_id", "taxon_key"), view(spark, sf, "fx_longnames"))


@query("c3_taxon_nodes", """select x.taxon_name, x.taxon_id, b.node_id, b.parent_id, b.branch_length from fx_branches b join fx_taxonvariants v on b.taxonvariant_id = v.taxonvariant_id
join fx_taxa x on v.taxon_id = x.taxon_id where b.tree_id = 12 and x.taxon_level in ('SPECIES', 'FAMILY')""")
def _(spark, sf):
    tables = mart(spark, sf)
    names = tables["taxa"].filter("taxon_level in ('SPECIES', 'FAMILY')").select("taxon_name")
    unknown = view(spark, sf, "fx_messy_names").select(F.col("label").alias("taxon_name"))
    found = j.taxon_nodes(names.unionByName(unknown), tables, 12)
    return found.select("taxon_name", "taxon_id", "node_id", "parent_id", "branch_length")


@query("c4_taxa_with_occurrences_in_tree", """select distinct x.taxon_name, o.decimal_latitude, o.decimal_longitude from fx_taxonvariants v join fx_taxa x on v.taxon_id = x.taxon_id
join fx_occurrences o on o.taxonvariant_id = v.taxonvariant_id join fx_branches b on b.taxonvariant_id = v.taxonvariant_id where b.tree_id = 12 and x.taxon_level = 'SPECIES'""")
def _(spark, sf):
    return j.taxa_with_occurrences_in_tree(mart(spark, sf), 12)


@query("c6_taxon_fanout", """select x.taxon_name, o.occurrence_id, v.taxonvariant_status from fx_taxa x join fx_taxonvariants v on v.taxon_id = x.taxon_id
join fx_occurrences o on o.taxonvariant_id = v.taxonvariant_id where x.taxon_level = 'SPECIES'""")
def _(spark, sf):
    tables = mart(spark, sf)
    rows = j.taxon_fanout(tables["taxa"].filter("taxon_level = 'SPECIES'"), tables, "occurrences")
    return rows.select("taxon_name", "occurrence_id", "taxonvariant_status")


@query("c7_with_parent", """select b.branch_id, b.label, v.taxonvariant_name, v.taxon_id from fx_branches b left join fx_taxonvariants v on b.taxonvariant_id = v.taxonvariant_id""")
def _(spark, sf):
    tables = mart(spark, sf)
    return j.with_parent(tables["branches"], tables["taxonvariants"], "taxonvariant_id").select("branch_id", "label", "taxonvariant_name", "taxon_id")


def backbone_labels(spark, sf):
    names = view(spark, sf, "fx_longnames").select(F.col("completename").alias("label"))
    return view(spark, sf, "fx_occ_raw").select("label").unionByName(names)


BACKBONE = """with labels as (select label from fx_occ_raw union select completename from fx_longnames),
known as (select l.label, coalesce(k.tsn_accepted, n.tsn) as accepted_tsn, a.completename as accepted_name from labels l
  join fx_longnames n on n.completename = l.label left join fx_synonym_links k on k.tsn = n.tsn join fx_longnames a on a.tsn = coalesce(k.tsn_accepted, n.tsn)),
looked as (select k.*, coalesce(o.taxonvariant_id, c.taxonvariant_id) as vid from known k left join fx_taxonvariants o on o.taxonvariant_name = k.label
  left join fx_taxonvariants c on c.taxonvariant_name = k.accepted_name),
made as (select label, accepted_tsn, row_number() over (order by label) as rn from looked where vid is null and label = accepted_name)"""


@query("c8_resolve_backbone", BACKBONE + """
select k.label, coalesce(k.vid, (select max(taxonvariant_id) from fx_taxonvariants) + m.rn) as taxonvariant_id
from looked k left join made m on m.label = k.accepted_name""")
def _(spark, sf):
    t = mart(spark, sf)
    return resolve_backbone(backbone_labels(spark, sf), t["longnames"], t["synonym_links"], t["taxonvariants"], t["taxa"]).label_map


@query("c8_resolve_backbone_taxa", BACKBONE + """
select taxon_id, taxon_name, case when taxon_level = 'SPECIES' then msw_id else gbif_taxon_key end as gbif_taxon_key from fx_taxa
union all select (select max(taxon_id) from fx_taxa) + rn, label, accepted_tsn from made""")
def _(spark, sf):
    t = mart(spark, sf)
    found = resolve_backbone(backbone_labels(spark, sf), t["longnames"], t["synonym_links"], t["taxonvariants"], t["taxa"])
    return found.taxa.select("taxon_id", "taxon_name", "gbif_taxon_key")


def name_labels(spark, sf):
    names = view(spark, sf, "fx_longnames").select(F.col("completename").alias("label"))
    return view(spark, sf, "fx_messy_names").select("label").unionByName(names).unionByName(view(spark, sf, "fx_chain_names").select(F.col("completename").alias("label")))


def resolved(spark, sf):
    t = mart(spark, sf)
    names = t["longnames"].unionByName(view(spark, sf, "fx_chain_names"))
    links = t["synonym_links"].unionByName(view(spark, sf, "fx_chain_links"))
    return resolve_names(name_labels(spark, sf), t["taxonvariants"], t["taxa"], names, links)


# levenshtein over all pairs: the plain definition, against the keyed join of the operator
FUZZY = """fuzzy as (select label, taxon_id, distance from (select q.label, x.taxon_id, levenshtein(q.label, x.taxon_name) as distance,
    row_number() over (partition by q.label order by levenshtein(q.label, x.taxon_name), x.taxon_id) as rn
  from {asked} q join fx_taxa x on abs(length(q.label) - length(x.taxon_name)) <= 1 and levenshtein(q.label, x.taxon_name) <= 1) c where rn = 1)"""

RESOLVED = f"""with recursive all_names as (select tsn, completename from fx_longnames union all select tsn, completename from fx_chain_names),
all_links as (select tsn, tsn_accepted from fx_synonym_links union all select tsn, tsn_accepted from fx_chain_links),
asked as (select label from fx_messy_names union select completename from all_names),
local_names as (select a.label, min(v.taxonvariant_id) as vid from asked a join fx_taxonvariants v on v.taxonvariant_name = a.label group by a.label having count(*) = 1),
steps as (select a.label, c.completename as accepted from asked a join all_names n on n.completename = a.label join all_links k on k.tsn = n.tsn
  join all_names c on c.tsn = k.tsn_accepted where a.label not in (select label from local_names)),
linked as (select s.label, v.taxon_id, v.taxonvariant_level as level from steps s join fx_taxonvariants v on v.taxonvariant_name = s.accepted
  union all select s.label, l.taxon_id, l.level from linked l join steps s on s.accepted = l.label),
rest as (select label from asked where label not in (select label from local_names) and label not in (select label from linked)),
{FUZZY.format(asked='rest')},
made as (select label, taxon_id, 'link' as rule from linked union all select label, taxon_id, 'fuzzy' from fuzzy),
keyed as (select *, row_number() over (order by label) + (select max(taxonvariant_id) from fx_taxonvariants) as taxonvariant_id from made)"""


@query("c9_resolve_names", RESOLVED + """
select a.label, coalesce(l.vid, k.taxonvariant_id) as taxonvariant_id, case when l.vid is not null then 'local' else k.rule end as rule
from asked a left join local_names l on l.label = a.label left join keyed k on k.label = a.label""")
def _(spark, sf):
    return resolved(spark, sf).label_map


@query("c9_resolve_names_variants", RESOLVED + """
select k.taxonvariant_id, k.label as taxonvariant_name, x.taxon_level as taxonvariant_level, 'synonym' as taxonvariant_status, k.taxon_id from keyed k join fx_taxa x on x.taxon_id = k.taxon_id""")
def _(spark, sf):
    return resolved(spark, sf).variants


@query("c10_attach_candidates", """with good as (select * from fx_candidates where score >= 0.75 and edit_distance <= 1 and regexp_matches(match_value, '(Fuzzy|Exact) match by canonical form')),
best as (select *, row_number() over (partition by label order by score desc, edit_distance, local_id) as rn from good)
select b.label as taxonvariant_name, x.taxon_level as taxonvariant_level, 'synonym' as taxonvariant_status, x.taxon_id, b.edit_distance, b.score
from best b join fx_taxa x on x.gbif_taxon_key = b.local_id where rn = 1""")
def _(spark, sf):
    return attach_candidates(view(spark, sf, "fx_candidates"), view(spark, sf, "fx_taxa"), "gbif_taxon_key")


@query("c1_rejects", "select gbif_id, taxon_key from fx_occ_raw where taxon_key not in (select tsn from fx_longnames where completename not like '%9')")
def _(spark, sf):
    known = view(spark, sf, "fx_longnames").filter("completename not like '%9'")
    return lookup_rejects(view(spark, sf, "fx_occ_raw").select("gbif_id", "taxon_key"), known).select("gbif_id", "taxon_key")


@query("c10_accept_fuzzy", f"""with asked as (select distinct label from fx_messy_names), {FUZZY.format(asked='asked')}
select f.label as taxonvariant_name, x.taxon_level as taxonvariant_level, 'synonym' as taxonvariant_status, f.taxon_id, f.distance as edit_distance from fuzzy f join fx_taxa x on x.taxon_id = f.taxon_id""")
def _(spark, sf):
    return accept_fuzzy(view(spark, sf, "fx_messy_names"), view(spark, sf, "fx_taxa")).drop("score")


@query("c13_setdiff_join", "select node_id, label from fx_phylogeny where label <> '' and label not in (select binomial from fx_traits_wide where t2_price not in ('', 'n/a'))")
def _(spark, sf):
    tips = view(spark, sf, "fx_phylogeny").filter("label <> ''").select("node_id", "label")
    priced = view(spark, sf, "fx_traits_wide").filter("t2_price not in ('', 'n/a')")
    return j.setdiff_join(tips, priced.withColumnRenamed("binomial", "label"), "label")


@query("c14_taxa_in_all", """select taxon_id, taxon_name from fx_taxa x where exists (select 1 from fx_taxonvariants v join fx_occurrences o on o.taxonvariant_id = v.taxonvariant_id where v.taxon_id = x.taxon_id)
and exists (select 1 from fx_taxonvariants v join fx_states s on s.taxonvariant_id = v.taxonvariant_id where v.taxon_id = x.taxon_id)""")
def _(spark, sf):
    return j.taxa_in_all(mart(spark, sf), ["occurrences", "states"]).select("taxon_id", "taxon_name")


# the parents of each key without a part of their rows
KEPT_PARENTS = {"taxonvariants": "taxonvariant_status = 'accepted'", "taxa": "taxon_level <> 'FAMILY'", "trees": "tree_id <> 12", "characters": "data_source = 'parts'"}
ORPHANS = [("branches", "taxonvariant_id", "taxonvariants"), ("taxonvariants", "taxon_id", "taxa"), ("branches", "tree_id", "trees"),
           ("occurrences", "taxonvariant_id", "taxonvariants"), ("states", "character_id", "characters"), ("states", "taxonvariant_id", "taxonvariants")]


def orphans_sql() -> str:
    kept = {n: f"(select * from fx_{n} where {KEPT_PARENTS[n]})" if n in KEPT_PARENTS else f"fx_{n}" for n in ("branches", "occurrences", "states", *KEPT_PARENTS)}
    return " union all ".join(
        f"select '{child}' as child, '{fk}' as fk, {fk} as fk_value, count(*) as n_rows from {kept[child]} c where {fk} not in (select {fk} from {kept[parent]} p) group by {fk}"
        for child, fk, parent in ORPHANS
    )


@query("c18_orphan_audit", orphans_sql())
def _(spark, sf):
    tables = mart(spark, sf)
    return j.orphan_audit({n: df.filter(KEPT_PARENTS[n]) if n in KEPT_PARENTS else df for n, df in tables.items()})


@query("d13_assign_keys", """select row_number() over (order by s_name, s_suppkey) + (select max(taxon_id) from fx_taxa) as taxon_id, s_name as taxon_name from supplier""")
def _(spark, sf):
    taxa = view(spark, sf, "fx_taxa")
    new = base(spark, sf, "supplier").select(F.col("s_name").alias("taxon_name"), "s_suppkey")
    return assign_keys(new, taxa, "taxon_id", ["taxon_name", "s_suppkey"]).select("taxon_id", "taxon_name")


@query("d14_match_count", """select n.label as name, count(v.taxonvariant_id) as n_matches from (select distinct label from fx_messy_names) n
left join fx_taxonvariants v on v.taxonvariant_name = n.label group by n.label""")
def _(spark, sf):
    return match_count(view(spark, sf, "fx_messy_names").withColumnRenamed("label", "name"), view(spark, sf, "fx_taxonvariants"))


SYNONYMS = """(select line, case when regexp_matches(text, '<i>([A-Za-z]+)</i>') then [regexp_extract(text, '<i>([A-Za-z]+)</i>', 1)]
  when len(list_filter(string_split(text, ', '), lambda w: not regexp_matches(w, '^[A-Z][a-z]+$'))) = 0 then string_split(text, ', ')
  when regexp_matches(text, '^[A-Z][a-z]+') then [regexp_extract(text, '^([A-Z][a-z]+)', 1)] else [] end as words
from (select line, regexp_replace(synonyms, '\\.$', '') as text from fx_taxonomy_rows) t)"""


@query("g1_extract_synonyms", f"""select r.line, u.epithet, case when r.taxon_level = 'SPECIES' then concat(r.genus, ' ', u.epithet) else u.epithet end as synonym_name
from (select line, unnest(words) as epithet from {SYNONYMS} w) u join fx_taxonomy_rows r on r.line = u.line""")
def _(spark, sf):
    return extract_synonyms(view(spark, sf, "fx_taxonomy_rows")).select("line", "epithet", "synonym_name")


RANKS = ["rank_order", "rank_family", "genus", "species"]
PLACES = """prefixes as (select line, id, 1 as depth, rank_order as prefix from fx_taxonomy_rows
  union all select line, id, 2, concat(rank_order, '|', rank_family) from fx_taxonomy_rows where rank_family <> ''
  union all select line, id, 3, concat(rank_order, '|', rank_family, '|', genus) from fx_taxonomy_rows
  union all select line, id, 4, concat(rank_order, '|', rank_family, '|', genus, '|', genus, ' ', species) from fx_taxonomy_rows where species <> ''),
firsts as (select line, id, prefix from (select *, row_number() over (partition by prefix order by line) as rn from prefixes) p where rn = 1),
parents as (select p.line, arg_max(f.id, p.depth) as parent_id from prefixes p join firsts f on f.prefix = p.prefix and f.line < p.line group by p.line),
places as (select r.line, r.id, case when r.species <> '' then concat(r.genus, ' ', r.species) else r.genus end as label, q.parent_id
  from fx_taxonomy_rows r left join parents q on q.line = r.line)"""


@query("e5_ranks_to_adjacency", f"with {PLACES} select line, id, label, parent_id from places")
def _(spark, sf):
    return ranks_to_adjacency(view(spark, sf, "fx_taxonomy_rows"), RANKS)


@query("g2_build_taxonomy", f"""with {PLACES}, numbered as (select p.*, row_number() over (order by line) as taxon_id from places p)
select n.taxon_id, n.label as taxon_name, r.taxon_level, cast(n.id as bigint) as msw_id, cast(n.parent_id as bigint) as parent_id, cast(42 as bigint) as tree_id
from numbered n join fx_taxonomy_rows r on r.line = n.line""")
def _(spark, sf):
    built = build_taxonomy(view(spark, sf, "fx_taxonomy_rows"), RANKS, 42)
    nodes = built.branches.select(F.col("node_id").alias("msw_id"), "parent_id", "tree_id")
    return built.taxa.join(nodes, "msw_id").select("taxon_id", "taxon_name", "taxon_level", "msw_id", "parent_id", "tree_id")


@query("g2_build_taxonomy_variants", f"""with {PLACES}, numbered as (select p.*, r.taxon_level, r.genus, row_number() over (order by p.line) as taxon_id from places p join fx_taxonomy_rows r on r.line = p.line),
names as (select line, 0 as nth, label as taxonvariant_name, 'accepted' as taxonvariant_status, taxon_id from numbered
  union all select n.line, 1, case when n.taxon_level = 'SPECIES' then concat(n.genus, ' ', u.epithet) else u.epithet end, 'synonym', n.taxon_id
  from (select line, unnest(words) as epithet from {SYNONYMS} w) u join numbered n on n.line = u.line)
select row_number() over (order by line, nth, taxonvariant_name) as taxonvariant_id, taxonvariant_name, taxonvariant_status, taxon_id from names""")
def _(spark, sf):
    built = build_taxonomy(view(spark, sf, "fx_taxonomy_rows"), RANKS, 42)
    return built.taxonvariants.select("taxonvariant_id", "taxonvariant_name", "taxonvariant_status", "taxon_id")


@query("g3_build_backbone", """select cast(b.taxonID as bigint) as tsn, b.canonicalName as completename,
  case when b.taxonomicStatus <> 'accepted' and b.acceptedNameUsageID <> '' then cast(b.acceptedNameUsageID as bigint) end as tsn_accepted from fx_backbone b where b.class = 'Mammalia'""")
def _(spark, sf):
    longnames, links = build_backbone(view(spark, sf, "fx_backbone"))
    return longnames.join(links, "tsn", "left")
