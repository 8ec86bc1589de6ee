"""Sources and sinks: write the fixture, read it back with the operator under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import base, mart, view
from catalog.registry import query, scratch
from phylomart.operators.joins import backfill_fk, insert_if_absent
from phylomart.operators.traits import character_lines, character_matrix, matrix_lines
from phylomart.runtime import cut_lineage
from phylomart.schemas import TABLES
from phylomart.sources.fragments import fragment_rejects, parse_fragments
from phylomart.sources.newick import newick_fragments, newick_rejects, nexus_trees, parse_newick, write_newick
from phylomart.sources.tables import register_tables, write_tables
from phylomart.sources.shapes import read_shapes, write_shapes
from phylomart.sources.tabular import read_csv_quoted, read_ranges, read_species_csv, read_tsv, write_species_csv, write_tsv
from catalog.traits import KINDS, labelled_states

ROWS_SCHEMA = (
    "line long, id string, rank_order string, rank_family string, genus string, species string, taxon_level string, synonyms string"
)
ROWS_SQL = """select line, id, rank_order, nullif(rank_family, '') as rank_family, genus, nullif(species, '') as species, taxon_level,
  nullif(synonyms, '') as synonyms from fx_taxonomy_rows"""


@query("a1_read_tsv", ROWS_SQL)
def _(spark, sf):
    path = scratch(spark)
    write_tsv(view(spark, sf, "fx_taxonomy_rows"), path)
    return read_tsv(spark, path, ROWS_SCHEMA)


@query("a2_read_tsv_gzip", ROWS_SQL)
def _(spark, sf):
    path = scratch(spark)
    rows = view(spark, sf, "fx_taxonomy_rows")
    rows.write.options(sep="\t", header=True, quote="", emptyValue="", compression="gzip").csv(path)
    return read_tsv(spark, path, ROWS_SCHEMA)


@query(
    "a3_read_csv_quoted",
    "select line, id, concat(synonyms, chr(10), '\"', genus, '\", ', rank_order) as note from fx_taxonomy_rows",
)
def _(spark, sf):
    path = scratch(spark)
    note = F.concat("synonyms", F.lit("\n"), F.lit('"'), "genus", F.lit('", '), "rank_order").alias("note")
    rows = view(spark, sf, "fx_taxonomy_rows").select("line", "id", note)
    rows.write.options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False).csv(path)
    return read_csv_quoted(spark, path, "line long, id string, note string")


@query("a4_read_tsv_crlf", ROWS_SQL)
def _(spark, sf):
    path = scratch(spark)
    rows = view(spark, sf, "fx_taxonomy_rows")
    rows.write.options(sep="\t", header=True, quote="", emptyValue="", lineSep="\r\n").csv(path)
    return read_tsv(spark, path, ROWS_SCHEMA)


@query(
    "a5_register_tables",
    "\nunion all ".join(f"select '{t}' as table_name, count(*) as n_rows from fx_{t}" for t in TABLES),
)
def _(spark, sf):
    path = scratch(spark)
    write_tables(mart(spark, sf), path)
    register_tables(spark, path)
    return spark.sql(" union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLES))


ADJACENT = """select cast(c.tree_id as string) as tree_name, replace(c.label, '_', ' ') as label, replace(p.label, '_', ' ') as parent_label, c.branch_length
from {0} c left join {0} p on c.parent_id = p.node_id and c.tree_id = p.tree_id"""


def adjacent(nodes):
    parents = nodes.select("tree_name", F.col("node_id").alias("parent_id"), F.col("label").alias("parent_label"))
    return nodes.join(parents, ["tree_name", "parent_id"], "left").select("tree_name", "label", "parent_label", "branch_length")


def customer_texts(spark, sf):
    """The text of every customer's tree, which has that customer's orders."""
    return write_newick(view(spark, sf, "fx_customer_trees")).withColumn("tree_name", F.col("tree_id").cast("string"))


@query("a6_parse_newick", ADJACENT.format("fx_customer_trees"))
def _(spark, sf):
    return adjacent(parse_newick(customer_texts(spark, sf)))


# the five trees of tree 11 hold all customers and orders; each comes as one piece a node, or two
@query("a6_parse_fragments", ADJACENT.format("fx_taxonomy").replace("cast(c.tree_id as string) as tree_name, ", ""))
def _(spark, sf):
    pieces = newick_fragments(view(spark, sf, "fx_taxonomy")).withColumn("tree_name", F.col("root_id").cast("string"))
    return adjacent(parse_fragments(pieces)).drop("tree_name")


def with_rings(ranges):
    """Rectangle and hole bounds to closed five-point rings."""

    def ring(x0, y0, x1, y1):
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners])

    hole = F.when(F.col("hx0").isNotNull(), ring("hx0", "hy0", "hx1", "hy1"))
    return ranges.select("binomial", "legend", F.array_compact(F.array(ring("x0", "y0", "x1", "y1"), hole)).alias("rings"))


@query(
    "a7_read_ranges",
    """select binomial, legend, case when hx0 is null then 1 else 2 end as n_rings, x0, y1 from fx_ranges""",
)
def _(spark, sf):
    path = scratch(spark)
    with_rings(view(spark, sf, "fx_ranges")).write.parquet(path)
    ranges = read_ranges(spark, path)
    return ranges.select(
        "binomial", "legend", F.size("rings").alias("n_rings"), F.col("rings")[0][0]["x"].alias("x0"), F.col("rings")[0][2]["y"].alias("y1")
    )


# written as shape files and read back in slices far smaller than a file
@query(
    "a7_read_shapes",
    """select binomial, legend, case when hx0 is null then 1 else 2 end as n_rings, x0, y0, x1, y1, hx0, hy1 from fx_ranges""",
)
def _(spark, sf):
    path = scratch(spark)
    write_shapes(with_rings(view(spark, sf, "fx_ranges")), path)
    corner = {"x0": (0, 0, "x"), "y0": (0, 0, "y"), "x1": (0, 2, "x"), "y1": (0, 2, "y"), "hx0": (1, 0, "x"), "hy1": (1, 2, "y")}
    ranges = read_shapes(spark, path, slice_bytes=16 * 1024)
    return ranges.select(
        "binomial",
        "legend",
        F.size("rings").alias("n_rings"),
        *[F.get(F.get("rings", F.lit(ring)), F.lit(at))[axis].alias(name) for name, (ring, at, axis) in corner.items()],
    )


@query("a8_write_tsv", "select state_id, label, character_id, character_value, taxonvariant_id from fx_states")
def _(spark, sf):
    path = scratch(spark)
    write_tsv(view(spark, sf, "fx_states"), path)
    return read_tsv(spark, path, TABLES["states"])


SPECIES_RECORDS_SQL = """select o.gbif_id, x.taxon_name, o.decimal_latitude, o.decimal_longitude, replace(x.taxon_name, ' ', '_') as species
from fx_occurrences o join fx_taxonvariants v on o.taxonvariant_id = v.taxonvariant_id join fx_taxa x on v.taxon_id = x.taxon_id
where x.taxon_level = 'SPECIES'"""


@query("a9_write_species_csv", SPECIES_RECORDS_SQL)
def _(spark, sf):
    path = scratch(spark)
    tables = mart(spark, sf)
    records = cut_lineage(
        tables["occurrences"]
        .join(tables["taxonvariants"], "taxonvariant_id")
        .join(tables["taxa"].filter("taxon_level = 'SPECIES'"), "taxon_id")
        .select("gbif_id", "taxon_name", "decimal_latitude", "decimal_longitude")
    )
    # first the aliased species, then all: what is there already must not come twice
    aliased = tables["taxonvariants"].filter("taxonvariant_status = 'synonym'").select("taxon_id")
    names = tables["taxa"].join(aliased, "taxon_id", "left_semi").select("taxon_name")
    write_species_csv(records.join(names, "taxon_name", "left_semi"), path)
    write_species_csv(records, path)
    return read_species_csv(spark, path, "gbif_id long, taxon_name string, decimal_latitude double, decimal_longitude double")


@query(
    "a10_insert_if_absent",
    """select distinct * from fx_occurrences where basis_of_record <> 'PRESERVED_SPECIMEN' or taxonvariant_id is null""",
)
def _(spark, sf):
    occ = view(spark, sf, "fx_occurrences")
    stored = occ.filter("basis_of_record = 'PRESERVED_SPECIMEN' and taxonvariant_id is not null")
    return insert_if_absent(occ.unionByName(occ), stored)


@query(
    "a11_backfill_fk",
    """select o.occurrence_id, o.label, coalesce(m.taxonvariant_id, o.taxonvariant_id) as taxonvariant_id
from fx_occurrences o left join (select taxonvariant_name, 2 * taxon_id as taxonvariant_id from fx_taxonvariants where taxonvariant_status = 'synonym') m
on o.label = m.taxonvariant_name""",
)
def _(spark, sf):
    tables = mart(spark, sf)
    synonyms = tables["taxonvariants"].filter("taxonvariant_status = 'synonym'")
    label_map = synonyms.select(F.col("taxonvariant_name").alias("label"), (F.col("taxon_id") * 2).alias("taxonvariant_id"))
    return backfill_fk(tables["occurrences"], label_map).select("occurrence_id", "label", "taxonvariant_id")


@query(
    "a12_write_newick",
    """with leaves as (select tree_id, parent_id, string_agg(concat(replace(label, ' ', '_'), ':', cast(branch_length as string)), ',' order by node_id) as inner_text
  from fx_customer_trees where node_id >= 100 group by tree_id, parent_id),
states as (select n.tree_id, string_agg(concat('(', l.inner_text, ')', n.label, ':', cast(n.branch_length as string)), ',' order by n.node_id) as inner_text
  from fx_customer_trees n join leaves l on l.tree_id = n.tree_id and l.parent_id = n.node_id where n.node_id between 2 and 4 group by n.tree_id)
select n.tree_id, concat('(', s.inner_text, ')', replace(n.label, ' ', '_'), ';') as newick from fx_customer_trees n join states s on s.tree_id = n.tree_id where n.node_id = 1""",
)
def _(spark, sf):
    return write_newick(view(spark, sf, "fx_customer_trees")).select("tree_id", "newick")


@query(
    "a12_newick_fragments",
    """with recursive kids as (select t.*, row_number() over (partition by t.parent_id order by t.node_id) = 1 as first, exists (select 1 from fx_taxonomy c where c.parent_id = t.node_id) as is_inner from fx_taxonomy t),
walk as (select node_id as root_id, node_id, [node_id] as path, concat(replace(label, ' ', '_')) as own, '' as comma, is_inner from kids where parent_id is null
  union all select w.root_id, k.node_id, list_append(w.path, k.node_id), concat(replace(k.label, ' ', '_'), ':', cast(k.branch_length as string)), case when k.first then '' else ',' end, k.is_inner from walk w join kids k on k.parent_id = w.node_id),
pieces as (select root_id, path as key, case when is_inner then concat(comma, '(') else concat(comma, own) end as text, len(path) = 1 and not is_inner as ends from walk
  union all select root_id, list_append(path, 9223372036854775807), concat(')', own), len(path) = 1 from walk where is_inner)
select root_id, row_number() over (partition by root_id order by key) as ordinal, case when ends then concat(text, ';') else text end as fragment from pieces""",
)
def _(spark, sf):
    return newick_fragments(view(spark, sf, "fx_taxonomy")).select("root_id", "ordinal", "fragment")


@query("a6_nexus_trees", "select c_name as tree_name, concat('(', replace(c_name, '#', '_'), ':', cast(c_custkey as string), ',B:2);') as newick from customer")
def _(spark, sf):
    newick = F.concat(F.lit("("), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(":"), F.col("c_custkey").cast("string"), F.lit(",B:2);"))
    head = F.when(F.col("c_custkey") % 2 == 0, "  tree '").otherwise("\tUTREE * '")
    rows = base(spark, sf, "customer")
    lines = rows.select(F.concat(head, "c_name", F.lit("' = "), newick).alias("value"))
    others = rows.select(F.concat(F.lit("  "), "c_name", F.lit(" tree = of life;")).alias("value"))
    return nexus_trees(lines.unionByName(others))


REJECTED = "select tree_name from (select distinct cast(tree_id as string) as tree_name, tree_id % 5 as kind from fx_customer_trees) t where kind < 3"


def spoilt(text, kind):
    """Texts of kind 0 lack a bracket, those of kind 1 have a second root, those of kind 2 a length that is no number."""
    return F.when(kind == 0, F.concat(F.lit("("), text)).when(kind == 1, F.concat(F.lit("Other,"), text)).when(kind == 2, F.replace(text, F.lit(":1.5"), F.lit(":long"))).otherwise(text)


@query("a6_newick_rejects", REJECTED)
def _(spark, sf):
    texts = customer_texts(spark, sf)
    return newick_rejects(texts.select("tree_name", spoilt(F.col("newick"), F.col("tree_id") % 5).alias("newick"))).select("tree_name")


@query(
    "a6_fragment_rejects",
    REJECTED.replace(
        "select tree_name from",
        "select tree_name, case kind when 0 then 'brackets are not balanced' when 1 then 'more than one root' else 'a length is not a number' end as error from",
    ),
)
def _(spark, sf):
    pieces = newick_fragments(view(spark, sf, "fx_customer_trees"))
    kind = F.col("tree_id") % 5
    text = F.when((F.col("ordinal") == 1) | (kind == 2), spoilt(F.col("fragment"), kind)).otherwise(F.col("fragment"))
    return fragment_rejects(pieces.select(F.col("tree_id").cast("string").alias("tree_name"), "ordinal", text.alias("fragment")))


@query(
    "a13_matrix_lines",
    """select concat(replace(taxon_name, ' ', '_'), ' ', coalesce(arg_max(case when label = 't1_size' then character_value end, case when label = 't1_size' then state_id end), '?'), ' ',
  coalesce(arg_max(case when label = 't2_price' then character_value end, case when label = 't2_price' then state_id end), '?')) as line
from (select x.taxon_name, c.label, s.character_value, s.state_id from fx_states s join fx_characters c on s.character_id = c.character_id
  join fx_taxonvariants v on s.taxonvariant_id = v.taxonvariant_id join fx_taxa x on v.taxon_id = x.taxon_id where c.data_source = 'parts') t
group by taxon_name""",
)
def _(spark, sf):
    continuous, _ = character_matrix(labelled_states(spark, sf), KINDS)
    return matrix_lines(continuous)


# a character for every month of orders, a line for every customer; the last order of the month counts
@query(
    "a13_character_lines",
    """with held as (select o_custkey, substring(cast(cast(o_orderdate as date) as string), 1, 7) as month, arg_max(cast(floor(o_totalprice) as bigint), o_orderkey) as cell from orders group by 1, 2),
months as (select distinct month from held), taxa as (select distinct o_custkey from held)
select concat('Customer_', cast(t.o_custkey as string), ' ', string_agg(coalesce(cast(h.cell as string), '?'), ' ' order by m.month)) as line, count(*) as n_cells
from taxa t join months m on true left join held h on h.o_custkey = t.o_custkey and h.month = m.month group by t.o_custkey""",
)
def _(spark, sf):
    orders = base(spark, sf, "orders")
    month = F.substring(F.col("o_orderdate").cast("date").cast("string"), 1, 7)
    states = orders.select(
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("taxon_name"), month.alias("character_label"),
        F.floor("o_totalprice").cast("string").alias("character_value"), F.col("o_orderkey").alias("state_id"),
    )
    return character_lines(states, states.select("character_label"))
