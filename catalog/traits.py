"""Trait queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import mart, view
from catalog.registry import query
from phylomart.operators.cleaning import keep_observed, to_numeric
from phylomart.operators.joins import map_local_ids, trait_lookup
from phylomart.operators.keys import collect_values, first_seen_ids, keep_groups_by_first_value
from phylomart.operators.stats import model_frame
from phylomart.operators.traits import accepted_branch, character_matrix, filter_characters, melt_traits, trait_set
from phylomart.plans.traits import build_triples_traits, load_traits
from phylomart.runtime import with_position

KINDS = {"t1_size": "continuous", "t2_price": "continuous", "t3_disc": "discrete"}

STATES_SQL = """select x.taxon_name, c.char_id, c.label as character_label, s.state_id, s.character_value from fx_states s
  join fx_characters c on s.character_id = c.character_id join fx_taxonvariants v on s.taxonvariant_id = v.taxonvariant_id
  join fx_taxa x on v.taxon_id = x.taxon_id where c.data_source = 'parts'"""


def labelled_states(spark, sf):
    """Whitelisted states under their taxon name."""
    return trait_lookup(mart(spark, sf), "parts")


def cell(label: str) -> str:
    """SQL for the last state of one character."""
    return f"arg_max(case when character_label = '{label}' then character_value end, case when character_label = '{label}' then state_id end)"


MELT_SQL = """select binomial as label, cast(i as bigint) as character_id, character_value from (
  select binomial, 1 as i, t1_size as character_value from fx_traits_wide union all select binomial, 2, t2_price from fx_traits_wide
  union all select binomial, 3, t3_refs from fx_traits_wide) t
where contains(character_value, ';') or (try_cast(character_value as double) is not null and try_cast(character_value as double) <> -999)"""


@query(
    "b11_keep_observed",
    """select binomial, t1_size, t3_refs from fx_traits_wide where contains(t3_refs, ';') or (try_cast(t3_refs as double) is not null and try_cast(t3_refs as double) <> -999)
union all select binomial, t1_size, t2_price from fx_traits_wide where contains(t2_price, ';') or (try_cast(t2_price as double) is not null and try_cast(t2_price as double) <> -999)""",
)
def _(spark, sf):
    wide = view(spark, sf, "fx_traits_wide")
    refs = keep_observed(wide, "t3_refs").select("binomial", "t1_size", "t3_refs")
    prices = keep_observed(wide, "t2_price").select("binomial", "t1_size", F.col("t2_price").alias("t3_refs"))
    return refs.unionByName(prices)


@query(
    "b12_filter_characters",
    """select s.state_id, s.character_value, c.label as character_label, case when c.label = 't3_disc' then 'discrete' else 'continuous' end as kind
from fx_states s join fx_characters c on s.character_id = c.character_id where c.data_source = 'parts' and c.label in ('t1_size', 't2_price', 't3_disc')""",
)
def _(spark, sf):
    tables = mart(spark, sf)
    kept = filter_characters(tables["states"], tables["characters"], "parts", KINDS)
    return kept.select("state_id", "character_value", "character_label", "kind")


@query(
    "b18_to_numeric",
    """select s.state_id, try_cast(s.character_value as double) as as_double, cast(trunc(try_cast(s.character_value as double)) as bigint) as as_integer
from fx_states s union all select row_number() over (order by binomial) * 10 + 9, try_cast(t2_price as double), cast(trunc(try_cast(t2_price as double)) as bigint) from fx_traits_wide""",
)
def _(spark, sf):
    states = view(spark, sf, "fx_states").select("state_id", "character_value")
    # numbered by name, and parts of one name by their key, so that the numbers do not hang on the order of rows in a file
    cents = F.round(F.col("p_retailprice") * 100).cast("long").cast("string")
    price = F.when(F.col("p_partkey") % 10 == 0, "").when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(cents)
    wide = view(spark, sf, "fx_part").select(F.col("c_name").alias("binomial"), "p_partkey", price.alias("t2_price"))
    prices = with_position(wide, ["binomial", "p_partkey"], "n").select((F.col("n") * 10 + 9).alias("state_id"), F.col("t2_price").alias("character_value"))
    both = states.unionByName(prices).select("state_id", F.col("character_value").alias("as_double"), F.col("character_value").alias("as_integer"))
    return to_numeric(to_numeric(both, ["as_double"]), ["as_integer"], integer=True)


@query("c2_map_local_ids", f"select label, character_id + 70 as character_id, character_value from ({MELT_SQL}) m")
def _(spark, sf):
    states, _ = melt_traits(view(spark, sf, "fx_traits_wide"), "binomial", "parts")
    return map_local_ids(states, view(spark, sf, "fx_characters").filter("data_source = 'parts'"))


@query("c5_trait_lookup", STATES_SQL)
def _(spark, sf):
    return labelled_states(spark, sf)


@query("d3_collect_values", "select taxon, charname, line, state, row_number() over (partition by taxon, charname order by line) as position from fx_triples")
def _(spark, sf):
    return collect_values(view(spark, sf, "fx_triples")).select("taxon", "charname", "line", "state", "position")


KEPT_TRIPLES = """select * from fx_triples where taxon in (select taxon from (select taxon, state, row_number() over (partition by taxon order by line) as rn
  from fx_triples where charname = 'extinction status') f where rn = 1 and state = 'extant')"""


@query("d4_keep_groups_by_first_value", f"select line, taxon, charname, state from ({KEPT_TRIPLES}) k")
def _(spark, sf):
    kept = keep_groups_by_first_value(view(spark, sf, "fx_triples"), "extinction status", "extant")
    return kept.select("line", "taxon", "charname", "state")


@query("d8_trait_set", f"""select n.taxon_name, t1_size, t2_price, t3_disc from (select distinct taxon_name from fx_taxa where taxon_level in ('SPECIES', 'FAMILY')) n
left join (select taxon_name, {cell('t1_size')} as t1_size, {cell('t2_price')} as t2_price, {cell('t3_disc')} as t3_disc from ({STATES_SQL}) s group by taxon_name) w
on n.taxon_name = w.taxon_name""")
def _(spark, sf):
    tables = mart(spark, sf)
    return trait_set(tables["taxa"].filter("taxon_level in ('SPECIES', 'FAMILY')"), tables, "parts")


@query("d9_character_matrix", f"""select taxon_name, coalesce({cell('t1_size')}, '?') as t1_size, coalesce({cell('t2_price')}, '?') as t2_price,
  coalesce(cast(cast(trunc(try_cast({cell('t3_disc')} as double)) as bigint) as string), '?') as t3_disc from ({STATES_SQL}) s group by taxon_name""")
def _(spark, sf):
    continuous, discrete = character_matrix(labelled_states(spark, sf), KINDS)
    return continuous.join(discrete, "taxon_name")


@query("d10_melt_traits", MELT_SQL)
def _(spark, sf):
    return melt_traits(view(spark, sf, "fx_traits_wide"), "binomial", "parts")[0]


FIRST_SEEN = "select charname, row_number() over (order by taxon, line) as char_id from (select charname, taxon, line, row_number() over (partition by charname order by taxon, line) as rn from {src}) f where rn = 1"


@query("d12_first_seen_ids", FIRST_SEEN.format(src="fx_triples"))
def _(spark, sf):
    return first_seen_ids(view(spark, sf, "fx_triples"))


@query("d16_accepted_branch", """select taxon_id, node_id, branch_id, taxonvariant_id from (
  select v.taxon_id, b.node_id, b.branch_id, b.taxonvariant_id, row_number() over (partition by v.taxon_id order by case when v.taxonvariant_status = 'accepted' then 0 else 1 end, b.node_id) as rn
  from fx_branches b join fx_taxonvariants v on b.taxonvariant_id = v.taxonvariant_id where b.tree_id = 12) t where rn = 1""")
def _(spark, sf):
    tables = mart(spark, sf)
    return accepted_branch(tables["branches"], tables["taxonvariants"], 12).select("taxon_id", "node_id", "branch_id", "taxonvariant_id")


@query("f5_model_frame", """select w.binomial as label, try_cast(w.t1_size as double) as response, try_cast(w.t2_price as double) as predictor_1
from fx_traits_wide w where w.binomial in (select label from fx_phylogeny)""")
def _(spark, sf):
    wide = to_numeric(view(spark, sf, "fx_traits_wide").drop("t3_refs"), ["t1_size", "t2_price"]).withColumnRenamed("binomial", "label")
    frame = model_frame(wide, view(spark, sf, "fx_phylogeny"), "t1_size")
    return frame.select("label", "response", F.col("predictors")[0].alias("predictor_1"))


@query("g5_build_triples_traits", f"""with kept as ({KEPT_TRIPLES}), ids as ({FIRST_SEEN.format(src='kept')})
select k.taxon as label, i.char_id as character_id, k.charname as character_label, k.state as character_value, k.line from kept k join ids i on k.charname = i.charname""")
def _(spark, sf):
    characters, states = build_triples_traits(view(spark, sf, "fx_triples"), "triples")
    named = characters.select(F.col("char_id").alias("character_id"), F.col("label").alias("character_label"))
    return states.join(named, "character_id").select("label", "character_id", "character_label", "character_value", "line")


@query("g6_load_traits", f"""with melted as ({MELT_SQL}), top as (select max(character_id) as n from fx_characters),
named as (select m.label, m.character_id + top.n as character_id, m.character_value, v.taxonvariant_id
  from melted m cross join top left join fx_taxonvariants v on v.taxonvariant_name = m.label)
select row_number() over (order by label, character_id, character_value) + (select max(state_id) from fx_states) as state_id, * from named""")
def _(spark, sf):
    states, characters = melt_traits(view(spark, sf, "fx_traits_wide"), "binomial", "new parts")
    return load_traits(characters, states, mart(spark, sf))[1]
