"""Hierarchy and tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import base, mart, view
from catalog.registry import query, r6
from catalog.traits import KINDS
from phylomart.operators import hierarchy as h
from phylomart.operators import trees as t
from phylomart.operators.names import resolve_names
from phylomart.plans.by_name import expand_by_name, make_phylo
from phylomart.plans.dataset import build_dataset

# Path of fixed depth in the phylogeny: customer - nation - region - stem - root.
TIPS = """tips as (select c.node_id, c.label, c.branch_length as l0, n.node_id as n1, n.branch_length as l1, r.node_id as n2, r.branch_length as l2, s.node_id as n3, s.branch_length as l3
  from fx_phylogeny c join fx_phylogeny n on c.parent_id = n.node_id join fx_phylogeny r on n.parent_id = r.node_id join fx_phylogeny s on r.parent_id = s.node_id where c.label <> '')"""


def path_length(a: str, b: str) -> str:
    """Path length between two tips of ``TIPS``."""
    return f"""({a}.l0 + {b}.l0 + case when {a}.n1 = {b}.n1 then 0 else {a}.l1 + {b}.l1 + case when {a}.n2 = {b}.n2 then 0 else {a}.l2 + {b}.l2 + {a}.l3 + {b}.l3 end end)"""


def tree_shape(df):
    return df.select("tree_id", "node_id", "parent_id", r6("branch_length").alias("branch_length"))


@query("e1_expand_taxon", """with recursive walk as (select node_id as root_id, node_id, label, lvl from fx_taxonomy where lvl in ('ORDER', 'SPECIES')
  union all select w.root_id, c.node_id, c.label, c.lvl from walk w join fx_taxonomy c on c.parent_id = w.node_id where w.lvl <> 'SPECIES')
select root_id, node_id, label as taxon_name from walk where lvl = 'SPECIES'""")
def _(spark, sf):
    tables = mart(spark, sf)
    roots = view(spark, sf, "fx_taxonomy").filter("lvl in ('ORDER', 'SPECIES')").select("node_id")
    found = h.expand_taxon(tables["branches"], tables["taxonvariants"], tables["taxa"], roots)
    return found.select("root_id", "node_id", "taxon_name")


@query("e1_expand_taxon_children", """with recursive walk as (select node_id as root_id, node_id, label, cast('' as string) as lvl from fx_taxonomy where lvl in ('FAMILY', 'SPECIES')
  union all select w.root_id, c.node_id, c.label, c.lvl from walk w join fx_taxonomy c on c.parent_id = w.node_id where w.lvl <> 'SPECIES')
select root_id, node_id, label as taxon_name from walk where lvl = 'SPECIES'""")
def _(spark, sf):
    tables = mart(spark, sf)
    roots = view(spark, sf, "fx_taxonomy").filter("lvl in ('FAMILY', 'SPECIES')").select("node_id")
    found = h.expand_taxon(tables["branches"], tables["taxonvariants"], tables["taxa"], roots, include_start=False)
    return found.select("root_id", "node_id", "taxon_name")


# customers in debt: tips over all regions of the phylogeny, and their places in the taxonomy forest
DEBTORS = "select 1000 + c_custkey as node_id from customer where c_acctbal < 0"
BOTH_TREES = "(select node_id, parent_id, branch_length, label, tree_id from fx_phylogeny union all select node_id, parent_id, branch_length, label, tree_id from fx_taxonomy)"


def both_trees(spark, sf):
    shape = ["node_id", "parent_id", "branch_length", "label", "tree_id"]
    return view(spark, sf, "fx_phylogeny").select(*shape).unionByName(view(spark, sf, "fx_taxonomy").select(*shape))


def debtors(spark, sf):
    tips = base(spark, sf, "customer").filter("c_acctbal < 0")
    return tips.select(F.explode(F.array(F.lit(11), F.lit(12)).cast("array<bigint>")).alias("tree_id"), (F.col("c_custkey") + 1000).alias("node_id"))


INDUCED = f"""closure as (select t.tree_id, t.node_id, t.parent_id, t.branch_length from {BOTH_TREES} t where t.node_id in ({DEBTORS})
  union select p.tree_id, p.node_id, p.parent_id, p.branch_length from closure c join {BOTH_TREES} p on p.tree_id = c.tree_id and p.node_id = c.parent_id),
roots as (select c.tree_id, c.node_id as root, c.node_id from closure c where c.parent_id is null union all
  select r.tree_id, r.root, c.node_id from roots r join closure c on c.tree_id = r.tree_id and c.parent_id = r.node_id),
tip_count as (select tree_id, root, count(*) as n from roots where node_id in ({DEBTORS}) group by tree_id, root),
under as (select c.tree_id, c.node_id as above, c.node_id from closure c union all select u.tree_id, u.above, c.node_id from under u join closure c on c.tree_id = u.tree_id and c.parent_id = u.node_id),
covers as (select u.tree_id, u.above as node_id from under u join roots r on r.tree_id = u.tree_id and r.node_id = u.above join tip_count n on n.tree_id = u.tree_id and n.root = r.root
  where u.node_id in ({DEBTORS}) group by u.tree_id, u.above, n.n having count(*) = n.n),
heads as (select c.tree_id, c.node_id from covers c where not exists (select 1 from covers d join closure k on k.tree_id = d.tree_id and k.node_id = d.node_id where d.tree_id = c.tree_id and k.parent_id = c.node_id)),
induced as (select c.tree_id, c.node_id, case when h.node_id is null then c.parent_id end as parent_id, case when h.node_id is null then c.branch_length end as branch_length
  from closure c join under u on u.tree_id = c.tree_id and u.node_id = c.node_id join heads g on g.tree_id = u.tree_id and g.node_id = u.above
  left join heads h on h.tree_id = c.tree_id and h.node_id = c.node_id)"""


@query("e3_induced_subtree", f"with recursive {INDUCED} select tree_id, node_id, parent_id, round(branch_length, 6) as branch_length from induced")
def _(spark, sf):
    return tree_shape(h.induced_subtree(both_trees(spark, sf), debtors(spark, sf)))


@query("e3_make_phylo", f"with recursive {INDUCED} select tree_id, node_id, parent_id, round(branch_length, 6) as branch_length from induced where tree_id = 12")
def _(spark, sf):
    names = base(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_name").alias("taxon_name"))
    unknown = view(spark, sf, "fx_messy_names").select(F.concat(F.lit("no such "), "label").alias("taxon_name"))
    return tree_shape(make_phylo(names.unionByName(unknown), mart(spark, sf), 12))


@query("e1_expand_by_name", """select n_name as taxon_name, 1000 + c_custkey as node_id, c_name as expanded_name from nation join customer on c_nationkey = n_nationkey
union all select c_name, 1000 + c_custkey, c_name from customer where c_acctbal < 0""")
def _(spark, sf):
    nations = base(spark, sf, "nation").select(F.col("n_name").alias("taxon_name"))
    customers = base(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_name").alias("taxon_name"))
    return expand_by_name(nations.unionByName(customers).unionByName(customers), mart(spark, sf))


def collapsed(source: str, out: str) -> str:
    """SQL of the one-child rule: every kept node walks up past removed ancestors."""
    return f"""{out}_single as (select tree_id, parent_id as node_id from {source} where parent_id is not null group by tree_id, parent_id having count(*) = 1),
{out}_climb as (select s.tree_id, s.node_id, s.parent_id, s.branch_length from {source} s where not exists (select 1 from {out}_single x where x.tree_id = s.tree_id and x.node_id = s.node_id)
  union all select c.tree_id, c.node_id, s.parent_id, c.branch_length + s.branch_length from {out}_climb c join {source} s on s.tree_id = c.tree_id and s.node_id = c.parent_id
  join {out}_single x on x.tree_id = s.tree_id and x.node_id = s.node_id),
{out} as (select c.tree_id, c.node_id, c.parent_id, case when c.parent_id is not null then c.branch_length end as branch_length from {out}_climb c
  left join {out}_single x on x.tree_id = c.tree_id and x.node_id = c.parent_id where x.node_id is null)"""


@query("e4_collapse_unary", f"with recursive {collapsed('fx_phylogeny', 'slim')} select tree_id, node_id, parent_id, round(branch_length, 6) as branch_length from slim")
def _(spark, sf):
    return tree_shape(h.collapse_unary(view(spark, sf, "fx_phylogeny")))


@query("e6_drop_tips", f"with recursive {INDUCED}, {collapsed('induced', 'slim')} select tree_id, node_id, parent_id, round(branch_length, 6) as branch_length from slim where tree_id = 12")
def _(spark, sf):
    tree = view(spark, sf, "fx_phylogeny")
    solvent = base(spark, sf, "customer").filter("not c_acctbal < 0").select(F.lit(12).cast("bigint").alias("tree_id"), (F.col("c_custkey") + 1000).alias("node_id"))
    return tree_shape(h.drop_tips(tree, solvent))


# suppliers' nations dangle: their parent is not in the tree
DANGLING = """(select tree_id, node_id, parent_id, label from fx_taxonomy union all
  select cast(11 as bigint), 700000000 + s_suppkey, cast(600000000 + s_nationkey as bigint), s_name from supplier)"""


@query("e8_roots_and_orphans", f"""select tree_id, node_id, parent_id, label, case when parent_id is null then 'root' else 'orphan' end as kind from {DANGLING} t
where parent_id is null or parent_id not in (select node_id from fx_taxonomy)""")
def _(spark, sf):
    shape = ["tree_id", "node_id", "parent_id", "label"]
    tree = view(spark, sf, "fx_taxonomy").select(*shape)
    extra = base(spark, sf, "supplier").select(
        F.lit(11).cast("bigint").alias("tree_id"), (F.col("s_suppkey") + 700000000).alias("node_id"),
        (F.col("s_nationkey") + 600000000).cast("bigint").alias("parent_id"), F.col("s_name").alias("label"),
    )
    return h.roots_and_orphans(tree.unionByName(extra))


@query("e9_resolve_polytomies", f"""with ranked as (select *, row_number() over (partition by tree_id, parent_id order by node_id) - 1 as r, count(*) over (partition by tree_id, parent_id) as k
  from {BOTH_TREES} b where parent_id is not null),
spots as (select tree_id, parent_id as top, node_id, branch_length, k + r as spot from ranked where k > 2
  union all select tree_id, parent_id, -node_id - 1, 0.0, r + 2 from ranked where k > 2 and r < k - 2)
select tree_id, node_id, parent_id, round(branch_length, 6) as branch_length from ranked where k <= 2
union all select tree_id, node_id, parent_id, branch_length from {BOTH_TREES} q where parent_id is null
union all select s.tree_id, s.node_id, case when s.spot // 2 = 1 then s.top else m.node_id end, round(s.branch_length, 6)
from spots s left join spots m on m.tree_id = s.tree_id and m.top = s.top and m.spot = s.spot // 2 and m.node_id < 0""")
def _(spark, sf):
    return tree_shape(t.resolve_polytomies(both_trees(spark, sf)))


CONTRAST_LEVELS = 24  # a node with k children adds log2(k) levels: room for a million customers per nation


def contrasts_sql() -> str:
    """Contrasts by unrolled levels, deepest first, on the collapsed and evenly resolved phylogeny."""
    head = f"""with recursive flat as (select 12 as tree_id, cast(0 as bigint) as node_id, cast(null as bigint) as parent_id, cast(null as double) as len
  union all select 12, r.node_id, 0, r.branch_length + s.branch_length from fx_phylogeny r join fx_phylogeny s on r.parent_id = s.node_id where r.node_id between 1 and 9
  union all select 12, node_id, parent_id, branch_length from fx_phylogeny where node_id >= 100),
ranked as (select *, row_number() over (partition by parent_id order by node_id) - 1 as r, count(*) over (partition by parent_id) as k from flat where parent_id is not null),
spots as (select parent_id as top, node_id, len, case when k > 2 then k + r else 2 + r end as spot from ranked
  union all select parent_id, -node_id - 1, 0.0, r + 2 from ranked where k > 2 and r < k - 2),
tree as materialized (select s.node_id, case when s.spot // 2 = 1 then s.top else m.node_id end as parent_id, s.len
  from spots s left join spots m on m.top = s.top and m.spot = s.spot // 2 and m.node_id < 0 union all select 0, null, 0.0),
down as (select node_id, parent_id, len, 0 as level from tree where parent_id is null union all select t.node_id, t.parent_id, t.len, d.level + 1 from tree t join down d on t.parent_id = d.node_id),
placed as materialized (select * from down),
tips as materialized (select p.node_id, p.parent_id, p.level, x.trait, x.value as x, p.len as v from placed p join
  (select item, 't1' as trait, t1 as value from fx_tip_traits union all select item, 't2', t2 from fx_tip_traits) x on x.item = p.node_id where x.value is not null),
at_{CONTRAST_LEVELS} as materialized (select node_id, parent_id, trait, x, v, 0 as two, cast(null as double) as contrast from tips where level = {CONTRAST_LEVELS})"""
    steps = []
    for level in range(CONTRAST_LEVELS - 1, -1, -1):
        steps.append(
            f"""at_{level} as materialized (select node_id, parent_id, trait, x, v, 0 as two, cast(null as double) as contrast from tips where level = {level}
  union all select p.node_id, p.parent_id, c.trait, case when n = 1 then x1 when v1 + v2 = 0 then (x1 + x2) / 2 else (x1 * v2 + x2 * v1) / (v1 + v2) end,
    p.len + case when n = 1 then v1 when v1 + v2 = 0 then 0 else v1 * v2 / (v1 + v2) end, case when n = 2 then 1 else 0 end, case when n = 2 and v1 + v2 > 0 then x1 - x2 end
  from (select parent_id, trait, count(*) as n, arg_min(x, node_id) as x1, arg_max(x, node_id) as x2, arg_min(v, node_id) as v1, arg_max(v, node_id) as v2 from at_{level + 1} group by parent_id, trait) c
  join placed p on p.node_id = c.parent_id)"""
        )
    rows = " union all ".join(f"select * from at_{level}" for level in range(CONTRAST_LEVELS))
    return (
        ",\n".join([head, *steps])
        + f"\nselect cast(12 as bigint) as tree_id, node_id, trait, round(contrast, 6) as contrast, round(x, 6) as ancestor from ({rows}) a where two = 1"
    )


@query("e10_independent_contrasts", contrasts_sql())
def _(spark, sf):
    tips = view(spark, sf, "fx_phylogeny").select("tree_id", "node_id")
    wide = view(spark, sf, "fx_tip_traits").join(tips, F.col("item") == F.col("node_id"))
    long = wide.unpivot(["tree_id", "node_id"], ["t1", "t2"], "trait", "value")
    found = t.independent_contrasts(view(spark, sf, "fx_phylogeny"), long)
    return found.select("tree_id", "node_id", "trait", r6("contrast").alias("contrast"), r6("ancestor").alias("ancestor"))


# the customers of every order and of the order after it
@query("e11_patristic_distance", f"""with {TIPS}, pairs as (select distinct 1000 + a.o_custkey as a, 1000 + b.o_custkey as b from orders a join orders b on b.o_orderkey = a.o_orderkey + 1)
select p.a, p.b, round(case when p.a = p.b then 0 else {path_length('x', 'y')} end, 6) as distance from pairs p join tips x on x.node_id = p.a join tips y on y.node_id = p.b""")
def _(spark, sf):
    tree = view(spark, sf, "fx_phylogeny")
    orders = base(spark, sf, "orders")
    after = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), (F.col("o_custkey") + 1000).alias("b"))
    pairs = orders.select("o_orderkey", (F.col("o_custkey") + 1000).alias("a")).join(after, "o_orderkey").select(F.lit(12).cast("bigint").alias("tree_id"), "a", "b").distinct()
    return t.patristic_distance(tree, pairs).select("a", "b", r6("distance").alias("distance"))


@query("e11_mean_patristic_distance", f"""with {TIPS} select x.node_id, count(*) as partners, round(avg({path_length('x', 'y')}), 6) as mean_distance from tips x join tips y on x.node_id <> y.node_id group by x.node_id""")
def _(spark, sf):
    tree = view(spark, sf, "fx_phylogeny")
    means = t.mean_patristic_distance(tree, tree.filter("label <> ''"))
    return means.select("node_id", "partners", r6("mean_distance").alias("mean_distance"))


@query("e12_root_to_tip", f"""with recursive down as (select tree_id, node_id, cast(0 as double) as depth, cast(0 as bigint) as level from {BOTH_TREES} b where parent_id is null
  union all select c.tree_id, c.node_id, d.depth + c.branch_length, d.level + 1 from down d join {BOTH_TREES} c on c.tree_id = d.tree_id and c.parent_id = d.node_id)
select d.tree_id, d.node_id, round(d.depth, 6) as depth, d.level, not exists (select 1 from {BOTH_TREES} c where c.tree_id = d.tree_id and c.parent_id = d.node_id) as is_tip from down d""")
def _(spark, sf):
    rows = h.root_to_tip(both_trees(spark, sf))
    return rows.select("tree_id", "node_id", r6("depth").alias("depth"), F.col("level").cast("bigint").alias("level"), "is_tip")


# tree 12 as it is, and tree 13 with its tips stretched to equal depth
STRETCHED = f"""(select node_id, parent_id, branch_length, label, tree_id from fx_phylogeny union all
  select p.node_id, p.parent_id, case when p.label = '' then p.branch_length else 100 - t.l1 - t.l2 - t.l3 end, p.label, cast(13 as bigint) from fx_phylogeny p left join tips t on t.node_id = p.node_id)"""


@query("e12_is_ultrametric", f"""with recursive {TIPS}, trees as {STRETCHED},
down as (select tree_id, node_id, cast(0 as double) as depth from trees where parent_id is null
  union all select c.tree_id, c.node_id, d.depth + c.branch_length from down d join trees c on c.tree_id = d.tree_id and c.parent_id = d.node_id)
select tree_id, max(depth) - min(depth) < 1e-6 as ultrametric from down d where node_id >= 1000 group by tree_id""")
def _(spark, sf):
    tree = view(spark, sf, "fx_phylogeny")
    depths = h.root_to_tip(tree).select("node_id", "depth")
    longer = tree.join(depths, "node_id").withColumn(
        "branch_length", F.when(F.col("label") == "", F.col("branch_length")).otherwise(F.col("branch_length") + 100 - F.col("depth"))
    )
    both = tree.unionByName(longer.drop("depth").withColumn("tree_id", F.lit(13).cast("bigint")))
    return h.is_ultrametric(both)


@query("e13_load_tree", """select (select max(branch_id) from fx_branches) + row_number() over (order by p.node_id) as branch_id, p.node_id, p.parent_id, v.taxonvariant_id, p.branch_length, cast(13 as bigint) as tree_id
from fx_phylogeny p left join fx_taxonvariants v on v.taxonvariant_name = p.label""")
def _(spark, sf):
    tables = mart(spark, sf)
    nodes = view(spark, sf, "fx_phylogeny")
    names = resolve_names(nodes.filter("label <> ''"), tables["taxonvariants"], tables["taxa"], tables["longnames"], tables["synonym_links"])
    _, rows = h.load_tree(nodes, "again", tables["trees"], names.label_map, tables["branches"])
    return rows.select("branch_id", "node_id", "parent_id", "taxonvariant_id", "branch_length", "tree_id")


def dataset(spark, sf):
    tables = mart(spark, sf)
    roots = view(spark, sf, "fx_taxonomy").filter("lvl = 'ORDER'").select("node_id")
    return build_dataset(tables, roots, 11, 12, "parts", KINDS)


@query("g8_build_dataset", """with s as (select x.taxon_name, c.label, s.character_value, s.state_id from fx_states s join fx_characters c on s.character_id = c.character_id
  join fx_taxonvariants v on s.taxonvariant_id = v.taxonvariant_id join fx_taxa x on v.taxon_id = x.taxon_id where c.data_source = 'parts'),
m as (select taxon_name, coalesce(arg_max(case when label = 't1_size' then character_value end, case when label = 't1_size' then state_id end), '?') as t1_size from s group by taxon_name)
select x.taxon_id, x.taxon_name, x.taxon_level, x.msw_id, 2 * x.taxon_id as msw_taxonvariant_id, 'SPECIES' as msw_taxonvariant_level, p.node_id, p.node_id * 10 + 2 as branch_id, m.t1_size
from fx_taxa x left join fx_phylogeny p on p.label = x.taxon_name left join m on m.taxon_name = x.taxon_name where x.taxon_level = 'SPECIES'""")
def _(spark, sf):
    built = dataset(spark, sf)
    matrix = built.continuous.select("taxon_name", "t1_size")
    return built.taxa.drop("msw_taxonvariant_label").join(matrix, "taxon_name", "left")


@query("g8_build_dataset_tree", f"with recursive {collapsed('fx_phylogeny', 'slim')} select tree_id, node_id, parent_id, round(branch_length, 6) as branch_length from slim")
def _(spark, sf):
    return tree_shape(dataset(spark, sf).branches)
