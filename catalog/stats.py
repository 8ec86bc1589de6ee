"""Statistics, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import base, mart, view
from catalog.registry import in_order, query, r6
from catalog.trees import TIPS, path_length
from phylomart.operators.hierarchy import interior_paths, node_paths
from phylomart.operators.occurrences import latitude_summary
from phylomart.operators.stats import complete_cases, gower_distance, mantel_test, regress_origin


# the p-value by the finite sums for whole degrees of freedom
@query("d15_regress_origin", """with s as (select taxonvariant_id, avg(abs(decimal_latitude)) as x, max(decimal_latitude) - min(decimal_latitude) as y from fx_occurrences group by taxonvariant_id),
m as (select count(*) as n, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy from s),
f as (select sxy / sxx as slope, sqrt((syy - sxy * sxy / sxx) / (n - 1) / sxx) as std_error, sxy * sxy / sxx / syy as r_squared, n - 1 as df from m),
g as (select *, slope / std_error as t_value, atan(abs(slope / std_error) / sqrt(df)) as angle from f),
k as (select df, angle, i, sum(case when i = 0 then 0 when df % 2 = 0 then ln((2 * i - 1) / (2.0 * i)) else ln(2 * i / (2 * i + 1.0)) end) over (order by i) + 2 * i * ln(cos(angle)) as lt
  from g join range(0, 10000000) r(i) on i < df // 2),
a as (select sum(exp(lt)) as total from k)
select round(slope, 6) as slope, round(std_error, 6) as std_error, round(t_value, 6) as t_value, round(r_squared, 6) as r_squared, df,
  round(1 - case when df % 2 = 0 then sin(angle) * total else 2 / pi() * (angle + sin(angle) * cos(angle) * coalesce(total, 0)) end, 6) + 0.0 as p_value from g cross join a""")
def _(spark, sf):
    fit = regress_origin(latitude_summary(view(spark, sf, "fx_occurrences"), "taxonvariant_id"), "average_absolute_latitude", "latitudinal_range")
    return fit.select(*[r6(c).alias(c) for c in ("slope", "std_error", "t_value", "r_squared", "p_value")], "df")


SPANS = """spans as (select max(t1) - min(t1) as s1, max(t2) - min(t2) as s2, max(t3) - min(t3) as s3 from fx_gower)"""
GOWER_PAIRS = f"""{SPANS}, gaps as (select a.item, b.item as other, abs(a.t1 - b.t1) / s1 as g1, abs(a.t2 - b.t2) / s2 as g2, abs(a.t3 - b.t3) / s3 as g3
  from fx_gower a join fx_gower b on a.item <> b.item cross join spans),
pairs as (select item, other, (coalesce(g1, 0) + coalesce(g2, 0) + coalesce(g3, 0)) / nullif((case when g1 is null then 0 else 1 end + case when g2 is null then 0 else 1 end + case when g3 is null then 0 else 1 end), 0) as d from gaps)"""


@query("f3_gower_distance", f"""with {GOWER_PAIRS} select item, count(d) as defined_pairs, count(*) - count(d) as undefined_pairs, round(sum(d), 5) as total_distance, round(avg(d), 6) as mean_distance from pairs group by item""")
def _(spark, sf):
    rows = gower_distance(view(spark, sf, "fx_gower"), "item", ["t1", "t2", "t3"])
    return rows.select("item", "defined_pairs", "undefined_pairs", F.round("total_distance", 5).alias("total_distance"), r6("mean_distance").alias("mean_distance"))


# what a customer spent in each two months of seven years, where anything: a sparse trait each
MONTHS = [f"m{i}" for i in range(40)]
SPENDING = "select o_custkey as item, " + ", ".join(
    f"cast(sum(case when (year(o_orderdate) - 1992) * 6 + (month(o_orderdate) - 1) // 2 = {i} then o_totalprice end) as double) as m{i}" for i in range(40)
) + " from orders group by o_custkey"


def many_traits_sql() -> str:
    """Pairs as rows per shared trait."""
    wide = ", ".join(f"({i}, m{i})" for i in range(40))
    return f"""with wide as ({SPENDING}), long as materialized (select item, k, x from wide, lateral (values {wide}) v(k, x) where x is not null),
spans as (select k, max(x) - min(x) as span from long group by k having max(x) > min(x)),
scaled as materialized (select item, l.k, x / span as x from long l join spans s on s.k = l.k),
pairs as (select a.item, b.item as other, avg(abs(a.x - b.x)) as d from scaled a join scaled b on a.k = b.k and a.item <> b.item group by a.item, b.item),
sums as (select item, count(*) as n, sum(d) as total from pairs group by item)
select w.item, coalesce(n, 0) as defined_pairs, (select count(*) from wide) - 1 - coalesce(n, 0) as undefined_pairs, round(coalesce(total, 0), 5) as total_distance, round(total / n, 6) as mean_distance
from wide w left join sums s on s.item = w.item"""


@query("f3_gower_many_traits", many_traits_sql())
def _(spark, sf):
    period = (F.year("o_orderdate") - 1992) * 6 + F.floor((F.month("o_orderdate") - 1) / 2)
    orders = base(spark, sf, "orders").select(F.col("o_custkey").alias("item"), period.alias("k"), F.col("o_totalprice").cast("double").alias("x"))
    wide = orders.groupBy("item").agg(*[F.sum(F.when(F.col("k") == i, F.col("x"))).alias(m) for i, m in enumerate(MONTHS)])
    rows = gower_distance(wide, "item", MONTHS)
    return rows.select("item", "defined_pairs", "undefined_pairs", F.round("total_distance", 5).alias("total_distance"), r6("mean_distance").alias("mean_distance"))


@query("b19_complete_cases", f"with {GOWER_PAIRS} select item from pairs group by item having count(*) = count(d)")
def _(spark, sf):
    return complete_cases(gower_distance(view(spark, sf, "fx_gower"), "item", ["t1", "t2", "t3"])).select("item")


PERMUTATIONS = 99


@query("f4_mantel_test", f"""with {TIPS}, spans as (select max(t1) - min(t1) as s1, max(t2) - min(t2) as s2 from fx_tip_traits),
base as (select item, row_number() over (order by item) as place from fx_tip_traits),
labels as (select p.perm, b.item, d.item as other from range(1, {PERMUTATIONS + 1}) p(perm) join base b on true
    join (select q.perm, t.item, row_number() over (partition by q.perm order by md5(concat('5:', cast(q.perm as string), ':', cast(t.item as string)))) as place
      from range(1, {PERMUTATIONS + 1}) q(perm) join fx_tip_traits t on true) d on d.perm = p.perm and d.place = b.place
  union all select 0, item, item from base),
traits as (select a.item as a, b.item as b, case when a.t1 is null or b.t1 is null then abs(a.t2 - b.t2) / s2 else (abs(a.t1 - b.t1) / s1 + abs(a.t2 - b.t2) / s2) / 2 end as x
  from fx_tip_traits a join fx_tip_traits b on a.item < b.item cross join spans),
steps as (select x.node_id as a, y.node_id as b, {path_length('x', 'y')} as y from tips x join tips y on x.node_id <> y.node_id),
rs as (select l.perm, corr(t.x, s.y) as r, count(*) as n from traits t join labels l on l.item = t.a join labels k on k.item = t.b and k.perm = l.perm
  join steps s on s.a = l.other and s.b = k.other group by l.perm),
seen as (select r, n from rs where perm = 0)
select round(s.r, 6) as r, round((1 + (select count(*) from rs q where q.perm > 0 and q.r >= s.r - 1e-12)) / {PERMUTATIONS + 1}.0, 6) as p_value, cast({PERMUTATIONS} as bigint) as permutations, s.n as n_pairs from seen s""")
def _(spark, sf):
    tree = view(spark, sf, "fx_phylogeny")
    paths = node_paths(tree.filter("label <> ''"), interior_paths(tree)).select(F.col("node_id").alias("item"), "path", "depths")
    found = mantel_test(view(spark, sf, "fx_tip_traits"), "item", ["t1", "t2"], paths, PERMUTATIONS, seed=5)
    return found.select(r6("r").alias("r"), r6("p_value").alias("p_value"), "permutations", "n_pairs")


@query("s1_order_by", "select taxon_id, taxon_name, row_number() over (order by taxon_name, taxon_id) as position from fx_taxa")
def _(spark, sf):
    return in_order(view(spark, sf, "fx_taxa").select("taxon_id", "taxon_name").orderBy("taxon_name", "taxon_id"))


@query("s2_order_bytes", "select taxon, charname, row_number() over (order by taxon, charname) as position from (select distinct taxon, charname from fx_triples) t")
def _(spark, sf):
    return in_order(view(spark, sf, "fx_triples").select("taxon", "charname").distinct().orderBy("taxon", "charname"))


@query("s3_limit_k", "select taxon_name, taxon_id from fx_taxa order by taxon_name, taxon_id limit 100")
def _(spark, sf):
    return view(spark, sf, "fx_taxa").select("taxon_name", "taxon_id").orderBy("taxon_name", "taxon_id").limit(100)


@query("s4_union_all", """select page_id, predicate from fx_trait_edges where units is not null union all select page_id, predicate from fx_trait_edges where object_term is not null""")
def _(spark, sf):
    edges = view(spark, sf, "fx_trait_edges")
    literals = edges.filter("units is not null").select("page_id", "predicate")
    return literals.unionByName(edges.filter("object_term is not null").select("page_id", "predicate"))


@query("s5_union_distinct", "select label from fx_taxonomy union select label from fx_phylogeny")
def _(spark, sf):
    return view(spark, sf, "fx_taxonomy").select("label").union(view(spark, sf, "fx_phylogeny").select("label")).distinct()


@query("s6_difference", "select label from fx_phylogeny except select binomial from fx_traits_wide where t2_price not in ('', 'n/a')")
def _(spark, sf):
    return view(spark, sf, "fx_phylogeny").select("label").subtract(view(spark, sf, "fx_traits_wide").filter("t2_price not in ('', 'n/a')").select("binomial"))


@query("s7_intersection", """select v.taxon_id from fx_taxonvariants v join fx_occurrences o on o.taxonvariant_id = v.taxonvariant_id
intersect select v.taxon_id from fx_taxonvariants v join fx_states s on s.taxonvariant_id = v.taxonvariant_id""")
def _(spark, sf):
    tables = mart(spark, sf)
    variants = tables["taxonvariants"].select("taxonvariant_id", "taxon_id")
    used = [variants.join(tables[n].select("taxonvariant_id").distinct(), "taxonvariant_id", "left_semi").select("taxon_id") for n in ("occurrences", "states")]
    return used[0].intersect(used[1])
