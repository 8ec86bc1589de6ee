"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylomart.llm.common import fresh
from phylomart.runtime import cut_lineage, ordinal_within

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = 3  # weights 1, 2, 3, 1, ... in the order of sources
MOST = 3  # times a source, and a document, may be taken
SEED = 42


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = CYCLE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): weights share all sizes, and no target is above ``most`` times its source.

    In order of cap over weight, a source is held at its cap if the even share of what earlier caps leave would
    be above it; the others share the rest by weight. This is where repeated resharing ends. One row per source.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = stats.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double")).withColumn(
        "cap", (most * F.col("source_size")).cast("double")
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = weighed.withColumn("left", left).withColumn("rest", F.sum("weight").over(rest))
    held = share.withColumn("held", F.col("cap") * F.col("rest") <= F.col("weight") * F.col("left"))
    # the first source that is not held fixes the share of all that follow
    first = F.min(F.when(~F.col("held"), F.struct(-F.col("rest"), "left", "rest"))).over(every)
    target = F.when(F.col("held"), F.col("cap")).otherwise(F.col("first.left") * F.col("weight") / F.col("first.rest"))
    return held.withColumn("first", first).select("source", "source_size", target.alias("target"))


def mix(sizes: DataFrame, cycle: int = CYCLE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``sizes`` (doc_id, source, size, any more) with source_size, target and the ``copies`` the mix takes of each row.

    Columns of these names are replaced.

    Inside a source all documents expect target / source_size copies. Rows are numbered by size, then doc_id;
    the prefix sum of expected copies starts at one offset drawn from the seed and the source, and a row is
    emitted once per whole number that its step crosses. Documents of like size stand side by side, so the words
    taken miss the target by less than the source's largest document. Numbering is by range partitions with
    offsets, so a hot source is spread over tasks. A null source is a source of its own, the last; a source
    without words has target 0 and is not taken; repeated rows are rows of their own; reruns agree.
    """
    plain = sizes.drop("source_size", "target", "copies")
    row, place = fresh(plain, "mix_tie"), fresh(plain, "mix_place")
    # rows of one source, size and id are told apart by a number of their own, so that they need not meet in one task
    stored = cut_lineage(plain.withColumn(row, F.monotonically_increasing_id()))
    targets = cut_lineage(source_targets(stored, cycle, most))
    placed = ordinal_within(stored, ["source"], ["size", "doc_id", row], place, stored=True)
    joined = placed.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    key = F.concat(F.lit(f"{seed}|"), F.coalesce("d.source", F.lit("")))
    offset = F.conv(F.substring(F.md5(key), 1, 5), 16, 10).cast("double") / (1 << 20)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(offset + rate * F.col(place)) - F.floor(offset + rate * (F.col(place) - 1))
    return joined.select("d.*", "source_size", "target", crossed.cast("long").alias("copies")).drop(row, place)


def mix_documents(docs: DataFrame, cycle: int = CYCLE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``mix`` takes it, with column ``copy`` from 1 up.

    The rows are written once with a number of their own, so repeated rows and null ids keep their own copies. A
    column called ``copy`` is replaced; all others stay. Texts move only in the join on that number.
    """
    row = fresh(docs, "mix_row")
    kept = cut_lineage(docs.drop("copy").withColumn(row, F.monotonically_increasing_id()))
    sizes = kept.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.col(row).alias("row"))
    taken = cut_lineage(mix(sizes, cycle, most, seed).where("copies > 0").select(F.col("row").alias(row), "copies"))
    # one plan at every size: the counts grow with the documents, so they are never sent to all tasks
    many = kept.join(taken.withColumnRenamed("copies", fresh(docs, "mix_copies")).hint("merge"), row)
    copies = F.sequence(F.lit(1).cast("long"), F.col(many.columns[-1]))
    return many.withColumn("copy", F.explode(copies)).select(*docs.drop("copy").columns, "copy")


def oracle(cycle: int = CYCLE, most: int = MOST, seed: int = SEED) -> str:
    return f"""
with sizes as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
stats as (select source, sum(size)::bigint as source_size from sizes group by source),
weighed as (select *, ((row_number() over (order by source asc nulls last) - 1) % {cycle} + 1)::double as weight, ({most} * source_size)::double as cap from stats),
share as (select *, (select sum(source_size) from stats)::double - coalesce(sum(cap) over (order by cap / weight, source asc nulls last
      rows between unbounded preceding and 1 preceding), 0) as left_over,
    sum(weight) over (order by cap / weight, source asc nulls last rows between current row and unbounded following) as rest from weighed),
held as (select *, cap * rest <= weight * left_over as held from share),
split as (select left_over, rest from held where not held order by rest desc limit 1),
targets as (select source, source_size, case when held then cap else (select left_over from split) * weight / (select rest from split) end as target from held),
placed as (select *, row_number() over (partition by source order by size nulls first, doc_id nulls first) as place from sizes),
rated as (select p.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    ('0x' || substr(md5('{seed}|' || coalesce(p.source, '')), 1, 5))::bigint / 1048576.0::double as shift
  from placed p join targets t on p.source is not distinct from t.source)
select doc_id, size, source_size, target,
  size * (floor(shift + rate * place) - floor(shift + rate * (place - 1)))::bigint as taken from rated"""
