"""Filter interaction audit: what each filter removes in every order of filters, from additive counts of failure masks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylomart.llm.words import chunks, encoded, mix
from phylomart.runtime import cut_lineage, lookup_side

FILTERS = "ABCDE"
MIN_WORDS = 100
# The prepass broadcasts one bit per counter. Counters follow the rows, up to this many bytes; with more rows
# than the bits can tell apart, more unique texts travel, and nothing else changes.
SKETCH_BYTES = 64 << 20
BITS_A_TEXT = 16
PROBES = 2
SLICE = 1 << 16  # counters of one row of the collected sketch
TEXT_BYTES = 4 << 20

_CAPITALS = bytes(range(0x41, 0x5B))
_SIGN = re.compile(rb"[#$%&*|]")


def text_mask(text: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text fails."""
    # bytes.split knows ASCII white space only: exactly the bytes 20 and 09-0D
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * capitals > 10 * code_points) << 2
        | (_SIGN.search(text) is not None) << 3
    )


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) to slim rows (doc_id, part, mask, h1, h2), without the text.

    mask has the bits of A to D; h1 and h2 are two 64-bit hashes of the text. A null text is empty, a null lang the part ''.
    """
    text = F.coalesce("text", F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "part", "mask", "h1", "h2"]
        for batch in chunks(batches, "text", TEXT_BYTES):
            points = pc.utf8_length(batch.column("text")).to_pylist()
            masks = [text_mask(t, n) for t, n in zip(encoded(batch.column("text")), points, strict=True)]
            columns = {**{c: batch.column(c) for c in names if c != "mask"}, "mask": pa.array(masks, pa.int32())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    slim = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), *_hashes(text))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, h1 long, h2 long"
    return slim.mapInArrow(run, schema)


def _hashes(text):
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counters of every hash, one array per probe."""
    h = h.view(np.uint64)
    return [(mix(h + np.uint64((0x9E3779B97F4A7C15 * i) & (2**64 - 1))) % np.uint64(bits)).view(np.int64) for i in range(1, PROBES + 1)]


def repeated_counters(hashes: DataFrame, bits: int) -> np.ndarray:
    """The merged counting sketch of the column h1, as a bit per counter: set where it counts two or more.

    Every batch of every task is a sketch of its own, with counts up to two and no zeros, and sketches are merged by adding, so
    a text in a third of all rows is a few rows before the shuffle. Only the bits come to the driver, at most ``bits`` of them.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(_places(batch.column("h1").to_numpy(zero_copy_only=False), bits))
            counter, n = np.unique(places, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(counter), pa.array(np.minimum(n, 2).astype(np.int32))], ["counter", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter = batch.column("counter").to_numpy(zero_copy_only=False)
            part, first = np.unique(counter // SLICE, return_index=True)
            packed = []
            for low, group in zip(part, np.split(counter, first[1:]), strict=True):
                flags = np.zeros(SLICE, dtype=bool)
                flags[group - low * SLICE] = True
                packed.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(packed, pa.binary())], ["part", "flags"])

    merged = hashes.select("h1").mapInArrow(sketch, "counter long, n int").groupBy("counter").agg(F.sum("n").alias("n"))
    twice = merged.where("n > 1").select("counter").repartitionByRange("counter").sortWithinPartitions("counter")
    found = np.zeros((-(-bits // SLICE), SLICE // 8), dtype=np.uint8)
    for row in twice.mapInArrow(pack, "part long, flags binary").toLocalIterator():
        found[row["part"]] |= np.frombuffer(row["flags"], dtype=np.uint8)
    return found.reshape(-1)


def may_repeat(spark, found: np.ndarray, bits: int):
    """A column function: may the text of this hash occur twice? Never false for one that does."""
    told = spark.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        flags, out = told.value, None
        for place in _places(h.to_numpy(), bits):
            hit = (flags[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 != 0
            out = hit if out is None else out & hit
        return pd.Series(out)

    return test


def flagged(docs: DataFrame, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, lang; others are left out) to one row each of (doc_id, part, mask), mask with the bits of A to E.

    E: the text is identical to that of a smaller doc_id, over the whole table. A null doc_id is neither smaller nor larger than
    another, so its row never fails E; repeated rows of the smallest doc_id all pass E.

    The prepass clears texts that are surely unique; only the others shuffle, grouped by the full text, for the smallest
    doc_id. A flagged row is one whose text may repeat and whose (doc_id, text hashes) are not those of a smallest doc_id.
    """
    spark = docs.sparkSession
    slim = cut_lineage(judge(docs))
    bits = min(8 * sketch_bytes, SLICE * (1 + slim.count() * BITS_A_TEXT // SLICE))
    test = may_repeat(spark, repeated_counters(slim, bits), bits)
    text = F.coalesce("text", F.lit(""))
    asked = docs.select("doc_id", text.alias("text")).where(test(F.xxhash64("text")))
    least = asked.groupBy("text").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    least = cut_lineage(least.select("doc_id", *_hashes(F.col("text"))))
    marked = slim.withColumn("repeated", test("h1") & F.col("doc_id").isNotNull())
    joined = marked.join(least.withColumn("first", F.lit(True)), ["doc_id", "h1", "h2"], "left")
    bit = F.when(F.col("repeated") & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return joined.select("doc_id", "part", F.col("mask").bitwiseOR(bit).alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of ``flagged`` per part and mask, and those labelled quality=1 and toxic=1.

    Several label rows of one doc_id count once, as good or toxic if one of them says so; a null doc_id has no label.
    """
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    told = lookup_side(labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality"), said("toxic")))
    joined = rows.join(told, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def order_plan(filters: str = FILTERS) -> list[tuple[str, int, str, int, int, int, int]]:
    """(filter_order, step, filter, mask, failed here, failed earlier, fails only it): one row per order, step and mask."""
    plan = []
    for order in permutations(filters):
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << filters.index(letter)
            for mask in range(1 << len(filters)):
                gone, fails = bool(mask & earlier), bool(mask & bit)
                plan.append(("".join(order), step, letter, mask, int(fails and not gone), int(gone), int(mask == bit)))
            earlier |= bit
    return plan


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report of ``mask_counts``: per part, every order of the filters and step, zeros included.

    Masks are additive: a row of counts meets the fixed plan of orders (120 orders, 5 steps, 32 masks) by its mask, and sums do the rest.
    An empty input has no parts and no rows.
    """
    spark = counts.sparkSession
    plan = spark.createDataFrame(order_plan(filters), "filter_order string, step int, letter string, mask int, here int, earlier int, only int")
    met = counts.join(F.broadcast(plan), "mask")
    n, here, earlier = F.col("n"), F.col("here"), F.col("earlier")
    fails = F.col("mask").bitwiseAND(F.expr(f"shiftleft(1, instr('{filters}', letter) - 1)")) != 0
    sums = {
        "kept": n * (1 - earlier) * (1 - here),
        "removed": n * here,
        "redundant": F.when(fails, n * earlier).otherwise(0),
        "unique_fails": n * F.col("only"),
        "good_lost": F.col("good") * here,
        "toxic_lost": F.col("toxic") * here,
    }
    steps = met.groupBy("part", "filter_order", "step", "letter").agg(*[F.sum(v).cast("long").alias(k) for k, v in sums.items()])
    # 120 rows per part and filter
    over = Window.partitionBy("part", "letter")
    return steps.select("part", "filter_order", "step", *sums, F.sum("removed").over(over).alias("shapley"))


def oracle() -> str:
    """DuckDB SQL for the whole audit."""
    fails = {"A": "w < 100", "B": "100 * dw < 80 * w", "C": "100 * caps > 10 * points", "D": "signs", "E": "coalesce(f.doc_id > least, false)"}
    mask = " + ".join(f"case when {c} then {1 << i} else 0 end" for i, c in enumerate(fails.values()))
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
    return f"""with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
e as (select doc_id, part, t, min(doc_id) over (partition by t) as least, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
f as (select doc_id, part, least, len(ws) as w, len(list_distinct(ws)) as dw, length(regexp_replace(t, '[^A-Z]', '', 'g')) as caps, length(t) as points, regexp_matches(t, '[#$%&*|]') as signs from e),
g as (select f.part, {mask} as mask, coalesce(l.quality = 1, false)::int as good, coalesce(l.toxic = 1, false)::int as toxic from f
  left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l on l.doc_id = f.doc_id),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from g group by part, mask),
o as (select ord, step, 1 << (instr('{FILTERS}', ord[step]) - 1) as bit, list_sum(list_transform(range(1, step), lambda i: 1 << (instr('{FILTERS}', ord[i]) - 1))) as before
  from (values {orders}) v(ord) cross join (select unnest([1, 2, 3, 4, 5]) as step) s),
m as (select part, ord, step, bit, mask, n, good, toxic, (mask & coalesce(before, 0)::bigint) <> 0 as gone, (mask & bit) <> 0 as fails from c cross join o),
r as (select part, ord as filter_order, step, bit, sum(case when not gone and not fails then n else 0 end) as kept, sum(case when fails and not gone then n else 0 end) as removed,
  sum(case when fails and gone then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
  sum(case when fails and not gone then good else 0 end) as good_lost, sum(case when fails and not gone then toxic else 0 end) as toxic_lost from m group by part, ord, step, bit)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r"""
