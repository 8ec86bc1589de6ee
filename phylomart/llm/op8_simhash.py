"""SimHash near-duplicates: multi-index hashing over segments of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.llm.common import fresh
from phylomart.llm.components import connect
from phylomart.llm.words import encoded
from phylomart.runtime import cut_lineage

SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
SEGMENTS = 3
SPREAD_ROWS = 50_000  # fingerprints a task expands to their balls


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half the hashes of the text's word shingles; 0 without words."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and exactly the bytes 20 and 09-0D
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes).tolist()
    ends = ends[shingle - 1 :].tolist() or [len(line)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends, strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
    set_ = bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * set_ > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with column text to all other columns and ``fp``, the fingerprint as a signed long; null is empty."""
    kept = [c for c in docs.columns if c != "text"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in encoded(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps.view(np.int64))], [*kept, "fp"])

    schema = docs.select(*kept).withColumn("fp", F.lit(0).cast("long")).schema
    return docs.mapInArrow(sketch, schema)


def segment_plan(segments: int = SEGMENTS, distance: int = DISTANCE, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment.

    If each segment differed in more bits than its radius, the whole would differ in at least the sum of
    (radius + 1) bits. Radii whose sum is distance + 1 - segments make that more than ``distance``, so a link shows in
    at least one segment's ball. The first segment takes the smallest radius, and the spare bits.
    """
    spare = max(0, distance + 1 - segments)
    plan, low = [], 0
    for i in range(segments):
        width = bits // segments + (i < bits % segments)
        # the last segments take the larger radii
        plan.append((low, width, spare // segments + (segments - 1 - i < spare % segments)))
        low += width
    return plan


def ball(width: int, radius: int) -> list[int]:
    """Masks of ``width`` bits with at most ``radius`` set: what to flip to reach every key nearby."""
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(width), r)]


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _asked(i: int, low: int, width: int, radius: int) -> Column:
    """The keys that a value asks for in segment ``i``."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
    own = _segment(F.col("fp"), low, width)
    return F.transform(masks, lambda m: F.struct(F.lit(i).alias("seg"), own.bitwiseXOR(m).alias("key")))


def links(prints: DataFrame, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of the different values in ``prints`` (fp) at most ``distance`` bits apart.

    Each value is stored once per segment under the segment's bits, and asks for every key in the ball around
    them; the whole distance is verified in the join. A pair is taken only from the first segment whose ball holds it, so it
    comes once. Keys are whole segments (21 bits for three); the expected candidates of a value are the values
    over 2**21, so for more than some 10**8 different values two segments of 32 bits and radii 1 and 2 are the choice.
    """
    plan = segment_plan(segments, distance)
    kept = cut_lineage(prints.select("fp").distinct())
    stored = [F.struct(F.lit(i).alias("seg"), _segment(F.col("fp"), low, width).alias("key")) for i, (low, width, _) in enumerate(plan)]
    tables = kept.select("fp", F.explode(F.array(*stored)).alias("x")).select(F.col("fp").alias("a"), "x.seg", "x.key")
    asked = [_asked(i, *part) for i, part in enumerate(plan)]
    # a stored fingerprint is a few bytes and becomes dozens of rows, so the table's own splits would be too large
    spread = kept.repartition(1 + kept.count() // SPREAD_ROWS, "fp")
    probes = spread.select("fp", F.explode(F.concat(*asked)).alias("x")).select(F.col("fp").alias("b"), "x.seg", "x.key")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    missed = [
        (F.col("t.seg") <= i) | (F.bit_count(_segment(apart, low, width)) > radius) for i, (low, width, radius) in enumerate(plan[:-1])
    ]
    near = [F.col("t.seg") == F.col("p.seg"), F.col("t.key") == F.col("p.key"), F.col("a") < F.col("b"), F.bit_count(apart) <= distance]
    return probes.alias("p").join(tables.alias("t"), reduce(lambda x, y: x & y, [*near, *missed])).select("a", "b")


def group(docs: DataFrame, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` (doc_id, text, any more) to all columns but text, with ``fp``, ``root`` and ``component_id``.

    component_id is the smallest doc_id reachable over links of fingerprints; null ids do not count, and a
    component of null ids alone has null. Equal fingerprints meet in one row before any join, so
    copies are never paired; what is joined back is one row per fingerprint.
    """
    slim = cut_lineage(fingerprints(docs))
    values = cut_lineage(slim.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connect(links(values, segments, distance))
    placed = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = cut_lineage(placed)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    told = cut_lineage(placed.join(cut_lineage(least), "root").select("fp", "root", "component_id"))
    return slim.join(told, "fp")


def digests(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near-duplicates: the one of the smallest doc_id, nulls last.

    The rows are written once with a number of their own, which settles ties between repeated ids.
    """
    row = fresh(docs, "simhash_row")
    kept = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    grouped = group(kept.select("doc_id", "text", F.col(row).alias("row")), segments, distance)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = grouped.groupBy("root").agg(F.min(order)["row"].alias(row))
    return kept.join(first.select(row), row, "left_semi").select(*docs.columns)
