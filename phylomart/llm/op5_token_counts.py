"""Token counts: an exact histogram of encoded lengths that answers every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylomart.llm.op12_byte_bpe import PATTERN, VOCABULARY, Encoder, read_ranks, vocabulary_of  # noqa: F401
from phylomart.llm.words import chunks
from phylomart.runtime import cut_lineage

TEXT_BYTES = 1 << 20
BLOCK = 64  # lengths of one block of the suffix sums


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` (columns key, text) to (key, n_tokens); a null text has none.

    The driver reads the vocabulary file (the one given, named by the session, or the default), which does not grow with the data,
    and broadcasts it. Markers of special tokens in a text are ordinary text. Very long texts are encoded part by part.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_of(docs, vocabulary)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in chunks(batches, "text", TEXT_BYTES):
            n = [len(encoder.encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64())], ["key", "n_tokens"])

    schema = f"key {docs.schema['key'].dataType.simpleString()}, n_tokens long"
    return docs.select("key", "text").mapInArrow(count, schema)


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs, docs_from, tokens_from, docs_before, tokens_before, truncated_tokens), one row per length.

    ``_from`` sums over documents of at least that length, ``_before`` over shorter ones; truncated_tokens is what
    remains of the corpus if every document is cut at that length. Sums run inside blocks of lengths, with the totals of
    later blocks added, so no window holds all lengths. An empty input has no rows.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    # one row per length, read twice below: written, so that texts are encoded once
    counts = cut_lineage(counts.withColumn("tokens", F.col("n_docs") * F.col("n_tokens")))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row per BLOCK lengths
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = [F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in "dt"]
    blocks = blocks.select("block", *after, F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    joined = counts.join(blocks, "block")
    docs_from = F.sum("n_docs").over(inside) + F.col("d_after")
    tokens_from = F.sum("tokens").over(inside) + F.col("t_after")
    out = joined.select("n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "d_all", "t_all")
    before = (F.col("d_all") - F.col("docs_from")).alias("docs_before"), (F.col("t_all") - F.col("tokens_from")).alias("tokens_before")
    cut = F.col("t_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")
    return out.select("n_tokens", "n_docs", "docs_from", "tokens_from", *before, cut.alias("truncated_tokens"))


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, n_docs, total_tokens, truncated_docs, truncated_tokens) for any context limits."""
    asked = sorted({int(x) for x in limits})
    docs, tokens = F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens"))
    sums = [docs.alias("docs"), tokens.alias("tokens")]
    for i, limit in enumerate(asked):
        sums.append(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))).alias(f"over{i}"))
        sums.append(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))).alias(f"kept{i}"))
    told = {"n_docs": lambda i: "docs", "total_tokens": lambda i: "tokens", "truncated_docs": lambda i: f"over{i}", "truncated_tokens": lambda i: f"kept{i}"}
    rows = [
        F.struct(F.lit(limit).cast("long").alias("limit"), *[F.coalesce(F.col(of(i)), F.lit(0)).alias(n) for n, of in told.items()])
        for i, limit in enumerate(asked)
    ]
    return hist.agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length such that at least that share of documents is no longer than it."""
    asked = np.unique(np.asarray(shares, dtype=float)).tolist()
    upto = F.col("docs_before") + F.col("n_docs")
    total = F.col("docs_before") + F.col("docs_from")
    out = [F.min(F.when(upto >= F.ceil(F.lit(s) * total), F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(asked)]
    row = hist.agg(*out)
    pairs = F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(asked)])
    return row.select(F.explode(pairs).alias("x")).select("x.*")
