"""Benchmark decontamination: backward search of test phrases in an FM-index of every shard of training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.llm.common import fresh
from phylomart.llm.fm_index import FMIndex
from phylomart.llm.words import ALNUM, chunks, encoded, split_words
from phylomart.runtime import cut_lineage

WINDOW = 13
SHARE = 20  # contaminated when SHARE * hit words reach all words
SHARD_BYTES = 6 << 20  # text of one index
BLOCK_BYTES = 32 << 20  # benchmark text of one broadcast
BLOCK_WINDOWS = 1 << 17  # windows of one broadcast, some 2 KB each on the driver
# Fixed value: a word, before or after A-Z are lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Phrases:
    """Windows of benchmark items: each different word sequence once, with the items that have it."""

    def __init__(self, ids: list, texts: list[bytes], window: int):
        words = split_words(texts, ALNUM, lower=True)
        sequences: dict[tuple[bytes, ...], set[str]] = {}
        self.hashes: dict[bytes, int] = {}
        for item, (a, b) in zip(ids, zip(words.first, words.first[1:], strict=False), strict=True):
            own = [words.word(i) for i in range(a, b)]
            self.hashes.update(zip(own, words.hashes[a:b].tolist(), strict=True))
            for start in range(max(1, len(own) - window + 1) if own else 0):
                sequences.setdefault(tuple(own[start : start + window]), set()).add(str(item))
        self.sequences = list(sequences)
        self.items = [sorted(x) for x in sequences.values()]
        self.lengths = np.array([len(s) for s in self.sequences], dtype=np.int64)
        self.words = list(self.hashes)
        place = {w: i for i, w in enumerate(self.words)}
        self.table = np.full((len(self.sequences), window), -1, dtype=np.int64)
        for i, s in enumerate(self.sequences):
            self.table[i, : len(s)] = [place[w] for w in s]
        self.word_hashes = np.array([self.hashes[w] for w in self.words], dtype=np.uint64)


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Words, removal spans (word places, merged, ends exclusive) and found items of each text.

    The shard's words are numbered in order of appearance; a separate symbol ends every text, so that no suffix
    comparison runs into the next one and no phrase spans two.
    """
    words = split_words(texts, ALNUM, lower=True)
    counts = np.diff(words.first)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not len(words.starts) or not phrases.sequences:
        return counts, spans, items
    ids, known = pd.factorize(words.hashes)
    n_docs = len(texts)
    doc_of_word = np.repeat(np.arange(n_docs), counts)
    # the words of a text are followed by its own end symbol
    ends = words.first[1:] + np.arange(n_docs)
    symbols = np.empty(len(ids) + n_docs, dtype=np.int64)
    symbols[np.arange(len(ids)) + doc_of_word] = ids + n_docs
    symbols[ends] = np.arange(n_docs)
    number = pd.Index(known).get_indexer(phrases.word_hashes)
    table = np.where(phrases.table >= 0, np.where(number[phrases.table] >= 0, number[phrases.table] + n_docs, -1), -1)
    index = FMIndex(symbols)
    low, high = index.count(table, phrases.lengths)
    found = np.flatnonzero(low < high)
    size = (high - low)[found]
    rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[found], size)
    at = index.locate(rows)
    doc = np.searchsorted(ends, at, side="right")
    first, phrase = at - doc, np.repeat(found, size)
    hits: dict[int, list[tuple[int, int]]] = {}
    names: dict[int, set[str]] = {}
    checked: set[tuple[int, int]] = set()
    for d, start, k in zip(doc.tolist(), first.tolist(), phrase.tolist(), strict=True):
        sequence = phrases.sequences[k]
        # symbols stand for hashes; the words themselves decide
        for i, word in enumerate(sequence, start):
            if (i, phrases.hashes[word]) not in checked:
                if words.word(i) != word:
                    break
                checked.add((i, phrases.hashes[word]))
        else:
            begin = start - int(words.first[d])
            hits.setdefault(d, []).append((begin, begin + len(sequence)))
            names.setdefault(d, set()).update(phrases.items[k])
    for d, found_spans in hits.items():
        spans[d], items[d] = merge(found_spans), sorted(names[d])
    return counts, spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, spans array<struct<start: bigint, end: bigint>>, items array<string>"


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, block_windows: int = BLOCK_WINDOWS) -> list[DataFrame]:
    """The different items of the benchmark in blocks of about ``block_bytes`` of text and ``block_windows`` windows, by a hash of the item.

    An item has no more windows than words. One item is not divided.
    """
    different = cut_lineage(benchmark.select("item_id", "text").distinct())
    words = F.regexp_count("text", F.lit(WORD_PATTERN))
    total, windows = different.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(words), F.lit(0))).first()
    n = 1 + max(total // block_bytes, windows // block_windows)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [different.where(block == i) for i in range(n)]


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` (with column text) and struct column ``hits``: n_words, spans, items.

    Spans are word places, ends exclusive, merged; items are the ids, as strings in order, of which a window
    occurs. Each task indexes its rows in shards of about ``shard_bytes`` (a longer text is a shard of its own) and
    searches them for the phrases of a block of the benchmark; further blocks make further passes, so neither
    memory nor broadcast grows with either table. Null and wordless texts have no words. A null item id is the
    string ``null``; items without words have no window; repeated items count once by id. A column called
    ``hits`` is replaced, all others stay, and repeated rows stay rows of their own.
    """
    docs = docs.drop("hits")
    spark, names = docs.sparkSession, docs.columns
    hits = "hits"
    out = docs.withColumn(hits, F.lit(None).cast(f"struct<{FOUND.replace(' long', ': bigint').replace(' array', ': array')}>"))
    for block in benchmark_blocks(benchmark, block_bytes):
        rows = block.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).collect()
        shared = spark.sparkContext.broadcast(Phrases([r[0] for r in rows], [r[1].encode() for r in rows], window))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text", shard_bytes):
                counts, spans, items = search_shard(encoded(batch.column("text")), shared.value)
                for d, old in enumerate(batch.column(hits).to_pylist()):
                    if old and old["spans"]:
                        spans[d] = merge([*spans[d], *((s["start"], s["end"]) for s in old["spans"])])
                        items[d] = sorted({*items[d], *old["items"]})
                told = pa.StructArray.from_arrays(
                    [
                        pa.array(counts, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["n_words", "spans", "items"],
                )
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), told], [*names, hits])

        out = out.mapInArrow(search, out.schema)
    return out


def n_hit(hits: str = "hits"):
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(hits: str = "hits", share: int = SHARE):
    return (n_hit(hits) > 0) & (share * n_hit(hits) >= F.col(f"{hits}.n_words"))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``docs`` without the contaminated ones; documents under the share stay as they are."""
    hits = fresh(docs, "bench_hits")
    found = find_hits(docs.withColumnsRenamed({c: hits for c in docs.columns if c.lower() == "hits"}), benchmark, window)
    kept = found.where(~is_contaminated("hits", share)).drop("hits")
    return kept.toDF(*docs.columns)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    raw = text.encode()
    words = split_words([raw], ALNUM, lower=True)
    keep, done = [], 0
    for a, b in spans:
        keep.append(raw[done : words.starts[a]])
        done = words.ends[b - 1]
    return b"".join([*keep, raw[done:]]).decode()
