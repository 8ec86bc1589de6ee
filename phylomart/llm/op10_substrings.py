"""Substring dedup: seed on winnowed anchors, extend to both sides, keep repeats of at least the length threshold."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.llm.words import NON_SPACE, Words, chunks, encoded, mix, powers, split_words
from phylomart.runtime import cut_lineage

LENGTH = 35  # words of a repeat, at least
ANCHOR = 8  # words of an anchor
TEXT_BYTES = 4 << 20

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hash of any run of words from prefix sums."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers(_BASE, len(hashes)))])
        self.back = powers(_INVERSE, len(hashes) + 1)

    def runs(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(np.uint64))


def select_anchors(words: Words, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: (document, anchor hash, segment hash, anchor place, first window, windows).

    A window of ``length`` words takes the least of its anchor hashes, the leftmost if they tie, so equal windows take equal
    anchors at equal offsets. Neighbouring windows with the same anchor form one segment: the anchor extended
    to both sides as far as windows that take it reach. Places are words of the document.
    """
    counts = np.diff(words.first)
    rolling = Rolling(words.hashes)
    n = len(words.hashes)
    grams = rolling.runs(np.arange(max(0, n - anchor + 1)), np.arange(anchor, max(anchor, n + 1)))
    span = length - anchor + 1  # anchors of a window
    # windows that lie inside one document, as word places of the batch
    windows = np.maximum(counts - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + words.first[:-1][doc]
    if not len(start):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    least = _least_place(grams, span)[start]
    # one segment per document and anchor place
    cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
    size = np.diff(cut, append=len(start))
    first, doc = start[cut], doc[cut]
    segment = rolling.runs(first, first + size - 1 + length)
    base = words.first[doc]
    return doc, grams[least[cut]], segment, least[cut] - base, first - base, size


def _least_place(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost least value in every run of ``span``, by doubling the reach."""
    places = np.arange(len(values))
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        ahead = places[step:]
        here = places[: len(ahead)]
        places = np.where(values[ahead] < values[here], ahead, here)
        reach += step
    return places


def _key_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag int"


def _tag(texts: list[bytes]) -> np.ndarray:
    """A 32-bit hash of the text: with the id it tells apart rows of one id and different texts."""
    return np.array([int.from_bytes(sha256(t).digest()[:4], "little", signed=True) for t in texts], dtype=np.int32)


def anchor_rows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(anchor, segment, doc_id, tag, first, size) of every segment: its first window and its count of windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", TEXT_BYTES):
            texts = encoded(batch.column("text"))
            doc, gram, segment, _, first, size = select_anchors(split_words(texts, NON_SPACE), length, anchor)
            columns = [gram.view(np.int64), segment.view(np.int64), batch.column("doc_id").take(pa.array(doc)), _tag(texts)[doc], first.astype(np.int32), size.astype(np.int16)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["anchor", "segment", "doc_id", "tag", "first", "size"])

    schema = f"anchor long, segment long, {_key_schema(docs)}, first int, size short"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def anchor_counts(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(anchor, mixed) of anchors that occur at least twice; mixed where their segments differ."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", TEXT_BYTES):
            _, gram, segment, *_ = select_anchors(split_words(encoded(batch.column("text")), NON_SPACE), length, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(segment.view(np.int64))], ["anchor", "segment"])

    rows = docs.select("text").mapInArrow(scan, "anchor long, segment long")
    counts = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"))
    return counts.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"))


def window_rows(seeded: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, window, doc_id, tag, place) of every window in the mixed segments of ``seeded`` (doc_id, tag, text, seeds)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", TEXT_BYTES):
            words = split_words(encoded(batch.column("text")), NON_SPACE)
            rolling = Rolling(words.hashes)
            seeds = batch.column("seeds").to_pylist()
            some = [(d, s["anchor"], s["first"], s["size"]) for d, own in enumerate(seeds) for s in own if s["mixed"]]
            doc, anchor, first, size = (np.array(x, dtype=np.int64) for x in (zip(*some, strict=True) if some else ([],) * 4))
            place = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            doc, anchor = np.repeat(doc, size), np.repeat(anchor, size)
            start = place + words.first[doc]
            window = rolling.runs(start, start + length).view(np.int64)
            columns = [pa.array(anchor), pa.array(window), *(batch.column(c).take(pa.array(doc)) for c in ("doc_id", "tag")), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "window", "doc_id", "tag", "place"])

    return seeded.select("doc_id", "tag", "text", "seeds").mapInArrow(scan, f"anchor long, window long, {_key_schema(seeded)}, place int")


def _same_doc(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag"))


def text_tag(text):
    """``_tag`` as a column: the first four bytes of the SHA-256, least significant first."""
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    pairs = [F.substring(digest, 2 * i + 1, 2) for i in (3, 2, 1, 0)]
    value = F.conv(F.concat(*pairs), 16, 10).cast("long")
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, tag, text, spans) of the documents with an anchor that occurs twice.

    Spans are sorted word ranges (a, b), end exclusive, whose union is what repeats; they may meet, or be none.

    Seed: every window of ``length`` words takes one winnowed anchor. Anchors are counted, never paired; only those
    that occur twice go on. Extend: an anchor's segment is its extension to both sides. If all segments of an anchor are
    equal, all its windows repeat. Otherwise its windows are counted one by one, again as groups. So a passage
    in a third of all documents costs its own rows, not their pairs. Windows are told apart by the hashes of anchor and
    window together, 128 bits.

    Null and short texts have no window. Repeated rows are documents of their own, so their windows repeat.
    """
    shared = cut_lineage(anchor_counts(docs, length, anchor))
    rows = anchor_rows(docs, length, anchor).alias("r").join(shared.alias("s"), "anchor")
    # repeated rows give equal structs, which the set holds once; it is bounded by the document's length
    seeds = F.collect_set(F.struct(F.when(F.col("mixed"), F.col("anchor")).alias("anchor"), "first", "size", "mixed")).alias("seeds")
    by_doc = cut_lineage(rows.groupBy("doc_id", "tag").agg(seeds))
    tagged = docs.select("doc_id", "text", text_tag(F.col("text")).alias("tag"))
    seeded = cut_lineage(tagged.alias("d").join(by_doc.alias("b"), _same_doc("d", "b")).select("d.doc_id", "d.tag", "d.text", "b.seeds"))
    windows = window_rows(seeded.where(F.exists("seeds", lambda s: s["mixed"])), length)
    twice = cut_lineage(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window"))
    found = windows.join(twice, ["anchor", "window"], "left_semi")
    places = cut_lineage(found.groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places")))
    joined = seeded.alias("d").join(places.alias("p"), _same_doc("d", "p"), "left")
    ends = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    whole = F.transform(F.filter("d.seeds", lambda s: ~s["mixed"]), lambda s: ends(s["first"], s["first"] + s["size"] - 1 + length))
    single = F.transform(F.coalesce("p.places", F.array().cast("array<int>")), lambda p: ends(p, p + length))
    return joined.select("d.doc_id", "d.tag", "d.text", F.sort_array(F.concat(whole, single)).alias("spans"))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def cut(found: DataFrame) -> DataFrame:
    """(doc_id, tag, text, spans) to (doc_id, tag, n_words, n_removed, kept_sha256, spans, kept).

    Spans come out merged, as maximal repeats; kept is what is left, its words joined by one space.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(encoded(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                kept, merged, done = [], [], 0
                for s in spans:
                    if merged and s["a"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["b"])
                    else:
                        merged.append({"start": s["a"], "end": s["b"]})
                for s in merged:
                    kept += words[done : s["start"]]
                    done = s["end"]
                line = b" ".join(kept + words[done:])
                out.append((len(words), sum(s["end"] - s["start"] for s in merged), sha256(line).hexdigest(), merged, line.decode()))
            columns = zip(*out, strict=True) if out else ([],) * 5
            types = pa.int64(), pa.int64(), pa.string(), _SPANS, pa.string()
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *arrays], names)

    names = ["doc_id", "tag", "n_words", "n_removed", "kept_sha256", "spans", "kept"]
    schema = f"{_key_schema(found)}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>, kept string"
    return found.mapInArrow(apply, schema)


def digests(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text).

    Whole texts are digested in place; only documents with a shared anchor move, and their results replace the
    digests of the whole by (doc_id, tag).
    """
    whole = docs.select("doc_id", "text", text_tag(F.col("text")).alias("tag"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    plain = cut(whole).drop("spans", "kept")
    changed = cut_lineage(cut(repeats(docs, length, anchor)).where("n_removed > 0").drop("spans", "kept").dropDuplicates(["doc_id", "tag"]))
    joined = plain.alias("d").join(changed.alias("c"), _same_doc("d", "c"), "left")
    return joined.select("d.doc_id", "d.n_words", *[F.coalesce(f"c.{c}", f"d.{c}").alias(c) for c in ("n_removed", "kept_sha256")])
