"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.llm.words import chunks

BITS = 16  # 2**BITS buckets
ORDERS = 3  # n-grams of 1 to ORDERS characters
ALPHA = 0.5
FOLDS = 5
TEXT_BYTES = 1 << 20  # text scored at a time
UNKNOWN = "und"

_MULTIPLIER = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def hashed_grams(texts: list[str | None], bits: int, orders: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order, the bucket of the n-gram that starts at each place; and each text's first place.

    Texts are lower-cased and followed by a gap of zero code points that the last n-grams reach into. What starts in the
    gap itself has the bucket after the last, which counts for nothing; so no n-gram spans two texts.
    """
    gap = "\0" * max(1, orders - 1)
    low = [(t or "").lower() + gap for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    shift, out = np.uint32(32 - bits), []
    gaps = (first[1:, None] - 1 - np.arange(len(gap))).ravel()
    rolled = np.zeros(len(codes), dtype=np.uint32)
    for order in range(orders):
        ahead = np.zeros(len(codes), dtype=np.uint32)
        ahead[: len(codes) - order] = codes[order:]
        rolled = (rolled ^ (ahead + np.uint32(order))) * _MULTIPLIER
        gram = (rolled * _SPREAD) >> shift
        gram[gaps] = 1 << bits
        out.append(gram)
    return out, first


def count_grams(labelled: DataFrame, bits: int = BITS, orders: int = ORDERS) -> DataFrame:
    """(lang, bucket, n) over (text, lang); bucket -1 counts the documents.

    Each task sums its own part before the shuffle: at most one row per language and bucket leaves it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "text", TEXT_BYTES):
            langs = batch.column("lang").to_pylist()
            grams, first = hashed_grams(batch.column("text").to_pylist(), bits, orders)
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])
                here = np.repeat(mine, np.diff(first))
                total = seen.setdefault(lang, np.zeros((1 << bits) + 1, dtype=np.int64))
                total[-1] += mine.sum()
                for gram in grams:
                    total[:-1] += np.bincount(gram[here], minlength=(1 << bits) + 1)[:-1]
        for lang, total in seen.items():
            some = np.flatnonzero(total)
            bucket = np.where(some == 1 << bits, -1, some)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(bucket), pa.array(total[some])], ["lang", "bucket", "n"])

    parts = labelled.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, log prior of each and log probability by (bucket, language)."""

    def __init__(self, counts: pa.Table, bits: int, orders: int, alpha: float):
        """``counts``: lang, bucket and n as in :func:`count_grams`."""
        self.bits, self.orders = bits, orders
        self.langs = sorted(counts.column("lang").unique().to_pylist())
        lang = pc.index_in(counts.column("lang"), pa.array(self.langs, pa.string())).to_numpy()
        bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
        # the counts of documents have bucket -1, the last row
        table = np.zeros(((1 << bits) + 1, len(self.langs)))
        table[bucket, lang] = n
        docs, table = table[-1], table[:-1]
        self.prior = np.log(docs / max(docs.sum(), 1)) if self.langs else docs
        logs = np.log((table + alpha) / (table.sum(axis=0) + alpha * table.shape[0])).astype(np.float32)
        self.logs = np.vstack([logs, np.zeros_like(logs[:1])])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Place of the most probable language of each text, and its posterior probability."""
        grams, first = hashed_grams(texts, self.bits, self.orders)
        total = np.tile(self.prior, (len(texts), 1))
        for gram in grams:
            total += np.add.reduceat(self.logs[gram], first[:-1], axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        return best, 1 / odds.sum(axis=1)


def fit(labelled: DataFrame, bits: int = BITS, orders: int = ORDERS, alpha: float = ALPHA) -> Model:
    """Learn from all rows of ``labelled`` (text, lang) with both present; the driver receives at most
    2**bits + 1 counts per language, whatever the number of rows."""
    rows = count_grams(labelled.where("text is not null and lang is not null"), bits, orders)
    return Model(rows.toArrow(), bits, orders, alpha)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (columns key, text) to (key, lang_pred, score), from the text alone.

    ``und`` with score 0 for a null text, one without any letter, or a model that has learnt nothing. Ties go to
    the first language in order. Whole texts are scored, as sparse rows of n-gram counts times the broadcast matrix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"key {docs.schema['key'].dataType.simpleString()}, lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, "text", TEXT_BYTES):
            texts = batch.column("text").to_pylist()
            known = [bool(model.langs) and has_letter(t) for t in texts]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if any(known):
                best, scores = model.score(texts)
                langs = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores = np.where(known, scores, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(langs, pa.string()), pa.array(scores)], ["key", "lang_pred", "score"])

    return docs.select("key", "text").mapInArrow(score, schema)


def identify(docs: DataFrame, bits: int = BITS, orders: int = ORDERS, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all ``docs`` (doc_id, text, lang).

    Learns from documents with a language whose fold is not 0. A null id has no fold: it is neither learnt from
    nor held out. Repeated rows are rows of their own and agree.
    """
    model = fit(docs.where(fold(F.col("doc_id")) != 0).select("text", "lang"), bits, orders, alpha)
    told = predict(docs.select(F.col("doc_id").alias("key"), "text"), model)
    held = F.coalesce(fold(F.col("key")) == 0, F.lit(False))
    return told.select(F.col("key").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")
