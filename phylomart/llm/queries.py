"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylomart.llm import (
    op1_url_filter,
    op2_mix,
    op3_language,
    op4_warc,
    op5_token_counts,
    op6_pii,
    op7_decontaminate,
    op8_simhash,
    op9_quality,
    op10_substrings,
    op11_codes,
    op12_byte_bpe,
    op13_filter_audit,
)
from phylomart.llm.common import table


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op1_url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    fields = ("host", "path", "rule", "verdict", "weight", "n_strict", "n_soft")
    return judged.select("page_id", *[F.col(f"judged.{f}").alias(f) for f in fields])


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = op2_mix.mix(docs.select("doc_id", "source", op2_mix.n_words(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return op5_token_counts.histogram(op5_token_counts.encoded_lengths(docs))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return op6_pii.digests(op6_pii.detect(docs))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op7_decontaminate.digests(op7_decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark")))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_simhash.digests(op8_simhash.group(table(spark, sf_dir, "documents").select("doc_id", "text")))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality.digests(op9_quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_substrings.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return op11_codes.digests(*op11_codes.compress(vectors))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return op12_byte_bpe.digests(op12_byte_bpe.decode(op12_byte_bpe.encode(docs)))


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op13_filter_audit.flagged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return op13_filter_audit.audit(op13_filter_audit.mask_counts(rows, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter,
    "op2_mix": mix,
    "op3_language": language,
    "op4_warc": warc,
    "op5_token_counts": token_counts,
    "op6_pii": pii,
    "op7_decontaminate": decontaminate,
    "op8_simhash": simhash,
    "op9_quality": quality,
    "op10_substrings": substrings,
    "op11_codes": codes,
    "op12_byte_bpe": byte_bpe,
    "op13_filter_audit": filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": op1_url_filter.oracle(),
    "op2_mix": op2_mix.oracle(),
    "op11_codes": op11_codes.oracle(),
    "op13_filter_audit": op13_filter_audit.oracle(),
}
