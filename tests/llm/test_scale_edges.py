"""Hosts of very many labels, rows that tie in everything, benchmarks of very many equal or short items."""

import time
from collections import Counter

from pyspark.sql import functions as F

from phylomart.llm import op1_url_filter, op2_mix, op7_decontaminate


def test_host_of_a_million_labels():
    rules = op1_url_filter.rule_table([("allow", "org/"), ("block", "example.org/es/"), ("block", "a.b.c.d/x")])
    start = time.perf_counter()
    assert op1_url_filter.find_rule(rules, "a." * 1_000_000 + "example.org", "/es/1") == ("example.org/es/", "block")
    assert op1_url_filter.find_rule(rules, "x.a.b.c.d", "/xy") == ("a.b.c.d/x", "block")
    assert op1_url_filter.find_rule(rules, "b.c.d", "/xy") == (None, None) == op1_url_filter.find_rule({}, "a.b", "/")
    assert op1_url_filter.find_rule(rules, "org", "/es/") == ("org/", "allow") == op1_url_filter.find_rule(rules, "..org", "/")
    assert time.perf_counter() - start < 5


def test_mix_of_equal_rows_and_clashing_columns(make):
    rows = [(None, "a", 5, "s", "t", 1, 2)] * 400 + [(i, "b", 10, "s", "t", 1, 2) for i in range(40)]
    df = make(rows, "doc_id long, source string, size long, source_size string, target string, copies int, place int")
    mixed = op2_mix.mix(df)
    assert mixed.columns == ["doc_id", "source", "size", "place", "source_size", "target", "copies"]
    got = {r.source: (r.n, r.target, r.taken) for r in mixed.groupBy("source").agg(F.count("*").alias("n"), F.max("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    assert {s: g[0] for s, g in got.items()} == {"a": 400, "b": 40}
    assert all(abs(taken - target) <= 10 for _, target, taken in got.values())
    assert {r.copies for r in mixed.collect()} <= {0, 1, 2, 3}


def test_benchmark_of_equal_rows_and_many_windows(make):
    text = " ".join(f"w{i}" for i in range(60))
    docs = make([(1, text), (2, "other words"), (3, "short one here")], "doc_id long, text string")
    bench = make([(7, text)] * 500 + [(i, f"short one {i}") for i in range(300)] + [(8, "short one"), (None, None)], "item_id long, text string")
    assert len(op7_decontaminate.benchmark_blocks(bench, block_bytes=1 << 20, block_windows=100)) > 5
    assert sum(b.count() for b in op7_decontaminate.benchmark_blocks(bench, block_windows=100)) == 303
    whole = op7_decontaminate.digests(op7_decontaminate.find_hits(docs, bench)).collect()
    parts = op7_decontaminate.digests(op7_decontaminate.find_hits(docs, bench, block_bytes=2000)).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, parts))
    assert {r.doc_id: (r.n_hit, r.n_items) for r in whole} == {1: (60, 1), 2: (0, 0), 3: (2, 1)}
