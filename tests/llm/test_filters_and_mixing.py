"""URL rules, mixing, language identification, WARC files, suffix order and the pipeline."""

import gzip
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from phylomart.llm import op1_url_filter, op2_mix, op3_language, op4_warc, op6_pii, op7_decontaminate, op8_simhash
from phylomart.llm.components import connect
from phylomart.llm.fm_index import FMIndex, suffix_order
from phylomart.runtime import shared_dir
from tools.check import rows as as_rows


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().convert_dtypes())
    cur = con.execute(sql)
    return as_rows([d[0] for d in cur.description], cur.fetchall())


# 1


def judged(pages):
    out = op1_url_filter.judge_urls(pages)
    fields = ("host", "path", "rule", "verdict", "weight", "n_strict", "n_soft")
    return out.select("page_id", *[F.col(f"judged.{f}").alias(f) for f in fields])


def test_url_verdicts(make):
    urls = {
        "http://A.Example.org/es/x?y#z": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/1": ("example.org", "/en/1", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://notorg/": ("notorg", "/", None, "allow"),
        "https://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "https://x.com/fr/porn": ("x.com", "/fr/porn", "com/fr/", "allow"),
        "https://x.net/porn": ("x.net", "/porn", None, "block"),
        "https://x.net/XXX-videos": ("x.net", "/XXX-videos", None, "block"),
        "https://x.net/popcorn/essex/sexton": ("x.net", "/popcorn/essex/sexton", None, "allow"),
        "https://casino.net/casino": ("casino.net", "/casino", None, "allow"),
        "https://casino.net/poker?adult": ("casino.net", "/poker", None, "block"),
        "https://x.net?a/b": ("x.net", "", None, "allow"),
        "https://x.net#a://b": ("x.net", "", None, "allow"),
        "no scheme casino poker": ("", "", None, "block"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "": ("", "", None, "allow"),
        "://\nÄ.ORG/sexé/nude": ("\nÄ.org", "/sexé/nude", "org/", "allow"),
        None: ("", "", None, "allow"),
    }
    pages = make([(i, u, "old") for i, u in enumerate([*urls, *urls])], "page_id long, url string, judged string")
    got = judged(pages)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter((i, *w) for i, w in enumerate([*urls.values()] * 2))
    assert as_rows(got.columns, got.collect()) == by_sql(op1_url_filter.oracle(), pages=pages)
    assert judged(pages.limit(0)).count() == 0


# 2


def mixed(docs):
    out = op2_mix.mix(docs.select("doc_id", "source", op2_mix.n_words(F.col("text")).alias("size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        left, rest = total - sum(held.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / rest for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return held | share
        held |= over


@pytest.mark.parametrize("kind", ["plain", "one source", "no words", "empty"])
def test_mix(make, kind):
    rng = np.random.default_rng(3)
    sources = ["a", "Z", "é", None, "tiny", "nil"]
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 200))), sources[min(3, int(rng.exponential(1)))]) for i in range(900)]
    rows += [(1000, "one", "tiny"), (1001, None, "nil"), (1001, "", "nil"), (None, "x y", "a"), (None, "x y", "a"), (5, "dup dup", "a"), (5, "dup dup", "a")]
    if kind == "one source":
        rows = [(i, t, "s") for i, t, _ in rows]
    if kind == "no words":
        rows = [(i, " ", s) for i, _, s in rows]
    docs = make(rows if kind != "empty" else [], "doc_id long, text string, source string")
    got = mixed(docs)
    collected = got.collect()
    sql = op2_mix.oracle()
    if kind != "empty":
        assert as_rows(got.columns, collected) == by_sql(sql, documents=docs)
    sizes, most = defaultdict(int), defaultdict(int)
    for _, t, s in docs.collect():
        n = len((t or "").split())
        sizes[s], most[s] = sizes[s] + n, max(most[s], n)
    targets = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    assert sorted({(r.source_size, round(r.target, 6)) for r in collected}) == sorted({(sizes[s], round(t, 6)) for s, t in targets.items()})
    assert all(r.taken <= 3 * r.size for r in collected) and len(collected) == docs.count()
    taken = defaultdict(int)
    for r in op2_mix.mix(docs.select("doc_id", "source", op2_mix.n_words(F.col("text")).alias("size"))).collect():
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - targets[s]) <= most[s] for s in sizes)
    whole = op2_mix.mix_documents(docs.withColumn("copy", F.lit("x")))
    assert sum(len((r.text or "").split()) for r in whole.collect()) == sum(taken.values())
    assert whole.columns == ["doc_id", "text", "source", "copy"]


def test_vocabulary_from_a_table(make):
    table = [("Casino", 1, "en"), ("casino", 2, "en"), (" Wette ", 1, "de"), ("pari-x", 1, "fr"), (None, 1, "en"), ("", 1, "en"), ("null", None, "en"), ("less", 0, "en")]
    table = make(table, "term string, weight int, lang string")
    assert op1_url_filter.read_vocabulary(table) == {"casino": 2, "wette": 1, "pari-x": 1}
    assert op1_url_filter.read_vocabulary(table, ["de", "fr"]) == {"wette": 1, "pari-x": 1}
    assert op1_url_filter.read_vocabulary(table, []) == {} == op1_url_filter.read_vocabulary(table.limit(0))
    with pytest.raises(ValueError):
        op1_url_filter.read_vocabulary(table, most=2)


def test_large_vocabulary_equals_a_search_for_every_term(make):
    # terms within terms, and strict ones among them
    weights = op1_url_filter.read_vocabulary(make([(f"w{i}", 1 + (i % 50 == 0), "x") for i in range(20_000)], "term string, weight int, lang string"))
    assert len(weights) == 20_000
    urls = [f"http://h{i}.net/W{i * 37}-w{i * 91 % 30_000}x/w{i}?q=w{i}w{i + 1}&w{i % 7}" for i in range(60)]
    judged = op1_url_filter.judge_urls(make(list(enumerate(urls)), "page_id long, url string"), rules=(), weights=weights).collect()
    for row in judged:
        tokens = set(re.findall("[a-z0-9]+", row.url.lower())) & weights.keys()
        assert row.judged.terms == sorted(tokens)
        assert row.judged.verdict == ("block" if sum(weights[t] for t in tokens) >= 2 else "allow")


# 3


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = op3_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(told) > 150 and sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)
    assert all(0 <= r.score <= 1 for r in told)


def told_by_plain_bayes(docs):
    """doc_id to (language, probability) by dictionaries of exact counts, a gram at a time."""
    size, alpha = 1 << 16, 0.5

    def buckets(text):
        codes = [ord(c) for c in text.lower()] + [0, 0]
        for i in range(len(codes) - 2):
            rolled = 0
            for k in range(3):
                rolled = ((rolled ^ (codes[i + k] + k)) * 0x01000193) % 2**32
                yield (rolled * 0x9E3779B1) % 2**32 >> 16

    seen, counts = Counter(), defaultdict(Counter)
    for r in docs:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            seen[r.lang] += 1
            counts[r.lang].update(buckets(r.text))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    told = {}
    for r in docs:
        if not any(c.isalpha() for c in r.text or ""):
            told[r.doc_id] = ("und", 0.0)
            continue
        own = Counter(buckets(r.text))
        logs = {
            lang: math.log(seen[lang] / sum(seen.values())) + sum(n * math.log((counts[lang][b] + alpha) / (total[lang] + alpha * size)) for b, n in own.items())
            for lang in sorted(seen)
        }
        best = max(logs, key=logs.get)
        told[r.doc_id] = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    return told


def test_predictions_and_scores_equal_plain_bayes(spark, make):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    # short mixed texts have scores well between 0 and 1
    short = [(10_000 + i, t, None) for i, t in enumerate(["der the", "la casa is", "12", "", "et a", "Ünd", "x", None, "de la", "no die"])]
    docs = docs.unionByName(make(short, "doc_id long, text string, lang string"))
    want = told_by_plain_bayes(docs.collect())
    got = {r.doc_id: r for r in op3_language.identify(docs).collect()}
    assert got.keys() == want.keys()
    assert {i: r.lang_pred for i, r in got.items()} == {i: lang for i, (lang, _) in want.items()}
    assert all(r.score == pytest.approx(want[i][1], abs=2e-3) for i, r in got.items())
    assert any(0.3 < r.score < 0.95 for r in got.values())


def test_language_cases(make):
    text = {"en": "the cat sat on the mat and then the dog ran", "de": "der hund und die katze sind auf der matte"}
    rows = [(i, text["en" if i % 2 else "de"] + f" {i}", "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(100, None, "en", "s"), (101, "", "de", "s"), (102, "12 34 !?", "en", "s"), (103, "THE CAT AND THE DOG", None, None), (None, text["de"], "xx", "s"),
             (104, text["en"] * 3000, None, "s"), (105, "日本", None, "s"), (7, text["en"], "en", "s")]
    docs = make(rows, "doc_id long, text string, lang string, lang_pred string")
    got = op3_language.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "en"]
    assert by[None].lang_pred == "de" and not by[None].held_out and by[105].lang_pred in ("de", "en")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    nothing = op3_language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert op3_language.identify(docs.limit(0)).count() == 0


def test_counted_grams_equal_plain_counts(make):
    texts = ["ab", "", "ba b"]
    grams, first = op3_language.hashed_grams(texts, 16, 3)
    assert list(first) == [0, 4, 6, 12] and all(len(g) == 12 for g in grams)
    rows = op3_language.count_grams(make([(t, "x") for t in texts], "text string, lang string")).collect()
    assert {r.bucket: r.n for r in rows if r.bucket >= 0} == {b: n for b, n in Counter(np.concatenate(grams).tolist()).items() if b < 1 << 16}
    assert sum(r.n for r in rows if r.bucket >= 0) == 3 * 6
    assert [r.n for r in rows if r.bucket < 0] == [3]


# 4


def test_normaliser_splits_a_whole_file_stream(spark, tmp_path):
    records = [op4_warc.build_record(i, f"http://x/{i}", body, op4_warc.bare_digest(body), None) for i, body in enumerate([b"", b"<p>\r\n\r\nWARC/1.1", b"x" * 3_000_000])]
    records.append(op4_warc.build_record(7, None, b"<p>", op4_warc.bare_digest(b"<p>"), 1))
    streams = {"one.warc.gz": gzip.compress(b"".join(records)), "parts.warc.gz": b"".join(map(gzip.compress, records)), "none.warc.gz": gzip.compress(b"")}
    for name, data in streams.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in streams], "path string")
    done = op4_warc.normalise(files, f"{shared_dir(spark)}/normalised").collect()
    assert sorted(r.n_records for r in done) == [0, 4, 4]
    for r in done:
        fs, path = op4_warc.open_fs(r.path)
        data, at = fs.open_input_file(path).read(), 0
        members = list(op4_warc.read_index(r["index"]))
        for (offset, length, kind, name), raw in zip(members, records, strict=False):
            assert offset == at and gzip.decompress(data[offset : offset + length]) == raw
            record, _ = op4_warc.parse_record(io.BytesIO(raw))
            assert (kind, name) == (record.kind, record.headers["warc-record-id"])
            at += length
        assert at == len(data) and len(members) == r.n_records


def test_broken_archives_raise(tmp_path):
    record = op4_warc.build_record(1, "u", b"body", op4_warc.bare_digest(b"body"), None)
    with pytest.raises(EOFError):
        io.BufferedReader(op4_warc.Inflated(io.BytesIO(gzip.compress(record)[:-12]))).read()
    with pytest.raises(ValueError, match="ends early"):
        op4_warc.parse_record(io.BytesIO(record[:-10]))
    with pytest.raises(ValueError, match="digest"):
        op4_warc._told(op4_warc.build_record(1, "u", b"body", op4_warc.bare_digest(b"else"), None))


# 7


def test_suffix_order_and_search():
    rng = np.random.default_rng(1)
    for _ in range(60):
        symbols = np.concatenate([rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), [0]])
        assert list(suffix_order(symbols)) == sorted(range(len(symbols)), key=lambda i: tuple(symbols[i:]))
        index = FMIndex(symbols, 4)
        phrases, lengths = rng.integers(1, 7, (20, 3)), rng.integers(0, 4, 20)
        phrases[0, 0] = -1
        for p, n, low, high in zip(phrases, lengths, *index.count(phrases, lengths), strict=True):
            want = [i for i in range(len(symbols)) if n and list(symbols[i : i + n]) == list(p[:n])]
            assert sorted(index.locate(np.arange(low, high))) == want


# 8


def test_components_of_chains_and_stars(make):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)]
    loops = [(5, 5), (200, 201), (201, 200), (200, 202), (202, 201)]
    got = {r.node: r.root for r in connect(make(chain[::-1] + star + loops, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{101 + i: 100 for i in range(50)}, 201: 200, 202: 200}
    assert connect(make([], "a long, b long")).count() == 0


# pipeline


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{entry.SMOKE_DIR}/documents.parquet")
    bench = spark.read.parquet(f"{entry.SMOKE_DIR}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "pii", "mix"] and corpus_pipeline.ORACLE_SQL is None
    step = lambda name, df: stages[name](spark, df, entry.SMOKE_DIR)
    columns = docs.columns

    good = step("quality", docs).cache()
    judged_ = entry.queries()["op9_quality"](spark, entry.SMOKE_DIR)
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in judged_.where("kept").collect()}

    single = step("near_dedup", docs).cache()
    grouped = op8_simhash.digests(op8_simhash.group(docs.select("doc_id", "text")))
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {r.component_id for r in grouped.collect()} and single.count() < docs.count()

    clean = step("decontaminate", docs).cache()
    told = op7_decontaminate.digests(op7_decontaminate.find_hits(docs, bench))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in told.where("not contaminated").collect()}

    private = step("pii", docs).cache()
    assert private.columns == columns and private.count() == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == op6_pii.redact_text(texts[r.doc_id]) and r.n_chars == len(r.text) for r in private.collect())
    assert all(not op6_pii.plain_spans(r.text) for r in private.collect())

    mixed_ = Counter(r.doc_id for r in step("mix", docs).collect())
    want = {r.doc_id: r.taken // r.size for r in entry.queries()["op2_mix"](spark, entry.SMOKE_DIR).collect() if r.taken}
    assert mixed_ == want

    final = corpus_pipeline.run(spark, entry.SMOKE_DIR)
    assert final.columns == [*columns, "copy"] and final.count() > 0


def test_stages_on_odd_and_empty_rows(spark, make):
    odd = make([(None, None, None), (1, "", "s"), (1, "", "s"), (2, "a@b.cc " * 60, None), (3, " ".join(f"w{i}" for i in range(80)), "s")], "doc_id long, text string, source string")
    odd = odd.withColumns({c: F.lit(c) for c in ("hits", "quality", "copy", "mix_row", "simhash_row", "fp", "common")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, entry.SMOKE_DIR)
        assert set(out.columns) == set(odd.columns), name
        assert all(r.fp == "fp" for r in out.collect())
        assert stage(spark, odd.limit(0), entry.SMOKE_DIR).count() == 0, name
