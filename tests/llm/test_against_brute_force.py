"""Each operator against a plain single-machine version, on the whole smoke tables and on small odd rows."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phylomart.llm import op4_warc, op5_token_counts, op6_pii, op7_decontaminate, op8_simhash, op9_quality, op10_substrings

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, verdict string, _row string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def smoke(spark, name):
    return spark.read.parquet(f"{entry.SMOKE_DIR}/{name}.parquet")


@pytest.fixture
def odd(make):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns."""
    passage = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i % 977}" for i in range(30000))
    rows = [
        (1, "", None, "a"), (2, None, "en", None), (None, "no id here", "en", "a"), (None, passage, None, "b"), (3, passage + " end", "en", "a"),
        (3, passage + " end", "en", "a"), (3, "other text of the same id", "fr", "a"), (4, long, "en", "c"), (5, "start " + passage, "en", None),
        (6, "\t\n \x0b\r\x0c", "en", "a"), (7, "one\x1ctwo\x85three four", "de", "a"), (8, "\n".join(["same line here"] * 30), "en", "a"),
        (9, "a b " * 40, "en", "a"), (10, "x", "en", "a"), (11, "ÄÖ é ß 日本語 \U0001F600 end", "de", "b"), (12, "0.1.2.3 +12 345 678 90", "en", "b"),
    ]
    return make([(*r, "v", "r") for r in rows], DOCS)


def pages_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# 6

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    keep = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in keep.items() for m in p.finditer(t) if ok(m)]


def check_pii(df):
    got = op6_pii.digests(op6_pii.detect(df.select(F.col("doc_id").alias("key"), "text"))).collect()
    want = Counter()
    for doc, text in pages_of(df):
        spans = brute_spans(text)
        n = Counter(s[0] for s in spans)
        want[(doc, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    return got


def test_pii(spark, odd):
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in check_pii(smoke(spark, "documents"))) > 0
    check_pii(odd)


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "x@@y.zz a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111-1111 1111  +1 (234) 567.89.01+5",
                                  "+1234567 +123456789012345 ++12345678", "@a.b a..b@c.d.", "9" * 5000, "a" * 5000 + "@", "1." * 3000])
def test_pii_base_patterns(text):
    assert op6_pii.plain_spans(text) == brute_spans(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail jane.doe (at) example [dot] org now", ("email", "jane.doe (at) example [dot] org")),
        ("write to jane at example dot com please", ("email", "jane at example dot com")),
        ("jаne@exаmple.com", ("email", "jаne@exаmple.com")),
        ("call plus four nine one five one two three four five six seven", ("phone", "plus four nine one five one two three four five six seven")),
        ("host one nine two dot one six eight dot zero dot one up", ("ip", "one nine two dot one six eight dot zero dot one")),
        ("card " + " ".join(["four", *["one"] * 15]) + ".", ("card", " ".join(["four", *["one"] * 15]))),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")),
        ("٤١١١ ١١١١ ١١١١ ١١١١", ("card", "٤١١١ ١١١١ ١١١١ ١١١١")),
    ],
)
def test_pii_disguises(text, found):
    base, every = op6_pii.find_spans("é " + text)
    assert found in [(k, ("é " + text)[a:b]) for k, a, b in every]
    assert set(base) <= set(every)
    assert op6_pii.redact_text(text).count("<") == 1


@pytest.mark.parametrize(
    ("text", "part", "whole"),
    [
        ("jаne@example.com", ("email", 2, 16), ("email", 0, 16)),
        ("jane@example.cоm", ("email", 0, 14), ("email", 0, 16)),
        ("+49 151 1234 five six seven eight", ("phone", 0, 12), ("phone", 0, 33)),
    ],
)
def test_pii_partly_disguised(text, part, whole):
    base, every = op6_pii.find_spans(text)
    assert base == [part] and sorted(every) == sorted([part, whole])
    assert op6_pii.redact_text(f"a {text} b") == f"a <{whole[0].upper()}> b"
    # a disguise beside or inside a plain one adds nothing to it
    assert op6_pii.find_spans("é а jane@example.com") == ([("email", 4, 20)],) * 2


@pytest.mark.parametrize("text", ["look at the dot com", "one two three", "we met at noon", "dot dot dot dot", "née à côté", ""])
def test_pii_leaves_clean_text(text):
    assert op6_pii.find_spans(text) == ([], []) and op6_pii.redact_text(text) == text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("call +1 415 five five five 0100 now", ("phone", "+1 415 five five five 0100")),
        ("plus one, four one five, five five five, two six seven one", ("phone", "plus one, four one five, five five five, two six seven one")),
        ("call +1 (four one five) 555-0100.", ("phone", "+1 (four one five) 555-0100")),
        ("card 4111 one one one one 1111 1111", ("card", "4111 one one one one 1111 1111")),
        ("host 192 dot 168 dot one dot 1 up", ("ip", "192 dot 168 dot one dot 1")),
        ("write jane at example.com.", ("email", "jane at example.com")),
        ("write jane.doe at mail.example.co.uk, please", ("email", "jane.doe at mail.example.co.uk")),
        ("write alice dot smith at example dot com", ("email", "alice dot smith at example dot com")),
        ("write alice dot smith@example.com", ("email", "alice dot smith@example.com")),
    ],
)
def test_pii_common_disguises(text, found):
    base, every = op6_pii.find_spans(text)
    assert found in [(k, text[a:b]) for k, a, b in every] and set(base) <= set(every)
    assert op6_pii.redact_text(text) == text.replace(found[1], f"<{found[0].upper()}>")


@pytest.mark.parametrize(
    "text",
    ["one of 5 or six. 7 at 8", "one two three four five six seven eight nine", "pages 12, 13 and one", "four one five, five five five, two six seven one",
     "chapter 1 dot one", "look at example.com", "more at example.com/jane today", "we met at noon.then left", "see jane at example.py", "on the dot at noon"],
)
def test_pii_leaves_clean_numbers_and_sites(text):
    assert op6_pii.find_spans(text) == ([], []) and op6_pii.redact_text(text) == text


def test_pii_long_runs_are_read_once():
    for piece in ("one ", "a dot ", "1 dot ", "five, 5 ", "a at b.", "one-"):
        op6_pii.find_spans(piece * 20000)


def test_pii_redacts_only_text(odd):
    out = op6_pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r.text for r in out.where("doc_id = 12").collect()} == {"<IP> <PHONE>"}
    assert out.where("text is null").count() == 1


# 7


def check_contamination(docs, bench, window=13, **more):
    items = defaultdict(set)
    for item, text in [(r.item_id, r.text) for r in bench.select("item_id", "text").collect()]:
        w = ALNUM_WORD.findall(lower(text or ""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            items[tuple(w[i : i + window])].add("null" if item is None else str(item))
    sizes = {len(s) for s in items}
    want = Counter()
    for doc, text in pages_of(docs):
        w = ALNUM_WORD.findall(lower(text))
        hit, own = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in items:
                    hit.update(range(i, i + n))
                    own |= items[s]
        want[(doc, len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit) and 20 * len(hit) >= len(w))] += 1
    got = op7_decontaminate.digests(op7_decontaminate.find_hits(docs, bench, window, **more)).collect()
    assert Counter(map(tuple, got)) == want
    return got


def test_decontaminate(spark, odd, make):
    docs, bench = smoke(spark, "documents"), smoke(spark, "benchmark")
    assert any(r.contaminated for r in check_contamination(docs, bench))
    check_contamination(docs, bench, shard_bytes=3000, block_bytes=1500)
    short = make([(1, "W3 w4"), (1, "w3 W4!"), (None, "x5 x6 x7"), (2, None), (3, " "), (4, "ÄÖ É"), (5, "ÄÖ é"), (10, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    assert sum(r.n_items for r in check_contamination(odd, short)) > 3
    check_contamination(odd, short, window=3, shard_bytes=50, block_bytes=20)
    check_contamination(odd.limit(0), short)
    check_contamination(odd, short.limit(0))


def test_decontaminate_keeps_columns(odd, make):
    bench = make([(1, " ".join(f"w{i}" for i in range(13)))], "item_id long, text string")
    docs = odd.withColumn("hits", F.lit("mine"))
    out = op7_decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns and out.where("hits = 'mine'").count() == out.count() == odd.where("text is null or not text like '%w3%'").count()


def test_spans_cut():
    assert op7_decontaminate.cut_spans("Ab, cd! éf gh.", [(1, 3)]) == "Ab,  gh."


# 8


def brute_fp(text):
    w = SPACE_WORD.findall(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def check_simhash(docs, **more):
    rows = [(d, brute_fp(t)) for d, t in pages_of(docs)]
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    want = Counter((d, f"{f:016x}", least.get(find(f))) for d, f in rows)
    got = op8_simhash.digests(op8_simhash.group(docs.select("doc_id", "text"), **more)).collect()
    assert Counter(map(tuple, got)) == want
    return want, [find(f) for _, f in rows]


def test_simhash(spark, odd):
    want, _ = check_simhash(smoke(spark, "documents"))
    assert any(doc != root for doc, _, root in want)
    check_simhash(odd)
    check_simhash(odd, segments=2)
    check_simhash(odd.limit(0))


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_links_lose_nothing(make, segments):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    fps = set(base)
    for b in base:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            fps.add(b ^ sum(1 << int(i) for i in flips))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = op8_simhash.links(make(signed, "fp long"), segments).collect()
    want = {(a[0], b[0]) for a in signed for b in signed if a < b and ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 4}
    assert Counter(map(tuple, got)) == Counter(want)


def test_one_of_each_group(odd):
    _, roots = check_simhash(odd)
    kept = op8_simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(roots))


# 9


def brute_quality(text):
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    counts = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def brute_common(rows, min_docs, share):
    key = lambda x: re.sub("[0-9]+", "0", x.lower()).strip(" \t\n\x0b\f\r")
    have, docs = defaultdict(set), defaultdict(set)
    for source, text in rows:
        docs[source].add(text)
        for x in (text or "").split("\n"):
            if SPACE_WORD.search(x):
                have[(source, key(x))].add(text)
    common = {k for k, v in have.items() if len(v) > min_docs and share * len(v) > len(docs[k[0]])}
    return [sum(len(SPACE_WORD.findall(x)) for x in (t or "").split("\n") if (s, key(x)) in common) for s, t in rows]


def check_quality(docs, min_docs=op9_quality.MIN_DOCS, share=op9_quality.SHARE):
    rows = docs.select("doc_id", "source", "text").collect()
    gone = brute_common([(r.source, r.text) for r in rows], min_docs, share)
    want = Counter()
    for r, n in zip(rows, gone, strict=True):
        base = brute_quality(r.text or "")
        want[(r.doc_id, *base, not base[-1] and 2 * n <= base[0], n)] += 1
    got = op9_quality.digests(op9_quality.quality(docs, min_docs=min_docs, share=share)).collect()
    assert Counter(map(tuple, got)) == want
    return got


def test_quality(spark, odd):
    check_quality(smoke(spark, "documents"))
    got = check_quality(smoke(spark, "documents"), 1, 1000)
    assert any(r.n_common_words for r in got)
    check_quality(odd)
    check_quality(odd, 0, 1000)
    check_quality(odd.limit(0))


def test_depleted_documents_go(make):
    # letters, as digits of a line are all alike
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    own = lambda i, n: "\n".join(" ".join(f"d{name(i)}l{name(j)}w{name(k)}" for k in range(20)) for j in range(n))
    boiler = " ".join(f"b{k}" for k in range(60))
    rows = [(i, boiler.upper() + f" {i}\n" + own(i, 2 if i % 2 else 9), "h") for i in range(60)] + [(100 + i, own(100 + i, 4), "h") for i in range(40)]
    docs = make(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in check_quality(docs)}
    assert all(got[i].kept == (i >= 60 or i % 2 == 0) for i in got)
    assert {r.doc_id for r in op9_quality.keep_good(docs).collect()} == {i for i in got if got[i].kept}
    kept = {r.doc_id: r.text for r in op9_quality.keep_good(docs).collect()}
    assert kept == {d: "\n".join(t.split("\n")[d < 60 :]) for d, t, _ in rows if d in kept}
    # copies of one text are one document, so they do not make their own lines common
    copies = make([(i, own(0, 4), "h") for i in range(200)], "doc_id long, text string, source string")
    assert op9_quality.keep_good(copies).count() == 200


def test_common_lines_of_a_large_host(make):
    # a line in 21 of 700 texts, twice in each, and one in 20 of them; far from a tenth of the host
    own = lambda i: " ".join(f"w{n}{'abcdefghij'[int(c)]}{k}" for n, c in enumerate(f"{i:03}") for k in "klmnopqrstuvwxyzabcdef")
    line, rare = "Share  this page 1", "seen too rarely"
    rows = [(i, (f"{line}\n" * 2 if i < 21 else "") + own(i) + f"\n{rare}" * (i < 20), "h") for i in range(700)]
    docs = make(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_common_words for r in check_quality(docs)}
    assert got == {i: 8 * (i < 21) for i, *_ in rows}
    good = {r.doc_id: r.text for r in op9_quality.keep_good(docs).collect()}
    assert good == {i: t.replace(f"{line}\n", "") for i, t, _ in rows}


# 10


def check_substrings(docs, length=35, **more):
    rows = [(d, SPACE_WORD.findall(t)) for d, t in pages_of(docs)]
    counts = Counter(tuple(w[i : i + length]) for _, w in rows for i in range(len(w) - length + 1))
    want = Counter()
    for d, w in rows:
        gone = {j for i in range(len(w) - length + 1) if counts[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        want[(d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    got = op10_substrings.digests(docs.select("doc_id", "text"), length, **more).collect()
    assert Counter(map(tuple, got)) == want
    return got


def test_substrings(spark, odd):
    assert any(0 < r.n_removed < r.n_words for r in check_substrings(smoke(spark, "documents")))
    check_substrings(odd)
    check_substrings(odd.limit(0))


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(make, seed):
    # a small vocabulary makes every kind of overlap, tie and self-repeat
    rng = np.random.default_rng(seed)
    rows = [(int(i), " ".join("abc"[x] for x in rng.integers(0, 2 + i % 2, rng.integers(0, 90)))) for i in range(60)]
    check_substrings(make(rows, "doc_id long, text string"), 9, anchor=3)


# 4, 5


def test_warc_rows(spark, make):
    pages = make([(5, "u", "<p>"), (3, "u\nv", "<p>"), (9, None, None), (8, "w", ""), (3, "u", "<p>"), (None, "n", "<p>"), (None, "n", "lone"), (1, "é", "日本" * 70000)],
                 "page_id long, url string, html string")

    def told(least):
        rows = []
        for r in pages.collect():
            body = (r.html or "").encode()
            ids = [q.page_id for q in pages.collect() if (q.html or "").encode() == body and q.page_id is not None]
            again = bool(ids) and r.page_id != min(ids) and len(body) >= least
            rows.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", min(ids) if again else None))
        return Counter(rows)

    assert Counter(map(tuple, op4_warc.round_trip(pages).collect())) == told(0)
    assert Counter(map(tuple, op4_warc.round_trip(pages, least_bytes=4).collect())) == told(4)
    assert op4_warc.round_trip(pages.limit(0)).count() == 0
    whole = entry.queries()["op4_warc"](spark, entry.SMOKE_DIR).collect()
    assert sorted(r.page_id for r in whole) == sorted(r.page_id for r in smoke(spark, "pages").collect())


def test_token_histogram(spark, odd):
    docs = smoke(spark, "documents").select(F.col("doc_id").alias("key"), "text").unionByName(odd.select(F.col("doc_id").alias("key"), "text"))
    import tiktoken

    ranks = op5_token_counts.read_ranks(op5_token_counts.VOCABULARY)
    encoding = tiktoken.Encoding("t", pat_str=op5_token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = [len(encoding.encode_ordinary(r.text or "")) for r in docs.collect()]
    hist = op5_token_counts.histogram(op5_token_counts.encoded_lengths(docs)).cache()
    counts = Counter(sizes)
    assert {(r.n_tokens, r.n_docs) for r in hist.collect()} == set(counts.items())
    for r in hist.collect():
        longer = [s for s in sizes if s >= r.n_tokens]
        assert (r.docs_from, r.tokens_from) == (len(longer), sum(longer))
        assert (r.docs_before, r.tokens_before) == (len(sizes) - len(longer), sum(sizes) - sum(longer))
        assert r.truncated_tokens == sum(min(s, r.n_tokens) for s in sizes)
    limits = [0, 1, 100, 1001, 10**6]
    for r in op5_token_counts.at_limits(hist, limits).collect():
        assert tuple(r)[1:] == (len(sizes), sum(sizes), sum(s > r.limit for s in sizes), sum(min(s, r.limit) for s in sizes))
    for r in op5_token_counts.quantiles(hist, [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == min(s for s in counts if sum(c for x, c in counts.items() if x <= s) >= np.ceil(r.share * len(sizes)))
    empty = op5_token_counts.histogram(op5_token_counts.encoded_lengths(docs.limit(0)))
    assert empty.count() == 0 and op5_token_counts.at_limits(empty, [5]).collect()[0][1:] == (0, 0, 0, 0)
