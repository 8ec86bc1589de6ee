"""Operators 11 to 13 against plain single-machine versions and the library's own encoding."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phylomart.llm import op11_codes, op12_byte_bpe, op13_filter_audit


def smoke(spark, name):
    return spark.read.parquet(f"{entry.SMOKE_DIR}/{name}.parquet")


# 11


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    rows = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(rows[0][2]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (gap(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for r in rows:
                got[near(cut(r[2], p), books[p])].append(cut(r[2], p))
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e], strict=True)] if e in got else old for e, old in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, label, q in rows:
        codes = [near(cut(q, p), books[p]) for p in range(parts)]
        error = sum(gap(cut(q, p), books[p][codes[p]]) for p in range(parts))
        by_label[label] += error
        out.append((i, label, "".join(f"{c:02x}" for c in codes), error))
    digest = sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, code, error, by_label[label], digest) for i, label, code, error in out)


VECTORS = "vec_id long, vector array<float>, label int, codes string, l string"


def check_codes(make, rows, **size):
    df = make([(i, v, label, "x", "y") for i, v, label in rows], VECTORS)
    got = op11_codes.digests(*op11_codes.compress(df, **size)).collect()
    return Counter(tuple(r) for r in got)


def test_codes_small(make):
    rng = random.Random(5)
    rows = [(i if i % 17 else None, [rng.choice([rng.gauss(0, 1), 0.25, -0.5]) for _ in range(8)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(5, rows[5][1], 1)] * 40 + [(6, [1e9] * 4 + [-7.0] * 4, 2), (7, [float(np.float32(x / 7)) for x in range(8)], 2)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    odd = [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, None), (904, [], 0), (905, [1.0], 0)]
    fitting = [(i, [min(max(x, -65536.0), 65536.0) for x in v], label) for i, v, label in rows]
    assert check_codes(make, rows + odd, entries=16) == brute_codes(fitting, entries=16)


def test_codes_few_and_none(make):
    rows = [(2, [0.5, 0.5, 0.5, 0.5], None), (1, [0.5, 0.5, 0.5, -0.001], None)]
    assert check_codes(make, rows) == brute_codes(rows)
    assert not check_codes(make, []) and not check_codes(make, [(1, None, 1)])


def test_codes_restore(make):
    df = make([(i, [float(i)] * 4, 0, "", "") for i in range(5)], VECTORS)
    codes, books = op11_codes.compress(df)
    assert {(r.vec_id, tuple(r.vector)) for r in op11_codes.restored(codes, books).collect()} == {(i, (float(i),) * 4) for i in range(5)}


def test_code_tables_of_wide_values():
    rng = np.random.default_rng(3)
    block = rng.integers(-(1 << 26), 1 << 26, (50, 8))
    books = rng.integers(-(1 << 26), 1 << 26, (4, 7, 2))
    codes, errors = op11_codes.nearest(block, books)
    for p in range(4):
        full = ((block[:, None, 2 * p : 2 * p + 2] - books[p]) ** 2).sum(axis=2)
        assert (codes[p] == full.argmin(axis=1)).all() and (errors[p] == full.min(axis=1)).all()


# 12


@pytest.fixture(scope="module")
def encoder():
    return op12_byte_bpe.Encoder(op12_byte_bpe.read_ranks(op12_byte_bpe.VOCABULARY))


def plain(encoder, text):
    return encoder.encoding.encode_ordinary(text)


ODD_TEXTS = ["", " ", "  a", "a  ", "\n\n x", "it's we'll I'd 'tis ''s 'S", "日本語 テスト", "\U0001f600\U0001f600 x", "<|endoftext|> a", "\x00\x1c\x85\xa0 b", "a" * 5000, "é" * 3000, "1" * 3000, "!" * 3000]


@pytest.mark.parametrize("blank", [" ", "\n", "\t", chr(0x3000), chr(0xA0), " \n"])
@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 50_000])
def test_bpe_blank_runs(encoder, blank, n):
    run = blank * n
    for text in (run, run + "x", "x" + run, "x" + run + "y z" + run + "1" + run + "!", "x" * 2000 + run + "é" + run):
        assert encoder.encode(text) == plain(encoder, text)


def test_bpe_million_blanks(encoder):
    text = "a" + " " * 1_000_000 + "b" + "\n" * 2_000_000
    ids = encoder.encode(text)
    assert encoder.encoding.decode_bytes(ids) == text.encode()


def test_bpe_splits(encoder):
    rng = random.Random(11)
    signs = ["a", "B", "é", "日", "1", "٣", "'", "s", "t", "ll", "!", "#", " ", "  ", "\n", "\t", "\r\n", chr(0x2003), "\x1c", "\x85", "\U0001f600", "word "]
    for _ in range(300):
        text = "".join(rng.choices(signs, k=rng.randint(1, 400)))
        parts = list(op12_byte_bpe.split_safely(text, part=rng.choice([1, 2, 7, 50])))
        assert "".join(p for p, _ in parts) == text
        assert [i for p, _ in parts for i in plain(encoder, p)] == plain(encoder, text)


def test_bpe_query(spark, make, encoder):
    docs = [(r.doc_id, r.text) for r in smoke(spark, "documents").collect()]
    rows = docs + [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, None), (1, None), (1, "x y"), (1, "x y"), (2, "word " * 60_000)]
    df = make([(i, t, "e", "f") for i, t in rows], "key long, text string, ids string, bytes string")
    encoded = op12_byte_bpe.encode(df)
    got = Counter(tuple(r) for r in op12_byte_bpe.digests(op12_byte_bpe.decode(encoded)).collect())
    sha = lambda b: sha256(b).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = plain(encoder, t or "")
        want[(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert got == want
    assert encoded.columns == ["key", "ids"] and not op12_byte_bpe.encode(df.limit(0)).collect()


def test_bpe_decodes_parts_of_characters(make):
    ids = tiktoken.Encoding("own", pat_str=op12_byte_bpe.PATTERN, mergeable_ranks=op12_byte_bpe.read_ranks(op12_byte_bpe.VOCABULARY), special_tokens={}).encode_ordinary("日\U0001f600")
    df = make([(i, [x]) for i, x in enumerate(ids)] + [(99, []), (100, None)], "key int, ids array<int>")
    got = {r.key: bytes(r.bytes) for r in op12_byte_bpe.decode(df).collect()}
    assert b"".join(got[i] for i in range(len(ids))) == "日\U0001f600".encode() and got[99] == got[100] == b""


def test_bpe_other_vocabulary(spark, make):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    df = make([(1, "un deux trois")], "key long, text string")
    spark.conf.set(op12_byte_bpe.VOCABULARY_SETTING, path)
    try:
        named = op12_byte_bpe.encode(df).first().ids
    finally:
        spark.conf.unset(op12_byte_bpe.VOCABULARY_SETTING)
    assert named == op12_byte_bpe.encode(df, path).first().ids


# 13


def brute_audit(docs, labels):
    texts = [(i, t or "", lang or "") for i, t, lang in docs]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, part in texts:
        words = t.encode().split()
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t],
        }
        rows.append((part, {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[1]]
                gone = [r for r in own if f in r[1] and r not in lost and set(order[: step - 1]) & r[1]]
                left = [r for r in left if f not in r[1]]
                only = sum(r[1] == {f} for r in own)
                out[part, "".join(order), step] = [len(left), len(lost), len(gone), only, sum(r[2] for r in lost), sum(r[3] for r in lost)]
                shapley[part, f] += len(lost)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


DOCS = "doc_id long, text string, lang string, part string, mask int, first boolean"
LABELS = "doc_id long, quality int, toxic int, n int"


def check_audit(make, docs, labels, **size):
    df = make([(*d, "p", 7, True) for d in docs], DOCS)
    flagged = op13_filter_audit.flagged(df, **size)
    got = op13_filter_audit.audit(op13_filter_audit.mask_counts(flagged, make([(*x, 1) for x in labels], LABELS))).collect()
    assert len(got) == len({tuple(r)[:3] for r in got})
    assert {tuple(r) for r in got} == brute_audit(docs, labels)


LONG = " ".join(f"w{i}" for i in range(120))
AUDIT_DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "fr"), (3, LONG, "fr"), (None, LONG, "en"), (None, None, None), (4, None, ""), (5, "", "en"), (1, LONG, "de"), (1, "", "de"),
    (6, "A B C " * 60, "en"), (7, LONG + " $", "fr"), (8, LONG + " $", "fr"), (9, LONG.upper() + "\x85", None), (10, "same " * 30_000, "en"), (11, "x\x0b#", "de"),
    (12, "é日\U0001f600 A", "de"), (13, LONG.replace("w1 ", "W1 "), "en"),
]
AUDIT_LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (None, 1, 1), (8, 1, 1), (6, None, 1), (77, 1, 1)]


def test_audit_small(make):
    check_audit(make, AUDIT_DOCS, AUDIT_LABELS)
    check_audit(make, [], AUDIT_LABELS)
    check_audit(make, [(None, None, None)], [])


def test_audit_full_sketch(make):
    """A sketch too small to clear anything gives the same rows."""
    docs = AUDIT_DOCS + [(100 + i, f"text {i % 400}", "en") for i in range(600)]
    check_audit(make, docs, AUDIT_LABELS, sketch_bytes=8)


def test_audit_smoke(spark, make):
    docs = [tuple(r) for r in smoke(spark, "documents").select("doc_id", "text", "lang").collect()]
    check_audit(make, docs, [tuple(r) for r in smoke(spark, "labels").collect()])


def test_audit_prepass_clears_unique_texts(spark, make):
    df = make([(i, f"text {i}" if i < 2000 else "copy", "en", "", 0, True) for i in range(2500)], DOCS)
    slim = op13_filter_audit.judge(df)
    bits = 1 << 17
    test = op13_filter_audit.may_repeat(spark, op13_filter_audit.repeated_counters(slim, bits), bits)
    asked = df.where(test(F.xxhash64("text"))).select("text").collect()
    assert sum(r.text == "copy" for r in asked) == 500 and len(asked) < 500 + 60
