"""Inputs that used to end a job or to change clean text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phylomart.llm import op5_token_counts, op6_pii


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "1." * 3 + "0" * 100_000 + "7", "9" * 100_000 + ".1.1.1", "+" + "1" * 100_000, "4" * 100_000])
def test_pii_long_digit_runs(text):
    base, every = op6_pii.find_spans(text)
    zeros = text.startswith("0") or text.endswith("07")
    assert base == every == ([("ip", 0, len(text))] if zeros else [])
    assert op6_pii.redact_text(text) == ("<IP>" if zeros else text)


CLEAN = [
    "She arrived at work.No one was there.", "He was good at maths.It was easy.", "We met at noon.In the evening we left.", "They stood at attention.My friend laughed.",
    "we met at noon.in the evening we left", "He looked at once.it was late", "she is at home.me too", "We sat at Home.In the rain", "at last.so it ends", "He is at sea.IS it far",
]


@pytest.mark.parametrize("text", CLEAN)
def test_pii_sentences_without_a_blank_between(text):
    assert op6_pii.find_spans(text) == ([], []) and op6_pii.redact_text(text) == text


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("mail jane at example.it today", "jane at example.it"),
        ("Contact: jane at verein.de", "jane at verein.de"),
        ("jane at mail.example.it", "jane at mail.example.it"),
        ("jane dot doe at example.de", "jane dot doe at example.de"),
        ("jane at EXAMPLE.COM", "jane at EXAMPLE.COM"),
        ("Jane at example.org", "Jane at example.org"),
    ],
)
def test_pii_real_addresses_stay_found(text, span):
    assert [text[a:b] for k, a, b in op6_pii.find_spans(text)[1] if k == "email"] == [span]


def test_pii_added_spans_precision_and_recall(spark):
    """Disguises put into the smoke documents are all found, and the documents by themselves gain no span."""
    texts = [r.text for r in spark.read.parquet(f"{entry.SMOKE_DIR}/documents.parquet").collect() if r.text]
    assert all(base == every for base, every in map(op6_pii.find_spans, texts))
    rng, planted, found = random.Random(1), 0, 0
    disguises = [
        "jane.doe (at) example [dot] org", "jane at example dot com", "jаne@exаmple.com", "jane at example.com", "plus four nine one five one two three four five six seven",
        "one nine two dot one six eight dot zero dot one", "+1 415 five five five 0100", "alice dot smith at mail dot example dot org", "bob＠example．net",
    ]
    for text in texts:
        words = text.split(" ")
        at, what = rng.randint(0, len(words)), rng.choice(disguises)
        before = " ".join(words[:at]) + " | "
        every = op6_pii.find_spans(before + what + " | " + " ".join(words[at:]))[1]
        planted += 1
        found += any(a == len(before) and b == len(before) + len(what) for _, a, b in every)
    assert planted >= 200 and found == planted


def test_counts_of_a_million_blanks(make):
    blanks = " " * 1_000_000
    rows = [(1, blanks), (2, "a" + blanks + "b"), (3, blanks + "x" + "\n" * 1_500_000), (4, None), (5, "x" * 200_000)]
    lengths = Counter(r.n_tokens for r in op5_token_counts.encoded_lengths(make(rows, "key long, text string")).collect())
    assert sum(lengths.values()) == 5 and lengths[0] == 1
    short = make([(1, "a" + " " * 50_000 + "b")], "key long, text string")
    whole = op5_token_counts.Encoder(op5_token_counts.read_ranks(op5_token_counts.VOCABULARY)).encoding.encode_ordinary("a" + " " * 50_000 + "b")
    assert op5_token_counts.encoded_lengths(short).select(F.col("n_tokens")).first()[0] == len(whole)
