"""Byte-level BPE: whole texts to token ids by a local rank file, and ids back to bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.llm.words import chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Session setting that names another rank file.
VOCABULARY_SETTING = "spark.phylomart.vocabulary"
# Fixed value: the pattern that cuts text into pieces before the byte pairs of this vocabulary are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXT_BYTES = 1 << 20
PART = 1 << 16  # characters of a part of a long text, at least
LONG_BLANKS = 1 << 10

# Fixed value: the white space of the pattern's \s.
_BLANK = "\t-\r\x20\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BLANKS = re.compile(f"[{_BLANK}]{{{LONG_BLANKS},}}")
# A match never goes on from a letter, digit or sign into white space, and none looks back.
_BOUNDARY = re.compile(r"(?<=[!-~])(?=[ \n])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def vocabulary_of(docs: DataFrame, given: str | None) -> str:
    """The rank file: the one given, else the one the session names, else the default."""
    return given or docs.sparkSession.conf.get(VOCABULARY_SETTING, VOCABULARY)


def split_safely(text: str, part: int = PART) -> Iterator[tuple[str, bool]]:
    """(part, whole) of a text, such that the parts' tokens follow one another as in the text.

    Parts end before a blank or line end that follows a visible ASCII character: every match of the pattern ends there, and no
    match looks back. A whole part is one match: of a run of white space before a visible character the pattern takes all but the
    last one, at the end of the text all. Long runs are told apart so, because the matcher's stack grows with them. A
    stretch without boundary stays one part.
    """
    done = 0
    for run in _BLANKS.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        yield from _cut(text, done, run.start(), part)
        yield text[run.start() : last], True
        done = last
    yield from _cut(text, done, len(text), part)


def _cut(text: str, start: int, end: int, part: int) -> Iterator[tuple[str, bool]]:
    while end - start > part:
        found = _BOUNDARY.search(text, start + part, end)
        if not found:
            break
        yield text[start : found.start()], False
        start = found.start()
    if start < end:
        yield text[start:end], False


class Encoder:
    """The library's encoding by the rank file, without special tokens: their marks in a text are ordinary text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for an empty or null one."""
        if not text:
            return []
        if len(text) <= LONG_BLANKS:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part, whole in split_safely(text):
            ids += (self.whole if whole else self.encoding).encode_ordinary(part)
        return ids


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` (columns key, text; others are left out) to (key, ids array<int>); null is an empty text, which has no ids.

    Each row is encoded by itself, so repeated rows agree. The driver reads the rank file, which does not grow with the data,
    and broadcasts it. A very long text is encoded part by part.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_of(docs, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in chunks(batches, "text", TEXT_BYTES):
            ids = pa.array([encoder.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids], ["key", "ids"])

    return docs.select("key", "text").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` (columns key, ids) to (key, ids, bytes binary): the ids' bytes one after the other, which need not be UTF-8.

    Null ids give no bytes. A null or unknown id within them is an error.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_of(encoded, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: piece for piece, rank in ranks.value.items()}
        for batch in batches:
            raw = [b"".join([token[i] for i in ids or ()]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ids"), pa.array(raw, pa.binary())], ["key", "ids", "bytes"])

    return encoded.select("key", "ids").mapInArrow(run, f"key {encoded.schema['key'].dataType.simpleString()}, ids array<int>, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The ids and bytes of ``decode`` as a count and digests."""
    return decoded.select(
        F.col("key").alias("doc_id"),
        F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
