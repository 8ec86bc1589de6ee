"""Personal data: plain identifiers, and disguised ones found in a normalised text and mapped back."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. An address is found from its @; numbers from the start of a run of digits, where alone they can begin.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters and marks of other scripts that are drawn like ASCII ones; one character each.
LOOKALIKES = {
    "Cyrillic": ("асеорхуіѕјԁһԛԝАВЕКМНОРСТХЅІЈ", "aceopxyisjdhqwABEKMHOPCTXSIJ"),
    "Greek": ("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX"),
    "marks": ("﹫․‐‑‒–−", "@.-----"),
}
HOMOGLYPHS = {ord(a): b for odd, plain in LOOKALIKES.values() for a, b in zip(odd, plain, strict=True)}
HOMOGLYPHS |= {0xFEE0 + code: chr(code) for code in range(0x21, 0x7F)}  # full-width forms
for _zero in (0x0660, 0x06F0, 0x0966):  # Arabic, Persian and Devanagari digits
    HOMOGLYPHS |= {_zero + i: str(i) for i in range(10)}
ODD = re.compile("[" + re.escape("".join(map(chr, HOMOGLYPHS))) + "]")

DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_DOT = r"[\x20\t-]{1,3}dot[\x20\t-]{1,3}"
# blanks and marks that a number may have inside; a full stop at the end of a sentence is none
_SEPARATOR = r"(?:[\x20\t(),;/-]|\.(?!\x20)){0,4}"
# Runs of digit words and digits, with "plus" before and "dot" between allowed. Those with a word in them are rewritten, and
# the rules for identifiers judge the result.
SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])(?:\+|plus[\x20\t-]{{1,3}})?(?:{_DIGIT}(?![A-Za-z])|[0-9]++)(?:(?:{_DOT}|{_SEPARATOR})(?:{_DIGIT}(?![A-Za-z])|[0-9]++))++",
    re.IGNORECASE | re.ASCII,
)
SPELLED_PART = re.compile(rf"(?P<digit>{_DIGIT})|(?P<plus>plus[\x20\t-]+)|(?P<dot>{_DOT})|[0-9]+|(?P<gap>[\x20\t,;/-]+)|[^A-Za-z0-9]", re.IGNORECASE | re.ASCII)
WORD_LETTER = re.compile("[A-Za-z]")
# cheap sign that a run may have a word
DIGIT_WORD = re.compile(rf"(?<![A-Za-z]){_DIGIT}(?![A-Za-z])|[0-9]{_DOT}[0-9]", re.IGNORECASE | re.ASCII)
BRACKETED = re.compile(r"\x20{0,2}[\[({<]\x20?(at|dot|@|\.)\x20?[\])}>]\x20{0,2}", re.IGNORECASE | re.ASCII)
# Last labels that make "name at host.label" an address; labels that are also usual file endings are left out.
TLDS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|io|co|ai|app|dev|me|tv|eu|us|uk|ie|de|at|ch|fr|be|nl|lu|es|pt|it|gr|dk|se|no|fi|is|cz|sk|hu|ro|bg|hr|si"
    "|lt|lv|ee|ua|ru|tr|il|in|cn|jp|kr|tw|hk|sg|my|th|vn|id|au|nz|za|ng|ke|eg|ma|br|ar|cl|mx|pe|ca"
)
# Words before "at host.label" that point to a site.
POINTING = frozenset(
    "a an and are available be below bought browse buy call check click contact download everything explore find followed follow found free get go here "
    "home hosted info information is it join learn listed live located look looked looking looks me meet more news now of off on online or order our out "
    "page pages people posted product products published read register registered see seen services shop sign site sold start stay store subscribe "
    "team that them there this today together up us view visit was watch we website were work worked working works you".split()
)
_LABEL, _LOCAL, _SAID = "[A-Za-z0-9-]{1,63}", "[A-Za-z0-9._%+-]{1,64}", r"\x20{1,2}dot\x20{1,2}"
# name at host dot domain, in words, or name at host.domain; a lone "at" or "dot", and "at the dot", is ordinary text
WORDED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<dots>(?:{_LOCAL}{_SAID}){{0,31}})(?P<name>{_LOCAL})(?P<at>\x20{{1,2}}at\x20{{1,2}}|@)(?!(?:the|an?|this|that|my|our|your)\x20)"
    rf"{_LABEL}(?:(?:{_SAID}|\.){_LABEL}){{0,8}}?(?:{_SAID}[A-Za-z]{{2,24}}(?![A-Za-z0-9]|{_SAID}[A-Za-z])|(?P<plain>\.(?:{TLDS})(?![A-Za-z0-9@/:_-]|\.[A-Za-z0-9]|{_SAID}[A-Za-z])))",
    re.IGNORECASE | re.ASCII,
)
WORDED_PART = re.compile(r"\x20{1,2}(at|dot)\x20{1,2}", re.IGNORECASE | re.ASCII)
# Last labels that are also words of running text: a sentence may start with one where the blank after a full stop is missing.
COMMON = frozenset("ai at au be ca de es eu fi id il in info int is it ma me my name no se si us".split())
# words before an address, whose nearness decides for such a label
CUE = re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address)", re.IGNORECASE | re.ASCII)
CUE_REACH = 40
# cheap sign that one of the three may apply
AT_DOT = re.compile(r"[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]|\x20dot\x20|\x20at\x20{1,2}[a-z0-9-]{1,63}\.[a-z0-9]", re.IGNORECASE | re.ASCII)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        digit *= 1 + i % 2
        total += digit - 9 * (digit > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    """At most 255; leading zeros may be any number of digits."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: each @ is read once, so the work is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
            at = text.find("@", done)
        else:
            # the run before a later @ ends at this one
            at = text.find("@", at + 1)


def plain_spans(text: str) -> list[Span]:
    """Identifiers written plainly: by kind, then start; ends exclusive."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Tape:
    """A text under rewriting, with the source range of every character."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint ranges, given in order; a new character stands for its whole range."""
        if not edits:
            return
        parts, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            parts += (self.text[done:a], new)
            starts += self.starts[done:a]
            ends += self.ends[done:a]
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            done = b
        parts.append(self.text[done:])
        starts += self.starts[done:]
        ends += self.ends[done:]
        self.text, self.starts, self.ends = "".join(parts), starts, ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _spelled(found: re.Match) -> list[tuple[int, int, str]]:
    """Words to characters. Blanks and commas beside a digit word go between two such words, else become one blank."""
    edits, parts = [], list(SPELLED_PART.finditer(found[0]))
    for i, part in enumerate(parts):
        kind = part.lastgroup
        if kind == "gap":
            beside = sum(p.lastgroup == "digit" for p in parts[max(0, i - 1) : i + 2])
            new = ("" if beside == 2 else " ") if beside else part[0]
        elif kind:
            new = {"digit": DIGITS.get(part[0].lower()), "plus": "+", "dot": "."}[kind]
        else:
            new = part[0]
        if new != part[0]:
            edits.append((found.start() + part.start(), found.start() + part.end(), new))
    return edits


def _sentence_end(found: re.Match) -> bool:
    """Is the plain last label of "name at host.label" rather the first word of the next sentence?

    So it is where a capital follows a lower-case host, or where the label is a common word and nothing else tells of an address: no
    worded dot, no second label of the host, no cue shortly before.
    """
    label, host = found["plain"][1:], found.string[found.end("at") : found.start("plain")]
    if host.islower() and not label.islower():
        return True
    if label.lower() not in COMMON or found["dots"] or "." in host or " " in host:
        return False
    return not CUE.search(found.string, max(0, found.start() - CUE_REACH), found.start())


def _worded(found: re.Match) -> list[tuple[int, int, str]]:
    at = found.start()
    if found["plain"] and ((not found["dots"] and found["name"].lower() in POINTING) or _sentence_end(found)):
        return []
    return [(at + p.start(), at + p.end(), "@" if p[1].lower() == "at" else ".") for p in WORDED_PART.finditer(found[0])]


def normalised(text: str) -> Tape | None:
    """The text with disguises undone, or None where there is none: look-alike letters, bracketed and worded
    at/dot, spelled digits, one transducer after the other."""
    changed = False
    tape = Tape(text)
    if not text.isascii() and ODD.search(text):
        # one character for one, so places stay
        tape.text, changed = text.translate(HOMOGLYPHS), True
    if AT_DOT.search(tape.text):
        edits = [(*m.span(), "@" if m[1].lower() in ("at", "@") else ".") for m in BRACKETED.finditer(tape.text)]
        tape.rewrite(edits)
        worded = [e for m in WORDED.finditer(tape.text) for e in _worded(m)]
        tape.rewrite(worded)
        changed = changed or bool(edits or worded)
    spelled = []
    if DIGIT_WORD.search(tape.text):
        spelled = [e for m in SPELLED.finditer(tape.text) if WORD_LETTER.search(m[0]) for e in _spelled(m)]
    tape.rewrite(spelled)
    return tape if changed or spelled else None


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans: plain ones with the disguised ones that no plain span of their kind holds whole."""
    base = plain_spans(text)
    tape = normalised(text)
    if tape is None:
        return base, base
    # plain spans of one kind never meet, so both ends rise together and only the last that starts in time can hold one
    taken = {kind: ([s[1] for s in base if s[0] == kind], [s[2] for s in base if s[0] == kind]) for kind in KINDS}
    every = list(base)
    for kind, a, b in plain_spans(tape.text):
        start, end = tape.source(a, b)
        starts, ends = taken[kind]
        at = bisect_right(starts, start) - 1
        if at < 0 or ends[at] < end:
            every.append((kind, start, end))
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), *s[1:]))


SPAN = "struct<kind: string, start: int, end: int>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` (columns key, text) to (key, base array of spans, spans array of spans).

    Offsets are code points of the whole source text, ends exclusive; a null text counts as empty and has none. Each
    row is read by itself, so repeated rows agree.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [find_spans(t) if t else ([], []) for t in batch.column("text").to_pylist()]
            sides = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in p[i]] for p in pairs], _SPAN) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *sides], ["key", "base", "spans"])

    schema = f"key {docs.schema['key'].dataType.simpleString()}, base array<{SPAN}>, spans array<{SPAN}>"
    return docs.select("key", "text").mapInArrow(find, schema)


def digests(found: DataFrame) -> DataFrame:
    """The spans of ``detect`` as counts and strings."""

    def joined(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(c: str, kind: str):
        return F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("key").alias("doc_id"),
        *[count("base", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        *[count("spans", k).alias(f"n_{k}_all") for k in KINDS],
    )


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by a tag of its kind; spans that meet become one tag, of the first kind."""
    if not text:
        return text
    spans = sorted(find_spans(text)[1], key=lambda s: (s[1], -s[2]))
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    if not merged:
        return text
    marks = [("", 0, 0), *merged, ("", len(text), len(text))]
    return "".join(text[x[2] : y[1]] + (f"<{y[0].upper()}>" if y[0] else "") for x, y in pairwise(marks))


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the identifiers in ``column`` replaced by tags; all else stays, null included."""

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        return texts.map(redact_text)

    return docs.withColumn(column, replace(F.col(column)))
