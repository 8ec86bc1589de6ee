"""URL filter: host and path rules first, then a weighted vocabulary matched by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"

# (verdict, rule): a host, then the beginning of a path
RULES = (
    (ALLOW, "org/"),
    (BLOCK, "example.org/es/"),
    (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"),
    (BLOCK, "com/de/"),
)

# One strict term blocks; soft terms block once LIMIT different ones are present.
LIMIT = 2
STRICT = ("porn", "porno", "xxx", "hentai", "milf", "camgirl", "sexcam", "xvideos", "warez", "keygen")
SOFT = (
    "adult", "sex", "sexy", "nude", "erotic", "escort", "dating", "casino", "poker", "slots", "betting", "jackpot",
    "viagra", "cialis", "payday", "torrent", "crack", "serial", "gore", "webcam",
)
WEIGHTS = {**dict.fromkeys(SOFT, 1), **dict.fromkeys(STRICT, LIMIT)}

# Terms that a vocabulary table may have: it goes to every task.
MOST_TERMS = 200_000

SCHEMA = "rule string, verdict string, weight long, n_strict long, n_soft long, terms array<string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: Sequence[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules by host, the longest path first: (path, rule, verdict)."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append((slash + path, rule, verdict))
    for own in by_host.values():
        own.sort(key=lambda x: -len(x[0]))
    return by_host


def find_rule(by_host: Mapping[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule that fits the host or one of its parent domains, and its verdict."""
    best: tuple[str | None, str | None] = (None, None)
    # a rule's host has as many dots as the part of the host it fits, so earlier labels can fit none
    labels = 1 + max((known.count(".") for known in by_host), default=0)
    host, at = ".".join(host.rsplit(".", labels)[-labels:]), 0
    while True:
        for start, rule, verdict in by_host.get(host[at:], ()):
            if path.startswith(start):
                if best[0] is None or len(rule) > len(best[0]):
                    best = (rule, verdict)
                break
        dot = host.find(".", at)
        if dot < 0:
            return best
        at = dot + 1


def read_vocabulary(table: DataFrame, languages: Sequence[str] | None = None, most: int = MOST_TERMS) -> dict[str, int]:
    """Weights for :func:`judge_urls` from a table (term, weight, lang), of some ``languages`` or of all rows.

    Terms are stripped of blanks and A-Z is lower-cased, as in urls; of a term given more than once the greatest weight counts. Null and empty terms,
    and weights that are null or not above 0, are left out. A table of over ``most`` terms is refused, not cut.
    """
    rows = table if languages is None else table.where(F.col("lang").isin(list(languages)))
    terms = rows.select(ascii_lower(F.trim("term")).alias("term"), F.col("weight").cast("long").alias("weight"))
    kept = terms.where("term <> '' and weight > 0").groupBy("term").agg(F.max("weight").alias("weight"))
    found = kept.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a vocabulary may have {most} terms")
    return {r.term: r.weight for r in found}


def _word(char: str) -> bool:
    return char.isascii() and char.isalnum()


def bounded_terms(automaton: ahocorasick.Automaton, text: str) -> set[str]:
    """The different terms that occur in ``text`` with no ASCII letter or digit on either side."""
    found = set()
    for end, term in automaton.iter(text):
        start = end - len(term) + 1
        if not (start and _word(text[start - 1])) and not (end + 1 < len(text) and _word(text[end + 1])):
            found.add(term)
    return found


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    weights: Mapping[str, int] = WEIGHTS,
    limit: int = LIMIT,
) -> DataFrame:
    """``pages`` with struct column ``judged`` (host, path, rule, verdict, weight, n_strict, n_soft, terms).

    A rule decides where one fits, the longest first; else the url is blocked when the weights of the different
    terms in it reach ``limit``. Rules and vocabulary are bounded configuration, sent with the task. Null and
    empty urls, and urls without ``://``, have an empty host and path and are judged by the vocabulary alone;
    null has no term and is allowed. Every row is judged by itself, so repeated rows agree. A column called
    ``judged`` is replaced; all others stay.
    """
    by_host, weights = rule_table(rules), dict(weights)

    @F.pandas_udf(SCHEMA)
    def judge(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term in weights:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for hosts, paths, urls in columns:
            out = []
            for host, path, text in zip(hosts, paths, urls, strict=True):
                rule, verdict = find_rule(by_host, host, path)
                terms = bounded_terms(automaton, text) if text and weights else set()
                weight = sum(weights[t] for t in terms)
                strict = sum(weights[t] >= limit for t in terms)
                verdict = verdict or (BLOCK if weight >= limit else ALLOW)
                out.append((rule, verdict, weight, strict, len(terms) - strict, sorted(terms)))
            yield pd.DataFrame(out, columns=["rule", "verdict", "weight", "n_strict", "n_soft", "terms"])

    host, path = host_and_path(F.col(url))
    told = judge(host, path, ascii_lower(F.col(url)))
    fields = [told[c].alias(c) for c in ("rule", "verdict", "weight", "n_strict", "n_soft", "terms")]
    return pages.withColumn("judged", F.struct(host.alias("host"), path.alias("path"), *fields))


def oracle(rules: Sequence[tuple[str, str]] = RULES, weights: Mapping[str, int] = WEIGHTS, limit: int = LIMIT) -> str:
    """The same verdicts in SQL: rules from the longest to the shortest, each term as a bounded pattern."""
    upper = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = rule.partition("/")
        fits.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash}{path}')", rule, verdict))
    rule = " ".join(f"when {test} then '{rule}'" for test, rule, _ in fits)
    told = " ".join(f"when {test} then '{verdict}'" for test, _, verdict in fits)
    hits = {t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::bigint" for t in weights}
    total = lambda terms, by: " + ".join(f"{by(t)}{hits[t]}" for t in terms) or "0::bigint"
    strict, soft = [t for t in weights if weights[t] >= limit], [t for t in weights if weights[t] < limit]
    return f"""
with cut as (select page_id, coalesce({upper.format('url')}, '') as low,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, low, {upper.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
scored as (select *, {total(weights, lambda t: f"{weights[t]} * ")} as weight, {total(strict, lambda t: "")} as n_strict,
    {total(soft, lambda t: "")} as n_soft from parts)
select page_id, host, path, case {rule} end as rule,
    case {told} when weight >= {limit} then 'block' else 'allow' end as verdict, weight, n_strict, n_soft
from scored"""
