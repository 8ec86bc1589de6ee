"""Quality rules: page statistics, and lines that too many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylomart.llm.common import fresh, let
from phylomart.runtime import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT = 50  # percent of words in repeated 3-word windows
WINDOW = 3
FEW = 32  # hashes looked up one by one
# A line is common when more than MIN_DOCS documents of its host have it. Only in hosts of over MIN_DOCS * SHARE documents
# must more than one in SHARE of them have it.
MIN_DOCS = 20
SHARE = 1000
# A document is depleted when common lines hold more than half of its words.
MOST_COMMON = 2


def words_of(text: Column) -> Column:
    """Maximal runs of non-space characters; none for null.

    A text whose blanks are single spaces and line ends, the usual case, is split at one character, which
    needs no pattern.
    """
    text = F.coalesce(text, F.lit(""))
    single = F.split(F.btrim(F.replace(text, F.lit("\n"), F.lit(" "))), " ")
    every = F.split(F.btrim(text, F.lit(BLANKS)), SPACE)
    split = F.when(F.rlike(text, F.lit(r"[\x09\x0B-\x0D]|[\x20\n]{2}")), every).otherwise(single)
    return F.when(has_word(text), split).otherwise(F.array().cast("array<string>"))


def lines_of(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), has_word)


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def line_keys(text: Column) -> Column:
    """Hashes of the normalised lines, blank ones too: lower case, every run of digits 0, no blanks at the ends."""
    plain = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    return F.transform(F.split(plain, "\n"), lambda line: F.xxhash64(F.btrim(line, F.lit(BLANKS))))


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows found twice or more.

    Window hashes that occur twice are read off the sorted hashes. The places that have one are looked up in their
    list where it is short, else by sorting (hash, place) pairs; the union of the windows there is measured.
    """
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))

    def by_lookup(h: Column, twice: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, F.get(h, i)))

    def by_sorting(h: Column) -> Column:
        def beside(pairs: Column, p: Column, at: Column) -> Column:
            # beyond the ends get() is null
            same = [F.coalesce(F.get(pairs, at + k)["h"] == p["h"], F.lit(False)) for k in (-1, 1)]
            return same[0] | same[1]

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        kept = let(pairs, lambda pairs: F.filter(pairs, lambda p, at: beside(pairs, p, at)))
        return F.sort_array(F.transform(kept, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

    def measure(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
        places = let(twice, lambda t: F.when(F.size(t) <= FEW, by_lookup(h, t)).otherwise(by_sorting(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, covered))

    return F.when(last > 0, let(hashes, measure)).otherwise(0).cast("long")


def line_runs(text: Column) -> Column:
    """(key, words) of each different line that holds a word: its key, and the words of all lines of that key."""
    plain = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    # lines of one key have the same number of words
    lines = F.transform(lines_of(plain), lambda x: F.struct(F.xxhash64(F.btrim(x, F.lit(BLANKS))).alias("key"), F.size(words_of(x)).cast("long").alias("words")))

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["key"] != F.get(s, i - 1)["key"]))

        def run(i: Column, k: Column, at: Column) -> Column:
            line = F.get(s, i)
            return F.struct(line["key"].alias("key"), (line["words"] * (F.coalesce(F.get(at, k + 1), F.size(s)) - i)).alias("words"))

        return F.when(F.size(s) > 0, let(first, lambda at: F.transform(at, lambda i, k: run(i, k, at))))

    return let(F.sort_array(lines), runs)


def text_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits that tell different texts apart."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def common_lines(docs: DataFrame, host: str, min_docs: int = MIN_DOCS, share: int = SHARE) -> DataFrame:
    """(host, doc, also, words, common): for each different text of a host that has common lines, by its two hashes,
    the number of its words in them and their keys.

    Documents are counted by their different texts, so copies of one text do not make its lines common. Lines meet the
    written table of common lines row by row, and a text gathers only its own, so no list grows with the host.
    """
    doc, also = text_hashes(F.col("text"))
    slim = docs.select(F.col(host).alias("host"), doc.alias("doc"), also.alias("also"), F.col("text"))
    lines = slim.select("host", "doc", "also", F.inline(line_runs(F.col("text"))))
    # one row per line of a different text
    seen = cut_lineage(lines.groupBy("host", "doc", "also", "key").agg(F.first("words").alias("words")))
    counts = cut_lineage(seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs))
    hosts = cut_lineage(slim.select("host", "doc", "also").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs")))
    met = counts.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
    common = cut_lineage(met.where(share * F.col("n") > F.col("docs")).select("c.host", "key"))
    own = seen.alias("s").join(common.alias("c"), F.col("s.host").eqNullSafe(F.col("c.host")) & (F.col("s.key") == F.col("c.key")), "left_semi")
    return cut_lineage(own.groupBy("host", "doc", "also").agg(F.sum("words").alias("words"), F.collect_list("key").alias("common")))


def with_common(docs: DataFrame, own: DataFrame, host: str, field: str) -> tuple[DataFrame, str]:
    """``docs`` with a ``field`` of ``common_lines`` for their text, null where it has no common line, and the name of that column."""
    common, own_host, doc, also, own_doc, own_also = (fresh(docs, n) for n in ("common", "line_host", "line_doc", "line_also", "own_doc", "own_also"))
    own = own.select(F.col("host").alias(own_host), F.col("doc").alias(own_doc), F.col("also").alias(own_also), F.col(field).alias(common))
    hashed = docs.withColumns(dict(zip((doc, also), text_hashes(F.col("text")), strict=True)))
    same = (hashed[doc] == own[own_doc]) & (hashed[also] == own[own_also]) & hashed[host].eqNullSafe(own[own_host])
    return hashed.join(own, same, "left").drop(own_host, own_doc, own_also, doc, also), common


def quality(
    docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: int = SHARE, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """``docs`` (with columns text and ``host``) and struct column ``quality``.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words (words in common
    lines), kept. Rejected are documents that fail the base rules, and depleted ones, more than half of whose words
    are in lines common in their host. Null text has no words and fails; a null host is a host of its own; repeated rows are
    judged alike. A column called ``quality`` is replaced, all others stay.
    """
    docs = docs.drop("quality")
    own = common_lines(docs, host, min_docs, share)
    # measured before the join, so that a query of the measures alone moves no text
    joined, common = with_common(docs.withColumn("quality", measure(min_words, max_repeat)), own, host, "words")
    q, gone = F.col("quality"), F.coalesce(F.col(common), F.lit(0).cast("long"))
    return joined.withColumn("quality", q.withField("n_common_words", gone).withField("kept", is_kept(q, gone))).drop(common)


def is_kept(q: Column, gone: Column) -> Column:
    """Neither failed nor depleted; one expression, so that no part of it is computed twice."""
    return F.when(q["base_failed"], False).otherwise(MOST_COMMON * gone <= q["n_words"])


def measure(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> Column:
    """The base measures of column text, as a struct."""
    text = F.col("text")

    def measured(words: Column) -> Column:
        n = F.size(words).cast("long")
        lines = lines_of(text)
        length = F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.length(w))
        dups = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        base = F.struct(
            n.alias("n_words"),
            length.alias("word_chars"),
            F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
            dups.alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )
        return let(base, finish)

    def finish(q: Column) -> Column:
        return q.withField("base_failed", (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > max_repeat * q["n_words"]))

    # one expression, so that a filter on a field does not compute the others again
    return let(words_of(text), measured)


def without_lines(text: Column, common: Column) -> Column:
    """``text`` less its common lines; the others, blank ones too, stay as they are."""
    lines = F.arrays_zip(F.split(text, "\n").alias("line"), line_keys(text).alias("key"))
    kept = F.filter(lines, lambda x: ~(has_word(x["line"]) & F.array_contains(common, x["key"])))
    return F.when(common.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def digests(judged: DataFrame) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def keep_good(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts less the lines common in their host; all else stays."""
    own = common_lines(docs, host, min_docs, share)
    base = fresh(docs, "line_base")
    joined, common = with_common(docs.withColumn(base, measure()), own.withColumn("own", F.struct("words", "common")), host, "own")
    gone = F.coalesce(F.col(common)["words"], F.lit(0).cast("long"))
    kept = joined.where(is_kept(F.col(base), gone))
    return kept.withColumn("text", without_lines(F.col("text"), F.col(common)["common"])).select(*docs.columns)
