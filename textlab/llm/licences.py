"""Licence scan by digests of canonical texts, in DataFrame functions only.

Every line is put into a canonical form: lower case, everything but letters and digits one
space, equivalent spellings alike, also across lines; copyright lines vanish. The digest of
all lines of a text joins with the digests of known licences. The digests of single lines join with those
of known notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm.licence_texts import EQUIVALENT, LICENCES, NOTICES, full_texts
from textlab.operators.small import MAX_SMALL_ROWS

LINE_BREAK = r"\r\n|\n|\r"
# Only a line with a holder is a copyright line: a sign, a year, 'by' or a blank to fill in
# after the word, or a name after 'Copyright'.
HOLDER = (r"^[^\p{L}\p{N}©]*(?:(?i:©|all rights reserved|\(c\) *\d"
          r"|(?:\(c\) *)?copyright[\s,:.–—-]*(?:©|&copy;|\(c\)|\d|by\b|[\[<{]))"
          r"|(?:\([cC]\) *)?Copyright\s+(?!(?:Act|Disclaimer|Holder|Interest|Law|Licen[cs]e|Notice|Owner"
          r"|Statement)s?\b)\p{Lu})")
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    """Canonical form of a line, empty for a copyright line."""
    low = F.lower(line)
    kept = F.when(line.rlike(HOLDER), F.lit("")).otherwise(low)
    return _respelled(F.regexp_replace(kept, NOT_A_WORD, "  "), EQUIVALENT)


def _respelled(words: Column, spellings: list[tuple[str, str]]) -> Column:
    """Words in their standard spelling. They come with two spaces in between, so that
    neighbours do not share one."""
    words = F.concat(F.lit(" "), words, F.lit(" "))
    for variant, standard in spellings:
        words = F.replace(words, F.lit(f" {_wide(variant)} "), F.lit(f" {_wide(standard)} "))
    return F.replace(F.trim(words), F.lit("  "), F.lit(" "))


def _wide(words: str) -> str:
    return words.replace(" ", "  ")


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text that are not empty; none for null."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.filter(F.transform(lines, canonical_line), lambda x: x != "")


def digest(lines: Column) -> Column:
    """Digest of the joined lines; spellings of several words may lie on two lines."""
    several = [x for x in EQUIVALENT if " " in x[0]]
    return F.sha2(_respelled(F.array_join(F.transform(
        lines, lambda x: F.replace(x, F.lit(" "), F.lit("  "))), "  "), several), 256)


def known_digests(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """``digest, licence, n_chars`` of known texts: one row per canonical text, of several
    identifiers the first by name."""
    known = spark.createDataFrame(entries, "licence string, text string")
    lines = canonical_lines(F.col("text"))
    return known.select("licence", digest(lines).alias("digest"),
                        F.length(F.array_join(lines, " ")).alias("n_chars")
                        ).groupBy("digest").agg(F.min("licence").alias("licence"),
                                                F.first("n_chars").alias("n_chars"))


def scan_licences(
    docs: DataFrame, text: str = "text", licences: list[tuple[str, str]] | None = None,
    notices: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """``docs`` with ``digest`` (SHA-256 of the canonical text), ``licence`` (the known one
    with that digest, else null) and ``notices``: identifiers of the known notices among
    its lines, sorted, without repeats, joined by commas (null if none).

    The lists default to the built-in ones and are given as Python lists; known digests are
    broadcast if there are few of them, else the join is shuffled. Null and empty texts have the
    digest of the empty text and no licence. Rows are not matched to each other: repeated
    rows give equal results. Columns with the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    licences = [*LICENCES, *full_texts()] if licences is None else licences
    whole, n_known = known_digests(spark, licences), len(licences)
    single = known_digests(spark, NOTICES if notices is None else notices)
    listed = single.collect()  # as many as the given list
    longest = max((r.n_chars for r in listed), default=0)
    table = F.create_map(*[F.lit(x) for r in listed for x in (r.digest, r.licence)])
    docs = docs.drop("digest", "licence", "notices")
    # The row in one piece, so that no column of it can meet those added here. The canonical
    # text travels once: lines that may be notices and the digest of all.
    cut = docs.select(F.struct(*docs.columns).alias("row"), canonical_lines(F.col(text)).alias("lines"))
    short = F.filter("lines", lambda x: F.length(x) <= longest)
    hashed = cut.select("row", digest(F.col("lines")).alias("digest"),
                        F.transform(short, lambda x: F.sha2(x, 256)).alias("hits"))
    known = whole.drop("n_chars").where("digest <> sha2('', 256)")
    found = hashed.join(F.broadcast(known) if n_known <= MAX_SMALL_ROWS else known, "digest", "left")
    names = F.array_sort(F.array_distinct(F.filter(
        F.transform("hits", lambda h: F.element_at(table, h)), lambda x: x.isNotNull())))
    return found.select(
        "row.*", "digest", "licence", F.when(F.size(names) > 0, F.array_join(names, ",")).alias("notices"))
