"""URL filter: a blocked Bloom filter in front of an exact join with the listed rules.

A rule is a host and the start of a path; it fits that host and its subdomains. The
canonical form of a rule is host + path. A url could meet a rule only in one of few forms:
a suffix of its host with as many labels as some rule has, and a prefix of its path as long
as that of some rule. Those forms are tested against a Bloom filter of all listed forms
whose bits for one key lie in one 256-bit block. What passes goes to a join with the
rules on the full form, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.operators.small import lookup_join

BITS_A_KEY = 16
BLOCK_BITS = 256
# The filter is broadcast: at most 2**17 blocks of 32 bytes, 4 MB. Longer lists only let
# more false positives through to the join.
MAX_BLOCKS = 1 << 17
_WORDS = BLOCK_BITS // 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical_rules(rules: DataFrame) -> DataFrame:
    """``host, path, verdict`` rules as ``form, rule, verdict, n_labels, n_path``. Hosts are
    lower-cased, null paths are empty, and rules without a host or verdict fit nothing.
    Of equal rules one is kept, ``block`` before ``allow``."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    path = F.coalesce("path", F.lit(""))
    return (
        rules.where("host <> '' AND verdict IS NOT NULL")
        .select(host.alias("host"), path.alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(F.concat("host", "path").alias("form"), F.concat("host", "path").alias("rule"),
                "verdict", F.size(F.split("host", r"\.")).alias("n_labels"),
                F.length("path").alias("n_path"))
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 40), F.lit(blocks).cast("bigint"))


def _bit(key: Column, word: int) -> Column:
    """The bit set in one 32-bit word of the block."""
    place = F.shiftrightunsigned(key, 5 * word).bitwiseAND(F.lit(31)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom_blocks(forms: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``block, w0 .. w7``: the filter of the column ``form``, one row per filled block."""
    blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_A_KEY // BLOCK_BITS)))
    key = F.xxhash64("form")
    rows = forms.select(_block(key, blocks).alias("block"), *[
        _bit(key, w).alias(f"w{w}") for w in range(_WORDS)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(_WORDS)]), blocks


def possible_forms(urls: DataFrame, labels: list[int], paths: list[int]) -> DataFrame:
    """``url`` (distinct) and every ``form`` a listed rule could have: host suffixes of
    ``labels`` labels with path prefixes of ``paths`` characters."""
    host, path = host_and_path(F.col("url"))
    cut = urls.select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    hosts = F.filter(F.array(*[F.lit(n) for n in labels]),
                     lambda n: n <= F.size(F.split("host", r"\.")))
    ends = F.filter(F.array(*[F.lit(n) for n in paths]), lambda n: n <= F.length("path"))
    return (
        cut.withColumn("_n", F.explode(hosts)).withColumn("_m", F.explode(ends))
        .select("url", F.concat(
            F.expr("substring_index(host, '.', -_n)"), F.expr("substring(path, 1, _m)")).alias("form"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    Of the rules that fit, the longest counts (of equally long ones that with the longer
    host); without one, ``rule`` is null and the verdict is ``default``. Null urls and
    those without ``://`` have an empty host and path and meet no rule. Every input row,
    repeated ones included, gives one output row; columns of these names are replaced.
    """
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    listed = canonical_rules(rules)
    shape = listed.agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("n_labels").alias("labels"),
        F.collect_set("n_path").alias("paths")).first()  # distinct small integers
    host, path = host_and_path(F.col(url))
    out = pages.withColumn("host", host).withColumn("path", path)
    if not shape["n"]:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    blocks, n_blocks = bloom_blocks(listed.select("form"), shape["n"])
    urls = pages.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    forms = possible_forms(urls, sorted(shape["labels"]), sorted(shape["paths"]))
    key = F.xxhash64("form")
    inside = F.lit(True)
    for w in range(_WORDS):
        inside = inside & (F.col(f"w{w}").bitwiseAND(_bit(key, w)) != 0)
    maybe = (
        forms.withColumn("block", _block(key, n_blocks))
        .join(F.broadcast(blocks), "block").where(inside).select("url", "form")
    )
    exact = lookup_join(maybe, listed.select("form", "rule", "verdict", "n_path"), "form")
    best = exact.groupBy(F.col("url").alias("_url")).agg(F.max_by(
        F.struct("rule", "verdict"),
        F.struct(F.length("rule"), -F.col("n_path"))).alias("_best"))
    return (
        out.join(best, F.col(url) == F.col("_url"), "left")
        .withColumn("rule", F.col("_best.rule"))
        .withColumn("verdict", F.coalesce("_best.verdict", F.lit(default)))
        .drop("_url", "_best")
    )
