"""Replacing the entries of a dictionary of any size in a text column.

The entries become an Aho-Corasick automaton: a text is read once, whatever the number of
entries, and the longest entry is taken at the first place where one matches. The automaton
is built on the driver, like the dictionary it comes from, and broadcast; Arrow batches pass
through it in Python. For short dictionaries `text.demojize` stays in the JVM instead.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Regional indicators stand for the letters A to Z; tag characters for ASCII behind a flag.
_REGIONAL, _TAG, _BLACK_FLAG, _TAG_END = 0x1F1E6, 0xE0000, 0x1F3F4, 0xE007F
JOINER, VARIATION = "‍", "️"


def flag_sequence(code: str) -> str:
    """The emoji of a region: two letters give a pair of regional indicators, longer codes
    (a subdivision such as ``gbsct``) a black flag with tags."""
    low = code.lower().replace("-", "")
    if not low.isascii() or not low.isalnum() or len(low) < 2:
        raise ValueError(f"no region code: {code!r}")
    if len(low) == 2:
        return "".join(chr(_REGIONAL + ord(c) - ord("a")) for c in low)
    return chr(_BLACK_FLAG) + "".join(chr(_TAG + ord(c)) for c in low) + chr(_TAG_END)


def flag_names(regions: Mapping[str, str]) -> dict[str, str]:
    """Dictionary entries for flags from region codes and their names."""
    return {flag_sequence(code): name for code, name in regions.items()}


def with_variants(names: Mapping[str, str]) -> dict[str, str]:
    """A dictionary that also has every entry without its variation selectors, and joined
    sequences with or without them behind each part, as texts hold them."""
    out = dict(names)
    for entry, name in names.items():
        bare = entry.replace(VARIATION, "")
        if bare:
            out.setdefault(bare, name)
        parts = bare.split(JOINER)
        if len(parts) > 1 and all(parts):
            out.setdefault(JOINER.join(p + VARIATION for p in parts), name)
    return out


def build_automaton(entries: Mapping[str, str]) -> ahocorasick.Automaton:
    """Automaton of the entries with their size and replacement."""
    if not entries or "" in entries:
        raise ValueError("the dictionary is empty or has an empty entry")
    out = ahocorasick.Automaton()
    for entry, new in entries.items():
        out.add_word(entry, (len(entry), new))
    out.make_automaton()
    return out


def replace_all(automaton: ahocorasick.Automaton, text: str, left: str, right: str) -> str:
    """The text with every match, longest first from the left, replaced. All matches are
    looked at, since a longer entry may begin and fail around a shorter one."""
    longest: dict[int, tuple[int, str]] = {}
    for end, (size, new) in automaton.iter(text):
        longest[end + 1 - size] = (end + 1, new)  # ends only grow
    if not longest:
        return text
    out, at = [], 0
    for start in sorted(longest):
        if start >= at:
            end, new = longest[start]
            out += (text[at:start], left, new, right)
            at = end
    return "".join([*out, text[at:]])


@lru_cache(2)
def _loaded(data: bytes) -> ahocorasick.Automaton:
    return pickle.loads(data)


def replace_entries(
    spark: SparkSession, col: Column | str, entries: Mapping[str, str], delimiters: tuple[str, str] = ("::", "::"),
) -> Column:
    """Every dictionary entry in a text replaced by its value between delimiters, the longest
    entry first, left to right; matches do not overlap. Null stays null."""
    shared = spark.sparkContext.broadcast(pickle.dumps(build_automaton(entries)))
    left, right = delimiters

    @pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _loaded(shared.value)
        for texts in batches:
            yield texts.map(lambda t: t if t is None else replace_all(automaton, t, left, right))

    return replaced(F.col(col) if isinstance(col, str) else col)
