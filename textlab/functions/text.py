"""Text normalisation as native column expressions.

Every function maps a string column to a column, holds no state and runs inside
the scan stage: no Python worker and no shuffle. Null text stays null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textlab.functions.binding import let
from textlab.functions.dictionary import replace_entries
from textlab.functions.emoji_names import default_emoji_names

# Hashtags that switch on masking (exact, case-sensitive).
STOP_HASHTAGS = (
    "#the", "#a", "#is", "#to", "#on", "#you", "#be", "#it", "#for", "#me", "#and",
    "#this", "#my", "#i", "#im", "#are", "#was", "#how", "#we", "#in", "#of", "#why",
    "#our", "#or", "#he",
)
HASHTAG_MASK = "<HASHTAG>"
USER_MASK = "<USER>"
URL_MASK = "<URL>"
PROMPT = "Represent the tweet for irony classification: "

# Letters and digits of Unicode 14 and 15 which the \p{L} and \p{N}
# of Java 17 (Unicode 13) miss. Harmless on a newer Java.
NEWER_WORD_RANGES = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 "
    "A7D0-A7D1 A7D3 A7D5-A7D9 A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 "
    "10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 10780-10785 10787-107B0 107B2-107BA "
    "10F70-10F81 11071-11072 11075 1123F-11240 11740-11746 11AB0-11ABF 11F02 11F04-11F10 "
    "11F12-11F33 11F50-11F59 12F90-12FF0 1342F 13441-13446 16A70-16ABE 16AC0-16AC9 "
    "1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1D2C0-1D2D3 1DF00-1DF1E "
    "1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E4F0-1E4F9 1E7E0-1E7E6 1E7E8-1E7EB "
    "1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)

# The Unicode whitespace set, as code point ranges.
SPACE_RANGES = "9-D 1C-20 85 A0 1680 2000-200A 2028 2029 202F 205F 3000"


def _class_body(ranges: str) -> str:
    ends = (r.split("-") for r in ranges.split())
    return "".join("-".join(rf"\x{{{e}}}" for e in pair) for pair in ends)


def _chars(ranges: str) -> str:
    out = []
    for r in ranges.split():
        lo, _, hi = r.partition("-")
        out += [chr(c) for c in range(int(lo, 16), int(hi or lo, 16) + 1)]
    return "".join(out)


WORD = r"[\p{L}\p{N}_" + _class_body(NEWER_WORD_RANGES) + "]"
NOT_WORD_AHEAD = f"(?!{WORD})"
NON_SPACE = f"[^{_class_body(SPACE_RANGES)}]"
SPACE_CHARS = _chars(SPACE_RANGES)

HASHTAG = f"#{WORD}+"
MENTION = f"@{WORD}{{1,15}}"
URL = f"https?://{NON_SPACE}+"

# Above this many entries a dictionary is matched by an automaton instead of one pattern.
MAX_LITERAL_NAMES = 20_000
_NAME_SLOTS = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java_quote(s: str) -> str:
    return "".join(
        ch if ch.isascii() and ch.isalnum() else rf"\x{{{ord(ch):X}}}" for ch in s
    )


# -- emoji ------------------------------------------------------------------

def _code_class(points: set[int], gap: int = 1) -> str:
    """Regex class of code points as ranges. Holes up to ``gap`` are filled, except in
    the alphabets below U+2000."""
    spans: list[list[int]] = []
    for p in sorted(points):
        if spans and p - spans[-1][1] <= (gap if spans[-1][0] >= 0x2000 else 1):
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"


def emoji_pattern(names: Mapping[str, str]) -> str:
    """One regex matching the longest dictionary entry at each position.

    Entries are grouped by what follows their first character, so variation
    selectors and skin tones cost one branch each. A coarse look-ahead keeps
    ordinary text away from the branches.
    """
    if not names or "" in names:
        raise ValueError("the emoji dictionary is empty or has an empty entry")
    firsts: dict[str, set[int]] = {}
    for e in names:
        firsts.setdefault(e[1:], set()).add(ord(e[0]))
    coarse = _code_class(set().union(*firsts.values()), gap=0x1000)
    branches = [
        _code_class(firsts[rest]) + _java_quote(rest)
        for rest in sorted(firsts, key=lambda r: (-len(r), r))
    ]
    return f"(?={coarse})(?:{'|'.join(branches)})"


def emoji_name(token: Column, names: Mapping[str, str]) -> Column:
    """Name of one emoji; the folded literal is slotted by first code point."""
    slots: list[dict[str, str]] = [{} for _ in range(_NAME_SLOTS)]
    for e, n in names.items():
        slots[ord(e[0]) % _NAME_SLOTS][e] = n
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")
    return F.element_at(F.get(table, F.ascii(token) % _NAME_SLOTS), token)


def _may_hold_emoji(c: Column, names: Mapping[str, str]) -> Column:
    """Byte test every text with a dictionary entry passes.

    Looks for the leading UTF-8 bytes of the entries, so most text of accented alphabets
    never reaches the regex.
    """
    leads = set()
    for e in names:
        wide = [ch for ch in e if not ch.isascii()]
        if not wide:
            return F.lit(True)
        coded = min(wide).encode("utf-8")
        leads.add(coded[:1] if len(coded) == 3 else coded[:2])
    raw = c.cast("binary")
    test = F.lit(False)
    for lead in sorted(leads):
        test = test | F.contains(raw, F.lit(bytearray(lead)))
    return test


def demojize(
    col: Column | str,
    names: Mapping[str, str] | None = None,
    delimiters: tuple[str, str] = ("::", "::"),
) -> Column:
    """Replace every emoji by its delimited name, longest entry first, left to right.

    Text between emoji and the emoji themselves come from the same pattern, so the
    pieces interleave exactly. A dictionary of more than ``MAX_LITERAL_NAMES`` entries is
    matched by an automaton in Python instead (`dictionary.replace_entries`), with the same
    result; texts without a byte of an entry do not go there.
    """
    c = _col(col)
    names = default_emoji_names() if names is None else names
    if len(names) > MAX_LITERAL_NAMES:
        large = replace_entries(SparkSession.active(), c, names, delimiters)
        return F.when(_may_hold_emoji(c, names), large).otherwise(c)
    pattern = emoji_pattern(names)
    left, right = (F.lit(d) for d in delimiters)

    def weave(found: Column, gaps: Column) -> Column:
        named = F.transform(
            found,
            lambda t, i: F.concat(left, emoji_name(t, names), right, F.get(gaps, i + 1)),
        )
        return F.concat(F.get(gaps, F.lit(0)), F.array_join(named, ""))

    rebuilt = let(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(0)),
        lambda found: F.when(
            F.size(found) > 0, let(F.split(c, pattern, -1), lambda gaps: weave(found, gaps))
        ).otherwise(c),
    )
    return F.when(_may_hold_emoji(c, names), rebuilt).otherwise(c)


# -- hashtags, mentions, links ----------------------------------------------

def hashtags(col: Column | str) -> Column:
    """All hashtags in text order, as an array."""
    return F.regexp_extract_all(_col(col), F.lit(HASHTAG), F.lit(0))


def _stop_pattern(stop: Sequence[str]) -> str:
    if not stop:
        raise ValueError("the stop list is empty")
    if any(not h.startswith("#") for h in stop):
        raise ValueError("stop entries start with '#'")
    words = "|".join(_java_quote(h[1:]) for h in sorted(stop, key=len, reverse=True))
    return f"#(?:{words}){NOT_WORD_AHEAD}"


def has_stop_hashtag(col: Column | str, stop: Sequence[str] = STOP_HASHTAGS) -> Column:
    """Whether a whole hashtag of the text is in the stop list."""
    return _col(col).rlike(_stop_pattern(stop))


def mask_hashtags(
    col: Column | str, stop: Sequence[str] = STOP_HASHTAGS, mode: str = "all"
) -> Column:
    """Mask hashtags. ``all``: one listed hashtag masks every hashtag of the text;
    ``listed``: only the listed ones are masked."""
    c = _col(col)
    if mode == "listed":
        return F.regexp_replace(c, _stop_pattern(stop), HASHTAG_MASK)
    if mode != "all":
        raise ValueError(f"mode must be 'all' or 'listed', not {mode!r}")
    return F.when(
        has_stop_hashtag(c, stop), F.regexp_replace(c, HASHTAG, HASHTAG_MASK)
    ).otherwise(c)


def mask_mentions(col: Column | str) -> Column:
    """Replace ``@`` and up to 15 word characters; a longer handle keeps its tail."""
    return F.regexp_replace(_col(col), MENTION, USER_MASK)


def mask_urls(col: Column | str) -> Column:
    """Replace http(s) links up to the next whitespace."""
    return F.regexp_replace(_col(col), URL, URL_MASK)


def strip_text(col: Column | str) -> Column:
    """Drop Unicode whitespace at both ends (plain ``trim`` knows only the space)."""
    return F.btrim(_col(col), F.lit(SPACE_CHARS))


# -- composition ------------------------------------------------------------

def mask_text(
    col: Column | str, stop: Sequence[str] = STOP_HASHTAGS, mode: str = "all"
) -> Column:
    """Hashtags, mentions, links, then the ends. A byte test keeps text without the
    marker of a step away from its regex."""
    c = _col(col)

    def where_marked(t: Column, marker: str, step: Callable[[Column], Column]) -> Column:
        return F.when(t.contains(marker), step(t)).otherwise(t)

    return let(
        where_marked(c, "#", lambda t: mask_hashtags(t, stop, mode)),
        lambda t: let(
            where_marked(t, "@", mask_mentions),
            lambda u: strip_text(where_marked(u, "://", mask_urls)),
        ),
    )


def clean_text(
    col: Column | str,
    names: Mapping[str, str] | None = None,
    stop: Sequence[str] = STOP_HASHTAGS,
    mode: str = "all",
) -> Column:
    """Emoji names, then hashtags, mentions, links and outer whitespace."""
    return let(demojize(col, names), lambda t: mask_text(t, stop, mode))


def with_prompt(col: Column | str, prompt: str = PROMPT) -> Column:
    """Put an instruction in front of the text."""
    return F.concat(F.lit(prompt), _col(col))
