import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlab.functions import dictionary as D
from textlab.functions import text as X


def slow(entries, text, left="<", right=">"):
    """The longest entry first at each place, as one pattern."""
    pattern = "|".join(map(re.escape, sorted(entries, key=len, reverse=True)))
    return re.sub(pattern, lambda m: left + entries[m[0]] + right, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab😂❤️‍", min_size=1, max_size=6), min_size=1, max_size=12),
       st.text("ab😂❤️‍ ", max_size=40))
def test_as_one_pattern(words, text):
    entries = {w: f"n{i}" for i, w in enumerate(words)}
    assert D.replace_all(D.build_automaton(entries), text, "<", ">") == slow(entries, text)


def test_large_dictionary_in_linear_time():
    rng = random.Random(1)
    entries = {"".join(chr(rng.randrange(0x1F300, 0x1F6FF)) for _ in range(rng.randint(1, 5))): str(i)
               for i in range(100_000)}
    automaton = D.build_automaton(entries)
    text = "".join(rng.choice(["word ", chr(rng.randrange(0x1F300, 0x1F6FF))]) for _ in range(20_000))
    start = time.perf_counter()
    once = D.replace_all(automaton, text, "<", ">")
    first = time.perf_counter() - start
    start = time.perf_counter()
    D.replace_all(automaton, text * 10, "<", ">")
    assert time.perf_counter() - start < 40 * first + 0.5
    # The longest entry at each place, by trying every length.
    out, i = [], 0
    while i < len(text):
        n = next((n for n in range(5, 0, -1) if text[i : i + n] in entries and len(text[i : i + n]) == n), 0)
        out.append(f"<{entries[text[i : i + n]]}>" if n else text[i])
        i += n or 1
    assert once == "".join(out)


def test_both_ways_agree(spark, monkeypatch):
    names = {"😂": "joy", "❤️": "red_heart", "❤": "heart", "👩‍🚀": "astronaut", "👩": "woman", ":)": "smile"}
    texts = ["a 😂 b", "❤️❤", "👩‍🚀👩 :) :", None, "", "plain", "👩‍", "😂" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    small = df.select("i", X.demojize("t", names).alias("t")).collect()
    monkeypatch.setattr(X, "MAX_LITERAL_NAMES", 1)
    large = df.select("i", X.demojize("t", names).alias("t"))
    assert sorted(large.collect()) == sorted(small)
    alone = df.select("i", D.replace_entries(spark, F.col("t"), names).alias("t")).collect()
    assert sorted(alone) == sorted(small)


def test_flags_and_variants():
    assert D.flag_sequence("it") == "🇮🇹" and D.flag_sequence("GB-SCT") == "🏴󠁧󠁢󠁳󠁣󠁴󠁿"
    names = D.flag_names({"it": "Italy", "fr": "France"})
    assert D.replace_all(D.build_automaton(names), "x🇮🇹🇫🇷y", ":", ":") == "x:Italy::France:y"
    more = D.with_variants({"❤️‍🔥": "heart_on_fire", "☀️": "sun"})
    assert {more[e] for e in ("❤‍🔥", "❤️‍🔥️", "☀")} == {"heart_on_fire", "sun"}
    for bad in ("", "x", "日本"):
        with pytest.raises(ValueError):
            D.flag_sequence(bad)
    for bad in ({}, {"": "x"}):
        with pytest.raises(ValueError):
            D.build_automaton(bad)
