import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import planned
from textlab.functions import text as X
from textlab.functions.emoji_names import default_emoji_names
from textlab.operators import explore, labelled

NAMES = {
    "😂": "face_with_tears_of_joy", "❤️": "red_heart", "❤": "red_heart",
    "👩": "woman", "👩‍💻": "woman_technologist", "👍": "thumbs_up", "👍🏽": "thumbs_up_medium",
    "🇦🇺": "australia", "🇺🇸": "united_states",
}
PIECES = [
    "#the", "#The", "#x", "##a", "#été_2", "@bob", "@" + "n" * 20, "me@site.org", "http://t.co/a#the?u=@x",
    "https://", "http:/", " ", "\n", " ", "　", "😂", "❤️", "❤", "👩‍💻", "👩", "👍🏽", "🇦🇺🇸", "🇺🇸",
    "a", "½", "-", "$1", "\\", "é", "<USER>",
]


def run(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select("id", expr.alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["id"])]


def by_hand(text, names, stop=X.STOP_HASHTAGS):
    longest = sorted(names, key=len, reverse=True)
    out, i = "", 0
    while i < len(text):
        hit = next((e for e in longest if text.startswith(e, i)), None)
        out += f"::{names[hit]}::" if hit else text[i]
        i += len(hit) if hit else 1
    if set(re.findall(r"#\w+", out)) & set(stop):
        out = re.sub(r"#\w+", "<HASHTAG>", out)
    out = re.sub(r"@\w{1,15}", "<USER>", out)
    return re.sub(r"https?://\S+", "<URL>", out).strip()


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=8)
                .map("".join).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)),
                min_size=20, max_size=60))
def test_clean_text_equals_regex_rules(spark, texts):
    got = run(spark, texts, X.clean_text("t", NAMES))
    assert got == [by_hand(t, NAMES) for t in texts]


def test_known_tails(spark):
    texts = ["x #the #en", "x #en #The", "x @src_a_very_long_handle", "x https://t.e/s?u=@x#a tail",
             "#is #été_2 mail me@site.org", "   #s  ", None, ""]
    assert run(spark, texts, X.clean_text("t")) == [
        "x <HASHTAG> <HASHTAG>", "x #en #The", "x <USER>_handle", "x <URL> tail",
        "<HASHTAG> <HASHTAG> mail me<USER>.org", "#s", None, "",
    ]


def test_mask_modes(spark):
    texts = ["#the #then #x"]
    assert run(spark, texts, X.mask_hashtags("t")) == ["<HASHTAG> <HASHTAG> <HASHTAG>"]
    assert run(spark, texts, X.mask_hashtags("t", mode="listed")) == ["<HASHTAG> #then #x"]
    with pytest.raises(ValueError):
        X.mask_hashtags("t", mode="some")
    with pytest.raises(ValueError):
        X.mask_hashtags("t", stop=["the"])


def test_word_class_equals_python(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(i, chr(c)) for i, c in enumerate(points[: 0x3000])], "i int, c string")
    wide = spark.range(0x3000, 0x32400).where("id < 55296 or id > 57343").select(
        F.col("id").cast("int").alias("i"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    both = df.unionByName(wide)
    hit = {r["c"] for r in both.where(F.col("c").rlike(f"^{X.WORD}$")).select("c").collect()}
    want = {chr(c) for c in points if c < 0x32400 and (chr(c).isalnum() or chr(c) == "_")}
    assert hit == want
    assert {c for c in map(chr, points) if c.isspace()} == set(X.SPACE_CHARS)


def test_default_names(spark):
    assert run(spark, ["😂 ❤️ ❤ 👍🏽 1️⃣ ok 😂😂 ©"], X.demojize("t")) == [
        "::face_with_tears_of_joy:: ::red_heart:: ::red_heart:: ::thumbs_up_medium_skin_tone:: "
        "::keycap_1:: ok ::face_with_tears_of_joy::::face_with_tears_of_joy:: ::copyright::"
    ]
    names = default_emoji_names()
    assert not any(e in n for n in names.values() for e in "😂❤")
    assert run(spark, list(names), X.demojize("t")) == [f"::{n}::" for n in names.values()]


def test_ascii_dictionary_and_limits(spark):
    assert run(spark, ["a :) b"], X.demojize("t", {":)": "smile"}, ("<", ">"))) == ["a <smile> b"]
    with pytest.raises(ValueError):
        X.demojize("t", {})


def test_no_python_worker_in_cleaning(spark, sf):
    df = labelled.clean(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    plan = planned(df)
    assert "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_prompt(spark):
    assert run(spark, ["x", None], X.with_prompt("t", "Say: ")) == ["Say: x", None]


def test_counts(spark):
    df = spark.createDataFrame(
        [("#a #a #B", 1), ("#b", 0), (None, 1), ("none", None), ("#ab#a", 1)], "text string, label int")
    assert [tuple(r) for r in explore.count_hashtags(df).collect()] == [("#a", 3), ("#B", 1), ("#ab", 1), ("#b", 1)]
    assert [tuple(r) for r in explore.count_hashtags(df, k=1).collect()] == [("#a", 3)]
    assert [tuple(r) for r in explore.count_labels(df).collect()] == [(1, 3), (0, 1)]
    top = planned(explore.count_hashtags(df, k=3))
    assert "TakeOrderedAndProject" in top
    # counts are combined before the shuffle
    assert "partial_count" in planned(explore.count_hashtags(df))


def test_emoji_tokens(spark):
    df = spark.createDataFrame([(1, "😂 x ❤️👩"), (2, "none")], "row_id long, text string")
    names = spark.createDataFrame([("😂", "joy"), ("❤️", "heart")], "emoji string, name string")
    rows = explore.emoji_tokens(df, names, X.emoji_pattern(NAMES)).collect()
    assert sorted((r["row_id"], r["pos"], r["emoji"], r["name"]) for r in rows) == [
        (1, 0, "😂", "joy"), (1, 1, "❤️", "heart"), (1, 2, "👩", None)]


def test_names_of_a_table(spark):
    table = spark.createDataFrame([("😂", "joy")], "emoji string, name string")
    assert run(spark, ["😂"], X.demojize("t", explore.names_of(table))) == ["::joy::"]


def test_merge_record_narrows(spark):
    df = spark.createDataFrame([(1,)], "a int")
    row = labelled.merge_record(df, {"a": 2**40, "b": 7, "c": None, "d": True, "e": 0.5})
    assert row.dtypes == [("a", "bigint"), ("b", "int"), ("c", "string"), ("d", "boolean"), ("e", "double")]
