"""Sources, projections, text functions, counts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views as V
from checks.registry import ORACLES, query
from textlab.functions import text as X
from textlab.functions.dictionary import replace_entries
from textlab.operators import explore, labelled
from textlab.sources import delimited as D
from textlab.sources.ranges import read_split_csv as read_split
from textlab.sources import sinks
from textlab.sources.storage import fresh_path
from textlab.operators import logs, split
from textlab.streaming.clean import clean_stream, read_text_stream

STOP_SQL = "[" + ", ".join(f"'{h}'" for h in X.STOP_HASHTAGS) + "]"
TAG = r"#[\p{L}\p{N}_]+"
SPACE_SQL = "'" + X.SPACE_CHARS.replace("'", "''") + "'"
SPACE_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
CSV_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])


def emoji_sql(t: str) -> str:
    # Longest first; none of the names holds an emoji.
    for e, n in V.EMOJI.items():
        t = f"replace({t}, '{e}', '::{n}::')"
    return t


def tags_sql(t: str) -> str:
    return (
        f"CASE WHEN list_has_any(regexp_extract_all({t}, '{TAG}'), {STOP_SQL}) "
        f"THEN regexp_replace({t}, '{TAG}', '<HASHTAG>', 'g') ELSE {t} END"
    )


def mentions_sql(t: str) -> str:
    return rf"regexp_replace({t}, '@[\p{{L}}\p{{N}}_]{{1,15}}', '<USER>', 'g')"


def urls_sql(t: str) -> str:
    return rf"regexp_replace({t}, 'https?://[^{SPACE_CLASS}]+', '<URL>', 'g')"


def strip_sql(t: str) -> str:
    return f"trim({t}, {SPACE_SQL})"


CLEAN_CTE = f"""{V.TWEETS_CTE},
named AS (SELECT row_id, label, text AS raw, {emoji_sql('text')} AS text FROM tweets),
tagged AS (SELECT row_id, label, raw, {tags_sql('text')} AS text FROM named),
cleaned AS (SELECT row_id, label, raw, {strip_sql(urls_sql(mentions_sql('text')))} AS text FROM tagged)"""


def tweet_sql(expr: str) -> str:
    return f"WITH {V.TWEETS_CTE} SELECT row_id, {expr} AS text FROM tweets"


# -- sources and sinks ------------------------------------------------------

@query("read_labelled_csv", f"WITH {V.TWEETS_CTE} SELECT row_id, text, label FROM tweets")
def read_labelled_csv(spark, sf):
    path = D.write_csv(V.tweets(spark, sf), fresh_path(spark, "tweets-csv"))
    return D.read_labelled_csv(spark, path, CSV_SCHEMA)


@query("read_split_csv", f"""WITH {V.TWEETS_CTE}
SELECT row_id, concat('"', text, chr(10), '",', chr(10)) AS text, label FROM tweets""")
def read_split_csv(spark, sf):
    """Texts with quotes and line breaks in them, read by byte ranges."""
    odd = F.concat(F.lit('"'), "text", F.lit('\n",\n'))
    path = D.write_csv(V.tweets(spark, sf).withColumn("text", odd), fresh_path(spark, "split-csv"))
    return read_split(spark, path, CSV_SCHEMA)


@query("read_many", f"""WITH {V.TWEETS_CTE}
SELECT row_id, text, label FROM tweets UNION ALL
SELECT row_id, text, CAST(NULL AS INTEGER) AS label FROM tweets""")
def read_many(spark, sf):
    tweets = V.tweets(spark, sf)
    full = D.write_csv(tweets, fresh_path(spark, "full"))
    bare = D.write_csv(tweets.drop("label"), fresh_path(spark, "bare"))
    two = T.StructType(CSV_SCHEMA.fields[:2])
    return D.read_many(spark, [full, bare], CSV_SCHEMA, {bare: two})


@query("convert_delimited", f"WITH {V.TWEETS_CTE} SELECT row_id, text, label FROM tweets")
def convert_delimited(spark, sf):
    tsv = D.write_csv(V.tweets(spark, sf), fresh_path(spark, "tweets") + ".txt", sep="\t")
    return D.read_labelled_csv(spark, D.convert_delimited(spark, tsv, schema=CSV_SCHEMA), CSV_SCHEMA)


@query("clean_directory", f"""WITH {CLEAN_CTE}
SELECT row_id, text, label, 'txt' AS kind FROM cleaned UNION ALL
SELECT row_id, text, label, 'csv' AS kind FROM cleaned""")
def clean_directory(spark, sf):
    folder = fresh_path(spark, "folder")
    tweets = V.tweets(spark, sf)
    for kind, sep in (("txt", "\t"), ("csv", ",")):
        tweets.write.options(**D.WRITE_OPTIONS, sep=sep, extension=kind).csv(f"{folder}/{kind}")
    swept = D.clean_directory(spark, folder, CSV_SCHEMA, "text")
    return swept.select("row_id", "text", "label", F.right("file", F.lit(3)).alias("kind"))


@query("write_ranked_trials", f"""WITH {V.EPOCHS_CTE}, best AS (
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, epoch) AS rn FROM epochs)
SELECT run_id, CAST(epoch + 1 AS INTEGER) AS iteration, f1 FROM best WHERE rn = 1
ORDER BY f1 DESC, run_id LIMIT 5""")
def write_ranked_trials(spark, sf):
    reports = V.epochs(spark, sf).select("run_id", (F.col("epoch") + 1).alias("iteration"), "f1")
    best = logs.best_per_trial(reports, "run_id")
    path = sinks.write_ranked_trials(best, fresh_path(spark, "trials"), tie="run_id")
    return spark.read.schema("run_id bigint, iteration int, f1 double").csv(path, header=True)


@query("write_summary", f"""WITH {V.PREDICTIONS_CTE}
SELECT 'bert-cls' AS "EMB_MODEL", 20 AS "MAX_EPOCHS", CAST(NULL AS DOUBLE) AS "REDUX",
  round(avg(CAST(label = pred AS INTEGER)), 6) AS test_accuracy
FROM predictions""")
def write_summary(spark, sf):
    from textlab.operators.metrics import accuracy

    row = accuracy(V.predictions(spark, sf)).select(V.r6("accuracy").alias("test_accuracy"))
    config = {"EMB_MODEL": "bert-cls", "MAX_EPOCHS": 20, "REDUX": None, "test_accuracy": -1.0}
    path = sinks.write_summary(row, fresh_path(spark, "summary"), config)
    schema = "EMB_MODEL string, MAX_EPOCHS int, REDUX double, test_accuracy double"
    return spark.read.schema(schema).json(path)


@query("save_run", f"""WITH {V.LABELLED_CTE}
SELECT ntile(5) OVER (ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS fold,
  row_id, label FROM labelled""")
def save_run(spark, sf):
    folds = split.kfold(V.labelled_tweets(spark, sf)).select("fold", "row_id", "label")
    path = sinks.save_run(fresh_path(spark, "run"), folds=folds, split_by="fold")
    back = spark.read.schema("row_id bigint, label int, fold int").parquet(f"{path}/folds")
    return back.select(F.col("fold").cast("bigint").alias("fold"), "row_id", "label")


@query("preview", f"WITH {V.TWEETS_CTE} SELECT row_id, text, label FROM tweets ORDER BY row_id LIMIT 5")
def preview(spark, sf):
    return labelled.preview(V.tweets(spark, sf))


# -- projections and predicates ---------------------------------------------

@query("labelled", f"WITH {V.TWEETS_CTE} SELECT row_id, text, label FROM tweets")
def labelled_table(spark, sf):
    raw = V.tweets(spark, sf).withColumnsRenamed({"text": "Tweet text", "label": "Label"})
    return labelled.labelled(raw)


@query("rename_positional", f'WITH {V.TWEETS_CTE} SELECT text AS "Tweet", label AS "Label" FROM tweets')
def rename_positional(spark, sf):
    return labelled.rename_positional(V.tweets(spark, sf).select("text", "label"))


@query("cast_label", f"""WITH {V.TWEETS_CTE}
SELECT row_id, CAST(label AS DOUBLE) AS target, CAST(label AS BIGINT) AS class FROM tweets""")
def cast_label(spark, sf):
    return V.tweets(spark, sf).select(
        "row_id", labelled.cast_label("label", False).alias("target"),
        labelled.cast_label("label", True).alias("class"),
    )


@query("has_stop_hashtag", f"""WITH {V.TWEETS_CTE}
SELECT row_id, list_has_any(regexp_extract_all(text, '{TAG}'), {STOP_SQL}) AS listed FROM tweets""")
def has_stop_hashtag(spark, sf):
    return V.tweets(spark, sf).select("row_id", X.has_stop_hashtag("text").alias("listed"))


@query("take_split", f"""WITH {V.TWEETS_CTE}
SELECT row_id, text, label FROM tweets
WHERE row_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def take_split(spark, sf):
    ids = V.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("row_id"))
    return split.take_split(V.tweets(spark, sf), ids)


@query("merge_record", f"""WITH {V.PREDICTIONS_CTE}
SELECT row_id, 42 AS "SEED", label, 1 AS pred FROM predictions""")
def merge_record(spark, sf):
    rows = V.predictions(spark, sf).select("row_id", "label", "pred")
    return labelled.merge_record(rows, {"SEED": 42, "pred": 1}).select("row_id", "SEED", "label", "pred")


# -- text functions ---------------------------------------------------------

@query("demojize", tweet_sql(emoji_sql("text")))
def demojize(spark, sf):
    return V.tweets(spark, sf).select("row_id", X.demojize("text").alias("text"))


@query("demojize_automaton", ORACLES["demojize"])
def demojize_automaton(spark, sf):
    """The same by the automaton that takes dictionaries of any size."""
    tweets = V.tweets(spark, sf)
    return tweets.select("row_id", replace_entries(spark, "text", V.EMOJI).alias("text"))


@query("emoji_tokens", f"""WITH {V.TWEETS_CTE},
lists AS (SELECT row_id, regexp_extract_all(text, '{V.EMOJI_PATTERN}') AS e FROM tweets),
spread AS (SELECT row_id, unnest(e) AS emoji, generate_subscripts(e, 1) - 1 AS pos FROM lists)
SELECT row_id, CAST(pos AS INTEGER) AS pos, emoji,
  CASE emoji WHEN '😂' THEN 'face_with_tears_of_joy' ELSE 'red_heart' END AS name
FROM spread""")
def emoji_tokens(spark, sf):
    names = spark.createDataFrame(list(V.EMOJI.items()), "emoji string, name string")
    return explore.emoji_tokens(V.tweets(spark, sf), names, X.emoji_pattern(V.EMOJI))


@query("hashtags", f"""WITH {V.TWEETS_CTE}
SELECT row_id, array_to_string(regexp_extract_all(text, '{TAG}'), ' ') AS tags FROM tweets""")
def hashtags(spark, sf):
    return V.tweets(spark, sf).select("row_id", F.array_join(X.hashtags("text"), " ").alias("tags"))


@query("mask_hashtags", tweet_sql(tags_sql("text")))
def mask_hashtags(spark, sf):
    return V.tweets(spark, sf).select("row_id", X.mask_hashtags("text").alias("text"))


# RE2 has no look-ahead: take the character behind the tag along and put it back.
@query("mask_hashtags_listed", tweet_sql(
    "regexp_replace(regexp_replace(text || ' ', '#(" + "|".join(h[1:] for h in X.STOP_HASHTAGS)
    + r")([^\p{L}\p{N}_])', '<HASHTAG>\2', 'g'), ' $', '')"
))
def mask_hashtags_listed(spark, sf):
    return V.tweets(spark, sf).select("row_id", X.mask_hashtags("text", mode="listed").alias("text"))


@query("mask_mentions", tweet_sql(mentions_sql("text")))
def mask_mentions(spark, sf):
    return V.tweets(spark, sf).select("row_id", X.mask_mentions("text").alias("text"))


@query("mask_urls", tweet_sql(urls_sql("text")))
def mask_urls(spark, sf):
    return V.tweets(spark, sf).select("row_id", X.mask_urls("text").alias("text"))


@query("strip_text", tweet_sql(strip_sql("text")))
def strip_text(spark, sf):
    return V.tweets(spark, sf).select("row_id", X.strip_text("text").alias("text"))


@query("clean_text", f"WITH {CLEAN_CTE} SELECT row_id, text, label FROM cleaned")
def clean_text(spark, sf):
    return labelled.clean(V.tweets(spark, sf))


@query("with_prompt", tweet_sql(f"'{X.PROMPT}' || text"))
def with_prompt(spark, sf):
    return V.tweets(spark, sf).select("row_id", X.with_prompt("text").alias("text"))


@query("clean_text_stream", f"""SELECT doc_id, {strip_sql(urls_sql(mentions_sql('t')))} AS text
FROM (SELECT doc_id, {tags_sql('text')} AS t FROM documents)""")
def clean_text_stream(spark, sf):
    schema = V.table(spark, sf, "documents").schema
    stream = read_text_stream(spark, sf, schema, "documents.parquet")
    out = fresh_path(spark, "stream")
    done = clean_stream(stream.select("doc_id", "text"), out, fresh_path(spark, "stream-state"))
    done.awaitTermination()
    return spark.read.schema("doc_id bigint, text string").parquet(out)


# -- counts -----------------------------------------------------------------

@query("count_labels", f"""WITH {V.TWEETS_CTE}
SELECT label, count(*) AS count FROM tweets WHERE label IS NOT NULL GROUP BY label""")
def count_labels(spark, sf):
    return explore.count_labels(V.tweets(spark, sf))


HASHTAGS_SQL = f"""WITH {V.TWEETS_CTE},
tags AS (SELECT unnest(regexp_extract_all(text, '{TAG}')) AS hashtag FROM tweets)
SELECT hashtag, count(*) AS count FROM tags GROUP BY hashtag"""


@query("count_hashtags", HASHTAGS_SQL)
def count_hashtags(spark, sf):
    return explore.count_hashtags(V.tweets(spark, sf))


@query("top_hashtags", HASHTAGS_SQL + " ORDER BY count DESC, hashtag LIMIT 10")
def top_hashtags(spark, sf):
    return explore.count_hashtags(V.tweets(spark, sf), k=10)


@query("hashtag_label_balance", f"""WITH {CLEAN_CTE},
tags AS (SELECT label, unnest(regexp_extract_all(text, '{TAG}')) AS hashtag FROM cleaned)
SELECT hashtag, count(*) AS count, count(label) AS labelled,
  CAST(coalesce(sum(label), 0) AS BIGINT) AS positive
FROM tags GROUP BY hashtag""")
def hashtag_label_balance(spark, sf):
    """Hashtags of the cleaned corpus with the balance of the labels they occur under."""
    cleaned = labelled.clean(V.tweets(spark, sf))
    tags = cleaned.select("label", explore.exploded_hashtags("text"))
    counts = tags.where(F.col("hashtag").isNotNull()).groupBy("hashtag").agg(
        F.count(F.lit(1)).alias("count"), F.count("label").alias("labelled"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("positive"),
    )
    return explore.top(counts, "count", "hashtag")
