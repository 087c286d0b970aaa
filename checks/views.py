"""Input views derived from the given tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.ranks import block_rank
from textlab.sources.storage import materialize

# Emoji which the tweets view adds to the texts.
EMOJI = {"😂": "face_with_tears_of_joy", "❤️": "red_heart", "❤": "red_heart"}
EMOJI_PATTERN = "😂|❤️|❤"

TWEETS = """
SELECT d.doc_id AS row_id,
  concat(d.text,
    CASE d.doc_id % 8
      WHEN 0 THEN concat(' #the #', d.lang)
      WHEN 1 THEN concat(' #', d.lang, ' #', d.source, ' #The')
      WHEN 2 THEN concat(' @', d.source, '_a_very_long_handle')
      WHEN 3 THEN concat(' https://t.example/', d.source, '?u=@x#a tail')
      WHEN 4 THEN concat(' 😂', d.source, '❤️')
      WHEN 5 THEN ' #is #été_2 mail me@site.org'
      WHEN 6 THEN concat('   #', d.source, '  ')
      ELSE '' END) AS text,
  l.quality AS label
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

PREDICTIONS = """
SELECT doc_id AS row_id, quality AS label, 1 - toxic AS pred,
  quality * 2 + toxic AS label4, CAST(doc_id % 4 AS INT) AS pred4,
  CAST((doc_id * 37 % 101) - 50 AS DOUBLE) / 10 AS z,
  CAST(floor(doc_id / 32) AS BIGINT) AS batch_id
FROM {labels}
"""

TOKENS = """
SELECT CAST(floor(vec_id / 10) AS BIGINT) AS doc_id,
  CAST(vec_id % 10 AS INT) AS token, CAST(vec_id % 6 AS INT) AS layer, embedding
FROM {embeddings}
"""

EPOCHS_SQL = """
SELECT user_id AS run_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS epoch,
  CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS f1,
  CAST(event_id * 104729 % 1000 AS DOUBLE) / 1000 AS accuracy,
  CAST(2 + user_id % 4 AS INT) AS patience
FROM events
"""


def _plain(sql: str) -> str:
    return sql.format(documents="documents", labels="labels", embeddings="embeddings")


TWEETS_CTE = f"tweets AS ({_plain(TWEETS)})"
PREDICTIONS_CTE = f"predictions AS ({_plain(PREDICTIONS)})"
TOKENS_CTE = f"tokens AS ({_plain(TOKENS)})"
EPOCHS_CTE = f"epochs AS ({EPOCHS_SQL})"
LABELLED_CTE = f"{TWEETS_CTE}, labelled AS (SELECT * FROM tweets WHERE label IS NOT NULL)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        TWEETS, documents=table(spark, sf, "documents"), labels=table(spark, sf, "labels")
    )


def labelled_tweets(spark: SparkSession, sf: str) -> DataFrame:
    return tweets(spark, sf).where(F.col("label").isNotNull())


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(PREDICTIONS, labels=table(spark, sf, "labels"))


def predictions4(spark: SparkSession, sf: str) -> DataFrame:
    """Four logits per row next to the four-class labels."""
    z = F.col("z")
    third = (F.col("row_id") % 7).cast("double") / 7.0
    return predictions(spark, sf).select(
        "row_id", F.col("label4").alias("label"), F.col("pred4").alias("pred"), "batch_id",
        F.array(z, -z, z / 2.0, third).alias("logits"),
    )


PREDICTIONS4_CTE = f"""{PREDICTIONS_CTE}, predictions4 AS (
SELECT row_id, label4 AS label, pred4 AS pred, batch_id,
  [z, -z, z / 2.0::DOUBLE, CAST(row_id % 7 AS DOUBLE) / 7.0::DOUBLE] AS logits
FROM predictions)"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(TOKENS, embeddings=table(spark, sf, "embeddings"))


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """One log per run, stored once; a run of any length is numbered in blocks."""
    events = table(spark, sf, "events").select("event_id", "user_id")
    ranked = block_rank(events, ["user_id"], "event_id")
    thousandth = lambda p: (F.col("event_id") * p % 1000).cast("double") / 1000.0
    logs = ranked.select(
        F.col("user_id").alias("run_id"),
        (F.col("rank") - 1).cast("int").alias("epoch"),
        thousandth(7919).alias("f1"),
        thousandth(104729).alias("accuracy"),
        (2 + F.col("user_id") % 4).cast("int").alias("patience"),
    )
    return materialize(logs, "epochs")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def unrolled(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``key, dim, value`` rows of a vector column, for comparison."""
    return df.select(key, F.posexplode_outer(vector).alias("dim", "value")).select(
        key, "dim", (F.round(F.col("value").cast("double"), 6) + F.lit(0.0)).alias("value")
    )


def r6(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6) + F.lit(0.0)
