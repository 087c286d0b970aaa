"""From documents to tokens: the training-data operators as one pipeline of stages.

Each stage is ``(name, function(spark, docs, sf_dir))``; its result is written as Parquet
and read again as the next one's input. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query
from textlab.llm import bpe, langid, mixing, simhash, substring
from textlab.sources.storage import materialize

# A mean probability below this is close to a guess among so many languages.
MIN_SCORE = 0.3
SCORE_LANGUAGES = 4


def least_score(n_languages: int) -> float:
    """The same multiple of a guess for any number of learned languages; with one there is
    nothing to guess."""
    return MIN_SCORE * SCORE_LANGUAGES / n_languages if n_languages > 1 else 0.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letter, or a score close to a guess. The
    network learns from the labelled rows of the input that are not held out; if it learns
    nothing, documents with a letter stay."""
    model = langid.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict_languages(docs, model)
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= least_score(len(model.languages)))
    return judged.where(sure).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    return simhash.one_per_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words that occur more than once. A document may be left empty;
    the mix then takes nothing from it."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: a document may come in part or repeatedly."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed texts, decoded again to check the round trip."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode_documents(docs, path)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids",
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

# The network's weights and the permutations have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs


query("pipeline", ORACLE_SQL)(run)
