"""Vectors and metrics that are kept and grown, epochs by permutation, and repeated sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import ORACLES, query
from checks.text_queries import CLEAN_CTE, CSV_SCHEMA
from textlab.operators import metrics
from textlab.operators.embed import embed
from textlab.operators.epochs import epoch_batch, epoch_batches, store_ranks
from textlab.operators.metric_store import merged_metrics, metric_part, store_part
from textlab.operators.vector_store import embed_stored, update_store
from textlab.sources import delimited as D
from textlab.sources.storage import fresh_path
from textlab.streaming.sweep import sweep_files, swept


@query("embed_stored", f"""WITH {V.TWEETS_CTE}
SELECT row_id, true AS same, 0 AS encoded_again FROM tweets""")
def stored_embedding(spark, sf):
    """Vectors by way of the store against plain ones, and what a second run encodes."""
    tweets, store = V.tweets(spark, sf), fresh_path(spark, "vectors")
    first = embed_stored(tweets, store, "hashing-64")
    again = update_store(tweets, store, "hashing-64")
    plain = embed(tweets, "hashing", out="plain").select("row_id", "plain")
    return first.join(plain, "row_id").select(
        "row_id", (F.col("embedding") == F.col("plain")).alias("same"), F.lit(again).alias("encoded_again"))


def _in_parts(spark, scored, multiclass, weights=None):
    """Sums of four parts of scored rows, one of them stored twice, merged."""
    path = fresh_path(spark, "metrics")
    for i in (0, 1, 2, 3, 2):
        part = scored.where(F.col("row_id") % 4 == i)
        store_part(metric_part(part, multiclass, weights=weights), path, "run", f"part{i}")
    return merged_metrics(spark, path, multiclass).select(*[V.r6(c).alias(c) for c in ("loss", "accuracy", "f1")])


@query("merged_binary", ORACLES["evaluate_binary"])
def merged_binary(spark, sf):
    return _in_parts(spark, V.predictions(spark, sf), False)


@query("merged_multiclass", ORACLES["evaluate_multiclass"])
def merged_multiclass(spark, sf):
    rows = V.predictions4(spark, sf)
    return _in_parts(spark, rows, True, metrics.class_weights(rows))


@query("epoch_batches", f"""WITH {V.TWEETS_CTE}, placed AS (SELECT row_number() OVER () - 1 AS i FROM tweets)
SELECT epoch, CAST(i // 32 AS BIGINT) AS batch_id, count(*) AS n, count(*) AS n_rows, true AS found
FROM placed CROSS JOIN (VALUES (0), (3)) e(epoch) GROUP BY epoch, i // 32""")
def permuted_batches(spark, sf):
    """Sizes of the batches of two epochs, and whether the batch that holds the last place
    is found by itself."""
    ranked = store_ranks(V.tweets(spark, sf).select("row_id", "label"))
    last = (ranked.n - 1) // 32
    out = None
    for epoch in (0, 3):
        rows = epoch_batches(ranked, 32, epoch)
        alone = epoch_batch(ranked, 32, last, epoch).select("row_id")
        same = rows.where(F.col("batch_id") == last).select("row_id").exceptAll(alone).count() == 0
        sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_rows"))
        part = sizes.select(F.lit(epoch).alias("epoch"), "batch_id", "n", "n_rows", F.lit(same).alias("found"))
        out = part if out is None else out.unionByName(part)
    return out


@query("sweep_files", f"""WITH {CLEAN_CTE}
SELECT row_id, text, label, n FROM cleaned CROSS JOIN range(2) g(n)""")
def repeated_sweep(spark, sf):
    """A sweep, more files, a second sweep, and a third one that finds nothing."""
    folder, out, checkpoint = (fresh_path(spark, n) for n in ("inbox", "swept", "sweep-state"))
    tweets = V.tweets(spark, sf)
    for n in range(3):
        if n < 2:
            tweets.write.options(**D.WRITE_OPTIONS).csv(f"{folder}/drop{n}")
        sweep_files(spark, folder, out, checkpoint, CSV_SCHEMA, "text").awaitTermination()
    drop = F.regexp_extract("file", r"drop(\d)/", 1).cast("bigint")
    return swept(spark, out).select("row_id", "text", "label", drop.alias("n"))
