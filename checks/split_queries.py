"""Splits, folds, batches and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query
from textlab.operators import sampling, split

KEY = "md5('42:' || CAST(row_id AS VARCHAR))"
EPOCH_KEY = "md5('42:0:' || CAST(row_id AS VARCHAR))"

SPLIT_CTE = f"""{V.TWEETS_CTE}, split AS (
SELECT *, CASE WHEN row_number() OVER (ORDER BY {KEY}, row_id)
    <= floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split
FROM tweets)"""

# Sizes of the folds of a class: its places in a deal to five folds in turn.
STRATIFIED_CTE = f"""{V.LABELLED_CTE},
classes AS (SELECT label, count(*) AS n, sum(count(*)) OVER (ORDER BY label) - count(*) AS off
  FROM labelled GROUP BY label),
ends AS (SELECT label, i, sum(floor((off + n - 1 - i) / 5.0) - floor((off - 1 - i) / 5.0))
    OVER (PARTITION BY label ORDER BY i) AS cut
  FROM classes, (SELECT unnest(range(4)) AS i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEY}, row_id) AS rn FROM labelled),
folded AS (SELECT r.row_id, r.label, CAST((SELECT count(*) FROM ends e
    WHERE e.label = r.label AND e.cut < r.rn) AS INTEGER) AS fold FROM ranked r)"""


@query("exact_split", f"WITH {SPLIT_CTE} SELECT row_id, text, label, split FROM split")
def exact_split(spark, sf):
    return split.exact_split(V.tweets(spark, sf))


@query("kfold", f"""WITH {V.TWEETS_CTE} SELECT row_id, text, label,
CAST(ntile(5) OVER (ORDER BY {KEY}, row_id) - 1 AS INTEGER) AS fold FROM tweets""")
def kfold(spark, sf):
    return split.kfold(V.tweets(spark, sf))


@query("stratified_kfold", f"WITH {STRATIFIED_CTE} SELECT row_id, label, fold FROM folded")
def stratified_kfold(spark, sf):
    return split.stratified_kfold(V.labelled_tweets(spark, sf)).select("row_id", "label", "fold")


@query("fold_distribution", f"""WITH {STRATIFIED_CTE},
cells AS (SELECT label, fold, count(*) AS n_val FROM folded GROUP BY label, fold)
SELECT fold, label, CAST(sum(n_val) OVER (PARTITION BY label) - n_val AS BIGINT) AS n_train, n_val
FROM cells""")
def fold_distribution(spark, sf):
    return split.fold_distribution(split.stratified_kfold(V.labelled_tweets(spark, sf)))


@query("take_fold_train", f"WITH {STRATIFIED_CTE} SELECT row_id, label, fold FROM folded WHERE fold <> 2")
def take_fold_train(spark, sf):
    folds = split.stratified_kfold(V.labelled_tweets(spark, sf))
    return split.take_fold(folds, 2, split.TRAIN).select("row_id", "label", "fold")


@query("take_fold_validation", f"WITH {STRATIFIED_CTE} SELECT row_id, label, fold FROM folded WHERE fold = 2")
def take_fold_validation(spark, sf):
    folds = split.stratified_kfold(V.labelled_tweets(spark, sf))
    return split.take_fold(folds, 2).select("row_id", "label", "fold")


@query("train_complement", f"WITH {SPLIT_CTE} SELECT row_id FROM split WHERE split <> 'val'")
def train_complement(spark, sf):
    """Training rows as everything that is not in validation."""
    rows = split.exact_split(V.tweets(spark, sf))
    return rows.where(F.col("split") != split.VALIDATION).select("row_id")


@query("shuffled", f"WITH {V.TWEETS_CTE} SELECT row_id, text, label FROM tweets ORDER BY {EPOCH_KEY}, row_id")
def shuffled(spark, sf):
    return split.shuffled(V.tweets(spark, sf))


@query("assign_batches", f"""WITH {V.TWEETS_CTE} SELECT row_id, text, label, CAST(floor(
(row_number() OVER (ORDER BY {EPOCH_KEY}, row_id) - 1) / 32) AS BIGINT) AS batch_id FROM tweets""")
def assign_batches(spark, sf):
    return split.assign_batches(V.tweets(spark, sf), 32)


@query("batch_sizes", f"""WITH {V.TWEETS_CTE}, b AS (SELECT CAST(floor(
(row_number() OVER (ORDER BY {EPOCH_KEY}, row_id) - 1) / 32) AS BIGINT) AS batch_id,
CAST(label AS DOUBLE) AS target FROM tweets)
SELECT batch_id, count(*) AS n, coalesce(sum(target), 0) AS positive, count(*) = 1 AS single
FROM b GROUP BY batch_id""")
def batch_sizes(spark, sf):
    """Shape of every batch; a batch of one row is flagged."""
    from textlab.operators.labelled import cast_label

    batches = split.assign_batches(V.tweets(spark, sf).select("row_id", "label"), 32)
    return batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(cast_label("label", False)), F.lit(0.0)).alias("positive"),
        (F.count(F.lit(1)) == 1).alias("single"),
    )


def _u(name: str) -> str:
    key = f"md5('42:{name}:' || CAST(trial AS VARCHAR))"
    return f"(CAST(CAST('0x' || substr({key}, 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def _choice(name: str, options: str, n: int) -> str:
    return f'list_extract({options}, 1 + CAST(floor({_u(name)} * {n}) AS BIGINT)) AS "{name}"'


def _log(name: str, low: float, high: float) -> str:
    a, b = f"ln({low}::DOUBLE)", f"ln({high}::DOUBLE)"
    return f'round(exp({a} + {_u(name)} * ({b} - {a})), 9) AS "{name}"'


@query("sample_space", f"""WITH trials AS (SELECT DISTINCT user_id AS trial FROM events)
SELECT trial, {_choice('REDUX', '[NULL, 128, 256, 512]', 4)},
  {_choice('H_DIM', '[8, 16, 32, 64, 128]', 5)},
  {_log('LR', 2e-5, 5e-3)}, {_log('WEIGHT_DECAY', 1e-5, 5e-1)}, {_log('L1', 1e-6, 5e-4)},
  {_choice('DROP_RATE', '[0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE]', 4)},
  {_choice('BATCH_SIZE', '[8, 16, 32, 64]', 4)},
  CAST(2 + floor({_u('PATIENCE')} * 4) AS INTEGER) AS "PATIENCE"
FROM trials""")
def sample_space(spark, sf):
    trials = V.table(spark, sf, "events").select(F.col("user_id").alias("trial")).distinct()
    drawn = sampling.sample_space(trials)
    return drawn.withColumns({c: F.round(c, 9) for c in ("LR", "WEIGHT_DECAY", "L1")})
