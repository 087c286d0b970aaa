"""Training logs, trials, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query
from textlab.operators import logs

STOP_CTE = f"""{V.EPOCHS_CTE},
before AS (SELECT *, max(f1) OVER (PARTITION BY run_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM epochs),
marked AS (SELECT *, max(CASE WHEN prev IS NULL OR f1 >= prev THEN epoch END)
  OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last_best FROM before),
stops AS (SELECT *, min(CASE WHEN epoch - last_best >= greatest(3, patience) THEN epoch END)
  OVER (PARTITION BY run_id) AS stop FROM marked),
ran AS (SELECT * FROM stops WHERE stop IS NULL OR epoch <= stop),
summary AS (SELECT run_id, avg(accuracy) AS avg_acc, avg(f1) AS avg_f1,
  CAST(max(epoch) + 1 AS INTEGER) AS last_epoch FROM ran GROUP BY run_id)"""

BEST_CTE = f"""{V.EPOCHS_CTE}, ordered AS (
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, epoch) AS rn FROM epochs),
best AS (SELECT run_id AS trial, CAST(epoch + 1 AS INTEGER) AS iteration, f1 FROM ordered WHERE rn = 1)"""

FOLDS_CTE = f"""{STOP_CTE}, folds AS (SELECT CAST(floor(run_id / 5) AS BIGINT) AS cv,
CAST(run_id % 5 AS INTEGER) AS fold, avg_acc, avg_f1, last_epoch FROM summary)"""


def _reports(spark, sf):
    return V.epochs(spark, sf).select(
        F.col("run_id").alias("trial"), (F.col("epoch") + 1).alias("iteration"), "f1"
    )


def _folds(spark, sf):
    done = logs.run_summary(V.epochs(spark, sf))
    return done.select(
        F.floor(F.col("run_id") / 5).alias("cv"), (F.col("run_id") % 5).cast("int").alias("fold"),
        "avg_acc", "avg_f1", "last_epoch",
    )


@query("early_stop", f"""WITH {STOP_CTE}
SELECT run_id, CAST(max(epoch) + 1 AS INTEGER) AS last_epoch,
  CAST(max(last_best) AS INTEGER) AS best_epoch, max(f1) AS best_f1
FROM ran GROUP BY run_id""")
def early_stop(spark, sf):
    return logs.early_stop(V.epochs(spark, sf))


@query("early_stop_off", f"""WITH {V.EPOCHS_CTE}, o AS (SELECT *,
row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, epoch DESC) AS rn,
max(epoch) OVER (PARTITION BY run_id) + 1 AS last_epoch FROM epochs)
SELECT run_id, CAST(last_epoch AS INTEGER) AS last_epoch, epoch AS best_epoch, f1 AS best_f1
FROM o WHERE rn = 1""")
def early_stop_off(spark, sf):
    return logs.early_stop(V.epochs(spark, sf), enabled=False)


@query("epochs_run", f"WITH {STOP_CTE} SELECT run_id, epoch, f1, accuracy FROM ran")
def epochs_run(spark, sf):
    return logs.epochs_run(V.epochs(spark, sf)).select("run_id", "epoch", "f1", "accuracy")


@query("run_summary", f"""WITH {STOP_CTE}
SELECT run_id, round(avg_acc, 6) AS avg_acc, round(avg_f1, 6) AS avg_f1, last_epoch FROM summary""")
def run_summary(spark, sf):
    return logs.run_summary(V.epochs(spark, sf)).withColumns(
        {c: V.r6(c) for c in ("avg_acc", "avg_f1")}
    )


@query("improvement_flags", f"""WITH {V.EPOCHS_CTE}
SELECT run_id, epoch, f1, f1 > coalesce(max(f1) OVER (PARTITION BY run_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS improved FROM epochs""")
def improvement_flags(spark, sf):
    return logs.improvement_flags(V.epochs(spark, sf)).select("run_id", "epoch", "f1", "improved")


@query("best_per_trial", f"WITH {BEST_CTE} SELECT trial, iteration, f1 FROM best")
def best_per_trial(spark, sf):
    return logs.best_per_trial(_reports(spark, sf))


@query("rung_survivors", f"""WITH {V.EPOCHS_CTE},
reports AS (SELECT run_id AS trial, CAST(epoch + 1 AS INTEGER) AS iteration, f1 FROM epochs
  WHERE epoch + 1 IN (5, 10)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iteration
    ORDER BY f1 DESC, md5('42:' || CAST(trial AS VARCHAR))) AS rn,
  count(*) OVER (PARTITION BY iteration) AS n FROM reports)
SELECT trial, iteration, f1 FROM ranked WHERE rn <= ceil(n / 2.0)""")
def rung_survivors(spark, sf):
    return logs.rung_survivors(_reports(spark, sf))


@query("rank_trials", f"WITH {BEST_CTE} SELECT * FROM best ORDER BY f1 DESC, trial LIMIT 5")
def rank_trials(spark, sf):
    return logs.rank_trials(logs.best_per_trial(_reports(spark, sf)))


@query("rank_trials_ascending", f"WITH {BEST_CTE} SELECT * FROM best ORDER BY f1, trial LIMIT 5")
def rank_trials_ascending(spark, sf):
    return logs.rank_trials(logs.best_per_trial(_reports(spark, sf)), order="asc")


@query("best_trial", f"WITH {BEST_CTE} SELECT * FROM best ORDER BY f1 DESC, trial LIMIT 1")
def best_trial(spark, sf):
    return logs.best_trial(logs.best_per_trial(_reports(spark, sf)))


@query("best_fold", f"""WITH {STOP_CTE}
SELECT CAST(run_id AS BIGINT) AS fold, round(avg_f1, 6) AS avg_f1, last_epoch FROM summary
ORDER BY summary.avg_f1 DESC, run_id LIMIT 1""")
def best_fold(spark, sf):
    runs = logs.run_summary(V.epochs(spark, sf)).withColumnRenamed("run_id", "fold")
    return logs.best_fold(runs).select("fold", V.r6("avg_f1").alias("avg_f1"), "last_epoch")


@query("cv_stats", f"""WITH {FOLDS_CTE}
SELECT cv, count(*) AS completed_folds, round(avg(avg_acc), 6) AS avg_acc_mean,
  round(stddev_pop(avg_acc), 6) AS avg_acc_std, round(avg(avg_f1), 6) AS avg_f1_mean,
  round(stddev_pop(avg_f1), 6) AS avg_f1_std FROM folds GROUP BY cv""")
def cv_stats(spark, sf):
    stats = logs.cv_stats(_folds(spark, sf), by=["cv"])
    means = [f"{m}_{s}" for m in ("avg_acc", "avg_f1") for s in ("mean", "std")]
    return stats.select("cv", "completed_folds", *[V.r6(c).alias(c) for c in means])


@query("cv_values", f"""WITH {FOLDS_CTE}
SELECT cv, CAST(row_number() OVER (PARTITION BY cv ORDER BY fold) - 1 AS INTEGER) AS pos,
  round(avg_f1, 6) AS avg_f1 FROM folds""")
def cv_values(spark, sf):
    stats = logs.cv_stats(_folds(spark, sf), by=["cv"])
    return stats.select("cv", F.posexplode("avg_f1_values").alias("pos", "v")).select(
        "cv", "pos", V.r6("v").alias("avg_f1")
    )
