"""Draws that follow former trials, and a search that uses them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks import views as V
from checks.plan_queries import vectors
from checks.registry import query
from textlab.operators.guided import CANDIDATES, GAMMA, NARROWEST, propose
from textlab.operators.logs import best_per_trial
from textlab.operators.sampling import Choice, LogUniform, RandInt, sample_space
from textlab.plans.config import Config
from textlab.plans.search import search_guided
from textlab.sources.storage import materialize

LOW, HIGH = math.log(1e-5), math.log(1e-1)
SPACE = {"LR": LogUniform(1e-5, 1e-1), "H_DIM": Choice((8, 16, 32, None)), "PATIENCE": RandInt(2, 8)}


def _u(key: str, more: str = "") -> str:
    text = f"'42:{key}:' || CAST(trial AS VARCHAR){more}"
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def _sigma(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def _line_density(seen: str) -> str:
    w = f"w_{seen}"
    s, mass = _sigma(f"(x - c) / {w}"), f"({_sigma(f'({HIGH} - c) / {w}')} - {_sigma(f'({LOW} - c) / {w}')})"
    kernels = f"list_sum(list_transform({seen}, lambda c: {s} * (1.0 - {s}) / {w} / {mass}))"
    return f"((1.0 / ({HIGH} - {LOW}) + coalesce({kernels}, 0)) / (len({seen}) + 1))"


def _line_sql(name: str) -> str:
    span = HIGH - LOW
    width = "greatest({0} / 4.0 / sqrt(greatest(len({1}), 1)), {0} * {2})"
    return f"""{name} AS (
  SELECT trial, exp(arg_max(x, ratio ORDER BY ratio DESC, c)) AS v FROM (
    SELECT trial, c, x, round(ln({_line_density('good')}) - ln({_line_density('bad')}), 9) AS ratio
    FROM (SELECT *, CASE WHEN k < len(good) THEN greatest({LOW}, least({HIGH},
        good[k + 1] + w_good * ln(share / (1.0 - share)))) ELSE {LOW} + u * ({HIGH} - {LOW}) END AS x
      FROM (SELECT *, {_sigma(f'({LOW} - good[k + 1]) / w_good')} + u * (
          {_sigma(f'({HIGH} - good[k + 1]) / w_good')} - {_sigma(f'({LOW} - good[k + 1]) / w_good')}) AS share
        FROM (SELECT *, CAST(floor({_u(f'{name}:pick', " || ':' || c")} * (len(good) + 1)) AS BIGINT) AS k,
            {_u(f'{name}:value', " || ':' || c")} AS u, {width.format(span, 'good', NARROWEST)} AS w_good,
            {width.format(span, 'bad', NARROWEST)} AS w_bad
          FROM new CROSS JOIN range({CANDIDATES}) g(c) CROSS JOIN (
            SELECT list({name} ORDER BY trial) FILTER (better) AS good,
              list({name} ORDER BY trial) FILTER (NOT better) AS bad FROM place)))))
  GROUP BY trial)""".replace("arg_max(x, ratio ORDER BY ratio DESC, c)", "first(x ORDER BY ratio DESC, c)")


def _options_sql(name: str, n: int) -> str:
    def density(seen: str) -> str:
        return f"((1.0 / {n} + len(list_filter({seen}, lambda c: c = x))) / (len({seen}) + 1))"

    return f"""{name} AS (
  SELECT trial, first(x ORDER BY ratio DESC, c) AS v FROM (
    SELECT trial, c, x, round(ln({density('good')}) - ln({density('bad')}), 9) AS ratio
    FROM (SELECT *, CASE WHEN k < len(good) THEN good[k + 1] ELSE floor(u * {n}) END AS x
      FROM (SELECT *, CAST(floor({_u(f'{name}:pick', " || ':' || c")} * (len(good) + 1)) AS BIGINT) AS k,
          {_u(f'{name}:value', " || ':' || c")} AS u
        FROM new CROSS JOIN range({CANDIDATES}) g(c) CROSS JOIN (
          SELECT list({name} ORDER BY trial) FILTER (better) AS good,
            list({name} ORDER BY trial) FILTER (NOT better) AS bad FROM place))))
  GROUP BY trial)"""


GUIDED_SQL = f"""
WITH {V.EPOCHS_CTE},
seen AS (SELECT run_id AS trial, max(f1) AS f1 FROM epochs GROUP BY run_id),
place AS (
  SELECT trial, {LOW} + {_u('LR')} * ({HIGH} - {LOW}) AS "LR", floor({_u('H_DIM')} * 4) AS "H_DIM",
    floor({_u('PATIENCE')} * 6) AS "PATIENCE",
    row_number() OVER (ORDER BY f1 DESC, trial) <= ceil({GAMMA} * count(*) OVER ()) AS better
  FROM seen),
new AS (SELECT DISTINCT run_id AS trial FROM epochs),
{_line_sql('LR')}, {_options_sql('H_DIM', 4)}, {_options_sql('PATIENCE', 6)}
SELECT trial, round("LR".v, 7) AS "LR", [8, 16, 32, NULL][CAST("H_DIM".v AS BIGINT) + 1] AS "H_DIM",
  CAST(2 + "PATIENCE".v AS INTEGER) AS "PATIENCE"
FROM "LR" JOIN "H_DIM" USING (trial) JOIN "PATIENCE" USING (trial)
"""


@query("guided_draws", GUIDED_SQL)
def guided_draws(spark, sf):
    """One more draw per run that follows the best scores of all runs."""
    epochs = V.epochs(spark, sf).select(F.col("run_id").alias("trial"), "epoch", "f1")
    best = best_per_trial(epochs, iteration="epoch").select("trial", "f1")
    ids = epochs.select("trial").distinct()
    out = propose(ids, sample_space(best, space=SPACE), space=SPACE)
    return out.withColumn("LR", F.round("LR", 7))


@query("search_guided", "SELECT 6::BIGINT AS trials, 18::BIGINT AS reports, true AS best_is_top")
def guided_search(spark, sf):
    """Size of a guided search, and whether its settings are those of the best trial."""
    data = materialize(vectors(spark, sf, 2), "vectors")
    space = {"LR": LogUniform(1e-4, 1e-1), "H_DIM": Choice((4, 8))}
    found = search_guided(data, Config(head="relu", opt="AdamW", samples=6, max_epochs=3), space=space, batch=3)
    top = found.ranked(k=1).first()
    return found.reports.agg(
        F.countDistinct("trial").alias("trials"), F.count(F.lit(1)).alias("reports"),
        F.lit(abs(found.best.lr - top["config/LR"]) < 1e-12).alias("best_is_top"))
