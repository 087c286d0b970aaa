"""Plan inspection and small brute-force rules used by several tests."""

from __future__ import annotations


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def wide_single_partitions(df, columns: list[str]) -> list[str]:
    """Single-partition exchanges whose output still holds one of the columns."""
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    hits = []
    for part in plan.split("\n\n"):
        if "Exchange" in part.split("\n")[0] and "SinglePartition" in part:
            if any(f"{c}#" in part for c in columns):
                hits.append(part)
    return hits


def loop_early_stop(scores: list[float], patience: int) -> tuple[int, int]:
    """(epochs run, best epoch) by going through the epochs one at a time."""
    lives = full = max(3, patience)
    best = best_at = None
    for e, s in enumerate(scores):
        if e and s < best:
            lives -= 1
            if lives == 0:
                return e + 1, best_at
        else:
            best, best_at, lives = s, e, full
    return len(scores), best_at
