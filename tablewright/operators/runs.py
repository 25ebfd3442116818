"""Run histories: best so far, issues, early stopping, retries, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.operators.ordered import running


def running_best(runs: DataFrame, keys, order: str, score: str) -> DataFrame:
    """Adds ``best_score`` and ``points``: maximum and number of rows so far, current row included."""
    return running(runs, keys, order, {"best_score": ("max", F.col(score)), "points": ("sum", F.lit(1))})


def issue(val: Column, train: Column, util: Column) -> Column:
    """Issue of one point without history."""
    return (
        F.when(train - val > fixed.OVERFIT_GAP, "overfitting").when(train < fixed.UNDERFIT_TRAIN, "underfitting")
        .when(util < fixed.LOW_UTILISATION, "resource_inefficiency").otherwise("healthy")
    )


def history_issue(val: Column, train: Column, util: Column, best: Column, points: Column) -> Column:
    return (
        F.when(points < 2, "insufficient_data")
        .when(val < best - fixed.SIGNIFICANT_DROP, "significant_regression")
        .when(val < best - fixed.MINOR_DROP, "minor_regression")
        .otherwise(issue(val, train, util))
    )


def metric_issues(runs: DataFrame, keys, order: str) -> DataFrame:
    c = F.col
    seen = running_best(runs, keys, order, "val_score")
    return seen.withColumn("issue", history_issue(c("val_score"), c("train_score"), c("util"), c("best_score"), c("points")))


def early_stop(runs: DataFrame, key: str, order: str, loss: str, patience: int) -> DataFrame:
    """(key, stopped, stop_step, epochs, best_step, best_loss): first epoch without improvement for ``patience`` epochs.

    An improvement is a loss below every earlier one. Without a stop the last epoch counts as the end.
    """
    c = F.col
    first = running(
        runs.select(key, order, loss), [key], order,
        {"low": ("min", c(loss)), "epoch": ("sum", F.lit(1))}, exclusive=("low",), keep_block=True,
    )
    better = first.withColumn("better", F.when(c("low").isNull() | (c(loss) < c("low")), c("epoch")))
    # the last improvement so far is the largest (epoch, step, loss) among the improving rows
    last = running(
        better, [key], order,
        {"last": ("max", F.when(c("better").isNotNull(), F.struct(c("epoch").alias("e"), c(order).alias("s"), c(loss).alias("l"))))},
    )
    state = F.struct("epoch", order, c("last.s").alias("best_step"), c("last.l").alias("best_loss"))
    hit = F.when(c("epoch") - c("last.e") >= patience, state)
    g = last.groupBy(key).agg(F.min(hit).alias("stop"), F.max(state).alias("end"))
    at = F.coalesce("stop", "end")
    return g.select(
        key, c("stop").isNotNull().alias("stopped"), at[order].alias("stop_step"), at["epoch"].alias("epochs"),
        at["best_step"].alias("best_step"), at["best_loss"].alias("best_loss"),
    )


def retry_counter(errors: DataFrame, key, order: str, limit: int = fixed.RETRY_LIMIT) -> DataFrame:
    """Adds ``attempt`` (1-based per error id) and ``fallback`` from the limit on."""
    keys = [key] if isinstance(key, str) else list(key)
    return running(errors, keys, order, {"attempt": ("sum", F.lit(1))}).withColumn("fallback", F.col("attempt") >= limit)


def iteration_cap(rounds: DataFrame, key: str, order: str, limit: int = fixed.ITERATION_LIMIT) -> DataFrame:
    """Adds ``iteration`` and ``decision``: beyond the limit the result is accepted as it is."""
    c = F.col
    seen = running(rounds, [key], order, {"iteration": ("sum", F.lit(1))})
    return seen.withColumn(
        "decision", F.when(c("iteration") > limit, "accept_limit").when(c("acceptable"), "accept").otherwise("retry")
    )


def cause_list(train: Column, val: Column, util: Column) -> Column:
    """array<struct(priority, cause, fix)> of everything that applies, or the one entry for a normal point."""
    tests = [train - val > fixed.OVERFIT_GAP, train < fixed.UNDERFIT_TRAIN, util < fixed.LOW_UTILISATION]

    def entry(p, cause, fix):
        return F.struct(F.lit(p).alias("priority"), F.lit(cause).alias("cause"), F.lit(fix).alias("fix"))

    found = F.filter(F.array(*[F.when(t, entry(*c)) for t, c in zip(tests, fixed.CAUSES)]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(entry(*fixed.NORMAL_CAUSE)))


def resource_alert(accelerator: Column, ram: Column, runtime: Column) -> Column:
    """First alert whose threshold is reached; null when none is."""
    return (
        F.when(accelerator >= fixed.ACCELERATOR_ALERT, fixed.ALERTS[0]).when(ram >= fixed.RAM_ALERT, fixed.ALERTS[1])
        .when(runtime >= fixed.RUNTIME_ALERT, fixed.ALERTS[2])
    )


def order_actions(df: DataFrame, actions: str) -> DataFrame:
    """The actions of each row in ascending priority (an array of (priority, action) structs sorts by it)."""
    return df.withColumn(actions, F.array_sort(actions))
