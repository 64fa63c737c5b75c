"""Monitors of training runs. A run's rows are ordered by ``order`` within ``by``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lr_factor(step: Column, warmup: int, total: int, least: float = 0.0) -> Column:
    """Linear warm-up, then a cosine that isn't clamped: past ``total`` it rises again."""
    progress = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, step / max(1, warmup)).otherwise(F.greatest(F.lit(least), 0.5 * (1 + F.cos(progress * math.pi))))


def may_augment(epoch: Column, total: Column, share: float = 0.35) -> Column:
    return epoch / total < share


def _run(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))).alias("_run"))


def early_stopping(df: DataFrame, by: list[str], order: list[str], value: str, patience: int = 10, min_delta: float = 0.001, mode: str = "min") -> DataFrame:
    """(by, best_value, counter, stopped, stopped_at): the state after each run.

    The best value moves only by more than ``min_delta``, so it is a fold and no running minimum. A run is one series of
    evaluations, thousands at most; runs are spread by key.
    """
    zero = F.struct(F.lit(math.inf if mode == "min" else -math.inf).alias("best"), F.lit(0).alias("n"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("at"))

    def step(a: Column, x: Column) -> Column:
        better = x["_v"] < a["best"] - min_delta if mode == "min" else x["_v"] > a["best"] + min_delta
        n = F.when(better, 0).otherwise(a["n"] + 1)
        at = F.coalesce(a["at"], F.when(n >= patience, a["seen"] + 1))
        return F.struct(F.when(better, x["_v"]).otherwise(a["best"]).alias("best"), n.alias("n"), (a["seen"] + 1).alias("seen"), at.alias("at"))

    out = _run(df, by, order, value).select(*by, F.aggregate("_run", zero, step).alias("s"))
    return out.select(*by, F.col("s.best").alias("best_value"), F.col("s.n").alias("counter"), F.col("s.at").isNotNull().alias("stopped"), F.col("s.at").alias("stopped_at"))


def collapse(df: DataFrame, by: list[str], order: list[str], score: str, floor: float = 0.3, fall: float = 0.8) -> DataFrame:
    """``collapsed``: a score under the floor, or, from ten points on, a mean of the last ten under 0.8 of the ten before."""
    w = W.partitionBy(*by).orderBy(*order)
    n = F.row_number().over(w)
    mean = lambda a, b: F.avg(score).over(w.rowsBetween(a, b))
    recent = mean(-9, 0)
    older = F.when(n >= 20, mean(-19, -10)).otherwise(recent)
    return df.withColumn("recent_avg", recent).withColumn("older_avg", older).withColumn("collapsed", (F.col(score) < floor) | ((n >= 10) & (recent < older * fall)))


def retained(df: DataFrame, by: list[str], order: list[str], k: int = 10) -> DataFrame:
    """The last k checkpoints of each run."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def latest(df: DataFrame, by: list[str], order: list[str], path: str = "path") -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(path, F.struct(*order)).alias(path))


def rollback(df: DataFrame, by: list[str], order: list[str], score: str, current: Column, path: str = "path", share: float = 0.7, k: int = 3) -> DataFrame:
    """(by, path) of the newest of the last k checkpoints whose score is above current/share."""
    rows = retained(df, by, order, k).where(F.col(score) > current / share)
    return latest(rows, by, order, path)


def best_so_far(df: DataFrame, by: list[str], order: list[str], loss: str) -> DataFrame:
    """``is_best``: a loss under all before it."""
    before = F.min(loss).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("is_best", F.coalesce(F.col(loss) < before, F.col(loss).isNotNull()))


def should_stop(stopped: DataFrame, last: DataFrame, by: list[str], score: str, least: float = 0.5) -> DataFrame:
    """(by, stop): early stopping, or a last score under ``least``."""
    return stopped.join(last.select(*by, score), by).select(*by, (F.col("stopped") | (F.col(score) < least)).alias("stop"))


def on_collapse(collapsed: DataFrame, back: DataFrame, by: list[str]) -> DataFrame:
    """(by, action): "rollback" where a collapse has a checkpoint to go to, "stop" where it has none, else "continue"."""
    j = collapsed.join(back.select(*by, F.col("path").alias("_to")), by, "left")
    return j.select(*by, F.when(~F.col("collapsed"), "continue").when(F.col("_to").isNotNull(), "rollback").otherwise("stop").alias("action"), "_to").withColumnRenamed("_to", "path")


def diagonal_score(attention: Column) -> Column:
    """The share of an attention matrix (array of rows) on its diagonal; 0 for null."""
    rows = F.size(attention)
    on = F.transform(attention, lambda r, i: F.coalesce(F.try_element_at(r, F.floor(i * F.size(r) / rows).cast("int") + 1), F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    return F.coalesce(total(on) / (total(F.flatten(attention)) + 1e-8), F.lit(0.0))


def mean_or_zero(c: str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def perturb(x: Column, seed: int, low: float = 0.9, high: float = 1.1) -> Column:
    """Samples scaled by one random factor of the row."""
    factor = F.rand(seed) * (high - low) + low
    return F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(factor, F.size(x)).alias("f")), lambda p: p["v"] * p["f"])


def navigate(prompts: DataFrame, action: str, current: int, target: int = 0) -> DataFrame:
    """(index, total, previous, current, next) of a move among prompts (idx from 0, prompt_id, status)."""
    total = F.count("*")
    pending = lambda c: F.min(F.when((F.col("status") == "pending") & c, F.col("idx")))
    to = {
        "next": F.least(F.lit(current + 1), total - 1),
        "prev": F.lit(max(current - 1, 0)),
        "goto": F.greatest(F.lit(0), F.least(F.lit(target), total - 1)),
        "next_pending": F.coalesce(pending(F.col("idx") > current), pending(F.col("idx") < current), F.lit(current)),
    }.get(action, F.lit(current))
    at = prompts.agg(to.cast("long").alias("index"), total.alias("total")).where("total > 0")
    near = prompts.join(F.broadcast(at), F.abs(F.col("idx") - F.col("index")) <= 1)  # one row
    pick = lambda d: F.max(F.when(F.col("idx") - F.col("index") == d, F.col("prompt_id")))
    return near.groupBy("index", "total").agg(pick(-1).alias("previous"), pick(0).alias("current"), pick(1).alias("next"))
