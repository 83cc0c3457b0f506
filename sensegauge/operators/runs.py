"""Experiment runs: the last value of each key, cohorts, and summaries over runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensegauge.functions import stats


@dataclass(frozen=True)
class Cohort:
    """Runs of one setting; a run belongs to the first cohort that it fits."""

    name: str
    augmented: bool
    epochs: int
    variant: str


#: The settings that reports tell apart.
COHORTS = (
    Cohort("plain_250_fixed", False, 250, "holdout fixed"),
    Cohort("augmented_250_fixed", True, 250, "holdout fixed"),
    Cohort("plain_250", False, 250, "holdout"),
    Cohort("plain_500_fixed", False, 500, "holdout fixed"),
    Cohort("augmented_500_fixed", True, 500, "holdout fixed"),
)


def finished(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("state") == "finished")


def route(runs: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """runs with ``cohort``; those that fit none are dropped."""
    named = F.lit(None).cast("string")
    for c in reversed(cohorts):
        named = F.when((F.col("augmented") == c.augmented) & (F.col("epochs") == c.epochs) & (F.col("variant") == c.variant), c.name).otherwise(named)
    return runs.withColumn("cohort", named).where(F.col("cohort").isNotNull())


def last_values(log: DataFrame, run: str = "run_id", key: str = "key", step: Sequence[str] = ("step",), value: str = "value") -> DataFrame:
    """run, key and the value at the last step: max_by over partial aggregates, so a hot key is no bottleneck."""
    return log.groupBy(run, key).agg(F.max_by(value, F.struct(*step)).alias(value))


def summaries(log: DataFrame) -> DataFrame:
    """run_id and a map from key to last value. A run has some hundred keys."""
    return last_values(log).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("summary"))


def lookup(summary, key: str):
    """The value of a key; a missing key is an error and not null."""
    return F.coalesce(F.element_at(summary, key), F.raise_error(f"no such key: {key}").cast("double"))


def over_runs(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, mean, stdev (of the sample), n_runs of value."""
    v = F.col("value")
    return values.groupBy(*by).agg(stats.mean(v).alias("mean"), stats.stdev(v).alias("stdev"), F.count(stats.clean(v)).alias("n_runs"))


#: A mean p-value up to this counts as significant.
SIGNIFICANT = 1 - 0.999


def significant(mean_p):
    return mean_p <= F.lit(SIGNIFICANT)


def best_checkpoint(losses: DataFrame) -> DataFrame:
    """run_id and the checkpoint of the lowest evaluation loss, the earliest of equal ones. losses: run_id, step, eval_loss, checkpoint."""
    return losses.where(stats.clean(F.col("eval_loss")).isNotNull()).groupBy("run_id").agg(F.min_by("checkpoint", F.struct("eval_loss", "step")).alias("checkpoint"), F.min("eval_loss").alias("eval_loss"))
