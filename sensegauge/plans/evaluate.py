"""Whole evaluations: pairs in, summaries out, as one plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensegauge.operators import metrics, summary
from sensegauge.operators.runs import finished, last_values, route


#: Names of the holdouts in keys, as the trainer and as the reports write them.
HOLDOUTS = {"same_sentence": summary.IDENTICAL, "identical_sentences": summary.IDENTICAL, "irrelevant_sentence": summary.UNRELATED, "unrelated_sentences": summary.UNRELATED}
#: Split, metric and statistic in the key of an event; the model's own keys name no metric.
KEY = rf"^(?:train/)?test/(?:({'|'.join(HOLDOUTS)})_)?(?:(.*)_)?(pearson_corr|pearson_pvalue|R2|rmse|mean_score|st_dev_score|mean|st_dev|ratio_equals|ratio_95|ratio_99|ratio_5|ratio_1)$"


def benchmark_metrics(pairs: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """split, metric, stat, value for all metrics on the test, identical and unrelated pairs (pair_id, split, original,
    simplification, label). Pairs are read and scored once."""
    names = list(names or metrics.without_model())
    return summary.all_kinds(metrics.long(metrics.score(pairs, names), names))


def run_values(log: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, cohort, split, metric, stat, value of finished runs: last values of the log, keys taken apart.

    The run table is small beside the log, which is aggregated to a value for each run and key first.
    """
    part = lambda i: F.regexp_extract("key", KEY, i)
    values = last_values(log).where(part(0) != "")
    split = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in HOLDOUTS.items() for x in kv)), F.nullif(part(1), F.lit(""))), F.lit(summary.TEST))
    values = values.select("run_id", split.alias("split"), F.when(part(2) == "", "Trained model").otherwise(part(2)).alias("metric"), part(3).alias("stat"), "value")
    return values.join(route(finished(runs)).select("run_id", "cohort"), "run_id")
