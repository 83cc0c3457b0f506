"""A regression of ratings on metric scores, in place of fine-tuning a language model, which needs one that is not here.

Evaluation is that of any model: predictions go to operators.summary, one kind of split after the other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensegauge.operators import metrics, summary

FEATURES = ("SARI", "BLEU", "METEOR (exact)", "TER", "ROUGE-1", "ROUGE-2", "ROUGE-L")


def _inputs(scored: DataFrame, names: Iterable[str]) -> DataFrame:
    return scored.select("pair_id", "split", "label", *(F.col(f"`{n}`").alias(f"x{i}") for i, n in enumerate(names)))


def fit(train: DataFrame, names: Iterable[str] = FEATURES, regularisation: float = 0.1):
    """train: pairs with labels. Scores that are null are imputed by the mean. The stages read the scores several times, so
    these are kept meanwhile; pairs are scored once."""
    names = list(names)
    columns = [f"x{i}" for i in range(len(names))]
    stages = [Imputer(inputCols=columns, outputCols=columns), VectorAssembler(inputCols=columns, outputCol="features"), LinearRegression(labelCol="label", regParam=regularisation)]
    scores = _inputs(metrics.score(train, names), names).where("label is not null").persist()
    try:
        return Pipeline(stages=stages).fit(scores)
    finally:
        scores.unpersist()


def predict(model, pairs: DataFrame, names: Iterable[str] = FEATURES) -> DataFrame:
    names = list(names)
    return model.transform(_inputs(metrics.score(pairs, names), names)).select("pair_id", "split", "label", "prediction")


def evaluate(predicted: DataFrame) -> DataFrame:
    """split, stat, value of the three kinds of split, from one pass."""
    return summary.all_predictions(predicted)


def sweep(pairs: DataFrame, holdouts: DataFrame, seeds: Iterable[int], share: float = 0.8, names: Iterable[str] = FEATURES) -> DataFrame:
    """run_id, split, stat, value: one run for each seed, which gives the split into training and test pairs. Runs follow
    one another on the driver, as each is a job for the whole cluster."""
    names, out = list(names), None
    for seed in seeds:
        train, test = pairs.randomSplit([share, 1 - share], seed)
        model = fit(train, names)
        run = evaluate(predict(model, test.unionByName(holdouts), names)).select(F.lit(f"seed-{seed}").alias("run_id"), "split", "stat", "value")
        out = run if out is None else out.unionByName(run)
    return out
