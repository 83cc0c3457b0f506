"""Summaries of scores against ratings: one pass, one shuffle, for all metrics and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensegauge.functions import stats

TEST, IDENTICAL, UNRELATED = "test", "same_sentence", "irrelevant_sentence"


def aggregates(kind: str, p: Column, y: Column, population: bool = False) -> dict[str, Column]:
    """Named aggregates of a split kind. Holdout ratings are constant, so correlation and R2 are of ``test`` only."""
    spread = {"rmse": stats.rmse(p, y), "mean": stats.mean(p), "st_dev": stats.stdev(p, population)}
    if kind == TEST:
        return {"pearson_corr": stats.pearson(p, y), "R2": stats.r2(p, y), **spread, "n": stats.pairs(p, y)}
    tests = stats.ABOVE if kind == IDENTICAL else stats.BELOW
    return {**{k: stats.share(f(p)) for k, f in tests.items()}, **spread}


def predictions(table: DataFrame, kind: str) -> DataFrame:
    """One row: the summary of a model's predictions (prediction, label), with the deviation of the population."""
    out = table.agg(*(c.alias(k) for k, c in aggregates(kind, F.col("prediction"), F.col("label"), population=True).items()))
    return with_pvalue(out) if kind == TEST else out


def all_predictions(table: DataFrame) -> DataFrame:
    """split, stat, value: ``predictions`` of all three kinds (split, prediction, label) from one aggregation. A kind without
    rows has its rows of statistics, which are null."""
    of = lambda kind, c: F.when(F.col("split") == kind, F.col(c))
    named = {f"{kind}.{k}": c for kind in (TEST, IDENTICAL, UNRELATED) for k, c in aggregates(kind, of(kind, "prediction"), of(kind, "label"), population=True).items()}
    wide = table.agg(*(c.alias(k.replace(".", "__")) for k, c in named.items()))
    wide = wide.withColumn(f"{TEST}__pearson_pvalue", stats.pearson_pvalue(F.col(f"{TEST}__pearson_corr"), F.col(f"{TEST}__n").cast("double"))).drop(f"{TEST}__n")
    name = F.split("name", "__")
    return wide.unpivot([], wide.columns, "name", "value").select(name[0].alias("split"), name[1].alias("stat"), "value")


def with_pvalue(summary: DataFrame) -> DataFrame:
    return summary.withColumn("pearson_pvalue", stats.pearson_pvalue(F.col("pearson_corr"), F.col("n").cast("double"))).drop("n")


def metrics(scores: DataFrame, kind: str) -> DataFrame:
    """split, metric and the statistics of a split kind for scores (split, metric, score, label)."""
    chosen = scores.where(F.col("split") == kind)
    out = chosen.groupBy("split", "metric").agg(*(c.alias(k) for k, c in aggregates(kind, F.col("score"), F.col("label")).items()))
    return with_pvalue(out) if kind == TEST else out


def all_kinds(scores: DataFrame) -> DataFrame:
    """split, metric, stat, value of all three kinds, from one aggregation of all statistics."""
    p, y = F.col("score"), F.col("label")
    named = {k: c for kind in (IDENTICAL, UNRELATED, TEST) for k, c in ((f"{kind}.{k}", c) for k, c in aggregates(kind, p, y).items())}
    wide = scores.where(F.col("split").isin(TEST, IDENTICAL, UNRELATED)).groupBy("split", "metric").agg(*(c.alias(k.replace(".", "__")) for k, c in named.items()))
    wide = wide.withColumn(f"{TEST}__pearson_pvalue", stats.pearson_pvalue(F.col(f"{TEST}__pearson_corr"), F.col(f"{TEST}__n").cast("double"))).drop(f"{TEST}__n")
    stacked = wide.unpivot(["split", "metric"], [c for c in wide.columns if c not in ("split", "metric")], "name", "value")
    name = F.split("name", "__")
    # FKGL is no measure of sameness, so it has no holdout summary
    return stacked.where((name[0] == F.col("split")) & ((F.col("metric") != "FKGL") | (F.col("split") == TEST))).select("split", "metric", name[1].alias("stat"), "value")
