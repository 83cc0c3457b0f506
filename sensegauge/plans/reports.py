"""Reports over runs: rows of metrics and models, the best of each column, and cell texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensegauge.operators.runs import over_runs, significant
from sensegauge.operators.summary import IDENTICAL, TEST, UNRELATED


@dataclass(frozen=True)
class Report:
    """Columns (statistic, whether high is best) of a split; cohorts of metric rows and of model rows."""

    split: str
    columns: tuple[tuple[str, bool], ...]
    metric_cohort: str
    model_cohorts: tuple[str, str]
    title: str
    italics: bool = False

    def with_equals(self) -> Report:
        return Report(self.split, (*self.columns, ("ratio_equals", True)), self.metric_cohort, self.model_cohorts, self.title, self.italics)


CORRELATION = Report(TEST, (("pearson_corr", True), ("R2", True), ("rmse", False)), "plain_500_fixed", ("plain_250_fixed", "augmented_250_fixed"), "Correlation with human ratings", True)
SAME = Report(IDENTICAL, (("ratio_95", True), ("ratio_99", True)), "plain_500_fixed", ("plain_500_fixed", "augmented_500_fixed"), "Identical pairs above 95 and 99, in %")
OTHER = Report(UNRELATED, (("ratio_5", True), ("ratio_1", True)), "plain_500_fixed", ("plain_500_fixed", "augmented_500_fixed"), "Unrelated pairs below 5 and 1, in %")
MODEL = "Trained model"


def cells(values: DataFrame, report: Report) -> DataFrame:
    """row_idx, row_name, col_name, mean, stdev, is_best, is_significant of values (run_id, cohort, split, metric, stat, value).

    Rows are the metrics in order of name, a gap for a blank row, the model without and with augmentation. Ties are all best.
    """
    stats = [c for c, _ in report.columns]
    rows = values.where((F.col("split") == report.split) & F.col("stat").isin(*stats, "pearson_pvalue"))
    model = F.col("metric") == MODEL
    plain, augmented = report.model_cohorts
    name = F.when(model & (F.col("cohort") == plain), MODEL).when(model & (F.col("cohort") == augmented), f"{MODEL} (augmented)").when(~model & (F.col("cohort") == report.metric_cohort), F.col("metric"))
    rows = over_runs(rows.withColumn("row_name", name).where(F.col("row_name").isNotNull()), ["row_name", "stat"])
    p = rows.where(F.col("stat") == "pearson_pvalue").select("row_name", significant(F.col("mean")).alias("sure"))
    rows = rows.where(F.col("stat").isin(*stats)).join(p, "row_name", "left")
    # tens of rows, so windows without many partitions are fine
    order = F.struct(F.when(F.col("row_name") == MODEL, 1).when(F.col("row_name") == f"{MODEL} (augmented)", 2).otherwise(0), "row_name")
    rank = F.dense_rank().over(Window.orderBy(order))
    rows = rows.withColumn("row_idx", rank + F.when(order.getField("col1") > 0, 1).otherwise(0))
    by = Window.partitionBy("stat")
    high = F.col("stat").isin([c for c, up in report.columns if up])
    best = F.when(high, F.max("mean").over(by)).otherwise(F.min("mean").over(by))
    sure = F.coalesce("sure", F.lit(False)) & (F.col("stat") == "pearson_corr") if report.italics else F.lit(False)
    return rows.select("row_idx", "row_name", F.col("stat").alias("col_name"), "mean", "stdev", "n_runs", (F.col("mean") == best).alias("is_best"), sure.alias("is_significant"))


def number(x: Column, digits: int) -> Column:
    """Rounded half to even, without trailing zeros."""
    text = F.bround(x, digits).cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def with_text(table: DataFrame) -> DataFrame:
    """cells with ``text``: mean±deviation; numbers stay numbers until here."""
    sd = F.when(F.col("stdev").isNotNull(), F.concat(F.lit("±"), number(F.col("stdev"), 2))).otherwise("")
    return table.withColumn("text", F.concat(number(F.col("mean"), 3), sd))
