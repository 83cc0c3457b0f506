"""Sinks: the append-only metric log, the run table, best checkpoints, models, and report tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensegauge.sources.schemas import ARTIFACTS, METRIC_LOG, RUNS, require


def append_metrics(events: DataFrame, path: str) -> None:
    """Appends events (run_id, step, key, value)."""
    require(events, METRIC_LOG).write.mode("append").parquet(path)


def as_events(summary: DataFrame, run_id: str, step: int, prefix: str = "test") -> DataFrame:
    """Events of a long summary (split, metric, stat, value): the key is prefix/[split_]metric_stat."""
    part = F.when(F.col("split") == "test", F.lit("")).otherwise(F.concat("split", F.lit("_")))
    key = F.concat(F.lit(f"{prefix}/"), part, F.col("metric"), F.lit("_"), F.col("stat"))
    return summary.select(F.lit(run_id).alias("run_id"), F.lit(step).cast("bigint").alias("step"), key.alias("key"), F.col("value"))


def append_run(spark: SparkSession, path: str, run_id: str, state: str, augmented: bool, epochs: int, variant: str) -> None:
    spark.createDataFrame([(run_id, state, augmented, epochs, variant)], RUNS).write.mode("append").parquet(path)


def append_artifact(spark: SparkSession, path: str, run_id: str, step: int, key: str, value: str) -> None:
    """A value that is text, such as the path of the best checkpoint."""
    spark.createDataFrame([(run_id, step, key, value)], ARTIFACTS).write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def latex(report: DataFrame, caption: str, columns: list[str]) -> str:
    """A LaTeX table of a report (row_idx, row_name, col_name, text, is_best, is_significant), which has tens of rows."""
    rows: dict[int, tuple[str, dict[str, str]]] = {}
    for r in report.orderBy("row_idx", "col_name").collect():
        cell = r["text"] or ""
        cell = rf"\textit{{{cell}}}" if r["is_significant"] else cell
        cell = rf"\textbf{{{cell}}}" if r["is_best"] else cell
        rows.setdefault(r["row_idx"], (r["row_name"], {}))[1][r["col_name"]] = cell
    escaped = lambda s: s.replace("%", r"\%").replace("_", r"\_").replace("±", r"$\pm$")
    lines = [r"\begin{table}", rf"\caption{{{escaped(caption)}}}", rf"\begin{{tabular}}{{l{'r' * len(columns)}}}", r"\toprule", " & ".join(["", *map(escaped, columns)]) + r" \\", r"\midrule"]
    last = None
    for i in sorted(rows):
        name, cells = rows[i]
        if last is not None and i > last + 1:
            lines.append(r"\midrule")  # a gap in the numbering is a blank row
        lines.append(" & ".join([escaped(name), *(escaped(cells.get(c, "")) for c in columns)]) + r" \\")
        last = i
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as a file in a folder of any store that Spark reaches; the folder is made."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
