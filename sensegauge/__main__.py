"""python -m sensegauge evaluate PAIRS LOG RUNS --run ID [--seed N] [--data-augmentation BOOL] [--epochs N] [--variant TEXT]
python -m sensegauge report LOG RUNS OUT [--count-equals]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sensegauge.functions.text import FALSE, TRUE
from sensegauge.operators import summary
from sensegauge.plans import evaluate, reports
from sensegauge.sources import sinks, tables


def boolean(text: str) -> bool:
    if (x := text.strip().lower()) not in (*TRUE, *FALSE):
        raise argparse.ArgumentTypeError(f"not a boolean: {text}")
    return x in TRUE


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("evaluate")
    for name in ("pairs", "log", "runs"):
        one.add_argument(name)
    one.add_argument("--run", required=True)
    one.add_argument("--seed", type=int, default=45)
    one.add_argument("--data-augmentation", type=boolean, default=True)
    one.add_argument("--epochs", type=int, default=500)
    one.add_argument("--variant", default="holdout fixed")
    two = commands.add_parser("report")
    for name in ("log", "runs", "out"):
        two.add_argument(name)
    two.add_argument("--count-equals", action="store_true")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "evaluate":
        own = tables.training_pairs(spark, args.pairs, args.data_augmentation).where("split = 'test'").withColumn("split", F.lit(summary.TEST))
        same = tables.identical_holdout(spark, args.pairs).withColumn("split", F.lit(summary.IDENTICAL))
        other = tables.unrelated_holdout(spark, args.pairs).withColumn("split", F.lit(summary.UNRELATED))
        found = evaluate.benchmark_metrics(own.unionByName(same).unionByName(other))
        sinks.append_metrics(sinks.as_events(found, args.run, args.seed), args.log)
        sinks.append_run(spark, args.runs, args.run, "finished", args.data_augmentation, args.epochs, args.variant)
        return
    values = evaluate.run_values(tables.read_metric_log(spark, args.log), tables.read_runs(spark, args.runs)).cache()
    for name, report in (("correlation", reports.CORRELATION), ("identical", reports.SAME), ("unrelated", reports.OTHER)):
        report = report.with_equals() if args.count_equals and name != "correlation" else report
        text = sinks.latex(reports.with_text(reports.cells(values, report)), report.title, [c for c, _ in report.columns])
        sinks.write_text(spark, text, f"{args.out}/{name}")


if __name__ == "__main__":
    arguments = parser().parse_args()
    run(SparkSession.builder.appName("sensegauge").getOrCreate(), arguments)
