"""Sources: pair datasets, experiment runs, stop words, and pointers to model artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensegauge.sources.schemas import CONFIGS, METRIC_LOG, PAIRS, RUNS, SPLITS, require


def read_pairs(spark: SparkSession, path: str, config: str, split: str | None = None) -> DataFrame:
    """Pairs of a configuration (and split) from Parquet; both are filters on the scan, or partitions if stored so."""
    if config not in CONFIGS or split not in (None, *SPLITS):
        raise ValueError(f"unknown configuration or split: {config}, {split}")
    pairs = require(spark.read.schema(PAIRS).parquet(path), PAIRS).where(F.col("config") == config)
    return pairs if split is None else pairs.where(F.col("split") == split)


def training_pairs(spark: SparkSession, path: str, data_augmentation: bool) -> DataFrame:
    return read_pairs(spark, path, "meaning_with_data_augmentation" if data_augmentation else "meaning")


def identical_holdout(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "meaning_holdout_identical", "test")


def unrelated_holdout(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "meaning_holdout_unrelated", "test")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), RUNS)


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), METRIC_LOG)


#: English function words.
STOP_WORDS = """
i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom whose this that these those am is are was were be
been being have has had having do does did doing will would shall should can could may might must a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very just now
"""


def stop_words() -> list[str]:
    return STOP_WORDS.split()


def read_pointers(spark: SparkSession, path: str) -> DataFrame:
    """path, md5, size, nfiles of pointer files (a few lines of YAML each) to model artifacts."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    value = lambda key: F.regexp_extract("value", rf"(?m)^[\s-]*{key}:\s*(\S+)", 1)
    number = lambda key: F.expr(f"try_cast(regexp_extract(value, '(?m)^[\\\\s-]*{key}:\\\\s*(\\\\d+)', 1) as bigint)")
    return files.select("path", value("md5").alias("md5"), number("size").alias("size"), number("nfiles").alias("nfiles"))
