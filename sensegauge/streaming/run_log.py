"""The metric log as a stream: the last value of each run and key, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensegauge.operators.runs import last_values
from sensegauge.sources.schemas import METRIC_LOG


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Files of the log as they are appended."""
    return spark.readStream.schema(METRIC_LOG).parquet(path)


def last_value_stream(log: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes run_id, key and value to an in-memory table; state is one row for each run and key."""
    writer = last_values(log).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and key; windows are final, and their state is dropped, once events are ``late`` past them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
