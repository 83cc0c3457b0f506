"""Schemas of the tables that the library reads and writes, and the checks at load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType()}


def _schema(ddl: str) -> T.StructType:
    """Without a session, which Spark's own parser of such strings asks for."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


PAIRS = _schema("pair_id bigint, config string, split string, original string, simplification string, label double")
SCORES = _schema("pair_id bigint, split string, metric string, score double, label double")
RUNS = _schema("run_id string, state string, augmented boolean, epochs int, variant string")
METRIC_LOG = _schema("run_id string, step bigint, key string, value double")
ARTIFACTS = _schema("run_id string, step bigint, key string, value string")

#: Names of the dataset's configurations and splits.
CONFIGS = ("meaning_with_data_augmentation", "meaning", "meaning_holdout_identical", "meaning_holdout_unrelated")
SPLITS = ("train", "dev", "test")


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns of the schema, cast; a column that is missing is an error, at once and not at the first row."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*(df[f.name].cast(f.dataType) for f in schema.fields))
