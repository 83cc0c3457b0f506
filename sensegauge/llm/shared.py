"""Work that is cut from its lineage goes to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import itertools
import math

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensegauge.llm.kernels import tidy


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A folder of its own only where that is unset and the master is local, as in tests:
    on a cluster, a folder of one machine would lose work with that machine, so there it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


#: Checkpoints made so far, by the scratch that they were made in; the last ones of all are deleted when the driver ends.
_MADE: list[list[tuple[SparkSession, str]]] = [[]]


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df. Its files go with the innermost ``scratch``, or else when the driver ends."""
    shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        out = _with_bounded_size(df.checkpoint())
    _MADE[-1].append((df.sparkSession, out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()))
    if next(_CUTS) % COLLECT_EACH == 0:
        collect_garbage(df.sparkSession)
    return out


#: Estimated sizes of checkpoints of more bits are replaced by Spark's default, which no choice of a join takes for small.
SIZE_BITS = 62


def _with_bounded_size(df: DataFrame) -> DataFrame:
    """df, a checkpoint, with an estimated size that is bounded. Spark takes the product of both sides for the size of
    a join, and a checkpoint keeps that estimate: over many joins and checkpoints its digits double and double again, until
    planning spends its time on multiplying them."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes().bit_length() <= SIZE_BITS:
        return df
    jvm = spark._jvm
    parts = plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream()
    bounded = jvm.org.apache.spark.sql.execution.LogicalRDD(*parts, spark._jsparkSession, jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bounded), spark)


#: Spark deletes the files of a shuffle once the JVM has collected what refers to it, so operators of many steps ask for
#: that after so many checkpoints.
COLLECT_EACH = 8
_CUTS = itertools.count(1)


def collect_garbage(spark: SparkSession) -> None:
    """Collects the driver's garbage, and gives free memory that its two processes hold outside the heap back to the system:
    planning and the threads of many exchanges leave the JVM hundreds of MB of it."""
    gc.collect()  # Python's own references to the JVM's objects first
    spark._jvm.System.gc()
    tidy()
    with contextlib.suppress(Py4JError):  # JVMs other than HotSpot from 17 on, on Linux, have no such command
        trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str:
    """What ``jcmd System.trim_native_heap`` does, for the driver's JVM. The server's class is not exported, its interface is."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    name, kinds, given = jvm.java.lang.Class.forName, array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = name(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    return name("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


#: Rows of an Arrow batch at most, while an operator's own tables are written: documents may be long, and a batch is in
#: memory on both sides.
BATCH_ROWS = 2000


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_ROWS at most in what runs inside; the session's setting is as before afterwards."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(rows, before)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch():
    """What ``cut`` makes inside is deleted at the end, but for the DataFrames given to the function that this yields."""
    _MADE.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
        return df

    try:
        yield keep
    finally:
        for spark, path in _MADE.pop():
            if path in kept:
                _MADE[-1].append((spark, path))
            else:
                delete(spark, path)


def at_end(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    _MADE[0].append((spark, path))


@atexit.register
def _delete_all() -> None:
    for spark, path in _MADE[0]:
        with contextlib.suppress(Exception):  # the session may have ended, and its JVM with it
            delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(texts: DataFrame, key: str, text: str, chars: int) -> list[list]:
    """Rows (key, text) of a query set, in blocks of about ``chars`` characters that are fetched one at a time."""
    total = texts.agg(F.sum(F.length(text) + 16)).first()[0] or 0
    n = max(1, math.ceil(total / chars))
    block = F.pmod(F.xxhash64(key, text), F.lit(n))
    return [(texts.where(block == i) if n > 1 else texts).select(key, text) for i in range(n)]


#: Keys that are broadcast at most; a longer list is joined by shuffle.
FEW = 1_000_000


def few(keys: DataFrame, most: int = FEW) -> bool:
    """Whether keys (written already, so that counting is cheap) may be broadcast."""
    return keys.count() <= most


def restrict(rows: DataFrame, keys: DataFrame, key: str, without: bool = False) -> DataFrame:
    """The rows whose key is in keys; or those whose key is not, among them rows without key."""
    keys = cut(keys)
    keys = F.broadcast(keys) if few(keys) else keys
    return rows.join(keys, key, "left_anti" if without else "left_semi")


#: A key of more rows than HOT_ROWS, and of more than one in MOST_HOT of all rows, is hot; so there are fewer than MOST_HOT.
HOT_ROWS, MOST_HOT, SALTS = 1000, 100_000, 32


def hot_keys(counted: DataFrame, on: list[str], count: str) -> DataFrame | None:
    """The hot keys of counted, which has a row and a count for each key and is written already; None if there are none."""
    total, most = counted.agg(F.sum(count), F.max(count)).first()
    bound = max(HOT_ROWS, (total or 0) // MOST_HOT)
    return counted.where(F.col(count) > bound).select(*on) if (most or 0) > bound else None


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame | None, by: Column, how: str = "inner") -> DataFrame:
    """rows.join(table, on, how), inner or left, where table has few rows a key. Rows of hot keys are dealt to SALTS parts by a hash, and the rows
    of these keys in table copied to each; the hot keys themselves, fewer than MOST_HOT, are what is broadcast."""
    if hot is None:
        return rows.join(table, on, how)
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(by, F.lit(SALTS))).otherwise(0).cast("int")
    left = rows.join(marked, on, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(marked, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
