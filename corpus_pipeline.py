"""The corpus pipeline: STAGES on documents, each written as Parquet and read again as the next one's input.

Defined results, by those of the operators: rows without text pass the first four stages and have no ids; rows without
doc_id are never copies of others; rows that share a doc_id are one document, of which the near-copy stage keeps one row;
very long texts are treated whole; other columns, whatever their names, are kept up to the last stage; an empty table
gives an empty one at each stage."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensegauge.llm import decontaminate, line_dedup, ngram_join, pieces, toxicity
from sensegauge.llm.shared import BATCH_ROWS, at_end, collect_garbage, delete, scratch, shared_folder, small_batches, table


def lean(stage):
    """The stage with Arrow batches of BATCH_ROWS rows at most, which is set for the session: whoever runs the stage writes
    its rows, and documents may be long. ``run`` sets it back. What stages before left in the driver's memory goes first."""

    @functools.wraps(stage)
    def of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
            spark.conf.set(rows, str(BATCH_ROWS))
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return of


@lean
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Fitted to the labels of documents that are still there."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


@lean
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; those that lose all of them go."""
    return line_dedup.clean(docs)


@lean
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word windows link at 0.8, the one with the smallest id."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


@lean
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


@lean
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding gives the text back."""
    sent = pieces.ship(spark, pieces.Vocabulary.read())
    coded = pieces.encode(docs.select("doc_id", "text"), sent, decoded=True)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("SentencePiece encoding and decoding", tokenize),
]

#: A fitted model and searches stand between the tables and the rows; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once a stage is written, what it made on the way goes, and so do the rows of the stage before. The last stage's rows,
    which are the result, go when the driver ends."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    at_end(spark, folder)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
    return docs
