"""Pair metrics by name, and their columns on a table of pairs.

The original sentence is both source and reference of every metric. Words are cut on the JVM; metrics that count or
align n-grams run together in one pass over Arrow batches, the others are column expressions on what that gives. A null
text, or one without words, gives null scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensegauge.functions import overlap
from sensegauge.functions.text import fkgl, words
from sensegauge.functions.vectors import cosine, sigmoid
from sensegauge.workers import reach


class ModelUnavailable(RuntimeError):
    """A metric needs a model that is not there; no score is made up for it."""


#: Metrics of two word lists (original, simplification).
LISTS: dict[str, Callable] = {
    "SARI": overlap.sari_own,
    "BLEU": overlap.bleu,
    "METEOR (exact)": overlap.meteor_exact,
    "TER": lambda o, s: 100 - overlap.ter(o, s),
    "ROUGE-1": lambda o, s: overlap.rouge_n(o, s, 1),
    "ROUGE-2": lambda o, s: overlap.rouge_n(o, s, 2),
    "ROUGE-L": overlap.rouge_l,
}

#: Metrics that follow from other columns.
DERIVED: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "BLEU-SARI (AM)": (("SARI", "BLEU"), lambda: (F.col("`SARI`") + F.col("`BLEU`")) / 2),
    "BLEU-SARI (GM)": (("SARI", "BLEU"), lambda: F.when((F.col("`SARI`") > 0) & (F.col("`BLEU`") > 0), F.sqrt(F.col("`SARI`") * F.col("`BLEU`"))).when(F.col("`SARI`").isNotNull() & F.col("`BLEU`").isNotNull(), 0.0)),
    "IBLEU": (("BLEU",), lambda: ibleu(F.col("`BLEU`"), F.col("`BLEU`"))),
    "FKBLEU": (("BLEU",), lambda: ibleu(F.col("`BLEU`"), F.col("`BLEU`")) * sigmoid(fkgl(F.col("simplification")) - fkgl(F.col("original")))),
}

#: Metrics of columns of the pair.
COLUMNS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "FKGL": (("simplification",), lambda: fkgl(F.col("simplification"))),
    "Sentence Transformer": (("original_vector", "simplification_vector"), lambda: cosine(F.col("original_vector"), F.col("simplification_vector"))),
}

#: Metrics whose model has to be registered with ``use_model``.
NEURAL = ("BLEURT", "BERTScore precision", "BERTScore recall", "BERTScore F1", "QuestEval", "LENS", "Coverage", "Trained model")
_MODELS: dict[str, Callable[[Column, Column], Column]] = {}


def use_model(name: str, scorer: Callable[[Column, Column], Column]) -> None:
    """Registers a scorer, most often a pandas UDF that loads its model once in each worker, on a scale of 0 to 100."""
    _MODELS[name] = scorer


def ibleu(to_reference: Column, to_source: Column, alpha: float = 0.9) -> Column:
    return alpha * to_reference - (1 - alpha) * to_source


NAMES = (*LISTS, *DERIVED, *COLUMNS, *NEURAL)


def without_model() -> list[str]:
    """All that can be computed from texts alone, in order of name."""
    return sorted([*LISTS, *DERIVED, "FKGL"])


def score(pairs: DataFrame, names: Iterable[str]) -> DataFrame:
    """pairs with a column for each metric named."""
    names = list(names)
    for n in names:
        if n not in NAMES and n not in _MODELS:
            raise ValueError(f"unknown metric: {n}")
        if n in NEURAL and n not in _MODELS:
            raise ModelUnavailable(f"{n}: no model is registered")
    lists = sorted({n for n in names if n in LISTS} | {x for n in names if n in DERIVED for x in DERIVED[n][0]})
    out = _lists(pairs, lists) if lists else pairs
    out = out.withColumns({n: f() for n in names for table in (DERIVED, COLUMNS) if n in table for f in [table[n][1]]})
    out = out.withColumns({n: _MODELS[n](F.col("original"), F.col("simplification")) for n in names if n in _MODELS})
    return out.drop(*(n for n in lists if n not in names))


def _lists(pairs: DataFrame, names: list[str]) -> DataFrame:
    cut = pairs.withColumns({"_o": words(F.col("original")), "_s": words(F.col("simplification"))})
    schema = T.StructType([*pairs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    functions, kept = [LISTS[n] for n in names], list(pairs.columns)

    reach()

    def run(batches):
        for batch in batches:
            scores: list[list[float | None]] = [[] for _ in functions]
            for o, s in zip(batch.column("_o").to_pylist(), batch.column("_s").to_pylist(), strict=True):
                if o and s:
                    a = overlap.Text(o)
                    b = a if s == o else overlap.Text(s)
                for out, f in zip(scores, functions, strict=True):
                    out.append(f(a, b) if o and s else None)
            columns = [pa.array(x, pa.float64()) for x in scores]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *names])

    return cut.mapInArrow(run, schema)


def long(scored: DataFrame, names: Iterable[str], keep: Iterable[str] = ("pair_id", "split", "label")) -> DataFrame:
    """keep, metric, score: a row for each pair and metric."""
    names = list(names)
    return scored.unpivot(list(keep), [F.col(f"`{n}`").alias(n) for n in names], "metric", "score")
