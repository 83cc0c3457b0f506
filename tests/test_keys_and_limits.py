"""Keys of the log in both spellings, one rule of booleans, and TER with and without the published tool's limits."""

import argparse
import random

import pytest
from pyspark.sql import functions as F

from sensegauge import __main__ as main
from sensegauge.functions import overlap, text
from sensegauge.plans import evaluate
from sensegauge.sources.schemas import METRIC_LOG, RUNS


def test_keys_of_holdouts_in_both_spellings(spark):
    keys = {
        "train/test/identical_sentences_ratio_95": ("same_sentence", "Trained model", "ratio_95"), "train/test/same_sentence_ratio_95": ("same_sentence", "Trained model", "ratio_95"),
        "test/unrelated_sentences_SARI_rmse": ("irrelevant_sentence", "SARI", "rmse"), "test/irrelevant_sentence_ROUGE-1_ratio_equals": ("irrelevant_sentence", "ROUGE-1", "ratio_equals"),
        "train/test/pearson_corr": ("test", "Trained model", "pearson_corr"), "test/BLEU-SARI (AM)_R2": ("test", "BLEU-SARI (AM)", "R2"),
    }
    log = spark.createDataFrame([(str(i), 1, k, float(i)) for i, k in enumerate([*keys, "train/loss"])], METRIC_LOG)
    runs = spark.createDataFrame([(str(i), "finished", False, 500, "holdout fixed") for i in range(9)], RUNS)
    got = {int(r["run_id"]): (r["split"], r["metric"], r["stat"]) for r in evaluate.run_values(log, runs).collect()}
    assert got == dict(enumerate(keys.values()))


def test_one_rule_of_booleans(spark):
    for x in ("true", "FALSE", "Yes", "n", "T", "0", " y "):
        assert spark.range(1).select(text.parse_bool(F.lit(x)).alias("b")).first()["b"] == main.boolean(x)
    with pytest.raises(argparse.ArgumentTypeError):
        main.boolean("maybe")
    assert spark.range(1).select(text.parse_bool(F.lit(None).cast("string")).alias("b")).first()["b"] is None


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_ter(reference, prediction, words, far, most):
    """Every shift is measured."""
    hyp, shifts = list(prediction), 0
    best = plain_distance(hyp, reference)
    while True:
        found = []
        for i in range(len(hyp)):
            for j in range(len(reference)):
                if hyp[i] != reference[j] or i == j or abs(i - j) > far or (j < len(hyp) and hyp[j] == reference[j]):
                    continue
                n = 0
                while n < words and i + n < len(hyp) and j + n < len(reference) and hyp[i + n] == reference[j + n]:
                    n += 1
                rest = hyp[:i] + hyp[i + n :]
                found.append((best - plain_distance(rest[:j] + hyp[i : i + n] + rest[j:], reference), n, -i, -len(found), rest[:j] + hyp[i : i + n] + rest[j:]))
        found = found[:most]
        if not found or max(found)[0] <= 0:
            return 100 * (best + shifts) / len(reference)
        saved, *_, hyp = max(found)
        best, shifts = best - saved, shifts + 1


@pytest.mark.parametrize("limits", [(10, 50, 1000), (2, 3, 5), (None, None, None)])
def test_ter_against_every_shift(limits):
    random.seed(7)
    inf = tuple(10**9 if x is None else x for x in limits)
    for _ in range(150):
        a, b = ([random.choice("abcdefg"[: random.choice([3, 7])]) for _ in range(random.choice([1, 4, 9, 14]))] for _ in range(2))
        assert overlap.ter(a, b, *limits) == pytest.approx(plain_ter(a, b, *inf))
