"""Coverage: how well masked words of a text can be guessed beside its simplification. All but the language model.

Sentences are cut into words, words that are no stop word and stand at an even place (from 1, counted over all words of
the sentence) are masked; ids of words come from a given column function. The model's input is the simplification's ids,
a separator, and the original's masked ids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensegauge.functions.text import sentences, words

#: Mask id, longest sequence of either side, what the score's denominator is smoothed by.
MASK_ID, LONGEST, SMOOTH = 0, 250, 0.1


def is_masked(word: Column, place: Column, stop: Sequence[str]) -> Column:
    """place from 0, so even places from 1 are odd here."""
    return ~word.isin(list(stop)) & (place % 2 == 1)


def mask(text: Column, ids: Callable[[Column], Column], stop: Sequence[str]) -> Column:
    """Array by sentence of (unmasked ids, masked ids, flags, words, masked words, ratio of masked words). Sentences without
    a word are dropped."""

    def of(sentence: Column) -> Column:
        own = F.transform(words(sentence), lambda w, i: F.struct(w.alias("word"), ids(w).alias("ids"), is_masked(w, i, stop).alias("masked")))

        def parts(words: Column) -> Column:
            spread = lambda f: F.flatten(F.transform(words, f))
            hidden = F.filter(words, lambda x: x["masked"])
            return F.struct(
                spread(lambda x: x["ids"]).alias("unmasked"),
                spread(lambda x: F.transform(x["ids"], lambda t: F.when(x["masked"], F.lit(MASK_ID)).otherwise(t))).alias("masked"),
                spread(lambda x: F.transform(x["ids"], lambda t: x["masked"].cast("int"))).alias("is_masked"),
                F.transform(hidden, lambda x: x["word"]).alias("masked_words"),
                (F.size(hidden) / F.size(words)).alias("ratio"),
            )

        # by way of an array of one, the words are cut once and not for each part
        return F.transform(F.array(own), parts)[0]

    return F.transform(F.filter(sentences(text), lambda s: F.size(words(s)) > 0), of)


def flat(masked: Column, field: str) -> Column:
    return F.flatten(F.transform(masked, lambda s: s[field]))


def effective_ratio(masked: Column) -> Column:
    """Mean over sentences of the share of masked words; null without sentences."""
    return F.try_divide(F.aggregate(masked, F.lit(0.0), lambda a, s: a + s["ratio"]), F.size(masked))


def model_input(simplification_ids: Column, masked: Column, separator: int) -> Column:
    """ids, labels (-1 outside the original) and flags (0 outside), cut at LONGEST ids a side."""
    generated = F.slice(simplification_ids, 1, LONGEST)
    side = lambda f: F.slice(flat(masked, f), 1, LONGEST)
    before = F.size(generated) + 1
    return F.struct(
        F.concat(generated, F.array(F.lit(separator)), side("masked")).alias("ids"),
        F.concat(F.array_repeat(F.lit(-1), before), side("unmasked")).alias("labels"),
        F.concat(F.array_repeat(F.lit(0), before), side("is_masked")).alias("flags"),
    )


def soft_score(relative: Column, flags: Column) -> Column:
    """100 * sum of the flagged relative probabilities / (number of flags + 0.1). relative: the probability of the right id
    over that of the likeliest, by place, as the language model gives it."""
    hit = F.aggregate(F.zip_with(relative, flags, lambda p, f: p * f), F.lit(0.0), lambda s, x: s + x)
    return 100 * hit / (F.aggregate(flags, F.lit(0.0), lambda s, x: s + x) + SMOOTH)


def relative_probability(logits: Column, labels: Column) -> Column:
    """By place the probability of the label over that of the likeliest id: exp(logit - largest logit), so that no softmax
    over the vocabulary is needed. logits: an array by place of arrays by id; labels below 0 give 0."""
    both = F.arrays_zip(logits.alias("row"), labels.alias("label"))
    return F.transform(both, lambda x: F.when(x["label"] >= 0, F.exp(F.get(x["row"], x["label"]) - F.array_max(x["row"]))).otherwise(0.0))
