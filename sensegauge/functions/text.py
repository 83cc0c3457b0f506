"""Words, sentences and n-grams as columns. One rule of words everywhere: runs of letters and digits, lower-cased."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
SENTENCE = r"[^.!?]*[\p{L}\p{N}][^.!?]*"
VOWELS = r"[aeiouyàâäáãåæéèêëíìîïóòôöõøœúùûüýÿ]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Stretches between . ! ? that hold a word, each with a space before it."""
    return F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.concat(F.lit(" "), F.trim(s)))


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams, joined by a space; none where there are fewer tokens (slicing would fail)."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def syllables(tokens: Column) -> Column:
    """Groups of vowels, one a word at least."""
    return F.aggregate(tokens, F.lit(0), lambda s, w: s + F.greatest(F.lit(1), F.regexp_count(w, F.lit(VOWELS))))


def fkgl(text: Column) -> Column:
    """Grade level by Flesch and Kincaid (1975): 0.39 words a sentence + 11.8 syllables a word - 15.59. Null without words."""
    w = words(text)
    n, s = F.size(w).cast("double"), F.greatest(F.lit(1), F.regexp_count(text, F.lit(SENTENCE))).cast("double")
    return F.when(n > 0, 0.39 * n / s + 11.8 * syllables(w) / n - 15.59)


#: What counts as a boolean, in any case, with white space around.
TRUE, FALSE = ("true", "yes", "t", "y", "1"), ("false", "no", "f", "n", "0")


def parse_bool(text: Column) -> Column:
    """Other values than those of TRUE and FALSE are an error; null is null."""
    x = F.lower(F.trim(text))
    return F.when(x.isin(*TRUE), True).when(x.isin(*FALSE), False).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
