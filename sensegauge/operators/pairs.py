"""Tables of pairs: holdouts, and augmentation by symmetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identical(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Each text with itself, rated 100."""
    return texts.select(F.col(key).alias("pair_id"), F.lit("same_sentence").alias("split"), F.col(text).alias("original"), F.col(text).alias("simplification"), F.lit(100.0).alias("label"))


#: Rows of a range of ``unrelated``, about, and rows that are looked at after each.
RANGE, AHEAD = 1000, 4


def unrelated(texts: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """Each text with another one, rated 0: of another group (a row is one of its own, if None) and not equal to it. Every
    text gets one if the table has such a text; texts that are null are no texts.

    Rows are dealt by hash over ranges whose number follows from the count, so no task sorts all rows. The other text is
    one of the next ``AHEAD`` of the range, in a circle; if none will do, one of six texts of the table of which one does."""
    own = F.col(group or key)
    texts = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("pair_id"), own.alias("group"), F.col(text).alias("original"))
    n, spare = _spare(texts)
    h = F.xxhash64("pair_id", "group", "original")
    by = Window.partitionBy(F.pmod(h, F.lit(max(1, n // RANGE)))).orderBy(h)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("group", F.col("original").alias("text"))
    near = F.array(*(F.coalesce(F.lead(row, i).over(by), F.nth_value(row, i).over(whole)) for i in range(1, AHEAD + 1)), *spare)
    fits = lambda x: x.isNotNull() & ~x["group"].eqNullSafe(F.col("group")) & (x["text"] != F.col("original"))
    other = F.get(F.filter("near", fits), F.lit(0))["text"]
    paired = texts.withColumn("near", near).select("pair_id", F.lit("irrelevant_sentence").alias("split"), "original", other.alias("simplification"), F.lit(0.0).alias("label"))
    return paired.where(F.col("simplification").isNotNull())


def _spare(texts: DataFrame) -> tuple[int, list[Column]]:
    """The number of rows, and texts with their groups. For each row there is one of another group and text among them, if
    there is one at all: two groups of several texts have one for each row; a group of one text is another one than that of
    a row whose text differs, so the least and the greatest of such texts are enough."""
    each = texts.groupBy("group").agg(F.count("*").alias("n"), F.min("original").alias("a"), F.max("original").alias("b"))
    many, one = F.when(F.col("a") != F.col("b"), F.struct("group", "a", "b")), F.when(F.col("a") == F.col("b"), F.struct("a", "group"))
    found = each.agg(F.sum("n").alias("n"), F.min(many).alias("p"), F.max(many).alias("q"), F.min(one).alias("r"), F.max(one).alias("s")).first()
    pairs = [(x["group"], x[c]) for x in (found["p"], found["q"]) if x for c in ("a", "b")] + [(x["group"], x["a"]) for x in (found["r"], found["s"]) if x]
    kind = texts.schema["group"].dataType
    return found["n"] or 0, [F.struct(F.lit(g).cast(kind).alias("group"), F.lit(t).alias("text")) for g, t in pairs]


def augment(pairs: DataFrame) -> DataFrame:
    """Pairs and the same pairs swapped, once each: meaning is kept both ways or not at all."""
    swapped = pairs.withColumns({"original": F.col("simplification"), "simplification": F.col("original")})
    same = [c for c in pairs.columns if c != "pair_id"]
    return pairs.unionByName(swapped).dropDuplicates(same)
