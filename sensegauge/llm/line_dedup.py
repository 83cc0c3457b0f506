"""Line dedup by a deletion-neighbourhood join.

Of lines that are equal, or that one edit sets apart, the earliest stays; the order is by doc_id, then by line. The
symbols that are edited are words: near-copy lines of a corpus differ by a word, hardly ever by a single character. An
edit is a word that is replaced, missing or added; white space between words is no part of the comparison. A line goes
if *any* earlier line of the corpus is that near, whether or not that line stays itself, so the result does not depend
on the order of processing. Lines without a word are left alone; lines of fewer than ``near_words`` words only go as
exact copies, as one word is much of a short line (1 compares all lines).

Two lines are within one edit when they are equal after at most one word of each is left out, at the same place if of
both. So every line sends out its variants with a word left out, as hashed keys with the place, and itself; of lines with
one key the earliest is found by a minimum, without pairs; and distances are verified on the words. To keep variants few,
distinct lines go through a blocking first, which loses no pair: cut into halves at the same place, counted from either
end, two lines within one edit differ in one half only, so only lines that share a half with another one send variants.

Defined results: null and empty texts have no lines and stay as they are; very long texts and lines are looked at whole;
repeated rows, and rows that share a doc_id, stand at the same place and lose the same line numbers if these go; rows
without doc_id are not looked at and stay; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensegauge.llm.kernels import _POWERS, LINES, TEXT, Words, bit_table, map_arrow, map_slices, member, mix, slices, text_bytes
from sensegauge.llm.shared import cut, dealt_join, few, hot_keys, scratch

#: Words of a line from which on one of them may differ: one in ten.
NEAR_WORDS = 10
#: Places of lines that are broadcast at most, eight bytes each; more go by shuffle.
MAX_SENT = 1 << 21
_U = np.uint64
#: A line of these only is without a word.
BLANK = " \t\x0b\x0c\r"
TEXT_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
class Lines:
    """The lines with a word of a slice of texts, and hashes of any stretch of their words."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_bytes(column)
        words, lines = Words(data, offsets, TEXT), Words(data, offsets, LINES)
        a, b = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
        full = b > a
        self.data, self.starts, self.ends = data, lines.starts[full], lines.ends[full]
        self.rows = lines.rows()[full]
        breaks = np.append(0, np.cumsum(data == 0x0A))
        self.numbers = breaks[self.starts] - breaks[offsets[self.rows]]
        self.a, self.b, self.n = a[full], b[full], (b - a)[full]
        up, self.down = _POWERS.upto(len(words.codes) + 1)
        self.sums = np.zeros(len(words.codes) + 1, _U)
        np.cumsum(mix(words.codes) * up[: len(words.codes)], out=self.sums[1:])
        #: A hash of the line's bytes, and one of its words.
        self.h1, self.h2 = lines.codes[full], mix(self.part(self.a, self.b) ^ _U(0x5DEECE66D) + self.n.astype(_U))

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def halves(self) -> list[np.ndarray]:
        """For lines of n words: keys of all but one half of a line of n, and of n - 1, as the shorter one of a pair."""
        out = []
        for size in (self.n, self.n - 1):
            for j in range(2):
                a, b = size * j // 2, size * (j + 1) // 2
                head, tail = self.part(self.a, self.a + a), self.part(self.b - (size - b), self.b)
                out.append(mix(mix(head + a.astype(_U)) + tail * _U(3) + size.astype(_U) * _U(64) + _U(j)))
        return out

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, line, and place of the word that is left out, of each variant; whole lines come first and have place -1."""
        n = self.n[lines]
        at = np.repeat(lines, n)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        begin, end, p = self.a[at], self.b[at], self.a[at] + place
        # what follows the place moves one word to the front
        less = ((self.sums[p] - self.sums[begin]) + (self.sums[end] - self.sums[p + 1]) * self.down[1]) * self.down[begin]
        less = mix(less + (end - begin - 1).astype(_U))
        whole = mix(self.part(self.a[lines], self.b[lines]) + n.astype(_U))
        return np.concatenate([whole, less]), np.concatenate([lines, at]), np.concatenate([np.full(len(lines), -1), place])

    def texts(self, lines: np.ndarray) -> pa.Array:
        raw = self.data.tobytes()
        return pa.array([raw[a:b] for a, b in zip(self.starts[lines].tolist(), self.ends[lines].tolist(), strict=True)], pa.binary()).cast(pa.string())


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


KEYS = ("k0", "k1", "k2", "k3")


def _all_lines(docs: DataFrame, kind: str, near_words: int) -> DataFrame:
    """h1, h2 (hashes of the line), doc_id, line, and KEYS: of the halves, if the line is long enough for near copies."""

    def make():
        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            lines = Lines(part.column("text"))
            short = lines.n < near_words
            keys = [pa.array(k.view(np.int64), mask=short) for k in lines.halves()]
            return pa.RecordBatch.from_arrays([_longs(lines.h1), _longs(lines.h2), part.column("doc_id").take(pa.array(lines.rows)), pa.array(lines.numbers.astype(np.int32)), *keys], ["h1", "h2", "doc_id", "line", *KEYS])

        return of

    return map_slices(docs, make, f"h1 long, h2 long, doc_id {kind}, line int, k0 long, k1 long, k2 long, k3 long")


def _with_lines(docs: DataFrame, asked: DataFrame, columns, names: list[str], schema: str) -> DataFrame:
    """columns(row batch, Lines, the lines asked for) of the documents that hold lines asked for: doc_id, line, written
    already. Places that are few are broadcast as hashes; more meet the documents by shuffle, as numbers by document, which
    are as many as it has lines at most."""
    if few(asked, MAX_SENT):
        places = asked.select(F.xxhash64("doc_id").alias("d"), F.col("line").cast("long").alias("line")).toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(np.unique(_place(places.column("d").to_numpy(), places.column("line").to_numpy())))
        rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("d")).join(F.broadcast(asked.select("doc_id").distinct()), "doc_id", "left_semi")
    else:
        sent, rows = None, docs.join(asked.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "doc_id").select("doc_id", "text", "lines")

    def run(batches):
        table = sent.value if sent else None
        bits = bit_table(table) if sent else None
        for part in (p for b in batches for p in slices(b)):
            lines = Lines(part.column("text"))
            if sent:
                use = member(_place(part.column("d").to_numpy()[lines.rows], lines.numbers), table, bits)
            else:
                own = part.column("lines")
                use = np.flatnonzero(np.isin(lines.rows.astype(np.int64) << 32 | lines.numbers, np.repeat(np.arange(part.num_rows), np.diff(own.offsets.to_numpy())) << 32 | own.flatten().to_numpy()))
            yield pa.RecordBatch.from_arrays(columns(part, lines, use), names)

    return map_arrow(rows, run, schema)


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(_U) + mix(line.astype(_U) + _U(1)))


def _variants(docs: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """v, place, h1, h2, at (doc_id, line) of the variants of the lines at the places asked for; the whole line has its text."""

    def columns(part, lines, use):
        v, of, place = lines.variants(use)
        text = pa.concat_arrays([lines.texts(use), pa.nulls(len(of) - len(use), pa.string())])
        return [_longs(v), pa.array(place.astype(np.int32)), _longs(lines.h1[of]), _longs(lines.h2[of]), part.column("doc_id").take(pa.array(lines.rows[of])), pa.array(lines.numbers[of].astype(np.int32)), text]

    found = _with_lines(docs, asked, columns, ["v", "place", "h1", "h2", "doc_id", "line", "text"], f"v long, place int, h1 long, h2 long, doc_id {kind}, line int, text string")
    return found.select("v", "place", "h1", "h2", F.struct("doc_id", "line").alias("at"), "text")


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two lists are equal, or one element that is replaced, missing or added sets them apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _verified(batches):
    split = TEXT_SPLIT.findall
    for batch in batches:
        ok = [one_edit(split(a), split(b)) for a, b in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield batch.select(["h1", "h2"]).filter(pa.array(ok, pa.bool_()))


def _met(rows: DataFrame, table: DataFrame, on: list[str], count: str, by) -> DataFrame:
    """rows with the one row that table (written already) has for their key: by broadcast while table is small by its rows'
    number, else by shuffle, with hot keys dealt out."""
    own = table.drop(count)
    return rows.join(F.broadcast(own), on) if few(table) else dealt_join(rows, own, on, hot_keys(table, on, count), by)


def _near(docs: DataFrame, candidates: DataFrame, kind: str) -> DataFrame:
    """h1, h2 of the candidates that one edit sets apart from an earlier one. candidates: h1, h2, at (the first place)."""
    with_text = cut(_variants(docs, cut(candidates.select("at.*")), kind))
    variants = with_text.drop("text")
    # rows that share a doc_id may have another line at a place asked for, so a line may be there at several places; the
    # first one and its hash are kept, as a line is no near copy of itself
    less, first = F.col("place") >= 0, F.struct("at", "h1", "h2")
    of = variants.groupBy("v").agg(F.count("*").alias("c"), F.min(F.when(less, first)).alias("first_less"), F.min(F.when(~less, first)).alias("first_whole"), F.min("h1").alias("x"), F.max("h1").alias("y"))
    of = cut(of.where("x <> y").drop("x", "y"))
    same = cut(variants.where(less).groupBy("v", "place").agg(F.count("*").alias("c"), F.min(first).alias("earlier"), F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").drop("x", "y"))
    # a whole line meets lines with a word left out, and those of the same words; a line with a word left out meets whole
    # ones, and those without one at the same place
    by_text = _met(variants, of, ["v"], "c", F.xxhash64("h1")).select("h1", "h2", "at", F.explode(F.array(F.when(~less, F.col("first_less")), F.col("first_whole"))).alias("earlier"))
    by_place = _met(variants, same, ["v", "place"], "c", F.xxhash64("h1")).select("h1", "h2", "at", "earlier")
    found = by_text.unionByName(by_place).where("earlier.at < at and (earlier.h1 <> h1 or earlier.h2 <> h2)")
    found = cut(found.select("h1", "h2", F.col("earlier.h1").alias("o1"), F.col("earlier.h2").alias("o2")).distinct())
    texts = with_text.where("place < 0").groupBy("h1", "h2").agg(F.min("text").alias("text"))
    often = cut(found.groupBy("o1", "o2").agg(F.count("*").alias("c")))
    pairs = dealt_join(found, texts.toDF("o1", "o2", "other"), ["o1", "o2"], hot_keys(often, ["o1", "o2"], "c"), F.xxhash64("h1")).join(texts, ["h1", "h2"])
    return map_arrow(pairs.select("h1", "h2", "text", "other"), _verified, "h1 long, h2 long").distinct()


def gone_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, line (from 0), near: the lines that go; near if for an earlier line that is not equal to it."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch() as keep:
        lines = cut(_all_lines(docs, kind, near_words))
        keys = lines.select("h1", "h2", F.explode(F.array_compact(F.array(*KEYS))).alias("key"))
        shared = cut(keys.groupBy("key").agg(F.count("*").alias("c"), F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("key", "c"))
        near = _met(keys, shared, ["key"], "c", F.xxhash64("h1", "key")).select("h1", "h2").distinct().withColumn("candidate", F.lit(True))
        counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("c"))
        wanted = cut(counts.join(near, ["h1", "h2"], "left").where("c > 1 or candidate"))
        by = F.xxhash64("doc_id", "line")
        firsts = _met(lines.drop(*KEYS), wanted, ["h1", "h2"], "c", by).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.count("*").alias("c"), F.max("candidate").alias("candidate"))
        firsts = cut(firsts)
        found = _near(docs, firsts.where("candidate").select("h1", "h2", "at"), kind).withColumn("near", F.lit(True))
        why = cut(firsts.select("h1", "h2", "at", "c").join(found, ["h1", "h2"], "left").where("c > 1 or near"))
        met = _met(lines.drop(*KEYS), why, ["h1", "h2"], "c", by)
        later = F.struct("doc_id", "line") > F.col("at")
        return keep(cut(met.where(later | F.col("near")).select("doc_id", "line", (~later).alias("near")).distinct()))


def dedup(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with the text that stays, and n_lines (lines with a word before), n_exact, n_near (lines that went), in place of
    columns of these names."""
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_lines", "n_exact", "n_near")]
    packed = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    gone = gone_lines(docs, near_words)
    # as many numbers as the document has lines, at most
    by_doc = gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone"), F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"))
    met = packed.join(by_doc.hint("shuffle_hash"), "doc_id", "left")  # texts need not be sorted
    split = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    n = F.coalesce(F.size(F.filter(split, lambda x: F.btrim(x, F.lit(BLANK)) != "")), F.lit(0)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return met.select("doc_id", text.alias("text"), *(F.col("rest")[c].alias(c) for c in others), n.alias("n_lines"), zero("n_exact"), zero("n_near"))


def clean(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs, with their columns, without the lines that go; n_chars follows the text. Documents of which every line with
    a word goes are left out."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = dedup(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("row")), near_words)
    less = F.col("n_exact") + F.col("n_near")
    done = done.where((F.col("n_lines") == 0) | (F.col("n_lines") > less))
    own = {c: F.col("row")[c] for c in others}
    if "n_chars" in own:
        own["n_chars"] = F.when(less > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return done.select("doc_id", "text", *(x.alias(c) for c, x in own.items())).select(*docs.columns)
