"""Benchmark decontamination by greedy string tiling.

Words are letters, digits and non-ASCII characters, with A-Z as a-z. Karp-Rabin hashes of ``min_tile`` words of the
benchmark items are the seeds; windows of the documents meet them by hash. For each document and item with a seed in
common, the longest match without marked words is marked, again and again until none of ``min_tile`` words is left; as
tiles may lie in any order, passages in another order are found. An item leaks when tiles cover at least ``coverage``
of its words. Items of fewer than ``min_tile`` words have one seed, all their words.

The benchmark is a query set: its seeds are broadcast in blocks of at most ``block_chars`` characters, and every
document goes by every block, in one pass over the texts.

Defined results: null and empty texts and items match nothing; very long texts are matched whole, and a word repeated
thousands of times costs no more than others; repeated documents are judged each; repeated items have the same matches
each; a null item_id is an item; of items of equal shares the one with the greatest item_id is the best; other columns are
ignored by ``leaks`` and kept by ``remove``; an empty benchmark leaks nowhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensegauge.llm.kernels import _POWERS, ALNUM_LOWER, Words, bit_table, map_slices, member, mix, text_bytes, windows
from sensegauge.llm.shared import blocks

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_CHARS = 8_000_000
#: Places of seeds in items that are looked at at once, about; those of one document stay together, which are no more than
#: a block has words.
MAX_HITS = 1 << 21


class Seeds:
    """The words of a block of items and where each seed stands in them."""

    def __init__(self, rows: list, min_tile: int) -> None:
        self.ids = [r[0] for r in rows]
        data, offsets = text_bytes(pa.array([r[1] for r in rows], pa.string()))
        words = Words(data, offsets, ALNUM_LOWER)
        self.codes, self.ptr, self.k = words.codes, words.ptr, min_tile
        sizes = words.counts()
        self.short = sorted({int(n) for n in sizes if 0 < n < min_tile})
        found = []
        for k in [*self.short, min_tile]:
            codes, whole = windows(words, k)
            rows_of = words.rows()
            use = np.flatnonzero(whole & ((sizes[rows_of] == k) if k < min_tile else True))
            found.append((mix(codes[use] + np.uint64(k)), rows_of[use], use - words.ptr[rows_of[use]]))
        codes, items, at = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((at, items, codes))
        codes, self.items, self.at = codes[order], items[order], at[order]
        self.table, self.first = np.unique(codes, return_index=True)
        self.first = np.append(self.first, len(codes))
        self.bits = bit_table(self.table)

    def met(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of the seeds in common, once for each row however often they stand in it."""
        rows, out = words.rows(), [np.zeros(0, np.int64)]
        for k in [*self.short, self.k]:
            codes, whole = windows(words, k)
            codes = mix(codes + np.uint64(k))
            at = member(codes, self.table, self.bits)
            at = at[whole[at]]
            out.append(np.unique(rows[at] << 32 | np.searchsorted(self.table, codes[at])))
        both = np.unique(np.concatenate(out))
        return both >> 32, both & 0xFFFFFFFF

    def pairs(self, row: np.ndarray, seed: np.ndarray, coverage: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and items of which the seeds in common cover enough of the item's words."""
        n = self.first[seed + 1] - self.first[seed]
        posting = np.repeat(self.first[seed] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, item, at = np.repeat(row, n), self.items[posting], self.at[posting]
        order = np.lexsort((at, item, row))
        row, item, at = row[order], item[order], at[order]
        size = np.diff(self.ptr)[item]
        k = np.minimum(self.k, size)
        new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))[: len(row)]
        # words from one seed's place to the next one's, as far as the seed goes
        words = np.where(np.append(new[1:], True)[: len(row)], k, np.minimum(k, np.append(at[1:] - at[:-1], 0)[: len(row)]))
        begins = np.flatnonzero(new)
        covered = np.add.reduceat(words, begins) if len(begins) else words
        enough = covered >= coverage * size[begins]
        return row[begins][enough], item[begins][enough]


class _Part:
    """Hashes of any window of some words, and which words are marked."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.marked = codes, np.zeros(len(codes), bool)
        up, self.down = _POWERS.upto(len(codes) + 1)
        self.sums = np.append(np.uint64(0), np.cumsum(mix(codes) * up[: len(codes)]))

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of n words without a marked one."""
        taken = np.append(0, np.cumsum(self.marked))
        at = np.flatnonzero(taken[n:] == taken[:-n]) if n <= len(self.codes) else np.zeros(0, np.int64)
        return at, (self.sums[at + n] - self.sums[at]) * self.down[at]


def tile(doc: np.ndarray, item: np.ndarray, k: int) -> int:
    """Words of the item under tiles of k words or more: the longest unmarked match first, the leftmost in the document of
    equal ones. Only windows of one length are looked at at a time, so memory follows the words and not their matches."""
    a, b = _Part(doc), _Part(item)
    top = min(len(doc), len(item))
    while top >= k:
        low = k - 1
        while low < top:  # the longest length of a match that is left
            n = (low + top + 1) // 2
            if np.isin(b.free(n)[1], a.free(n)[1]).any():
                low = n
            else:
                top = n - 1
        if top < k:
            break
        _mark(a, b, top)
        top -= 1
    return int(b.marked.sum())


def _mark(a: _Part, b: _Part, n: int) -> None:
    """Marks the matches of n words, from the left."""
    at, codes = b.free(n)
    places: dict[int, list[int]] = {}
    for i, code in zip(at[::-1].tolist(), codes[::-1].tolist(), strict=True):
        places.setdefault(code, []).append(i)
    at, codes = a.free(n)
    some = np.isin(codes, np.fromiter(places, np.uint64, len(places)))
    end = 0
    for i, code in zip(at[some].tolist(), codes[some].tolist(), strict=True):
        own = places[code]
        while i >= end and own:
            j = own[-1]
            if b.marked[j : j + n].any() or not np.array_equal(a.codes[i : i + n], b.codes[j : j + n]):
                own.pop()  # marked words stay marked
                continue
            a.marked[i : i + n] = b.marked[j : j + n] = True
            end = i + n


def matcher(spark, rows: list, min_tile: int, coverage: float):
    sent = spark.sparkContext.broadcast(Seeds(rows, min_tile))

    def make():
        seeds: Seeds = sent.value
        sizes = np.diff(seeds.ptr)

        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = text_bytes(part.column("text"))
            words = Words(data, offsets, ALNUM_LOWER)
            row, seed = seeds.met(words)
            found: list[list] = part.column("leaks").to_pylist()
            stretch = np.cumsum(seeds.first[seed + 1] - seeds.first[seed]) // MAX_HITS  # a row's seeds may be in two of them
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(stretch) > 0) & (np.diff(row) > 0)))[: len(row)], len(row)) if len(row) else [0]
            for x, y in zip(cuts[:-1], cuts[1:]):
                for r, i in zip(*(z.tolist() for z in seeds.pairs(row[x:y], seed[x:y], coverage)), strict=True):
                    n = tile(words.codes[words.ptr[r] : words.ptr[r + 1]], seeds.codes[seeds.ptr[i] : seeds.ptr[i + 1]], min(min_tile, int(sizes[i])))
                    if n >= coverage * sizes[i]:
                        found[r].append({"item_id": seeds.ids[i], "covered": n, "item_words": int(sizes[i])})
            return part.set_column(part.schema.get_field_index("leaks"), "leaks", pa.array(found, part.schema.field("leaks").type))

        return of

    return make


def leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS, text: bool = False) -> DataFrame:
    """doc_id, contaminated, n_items, best_item, best_coverage, leaks (item_id, covered, item_words); text too if asked for."""
    kinds, item = dict(docs.dtypes), dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds['doc_id']}, text string, leaks array<struct<item_id: {item}, covered: long, item_words: long>>"
    out = docs.select("doc_id", "text", F.expr(f"cast(array() as array<struct<item_id: {item}, covered: long, item_words: long>>)").alias("leaks"))
    for block in blocks(benchmark.where("text is not null"), "item_id", "text", block_chars):
        out = map_slices(out, matcher(docs.sparkSession, block.collect(), min_tile, coverage), schema)
    share = "transform(leaks, x -> struct(x.covered / x.item_words as share, x.item_id as item_id))"
    best = F.expr(f"array_max({share})")
    return out.select(
        "doc_id", *["text"] * text, (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"),
        best["item_id"].alias("best_item"), F.coalesce(best["share"], F.lit(0.0)).alias("best_coverage"), "leaks",
    )


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, in which no item leaks."""
    kept = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select(F.struct("doc_id", *kept).alias("doc_id"), "text")
    return leaks(packed, benchmark, text=True, **options).where(~F.col("contaminated")).select("doc_id.doc_id", "text", *(F.col("doc_id")[c].alias(c) for c in kept)).select(*docs.columns)
