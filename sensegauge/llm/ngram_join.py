"""Similarity join on word n-grams: grouped prefix join, then components.

A document's set holds its distinct windows of ``k`` words (all its words as one, if they are fewer). Documents link
when 100 * intersection >= percent * union. Exact, by these steps:

1. Equal sets are one *unit*. Windows are ordered by hash. Of a set of n the *prefix* is its first 2 * (1 - t) * n + 2
   windows, t = percent / 100. In the ordered union of two sets that link fewer than one in two of the first windows
   are in one set only, so that two neighbours in the prefixes of both are the same: pairs of neighbours are the keys.
   Unlike single windows they hardly ever meet by a common phrase or passage, so no frequencies are needed.
2. Units with the same prefix and size are one *group*; its smallest unit leads it. Groups are posted under their keys,
   and under size bands too where a key has many.
3. Each group is verified against one hub of a posting that it is under, by size and by parity bitmap first (a set's
   windows hashed to 1024 bits; bits that differ bound the difference from below), then by the sets; members against
   their leaders. That is linear in the groups, and makes one component of most of a large group of near copies. A few
   rounds with other hubs follow for what is in different components still.
4. Of postings with several components left, pairs of units of different ones are expanded and verified, by size and
   bitmap first. Units under crowded postings, such as pages of one template, get new keys before that: the argument of
   step 1 holds for any order, so their windows are ordered anew, those that many of them have last. Then only units that
   are alike beyond the template meet. Postings that are crowded even so are tested in blocks, each pair in one task.

So every link between different components is found, and links within a component are not spelled out.

Defined results: null and empty texts and texts without words have empty sets and link with nothing; repeated rows
have equal sets and link; a row without doc_id takes part, but no component is named by it; rows that share a doc_id
are judged by their own texts; very long texts are compared whole; equal sets are ordered by nothing but their hash, which
decides no link; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sensegauge.llm import shared
from sensegauge.llm.components import components
from sensegauge.llm.kernels import TEXT_LOWER, Words, map_arrow, map_slices, mix, text_bytes, windows
from sensegauge.llm.shared import cut, dealt_join, hot_keys, restrict, scratch

#: Keys that are counted at once, in a search for hot ones.
STRETCH = 1 << 21
#: Windows that many units of crowds have, and that come last in these units' order, at most; which ones changes no link.
MAX_OFTEN = 1 << 20
#: Rounds of hubs, and the share of keys (one in so many, by hash) that hubs are taken from.
ROUNDS, HUB_KEYS = 2, 8
#: Groups under one key from which on these are dealt to size bands, and units from which on pairs carry bitmaps.
BANDED, CROWDED = 8, 32
#: Units in a block of a crowd.
BLOCK = 1000
BITMAP = 16


@dataclass(frozen=True)
class Rule:
    k: int
    percent: int

    def __post_init__(self) -> None:
        if not 75 <= self.percent <= 100:
            raise ValueError("percent must be 75 to 100")  # neighbours need not meet below

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return 2 * (100 - self.percent) * n // 100 + 2


class Sets:
    """Sorted distinct window codes of each row of a slice."""

    def __init__(self, column: pa.Array, k: int) -> None:
        data, offsets = text_bytes(column)
        words = Words(data, offsets, TEXT_LOWER)
        counts, rows = words.counts(), words.rows()
        codes, whole = windows(words, k)
        codes, rows = codes[whole], rows[whole]
        for size in range(1, k):
            short = np.flatnonzero(counts == size)
            if len(short):
                own = mix(windows(words, size)[0][words.ptr[short]] + np.uint64(size))
                codes, rows = np.concatenate([codes, own]), np.concatenate([rows, short])
        order = np.lexsort((codes, rows))
        codes, rows = codes[order], rows[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
        self.codes, self.rows = codes[new], rows[new]
        self.n = np.bincount(self.rows, minlength=len(counts)).astype(np.int64)
        self.ptr = np.append(0, np.cumsum(self.n))

    def sums(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n), np.uint64)
        some, at = np.unique(rows, return_index=True)
        if len(some):
            out[some] = np.add.reduceat(values, at)
        return out

    def fingerprints(self) -> pa.Array:
        a = mix(self.sums(mix(self.codes), self.rows) + self.n.astype(np.uint64))
        b = mix(self.sums(mix(self.codes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.rows) ^ self.n.astype(np.uint64))
        raw = np.stack([a, b], 1).astype(">u8").tobytes()
        return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * 16).astype(np.int32).tobytes()), pa.py_buffer(raw)])

    def bitmaps(self) -> np.ndarray:
        """For each row BITMAP words of 64 bits: the parity of its windows by bit."""
        out = np.zeros(len(self.n) * BITMAP, np.uint64)
        place = self.rows * BITMAP + (self.codes & np.uint64(BITMAP - 1)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        bit = np.uint64(1) << ((self.codes[order] >> np.uint64(8)) & np.uint64(63))
        some, at = np.unique(place[order], return_index=True)
        if len(some):
            out[some] = np.bitwise_xor.reduceat(bit, at)
        return out

    def prefixes(self, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes and rows of the prefixes; keys (pairs of neighbours in them) and their rows."""
        rank = np.arange(len(self.rows)) - self.ptr[self.rows]
        use = rank < rule.prefix(self.n)[self.rows]
        codes, rows = self.codes[use], self.rows[use]
        pair = rows[1:] == rows[:-1]
        return codes, rows, _keys(codes)[pair], rows[1:][pair]


def _keys(codes: np.ndarray) -> np.ndarray:
    """The key of each pair of neighbours."""
    return mix(codes[:-1] * np.uint64(0x9FB21C651E98DF25) + codes[1:])


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    offsets = np.append(0, np.cumsum(np.bincount(rows, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, unit, grp, bits and the keys of each document."""

    def make():
        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            sets, n = Sets(part.column("text"), rule.k), part.num_rows
            codes, rows, keys, key_rows = sets.prefixes(rule)
            group = mix(sets.sums(mix(codes), rows) + mix(sets.n.astype(np.uint64)))
            bitmaps = _lists(sets.bitmaps(), np.repeat(np.arange(n), BITMAP), n)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets.n), sets.fingerprints(), pa.array(group.view(np.int64)), bitmaps, _lists(keys, key_rows, n)], ["doc_id", "n", "unit", "grp", "bits", "keys"])

        return of

    kind = dict(docs.dtypes)["doc_id"]
    return cut(map_slices(docs.select("doc_id", "text"), make, f"doc_id {kind}, n long, unit binary, grp long, bits array<long>, keys array<long>"))


def _codes(docs: DataFrame, rule: Rule, units: DataFrame, bare: bool) -> DataFrame:
    """unit, codes (the sorted set as bytes) of units (unit, doc_id), once each. bare: there are units without doc_id."""

    def make():
        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = Sets(part.column("text"), rule.k)
            raw = sets.codes.tobytes()
            codes = pa.array([raw[8 * a : 8 * b] for a, b in zip(sets.ptr[:-1].tolist(), sets.ptr[1:].tolist(), strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([sets.fingerprints(), codes], ["unit", "codes"])

        return of

    asked = restrict(docs.select("doc_id", "text"), units.select("doc_id").distinct(), "doc_id")
    if bare:  # no doc_id leads to these, so all rows without one are read
        asked = asked.unionByName(docs.where("doc_id is null").select("doc_id", "text"))
    found = map_slices(asked, make, "unit binary, codes binary")
    found = cut(found.join(units.select("unit"), "unit", "left_semi") if bare else found)
    # more than one row a unit only where rows share a doc_id, or have none
    return found if found.count() == units.count() else found.dropDuplicates(["unit"])


def _verify(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """a, b, both, either (sizes of intersection and union) for pairs (a, b) of units. b may be in many pairs."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            both, either = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(z[i].as_buffer(), np.uint64) for z in (x, y))
                at = np.searchsorted(q, p)
                both[i] = np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p)
                either[i] = len(p) + len(q) - both[i]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(both), pa.array(either)], ["a", "b", "both", "either"])

    left = pairs.join(codes.select(F.col("unit").alias("a"), F.col("codes").alias("codes_a")), "a")
    full = left.join(codes.select(F.col("unit").alias("b"), F.col("codes").alias("codes_b")), "b")
    return map_arrow(full.select("a", "b", "codes_a", "codes_b"), run, "a binary, b binary, both long, either long")


def _can_link(n_a: Column, bits_a: Column, n_b: Column, bits_b: Column, percent: int) -> Column:
    """Whether two sets can link by their sizes and bitmaps."""
    differ = sum((F.bit_count(F.get(bits_a, i).bitwiseXOR(F.get(bits_b, i))) for i in range(BITMAP)), F.lit(0))
    both = F.least(F.floor((n_a + n_b - differ) / 2), n_a, n_b)
    return _can_size(n_a, n_b, percent) & (both * 100 >= (n_a + n_b - both) * percent)


def _can_size(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for each row of docs."""
    with scratch() as keep:
        return keep(cut(_joined(docs, Rule(k, percent))))


def _joined(docs: DataFrame, rule: Rule) -> DataFrame:
    percent = rule.percent
    rows = _rows(docs, rule)
    full = rows.where("n > 0")

    # postings (w, band, grp); members of a group have the same keys; groups of several units are postings of their own
    units = cut(full.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("bits").alias("bits")))
    leaders = cut(units.groupBy("grp").agg(F.min("unit").alias("leader"), F.first("n").alias("n"), F.count("*").alias("c")))
    posted = _posted(full).join(leaders.select("grp", "n"), "grp").select("w", "grp", F.explode(_bands(F.col("n"), F.col("c"), percent)).alias("band"))
    several = leaders.where("c > 1").select(F.col("grp").alias("w"), "grp", F.lit(-1).alias("band"))
    posted = cut(posted.unionByName(several))
    sizes = cut(posted.groupBy("w", "band").agg(F.count("*").alias("c")))
    hot = hot_keys(sizes, ["w", "band"], "c")
    by_posting = lambda rows, table, by: dealt_join(rows, table, ["w", "band"], hot, F.xxhash64(by))
    leaders = cut(leaders.join(posted.select("grp").distinct(), "grp", "left_semi"))
    near = cut(dealt_join(units, leaders.select("grp", "leader"), ["grp"], hot_keys(leaders, ["grp"], "c"), F.xxhash64("unit")))
    bare = not near.where("doc_id is null").isEmpty()

    def possible(pairs: DataFrame) -> DataFrame:
        side = lambda c: near.select(F.col("unit").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return cut(both.where(_can_link(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"), percent)).select("a", "b"))

    def links_of(pairs: DataFrame) -> DataFrame:
        units = near.join(pairs.select(F.col("a").alias("unit")).union(pairs.select("b")).distinct(), "unit", "left_semi")
        with scratch() as keep:  # the sets are large
            return keep(cut(_verify(pairs, _codes(docs, rule, units, bare)).where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")))

    def place(roots: DataFrame | None) -> DataFrame:
        """unit, grp, leader, n, root, and c (a hash of root, to compare by)."""
        own = near.select("unit", "grp", "leader", "n")
        own = own.withColumn("root", F.col("unit")) if roots is None else own.join(roots, F.col("unit") == F.col("node"), "left").select("unit", "grp", "leader", "n", F.coalesce("root", "unit").alias("root"))
        return own.withColumn("c", F.xxhash64("root"))

    placed, roots, tried = place(None), None, None
    some = posted.where(F.pmod("w", F.lit(HUB_KEYS)) == 0).join(leaders.select("grp", "leader"), "grp")
    for turn in range(ROUNDS):
        at = some.join(placed.where("unit = leader").select("grp", "c"), "grp").withColumn("o", F.xxhash64("grp", F.lit(turn)))
        hubs = at.groupBy("w", "band").agg(F.min(F.struct("o", "leader", "c")).alias("hub"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("w", "band", "hub")
        stars = by_posting(at, hubs, "grp").where("c <> hub.c").groupBy("leader").agg(F.min("hub").alias("hub")).select(F.col("leader").alias("a"), F.col("hub.leader").alias("b"))
        pairs = stars.unionByName(near.where("unit <> leader").select(F.col("unit").alias("a"), F.col("leader").alias("b"))) if turn == 0 else stars
        pairs = possible(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = links_of(pairs) if not pairs.isEmpty() else None
        if links is None or links.isEmpty():
            break
        roots = cut(components(_with(links, roots)))
        placed = cut(place(roots))

    # postings with several components, and pairs of these under them; a group counts once for a component
    parts = cut(placed.groupBy("grp", "c").agg(F.min("unit").alias("unit"), F.count("*").alias("k")))
    mixed = posted.join(parts, "grp").groupBy("w", "band").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.sum("k").alias("units"), F.min_by("c", "unit").alias("hub")).where("x <> y").drop("x", "y")
    mixed = cut(by_posting(posted, mixed, "grp"))
    own = placed.select("grp", "unit", "n", "c")
    under = cut(dealt_join(own, mixed, ["grp"], hot_keys(leaders, ["grp"], "c"), F.xxhash64("unit")).select("w", "band", "unit", "n", "c", "units", (F.col("c") == F.col("hub")).alias("main")))
    small, crowded = under.where(F.col("units") <= CROWDED), under.where(F.col("units") > CROWDED)
    pairs = _pairs(small, percent)
    with scratch() as keep:
        pairs = pairs.unionByName(keep(cut(_blocks(crowded, near, percent, lambda crowd: _crowds(docs, rule, crowd, near, bare)))))
    before = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    more = possible(pairs.distinct().join(before, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        roots = components(_with(links_of(more), roots))
    return _result(rows, roots)


def _posted(rows: DataFrame) -> DataFrame:
    """w, grp, c: the keys that several groups have, and about how many. One shuffle of the keys, from which the rows of
    hot keys are held back."""
    each = rows.select(F.explode("keys").alias("w"), "grp")
    hot = _hot(rows)
    cold = each if hot is None else each.join(F.broadcast(hot), "w", "left_anti")
    by = W.Window.partitionBy("w")  # no more than the bound of hot keys
    posted = cold.repartition("w").distinct().withColumn("c", F.count("*").over(by)).where("c > 1")
    return posted if hot is None else posted.unionByName(each.join(F.broadcast(hot), "w").distinct().withColumn("c", F.lit(shared.HOT_ROWS).cast("long")))


def _hot(rows: DataFrame) -> DataFrame | None:
    """w: all keys of more rows than HOT_ROWS and than a MOST_HOT-th of all rows, found without a shuffle of all keys. A key
    with such a share of all rows has that share in some stretch of them. Stretches give the keys that have half of it, by
    which no more than half of a hot key's rows go uncounted; so there are fewer than 2 * MOST_HOT keys here."""
    total = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    bound = max(shared.HOT_ROWS, total // shared.MOST_HOT)
    if total <= bound:
        return None

    def run(batches):
        held, n = [], 0

        def found():
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            some = count * 2 * total >= n * bound
            return pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(count[some])], ["w", "c"])

        for batch in batches:
            held.append(batch.column("keys").flatten().to_numpy())
            n += len(held[-1])
            if n >= STRETCH:
                yield found()
                held, n = [], 0
        if n:
            yield found()

    hot = cut(map_arrow(rows.select("keys"), run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).where(F.col("c") * 2 >= bound).select("w"))
    return None if hot.isEmpty() else hot


def _bands(n: Column, c: Column, percent: int) -> Column:
    """The size bands of a set of n under a key of c groups: two sets that link have one in common."""
    band = F.floor(F.log(n) / -math.log(percent / 100 - 1e-9)).cast("int")
    return F.when(c >= BANDED, F.array(band, band + 1)).otherwise(F.array(F.lit(-2)))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that can link by size of units of different components under one posting (w, band, unit, n, c, main);
    the posting's main component is not paired with itself."""
    x, y = rows.where("not main").alias("x"), rows.alias("y")
    same = (F.col("x.w") == F.col("y.w")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & (F.col("y.main") | (F.col("x.unit") < F.col("y.unit")))
    met = x.join(y, same & _can_size(F.col("x.n"), F.col("y.n"), percent))
    return met.select(F.greatest("x.unit", "y.unit").alias("a"), F.least("x.unit", "y.unit").alias("b")).distinct()


def _crowds(docs: DataFrame, rule: Rule, crowd: DataFrame, near: DataFrame, bare: bool) -> DataFrame:
    """Pairs (a, b) that can link of the units of a crowd (unit, n, c), under keys of an order in which windows that many
    of these units have come last, the more of them the later: with many units, sets have hardly any other windows."""
    codes = _codes(docs, rule, near.join(crowd.select("unit"), "unit", "left_semi"), bare)
    sent = docs.sparkSession.sparkContext.broadcast(_often(codes))

    def run(batches):
        often, scale = sent.value
        for batch in (b for b in batches if b.num_rows):
            found = []
            for raw in batch.column("codes"):
                p = np.frombuffer(raw.as_buffer(), np.uint64)
                p = p[np.lexsort((p, _scale(p, often, scale)))][: int(rule.prefix(np.int64(len(p))))]
                found.append(np.unique(_keys(p)))
            yield pa.RecordBatch.from_arrays([batch.column("unit").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))), pa.array(np.concatenate(found).view(np.int64))], ["unit", "w"])

    posted = cut(map_arrow(codes, run, "unit binary, w long").join(crowd, "unit"))
    counts = cut(posted.groupBy("w").agg(F.count("*").alias("k"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").drop("x", "y"))
    posted = dealt_join(posted, counts, ["w"], hot_keys(counts, ["w"], "k"), F.xxhash64("unit"))
    posted = cut(posted.select("w", "unit", "n", "c", F.explode(_bands(F.col("n"), F.col("k"), rule.percent)).alias("band")))
    mixed = cut(posted.groupBy("w", "band").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("units"), F.min("c").alias("hub")).where("x <> y").drop("x", "y"))
    posted = dealt_join(posted, mixed, ["w", "band"], hot_keys(mixed, ["w", "band"], "units"), F.xxhash64("unit")).withColumn("main", F.col("c") == F.col("hub"))
    posted = cut(posted)
    return _pairs(posted.where(F.col("units") <= CROWDED), rule.percent).unionByName(_blocks(posted.where(F.col("units") > CROWDED), near, rule.percent))


def _scale(codes: np.ndarray, often: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The scale of each window, 0 for those that are not in often (sorted)."""
    if not len(often):
        return np.zeros(len(codes), np.int8)
    at = np.minimum(np.searchsorted(often, codes), len(often) - 1)
    return np.where(often[at] == codes, scale[at], np.int8(0))


def _often(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted windows that CROWDED units or more have, and for each the binary logarithm of how many have it; if there are
    over MAX_OFTEN, only the most frequent of them."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("codes"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.as_buffer(), np.int64))], ["code"])

    counts = cut(map_arrow(codes.select("codes"), run, "code long").groupBy("code").agg(F.count("*").alias("k")).where(F.col("k") >= CROWDED))
    scale = sorted(((r["s"], r["n"]) for r in counts.groupBy(F.floor(F.log2("k")).alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, 64
    for s, n in scale:
        if (total := total + n) > MAX_OFTEN:
            break
        least = s
    found = counts.select("code", F.floor(F.log2("k")).cast("tinyint").alias("s")).where(F.col("s") >= least).toArrow()
    often, level = found.column("code").to_numpy().view(np.uint64), found.column("s").to_numpy()
    order = np.argsort(often)
    return often[order], level[order]


def _blocks(under: DataFrame, near: DataFrame, percent: int, anew: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) that can link of the units under crowded postings (w, band, unit, n, c). Near copies share many of these,
    so units that postings join are one crowd, in which each pair is tested once for a size band. The largest component in
    a crowd is not paired with itself: units beside it and all units are cut to blocks each, and a task has one of either. That
    is linear in a crowd with few units beside its largest component; what is said of the units (unit, n, c) of other crowds is up to anew."""
    under = cut(under.select("w", "band", "unit", "n", "c"))
    if under.isEmpty():
        return under.select(F.col("unit").alias("a"), F.col("unit").alias("b"))
    hubs = cut(under.groupBy("w", "band").agg(F.min("unit").alias("hub"), F.count("*").alias("k")))
    met = dealt_join(under, hubs.drop("k"), ["w", "band"], hot_keys(hubs, ["w", "band"], "k"), F.xxhash64("unit"))
    crowds = components(met.select(F.col("unit").alias("a"), F.col("hub").alias("b")).where("a <> b"))
    units = under.select("unit", "n", "c").distinct().join(crowds, F.col("unit") == F.col("node"))
    band = F.floor(F.log(F.col("n")) / -math.log(percent / 100 - 1e-9)).cast("int")
    units = cut(units.select("unit", "n", "c", F.explode(F.array(band, band + 1)).alias("size"), F.col("root").alias("crowd")))
    sizes = units.groupBy("crowd", "size", "c").agg(F.count("*").alias("k")).groupBy("crowd", "size").agg(F.max_by("c", "k").alias("most"), (F.sum("k") - F.max("k")).alias("rest"), F.sum("k").alias("k"))
    sizes = cut(sizes.where("rest > 0"))
    units = dealt_join(units, sizes, ["crowd", "size"], hot_keys(sizes, ["crowd", "size"], "k"), F.xxhash64("unit"))
    found = None
    if anew is not None and not (wide := cut(units.where(F.col("rest") > BLOCK).select("unit", "n", "c").distinct())).isEmpty():
        found, units = anew(wide), units.where(F.col("rest") <= BLOCK)
    units = units.withColumns({"is": F.ceil(F.col("rest") / BLOCK), "js": F.ceil(F.col("k") / BLOCK), "main": F.col("c") == F.col("most")})
    units = cut(units.select("unit", "n", "c", "size", "crowd", "is", "js", "main").join(near.select("unit", "bits"), "unit"))
    block = lambda count: F.pmod(F.xxhash64("unit"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    keys = ["crowd", "size", "i", "j"]
    x = units.where("not main").withColumn("i", block("is")).withColumn("j", every("js")).groupBy(keys)
    y = units.withColumn("j", block("js")).withColumn("i", every("is")).groupBy(keys)
    met = x.cogroup(y).applyInArrow(_tester(percent), "a binary, b binary").distinct()
    return met if found is None else met.unionByName(found)


def _tester(percent: int):
    """For two blocks: pairs of their units, of different components, that can link by sizes and bitmaps."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[bytes, bytes]] = []
        if left.num_rows and right.num_rows:
            units = [t.column("unit").to_pylist() for t in (left, right)]
            order = np.unique(np.array(units[0] + units[1], dtype="S16"), return_inverse=True)[1]
            o_x, o_y = order[: left.num_rows], order[left.num_rows :]
            (n_x, c_x, b_x), (n_y, c_y, b_y) = ((t.column("n").to_numpy(), t.column("c").to_numpy(), t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP)) for t in (left, right))
            main = np.array(right.column("main").to_pylist(), bool)
            for at in range(0, left.num_rows, 256):
                part = slice(at, at + 256)
                differ = np.zeros((len(n_x[part]), len(n_y)), np.int64)
                for w in range(BITMAP):
                    differ += np.bitwise_count(b_x[part, None, w] ^ b_y[None, :, w])
                n, least = n_x[part, None] + n_y[None, :], np.minimum(n_x[part, None], n_y[None, :])
                both = np.minimum((n - differ) // 2, least)
                ok = (c_x[part, None] != c_y[None, :]) & (main[None, :] | (o_x[part, None] < o_y[None, :])) & (least * 100 >= (n - least) * percent) & (both * 100 >= (n - both) * percent)
                for i, j in zip(*(z.tolist() for z in np.nonzero(ok)), strict=True):
                    p, q = units[0][at + i], units[1][j]
                    found.append((max(p, q), min(p, q)))
        return pa.table({"a": pa.array([p for p, _ in found], pa.binary()), "b": pa.array([q for _, q in found], pa.binary())})

    return of


def _with(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Links together with those that stand for the components found so far."""
    return links if roots is None else links.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def _result(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows whose set is another row's too, or has a link, get the smallest doc_id of the component; others their own."""
    own = rows.where("n > 0").groupBy("unit").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    if roots is None:
        own = own.withColumn("root", F.lit(None).cast("binary"))
    else:
        own = own.join(roots, F.col("unit") == F.col("node"), "left")
    own = cut(own.where("rows > 1 or root is not null").select("unit", "least", "rows", F.coalesce("root", "unit").alias("root")))
    components = cut(own.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("c")))
    named = cut(dealt_join(own, components.drop("c"), ["root"], hot_keys(components, ["root"], "c"), F.xxhash64("unit")).select("unit", "component", "rows"))
    out = dealt_join(rows.select("doc_id", "n", "unit"), named.drop("rows"), ["unit"], hot_keys(named, ["unit"], "rows"), F.xxhash64("doc_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which each component keeps the document with the smallest doc_id.

    Rows that share a doc_id are one document, which goes if none of its rows stays, and otherwise keeps its first row
    in the order of its text. Rows without doc_id stay.
    """
    found = cut(join(docs, k, percent)).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("rows"))
    gone, again = cut(ids.where("not stays").select("doc_id")), cut(ids.where("stays and rows > 1").select("doc_id"))
    single = restrict(docs, gone.union(again) if not again.isEmpty() else gone, "doc_id", without=True)
    if again.isEmpty():
        return single
    first = restrict(docs, again, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))).alias("r"))
    return single.unionByName(first.select("doc_id", "r.*").select(*docs.columns))
