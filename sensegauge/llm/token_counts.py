"""Edit-aware token counts from segment trees.

A text is cut into segments of about ``SEGMENT`` characters where pre-tokens are bound to end: before a single space
between two characters that are not white space, and between letters, digits and signs. That needs three characters only,
so cuts outside an edit stay valid. A stretch of one kind, such as 10,000 letters, is one pre-token and one segment.
A tree over the segments holds sums of characters and tokens. An edit re-encodes the segments that it touches, together
with the segment beside it where the cut between them is no longer one, and updates the sums above them; everything
else keeps its count. Counts equal those of encoding the whole text anew.

The tree is kept with the document: ``tree`` holds the segments' characters and tokens. ``build`` makes trees,
``edit`` applies edits to documents with trees and returns new texts, trees and counts.

Defined results: null and empty texts have no segments and no tokens, and may be edited; very long texts are counted and
edited whole; a null list of edits is empty; edits of equal ``seq`` follow in the order of start, stop and replacement;
start and stop of an edit are put in order and into the text (code points of the text as it is then); a null replacement
is empty; repeated rows are counted each; other columns are kept by ``build``, but a column named tree is replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensegauge.llm.kernels import map_arrow, slices, with_field

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEGMENT = 128


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


#: Where a pre-token is bound to end, whatever stands around: before a single space; between letter, digit and sign, but
#: after an apostrophe, which may begin a pre-token such as 's. Characters of other kinds are left alone.
CUT = regex.compile(r"(?<=\S) (?=\S)|(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])|(?<=[\p{P}\p{S}])(?=\p{N})|(?<=[\p{P}\p{S}--'])(?=\p{L})", regex.V1)


def is_cut(before: str, text: str) -> bool:
    """Whether a pre-token is bound to end before text, where the character before it is given."""
    return CUT.match(before + text[:2], 1) is not None


def segments(text: str, size: int = SEGMENT) -> list[str]:
    out, at, n = [], 0, len(text)
    while at < n:
        found = CUT.search(text, at + size) if at + size < n else None
        cut = found.start() if found else n
        out.append(text[at:cut])
        at = cut
    return out


class Tree:
    """Sums over segments in a heap: node i has the children 2i and 2i + 1, leaves begin at ``base``."""

    def __init__(self, texts: list[str], tokens: list[int], count) -> None:
        self.count, self.encoded = count, 0
        self._build(texts, tokens)

    def _build(self, texts: list[str], tokens: list[int]) -> None:
        self.base = 1 << max(0, (max(1, len(texts)) - 1).bit_length())
        self.texts = texts + [""] * (self.base - len(texts))
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (t, n) in enumerate(zip(texts, tokens, strict=True)):
            self.chars[self.base + i], self.tokens[self.base + i] = len(t), n
        for i in range(self.base - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds the character at ``at`` (the last one with text, if at is the end), and where the leaf begins."""
        at = min(at, self.chars[1] - 1) if self.chars[1] else 0
        node, begin = 1, 0
        while node < self.base:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.base, begin

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = self.base + leaf
        self.chars[node], self.tokens[node] = len(text), tokens
        while node := node // 2:
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, stop: int, text: str) -> None:
        start, stop = sorted((min(max(0, start), self.chars[1]), min(max(0, stop), self.chars[1])))
        lo, begin = self.find(start)
        hi, _ = self.find(max(start, stop - 1))
        region = "".join(self.texts[lo : hi + 1])
        region = region[: start - begin] + text + region[stop - begin :]
        while (left := self.left(lo)) is not None and not is_cut(self.texts[left][-1], region):
            lo = left
            region = self.texts[lo] + region
        while (right := self.right(hi)) is not None and not (region and is_cut(region[-1], self.texts[right])):
            hi = right
            region += self.texts[hi]
        n = self.count(region)
        self.encoded += len(region)
        for leaf in range(lo + 1, hi + 1):
            if self.texts[leaf]:
                self._set(leaf, "", 0)
        self._set(lo, region, n)
        if len(region) > 8 * SEGMENT:  # keep later edits of this place short
            keep = [(t, self.tokens[self.base + i]) for i, t in enumerate(self.texts) if t and i != lo]
            at = sum(1 for t in self.texts[:lo] if t)
            new = segments(region)
            self.encoded += len(region)
            parts = keep[:at] + [(t, self.count(t)) for t in new] + keep[at:]
            self._build([t for t, _ in parts], [c for _, c in parts])

    def left(self, leaf: int) -> int | None:
        return next((i for i in range(leaf - 1, -1, -1) if self.texts[i]), None)

    def right(self, leaf: int) -> int | None:
        return next((i for i in range(leaf + 1, self.base) if self.texts[i]), None)

    def leaves(self) -> list[tuple[str, int]]:
        return [(t, self.tokens[self.base + i]) for i, t in enumerate(self.texts) if t]


_ENCODINGS: dict = {}


def counter(sent):
    """The function that counts a text's tokens; built once in each Python worker."""
    import tiktoken

    ranks = sent.value
    if _ENCODINGS.get("ranks") is not ranks:
        _ENCODINGS.update(ranks=ranks, encoding=tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    encode = _ENCODINGS["encoding"].encode_ordinary
    return lambda text: len(encode(text))


_TREE = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
TREE = "array<struct<chars: int, tokens: int>>"


def ship(spark, ranks: dict[bytes, int]):
    """The vocabulary, of some megabytes whatever the input, for ``build`` and ``edit``."""
    return spark.sparkContext.broadcast(ranks)


def _trees(parts: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [x for p in parts for x in p]
    offsets = [0]
    for p in parts:
        offsets.append(offsets[-1] + len(p))
    values = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32())], ["chars", "tokens"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def build(docs: DataFrame, sent) -> DataFrame:
    """docs with ``tree``; docs: doc_id, text, and others that are kept."""
    docs = docs.drop("tree")

    def run(batches):
        count = counter(sent)
        for batch in (part for b in batches for part in slices(b)):
            parts = [[(len(s), count(s)) for s in segments(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _trees(parts)], [*batch.schema.names, "tree"])

    return map_arrow(docs, run, with_field(docs.schema, f"tree {TREE}"))


def edit(docs: DataFrame, sent) -> DataFrame:
    """doc_id, n_before, n_tokens, n_chars, n_edits, encoded (characters that were encoded anew), text, tree of docs after
    their ``edits``, an array of (start, stop, replacement), in order. docs: doc_id, text, tree, edits."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_before", "n_tokens", "n_chars", "n_edits", "encoded", "text", "tree"]

    def run(batches):
        count = counter(sent)
        for batch in (part for b in batches for part in slices(b)):
            out: list[list] = [[] for _ in names[1:]]
            for text, tree, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "tree", "edits")), strict=True):
                at, parts = 0, []
                for leaf in tree or []:
                    parts.append((text or "")[at : at + leaf["chars"]])
                    at += leaf["chars"]
                own = Tree(parts, [leaf["tokens"] for leaf in tree or []], count)
                before = own.tokens[1]
                for e in edits or []:
                    own.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                leaves = own.leaves()
                for o, x in zip(out, (before, own.tokens[1], own.chars[1], len(edits or []), own.encoded, "".join(t for t, _ in leaves), [(len(t), n) for t, n in leaves]), strict=True):
                    o.append(x)
            columns = [pa.array(o, pa.int64()) for o in out[:5]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(out[5], pa.string()), _trees(out[6])], names)

    schema = f"doc_id {kind}, n_before long, n_tokens long, n_chars long, n_edits long, encoded long, text string, tree {TREE}"
    return map_arrow(docs.select("doc_id", "text", "tree", "edits"), run, schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the edits of a table (doc_id, seq, start, stop, replacement), by seq. A document's edits follow one
    another, so they are applied by one task, as an array in its row."""
    own = edits.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("edits"))
    return docs.join(own, "doc_id", "left")
