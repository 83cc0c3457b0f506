"""License scans: ordered signature rules over a text's words.

A rule is a regular expression over the words joined by single spaces, a gate of words without which it cannot match, a
label, a priority and a confidence; the rules are hand-written, see ``license_rules``. Gates are looked up first, for all
words of a slice at once; a rule's expression runs only on texts that hold the words of its gate. Of overlapping
detections those go whose words lie within the words of one accepted before; acceptance is by priority, then length,
then position.

Defined results: null and empty texts have no words, no places, empty labels and score 0; very long texts are scanned
whole; repeated rows are scanned each; other columns of the input are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensegauge.llm.kernels import ALNUM_LOWER, Words, bit_table, map_slices, member, text_bytes
from sensegauge.llm.license_rules import Rule, rules

#: Phrase and label of the base detections.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

def _codes(words: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array([" ".join(words)]))
    return Words(data, offsets, ALNUM_LOWER).codes


def scan_words(text: str, found: set[str], ordered: list[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, Rule]]:
    """Detections (first word, word after the last, rule) that stand. text: words between single spaces, one at each end."""
    spans = []
    for rule, rx in ordered:
        if not any(found.isdisjoint(one) for one in rule.gate):
            at = 0
            while m := rx.search(text, at):
                spans.append((m.start(), m.end() - 1, rule))
                at = m.end() - 1
    spans.sort(key=lambda s: (-s[2].priority, s[0] - s[1], s[0]))
    kept, reach = [], np.zeros(len(text) if spans else 0, np.int64)  # how far the accepted spans over a place go
    for s in spans:
        if reach[s[0]] < s[1]:
            kept.append(s)
            np.maximum(reach[s[0] : s[1]], s[1], out=reach[s[0] : s[1]])
    return [(text.count(" ", 0, a), text.count(" ", 0, b), r) for a, b, r in sorted(kept, key=lambda s: (s[0], s[1], s[2].label))]


def scanner():
    ordered = [(r, re.compile(r.pattern)) for r in rules()]
    keywords = sorted({w for r, _ in ordered for one in r.gate for w in one})
    codes = _codes(keywords)
    by_code = dict(zip(codes.tolist(), keywords, strict=True))
    table = np.sort(codes)
    bits = bit_table(table)
    base = [(_codes(phrase.split()), label) for phrase, label in BASE]

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(part.column("text"))
        words = Words(data, offsets, ALNUM_LOWER)
        n, rows = len(offsets) - 1, words.rows()
        n_base, first, last = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
        base_labels: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in base:
            k = len(phrase)
            if len(words.codes) >= k:
                at = np.flatnonzero(words.codes[: len(words.codes) - k + 1] == phrase[0])
                for j in range(1, k):
                    at = at[words.codes[at + j] == phrase[j]]
                at = at[rows[at] == rows[at + k - 1]]
                own = rows[at]
                np.add.at(n_base, own, 1)
                np.minimum.at(first, own, at - words.ptr[own])
                np.maximum.at(last, own, at - words.ptr[own])
                for r in np.unique(own).tolist():
                    base_labels[r].add(label)
        gates: dict[int, set[str]] = {}
        for at in member(words.codes, table, bits).tolist():
            gates.setdefault(int(rows[at]), set()).add(by_code[int(words.codes[at])])
        labels, scores, spans = [set(x) for x in base_labels], np.where(n_base > 0, 0.5, 0.0), [""] * n
        for r, found in gates.items():
            a, b = int(offsets[r]), int(offsets[r + 1])
            raw = bytes(data[a:b])
            text = b" ".join([b"", *(raw[s - a : e - a] for s, e in zip(words.starts[words.ptr[r] : words.ptr[r + 1]].tolist(), words.ends[words.ptr[r] : words.ptr[r + 1]].tolist(), strict=True)), b""])
            got = scan_words(text.lower().decode("utf-8", "replace"), found, ordered)
            labels[r] |= {rule.label for _, _, rule in got}
            scores[r] = max([scores[r], *(rule.confidence for _, _, rule in got)])
            spans[r] = ",".join(f"{rule.label}:{s}:{e}" for s, e, rule in got)
        none = n_base == 0
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(words.counts()), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in base_labels]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(scores), pa.array(spans)],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )

    return of


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label:first word:end word)."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return map_slices(docs.select("doc_id", "text"), scanner, schema)
