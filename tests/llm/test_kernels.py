"""Word kernels, line hashes and n-gram sets against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sensegauge.llm import kernels
from sensegauge.llm.kernels import ALNUM_LOWER, TEXT, Words, slices, text_bytes


def texts(seed: int, n: int = 200) -> list:
    random.seed(seed)
    return ["".join(random.choice(["a", "B", "é", "Ñ", " ", "\n", ".", "1", "x yz", "漢"]) for _ in range(random.choice([0, 1, 5, 60, 400]))) for _ in range(n)] + [None, "", "x" * 300, "é" * 200]


@pytest.mark.parametrize("block", [1 << 17, 37, 5])
@pytest.mark.parametrize("kind, rx, lower", [(TEXT, rb"[^\x20\x09-\x0D]+", False), (ALNUM_LOWER, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)])
def test_words_are_those_of_the_expression(monkeypatch, block, kind, rx, lower):
    monkeypatch.setattr(kernels, "BLOCK", block)
    rows = texts(block)
    data, offsets = text_bytes(pa.array(rows))
    w = Words(data, offsets, kind)
    fold = (lambda x: x.lower()) if lower else (lambda x: x)
    expected = [re.findall(rx, fold((t or "").encode())) for t in rows]
    got = [[fold(bytes(data[s:e])) for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.ptr, w.ptr[1:])]
    assert got == expected
    codes: dict = {}
    for word, code in zip((x for r in got for x in r), w.codes.tolist(), strict=True):
        assert codes.setdefault(word, code) == code
    assert len(set(codes.values())) == len(codes)


def test_windows_stay_in_rows():
    data, offsets = text_bytes(pa.array(["a b c", "b c", "a b c d", ""]))
    codes, whole = kernels.windows(Words(data, offsets, TEXT), 3)
    assert whole.tolist() == [True, False, False, False, False, True, True, False, False]
    assert codes[0] == codes[5] != codes[6]


def test_slices_keep_all_rows(monkeypatch):
    monkeypatch.setattr(kernels, "SLICE_BYTES", 50)
    rows = texts(9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["i", "text"])
    parts = list(slices(batch))
    assert len(parts) > 5 and [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(rows)))
    data, offsets = text_bytes(parts[3].column("text"))
    assert [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == [t or "" for t in parts[3].column("text").to_pylist()]


def test_member():
    table = np.sort(kernels.mix(np.arange(50, dtype=np.uint64)))
    codes = kernels.mix(np.arange(30, 80, dtype=np.uint64))
    assert kernels.member(codes, table, kernels.bit_table(table)).tolist() == list(range(20))
    assert not len(kernels.member(codes, table[:0], kernels.bit_table(table[:0])))
