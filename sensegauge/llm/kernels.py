"""Vectorised word kernels over the UTF-8 bytes of Arrow string columns.

Every word class used by the operators is decided by ASCII bytes alone, so words can be found and hashed on the raw
bytes without decoding. Work is done in blocks of about ``BLOCK`` bytes, so memory does not follow the length of a text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sensegauge.workers import reach

SLICE_BYTES = 1 << 20
BLOCK = 1 << 17
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class ByteClass:
    """Which bytes belong to words, and the code of each byte in a word's hash."""

    def __init__(self, delimiters: Sequence[int], lower: bool = False) -> None:
        self.inside = np.ones(256, bool)
        self.inside[list(delimiters)] = False
        self.code = mix(np.arange(1, 257, dtype=_U) * _BASE)
        if lower:
            self.code[65:91] = self.code[97:123]


SPACES = [0x20, *range(0x09, 0x0E)]
#: Words are what stands between white space.
TEXT = ByteClass(SPACES)
TEXT_LOWER = ByteClass(SPACES, lower=True)
#: Words are letters, digits and all that is not ASCII; A-Z count as a-z.
ALNUM_LOWER = ByteClass([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)
LINES = ByteClass([0x0A])


class _Powers:
    """Powers of the hash's base and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, BLOCK + 4096)
            inverse = pow(int(_BASE), -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, _U), np.cumprod(np.full(self.n, b, _U), dtype=_U)]) for b in (_BASE, _U(inverse)))
        return self.up, self.down


_POWERS = _Powers()


class Words:
    """Words of the rows of a slice: byte ranges, hashes, and for each row the range of its words."""

    __slots__ = ("starts", "ends", "codes", "ptr", "prefixes")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: ByteClass, prefixes: Sequence[int] = ()) -> None:
        n, found = len(data), []
        breaks = np.zeros(n + 1, bool)
        breaks[offsets] = True
        at = 0
        while at < n:
            end = min(at + BLOCK, n)
            inside = kind.inside[data[at:end]]
            if end < n and inside[-1] and not breaks[end]:
                cut = np.flatnonzero(~inside)
                if len(cut):
                    end = at + int(cut[-1]) + 1
                else:
                    while end < n and kind.inside[data[end]] and not breaks[end]:
                        end += min(BLOCK, n - end)
                        stop = np.flatnonzero(~kind.inside[data[at:end]] | breaks[at:end] & (np.arange(at, end) > at))
                        if len(stop):
                            end = at + int(stop[0])
                            break
                inside = kind.inside[data[at:end]]
            found.append(self._block(data[at:end], inside, breaks[at : end + 1], kind, at, prefixes))
            at = end
        self.starts, self.ends, self.codes = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, _U)))
        self.prefixes = [np.concatenate([f[3][i] for f in found]) if found else np.zeros(0, _U) for i in range(len(prefixes))]
        self.ptr = np.searchsorted(self.starts, offsets)

    @staticmethod
    def _block(data, inside, breaks, kind, at, prefixes):
        n = len(data)
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, inside
        after = np.append(inside, False)
        starts = np.flatnonzero(after & (~before | breaks))
        ends = np.flatnonzero(before & (~after | breaks))
        up, down = _POWERS.upto(n + 1)
        total = np.empty(n + 1, _U)
        total[0] = 0
        np.cumsum(kind.code[data] * up[:n], out=total[1:])
        sizes = ends - starts
        base = total[starts]
        codes = mix((total[ends] - base) * down[starts] + sizes.astype(_U))
        early = [np.where(sizes > k, mix((total[np.minimum(starts + k, n)] - base) * down[starts] + _U(1 << 32 | k)), _U(0)) for k in prefixes]
        return starts + at, ends + at, codes, early

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())


_STEPS = mix(np.arange(1001, 1001 + 64, dtype=_U) * _BASE) | _U(1)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether these k words stand in one row."""
    n = len(words.codes)
    out, whole = np.zeros(n, _U), np.zeros(n, bool)
    if n >= k:
        for j in range(k):
            out[: n - k + 1] += words.codes[j : n - k + 1 + j] * _STEPS[j % 64] + _U(j // 64)
        last = np.repeat(words.ptr[1:], words.counts())
        whole = np.arange(n) + k <= last
    return mix(out), whole


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 0) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` (SLICE_BYTES) bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // (size or SLICE_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow; a Python worker that has ended a task gives its free memory back."""
    reach()

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return df.mapInArrow(tidied, schema)


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text") -> DataFrame:
    """``make()`` runs once in each task and gives the function for its slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch, column):
                yield each(part)

    return map_arrow(df, run, schema)


def member(codes: np.ndarray, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of codes that are in the sorted table; bits: of ``bit_table``."""
    maybe = np.flatnonzero(bits[(codes & _U(len(bits) - 1)).astype(np.int64)])
    if not len(maybe) or not len(table):
        return maybe[:0]
    at = np.minimum(np.searchsorted(table, codes[maybe]), len(table) - 1)
    return maybe[table[at] == codes[maybe]]


def bit_table(table: np.ndarray) -> np.ndarray:
    n = 1 << max(12, min(24, int(len(table) * 16).bit_length()))
    bits = np.zeros(n, bool)
    bits[(table & _U(n - 1)).astype(np.int64)] = True
    return bits


def with_field(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
