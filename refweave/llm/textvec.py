"""Vectorised text kernels: a batch of texts as one byte buffer, its words and their 64-bit hashes, without a Python loop over words.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 that is the same as runs of code points outside that set.
Hashes depend on nothing but the bytes: they are the same in every process, on every machine and at every batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Multipliers of word positions in an n-gram.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)
_BASE = 0x100000001B3 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of terms: all ASCII but letters and digits.
NOT_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 20), base, U64)
        steps[0] = 1
        held = _powers[name] = np.cumprod(steps, dtype=U64)
    return held[:n]


def forget() -> None:
    """Drops the tables of powers, which grow with the longest piece."""
    _powers.clear()


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets of the texts in them. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batch in order, in pieces of at most about ``max_bytes`` of text (one row at least), to bound what a step holds."""
    _, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a piece: ``start``, ``end`` (byte positions), ``of`` (n + 1 word offsets of the texts), ``hash`` when asked for."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, value: np.ndarray | None = BYTE_VALUE, space: np.ndarray = SPACE):
        self.raw, self.offsets = raw, offsets
        inside = ~space[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.inside = inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)
        self.hash = None
        if value is not None:
            self.sums = prefix_sums(raw, value)
            self.hash = span_hash(self.sums, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def characters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all code points in words: byte position, position after it, and how many more code points its word has."""
        at = np.flatnonzero(self.inside & ((self.raw & 0xC0) != 0x80))
        word = np.searchsorted(self.start, at, "right") - 1
        after = np.empty_like(at)
        after[:-1] = at[1:]
        ends = np.searchsorted(at, self.end) - 1
        after[ends] = self.end
        return at, after, ends[word] - np.arange(len(at))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows that lie in one text, and the index of each window's first word."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        total = h[: len(h) - n + 1] * _PLACE[0]
        for k in range(1, n):
            total = total + h[k : len(h) - n + 1 + k] * _PLACE[k]
        end = np.repeat(self.of[1:], self.counts)[: len(total)]
        at = np.flatnonzero(np.arange(len(total)) + n <= end)
        return mix(total[at]), at


def prefix_sums(raw: np.ndarray, value: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(value[raw] * _power("up", _BASE, len(raw)), out=sums[1:], dtype=U64)
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    down = _power("down", _BASE_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def sum_by(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs given by n + 1 offsets; an empty run gives 0."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[of[1:]] - sums[of[:-1]]
