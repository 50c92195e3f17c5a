"""Words of whole texts as NumPy arrays, for the inside of Arrow tasks.

A batch of texts is one byte buffer.  Word bounds and 64-bit word hashes come from array passes over it, with no
per-word Python.  Work runs over pieces of bounded size, so a very long text costs its words, not many copies of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20     # texts worked on at a time
PIECE_BYTES = 1 << 18     # bytes hashed at a time
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))

SPACE = np.ones(256, bool)                        # [^\x20\x09-\x0D]+
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)                       # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a, b, seed: int = 0) -> np.ndarray:
    """A name for ordered pairs of 64-bit values."""
    return mix(mix(np.asarray(a, np.uint64) + np.uint64(seed * 2 + 1)) * np.uint64(3) + np.asarray(b, np.uint64))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> np.ndarray:
    """At least n powers of the multiplier modulo 2^64."""
    return _powers(n)[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the multiplier and of its inverse modulo 2^64."""
    size = max(1 << 16, 1 << max(0, n - 1).bit_length())
    if size not in _tables:
        if len(_tables) > 6:
            _tables.clear()
        _tables[size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m)]))
                              for m in (_MULT, _INV))
    return _tables[size]


@dataclass
class Words:
    """Words of some texts: ``first[d]:first[d + 1]`` are those of text ``d``."""

    data: np.ndarray     # bytes of all texts
    bounds: np.ndarray   # text d is data[bounds[d]:bounds[d + 1]]
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def strings(self, index: np.ndarray) -> list[bytes]:
        raw, s, e = self.data.tobytes(), self.start[index].tolist(), self.end[index].tolist()
        return [raw[a:b] for a, b in zip(s, e)]


def _buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and len(arr) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(data: np.ndarray, bounds: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``chars`` inside each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = chars[data]
    edge = np.zeros(len(data) + 1, bool)     # a text begins here
    edge[bounds] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are ordered and disjoint."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + PIECE_BYTES, "right")))
        lo, hi = int(start[a]), int(end[b - 1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[data[lo:hi]] * up[:hi - lo], out=total[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def words(texts, lower: bool = False, chars: np.ndarray = SPACE) -> Words:
    """Words of an Arrow string array; a null text has none."""
    data, bounds = _buffer(texts)
    if lower:
        data = _LOWER[data]
    start, end = spans(data, bounds, chars)
    return Words(data, bounds, start, end, hash_spans(data, start, end), np.searchsorted(start, bounds).astype(np.int64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; entry i covers i .. i + k - 1 (bounds of texts are the caller's)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = 1 << 18
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        up, down = _powers(hi - lo + k)
        total = np.zeros(hi - lo + k, np.uint64)
        np.cumsum(hashes[lo:hi + k - 1] * up[:hi - lo + k - 1], out=total[1:])
        out[lo:hi] = mix((total[k:k + hi - lo] - total[:hi - lo]) * down[:hi - lo])
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces holding about ``size`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = _buffer(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def numbers(values, dtype=np.int64) -> np.ndarray:
    """A column without nulls as an array."""
    return np.asarray(values.to_numpy(zero_copy_only=False), dtype)


def cut(flat: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Bytes of each text's part of a flat array."""
    raw, w = flat.tobytes(), flat.dtype.itemsize
    return [raw[a * w:b * w] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
