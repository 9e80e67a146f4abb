"""Words of Arrow text columns as numpy arrays: positions and 64-bit hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 2 << 20  # bytes of text handled at once; one longer text is handled alone
_SLICE = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` reproducible odd 64-bit numbers."""
    return mix((np.arange(n, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE = stream(256, 11)
_FOLDED = np.arange(256)
_FOLDED[ord("A"):ord("Z") + 1] += 32

#: Separators of words: the six white-space bytes, or all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Words:
    """Words of consecutive texts; word ``i`` is ``data[start[i]:end[i]]``, text ``d`` has words ``first[d]:first[d+1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the bounds of the texts; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return (data[bounds[0]:bounds[-1]], bounds - bounds[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def find(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray = SPACE, fold: bool = True) -> Words:
    """All words between separators, with hashes that ignore the case of A-Z if ``fold``."""
    inside = ~sep[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    here = np.concatenate([[False], inside, [False]])
    start = np.flatnonzero(inside & (~here[:-2] | cut[:-1]))
    end = np.flatnonzero(inside & (~here[2:] | cut[1:])) + 1
    table = _BYTE[_FOLDED] if fold else _BYTE
    out = np.empty(len(start), _U)
    place = stream(int((end - start).max()) if len(start) else 1, 23)
    at = 0
    while at < len(start):  # slices of whole words bound the memory
        to = max(at + 1, int(np.searchsorted(end, start[at] + _SLICE)))
        lo, hi = start[at], end[to - 1]
        first, length = start[at:to] - lo, end[at:to] - start[at:to]
        used = inside[lo:hi]
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        value = table[data[lo:hi][used]] * place[np.arange(int(length.sum())) - np.repeat(begin, length)]
        out[at:to] = np.add.reduceat(value, begin)
        at = to
    return Words(start, end, np.searchsorted(start, bounds), mix(out + (end - start).astype(_U)))


def grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``size`` words, and whether the run stays within one text."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, bool)
    weight = stream(size, 37)
    total = sum(w.hash[k:k + n] * weight[k] for k in range(size))
    left = np.repeat(w.first[1:], w.count)[:n] - np.arange(n)
    return mix(total), left >= size


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about ``size`` bytes of text each, with bytes and bounds of their texts."""
    data, bounds = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
        at = to
    pa.default_memory_pool().release_unused()
