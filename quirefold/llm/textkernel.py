"""Vectorised text scanning on Arrow buffers: words, their hashes and byte classes, without a Python loop over words.

Texts of a batch are one array of UTF-8 bytes with offsets. A hash of any byte range comes from prefix sums of
byte * R^position modulo 2^64, so hashing every word, or every prefix of every word, is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

R = np.uint64(0x9E3779B97F4A7C15 | 1)
R_INV = np.uint64(pow(int(R), -1, 1 << 64))
SLICE_BYTES = 1 << 20
SMALL_SLICE_BYTES = 1 << 18  # where a byte takes a hundred bytes of scratch or more
_POW = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i for i in [0, n)."""
    if len(_POW["p"]) < n:
        for k, base in (("p", R), ("i", R_INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    p, i = _POW["p"][:n], _POW["i"][:n]
    if n > 8 * SLICE_BYTES:  # one very long text isn't worth keeping its powers
        _POW["p"], _POW["i"] = _POW["p"][:1].copy(), _POW["i"][:1].copy()
    return p, i


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that all bits of a hash depend on all bits of its input."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, so that scratch arrays stay small; a longer text is alone."""
    if not len(col):
        return
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        yield at, (at := max(at + 1, upto))


def classes(chars: str, high: bool) -> np.ndarray:
    """A table of 256: True for these ASCII characters and, with high, for all bytes of other characters."""
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    out[128:] = high
    return out


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = classes(LETTERS + "0123456789", True)
NONSPACE = ~classes(" \t\n\r\x0b\x0c", False)


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def hashes(self) -> np.ndarray:
        return mix((self.sums[self.ends] - self.sums[self.starts]) * self.inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def prefixes(self, k: int) -> np.ndarray:
        """Hash of the first k bytes, 0 for shorter words."""
        e = np.minimum(self.starts + k, self.ends)
        h = mix((self.sums[e] - self.sums[self.starts]) * self.inverse[self.starts] + np.uint64(k))
        h[self.ends - self.starts < k] = 0
        return h


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of the maximal runs of True; none goes over the end of a text."""
    n = len(inside)
    if not n:
        return (z := np.zeros(0, np.int64)), z, z
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None, values: np.ndarray | None = None) -> Words:
    """The words of all texts. values: what is hashed in place of the bytes."""
    starts, ends, doc = runs(WORD[data] if inside is None else inside, offsets)
    p, i = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((data if values is None else values).astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return Words(starts, ends, doc, sums, i)


def hash_word(text: str, prefix: bool = False) -> int:
    """The hash that Words.hashes, or prefixes, has for this text."""
    data = np.frombuffer(text.encode(), np.uint8)
    p, _ = powers(len(data) + 1)
    s = ((data.astype(np.uint64) + np.uint64(1)) * p[:-1]).sum(dtype=np.uint64)
    return int(mix(np.array([s + np.uint64(len(data))], np.uint64))[0])


def member(values: np.ndarray, found_in: np.ndarray) -> np.ndarray:
    """Which values are in a small sorted array."""
    if not len(found_in) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(found_in, values)
    at[at == len(found_in)] = 0
    return found_in[at] == values


def total(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum over each text."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]
