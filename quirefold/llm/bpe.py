"""Byte-pair encoding and decoding with the ranks of a public vocabulary file.

A text is cut into words by the vocabulary's pattern. A word's parts start as single bytes; a contiguous array holds the rank of
each adjacent pair. Again and again the smallest rank is found (the leftmost of equals), its boundary is deleted, and the
ranks on either side are looked up anew. All distinct new words of a batch do this side by side as rows of one array; a word of
more than SHORT bytes keeps its ranks in a heap instead. Words that were seen before are taken from a table, which is emptied
when it holds CACHE words. Decoding concatenates the bytes of the tokens.

Defined results: a null text has null tokens and decodes to null; an empty text has none; ids that the vocabulary lacks decode
to nothing, bytes that aren't UTF-8 to the replacement character; repeated rows give equal rows; a null doc_id keeps its row;
an empty table gives an empty result. Only doc_id and text (or tokens) are read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quirefold.llm import textkernel as K
from quirefold.llm.common import give_back, map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, CACHE = 64, 200_000
NONE = np.int32(2**31 - 1)


class _Words(dict):
    """Word -> row; a new word gets the next row."""

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Codec:
    def __init__(self, lines: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.find = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        table: list[bytes] = [b""] * size
        for t, i in self.ranks.items():
            table[i] = t
        self.tokens = pa.array([*table, b""], pa.large_binary())
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = sorted((self.ranks[t[:k]] << 32 | self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        # an open-addressing table: pairs are looked up by the million
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        mask = (1 << self.bits) - 1
        for key, i in pairs:
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.values[at] = key, i
        self.clear()

    def clear(self) -> None:
        self.words = _Words()
        self.words.new = []
        self.flat, self.start, self.count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.size = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, NONE where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        at, out = self._slot(key), np.full(key.shape, NONE, np.int32)
        rows, mask = np.arange(len(key)), (1 << self.bits) - 1
        while len(rows):
            found = self.keys[at]
            hit = found == key
            out[rows[hit]] = self.values[at[hit]]
            go = ~hit & (found >= 0)
            rows, key, at = rows[go], key[go], (at[go] + 1) & mask
        return out

    def merge_rows(self, parts: np.ndarray, n: np.ndarray) -> None:
        """In place: parts has a word's tokens in each row, n their number. Rows that still merge lose a column with each step."""
        rows, width = np.arange(len(parts)), parts.shape[1]
        ids = parts.copy()
        ranks = np.full((len(parts), width), NONE, np.int32)
        for j in range(width - 1):
            own = np.flatnonzero(n > j + 1)
            ranks[own, j] = self.rank(ids[own, j], ids[own, j + 1])
        while len(rows):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            on = least < NONE
            if not on.all():
                done = rows[~on]
                parts[done, : ids.shape[1]] = ids[~on]
                rows, ids, ranks, at, least = rows[on], ids[on], ranks[on], at[on], least[on]
                if not len(rows):
                    break
            n[rows] -= 1
            k = np.arange(len(rows))
            ids[k, at] = least
            stay = np.arange(ids.shape[1])[None] != at[:, None] + 1
            ids, ranks = (x[stay].reshape(len(rows), -1) for x in (ids, ranks))
            size = n[rows]
            right = np.flatnonzero(at + 1 < size)
            ranks[k, at] = NONE
            ranks[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word, with a heap of ranks and links between parts."""
        ids = [int(self.byte[b]) for b in word]
        n = len(ids)
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        text = [bytes([b]) for b in word]
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := self.ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and nxt[i] == j) or self.ranks.get(text[i] + text[j]) != r:
                continue
            text[i], ids[i], alive[j] = text[i] + text[j], r, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (q := self.ranks.get(text[i] + text[nxt[i]])) is not None:
                    heapq.heappush(heap, (q, i, nxt[i]))
            if prev[i] >= 0 and (q := self.ranks.get(text[prev[i]] + text[i])) is not None:
                heapq.heappush(heap, (q, prev[i], i))
        return [ids[i] for i in range(n) if alive[i]]

    def learn(self) -> None:
        """Encodes the words that are new."""
        new, self.words.new = [w.encode() for w in self.words.new], []
        if not new:
            return
        size = np.array([len(w) for w in new])
        flat, count = [np.zeros(0, np.int32)], np.zeros(len(new), np.int64)
        start, lower, at = np.zeros(len(new), np.int64), 0, self.size
        for upper in (4, 8, 12, 16, 24, 32, SHORT):
            own = np.flatnonzero((size > lower) & (size <= upper))
            lower = upper
            for a in range(0, len(own), 10_000):
                some = own[a : a + 10_000]
                raw = np.frombuffer(b"".join(new[i].ljust(upper, b"\0") for i in some), np.uint8).reshape(len(some), upper)
                parts, n = self.byte[raw], size[some].copy()
                self.merge_rows(parts, n)
                flat.append(parts[np.arange(upper)[None] < n[:, None]])
                count[some], start[some] = n, at + np.cumsum(n) - n
                at += int(n.sum())
        for i in np.flatnonzero(size > SHORT):
            flat.append(np.array(self.merge_long(new[i]), np.int32))
            count[i], start[i] = len(flat[-1]), at
            at += len(flat[-1])
        self.flat += flat
        self.start.append(start)
        self.count.append(count)
        self.size = at

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words, known by then, and where each text's end."""
        if len(self.words) > CACHE:
            self.clear()
        row, find, rows, ends = self.words.__getitem__, self.find, [], []
        for t in texts:
            rows.extend(map(row, find(t)))
            ends.append(len(rows))
        self.learn()
        self.flat, self.start, self.count = [np.concatenate(self.flat)], [np.concatenate(self.start)], [np.concatenate(self.count)]
        return np.array(rows, np.int64), np.array(ends, np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many tokens each text has."""
        at, ends = self._rows(texts)
        stop = np.concatenate([[0], np.cumsum(self.count[0][at])])
        return np.diff(stop[ends], prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens and the offsets of the texts."""
        at, ends = self._rows(texts)
        n = self.count[0][at]
        stop = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(self.start[0][at] - stop[:-1], n) + np.arange(stop[-1])
        return self.flat[0][where], stop[np.concatenate([[0], ends])]

    def decode(self, tokens: np.ndarray) -> bytes:
        known = np.where((tokens >= 0) & (tokens < len(self.lengths)), tokens, len(self.lengths))
        data = self.tokens.take(pa.array(known))
        return data.buffers()[2].to_pybytes()[: int(np.append(self.lengths, 0)[known].sum())] if len(known) else b""


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, lines: bytes, pattern: str) -> Codec:
    """One for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(lines, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, tokens, and exact: whether the tokens decode to the text."""
    shipped = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())  # noqa: SIM115

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, shipped.value, pattern)
        for batch in batches:
            for a, z in K.slices(batch.column(1), 2 << 20):
                col = batch.column(1).slice(a, z - a)
                null = pc.is_null(col).to_numpy(zero_copy_only=False)
                tokens, off = c.encode(pc.fill_null(col, "").to_pylist())
                raw, ends = K.buffers(col)
                bytes_at = np.concatenate([[0], np.cumsum(c.lengths[tokens])])[off]
                back = np.frombuffer(c.decode(tokens), np.uint8)
                if len(back) == len(raw):
                    wrong = np.concatenate([[0], np.cumsum(back != raw)])
                    exact = (bytes_at == ends)[1:] & (wrong[ends[1:]] == wrong[ends[:-1]])
                else:
                    exact = np.array([back[p:q].tobytes() == raw[s:e].tobytes() for p, q, s, e in zip(bytes_at, bytes_at[1:], ends, ends[1:], strict=False)], bool)
                offsets = pa.array(off.astype(np.int32), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(tokens)), pa.array(exact, mask=null)], ["doc_id", "tokens", "exact"])
        c.clear()  # the worker lives on and may have other things to do
        give_back()

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, tokens array<int>, exact boolean")


def counts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, tokens: how many tokens encode gives; null for a null text."""
    shipped = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())  # noqa: SIM115

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, shipped.value, pattern)
        for b in batches:
            parts = [c.counts(pc.fill_null(b.column(1).slice(a, z - a), "").to_pylist()) for a, z in K.slices(b.column(1))]
            null = pc.is_null(b.column(1)).to_numpy(zero_copy_only=False)
            n = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, mask=null)], ["doc_id", "tokens"])
        c.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, tokens long")


def decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(open(path, "rb").read())  # noqa: SIM115

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, shipped.value, pattern)
        out = [None if x is None else c.decode(np.array([-1 if t is None else t for t in x], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "tokens"), each, "doc_id long, text string")
