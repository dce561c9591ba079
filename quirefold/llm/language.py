"""Language identification by cross-parsing: the language whose training text covers a text in the fewest phrases wins.

For each language a suffix automaton of its training text accepts exactly the strings that occur there. A text is cut
greedily into longest matches; phrases * log2(training length) / length estimates the cross entropy. All texts of a batch
step through the transition tables of all languages at once (rows laid over each other, so that every letter of the training
texts has a code, in any script), in blocks of BLOCK characters that are parsed by
themselves (so every block of every text is read; at most one phrase in a block is cut short).

Characters are lower-cased; whatever isn't a letter becomes a space, and runs of spaces count as one. A letter that no
training text has ends the running phrase, or is a phrase by itself if none runs.

Defined results: a text without letters (null and empty ones too) has predicted null, bits null and phrases null; ties go to
the language first in alphabetical order; repeated rows each get a result; null doc_ids keep their rows; with no labelled
language all are null. Only doc_id, text and lang are read; lang is used for training alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import textkernel as K
from quirefold.llm.common import map_batches, spread_sample

BLOCK, TRAIN_TEXTS, TRAIN_CHARS, TRIES = 1024, 60, 16_000, 16


def codepoints(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start and every path from it spells a substring."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Model:
    """code 0 is an unknown letter, 1 a space; where owner[state + code] is state, table[state + code] is the next one.

    Elsewhere a phrase ends, and go[language, code] is the state in which the next begins.
    """

    langs: list[str]
    code_of: np.ndarray
    table: np.ndarray
    owner: np.ndarray
    go: np.ndarray
    roots: np.ndarray
    log_size: np.ndarray

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        low = [t.lower() for t in texts]
        cp = codepoints(low)
        codes = self.code_of[cp]
        off = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
        drop = np.zeros(len(codes), bool)  # a space after a space, or at a text's start
        drop[1:] = (codes[1:] == 1) & (codes[:-1] == 1)
        starts = off[:-1][off[:-1] < off[1:]]
        drop[starts] = codes[starts] == 1
        kept = np.concatenate([[0], np.cumsum(~drop)])
        return codes[~drop], kept[off]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and the characters parsed."""
        codes, off = self.encode(texts)
        size = np.diff(off)
        n_blocks = -(-size // BLOCK)
        doc = np.repeat(np.arange(len(texts)), n_blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = off[doc] + nth * BLOCK
        length = np.minimum(off[doc + 1] - start, BLOCK)
        order = np.argsort(-length, kind="stable")
        doc, start, length = doc[order], start[order], length[order]
        state = np.repeat(self.roots[:, None], len(doc), 1)
        count = np.zeros(state.shape, np.int32)
        active = len(doc) - np.searchsorted(length[::-1], np.arange(BLOCK), "right")  # blocks longer than t
        for t in range(int(length[0]) if len(length) else 0):
            a = active[t]
            code, now = codes[start[:a] + t], state[:, :a]
            at = now + code
            on = self.owner[at] == now
            count[:, :a] += ~on
            state[:, :a] = np.where(on, self.table[at], self.go[:, code])
        count += state != self.roots[:, None]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(doc, count[i], len(texts))
        return out, size


def overlay(rows: list[dict[int, int]]) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """A place for each row, no two equal, so that no two entries meet at place + code; and the entries there: row, target."""
    places, taken, used = [0] * len(rows), {}, set()
    free = top = 0
    for s in sorted(range(len(rows)), key=lambda s: (-len(rows[s]), s)):
        codes = sorted(rows[s])
        while free in taken:
            free += 1
        first = codes[0] if codes else 0
        at = max(free - first, 0)
        for _ in range(TRIES):
            if at not in used and not any(at + c in taken for c in codes):
                break
            at += 1
        else:
            at = top  # behind all others there is room
        places[s] = at
        used.add(at)
        for c in codes:
            taken[at + c] = (s, rows[s][c])
        top = max(top, at + 1 + (codes[-1] if codes else 0))
    return places, taken


def build(training: dict[str, str]) -> Model:
    """training: a text for each language."""
    langs = sorted(training)
    letters = sorted({c for lang in langs for c in np.unique(codepoints([training[lang]])).tolist() if chr(c).isalpha()})
    code_of = np.array([0 if chr(c).isalpha() else 1 for c in range(0x110000)], np.int32)
    code_of[letters] = np.arange(2, 2 + len(letters))
    width = 2 + len(letters)
    m = Model(langs, code_of, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((len(langs), width), np.int32), np.zeros(len(langs), np.int32), np.zeros(len(langs)))
    tables, owners, base = [], [], 0
    for i, lang in enumerate(langs):
        codes = m.encode([training[lang]])[0].tolist()
        rows = suffix_automaton(codes)
        places, taken = overlay(rows)
        size = max(places) + width
        table, owner = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for at, (s, to) in taken.items():
            table[at], owner[at] = base + places[to], base + places[s]
        tables.append(table), owners.append(owner)
        m.roots[i], m.log_size[i] = base + places[0], np.log2(max(len(codes), 2))
        m.go[i] = m.roots[i]
        for c, to in rows[0].items():
            m.go[i, c] = base + places[to]
        base += size
    if tables:
        m.table, m.owner = np.concatenate(tables), np.concatenate(owners)
    return m


def fit(docs: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> Model:
    """Trains on labelled rows: of each language at most `texts` (the smallest hashes of doc_id), whole texts while they come to `chars` characters at most.

    A language none of whose texts is that short has the beginning of its shortest one. The driver gets `chars` characters of a text at most.
    """
    chosen = spread_sample(docs, "doc_id", "lang", texts)
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), (F.col("doc_id") == F.col("__key")) & (F.col("lang") == F.col("__by")))
    some = rows.select("lang", "doc_id", F.length("text").alias("n"), F.substring("text", 1, chars).alias("t")).where("n > 0").distinct().collect()
    got: dict[str, list[str]] = {}
    for r in sorted(some):
        if sum(len(t) + 1 for t in got.setdefault(r["lang"], [])) + r["n"] <= chars:
            got[r["lang"]].append(r["t"])
    for lang in [k for k, v in got.items() if not v]:
        got[lang] = [min((r["n"], r["doc_id"], r["t"]) for r in some if r["lang"] == lang)[2]]
    return build({lang: " ".join(v) for lang, v in got.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, predicted, bits (estimated cross entropy a character) and phrases for every row."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        col = b.column(1)
        pred, bits, phr = [], [], []
        for a, z in K.slices(col, 4 << 20):
            texts = pc.fill_null(col.slice(a, z - a), "").to_pylist()
            p, size = model.phrases(texts)
            if not model.langs:
                pred += [None] * len(texts)
                bits += [None] * len(texts)
                phr += [None] * len(texts)
                continue
            e = p * model.log_size / np.maximum(size, 1)[:, None]
            win = e.argmin(1)
            ok = size > 0
            pred += [model.langs[w] if k else None for w, k in zip(win.tolist(), ok.tolist(), strict=True)]
            bits += [v if k else None for v, k in zip(e.min(1).tolist(), ok.tolist(), strict=True)]
            phr += [v if k else None for v, k in zip(p[np.arange(len(win)), win].tolist(), ok.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(bits, pa.float64()), pa.array(phr, pa.int64())], ["doc_id", "predicted", "bits", "phrases"])

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, predicted string, bits double, phrases long")
