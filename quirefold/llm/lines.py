"""Line dedup: a line goes when an earlier one is equal or within one word edit of it.

Lines are compared in normal form (lower case, white space collapsed). Earlier means a smaller (doc_id, line number). Lines
without words (fewer than MIN_WORDS) always stay. The edit bound is one word (replaced, added or left out) where the shorter
line has EDIT_WORDS words or more, and none in shorter lines, of which one word is too large a part.

The join is on deletion neighbourhoods: a line emits the hash of itself and of itself without each word. Two lines within one
edit share such a variant: both without the word at the same place, or the longer without one word and the shorter as it is.
Before that, an exact filter: with an edit in one half of a line, the other half is unchanged, so a line that shares neither half
with any other line of fitting length has no partner and emits nothing. A line that shares its first half needs variants of its
second half only, and the other way round. Among the rows of one variant the earliest is found in one sorted pass, not by
pairs, so a variant that many thousands of lines share costs no more a line than others. The partner found is verified on the words.

Defined results: a null text stays null; an empty text stays; a text all of whose lines go becomes empty, its row stays;
rows with a null doc_id stay as they are and take no part; rows that share doc_id are tied line by line: neither is earlier.
n_chars, where there is such a column, becomes the new length. All other columns pass through. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm import textkernel as K
from quirefold.llm.common import ROW, give_back, packed, parts, split_by_ids, written

MIN_WORDS, EDIT_WORDS = 1, 8
_KEYS = ("p0", "s0", "p1", "s1")


def normal(line: str) -> list[str]:
    return line.lower().split()


def _h64(text: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(text, seed) - (1 << 63)


def _halves(words: list[str]) -> tuple[int, int, int, int]:
    """The first and second half, as the shorter line of a pair (or of two as long) and as the longer one."""
    n = len(words)
    a, b = n // 2, (n - 1) // 2
    h = lambda part, kind, length: _h64(" ".join(part), 2 * length + kind)
    return h(words[:a], 0, n), h(words[a:], 1, n), h(words[:b], 0, n - 1), h(words[b + 1 :], 1, n - 1)


def line_table(docs: DataFrame) -> DataFrame:
    """A row for each line that takes part: its place, 128 bits of hash, and the hashes of its halves where an edit counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, z in K.slices(batch.column(1)):
                cols: list[list] = [[] for _ in range(8)]
                for doc_id, text in zip(ids[a:z], batch.column(1).slice(a, z - a).to_pylist(), strict=True):
                    for no, line in enumerate((text or "").split("\n")):
                        words = normal(line)
                        if len(words) < MIN_WORDS:
                            continue
                        d = xxhash.xxh3_128_intdigest(" ".join(words))
                        row = (doc_id, no, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), *(_halves(words) if len(words) >= EDIT_WORDS else (None,) * 4))
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "line_no", "h1", "h2", *_KEYS])
        give_back()

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(each, "doc_id long, line_no long, h1 long, h2 long, p0 long, s0 long, p1 long, s1 long")


def _suspects(first: DataFrame) -> DataFrame:
    """doc_id, lines: array of (line_no, h1, ahead, behind) of the lines that share a half with another: the second (ahead) or the first half (behind) may hold an edit.

    A half's hash holds its side and the length it is for, so halves of different roles never meet by chance.
    """
    keys = first.where("p0 IS NOT NULL").select("doc_id", "line_no", "h1", F.explode(F.array(*[F.struct(F.lit(i % 2).alias("side"), F.col(k).alias("key")) for i, k in enumerate(_KEYS)])).alias("k"))
    keys = keys.select("doc_id", "line_no", "h1", "k.side", "k.key")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    some = keys.join(shared, "key").groupBy("doc_id", "line_no", "h1").agg(F.max(F.col("side") == 0).alias("ahead"), F.max(F.col("side") == 1).alias("behind"))
    return some.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h1", "ahead", "behind")).alias("lines"))


def _numbers(words: list[str]) -> np.ndarray:
    return K.mix(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))


def variant_hashes(words: list[str], ahead: bool, behind: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line and of it without a word, with the place left out (-1: none)."""
    n = len(words)
    x = _numbers(words)
    p, inv = K.powers(n + 1)
    c = np.concatenate([[np.uint64(0)], np.cumsum(x * p[:n])])
    # the two roles cut a line at n // 2 and (n - 1) // 2: one place more on either side covers both
    places = np.arange(max(0, (n - 1) // 2 - 1) if not behind else 0, min(n, n // 2 + 1) if not ahead else n)
    without = c[places] + (c[n] - c[places + 1]) * inv[1]
    h = K.mix(np.concatenate([[c[n]], without]) + np.concatenate([[n], np.full(len(places), n - 1)]).astype(np.uint64))
    return h.view(np.int64), np.concatenate([[-1], places])


def _variant_batch(*cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["key", "place", "doc_id", "line_no"])


def _chosen(text: str, lines: list[dict]) -> Iterator[tuple[int, list[str], tuple[bool, bool]]]:
    """The lines of a text that are meant: number and hash must agree (rows may share a doc_id)."""
    all_lines = text.split("\n")
    for x in lines:
        if x["line_no"] < len(all_lines):
            words = normal(all_lines[x["line_no"]])
            if (xxhash.xxh3_128_intdigest(" ".join(words)) >> 64) - (1 << 63) == x["h1"]:
                yield x["line_no"], words, (x["ahead"], x["behind"])


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, place, doc_id, line_no: each line with the earliest partner that its variants show.

    Partners of a row: rows of its key with the same place left out, or the whole line (place -1) for a variant and any
    variant for the whole line. Only the first row of each place and of the key matters, so a run is never kept as a whole.
    """
    run: dict = {"key": None}

    def close(found: list) -> None:
        whole, cut = run["whole"], run["cut"]
        if whole and cut and cut[0] < whole[-1]:
            found += [(r, cut[0]) for r in whole if cut[0] < r]
        run["whole"], run["cut"] = [], []

    for batch in batches:
        key, place, doc, no = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        same[0] |= run["key"] is not None and key[0] == run["key"]
        same[-1] = True  # may go on in the next batch
        found: list = []
        rows = np.flatnonzero(same)
        for k, p, d, n in zip(key[rows].tolist(), place[rows].tolist(), doc[rows].tolist(), no[rows].tolist(), strict=True):
            if k != run["key"]:
                if run["key"] is not None:
                    close(found)
                run = {"key": k, "place": None, "first": None, "whole": [], "cut": []}
            me = (d, n)
            if p == -1:
                run["whole"].append(me)
                continue
            best = None
            if p != run["place"]:
                run["place"], run["first"] = p, me
            elif run["first"] < me:
                best = run["first"]
            if run["whole"] and run["whole"][0] < me:
                best = min(best, run["whole"][0]) if best else run["whole"][0]
            if best:
                found.append((me, best))
            if not run["cut"] or me < run["cut"][0]:
                run["cut"] = [me]
        yield _pairs(found)
    found = []
    if run["key"] is not None:
        close(found)
    yield _pairs(found)


def _pairs(found: list) -> pa.RecordBatch:
    flat = np.array([(*a, *b) for a, b in found], np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in flat.T], ["doc_id", "line_no", "by_doc", "by_line"])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether at most one word is replaced, added or left out."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([within_one(x.split(" "), y.split(" ")) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)], pa.bool_())).select([0, 1, 2])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, h1 of every line that goes."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = written(line_table(ids), "lines")
    place = F.struct("doc_id", "line_no")
    groups = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), *[F.first(k).alias(k) for k in _KEYS])
    groups = written(groups.select("h1", "h2", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), *_KEYS), "first-lines")
    copies = groups.where("n > 1").select("h1", "h2", F.col("doc_id").alias("by_doc"), F.col("line_no").alias("by_line"))
    equal = lines.select("doc_id", "line_no", "h1", "h2").join(copies, ["h1", "h2"]).where("by_doc < doc_id OR (by_doc = doc_id AND by_line < line_no)").select("doc_id", "line_no", "h1")

    suspects = written(_suspects(groups), "suspects")
    mine = suspects.select(F.col("doc_id").alias("__id"), "lines")
    with_suspects, _ = split_by_ids(ids, mine.select("__id"), "doc_id")  # else every text would be shuffled for some lines
    texts = with_suspects.join(mine, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "lines")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, no, x["h1"], " ".join(w), x["ahead"], x["behind"]) for d, text, ls in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in ls for no, w, _ in _chosen(text, [x])]
            names, kinds = ["doc_id", "line_no", "h1", "line", "ahead", "behind"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    chosen = written(texts.mapInArrow(words_of, "doc_id long, line_no long, h1 long, line string, ahead boolean, behind boolean"), "suspect-lines")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for d, no, line, ahead, behind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, at = variant_hashes(line.split(" "), ahead, behind)
                for c, v in zip(cols, (h, at, np.full(len(h), d), np.full(len(h), no)), strict=True):
                    c.append(v)
            yield _variant_batch(*cols)

    rows = chosen.select("doc_id", "line_no", "line", "ahead", "behind").mapInArrow(emit, "key long, place long, doc_id long, line_no long")
    pairs = rows.repartition("key").sortWithinPartitions("key", "place", "doc_id", "line_no").mapInArrow(_earliest, "doc_id long, line_no long, by_doc long, by_line long")
    best = pairs.groupBy("doc_id", "line_no").agg(F.min(F.struct("by_doc", "by_line")).alias("by"))
    best = best.select("doc_id", "line_no", F.col("by.by_doc").alias("by_doc"), F.col("by.by_line").alias("by_line"))
    other = chosen.select(F.col("doc_id").alias("by_doc"), F.col("line_no").alias("by_line"), F.col("line").alias("other"))
    checked = best.join(chosen.select("doc_id", "line_no", "h1", "line"), ["doc_id", "line_no"]).join(other, ["by_doc", "by_line"])
    near = checked.select("doc_id", "line_no", "h1", "line", "other").mapInArrow(_verified, "doc_id long, line_no long, h1 long")
    return equal.union(near).distinct()


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines gone from text; n_chars is set where it is a column."""
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h1")).alias("__lines"))
    gone = written(gone.select(F.col("doc_id").alias("__id"), "__lines"), "repeated-lines")
    inside, outside = split_by_ids(packed(docs), gone.select("__id"), f"{ROW}.doc_id")
    rows = inside.join(gone, F.col(f"{ROW}.doc_id").cast("long") == F.col("__id"), "left")
    schema: T.StructType = docs.schema
    at = schema.names.index("text")
    counted = schema.names.index("n_chars") if "n_chars" in schema.names else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in parts(batch)):
            row, drop = b.column(0), b.column(1)
            cols = row.flatten()
            hit = np.flatnonzero(pc.is_valid(drop).to_numpy(zero_copy_only=False))
            if len(hit):
                for i in (at, counted):
                    values = cols[i].to_pylist() if i is not None else []
                    if i == at:
                        for j in hit:
                            values[j] = _without(values[j], drop[int(j)].as_py())
                        new = values
                    elif i is not None:
                        for j in hit:
                            values[j] = None if new[j] is None else len(new[j])
                    if i is not None:
                        cols[i] = pa.array(values, cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, schema.names)
        give_back()

    changed = rows.select(ROW, "__lines").mapInArrow(each, schema)
    return changed if outside is None else changed.union(outside.select(f"{ROW}.*"))


def _without(text: str | None, gone: list[dict]) -> str | None:
    if text is None:
        return None
    by = {}
    for x in gone:
        by.setdefault(x["line_no"], set()).add(x["h1"])
    keep = []
    for no, line in enumerate(text.split("\n")):
        if no in by and (xxhash.xxh3_128_intdigest(" ".join(normal(line))) >> 64) - (1 << 63) in by[no]:
            continue
        keep.append(line)
    return "\n".join(keep)
