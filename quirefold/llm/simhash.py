"""SimHash near-duplicate groups by deletion-variant signatures.

A text is the set of its words (lower case, cut at white space), weighted by the logarithm of their counts; its signature
has BITS bits. Two texts are near duplicates when their signatures differ in at most MAX_BITS bits; a group is a connected
component of that relation. Signatures that differ in at most 2s - 1 bits, cut into s segments, have a segment that differs
in at most one bit, so both have an equal variant of that segment with one bit left out. Each signature emits all variants
of all segments; rows with equal variants meet in one partition, sorted, and every candidate is verified.

Within a run of equal variants all pairs are verified, by shifts of all short runs at once, and in blocks of a long one; rows of
a long run that are known to be in one component aren't compared with each other. Of a batch only as many edges go on as connect
its components. Nothing is capped.

Defined results: texts without words (null, empty) are in no group; rows whose doc_id is null are in no group and stay; rows
that share a doc_id are one document, which joins the groups of each of its texts and stays or goes as a whole; ties keep
the smallest doc_id; an empty table gives an empty result. Other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import textkernel as K
from quirefold.llm.common import ROW, map_batches, packed, split_by_ids, written

BITS, MAX_BITS = 128, 15
SHORT_RUN, CHUNK = 160, 256
BLOCK = 1 << 18
_SALT = np.uint64(0xD6E8FEB86659FD93)


def signature(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two halves of each signature, and which texts have one."""
    parts = [_signature(texts.slice(a, b - a)) for a, b in K.slices(texts, K.SMALL_SLICE_BYTES)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool))


def _signature(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts)
    low, off = K.buffers(pc.utf8_lower(texts))
    w = K.words(low, off, K.NONSPACE[low])
    h = w.hashes()
    order = np.lexsort((h, w.doc))
    doc, h = w.doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    weight = np.rint(8 * np.log1p(np.diff(np.append(at, len(doc)))))  # whole numbers: sums are exact in any order
    doc, h = doc[at], h[at]
    begin = np.searchsorted(doc, np.arange(n + 1))
    out, seen = np.zeros((n, 2), np.uint64), np.diff(begin) > 0
    for i in np.flatnonzero(seen):
        total, votes = 0.0, np.zeros(BITS)
        for a in range(begin[i], begin[i + 1], 1 << 15):
            z = min(a + (1 << 15), begin[i + 1])
            bits = np.unpackbits(np.stack([h[a:z], K.mix(h[a:z] ^ _SALT)], 1).view(np.uint8), axis=1)
            votes += weight[a:z].astype(np.float32) @ bits.astype(np.float32)
            total += weight[a:z].sum()
        out[i] = np.packbits(2 * votes > total).view(np.uint64)
    return out[:, 0], out[:, 1], seen


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo for every row that has a doc_id and words."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        hi, lo, ok = signature(b.column(1))
        arrays = [b.column(0).cast(pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "hi", "lo"]).filter(pa.array(ok))

    return map_batches(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), each, "doc_id long, hi long, lo long")


def variants(sigs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """key, node, hi, lo: for each segment and each of its bits the segment without that bit. node: the smallest doc_id of the signature."""
    n_seg = (max_bits + 2) // 2
    if BITS % n_seg or 64 % (BITS // n_seg):
        raise ValueError("the segments must divide the halves evenly")
    size = BITS // n_seg
    half = 64 // size
    distinct = sigs.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"))
    every = distinct.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))))
    mask = (1 << size) - 1
    segment = f"shiftright(CASE WHEN j DIV {size} < {half} THEN hi ELSE lo END, CAST(j DIV {size} % {half} * {size} AS INT)) & {mask}L"
    key = f"CAST(j AS BIGINT) * {1 << size}L + (({segment}) & ~shiftleft(1L, CAST(j % {size} AS INT)))"
    return every.select(F.expr(key).alias("key"), "node", "hi", "lo")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """In place: root[i] is the smallest row of i's component, now with the edges a, b."""
    while len(a):
        a, b = root[a], root[b]
        on = a != b
        a, b = a[on], b[on]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _search(node: np.ndarray, sig: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect each component of one run."""
    hi = np.ascontiguousarray(sig[:, 0])
    root, todo = np.arange(len(node)), np.arange(len(node))
    step = min(max(BLOCK // len(node), 16), CHUNK)
    while len(todo):
        own = root[todo] == root[todo[0]]
        others = todo[~own]
        if not len(others):  # all that are left are in one component
            break
        lead = int(own.argmin())
        if lead >= min(step, len(todo)):  # rows of one component: the fewer the others, the more of them at once
            front = todo[: min(lead, max(BLOCK // len(others), step))]
        else:
            front, others = todo[:step], todo
        rest = todo[len(front) :]
        i, j = np.nonzero(np.bitwise_count(hi[front][:, None] ^ hi[others][None]) <= most)
        i, j = front[i], others[j]
        near = (root[i] != root[j]) & (_distance(sig[i], sig[j]) <= most)
        unite(root, i[near], j[near])
        todo = rest
        if np.count_nonzero(near) > step:  # rows of one component come together
            todo = rest[np.argsort(root[rest], kind="stable")]
    own = np.flatnonzero(root != np.arange(len(root)))
    return node[root[own]], node[own]


def edges_of(key: np.ndarray, node: np.ndarray, sig: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges within all runs of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, n in zip(start[size > SHORT_RUN], size[size > SHORT_RUN], strict=True):
        x, y = _search(node[s : s + n], sig[s : s + n], most)
        a.append(x), b.append(y)
    hi = np.ascontiguousarray(sig[:, 0])
    last = np.repeat(np.where(size <= SHORT_RUN, start + size, 0), size)  # end of the run of each row
    short = size[size <= SHORT_RUN]
    rows = None
    for k in range(1, SHORT_RUN):
        short = short[short > k]
        if not len(short):
            break
        if rows is None and 4 * int((short - k).sum()) > len(key):
            near = np.flatnonzero(np.bitwise_count(hi[k:] ^ hi[:-k]) <= most)
            near = near[near + k < last[near]]
        else:  # few rows are left
            rows = np.arange(len(key)) if rows is None else rows
            rows = rows[rows + k < last[rows]]
            near = rows[np.bitwise_count(hi[rows] ^ hi[rows + k]) <= most]
        near = near[_distance(sig[near], sig[near + k]) <= most]
        a.append(node[near]), b.append(node[near + k])
    return np.concatenate(a), np.concatenate(b)


def near_edges(variant_rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a < b: pairs of nodes that connect the same components as all pairs within max_bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list[np.ndarray]) -> pa.RecordBatch:
            x, y = edges_of(part[0], part[1], np.stack([c.view(np.uint64) for c in part[2:]], 1), max_bits)
            nodes, code = np.unique(np.concatenate([x, y]), return_inverse=True)
            root = np.arange(len(nodes))
            unite(root, code[: len(x)], code[len(x) :])
            own = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[root[own]]), pa.array(nodes[own])], ["a", "b"])

        kept: list[list[np.ndarray]] = []  # the run that may go on in the next batch
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if kept and cols[0][0] != kept[0][0][0]:
                yield out([np.concatenate(x) for x in zip(*kept, strict=True)])
                kept = []
            if cut:
                whole = [*kept, [c[:cut] for c in cols]]
                yield out([np.concatenate(x) for x in zip(*whole, strict=True)])
                kept = []
            kept.append([c[cut:] for c in cols])
        if kept:
            yield out([np.concatenate(x) for x in zip(*kept, strict=True)])

    return variant_rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(each, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, by alternating large and small stars until nothing changes."""
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["x"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        joined = large.join(low, large["u"] == low["x"])
        small = joined.select("v", "m").where("v > m").union(joined.select("u", "m")).distinct().toDF("u", "v")
        stars = written(small, "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, duplicate_of: each document of a group but the smallest doc_id, and that one."""
    sigs = written(signatures(docs), "signatures")
    roots = components(near_edges(variants(sigs, max_bits), max_bits).union(_same(sigs)).toDF("a", "b"))
    return roots.where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of")).distinct()


def _same(sigs: DataFrame) -> DataFrame:
    """Edges from each document to the smallest one with its signature."""
    least = sigs.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "node")
    return sigs.join(least, ["hi", "lo"]).where("doc_id <> node").select("node", "doc_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the duplicates."""
    gone = written(duplicates(docs, max_bits).select(F.col("doc_id").alias("__id")), "duplicates")
    inside, outside = split_by_ids(packed(docs), gone, f"{ROW}.doc_id")
    kept = inside.join(gone, F.col(f"{ROW}.doc_id") == F.col("__id"), "left_anti") if outside is None else outside
    return kept.select(f"{ROW}.*")
