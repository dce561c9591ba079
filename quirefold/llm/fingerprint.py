"""Document fingerprints of statistically improbable features.

A feature is a window of WINDOW bytes. Its rarity is the share that its entropy (in LEVELS levels) has among all windows of
all texts: rare levels rank first; windows of next to no entropy, and those of nearly the most, have none. In every stretch of POPULAR
consecutive windows the leftmost rarest one scores; windows that score LEAST times or more are selected. Their hashes go
into Bloom filters of BLOOM bits with HASHES bits each, a new filter after FILL features. Two fingerprints compare by the
overlap of their filters, normalised so that 0 is what chance gives and 1 is all bits of the smaller filter.

Two documents are linked when the Jaccard similarity of their sets of features is ALIKE or more. Each row has the number of other
documents that its own is linked to (links), its class (the smallest doc_id that links lead to, directly or over others) and its
match: the linked document of the highest similarity (ties: the smallest doc_id), whose fingerprint is compared with its own. Every
document is a query and nothing is capped. Features that exactly the same texts have are one item that weighs as many. Two sets that are
alike have an item in common that is among the rarest of both: what follows it in the common order of items weighs too
little. Each set is sent to each of these, with all of its items where it may meet another, so what moves grows with the texts and not
with their pairs; a pair counts at the first item it has in common. Texts of equal sets (by a 64-bit hash) are one, and count as many.

Defined results: texts shorter than a window (null and empty ones too) have no features, an empty fingerprint, no match, no
score and no links; a text with no other that is alike has no match, no score, no links and its own doc_id as class; comparing an empty fingerprint gives 0; repeated rows get equal fingerprints; rows that share a doc_id don't match each
other, and get the same match, class and number of links; a null doc_id has a fingerprint and no class, neither matches nor is matched. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import textkernel as K
from quirefold.llm.common import map_batches, split_by_ids, written
from quirefold.llm.simhash import components, unite

WINDOW, POPULAR, LEAST, LEVELS = 64, 64, 16, 256
ALIKE = 0.2
PAIRS = 1 << 17
BLOOM, HASHES, FILL = 2048, 5, 160
SCALE = 1 << 20
_N = np.arange(WINDOW + 1)
# entropy of a window is log2(64) - sum over bytes of n log2(n) / 64; _GAIN[k] is what the k-th equal byte adds to the sum, in whole units
_NLOGN = np.rint(np.where(_N > 0, _N * np.log2(np.maximum(_N, 1)), 0) * SCALE).astype(np.int64)
_GAIN = np.diff(_NLOGN, prepend=0)
LOWEST, HIGHEST = 0.15, 0.995


def equal_near(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, how many of the WINDOW - 1 bytes before it equal it, and how many of those after it; itself counted too."""
    n = len(data)
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, min(WINDOW, n)):
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    return before, after


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that starts at each byte."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    before, after = equal_near(data)
    # the window that ends with byte i gains byte i (after the 63 before it) and has lost byte i - 64 (before the 63 after it)
    change = _GAIN[before]
    change[WINDOW:] -= _GAIN[after[:-WINDOW]]
    sums = np.cumsum(change)[WINDOW - 1 :]
    entropy = 6 * WINDOW * SCALE - sums
    return np.clip(entropy * LEVELS // (6 * WINDOW * SCALE + 1), 0, LEVELS - 1)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which windows lie in one text."""
    start = np.arange(max(n - WINDOW + 1, 0))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(start)]
    return offsets[doc + 1] - start >= WINDOW


def select(rank: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the selected windows; rank: a window's place in rarity, from 1; 0 for none."""
    n = len(rank)
    if n == 0:
        return np.zeros(0, np.int64)
    ok = _inside(offsets, n + WINDOW - 1)
    big = np.int64(1) << 40
    key = np.where(ok & (rank > 0), rank.astype(np.int64) * big + np.arange(n), np.int64(1) << 62)
    pad = np.concatenate([key, np.full(POPULAR - 1, np.int64(1) << 62)])
    span = 1
    while span < POPULAR:  # minimum over 2, 4, ... 64 neighbours
        pad[: len(pad) - span] = np.minimum(pad[: len(pad) - span], pad[span:])
        span *= 2
    best = pad[:n]
    # a stretch must lie in one text: its last window does, or the text has fewer windows than a stretch and it starts with them
    starts, size = offsets[:-1], np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.arange(n)
    whole = ok & ((at + POPULAR <= (starts + size)[doc]) | (at == starts[doc]))
    best = best[whole]
    best = np.where(best < np.int64(1) << 62, best % big, -1)
    at, hits = np.unique(best[(best >= 0) & (best < (starts + size)[doc[at[whole]]])], return_counts=True)
    short = size[doc[at]] < POPULAR + LEAST  # a short text has few stretches
    return at[(hits >= LEAST) | short]


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each selected feature."""
    at = select(ranks[levels(data)], offsets)
    p, inv = K.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return np.searchsorted(offsets, at, "right") - 1, K.mix((sums[at + WINDOW] - sums[at]) * inv[at]) if len(at) else np.zeros(0, np.uint64)


def filters(doc: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """The chained filters of each text."""
    count = np.bincount(doc, minlength=n)
    nth = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    chain = -(-count // FILL)
    first = np.cumsum(chain) - chain
    bits = np.zeros((int(chain.sum()), BLOOM), bool)
    for k in range(HASHES):
        bits[first[doc] + nth // FILL, ((h >> np.uint64(11 * k)) % np.uint64(BLOOM)).astype(np.int64)] = True
    raw = np.packbits(bits, axis=1)
    return [raw[a : a + c].tobytes() for a, c in zip(first, chain, strict=True)]


def compare(a: bytes | None, b: bytes | None) -> float:
    """The mean over the filters of the shorter chain of the best normalised overlap with one of the other."""
    x, y = (np.unpackbits(np.frombuffer(v or b"", np.uint8)).reshape(-1, BLOOM).astype(np.float32) for v in (a, b))
    if len(x) > len(y) or (len(x) == len(y) and (a or b"") > (b or b"")):
        x, y = y, x
    if not len(x):
        return 0.0
    both, nx, ny = x @ y.T, x.sum(1)[:, None], y.sum(1)[None]
    most, chance = np.minimum(nx, ny), nx * ny / BLOOM
    cut = chance + 0.3 * (most - chance)
    return float(np.clip((both - cut) / np.maximum(most - cut, 1e-9), 0, 1).max(1).mean())


def level_ranks(docs: DataFrame) -> np.ndarray:
    """The place in rarity of each level, from counts over all windows of all texts; 0: not ranked."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(LEVELS, np.int64)
        for a, z in K.slices(b.column(0)):
            data, off = K.buffers(b.column(0).slice(a, z - a))
            lv = levels(data)
            total += np.bincount(lv[_inside(off, len(data))], minlength=LEVELS)[:LEVELS]
        own = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["level", "n"])

    rows = map_batches(docs.select("text"), each, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    return ranks_of({r["level"]: r["n"] for r in rows})


def ranks_of(counts: dict[int, int]) -> np.ndarray:
    usable = [lv for lv in counts if LOWEST * LEVELS <= lv < HIGHEST * LEVELS]
    out = np.zeros(LEVELS, np.int64)
    for i, lv in enumerate(sorted(usable, key=lambda lv: (counts[lv], lv))):
        out[lv] = i + 1
    return out


def digests(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """doc_id, n_features, filters, features (their hashes)."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        count, out, hashes = [], [], []
        for a, z in K.slices(b.column(1)):
            data, off = K.buffers(b.column(1).slice(a, z - a))
            doc, h = features(data, off, ranks)
            count.append(np.bincount(doc, minlength=z - a))
            out += filters(doc, h, z - a)
            hashes.append(h.view(np.int64))
        n = np.concatenate(count)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(hashes)))
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n), pa.array(out, pa.binary()), lists], ["doc_id", "n_features", "filters", "features"])

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, n_features long, filters binary, features array<long>")


def item_lists(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """set, size, n, first, several, items, weights: of each set that shares a feature.

    sets: set, features (distinct); groups: set, size, n, first, several. Items order by the logarithm of their number of sets.
    """
    each = sets.select("set", F.explode("features").alias("f")).repartition("f")
    item = F.expr("shiftleft(CAST(floor(log2(count(*))) AS BIGINT), 58) | shiftrightunsigned(xxhash64(count(*), bit_xor(xxhash64(set))), 6)")
    shared = each.groupBy("f").agg(F.count("*").alias("df"), item.alias("item")).where("df > 1").select("f", "item")
    items = each.join(shared.hint("shuffle_hash"), "f").select("set", "item").repartition("set").groupBy("set", "item").agg(F.count("*").cast("int").alias("w"))
    common = items.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("item", "w"))).alias("fs"))
    return common.join(groups.select("set", "size", "n", "first", "several"), "set").select("set", "size", "n", "first", "several", F.col("fs.item").alias("items"), F.col("fs.w").alias("weights"))


def rare_items(lists: DataFrame) -> DataFrame:
    """item, at, set, size, left, head, before: a row for each set and each of its rare items; at: the item's place among the set's; left: what
    it and those behind it weigh; head, before: the set's first item, and the one before this."""

    def rare(b: pa.RecordBatch) -> pa.RecordBatch:
        count = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(b.num_rows), count)
        flat, w = (b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
        first = np.cumsum(count) - count
        ahead = np.cumsum(w) - w
        left = np.bincount(doc, weights=w, minlength=b.num_rows).astype(np.int64)[doc] - (ahead - ahead[first[doc]])
        ident, size = (b.column(k).to_numpy()[doc] for k in (0, 1))
        own = np.flatnonzero(left >= np.ceil(ALIKE * size - 1e-9))
        begin = first[doc[own]]
        cols = [flat[own], (own - begin).astype(np.int32), ident[own], size[own], left[own], flat[begin], flat[np.maximum(own - 1, begin)]]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["item", "at", "set", "size", "left", "head", "before"])

    return map_batches(lists.select("set", "size", "items", "weights"), rare, "item long, at int, set long, size long, left long, head long, before long")


def _may_meet(at: np.ndarray, size: np.ndarray, left: np.ndarray, head: np.ndarray, before: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs can have their first common item here and still be alike."""
    earlier = (at[i] > 0) & (at[j] > 0) & ((head[i] == head[j]) | (before[i] == before[j]))
    return ~earlier & (np.minimum(left[i], left[j]) >= ALIKE / (1 + ALIKE) * (size[i] + size[j]) - 1e-9)


def meeting(b: pa.RecordBatch) -> pa.RecordBatch:
    """item, at, set of the rows that may meet another of their run."""
    key, at, _, size, left, head, before = (c.to_numpy() for c in b.columns)
    alive = np.zeros(len(key), bool)
    for i, j in _pairs(key):
        on = _may_meet(at, size, left, head, before, i, j)
        alive[i[on]] = alive[j[on]] = True
    return b.select(["item", "at", "set"]).filter(pa.array(alive))


def by_runs(rows: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn on batches of whole runs of equal items."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the run that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            if kept and key[0] != kept[0].column(0)[0].as_py():
                yield fn(pa.concat_batches(kept))
                kept = []
            if cut := int(np.searchsorted(key, key[-1])):
                yield fn(pa.concat_batches([*kept, b.slice(0, cut)]))
                kept = []
            kept.append(b.slice(cut))
        if kept:
            yield fn(pa.concat_batches(kept))

    return rows.repartition("item").sortWithinPartitions("item", "set").mapInArrow(each, schema)


def _pairs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with equal keys (sorted), some PAIRS at once."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    last, rows = np.repeat(start + size, size), np.arange(len(key))
    a: list[np.ndarray] = []
    many, k = 0, 1
    while len(rows := rows[rows + k < last[rows]]):
        a.append(np.stack([rows, rows + k]))
        many, k = many + len(rows), k + 1
        if many >= PAIRS:
            yield tuple(np.concatenate(a, 1))
            a, many = [], 0
    if many:
        yield tuple(np.concatenate(a, 1))


def compare_sets(b: pa.RecordBatch) -> pa.RecordBatch:
    """What the pairs that are alike, and have their first common item here, give each set. b: whole runs of equal items, with their sets' lists."""
    key, at, ident, size, n, first, several = (c.to_numpy(zero_copy_only=False) for c in b.columns[:7])
    count = pc.list_value_length(b.column(7)).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(count) - count
    names, code = np.unique(b.column(7).flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    w = b.column(8).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    weight = np.zeros(len(names), np.int64)
    weight[code] = w
    here, ahead = np.searchsorted(names, key), np.cumsum(w) - w
    left = ahead[begin] + np.bincount(np.repeat(np.arange(len(count)), count), weights=w).astype(np.int64) - ahead[begin + at]  # the item's weight and those after it
    head, before = code[begin], code[begin + np.maximum(at - 1, 0)]
    links, best, match, root = np.zeros(len(key), np.int64), np.zeros(len(key)), np.zeros(len(key), np.int64), np.arange(len(key))
    told: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    for i, j in _pairs(key):
        on = _may_meet(at, size, left, head, before, i, j)
        i, j = i[on], j[on]
        row = np.concatenate([np.repeat(np.arange(len(i)), count[x]) for x in (i, j)])
        where = np.concatenate([np.repeat(begin[x] - np.cumsum(count[x]) + count[x], count[x]) + np.arange(count[x].sum()) for x in (i, j)])
        k = np.sort(row << 32 | code[where])
        k = k[1:][k[1:] == k[:-1]]  # what both have, in the order of items
        row, item = k >> 32, k & 0xFFFFFFFF
        new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        both = np.bincount(row, weights=weight[item], minlength=len(i))
        j_ = both / (size[i] + size[j] - both)
        hit = np.zeros(len(i), bool)
        hit[row[new]] = item[new] == here[i[row[new]]]
        hit &= j_ >= ALIKE - 1e-9
        i, j, like = i[hit], j[hit], j_[hit]
        if not len(i):
            continue
        unite(root, i, j)
        told.append(np.stack([i, j])[:, several[i] | several[j]])
        a, o, like = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([like, like])
        np.add.at(links, a, n[o])
        order = np.lexsort((first[o], -like, a))
        a, o, like = a[order], o[order], like[order]
        new = np.concatenate([[True], a[1:] != a[:-1]])
        a, o, like = a[new], first[o[new]], like[new]
        better = (like > best[a]) | ((like == best[a]) & (o < match[a]))
        best[a[better]], match[a[better]] = like[better], o[better]
    own = np.flatnonzero(best > 0)
    x, y = np.concatenate(told, 1)
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    none = np.zeros(len(x), np.int64)
    cols = [np.concatenate([ident[own], ident[x]]), np.concatenate([links[own], none]), np.concatenate([best[own], none]), np.concatenate([match[own], none]), np.concatenate([first[own], none]), np.concatenate([first[root[own]], none])]
    other = pa.array(np.concatenate([own * 0, ident[y]]), mask=np.arange(len(own) + len(x)) < len(own))
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), other], ["set", "links", "j", "match", "first", "root", "other"])


def alike(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """set, links, j, match, first, root: parts of each set's links, best match and component; and set, other: each link of a set that a document of several has."""

    lists = written(item_lists(sets, groups), "items")
    rows = by_runs(rare_items(lists), meeting, "item long, at int, set long").join(lists, "set")
    rows = rows.select("item", "at", "set", "size", "n", "first", "several", "items", "weights")
    return by_runs(rows, compare_sets, "set long, links long, j double, match long, first long, root long, other long")


def links(made: DataFrame) -> DataFrame:
    """id, match, class, links of each document that is linked to another. made: doc_id, features."""
    rows = made.where("doc_id IS NOT NULL AND size(features) > 0").select("doc_id", F.array_distinct("features").alias("features"))
    rows = rows.select("doc_id", "features", F.size("features").cast("long").alias("size"), F.xxhash64(F.array_sort("features")).alias("set"))
    known = written(rows.groupBy("doc_id", "set", "size").agg(F.count("*").alias("rows")), "feature-sets")
    odd = written(known.groupBy("doc_id").agg(F.sum("rows").alias("rows"), F.count("*").alias("sets")).where("rows > 1").select(F.col("doc_id").alias("__id"), "sets"), "repeated")
    several = odd.where("sets > 1").select(F.col("__id").alias("doc_id"))
    of_several = written(known.join(several, "doc_id").select("doc_id", "set"), "several")
    single = known.join(several, "doc_id", "left_anti")
    groups = known.select("doc_id", "set", "size").join(several.withColumn("several", F.lit(True)), "doc_id", "left").groupBy("set", "size")
    groups = written(groups.agg(F.min("doc_id").alias("first"), F.count("*").alias("all"), F.count_if(F.col("several").isNull()).alias("n"), F.coalesce(F.max("several"), F.lit(False)).alias("several")), "equal-sets")
    members = written(known.join(groups.where("all > 1"), ["set", "size"]).select("doc_id", "set", "first"), "equal-members")
    second = members.where("doc_id > first").groupBy("set", "first").agg(F.min("doc_id").alias("second"))
    equal = members.where("doc_id > first").select(F.col("doc_id").alias("id"), F.col("first").alias("match")).union(second.select(F.col("first").alias("id"), F.col("second").alias("match")))
    equal = equal.groupBy("id").agg(F.min("match").alias("match"))
    # a set is compared once: a row of a document that has one row, and is not the first of its set, stands for nothing of its own
    out = written(members.where("doc_id > first").select(F.col("doc_id").alias("__id")).union(odd.select("__id")).distinct(), "copies")
    _, own = split_by_ids(rows, out, "doc_id")
    own = rows.join(out, F.col("doc_id") == F.col("__id"), "left_anti") if own is None else own
    rest = rows.join(odd, F.col("doc_id") == F.col("__id"), "left_semi").join(groups.select("set", F.col("first").alias("doc_id")), ["set", "doc_id"]).dropDuplicates(["set"])
    found = written(alike(own.select("set", "features").union(rest.select("set", "features")), groups), "alike")
    part = written(found.where("other IS NULL").groupBy("set").agg(F.sum("links").alias("links"), F.max(F.struct("j", (-F.col("match")).alias("m"))).alias("b")), "alike-sets")
    best = known.join(part, "set").select(F.col("doc_id").alias("id"), "b.j", (-F.col("b.m")).alias("match")).where("id <> match")
    best = best.groupBy("id").agg(F.max(F.struct("j", (-F.col("match")).alias("m"))).alias("b")).select("id", (-F.col("b.m")).alias("match"))
    best = written(equal.union(best.join(equal.select("id"), "id", "left_anti")), "matches")
    edges = found.where("other IS NULL AND first <> root").select("first", "root").union(members.where("doc_id > first").select("doc_id", "first"))
    edges = edges.union(of_several.join(groups, "set").where("doc_id <> first").select("doc_id", "first"))
    classes = components(edges.toDF("a", "b"))
    # documents of several sets are counted one by one, all others by set
    near = found.where("other IS NOT NULL").select("set", "other").union(groups.where("several").select("set", F.col("set").alias("other"))).distinct()
    beside = near.join(of_several.select(F.col("set").alias("other"), F.col("doc_id").alias("d")), "other").groupBy("set").agg(F.countDistinct("d").alias("more"))
    total = groups.select("set", "n").join(part.select("set", "links"), "set", "left").join(beside, "set", "left").select("set", (F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("links"))
    counted = single.join(total, "set").select(F.col("doc_id").alias("id"), "links")
    around = of_several.join(near, "set").select("doc_id", "other").distinct()
    mine = around.join(groups.select(F.col("set").alias("other"), "n"), "other").groupBy("doc_id").agg(F.sum("n").alias("n"))
    theirs = around.join(of_several.select(F.col("set").alias("other"), F.col("doc_id").alias("d")), "other").groupBy("doc_id").agg(F.countDistinct("d").alias("more"))
    counted = counted.union(mine.join(theirs, "doc_id").select("doc_id", F.col("n") + F.col("more") - 1))
    linked = best.join(counted.where("links > 0"), "id", "left").join(classes.select(F.col("node").alias("id"), F.col("root").alias("class")), "id", "left")
    return linked.select("id", "match", F.coalesce("class", "id").alias("class"), "links")


def matches(made: DataFrame) -> DataFrame:
    """id, match: the best other document of each, if one is alike. made: doc_id, features."""
    return links(made).select("id", "match")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_features, filters, match, score, class, links for every row."""
    made = written(digests(docs, level_ranks(docs)), "digests")
    best = written(links(made), "links")
    some, _ = split_by_ids(made.select("doc_id", "filters"), best.select(F.col("match").alias("__id")).distinct(), "doc_id")
    other = some.groupBy(F.col("doc_id").alias("match")).agg(F.max("filters").alias("other"))
    matched = best.join(other, "match").select("id", "match", "other", "class", "links")
    rows = made.select("doc_id", "n_features", "filters").join(matched, F.col("doc_id") == F.col("id"), "left")
    rows = rows.select("doc_id", "n_features", "filters", "match", "other", F.coalesce("class", "doc_id").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        s = [None if m is None else compare(x, y) for m, x, y in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(s, pa.float64()), *b.columns[5:]], ["doc_id", "n_features", "filters", "match", "score", "class", "links"])

    return map_batches(rows, score, "doc_id long, n_features long, filters binary, match long, score double, class long, links long")
