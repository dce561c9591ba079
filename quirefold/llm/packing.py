"""Packing texts into windows of a fixed number of tokens by non-negative least squares on the histogram of lengths.

Tokens are those of the byte-pair vocabulary (bpe_counts), or words between white space (token_counts), plus one that ends each
text. A text longer than the window is cut into full windows and a rest, so no token is lost. Rests are binned by length (bins of STEP tokens, rounded up); all combinations of at most DEPTH
bins that fill a window are enumerated, and the repeat counts that fit the histogram best with none below zero are solved
for, rounded, and cut to what is there. What remains is packed greedily, best fit first, again on the histogram. The plan
is as large as the number of bins, whatever the number of texts; each text finds its place in it by its rank in its bin,
which comes from counts by shard and a rank within a shard, so no bin is ranked in one task.

Defined results: null and empty texts (no tokens) take no place and don't appear; repeated rows are each packed; a null doc_id is
packed like others; ties in rank are broken by doc_id, then piece; an empty table gives an empty result. Only doc_id and text are
read (or doc_id and tokens where a count is given).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm import bpe
from quirefold.llm.common import written

WINDOW, STEP, DEPTH = 2048, 16, 3
#: So many rows share one rank within a bin: what the driver holds is a number for each bin and each shard of this size.
SHARD_ROWS = 250_000


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tol = 1e-8 * max(1.0, np.abs(atb).max(initial=0))
    for _ in range(most):
        w = atb - ata @ x
        w[free] = -np.inf
        if not n or w.max() <= tol:
            break
        free[w.argmax()] = True
        while True:
            own = np.flatnonzero(free)
            s = np.linalg.lstsq(ata[np.ix_(own, own)], atb[own], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[own] = s
                break
            bad = s <= 0
            step = (x[own][bad] / np.maximum(x[own][bad] - s[bad], 1e-300)).min()
            x[own] += step * (s - x[own])
            free[own[x[own] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def combinations(bins: np.ndarray, full: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Falling tuples of at most `depth` of these bins that sum to full."""
    have, out = set(bins.tolist()), []

    def grow(part: tuple[int, ...], left: int) -> None:
        if left in have and (not part or left <= part[-1]):
            out.append((*part, left))
        if len(part) + 2 <= depth:
            for b in sorted(have):
                if b < left and (not part or b <= part[-1]):
                    grow((*part, b), left - b)

    grow((), full)
    return sorted(set(out))


@dataclass
class Plan:
    """Windows in order: combos[i] is repeated times[i] times."""

    combos: list[tuple[int, ...]]
    times: list[int]

    @property
    def windows(self) -> int:
        return sum(self.times)


def solve(histogram: dict[int, int], window: int = WINDOW, step: int = STEP, depth: int = DEPTH) -> Plan:
    """histogram: rests by bin (bin b holds lengths in ((b - 1) * step, b * step])."""
    full = window // step
    left = Counter({b: n for b, n in histogram.items() if n})
    combos, times = [], []
    bins = np.array(sorted(left), np.int64)
    found = combinations(bins, full, depth)
    if found:
        a = np.zeros((full + 1, len(found)))
        for j, combo in enumerate(found):
            for b in combo:
                a[b, j] += 1
        target = np.array([left.get(b, 0) for b in range(full + 1)], float)
        x = nnls(a, target / max(target.max(), 1)) * max(target.max(), 1)
        for j in np.argsort(-x, kind="stable"):
            need = Counter(found[j])
            if (n := min(int(round(x[j])), *(left[b] // k for b, k in need.items()))) > 0:
                combos.append(found[j]), times.append(n)
                for b, k in need.items():
                    left[b] -= k * n
    while (some := [b for b in left if left[b] > 0]) and some:
        combo, room = [], full  # the longest that still fits, again and again
        trial = Counter(left)
        while fits := [b for b in trial if trial[b] > 0 and b <= room]:
            b = max(fits)
            combo.append(b)
            trial[b] -= 1
            room -= b
        need = Counter(combo)
        n = min(left[b] // k for b, k in need.items())
        combos.append(tuple(combo)), times.append(n)
        for b, k in need.items():
            left[b] -= k * n
    return Plan(combos, times)


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, tokens: words and one that ends the text; texts without words are left out."""
    n = F.expr("regexp_count(text, '[^ \\\\t\\\\n\\\\r\\\\x0B\\\\f]+')")
    return docs.select("doc_id", n.cast("long").alias("tokens")).where("tokens > 0").select("doc_id", (F.col("tokens") + 1).alias("tokens"))


def bpe_counts(docs: DataFrame) -> DataFrame:
    """doc_id, tokens: those that bpe.encode gives and one that ends the text; texts without tokens are left out."""
    return bpe.counts(docs).where("tokens > 0").select("doc_id", (F.col("tokens") + 1).alias("tokens"))


def pack(counts: DataFrame, window: int = WINDOW, step: int = STEP, depth: int = DEPTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """window_id, slot, doc_id, start, tokens: which tokens of which text stand where.

    window_id is a pair (plan: 0 for texts' full windows, 1 for rests; number), flattened to one integer: rests come first.
    """
    counts = written(counts.select("doc_id", "tokens").where("tokens > 0"), "token-counts")
    shards = max(8, -(-counts.count() // shard_rows))
    counts = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(shards)).cast("int"))
    whole = F.floor(F.col("tokens") / window).cast("long")
    rest = F.col("tokens") - whole * window
    rests = counts.where(rest > 0).select("doc_id", (whole * window).alias("start"), rest.alias("tokens"), F.ceil(rest / step).cast("int").alias("bin"), "shard")
    fulls = counts.where(whole > 0).select("doc_id", whole.alias("n"), "shard")
    sizes = {(r["bin"], r["shard"]): r["n"] for r in rests.groupBy("bin", "shard").agg(F.count("*").alias("n")).collect()}  # bins x shards rows at most
    full_sizes = {r["shard"]: r["n"] for r in fulls.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    histogram: Counter = Counter()
    base = np.zeros((window // step + 2, shards), np.int64)
    for (b, s), n in sorted(sizes.items()):
        base[b, s] = histogram[b]
        histogram[b] += n
    plan = solve(histogram, window, step, depth)
    places: dict[int, list[tuple[int, int, int, int]]] = {}  # bin: first rank, first window, uses in a window, first slot
    used: Counter = Counter()
    first_window = 0
    for combo, times in zip(plan.combos, plan.times, strict=True):
        slot = 0
        for b, k in sorted(Counter(combo).items(), reverse=True):
            places.setdefault(b, []).append((used[b], first_window, k, slot))
            used[b] += times * k
            slot += k
        first_window += times
    table = {b: np.array(v, np.int64) for b, v in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, tokens, bins, shard, rank = batch.columns
            out_w, out_s = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            b, s, r = (c.to_numpy(zero_copy_only=False) for c in (bins, shard, rank))
            for one in np.unique(b):
                own = np.flatnonzero(b == one)
                t = table[int(one)]
                at = r[own] - 1 + base[one, s[own]]
                i = np.searchsorted(t[:, 0], at, "right") - 1
                within = at - t[i, 0]
                out_w[own], out_s[own] = t[i, 1] + within // t[i, 2], t[i, 3] + within % t[i, 2]
            yield pa.RecordBatch.from_arrays([pa.array(out_w), pa.array(out_s.astype(np.int32)), doc, start, tokens], ["window_id", "slot", "doc_id", "start", "tokens"])

    schema = "window_id long, slot int, doc_id long, start long, tokens long"
    ranked = rests.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "shard").orderBy("doc_id", "start")).cast("long"))
    packed = ranked.select(F.col("doc_id").cast("long"), "start", "tokens", "bin", "shard", "rank").mapInArrow(place, schema)
    begin, bases = plan.windows, []
    for s in sorted(full_sizes):
        bases.append((s, begin))
        begin += full_sizes[s]
    begins = counts.sparkSession.createDataFrame(bases, "shard int, begin long")  # a row for each shard
    w = Window.partitionBy("shard").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    summed = fulls.select("doc_id", "n", "shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    numbered = summed.join(F.broadcast(begins), "shard").select("doc_id", "n", (F.col("begin") + F.col("before")).alias("at"))
    pieces = numbered.select("doc_id", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    full_rows = pieces.select((F.col("at") + F.col("k")).alias("window_id"), F.lit(0).alias("slot"), F.col("doc_id").cast("long"), (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("tokens"))
    return packed.union(full_rows)
