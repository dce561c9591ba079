"""Toxicity: the trees and the calibration against exhaustive versions, features by hand, held-out recall and precision."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quirefold.llm import boosting, toxicity

SF = "/root/testdata/sf0.1"  # held-out figures need more labelled rows than the smaller tables have
SCHEMA = "doc_id long, text string, score string, h string, y string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def best_split(x, g, h, l2):
    """By trying every cut between two values of every feature."""
    best = (0.0, None)
    for j in range(x.shape[1]):
        for c in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= c
            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
            gain = score(left) + score(~left) - g.sum() ** 2 / (h.sum() + l2)
            best = max(best, (gain, (j, c)), key=lambda v: v[0])
    return best


def test_first_tree_by_exhaustive_search():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (80, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (x[:, 0] > 3) ^ (rng.random(80) < 0.1)).astype(float)
    f = boosting.fit_forest(x, y, rounds=1, depth=2)
    p = np.full(80, y.mean())
    g, h = y - p, p * (1 - p)
    node = np.zeros(80, int)
    for i in range(3):
        own = node == i
        gain, (j, c) = best_split(x[own], g[own], h[own], 1.0)
        mine = x[own, f.feature[0][i]] > f.cut[0][i]
        got = sum(g[own][m].sum() ** 2 / (h[own][m].sum() + 1.0) for m in (mine, ~mine)) - g[own].sum() ** 2 / (h[own].sum() + 1.0)
        assert np.isclose(got, gain) and gain > 0
        node[own] = 2 * i + 1 + mine
    for leaf in range(4):
        own = node == leaf + 3
        assert np.isclose(f.value[0][leaf], 0.2 * g[own].sum() / (h[own].sum() + 1.0))
        assert np.allclose(f.raw(x[own]), f.base + f.value[0][leaf])


def test_isotonic_by_max_min():
    rng = np.random.default_rng(2)
    s = np.arange(12.0)
    y = (rng.random(12) < s / 12).astype(float)
    kx, ky = boosting.fit_isotonic(s, y)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert (np.diff(ky) > 0).all() and (np.diff(kx) > 0).all()
    at = np.searchsorted(np.cumsum([np.isclose(want, v).sum() for v in ky]), np.arange(12), "right")
    assert np.allclose(ky[at], want)


def test_features_by_hand():
    lx = toxicity.Lexicon(toxicity._hashes(["rotten"]), {4: toxicity._hashes([]), 5: np.zeros(0, np.uint64), 6: np.zeros(0, np.uint64)}, toxicity._hashes(["idiot"]), toxicity._hashes(["you"]))
    x = toxicity.features(pa.array(["you ARE a rotten idiot!", "1d10t", None, ""]), lx)
    learned, built, near, you, upper, bang = x[0, [0, 4, 6, 7, 8, 9]]
    assert np.allclose([learned, built, near, you], [1 / 5, 1 / 5, 2 / 5, 1 / 5]) and np.isclose(upper, 3 / 18) and np.isclose(bang, 1 / 23)
    assert np.isclose(x[1, 11], 1.0) and not x[2].any() and not x[3].any()


def test_lexicon_by_brute_force(spark):
    bad = [f"foul words number{i} zork" for i in range(9)] + ["zork foul words number0"]
    good = [f"kind words number{i}" for i in range(60)]
    docs = frame(spark, bad + good + bad[:1] * 5)
    labels = spark.createDataFrame([(i, int(i < 10 or i >= 70)) for i in range(75)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, 1000)
    assert rows.count() == 70  # equal texts once
    got = rows.collect()
    texts = np.zeros((2, toxicity.FOLDS), np.int64)
    for r in got:
        texts[r["y"], r["fold"]] += 1
    assert (texts.max(1) - texts.min(1) <= 1).all()
    counts = toxicity.word_counts(rows)
    vocabulary = sorted({w for t in bad + good for w in t.split()})
    for without in (None, 0, 3):
        want = set()
        for w in vocabulary:
            t = sum(w in r["text"].split() for r in got if r["y"] and r["fold"] != without)
            c = sum(w in r["text"].split() for r in got if not r["y"] and r["fold"] != without)
            nb, ng = (sum(r["y"] == y and r["fold"] != without for r in got) for y in (1, 0))
            if t >= 3 and t / nb >= 15 * (c + 0.5) / ng:
                want.add(w)
        lx = toxicity.learn_lexicon(counts, texts, without)
        assert lx.words.tolist() == toxicity._hashes(sorted(want)).tolist() and {"foul", "zork"} <= want


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    got = toxicity.score(docs, toxicity.fit(docs, labels.where(part > 0))).join(labels.where(part == 0).selectExpr("doc_id", "toxic AS y"), "doc_id").select("toxic", "y").toPandas()
    hit = int(((got.toxic == 1) & (got.y == 1)).sum())
    assert hit >= 0.85 * (got.y == 1).sum() and hit >= 0.95 * (got.toxic == 1).sum(), got.value_counts()


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (4, None)] + [(10 + i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts = ["you rotten fool " * 3 if i % 2 else "a calm sentence" for i in range(40)]
    docs = frame(spark, [*texts, None, "", "you rotten fool", "word " * 100_000, "you rotten fool", "you rotten fool"], [*range(10, 50), 60, 61, None, 63, 64, 64])
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 46 and all(r["score"] is not None for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[60]["score"] == by[61]["score"] and by[60]["toxic"] == 0 and by[64]["score"] == by[None]["score"]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["toxic"] == 0}
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.drop_toxic(docs.limit(0), model).count() == 0
    for some, share in ((labels.where("toxic = 1"), 0.49), (labels.limit(0), 0.0)):
        assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {share}
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).where("toxic = 1").count() == 0
