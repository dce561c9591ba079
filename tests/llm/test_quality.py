"""Quality: densities by inverse and determinant, moments by hand, held-out recall and precision."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import quality

SCHEMA = "doc_id long, text string, score string, chars string, __y string"


def by_hand(x, y, z, to_pooled=0.1, to_identity=0.05):
    """Score of the rows of z by explicit inverses, from rows x with classes y."""
    d, n = x.shape[1], [int((y == k).sum()) for k in (0, 1)]
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    dens = []
    for k in (0, 1):
        w = max(to_pooled, d / (d + n[k]))
        c = (1 - w) * cov[k] + w * pooled
        c = (1 - to_identity) * c + to_identity * np.trace(c) / d * np.eye(d)
        diff = z - x[y == k].mean(0)
        dens.append(np.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ni,ij,nj->n", diff, np.linalg.inv(c), diff))
    return dens[1] - dens[0]


def test_scores_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.orderBy("doc_id").collect()
    x = quality.statistics(pa.array([r["text"] for r in rows]))
    of = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = np.array([r["doc_id"] in of for r in rows])
    y = np.array([of.get(r["doc_id"], 0) for r in rows])
    want = by_hand(x[known], y[known], x)
    got = quality.classify(docs, labels).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in got], want, rtol=1e-6, atol=1e-6)
    assert [r["quality"] for r in got] == (want >= 0).astype(int).tolist() and 0 < (want >= 0).sum() < len(want)


def test_statistics_by_hand():
    text = "One two. One\nOne two. One\n5 <b>!"
    x = dict(zip(quality.NAMES, quality.statistics(pa.array([text, None, ""]))[0], strict=True))
    words = text.split()
    letters = sum(c.isalpha() for c in text)
    assert np.isclose(x["chars"], np.log1p(len(text))) and np.isclose(x["words"], np.log1p(len(words)))
    assert np.isclose(x["upper"], np.sqrt(sum(c.isupper() for c in text) / letters)) and np.isclose(x["digit"], np.sqrt(1 / len(text)))
    assert np.isclose(x["distinct"], np.log1p(len(set(words))) / np.log1p(len(words))) and np.isclose(x["repeat"], np.sqrt(4 / len(words)))
    assert np.isclose(x["line_repeat"], np.sqrt(1 - 2 / 3)) and np.isclose(x["end_marks"], np.sqrt(3 / len(words)))
    empty = quality.statistics(pa.array([None, ""]))
    assert (empty[0] == empty[1]).all()


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string")) % 2
    described = quality.describe(docs)
    got = quality.score(described, quality.fit(described, labels.where(part == 0))).join(labels.where(part == 1).selectExpr("doc_id", "quality AS y"), "doc_id").select("quality", "y").toPandas()
    for k in (0, 1):
        hit = ((got.quality == k) & (got.y == k)).sum()
        assert hit >= 0.85 * (got.y == k).sum() and hit >= 0.85 * (got.quality == k).sum(), got.value_counts()


@pytest.mark.parametrize("some", ["all", "none", "one class"])
def test_odd_rows(spark, some):
    texts = [None, "", "a plain sentence of words.", "a plain sentence of words.", "### $$$ %%%", "word " * 100_000]
    ids = [None, 1, 2, 2, 3, 4]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in zip(ids, texts, strict=True)], SCHEMA)
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 1), (4, 0), (1, None), (None, 1)], "doc_id long, quality int")
    labels = {"all": labels, "none": labels.limit(0), "one class": labels.where("quality = 1")}[some]
    got = quality.classify(docs, labels).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 2, 2, 3, 4] and all(r["score"] is not None for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["score"] == by[1]["score"] and len({r["score"] for r in got if r["doc_id"] == 2}) == 1
    if some == "all":
        assert by[2]["quality"] == 1 and by[3]["quality"] == 0
    else:
        assert {(r["score"], r["quality"]) for r in got} == {(0.0, 1)}
    assert quality.classify(docs.limit(0), labels).count() == 0
