"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of a text.

Each class has a mean and a covariance, shrunk towards the pooled one (the more, the fewer rows it has) and towards a multiple of the identity; the score is
the difference of the two log densities (Mahalanobis distance and log determinant from a Cholesky factor that is computed
once) plus that of the log priors. The moments are sums over all labelled rows, so the fit has no sample.

Defined results: null and empty texts have the statistics of a text without characters; repeated rows each get a score;
null doc_ids keep their rows; labels that are null or contradict each other aren't used; with fewer than two classes the
score is 0 and quality 1 (nothing is rejected). Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import textkernel as K
from quirefold.llm.common import map_batches, written

NAMES = ["chars", "words", "word_len", "upper", "digit", "punct", "symbol", "space", "distinct", "repeat", "line_len", "line_repeat", "end_marks"]
_UPPER, _DIGIT = K.classes("ABCDEFGHIJKLMNOPQRSTUVWXYZ", False), K.classes("0123456789", False)
_PUNCT, _SYMBOL, _END = K.classes(".,;:!?'\"()-", False), K.classes("#$%&*+/<=>@[\\]^_`{|}~!", False), K.classes(".?!", False)
_LETTER = K.classes(K.LETTERS, True)
_LINE = ~K.classes("\n", False)


def statistics(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(NAMES))), *(_statistics(texts.slice(a, b - a)) for a, b in K.slices(texts))])


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in each text, and the largest count of one."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=n), most


def _statistics(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    raw, at = K.buffers(texts)
    w = K.words(raw, at, K.NONSPACE[raw])
    count = np.bincount(w.doc, minlength=n)
    letters, size = np.maximum(K.total(_LETTER[raw], at), 1), np.maximum(np.diff(at), 1)
    distinct, most = _repeats(w.hashes(), w.doc, n)
    lines = K.words(raw, at, _LINE[raw])
    rows = np.bincount(lines.doc, minlength=n)
    lines_distinct, _ = _repeats(lines.hashes(), lines.doc, n)
    c = np.maximum(count, 1)
    share = lambda cls, of: np.sqrt(K.total(cls[raw], at) / of)
    return np.stack(
        [
            np.log1p(np.diff(at)), np.log1p(count), np.log1p(size / c), share(_UPPER, letters), share(_DIGIT, size), share(_PUNCT, size), share(_SYMBOL, size), share(~K.NONSPACE, size),
            np.log1p(distinct) / np.log1p(c), np.sqrt(most / c), np.log1p(size / np.maximum(rows, 1)), np.sqrt(1 - lines_distinct / np.maximum(rows, 1)), np.sqrt(K.total(_END[raw], at) / c),
        ],
        1,
    ).astype(float)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and one double for each of NAMES."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c) for c in x.T)], ["doc_id", *NAMES])

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, " + ", ".join(f"{c} double" for c in NAMES))


@dataclass
class Model:
    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors
    consts: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        dens = [k - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, k in zip(self.means, self.factors, self.consts, strict=True)]
        return dens[1] - dens[0]


def from_moments(n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_pooled: float = 0.1, to_identity: float = 0.05) -> Model:
    """n: rows of each class; s, ss: their sums of x and of its outer products."""
    means = s / n[:, None]
    cov = ss / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    d = len(pooled)
    factors, consts = [], []
    for k in range(2):
        weight = max(to_pooled, d / (d + n[k]))  # a class of few rows leans on the pooled covariance
        c = (1 - weight) * cov[k] + weight * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        consts.append(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum())
    return Model(means, np.array(factors), np.array(consts))


def fit(described: DataFrame, labels: DataFrame) -> Model | None:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__a"), F.max("quality").alias("__b")).where("__a = __b")
    rows = described.join(known.select("doc_id", F.col("__a").alias("__y")), "doc_id")
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    # 100 sums of products would be too long for generated code as single columns: they are elements of arrays, summed by position
    terms = F.array(F.lit(1.0), *[F.col(c) for c in NAMES], *[F.col(NAMES[i]) * F.col(NAMES[j]) for i, j in pairs])
    sums = rows.where("__y IN (0, 1)").select("__y", F.posexplode(terms).alias("p", "v")).groupBy("__y", "p").agg(F.sum("v").alias("v")).collect()
    got = np.zeros((2, 1 + d + len(pairs)))
    for r in sums:
        got[r["__y"], r["p"]] = r["v"]
    if not got[:, 0].all():
        return None
    ss = np.zeros((2, d, d))
    for (i, j), v in zip(pairs, got[:, 1 + d :].T, strict=True):
        ss[:, i, j] = ss[:, j, i] = v
    return from_moments(got[:, 0], got[:, 1 : 1 + d], ss)


def score(described: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (above 0: good) and quality (1 or 0) for every row."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([pc.cast(b.column(1 + i), pa.float64()).to_numpy(zero_copy_only=False) for i in range(len(NAMES))], 1)
        s = model.score(x) if model else np.zeros(len(x))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0).astype(np.int32))], ["doc_id", "score", "quality"])

    return map_batches(described.select("doc_id", *NAMES), each, "doc_id long, score double, quality int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    described = written(describe(docs), "statistics")  # read twice: by the fit and by the scores
    return score(described, fit(described, labels))
