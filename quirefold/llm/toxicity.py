"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities of lexicon words (a small built-in list, and words and word beginnings learned from the
labelled rows), how near they stand to a second-person pronoun, capitals, punctuation, and rates of obfuscated spellings.

Defined results: a text with all features at 0 (null and empty ones too) shows nothing toxic: its score is what the model gives
such a row, but never more than the share of toxic labels, and it isn't rejected; repeated rows each get the same score; a null doc_id keeps its row; without labelled rows of both classes the score is the share of
toxic labels (0 with none) and nothing is rejected; an empty table gives an empty result. Labels that are null, or whose
doc_id is null or labelled both ways, aren't used; equal texts of one label count once in the fit; rows that share a doc_id are all
labelled by it. Only doc_id and text are read; all other columns pass through as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm import boosting
from quirefold.llm import textkernel as K
from quirefold.llm.common import map_batches, spread_sample, written

INSULTS = (
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool ugly hate imbecile jerk garbage "
    "dumm trottel abschaum versager arschloch ekelhaft widerlich blöd schwachkopf imbécile crétin abruti connard minable "
    "dégoûtant débile ordure idiota imbécil estúpido basura asqueroso inútil patético payaso tonto"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú usted ustedes ti tus vosotros".split()
MAX_TRAIN_ROWS, NEAR_WORDS, FOLDS = 8000, 6, 4
PREFIXES = (4, 5, 6)
_LEET = np.arange(256, dtype=np.uint8)
for a, b in zip(b"0134578@$!", b"oieastbasi", strict=True):
    _LEET[a] = b
_LETTER = K.classes(K.LETTERS, True)
_LEETED = _LETTER[_LEET]
_UPPER, _DIGIT = K.classes("ABCDEFGHIJKLMNOPQRSTUVWXYZ", False), K.classes("0123456789", False)
_PUNCT = ~(K.WORD | ~K.NONSPACE)
N_FEATURES = 13


@dataclass
class Lexicon:
    words: np.ndarray
    prefixes: dict[int, np.ndarray]
    built_in: np.ndarray
    you: np.ndarray


@dataclass
class Model:
    lexicon: Lexicon
    forest: boosting.Forest | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float
    cut: float = 0.5

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.forest is None:
            return np.full(len(texts), self.prior)
        x = features(texts, self.lexicon)
        raw = self.forest.raw(x)
        out = np.interp(raw, *self.knots) if self.knots else 1 / (1 + np.exp(-raw))
        return np.where(x.any(1), out, np.minimum(out, min(self.prior, 0.49)))


def _hashes(texts: list[str]) -> np.ndarray:
    return np.unique(np.array([K.hash_word(t) for t in texts], np.uint64))


def _near(hits: np.ndarray, marks: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which hits (indices of words) have a mark within NEAR_WORDS words in the same text."""
    if not len(marks):
        return np.zeros(len(hits), bool)
    after = np.minimum(np.searchsorted(marks, hits), len(marks) - 1)
    out = np.zeros(len(hits), bool)
    for at in (after, np.maximum(after - 1, 0)):
        out |= (np.abs(marks[at] - hits) <= NEAR_WORDS) & (doc[marks[at]] == doc[hits])
    return out


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    return np.concatenate([np.zeros((0, N_FEATURES)), *(_features(texts.slice(a, b - a), lexicon) for a, b in K.slices(texts, K.SMALL_SLICE_BYTES))])


def _features(texts: pa.Array, lx: Lexicon) -> np.ndarray:
    n = len(texts)
    raw, at = K.buffers(texts)
    low, off = K.buffers(pc.utf8_lower(texts))
    w = K.words(low, off)
    h = w.hashes()
    per = lambda idx: np.bincount(w.doc[idx], minlength=n)
    count = np.bincount(w.doc, minlength=n)
    learned, built = K.member(h, lx.words), K.member(h, lx.built_in)
    begins = np.zeros(len(h), bool)
    for k, known in lx.prefixes.items():
        if len(known):
            begins |= K.member(w.prefixes(k), known)
    hit, you = np.flatnonzero(learned | built | begins), np.flatnonzero(K.member(h, lx.you))
    # obfuscation: the letters of each run between spaces, digits and signs read as the letters they stand for
    letters = _LEETED[low]
    rank = np.zeros(len(low) + 1, np.int64)
    np.cumsum(letters, out=rank[1:])
    p, inv = K.powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(np.where(letters, (_LEET[low].astype(np.uint64) + np.uint64(1)) * p[rank[:-1]], np.uint64(0)), out=sums[1:])
    s, e, token = K.runs(K.NONSPACE[low], off)
    odd = (rank[e] - rank[s] < e - s) | (_DIGIT[low[s]] if len(s) else False)
    digits = np.zeros(len(low) + 1, np.int64)
    np.cumsum(_DIGIT[low], out=digits[1:])
    odd |= digits[e] > digits[s]
    s, e, token = s[odd], e[odd], token[odd]
    plain = K.mix((sums[e] - sums[s]) * inv[rank[s]] + (rank[e] - rank[s]).astype(np.uint64))
    masked = np.bincount(token[K.member(plain, lx.words) | K.member(plain, lx.built_in)], minlength=n)
    seen = np.bincount(np.searchsorted(off, w.starts[learned | built], "right") - 1, minlength=n)
    mixed = (digits[w.ends] > digits[w.starts]) & (digits[w.ends] - digits[w.starts] < w.ends - w.starts)
    size, c = np.maximum(np.diff(at), 1), np.maximum(count, 1)
    lead = K.total(_LETTER[raw], at)
    hits = per(hit)
    return np.stack(
        [
            per(np.flatnonzero(learned)) / c, np.log1p(per(np.flatnonzero(learned))), per(np.flatnonzero(begins)) / c, np.log1p(per(np.flatnonzero(begins))),
            per(np.flatnonzero(built)) / c, np.log1p(hits), per(hit[_near(hit, you, w.doc)]) / c, per(you) / c, K.total(_UPPER[raw], at) / np.maximum(lead, 1),
            K.total(raw == ord("!"), at) / size, K.total(_PUNCT[raw], at) / size, np.maximum(masked - seen, 0) / c, per(np.flatnonzero(mixed)) / c,
        ],
        1,
    ).astype(float)


def _distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new].astype(np.int32), value[new]


def contents(texts: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The distinct words (0) and word beginnings (by length) of each text, as text number and hash."""
    parts: dict[int, list] = {k: [] for k in (0, *PREFIXES)}
    for a, z in K.slices(texts, K.SMALL_SLICE_BYTES):
        low, off = K.buffers(pc.utf8_lower(texts.slice(a, z - a)))
        w = K.words(low, off)
        for k, found in parts.items():
            v = w.prefixes(k) if k else w.hashes()
            found.append(_distinct(w.doc[v != 0] + a, v[v != 0]))
    return {k: tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, np.uint64)) for k, found in parts.items()}


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """h, y, fold, text: the distinct texts of at most max_rows labelled rows, each class dealt evenly over the folds."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("__a"), F.max("toxic").alias("__b")).where("__a = __b")
    chosen = spread_sample(known.select("doc_id", F.lit(1).alias("__one")), "doc_id", "__one", max_rows)
    chosen = chosen.join(known, chosen["__key"] == known["doc_id"]).select("__key", (F.col("__a") != 0).cast("int").alias("__toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__key"))
    rows = rows.select(F.xxhash64("text").alias("h"), F.col("__toxic").alias("y"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["h", "y"])
    rows = written(rows, "labelled-texts")
    folds = rows.select("h", "y").withColumn("fold", (F.row_number().over(Window.partitionBy("y").orderBy("h")) % FOLDS).cast("int"))  # max_rows rows at most
    return rows.join(F.broadcast(folds), ["h", "y"]).select("h", "y", "fold", "text")


def word_counts(rows: DataFrame, least: int = 3) -> pa.Table:
    """kind (0: words, else the length of the beginning), value, and in how many clean (c0, ...) and toxic (t0, ...) texts of each fold; those in `least` toxic texts."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        y, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        kinds, docs, values = zip(*((np.full(len(d), k, np.int32), d, v) for k, (d, v) in contents(b.column(2)).items()), strict=True)
        doc = np.concatenate(docs)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(values).view(np.int64)), pa.array((fold[doc] + FOLDS * y[doc]).astype(np.int32))], ["kind", "value", "part"])

    found = map_batches(rows.select("y", "fold", "text"), each, "kind int, value long, part int")
    parts = [F.count_if(F.col("part") == i).alias(f"{'ct'[i // FOLDS]}{i % FOLDS}") for i in range(2 * FOLDS)]
    counted = found.groupBy("kind", "value").agg(*parts)
    return counted.where(sum((F.col(f"t{i}") for i in range(1, FOLDS)), F.col("t0")) >= least).toArrow()


def learn_lexicon(counts: pa.Table, texts: np.ndarray, without: int | None = None, ratio: float = 15.0, least: int = 3) -> Lexicon:
    """Words and word beginnings in at least `least` toxic texts, `ratio` times as frequent there as in the others; texts: how many of each class (row) and fold.

    without: a fold whose texts don't count.
    """
    use = [i for i in range(FOLDS) if i != without]
    clean, toxic = (sum((counts[f"{c}{i}"].to_numpy() for i in use), np.zeros(counts.num_rows, np.int64)) for c in "ct")
    good, bad = (max(int(t[use].sum()), 1) for t in texts)
    keep = (toxic >= least) & (toxic / bad >= ratio * (clean + 0.5) / good)
    kind, value = counts["kind"].to_numpy()[keep], counts["value"].to_numpy()[keep].view(np.uint64)
    return Lexicon(np.sort(value[kind == 0]), {k: np.sort(value[kind == k]) for k in PREFIXES}, _hashes(INSULTS), _hashes(SECOND_PERSON))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fits on the distinct texts of at most max_rows labelled rows (the smallest hashes of doc_id), whole texts of any length.

    The lexicon comes from all of them; the trees are fitted to features from lexicons of the other folds, and the fold that
    they don't see gives the calibration. Words are counted and features made on the executors; the driver gets the words that
    enough toxic texts share, and N_FEATURES numbers a text.
    """
    rows = labelled(docs, labels, max_rows)
    texts = np.zeros((2, FOLDS), np.int64)
    for r in rows.groupBy("y", "fold").agg(F.count("*").alias("n")).collect():
        texts[r["y"], r["fold"]] = r["n"]
    if not texts.sum(1).all():
        prior = texts[1].sum() / max(texts.sum(), 1)
        return Model(Lexicon(np.zeros(0, np.uint64), {}, _hashes(INSULTS), _hashes(SECOND_PERSON)), None, None, min(float(prior), 0.49))
    counts = word_counts(rows)
    lexicons = [learn_lexicon(counts, texts, k) for k in range(FOLDS)]  # the trees see each text through a lexicon that was learned without it

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        fold = b.column(2).to_numpy(zero_copy_only=False)
        x = np.zeros((b.num_rows, N_FEATURES))
        for k in np.unique(fold):
            own = np.flatnonzero(fold == k)
            x[own] = features(b.column(3).take(pa.array(own)), lexicons[k])
        return pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c) for c in x.T)], ["h", "y", "fold", *(f"x{i}" for i in range(N_FEATURES))])

    got = map_batches(rows, each, "h long, y int, fold int, " + ", ".join(f"x{i} double" for i in range(N_FEATURES))).toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[("h", "ascending"), ("y", "ascending")]))
    x, y = np.stack([got[f"x{i}"].to_numpy() for i in range(N_FEATURES)], 1), got["y"].to_numpy().astype(bool)
    held = got["fold"].to_numpy() == 0
    trees = ~held if 0 < y[~held].sum() < (~held).sum() and 0 < y[held].sum() < held.sum() else held | True
    forest = boosting.fit_forest(x[trees], y[trees].astype(float))
    held = held if not trees.all() else trees
    return Model(learn_lexicon(counts, texts), forest, boosting.fit_isotonic(forest.raw(x[held]), y[held].astype(float)), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (calibrated probability) and toxic (1 from model.cut on) for every row."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= model.cut).astype(np.int32))], ["doc_id", "score", "toxic"])

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, score double, toxic int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model doesn't reject, with all their columns."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(model.score(b.column(b.schema.names.index("text"))) < model.cut))

    return map_batches(docs, each, docs.schema)
