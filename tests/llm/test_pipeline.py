"""The pipeline's stages, each on what the one before kept, against plain Python."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quirefold.llm import bpe, common, lines, packing, pii, simhash, toxicity

SF = "/root/testdata/sf0.001"


def plain_line_dedup(rows):
    """Rows in order of doc_id; every line against all earlier ones."""
    seen, by_length, out = set(), {}, {}
    for r in rows:
        if r["doc_id"] is None or r["text"] is None:
            out[id(r)] = r["text"]
            continue
        keep = []
        for line in r["text"].split("\n"):
            w = tuple(lines.normal(line))
            if not w:
                keep.append(line)
                continue
            near = w in seen or any(min(len(v), len(w)) >= lines.EDIT_WORDS and lines.within_one(list(v), list(w)) for n in (-1, 0, 1) for v in by_length.get(len(w) + n, ()))
            if not near:
                keep.append(line)
            if w not in seen:
                seen.add(w)
                by_length.setdefault(len(w), []).append(w)
        out[id(r)] = "\n".join(keep)
    return out


def plain_keep_one(rows):
    hi, lo, ok = simhash.signature(pa.array([r["text"] for r in rows], pa.string()))
    sig, group = np.stack([hi, lo], 1), list(range(len(rows)))
    ok &= np.array([r["doc_id"] is not None for r in rows])

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in np.flatnonzero(ok):
        for j in np.flatnonzero(ok & (simhash._distance(sig[i][None], sig) <= simhash.MAX_BITS)):
            a, b = sorted((root(i), root(int(j))), key=lambda k: (rows[k]["doc_id"], k))
            group[b] = a
    return [r for i, r in enumerate(rows) if not ok[i] or rows[root(i)]["doc_id"] == r["doc_id"]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents, and rows of every odd kind."""
    path = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choice(words) for _ in range(300)) + " Mr. Smith, write to a.b@site.org"
    odd = [(9000, None), (9001, ""), (9002, "  \n"), (9003, text), (9004, text.replace("w7 ", "x7 ", 1)), (9005, text.replace(" ", "\n", 250)), (9006, "漢字" * 3000), (9007, "one\none\nOne"), (None, "a row without an id, of Mr. Jones"), (9008, "word " * 5000)]
    more = spark.createDataFrame([(i, t, "en", "odd", 0 if t is None else len(t)) for i, t in odd], docs.schema)
    docs.unionByName(more).coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_by_brute_force(spark, folder):
    spark.conf.set(pii.KEY_CONF, "a key for tests")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "pii", "packing"]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    rows = sorted((r.asDict() for r in docs.collect()), key=key)
    made = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            score = model.score(pa.array([r["text"] for r in rows], pa.string()))
            rows = [r for r, s in zip(rows, score, strict=True) if s < model.cut]
        elif name == "line_dedup":
            new = plain_line_dedup(rows)
            rows = [r | {"text": new[id(r)], "n_chars": r["n_chars"] if new[id(r)] is None else len(new[id(r)])} for r in rows]
        elif name == "simhash_near_dedup":
            rows = plain_keep_one(rows)
        else:
            new = [r["text"] and pii.replace(r["text"], b"a key for tests") for r in rows]
            rows = [r | {"text": t, "n_chars": r["n_chars"] if t is None else len(t)} for r, t in zip(rows, new, strict=True)]
        made = stage(spark, made, folder)
        assert made.columns == docs.columns
        made.write.parquet(f"{folder}/{name}")
        made = spark.read.parquet(f"{folder}/{name}")
        assert sorted((r.asDict() for r in made.collect()), key=key) == rows, name
        assert len(rows) > 50
    vocabulary = bpe.Codec(open(bpe.VOCABULARY, "rb").read())
    want = Counter()
    for r in rows:
        n = len(vocabulary.encode([r["text"] or ""])[0])
        want[r["doc_id"]] += n + 1 if n else 0
    out = corpus_pipeline.run(spark, folder).collect()
    got, windows = Counter(), Counter()
    for r in out:
        got[r["doc_id"]] += r["tokens"]
        windows[r["window_id"]] += r["tokens"]
    assert +got == +want and max(windows.values()) <= packing.WINDOW and len({(r["window_id"], r["slot"]) for r in out}) == len(out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["start"], r["tokens"]))
    for pieces in by.values():
        ends = [0]
        for start, tokens in sorted(pieces):
            assert start == ends[-1]
            ends.append(start + tokens)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert {9000, 9001, 9002, 9006, 9007, 9008, None} <= set(texts) and texts[9007] == "one" and "Jones" not in texts[None]
    spark.conf.unset(pii.KEY_CONF)


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_edges_grow_with_texts(spark, monkeypatch):
    """Of near copies all but one go, and what is written to find them is no pair of each two."""
    words = [f"word{i}" for i in range(60)]
    texts = [(i, " ".join([*words, f"own{i}"])) for i in range(45)]
    tables, kept = {}, simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: tables.setdefault(name, []).append(out := kept(df, name)) or out)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()] == [0]
    assert tables["edges"][0].count() < 45 * 5


def test_workers_hold_parts_of_a_batch(spark):
    """However large the Arrow batch, what is made of it at once is bounded, and every row comes through."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 900) AS text")
    sizes = common.map_batches(docs, lambda b: pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}), "rows long, size long").collect()
    assert sum(r["rows"] for r in sizes) == 3000 and max(r["size"] for r in sizes) < 2 * common.PART_BYTES
    texts = pa.array([f"You {i} are some w0rds, " * 60 for i in range(3000)])
    lexicon = toxicity.Lexicon(toxicity._hashes(["words"]), {}, toxicity._hashes(toxicity.INSULTS), toxicity._hashes(toxicity.SECOND_PERSON))
    toxicity.features(texts[:10], lexicon)
    tracemalloc.start()
    x = toxicity.features(texts, lexicon)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == 3000 and peak < 40e6, peak
    one = toxicity.features(texts[77:78], lexicon)
    assert (x[77] == one[0]).all()


def test_near_dedup_rounds_within_a_component(monkeypatch):
    """Rows that are known to be in one component aren't taken a few at a time, and every link to the others is found."""
    rng = np.random.default_rng(3)
    near = np.repeat(rng.integers(0, 1 << 63, (2, 2)).astype(np.uint64), [6000, 300], 0)
    for _ in range(3):
        near[np.arange(len(near)), rng.integers(0, 2, len(near))] ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    sig = rng.permutation(np.concatenate([near, rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64)]))
    rounds, distance = [], simhash._distance
    monkeypatch.setattr(simhash, "_distance", lambda a, b: rounds.append(len(a)) or distance(a, b))
    a, b = simhash._search(np.arange(len(sig)), sig, simhash.MAX_BITS)
    assert len(rounds) < 40, len(rounds)
    root = np.arange(len(sig))
    simhash.unite(root, a, b)
    want = np.arange(len(sig))
    for i in range(len(sig)):
        j = np.flatnonzero(distance(sig[i][None], sig) <= simhash.MAX_BITS)
        simhash.unite(want, np.full(len(j), i), j)
    assert (root == want).all() and len(np.unique(root)) == 42
