"""The corpus operators against brute force, round trips, held-out accuracy and the cases that their docstrings define."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import bpe, language, lines, packing, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, __row string, __id string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [None, "", " \n\t", "one two three four five six seven eight nine", "one two three four five six seven eight nine", "é" * 70, "word " * 30_000]


def test_language_phrases_by_brute_force():
    m = language.build({"a": "abracadabra cadabra", "b": "banana bandana"})
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdnr z") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    got, _ = m.phrases(texts)
    for t, row in zip(texts, got, strict=True):
        t = " ".join(t.split()) + (" " if t.strip() and t[-1] == " " else "")
        for i, train in enumerate(("abracadabra cadabra", "banana bandana")):
            n, cur = 0, ""
            for ch in t:
                if cur + ch in train:
                    cur += ch
                else:
                    n, cur = n + 1, ch if ch in train else ""
            assert row[i] == n + bool(cur), (t, train)


def test_language_of_any_script(spark):
    rng = random.Random(6)
    scripts = {"zh": (0x4E00, 3000), "ko": (0xAC00, 2000), "ja": (0x3041, 80), "ru": (0x430, 32), "el": (0x3B1, 24), "ar": (0x627, 30), "en": (0x61, 26), "got": (0x10330, 20)}
    words = {lang: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randint(1, 5))) for _ in range(300)] for lang, (a, n) in scripts.items()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    m = language.build({lang: text(lang, 100 if lang == "en" else 600) for lang in scripts})
    want = [lang for lang in scripts for _ in range(3)]
    texts = [text(lang, 40) for lang in want]
    got = language.identify(frame(spark, [*texts, "。、🙂 12"]), m).orderBy("doc_id").collect()
    assert [r["predicted"] for r in got] == [*want, None]


def test_language_accuracy(docs):
    got = language.identify(docs, language.fit(docs, texts=5)).join(docs.select("doc_id", "lang"), "doc_id").where(F.length("predicted") > 0)
    assert got.where("predicted = lang").count() >= 0.98 * got.count()


def test_bpe_equals_a_reference(docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(bpe.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r["text"] for r in docs.select("text").limit(40).collect()] + ["日本語 ünï 🙂🙂 123 don't", "a" * 500, "xyz" * 200]
    c = bpe.Codec(open(bpe.VOCABULARY, "rb").read())
    tokens, off = c.encode(texts)
    for t, a, b in zip(texts, off, off[1:], strict=False):
        assert tokens[a:b].tolist() == enc.encode_ordinary(t)
        assert c.decode(tokens[a:b]).decode() == t


def test_lines_by_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(7, 12))] for _ in range(12)]
    texts = []
    base += [["Short"], ["two", "words"], [], ["three", "short", "words"]]
    for _ in range(25):
        ls = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(base))
            if len(w) < 4:
                ls.append(" ".join(w))
                continue
            how = rng.randint(0, 3)
            if how == 1:
                w[rng.randrange(len(w))] = "other"
            elif how == 2:
                del w[rng.randrange(len(w))]
            elif how == 3:
                w.insert(rng.randint(0, len(w)), "more")
            ls.append(" ".join(w))
        texts.append("\n".join(ls))
    want, before = [], []
    for d, t in enumerate(texts):
        keep = []
        for no, line in enumerate(t.split("\n")):
            w = lines.normal(line)
            near = lambda v, w=w: min(len(v), len(w)) >= lines.EDIT_WORDS and lines.within_one(v, w)
            if not w or not any(v == w or near(v) for v in before):
                keep.append(line)
            before.append(w)
        want.append("\n".join(keep))
    got = {r["doc_id"]: r["text"] for r in lines.drop_lines(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_simhash_by_brute_force(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    hi, lo, ok = simhash.signature(pa.array([r["text"] for r in rows]))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    sig = np.stack([hi, lo], 1)
    for i in range(len(rows)):
        for j in np.flatnonzero(simhash._distance(sig[i][None], sig) <= simhash.MAX_BITS):
            if ok[i] and ok[j]:
                a, b = sorted((root(i), root(int(j))))
                group[b] = a
    want = {rows[i]["doc_id"]: rows[root(i)]["doc_id"] for i in range(len(rows)) if root(i) != i}
    assert {r["doc_id"]: r["duplicate_of"] for r in simhash.duplicates(docs).collect()} == want and want


def test_simhash_long_runs():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, (3, 2), dtype=np.uint64)
    sig = np.repeat(centre, 80, 0)
    for row in sig:
        for bit in rng.integers(0, 64, 4):
            row[0] ^= np.uint64(1) << np.uint64(bit)
    a, b = simhash.edges_of(np.zeros(240, np.int64), np.arange(240), sig, 15)
    seen = list(range(240))
    for x, y in zip(a, b, strict=True):
        old, new = seen[y], seen[x]
        seen = [new if s == old else s for s in seen]
    assert len(set(seen)) == 3


def test_nnls_by_every_active_set():
    rng = np.random.default_rng(7)
    for _ in range(20):
        a, b = rng.integers(0, 3, (4, 5)).astype(float), rng.integers(0, 9, 4).astype(float)
        best = np.inf
        for mask in range(1 << 5):
            own = [j for j in range(5) if mask >> j & 1]
            x = np.linalg.lstsq(a[:, own], b, rcond=None)[0] if own else np.zeros(0)
            if (x >= -1e-9).all():
                best = min(best, np.linalg.norm(a[:, own] @ x - b))
        x = packing.nnls(a, b)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= best + 1e-6


def test_combinations_are_all():
    bins = np.array([2, 3, 5, 6, 10])
    want = {tuple(sorted(c, reverse=True)) for n in (1, 2, 3) for c in itertools.product(bins.tolist(), repeat=n) if sum(c) == 10}
    assert set(packing.combinations(bins, 10, 3)) == want


def test_packing_needs_few_windows():
    """Never more windows than greedy packing alone, and at most one in twenty above what the tokens fill, where bins can fill a window."""
    rng = random.Random(9)
    sizes = Counter(rng.randint(1, 128) for _ in range(3000))
    plan = packing.solve(dict(sizes))
    used = Counter()
    for combo, n in zip(plan.combos, plan.times, strict=True):
        assert sum(combo) <= 128
        for b in combo:
            used[b] += n
    assert used == sizes
    assert plan.windows <= 1.05 * sum(b * n for b, n in sizes.items()) / 128 + 1


def test_packing_full_windows_and_shards(spark):
    counts = [(None, 5000), (1, 0), (2, 2048), (3, 1), (4, 4096), (4, 4096), (5, 100), (5, 100), (6, None)]
    df = spark.createDataFrame([(i, n, "x") for i, n in counts], "doc_id long, tokens long, shard string")
    rows = packing.pack(df, shard_rows=1).collect()
    places = [(r["window_id"], r["slot"]) for r in rows]
    assert len(set(places)) == len(places) and sorted({w for w, _ in places}) == list(range(max(w for w, _ in places) + 1))
    per_doc, per_window = Counter(), Counter()
    for r in rows:
        per_doc[r["doc_id"]] += r["tokens"]
        per_window[r["window_id"]] += r["tokens"]
    assert per_doc == {None: 5000, 2: 2048, 3: 1, 4: 8192, 5: 200} and max(per_window.values()) <= packing.WINDOW
    assert packing.pack(df.limit(0)).count() == 0


def test_nnls_and_plan():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = packing.nnls(a, np.array([3.0, 2.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 2])
    plan = packing.solve({64: 10, 100: 7, 28: 7, 5: 3})
    used = {}
    for combo, n in zip(plan.combos, plan.times, strict=True):
        assert sum(combo) <= packing.WINDOW // packing.STEP
        for b in combo:
            used[b] = used.get(b, 0) + n
    assert used == {64: 10, 100: 7, 28: 7, 5: 3}


def test_packing_places_every_token_once(docs):
    rows = packing.pack(packing.token_counts(docs)).toPandas()
    assert not rows.duplicated(["window_id", "slot"]).any() and not rows.duplicated(["doc_id", "start"]).any()
    assert rows.groupby("window_id").tokens.sum().max() <= packing.WINDOW
    want = {r["doc_id"]: len(r["text"].split()) + 1 for r in docs.collect() if r["text"].split()}
    assert rows.groupby("doc_id").tokens.sum().to_dict() == want


def test_packing_counts_bpe_tokens(spark, docs):
    from quirefold.llm import queries

    rows = queries.op8_packing(spark, SF).toPandas()
    assert not rows.duplicated(["window_id", "slot"]).any() and rows.groupby("window_id").tokens.sum().max() <= packing.WINDOW
    want = {r["doc_id"]: len(r["tokens"]) + 1 for r in bpe.encode(docs).collect() if r["tokens"]}
    assert rows.groupby("doc_id").tokens.sum().to_dict() == want
    odd = frame(spark, [*ODD, "漢字" * 3000])
    want = {r["doc_id"]: len(r["tokens"]) + 1 for r in bpe.encode(odd).collect() if r["tokens"]}
    got = packing.pack(packing.bpe_counts(odd)).toPandas()
    assert got.groupby("doc_id").tokens.sum().to_dict() == want and (got.doc_id == len(ODD)).sum() > 1




def test_simhash_work_on_long_runs(spark, monkeypatch):
    """A long run of texts that aren't alike takes a step for each block, not for each text; copies take no edge for each pair."""
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    sig[2990] = sig[7] ^ np.array([5, 9], np.uint64)
    steps, distance = [], simhash._distance
    monkeypatch.setattr(simhash, "_distance", lambda a, b: (steps.append(1), distance(a, b))[1])
    a, b = simhash.edges_of(np.zeros(3000, np.int64), np.arange(3000), sig, 15)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(7, 2990)} and len(steps) < 300
    near = [(3, i, 77, 1 << i) for i in range(40)]
    edges = simhash.near_edges(spark.createDataFrame(near, "key long, node long, hi long, lo long")).collect()
    assert {x for r in edges for x in r} == set(range(40)) and len(edges) < 80


def test_simhash_runs_by_brute_force():
    rng = np.random.default_rng(9)
    size = [1, 2, 5, 40, 100, 159, 160, 161, 400, 900]
    key = np.repeat(np.arange(len(size)), size)
    sig = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)[rng.integers(0, 60, len(key))]
    for row in sig:
        for bit in rng.integers(0, 64, 8):
            row[bit % 2] ^= np.uint64(1) << np.uint64(bit)
    a, b = simhash.edges_of(key, np.arange(len(key)), sig, 15)
    want, got = np.arange(len(key)), np.arange(len(key))
    for i in range(len(key)):
        for j in np.flatnonzero((key == key[i]) & (simhash._distance(sig[i][None], sig) <= 15)):
            want[want == max(want[i], want[j])] = min(want[i], want[j])
    for i, j in zip(a, b, strict=True):
        assert key[i] == key[j]
        got[got == max(got[i], got[j])] = min(got[i], got[j])
    assert got.tolist() == want.tolist() and 60 < len(set(want.tolist())) < len(key)


def test_bpe_learns_words_side_by_side(monkeypatch):
    """Words of all lengths in one batch, no step for each word; the same tokens as one word at a time."""
    c = bpe.Codec(open(bpe.VOCABULARY, "rb").read())
    rng = np.random.default_rng(10)
    words = ["".join(rng.choice(list("etaoin shré中"), n)).replace(" ", "x") for n in [*range(1, 40), 64, 65, 200] * 4]
    monkeypatch.setattr(np, "split", None)
    tokens, ends = c.encode(words)
    for i, w in enumerate(words):
        want = [t for x in c.find(w) for t in c.merge_long(x.encode())]
        assert tokens[ends[i] : ends[i + 1]].tolist() == want
    assert c.counts(words).tolist() == np.diff(ends).tolist()
