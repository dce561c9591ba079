"""Fingerprints: each step against a plain version."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quirefold.llm import fingerprint as fp
from quirefold.llm import textkernel as K

SF = "/root/testdata/sf0.001"


def level(window):
    s = sum(int(fp._NLOGN[n]) for n in Counter(window).values())
    e = 6 * fp.WINDOW * fp.SCALE - s
    return min(max(e * fp.LEVELS // (6 * fp.WINDOW * fp.SCALE + 1), 0), fp.LEVELS - 1)


def chosen(data, ranks):
    """Starts of the features of one text, window by window."""
    n = len(data) - fp.WINDOW + 1
    rank = [int(ranks[level(data[i : i + fp.WINDOW])]) for i in range(n)]
    hits = Counter()
    for a in range(max(n - fp.POPULAR + 1, 1) if n > 0 else 0):
        some = [(rank[i], i) for i in range(a, min(a + fp.POPULAR, n)) if rank[i]]
        if some:
            hits[min(some)[1]] += 1
    return sorted(i for i, k in hits.items() if k >= fp.LEAST or n < fp.POPULAR + fp.LEAST)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    some = ["".join(rng.choice("abcdefgh  nop") for _ in range(n)) for n in (0, 10, 63, 64, 65, 100, 130, 200, 700)]
    return [*some, "a" * 300, some[8][:300] + "changed" + some[8][300:]]


def test_levels(texts):
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        assert fp.levels(data).tolist() == [level(t.encode()[i : i + fp.WINDOW]) for i in range(len(t) - fp.WINDOW + 1)]


def test_selection_and_filters(texts):
    counts = Counter(level(t.encode()[i : i + fp.WINDOW]) for t in texts for i in range(len(t) - fp.WINDOW + 1))
    ranks = fp.ranks_of(counts)
    data, off = K.buffers(pa.array(texts))
    doc, h = fp.features(data, off, ranks)
    made = fp.filters(doc, h, len(texts))
    for i, t in enumerate(texts):
        want = chosen(t.encode(), ranks)
        own = h[doc == i]
        assert len(own) == len(want), i
        same = {t[a : a + fp.WINDOW] for a in want}
        assert len(set(own.tolist())) == len(same)
        bits = []
        for nth, x in enumerate(own.tolist()):
            if nth % fp.FILL == 0:
                bits.append(set())
            bits[-1] |= {(x >> 11 * k) % fp.BLOOM for k in range(fp.HASHES)}
        got = np.unpackbits(np.frombuffer(made[i], np.uint8)).reshape(-1, fp.BLOOM)
        assert [set(np.flatnonzero(row).tolist()) for row in got] == bits


def test_ranks_are_over_all_texts(spark, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    counts = Counter(level(t.encode()[i : i + fp.WINDOW]) for t in texts for i in range(len(t) - fp.WINDOW + 1))
    assert fp.level_ranks(df).tolist() == fp.ranks_of(counts).tolist()


def test_compare(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r["text"] for r in docs.where("n_chars > 3000").orderBy("doc_id").limit(6).collect()]
    ranks = fp.level_ranks(docs)

    def digest(t):
        data, off = K.buffers(pa.array([t]))
        return fp.filters(*fp.features(data, off, ranks), 1)[0]

    d = [digest(t) for t in texts]
    assert fp.compare(d[0], d[0]) == 1.0
    assert fp.compare(d[0], digest(texts[0][:1500] + " changed " + texts[0][1500:])) > 0.6
    assert fp.compare(d[0], b"") == 0.0 and fp.compare(d[0], d[1]) < 0.3


def test_matches_by_brute_force(spark):
    rng = random.Random(4)
    sets = {i: {rng.randrange(60) for _ in range(rng.randint(0, 25))} for i in range(80)}
    sets |= {80: sets[7], 81: sets[7], 82: sets[3] | sets[4], 83: {1000, 1001}, 84: {1001, 1000}, 85: {2000}, 86: {1000, 1001, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12}}
    sets |= {100 + i: set(range(5000, 5010)) | {6000 + i, 7000 + i % 9} for i in range(40)}  # a passage that many share
    made = spark.createDataFrame([(i, sorted(s, key=lambda x: (x * 7919 + i) % 1009) + sorted(s)[:1]) for i, s in sets.items()] + [(None, [1, 2]), (7, sorted(sets[7]))], "doc_id long, features array<long>")
    want = {}
    for i, a in sets.items():
        found = [(-len(a & b) / len(a | b), j) for j, b in sets.items() if j != i and len(a & b) >= fp.ALIKE * len(a | b) > 0]
        if found:
            want[i] = min(found)[1]
    assert {r["id"]: r["match"] for r in fp.matches(made).collect()} == want
    assert want[7] == 80 and want[80] == 7 and want[83] == 84 and 85 not in want and want[109] == 100


def test_odd_rows(spark):
    text = open(__file__).read()
    rows = [(None, text), (1, None), (2, ""), (3, "short"), (4, text), (4, text), (5, text), (6, "é" * 70), (7, text * 300)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, match string, filters string")
    got = fp.fingerprints(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (1, 2, 3):
        assert (by[i][0]["n_features"], bytes(by[i][0]["filters"]), by[i][0]["match"], by[i][0]["score"]) == (0, b"", None, None)
    assert by[4][0] == by[4][1] and by[4][0]["match"] == 5 and by[5][0]["match"] == 4 and by[5][0]["score"] == 1.0
    assert by[None][0]["n_features"] == by[4][0]["n_features"] > 0 and by[None][0]["match"] is None
    assert by[7][0]["n_features"] > 250 * by[4][0]["n_features"]
    assert fp.fingerprints(df.limit(0)).count() == 0


def test_links_by_brute_force(spark):
    """Every link counts, also that of the third copy, of a passage many share, and of documents with several texts."""
    rng = random.Random(6)
    rows = [(i, {rng.randrange(50) for _ in range(rng.randint(1, 20))}) for i in range(70)]
    rows += [(80 + i, set(range(500, 512)) | {600 + i, 700 + i % 5}) for i in range(60)]
    rows += [(150, rows[3][1]), (151, rows[3][1]), (152, rows[75][1]), (5, rows[75][1]), (5, rows[3][1]), (6, rows[6][1]), (6, rows[6][1]), (152, rows[9][1]), (160, {9001}), (161, {9001}), (162, {9002})]
    made = spark.createDataFrame([(i, sorted(s)) for i, s in rows], "doc_id long, features array<long>")
    near = {i: {} for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i != j and len(a & b) >= fp.ALIKE * len(a | b) > 0:
                near[i][j] = max(near[i].get(j, 0), len(a & b) / len(a | b))
    want = {}
    for i in near:
        seen, queue = {i}, [i]
        while queue:
            new = near[queue.pop()].keys() - seen
            seen |= new
            queue += new
        if near[i]:
            want[i] = (min((-s, j) for j, s in near[i].items())[1], min(seen), len(near[i]))
    assert {r["id"]: (r["match"], r["class"], r["links"]) for r in fp.links(made).collect()} == want
    assert want[160] == (161, 160, 1) and 162 not in want and want[100][2] >= 59


def test_linked_pairs_are_not_rows(spark):
    """What is written for a passage that all share grows with the texts, not with their pairs."""
    n = 300
    sets = [(i, i, [*range(10), 1000 + i, 2000 + i // 2]) for i in range(n)]
    df = spark.createDataFrame(sets, "doc_id long, set long, features array<long>")
    groups = df.selectExpr("set", "12L AS size", "1L AS n", "doc_id AS first", "false AS several")
    rows = fp.alike(df.select("set", "features"), groups).collect()
    assert len(rows) <= 3 * n and sum(r["links"] for r in rows) == n * (n - 1)
