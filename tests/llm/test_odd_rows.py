"""Null, empty, very long and repeated rows, ties, empty tables and clashing columns: the results that the docstrings define."""

from quirefold.llm import bpe, language, lines, simhash

SCHEMA = "doc_id long, text string, lang string, n_chars long, key string, node string, h1 string, __row string, __id string, lines string"
LINE = "one two three four five six seven eight nine"
ROWS = [(None, LINE), (1, None), (2, ""), (3, " \n\t"), (4, LINE), (4, LINE), (5, LINE + "\n" + LINE), (6, "é" * 70), (7, "word " * 30_000), (8, "One  two three four FIVE six seven eight nine"), (9, LINE.replace("nine", "ten"))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0 if t is None else len(t), *"abcdef") for i, t in rows], SCHEMA)


def test_language(spark):
    m = language.build({"en": "the quick brown fox", "fr": "le renard brun"})
    got = language.identify(frame(spark, ROWS), m).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i, _ in ROWS)
    for r in got:
        assert (r["predicted"] is None) == (r["bits"] is None) == (r["phrases"] is None) == (r["doc_id"] in (1, 2, 3))
    tie = language.build({"b": "xyz", "a": "xyz"})
    assert language.identify(frame(spark, [(1, "xy")]), tie).first()["predicted"] == "a"
    nothing = language.fit(frame(spark, []))
    assert {r["predicted"] for r in language.identify(frame(spark, ROWS), nothing).collect()} == {None}
    assert language.identify(frame(spark, []), m).count() == 0
    long = frame(spark, [(1, "le renard brun " * 5000), (2, "le chat " * 4000)]).replace("en", "fr", ["lang"]).union(frame(spark, [(3, "the quick fox"), (4, "the dog"), (4, "the dog")]))
    trained = language.fit(long)
    assert trained.langs == ["en", "fr"] and abs(trained.log_size[1] - 14) < 0.1  # of two long texts the beginning of the shorter
    assert [r["predicted"] for r in language.identify(frame(spark, [(1, "the dog"), (2, "chat le chat")]), trained).orderBy("doc_id").collect()] == ["en", "fr"]


def test_bpe(spark):
    df = frame(spark, ROWS)
    coded = bpe.encode(df)
    by = {r["doc_id"]: r for r in coded.collect()}
    assert by[1]["tokens"] is None and by[1]["exact"] is None and by[2]["tokens"] == [] and all(r["exact"] for i, r in by.items() if i != 1)
    assert sorted(((r["doc_id"] or 0, r["text"] or "-") for r in bpe.decode(coded).collect())) == sorted((i or 0, t or "-" if t is None else t or "-") for i, t in ROWS)
    assert {r["doc_id"]: r["tokens"] for r in bpe.counts(df).collect()} == {i: None if r["tokens"] is None else len(r["tokens"]) for i, r in by.items()}
    odd = spark.createDataFrame([(1, [-1, None, 10**9]), (2, None), (3, [])], "doc_id long, tokens array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd).collect()} == {1: "", 2: None, 3: ""}
    assert bpe.encode(frame(spark, [])).count() == 0


def test_lines(spark):
    df = frame(spark, ROWS)
    out = lines.drop_lines(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect()), key=str)
    want = {0: [LINE], 1: [None], 2: [""], 3: [" \n\t"], 4: [LINE, LINE], 5: [""], 6: ["é" * 70], 7: ["word " * 30_000], 8: [""], 9: [""]}
    assert got == sorted(((i, t) for i, ts in want.items() for t in ts), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in out.where("doc_id > 1").collect()) and {r["h1"] for r in out.collect()} == {"c"}
    assert lines.drop_lines(frame(spark, [])).count() == 0


def test_simhash(spark):
    df = frame(spark, [*ROWS, (4, "another text of this document, of other words than those")])
    assert {(r["doc_id"], r["duplicate_of"]) for r in simhash.duplicates(df).where("doc_id IN (4, 5, 8)").collect()} == {(5, 4), (8, 4)}
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert {None, 1, 2, 3, 4, 6, 7} <= set(kept) and kept.count(4) == 3 and not {5, 8} & set(kept)
    assert simhash.keep_one(frame(spark, [])).count() == 0 and simhash.duplicates(frame(spark, [])).count() == 0
