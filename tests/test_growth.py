"""What must not grow faster than the input: tasks, passes over the input, memory of a worker."""

import random
import time
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.functions import codecs
from quirefold.functions import scalars as S
from quirefold.functions import texts as columns
from quirefold.operators import files as P
from quirefold.operators import joins
from quirefold.operators import recognise as R
from quirefold.plans import catalogue, derived, texts
from quirefold.plans.files import _report
from quirefold.sources.pdf.cmaps import CMap
from quirefold.sources.pdf.objects import value
from quirefold.sources.pdf.tokens import Lexer, Ref


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_text_is_encoded_once(spark, tmp_path):
    """filters_roundtrip read and encoded every text once for each filter."""
    rows = [(1, "a text of words, words and words " * 40), (2, ""), (3, None), (4, "é" * 5000), (4, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.queries()["filters_roundtrip"](spark, str(tmp_path))
    assert plan(found).count("MapInArrow") == 1 and plan(found).count("Relation") == 1
    want = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.explode(F.array(*map(F.lit, [*texts._ENCODERS, "Predictor"]))).alias("filter"), F.md5("text").alias("digest"))
    assert found.count() == 30 and found.exceptAll(want).count() == 0


def test_lzw_with_many_tables():
    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(30_000))
    packed = texts._lzw(data)
    assert codecs.decode("LZWDecode", packed) == data and codecs.decode("LZWDecode", packed[:6000]) == data[: len(codecs.decode("LZWDecode", packed[:6000]))] != b""
    assert codecs.decode("LZWDecode", texts._lzw(b"")) == b"" and codecs.decode("FlateDecode", zlib.compress(b"")) == b""
    with pytest.raises(ValueError):
        codecs.decode("LZWDecode", bytes([0x80, 0x0B, 0xFF, 0xFF]))


def test_decoded_columns_hold_few_values_at_once():
    """filter_roundtrip made Python objects of a whole Arrow batch."""
    column = pa.array([bytes(200_000)] * 300 + [None, b""])
    tracemalloc.start()
    out = codecs._by_rows(lambda b: b and b[:1], column)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [b"\0"] * 300 + [None, b""] and most < 4 << 20
    assert codecs._by_rows(len, pa.array([], pa.binary())).to_pylist() == []


def test_cmaps_are_spread_and_parsed_once(spark, tmp_path, monkeypatch):
    """cmap_expand and cmap_codes parsed a program for each row, in the one task of a small table."""
    spark.range(600).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name, n in (("cmap_expand", 4200), ("cmap_codes", 600)):
        found = catalogue.queries()[name](spark, str(tmp_path))
        counts = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(counts) >= 8 and sum(r["count"] for r in counts) == n
    parsed = []
    monkeypatch.setattr(columns.cmaps, "parse", lambda p: parsed.append(p) or CMap(texts={1: "a"}))
    monkeypatch.setattr(columns, "_CMAPS", {})
    for p in (b"a", b"b", b"a", b"c" * 5000, b"c" * 5000):
        columns._cmap(p)
    assert parsed == [b"a", b"b", b"c" * 5000, b"c" * 5000]


def test_cmap_columns_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, bytearray(b"1 beginbfrange <01> <02> <0041> endbfrange"), bytearray(b"\0\1")), (2, None, bytearray(b"x")), (3, bytearray(b""), None), (4, bytearray(b""), bytearray(b""))], "i int, p binary, d binary")
    got = {r["i"]: (r["t"], r["c"]) for r in rows.select("i", columns.cmap_texts(F.col("p")).alias("t"), columns.cmap_cids(F.col("p"), F.col("d")).alias("c")).collect()}
    assert got == {1: ([(1, "A"), (2, "B")], [1]), 2: (None, None), 3: ([], None), 4: ([], [])}


def test_a_token_is_read_once(monkeypatch):
    """pdf_tagged_sections and others: arrays and dictionaries read each of their tokens twice."""
    data, tokens = b"<</K [[1 2] (text) <</A /B>>] /P 3 0 R>>", []
    scan = Lexer.scan
    monkeypatch.setattr(Lexer, "scan", lambda self, *how: tokens.append(found := scan(self, *how)) or found)
    assert value(Lexer(data)) == {"K": [[1, 2], b"text", {"A": "B"}], "P": Ref(3, 0)}
    assert len(tokens) == 16


def test_places_of_many_siblings(spark):
    """pdf_elements looked for the place of an element among all of its siblings."""
    n = 3000
    files = spark.createDataFrame([(1, bytearray(_report(list(range(n)), ["x"] * n, True, 4)))], "doc_id long, payload binary")
    began = time.time()
    found = [(r["ord"], r["parent_id"]) for r in P.elements(files).orderBy("elem_id").collect()]
    assert found == [(None, None), (0, 0), *((i, 1) for i in range(2 * n - n // 4))] and time.time() - began < 60


def test_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    """cell_grid and other queries over numbered rows sorted all rows in as few tasks as their compressed shuffle had megabytes for."""
    rows = spark.range(4000).selectExpr("id DIV 4 AS l_orderkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber", "id % 40 AS l_partkey", "id % 60 AS l_suppkey", "CAST(id AS DOUBLE) AS l_extendedprice")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for most, least in ((500_000, 16), (100, 40)):
        monkeypatch.setattr(derived, "ROWS_A_TASK", most)
        boxes = derived.derive(spark, str(tmp_path), "boxes")
        assert boxes.rdd.getNumPartitions() >= least and boxes.count() == 4000
        found = catalogue.queries()["cell_grid"](spark, str(tmp_path))
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= least and plan(found).count("Repartition") == 2


def test_cells_only_meet_columns_that_can_be_first(spark):
    cells = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.0, 5.0, 9.9, 10.0, 25.0, None])] + [(1, 0, 12.0), (2, 1, 0.0), (None, 1, 0.0)], "doc_id long, cell_ix int, x0 double")
    columns_of = spark.createDataFrame([(1, 3, 20.0), (1, 1, 10.0), (1, 2, 7.0), (1, 4, None), (1, 5, 20.0), (1, None, 30.0), (3, 1, 9.0), (None, 1, 9.0)] + [(1, 100 + i, 3.0) for i in range(500)], "doc_id long, col int, right double")
    plain = cells.join(columns_of.withColumnRenamed("doc_id", "d"), F.expr("doc_id = d AND x0 < right"))
    want = plain.groupBy("doc_id", "cell_ix").agg(F.min("col").alias("col"))
    got = joins.cell_columns(cells, columns_of)
    assert got.count() == want.count() == 5 and got.exceptAll(want).count() == 0
    assert {r["cell_ix"]: r["col"] for r in got.collect()} == {0: 1, 1: 1, 2: 1, 3: 3, 4: None}


def test_a_name_is_worked_out_once(spark):
    """section_names put the lower-cased title into its expressions dozens of times, each worked out again."""
    df = spark.createDataFrame([(1, "1.2", "1.2 A " + "word " * 30, "1"), (2, None, None, None), (3, "2", "x" * 70, "")], "i long, n string, t string, p string")
    c = [F.col(x) for x in "ntip"]
    for name, most in ((S.slug(*c), 20), (S.path_name(F.lit("/" + "d" * 29), *c), 24)):
        assert 0 < plan(df.select(name)).count("regexp_replace(") <= most
    got = df.select(S.slug(*c[:3]), S.slug(*c), S.path_name(F.lit("/" + "d" * 29), *c)).collect()
    words, many = "-a" + "-word" * 11, "2-" + "x" * 60
    assert [tuple(r) for r in got] == [("1-2" + words, "2" + words, "1-2"), ("section-3",) * 3, (many, many, "2")]


def test_recognition_reads_a_file_once(spark, tmp_path):
    """recognised_pages built its files three times and read their pages twice, in one task."""
    spark.range(400).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.queries()["recognised_pages"](spark, str(tmp_path))
    assert plan(found).count("Relation") == 1 and plan(found).count("MapInArrow") == 3
    assert found.count() == sum(n % 4 + 1 for n in range(400)) and found.select(F.spark_partition_id().alias("p")).distinct().count() >= 8


def test_recognised_texts_are_those_of_the_steps(spark):
    files = spark.createDataFrame([(n, bytearray(texts._sparse(n))) for n in range(9)] + [(9, None), (10, bytearray(b"no file"))], "doc_id long, payload binary")

    def rasterise(payload, page, dpi):
        return (len(payload) + page) % 4, (612.0, 792.0)

    def engine(image):
        if image == 0:
            raise RuntimeError("no answer")
        if image == 1:
            failed = RuntimeError("broke off")
            failed.partial = "<doctag><text>half"
            raise failed
        return "<doctag>" if image == 2 else "<doctag><text>one</text><text>two</text></doctag>"

    for threshold, force in ((R.THRESHOLD, False), (0.0, False), (1.0, True)):
        pages = R.routed(R.page_coverages(files), threshold, force)
        back = R.recognised(files, pages, rasterise, engine)
        want = R.with_recognised(pages, R.tagged_blocks(back.where("tags IS NOT NULL").select("doc_id", "page", "tags")))
        got = R.recognised_texts(files, rasterise, engine, threshold=threshold, force=force)
        assert got.select("doc_id", "page", "text").exceptAll(want).count() == 0 and got.count() == want.count() > 9
        assert got.where("error IS NOT NULL").select("doc_id", "page", "error").exceptAll(back.select("doc_id", "page", "error").where("error IS NOT NULL")).count() == 0
    twice = R.recognised_texts(files.union(files), rasterise, engine)
    assert twice.count() == 2 * got.count()
    with pytest.raises(ValueError):
        R.recognised_texts(files, rasterise, engine, threshold=1.5)


def test_texts_of_many_files_stay_in_place(spark, tmp_path):
    """pdf_lines and others shuffle the texts of a table in few files, and of no other."""
    rows = spark.range(400).selectExpr("id AS doc_id", "concat('line ', id) AS text")
    for n in (1, 4):
        rows.repartition(n).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found = catalogue.queries()["pdf_lines"](spark, f"{tmp_path}/{n}")
        assert plan(found).count("Repartition") == (n < 4) and found.count() == 400
    assert catalogue.queries()["pdf_lines"](spark, f"{tmp_path}/1").select(F.spark_partition_id().alias("p")).distinct().count() >= 8
