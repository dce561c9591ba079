"""The document operators against literal cases, and their queries against DuckDB."""

import glob
import os
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quirefold.functions import codecs
from quirefold.functions import scalars as S
from quirefold.operators import segments
from quirefold.plans import catalogue
from quirefold.sources import markup

SF = "/root/testdata/sf0.001"


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("c"))).collect()]


def test_numbering(spark):
    texts = ["7 Where to begin", "2.10.3 Deep", "2.10.3. Deep", "5 x", "5\tx", "2.71828", "6..1 x", "2nd Draft", "C.4 x", None]
    assert column(spark, texts, S.numbered_level) == [1, 3, 3, 1, 1, None, None, None, None, None]
    assert column(spark, ["C.4 Rights", "C.4.2 Owner", "C. Once", "c.4 x", "C.4", "4.4 x"], S.annex_level) == [2, 3, None, None, None, None]


def test_markers(spark):
    assert column(spark, ["• Milk", "–glued", "•", "  ◦ x"], S.list_marker) == ["•", None, None, "◦"]
    assert column(spark, ["• Milk", "plain"], S.strip_marker) == ["Milk", "plain"]


def test_ordered_runs_side_by_side(spark):
    """A run ends where the edge or the count leaves it, and the next begins there."""
    rows = [("1. a", 72), ("2. b", 72), ("3. c", 90), ("4. d", 90), ("5. e", 72), ("1) f", 72), ("2) g", 72), ("3. h", 72), ("x", 72), ("4. i", 72)]
    df = spark.createDataFrame([(1, 1, i, t, float(x)) for i, (t, x) in enumerate(rows)], "doc_id long, page int, block_ix int, text string, x0 double")
    got = segments.ordered_runs(df).orderBy("block_ix").collect()
    assert [(r["block_ix"], r["run_length"]) for r in got] == [(0, 2), (1, 2), (2, 2), (3, 2), (5, 2), (6, 2)]


def test_sentences(spark):
    long = "word " * 100
    texts = ["One. Two.", "By J. R. Smith. Then", "in 5. Then", "A. B", "no end", "line\nends here. More", long, "é" * 200, "Why? Yes", None]
    assert column(spark, texts, S.first_sentence) == ["One.", "By J. R. Smith.", "in 5.", "A.", "no end", "line\nends here.", ("word " * 59).strip() + "…", "é" * 148 + "…", "Why?", None]


def test_dates_and_slugs(spark):
    assert column(spark, ["D:20200231", "D:20201301", "2020", None], S.iso_date) == ["2020-02-31", None, None, None]
    assert column(spark, ["ISO 32000-2:2020(en), x", "ISO/TS 32005", "ISO"], S.iso_id) == ["iso32000-2:2020", "iso32005", None]


@pytest.mark.parametrize("spec,n,want", [("2,4-6,7", 9, [2, 4, 5, 6, 7]), ("5-", 6, [5, 6]), ("8,2,2", 9, [2, 8]), ("", 2, [1, 2])])
def test_page_ranges(spark, spec, n, want):
    assert spark.range(1).select(markup.page_ranges(F.lit(spec), F.lit(n))).first()[0] == want


@pytest.mark.parametrize("spec", ["500", "0", "abc", "1.5", ","])
def test_bad_page_ranges(spark, spec):
    with pytest.raises(PySparkException):
        spark.range(1).select(markup.page_ranges(F.lit(spec), F.lit(3))).collect()


def test_codecs():
    data = bytes(range(256)) * 3
    packed = zlib.compress(data)
    assert codecs.decode("Fl", packed) == data
    assert codecs.decode("FlateDecode", packed[2:-4]) == data
    assert codecs.decode("FlateDecode", b"\r\n" + packed) == data
    assert codecs.decode("AHx", b"51 75 69 6z C6c7>") == b"Quillp"
    assert codecs.decode("A85", b"<~" + __import__("base64").a85encode(b"quiet\0\0\0\0xyz") + b"~>") == b"quiet\0\0\0\0xyz"
    assert codecs.decode("RL", bytes([1, 65, 66, 255, 90, 128, 1])) == b"ABZZ"
    assert codecs.decode("LZWDecode", bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert codecs.decode_chain(["AHx", "DCTDecode"], b"41>")[1] == ["DCTDecode"] and codecs.is_image("DCT") and not codecs.is_image("Fl")
    with pytest.raises(ValueError):
        codecs.decode("Nope", b"")


def test_damaged_deflate_keeps_its_beginning():
    import random

    rng = random.Random(1)
    data = bytes(rng.randrange(40) for _ in range(60_000))
    packed = zlib.compress(data)
    for cut in (len(packed) // 2, len(packed) - 3):
        got = codecs.flate(packed[:cut])
        assert data.startswith(got) and len(got) > 0.4 * len(data)
    broken = bytearray(packed)
    broken[len(packed) // 2] ^= 0xFF
    assert codecs.flate(bytes(broken))[:20_000] == data[:20_000]
    with pytest.raises(ValueError):
        codecs.flate(b"nothing of the kind")


def test_predictors_by_byte():
    import random

    rng = random.Random(2)
    for colors, columns in ((1, 7), (3, 5), (4, 1)):
        row, bpp = colors * columns, colors
        raw = b"".join(bytes([rng.choice((0, 1, 2, 3, 4, 2, 1))]) + bytes(rng.randrange(256) for _ in range(row)) for _ in range(12))
        want, above = b"", bytes(row)
        for k in range(0, len(raw), row + 1):
            how, line = raw[k], bytearray(raw[k + 1 : k + 1 + row])
            for i in range(row):
                a, b, c = (line[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
                near = min(((abs(a + b - c - v), o, v) for o, v in enumerate((a, b, c))))[2]
                line[i] = (line[i] + (0, a, b, (a + b) // 2, near)[how]) % 256
            want, above = want + line, line
        assert codecs.predict(raw, {"Predictor": 15, "Colors": colors, "Columns": columns}) == want
        tiff = bytes(rng.randrange(256) for _ in range(3 * row))
        plain = bytearray(tiff)
        for r in range(3):
            for i in range(colors, row):
                plain[r * row + i] = (plain[r * row + i] + plain[r * row + i - colors]) % 256
        assert codecs.predict(tiff, {"Predictor": 2, "Colors": colors, "Columns": columns}) == bytes(plain)
    for bad in ({"Predictor": 2, "BitsPerComponent": 4}, {"Predictor": 15, "Columns": 1 << 25}, {"Predictor": 15, "Colors": 0}):
        with pytest.raises(ValueError):
            codecs.predict(b"xx", bad)


def test_unique_names(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "x-2"), (1, 2, "x"), (1, 3, "x"), (2, 0, "x"), (1, 4, "index")], "parent long, ix long, name string")
    assert [r["name"] for r in segments.unique_names(df, ("index",)).orderBy("parent", "ix").collect()] == ["x", "x-2", "x-3", "x-4", "index-2", "x"]


def values(df):
    def one(v):
        if hasattr(v, "tolist") and hasattr(v, "__len__"):
            return [one(x) for x in v.tolist()]
        if isinstance(v, list):
            return [one(x) for x in v]
        if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
            return None
        return float(v) if not isinstance(v, str | bool) and hasattr(v, "__float__") else v

    df = df[sorted(df.columns)]
    return sorted(repr([one(v) for v in row]) for row in df.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert values(catalogue.queries()[name](spark, SF).toPandas()) == values(duck.execute(catalogue.oracle_sql()[name]).df())
