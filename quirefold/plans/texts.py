"""Queries of the text, marker, colour, recognition and codec rules, and the SQL each is held against."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import codecs, colour
from quirefold.functions import geometry as G
from quirefold.functions import scalars as S
from quirefold.functions import texts as X
from quirefold.operators import files as P
from quirefold.operators import joins, metrics
from quirefold.operators import recognise as R
from quirefold.plans.derived import derive, with_sql
from quirefold.plans.files import REPORTS, made, read, reports, spread_texts
from quirefold.sources.pdf import writer as w

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        _SQL[fn.__name__] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Markdown of any text

_WORD = "regexp_matches(coalesce({0}, ''), '^(?:[A-Za-z0-9]|[^\\x00-\\x7f])$')"


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents), c AS (SELECT doc_id, CAST(no - 1 AS INT) AS no, line, string_split(line, '') AS c FROM l WHERE line <> '')
    SELECT doc_id, no, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] IN ('\', '`', '*', '|') THEN '\' || c[i] WHEN c[i] IN ('_', '~') AND NOT ({_WORD.format("c[i - 1]")} AND {_WORD.format("c[i + 1]")}) THEN '\' || c[i]
    WHEN c[i] = '!' AND c[i + 1] = '[' THEN '\!' WHEN c[i] = '[' AND regexp_matches(array_to_string(c[i:], ''), '^\[[^\]]*\][(\[:]') THEN '\[' WHEN c[i] = '<' AND coalesce(c[i - 1], '') <> '<' AND regexp_matches(coalesce(c[i + 1], ''), '[A-Za-z!?/]') THEN '\<'
    WHEN c[i] = '&' AND regexp_matches(array_to_string(c[i:], ''), '^&#?[A-Za-z0-9]+;') THEN '&amp;' WHEN i = 1 AND c[i] IN ('#', '>', '-', '+', '=') THEN '\' || c[i] WHEN c[i] IN ('.', ')') AND regexp_matches(array_to_string(c[1:i - 1], ''), '^[0-9]+$') AND coalesce(c[i + 1], ' ') IN (' ', chr(9)) THEN '\' || c[i] ELSE c[i] END), '') AS escaped FROM c"""
)
def md_escape(spark, sf):
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where("line <> ''")
    return lines.select("doc_id", "no", X.escape(F.col("line"), at_start=True).alias("escaped"))


@query(r"SELECT doc_id, concat(repeat('`', n + 1), CASE WHEN n > 0 THEN ' ' ELSE '' END, t, CASE WHEN n > 0 THEN ' ' ELSE '' END, repeat('`', n + 1)) AS code, repeat('`', greatest(3, n + 1)) AS fence FROM (SELECT doc_id, doc_id % 5 AS n, concat(repeat('`', doc_id % 5), source, repeat('`', doc_id % 5)) AS t FROM documents)")
def code_spans(spark, sf):
    ticks = F.repeat(F.lit("`"), (F.col("doc_id") % 5).cast("int"))
    text = F.concat(ticks, "source", ticks)
    return read(spark, sf, "documents").select("doc_id", X.code_span(text).alias("code"), S.code_fence(text).alias("fence"))


_CLAUSE = "concat(o_orderkey % 4 + 1, '.', o_orderkey % 6 + 1)"


@query(
    with_sql("sections", query=f"""SELECT o.o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 4) AND hit THEN replace(t, '#', concat('[', n, '](/', n, '.md)')) ELSE replace(t, '#', n) END AS text, CAST(CASE WHEN o_orderkey % 5 IN (0, 1, 4) AND hit THEN 1 ELSE 0 END AS INT) AS links FROM (
    SELECT o_orderkey, {_CLAUSE} AS n, o_orderkey % 3 <> 2 AS hit, CASE o_orderkey % 5 WHEN 0 THEN 'as clause # says' WHEN 1 THEN 'See # and Table 9.9.' WHEN 2 THEN 'table #' WHEN 3 THEN '`see #` in [a](see #) \\#' ELSE '§ #.' END AS t FROM orders) o""")
)
def clause_links(spark, sf):
    o = read(spark, sf, "orders")
    n = F.concat(F.col("o_orderkey") % 4 + 1, F.lit("."), F.col("o_orderkey") % 6 + 1)
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, "as clause # says").when(k == 1, "See # and Table 9.9.").when(k == 2, "table #").when(k == 3, "`see #` in [a](see #) \\#").otherwise("§ #.")
    own = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("/"), n, F.lit(".md"))).otherwise("/x.md")
    paths = F.create_map(n, F.concat(F.lit("/"), n, F.lit(".md")), F.lit("8.8"), F.lit("/8.8.md"))
    linked = X.linked(F.replace(t, F.lit("#"), n), paths, own)
    return o.select("o_orderkey", linked.alias("l")).select("o_orderkey", "l.text", "l.links")


@query("""SELECT o_orderkey, o_orderkey % 4 < 2 AS cued FROM orders""")
def reference_cues(spark, sf):
    k = F.col("o_orderkey") % 4
    before = F.when(k == 0, F.concat("o_orderpriority", F.lit(" Subclause "))).when(k == 1, "x § ").when(k == 2, F.concat("o_orderpriority", F.lit(" clause"))).otherwise("PDF ")
    return read(spark, sf, "orders").select("o_orderkey", S.is_cued(before).alias("cued"))


# titles, names, markers


@query(
    r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), k AS (SELECT *, left(t, CAST(list_max(list_filter(range(0, 201), lambda i: octet_length(encode(left(t, i))) <= 200)) AS BIGINT)) AS cut FROM c), b AS (SELECT *, regexp_extract(cut, '(?s)^(.*)\s', 1) AS back FROM k)
    SELECT doc_id, CASE WHEN octet_length(encode(t)) <= 200 THEN t WHEN octet_length(encode(back)) > 100 THEN rtrim(back) ELSE rtrim(cut) END AS title FROM b"""
)
def section_titles(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.title_of(F.lit(None).cast("string"), F.col("text"), F.lit(None).cast("string")).alias("title"))


_KEBAB = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '-')"
_NAMES = f"""WITH n AS (SELECT doc_id, concat(doc_id % 9, '.', doc_id % 7) AS number, CAST(doc_id % 9 AS VARCHAR) AS parent, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 END AS has, left(text, 150) AS t FROM documents),
k AS (SELECT *, CASE WHEN has = 1 THEN replace(number, '.', '-') ELSE '' END AS num, {_KEBAB.format("t")} AS tail FROM n),
c AS (SELECT *, CASE WHEN length(tail) <= 60 THEN tail WHEN position('-' IN left(tail, 60)) > 0 AND length(regexp_replace(left(tail, 60), '-[^-]*$', '')) > 30 THEN regexp_replace(left(tail, 60), '-[^-]*$', '') ELSE rtrim(left(tail, 60), '-') END AS cut FROM k),
s AS (SELECT *, coalesce(nullif(concat_ws('-', nullif(num, ''), nullif(cut, '')), ''), concat('section-', doc_id + 1)) AS full_name, coalesce(nullif(concat_ws('-', nullif(CASE WHEN has = 1 THEN CAST(doc_id % 7 AS VARCHAR) ELSE '' END, ''), nullif(cut, '')), ''), concat('section-', doc_id + 1)) AS short_name FROM c)"""


@query(f"{_NAMES} SELECT doc_id, full_name AS slug, short_name AS trimmed, CASE WHEN 30 + 8 + 2 * length(full_name) <= 150 THEN full_name WHEN 30 + 8 + 2 * length(short_name) <= 150 THEN short_name WHEN num <> '' THEN num ELSE concat('section-', doc_id + 1) END AS name FROM s")
def section_names(spark, sf):
    has = F.col("doc_id") % 4 != 3
    number, parent = F.when(has, F.concat(F.col("doc_id") % 9, F.lit("."), F.col("doc_id") % 7)), F.when(has, (F.col("doc_id") % 9).cast("string"))
    title = F.substring("text", 1, 150)
    return read(spark, sf, "documents").select(
        "doc_id", S.slug(number, title, F.col("doc_id")).alias("slug"), S.slug(number, title, F.col("doc_id"), parent).alias("trimmed"), S.path_name(F.lit("/" + "d" * 29), number, title, F.col("doc_id"), parent).alias("name")
    )


@query(with_sql("items", query="SELECT block_ix, CASE WHEN block_ix % 3 = 0 THEN '-' WHEN block_ix % 3 = 1 THEN '•' ELSE NULL END AS marker, block_ix % 5 = 0 AS counted, block_ix % 4 < 2 AS same FROM items"))
def declared_markers(spark, sf):
    i = derive(spark, sf, "items").select(F.col("block_ix").alias("i"))
    text = F.when(F.col("i") % 3 == 0, " - one").when(F.col("i") % 3 == 1, "• two").otherwise("-three")
    k, j = F.col("i") % 5, F.col("i") % 4
    marker = F.when(k == 0, "a.").when(k == 1, "-").when(k == 2, "•").when(k == 3, "").otherwise(None)
    other = F.when(j == 0, "[12]").when(j == 1, "[9]").when(j == 2, "3)").otherwise("[b]")
    return i.select(F.col("i").alias("block_ix"), S.declared_marker(text).alias("marker"), S.enumerated(marker).alias("counted"), S.same_form(F.lit("[3]"), other).alias("same"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN concat('page ', p_size) ELSE concat('pages ', p_size, '–', p_size + 2) END AS pages, CASE WHEN p_size % 5 = 0 THEN 'encrypted' WHEN p_size % 5 = 1 THEN 'tagged' WHEN p_size % 5 = 2 THEN 'layout' ELSE 'ocr' END AS route, least(6, greatest(1, p_size - 20)) AS level FROM part")
def page_labels(spark, sf):
    k = F.col("p_size") % 3
    pages = S.fmt_pages(F.when(k == 0, 0).otherwise(F.col("p_size")), F.when(k == 2, F.col("p_size") + 2).otherwise(F.col("p_size")))
    r = F.col("p_size") % 5
    route = metrics.probe_route(r == 0, F.when(r <= 1, 1).otherwise(0), F.lit(0), F.when(r <= 2, 1).otherwise(0))
    return read(spark, sf, "part").select("p_partkey", pages.alias("pages"), route.alias("route"), S.heading_level(F.col("p_size") - 20).alias("level"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE concat('Sub', CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END, p_name) END AS plain, p_size % 6 = 0 OR p_size > 30 AS bold, p_size % 6 = 1 OR p_size % 128 >= 64 OR p_size % 8 = 7 AS italic, p_size % 6 = 2 OR p_size % 2 = 1 AS mono FROM part"""
)
def font_names(spark, sf):
    size = F.col("p_size")
    plain = S.strip_subset_prefix(F.concat(F.when(size % 4 == 0, "ABCDEF+").when(size % 2 == 0, "Sub+").otherwise("Sub-"), "p_name"))
    name = F.when(size % 6 == 0, "Some-SemiBold").when(size % 6 == 1, "Some-Oblique").when(size % 6 == 2, "CourierX").otherwise("Plain")
    flags = (size % 2 + F.when(size % 8 == 7, 64).otherwise(0)).cast("int")
    traits = S.font_traits(name, flags, F.when(size > 40, 600), F.when(size > 30, 121))
    return read(spark, sf, "part").select("p_partkey", plain.alias("plain"), traits.alias("t")).select("p_partkey", "plain", "t.bold", "t.italic", "t.mono")


@query(with_sql("images", query="SELECT image_id, CASE codec WHEN 'jpeg' THEN 'jpg' WHEN 'raw' THEN 'png' END AS extension, CAST(CASE WHEN alpha THEN 1 WHEN width IN (1, 2, 4, 8, 16) THEN width ELSE 8 END AS INT) AS bits FROM images"))
def image_kinds(spark, sf):
    return derive(spark, sf, "images").select("image_id", S.image_extension(F.col("codec")).alias("extension"), S.valid_bits(F.col("width"), F.col("alpha")).cast("int").alias("bits"))


@query("SELECT o_custkey, string_agg(concat(p, '=', n), ' ' ORDER BY n DESC, p) AS counts FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def count_lists(spark, sf):
    by = read(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").count()
    return by.groupBy("o_custkey").agg(S.count_list(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "count")))).alias("counts"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\s\x0b\x{85}\p{Z}]+'), lambda x: x <> '')) AS w FROM documents), k AS (SELECT doc_id, w, length(regexp_replace(w, '[^\p{L}\p{Nd}]', '', 'g')) * 2 > length(w) AS likely FROM w),
    s AS (SELECT doc_id, string_agg(w, ' ' ORDER BY n DESC, w) AS samples FROM (SELECT doc_id, w, octet_length(encode(w)) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY octet_length(encode(w)) DESC, w) AS r FROM (SELECT DISTINCT doc_id, w FROM k WHERE likely AND length(w) > 25)) WHERE r <= 3 GROUP BY doc_id)
    SELECT d.doc_id, count(k.w) AS words, count(*) FILTER (WHERE likely AND length(w) > 25) AS long_words, CAST(coalesce(max(length(w)) FILTER (WHERE likely), 0) AS INT) AS longest, coalesce(max(s.samples), '') AS samples FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""
)
def word_quality(spark, sf):
    return metrics.word_quality(read(spark, sf, "documents"), ["doc_id"])


# geometry, colours, bits


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 12 ELSE -6 END AS INT) AS direction, CAST(p_size AS DOUBLE) AS x0, CAST(800 - 2 * (p_size + 50) AS DOUBLE) AS y0, CAST(p_size + 100 AS DOUBLE) AS x1, CAST(800 - 2 * p_size AS DOUBLE) AS y1, p_partkey % 2 = 0 AS near FROM part")
def directions(spark, sf):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    dx, dy = F.when(k == 0, 2.0).when(k == 2, -1.0).otherwise(0.0), F.when(k == 1, 3.0).when(k == 3, -1.0).otherwise(0.0)
    r = G.grid_rect(size, size, size + 100, size + 50, F.lit(500.0), F.lit(800.0), 500)
    box = G.grid_rect(size, size * 1.25, size + 100, (size + 50) * 1.25, F.lit(500.0), F.lit(800.0))
    near = G.nearly_equal(size, size + F.when(F.col("p_partkey") % 2 == 0, 5e-7).otherwise(2e-6))
    out = read(spark, sf, "part").select("p_partkey", G.orientation(dx, dy).alias("direction"), box.alias("b"), r.alias("r"), near.alias("near"))
    return out.select("p_partkey", "direction", F.round("b.x0", 6).alias("x0"), F.round("b.y0", 6).alias("y0"), F.round("b.x1", 6).alias("x1"), F.round("b.y1", 6).alias("y1"), "near")


@query(
    """WITH v AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS c, (p_partkey % 11) / 10.0::DOUBLE AS k, (p_partkey % 5) / 4.0::DOUBLE AS a FROM part)
    SELECT p_partkey, CAST(floor((1 - c) * (1 - k) * 255 + 0.5) AS INT) AS red, round(CASE WHEN a >= 1 THEN c WHEN a <= 0 THEN k ELSE least(1.0, greatest(0.0, k + (c - k) / a)) END, 9) AS free, CAST(floor(least(1.0, greatest(0.0, -0.5 + c * 2)) * 255 + 0.5) AS INT) AS scaled FROM v"""
)
def colour_samples(spark, sf):
    c, k, a = F.col("p_size") / 50.0, F.col("p_partkey") % 11 / 10.0, F.col("p_partkey") % 5 / 4.0
    red = colour.clamp8(colour.cmyk_to_rgb(c, c, c, k)[0])
    return read(spark, sf, "part").select("p_partkey", red.alias("red"), F.round(colour.unblended(c, k, a), 9).alias("free"), colour.clamp8(colour.decoded(c, F.lit(-0.5), F.lit(1.5))).alias("scaled"))


@query("SELECT p_partkey, CAST((p_partkey * 7919 % 4294967296) >> (19 - p_size % 20) AS BIGINT) & 8191 AS field, CASE WHEN p_size % 20 <= 8 THEN CAST((p_partkey * 7919 % 4294967296) >> (8 - p_size % 20) AS BIGINT) & 16777215 END AS wide FROM part")
def bit_fields(spark, sf):
    data = F.unhex(F.lpad(F.hex((F.col("p_partkey") * 7919) % 4294967296), 8, "0"))
    at = F.col("p_size") % 20
    return read(spark, sf, "part").select("p_partkey", colour.bit_field(data, at, 13).alias("field"), colour.bit_field(data, at, 24).alias("wide"))


@query(
    """WITH s AS (SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS span_id, l_partkey, l_suppkey FROM lineitem),
    r AS (SELECT doc_id, (span_id - 1) // 3 AS line_id, span_id, (span_id - 1) % 3 AS pos, l_partkey, l_suppkey, CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE CAST(l_suppkey % 4 AS INT) END AS mcid, CASE WHEN (span_id - 1) % 3 = 0 AND l_partkey % 4 < 2 THEN '  ' ELSE 'word' END AS text FROM s)
    SELECT doc_id, span_id, CASE WHEN pos = 0 AND mcid IS NULL AND text = '  ' AND l_suppkey % 3 > 0 THEN lead(mcid) OVER (PARTITION BY doc_id, line_id ORDER BY span_id) ELSE mcid END AS mcid FROM r"""
)
def indent_spans(spark, sf):
    s = derive(spark, sf, "spans").select("doc_id", "span_id")
    rows = spark.sql(
        """SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS span_id, l_partkey, l_suppkey FROM {lineitem}""",
        lineitem=read(spark, sf, "lineitem"),
    )
    pos = (F.col("span_id") - 1) % 3
    spans = rows.join(s, ["doc_id", "span_id"], "left_semi").select(
        "doc_id", "span_id", F.floor((F.col("span_id") - 1) / 3).alias("line_id"), F.lit(10.0).alias("size"), (pos * 100.0).alias("x0"),
        F.when(F.col("l_suppkey") % 3 > 0, pos * 100.0 + 99.5).otherwise(pos * 100.0 + 90).alias("x1"), F.when(F.col("l_partkey") % 2 == 1, (F.col("l_suppkey") % 4).cast("int")).alias("mcid"),
        F.when((pos == 0) & (F.col("l_partkey") % 4 < 2), "  ").otherwise("word").alias("text"),
    )
    return joins.adopt_indents(spans).select("doc_id", "span_id", "mcid")


# fonts and CMaps


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN chr(CAST(65 + p_size % 26 AS INT)) WHEN 1 THEN chr(CAST(913 + p_size % 10 AS INT)) WHEN 2 THEN chr(CAST(66560 + p_size AS INT)) WHEN 3 THEN 'é' WHEN 4 THEN 'fi€' WHEN 5 THEN 'AΑ' END AS text FROM part")
def glyph_names(spark, sf):
    k, size = F.col("p_partkey") % 7, F.col("p_size")
    name = F.when(k == 0, F.char((65 + size % 26).cast("int"))).when(k == 1, F.concat(F.lit("uni0"), F.hex(913 + size % 10))).when(k == 2, F.concat(F.lit("u"), F.hex(66560 + size)))
    name = name.when(k == 3, "eacute.alt").when(k == 4, "f_i_Euro").when(k == 5, "uni00410391").otherwise("g123")
    return read(spark, sf, "part").select("p_partkey", X.glyph_text(name).alias("text"))


@query("""WITH p AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey, CAST(p_size % 9 + 1 AS BIGINT) AS code, 'fi' AS text FROM p UNION ALL SELECT p_partkey, 64 + p_size % 4 + i, chr(CAST(1040 + p_size % 4 + i AS INT)) FROM p, (SELECT unnest(range(0, 4)) AS i)
UNION ALL SELECT p_partkey, 96, 'X' FROM p UNION ALL SELECT p_partkey, 97, 'é' FROM p""")
def cmap_expand(spark, sf):
    program = F.concat(
        F.lit("/CIDInit /ProcSet findresource begin 1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <0"), F.col("p_size") % 9 + 1, F.lit("> <00660069> endbfchar 2 beginbfrange <4"), F.col("p_size") % 4, F.lit("> <4"),
        F.col("p_size") % 4 + 3, F.lit("> <04"), F.hex(F.col("p_size") % 4 + 16), F.lit("> <60> <61> [<0058> /eacute] endbfrange"),
    )
    parts = P.spread(read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    return parts.select("p_partkey", F.explode(X.cmap_texts(program.cast("binary"))).alias("e")).select("p_partkey", "e.code", "e.text")


@query("SELECT p_partkey, [CAST(7 + p_size AS BIGINT), 33088 + p_size, 5] AS cids FROM part")
def cmap_codes(spark, sf):
    program = F.lit("2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 begincidrange <00> <7F> 7 endcidrange 1 begincidchar <9999> 5 endcidchar")
    data = F.unhex(F.concat(F.lpad(F.hex("p_size"), 2, "0"), F.hex(33088 + F.col("p_size")), F.lit("9999")))
    parts = P.spread(read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    return parts.select("p_partkey", X.cmap_cids(program.cast("binary"), data).alias("cids"))


# filters


def _run_length(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"


def _lzw(data: bytes) -> bytes:
    """Codes of nine to twelve bits, a clear code first and where the table is full."""
    codes, widths, table, width, prior = [256], [9], {}, 9, -1
    for c in data:
        if prior < 0:
            prior = c
            continue
        key = prior << 8 | c
        code = table.get(key)
        if code is not None:
            prior = code
            continue
        codes.append(prior)
        widths.append(width)
        table[key] = size = 258 + len(table)
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
        if size >= 4093:
            codes.append(256)
            widths.append(width)
            table, width = {}, 9
        prior = c
    if prior >= 0:
        codes.append(prior)
        widths.append(width)
        size = 259 + len(table)
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    each, wide = np.array([*codes, 257]), np.array([*widths, width])
    places = wide[:, None] - 1 - np.arange(12)
    return np.packbits((each[:, None] >> np.maximum(places, 0) & 1)[places >= 0].astype(np.uint8)).tobytes()


def _predicted(data: bytes) -> bytes:
    """Rows of 16 bytes with a PNG filter each, in turn, behind deflate."""
    rows = np.frombuffer(data + bytes(-len(data) % 16), np.uint8).reshape(-1, 16).astype(np.int16)
    left, above, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:], corner[1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]
    x, y, z = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
    near = np.where((x <= y) & (x <= z), left, np.where(y <= z, above, corner))
    how = np.arange(len(rows)) % 5
    ahead = np.select([(how == k)[:, None] for k in (1, 2, 3, 4)], [left, above, (left + above) // 2, near], 0)
    return zlib.compress(np.hstack([how[:, None], rows - ahead]).astype(np.uint8).tobytes())


_ENCODERS: dict[str, Callable[[bytes], bytes]] = {"FlateDecode": zlib.compress, "LZWDecode": _lzw, "ASCII85Decode": lambda b: base64.a85encode(b, adobe=True), "RunLengthDecode": _run_length, "Fl": lambda b: zlib.compress(b)[2:-4]}


@query("SELECT doc_id, unnest(['FlateDecode', 'LZWDecode', 'ASCII85Decode', 'RunLengthDecode', 'Fl', 'Predictor']) AS filter, md5(text) AS digest FROM documents")
def filters_roundtrip(spark, sf):
    """Every filter undone: what another encoder made of each text is the text again."""

    encoders = [*((f, f, fn) for f, fn in _ENCODERS.items()), ("Predictor", "FlateDecode", _predicted)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = [(d, None if t is None else t.encode()) for d, t in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True)]
                rows = [(d, name, f, *((None, None) if t is None else (fn(t), len(t)))) for d, t in part for name, f, fn in encoders]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32()), strict=True)], ["doc_id", "filter", "by", "data", "size"])

    texts = spread_texts(read(spark, sf, "documents"))
    rows = texts.mapInArrow(each, "doc_id long, filter string, by string, data binary, size int")
    params = F.when(F.col("filter") == "Predictor", F.create_map(F.lit("Predictor"), F.lit(15), F.lit("Columns"), F.lit(16)))
    back = rows.select("doc_id", "filter", "size", codecs.decoded_each(F.col("by"), F.col("data"), params).alias("data"))
    whole = F.when(F.col("filter") == "Predictor", F.substring("data", F.lit(1), F.col("size"))).otherwise(F.col("data"))  # without what fills the last row
    return back.select("doc_id", "filter", F.md5(whole).alias("digest"))


# recognised pages


@query(
    """WITH d AS (SELECT doc_id, source, lang, doc_id % 4 AS k FROM documents) SELECT doc_id, CAST(0 AS INT) AS block_ix, 'heading' AS role, CAST(doc_id % 5 + 1 AS INT) AS level, source AS text, CAST(NULL AS VARCHAR) AS alt, CAST(0.5 AS DOUBLE) AS x0 FROM d UNION ALL SELECT doc_id, 1, 'list_item', 2, lang, NULL, NULL FROM d
    UNION ALL SELECT doc_id, 2, 'list_item', 1, 'a <b> c', NULL, NULL FROM d UNION ALL SELECT doc_id, 2 + i, 'table_cell', 0, concat('cell ', i), NULL, 1.0 FROM d, (SELECT unnest([1, 2, 3]) AS i) UNION ALL SELECT doc_id, 6, 'figure', 0, '', 'pie_chart', NULL FROM d UNION ALL SELECT doc_id, 7, 'paragraph', 0, 'loose', NULL, NULL FROM d"""
)
def doctags_pages(spark, sf):
    d = read(spark, sf, "documents")
    level = (F.col("doc_id") % 5).cast("string")
    tags = F.concat(
        F.lit("<doctag><section_header_level_"), level, F.lit("><loc_1><loc_2><loc_3><loc_4>"), "source", F.lit("</section_header_level_"), level, F.lit("><unordered_list><ordered_list><list_item>"), "lang",
        F.lit("</list_item></ordered_list><list_item>a <b> c</list_item></unordered_list><otsl><loc_2><loc_2><loc_3><loc_4><ched>cell 1<fcel>cell 2<nl><ecel><fcel> cell 3 <nl></otsl><picture><pie_chart></picture>loose</doctag>"),
    )
    made_of = d.select("doc_id", F.lit(1).alias("page"), tags.alias("tags"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(250.0).alias("width"), F.lit(500.0).alias("height"))
    return R.tagged_blocks(made_of).select("doc_id", "block_ix", "role", "level", "text", "alt", "box.x0")


def _sparse(n: int) -> bytes:
    """Pages that are empty, have a word, or are full of lines."""
    full = b"BT /F1 12 Tf 14 TL 40 760 Td " + b" ".join(w.literal("many words of a page that is full of text from side to side, and so on and on") + b" Tj T*" for _ in range(52)) + b" ET"
    return w.document([[b"", b"BT /F1 12 Tf 300 400 Td (word) Tj ET", full][(n + i) % 3] for i in range(n % 4 + 1)])


_SPARSE = "WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(unnest(range(0, p_partkey % 4 + 1)) AS INT) AS i, p_partkey AS n FROM part), k AS (SELECT doc_id, i + 1 AS page, (n + i) % 3 AS kind FROM p)"


def _sparse_files(spark: SparkSession, sf: str) -> DataFrame:
    return made(read(spark, sf, "part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", "p_partkey AS n"), _sparse)


@query(f"{_SPARSE} SELECT doc_id, page, concat(CASE WHEN kind < 2 THEN 'ocr ' ELSE 'keep' END, ' page ', page, chr(9), CASE kind WHEN 2 THEN 'full' ELSE 'coverage   0.' || CASE kind WHEN 0 THEN '0' ELSE '1' END || '%' END, chr(9), CASE kind WHEN 0 THEN 0 ELSE 1 END, ' block(s)') AS line FROM k")
def recognition_plan(spark, sf):
    """What would be recognised: pages without text, or with next to none."""
    lines = R.plan_lines(R.routed(R.page_coverages(_sparse_files(spark, sf))))
    return lines.select("doc_id", "page", F.regexp_replace("line", r"coverage +[5-9][0-9]\.\d%", "full").alias("line"))


@query(f"{_SPARSE} SELECT doc_id, page, CASE kind WHEN 2 THEN 'text' ELSE CASE WHEN (doc_id + page) % 5 = 0 THEN CASE kind WHEN 1 THEN 'word' ELSE '' END WHEN (doc_id + page) % 5 = 1 THEN 'half' ELSE concat('read ', doc_id + page) END END AS text FROM k")
def recognised_pages(spark, sf):
    """Recognised text in place of a page's own; a page that fails keeps its own, and what was written before a failure counts."""
    files = _sparse_files(spark, sf)
    keyed = files.withColumn("payload", F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0").cast("binary"), "payload"))

    def rasterise(payload: bytes, page: int, dpi: float) -> tuple[int, tuple[float, float]]:
        return int(payload[:12]) + page, (612.0, 792.0)

    def engine(image: int) -> str:
        if image % 5 == 0:
            raise RuntimeError("no answer")
        if image % 5 == 1:
            failed = RuntimeError("broke off")
            failed.partial = "<doctag><text>half"
            raise failed
        return f"<doctag><text><loc_1><loc_1><loc_9><loc_9>read {image}</text></doctag>"

    out = R.recognised_texts(keyed, rasterise, engine)
    return out.select("doc_id", "page", F.when(F.startswith("text", F.lit("many words")), "text").otherwise(F.col("text")).alias("text"))


# reports on outlines


@query(REPORTS + " SELECT doc_id, CAST(2 + 2 * count(*) - count(*) FILTER (WHERE i % 4 = 1) AS INT) AS elements, CAST(count(*) AS INT) AS headings, CAST(count(*) FILTER (WHERE i % 4 <> 1) AS INT) AS paragraphs, CAST(2 * count(*) - count(*) FILTER (WHERE i % 4 = 1) AS INT) AS mcids, CAST(2 AS INT) AS max_depth, 'tagged' AS path FROM h GROUP BY doc_id")
def pdf_tag_stats(spark, sf):
    """The tags in the report on each file."""
    return P.probe(reports(spark, sf, True)).select("doc_id", "tags.elements", "tags.headings", "tags.paragraphs", "tags.mcids", "tags.max_depth", "path")


@query(REPORTS + " SELECT doc_id, CAST(count(*) AS INT) AS concepts, CAST(1 + count(DISTINCT i // 3) FILTER (WHERE i % 3 > 0) AS INT) AS indexes, CAST(0 AS INT) AS links, CAST(count(DISTINCT i // 3) FILTER (WHERE i % 3 > 0) AS INT) AS dirs FROM h GROUP BY doc_id")
def pdf_bundle_stats(spark, sf):
    return P.bundle_stats(reports(spark, sf, False))
