"""Queries over PDF files. The tables have none, so each query writes files from rows, reads them, and is held against SQL on the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import files as P
from quirefold.sources.pdf import writer as w
from quirefold.sources.pdf.tokens import Name

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


def made(rows: DataFrame, build: Callable[..., bytes], spread: bool = True) -> DataFrame:
    """doc_id, payload: a file from each row, in tasks of about as many rows unless they are spread already; build gets the columns behind doc_id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                cols = [c.slice(k, 256).to_pylist() for c in b.columns]
                payloads = [build(*row[1:]) for row in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(payloads, pa.binary())], ["doc_id", "payload"])

    return (P.spread(rows, "doc_id") if spread else rows).mapInArrow(each, "doc_id long, payload binary")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_texts(documents: DataFrame) -> DataFrame:
    """doc_id, text in tasks for all cores. Texts are large, so a table of as many files as there are cores isn't shuffled."""
    rows = documents.select("doc_id", "text")
    return rows if len(documents.inputFiles()) >= documents.sparkSession.sparkContext.defaultParallelism else P.spread(rows, "doc_id")


# texts of documents, fifty lines a page, in a table or in packed streams


def _text_file(number: int, text: str) -> bytes:
    return w.document(w.text_pages(text.split("\n")), compact=number % 3 == 0, packed=number % 2 == 0)


def text_files(spark: SparkSession, sf: str) -> DataFrame:
    return made(spread_texts(read(spark, sf, "documents")).selectExpr("doc_id", "doc_id AS number", "text"), _text_file, spread=False)


TEXT_LINES = """WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
l AS (SELECT doc_id, CAST((i - 1) // 50 + 1 AS INT) AS page, i, text FROM raw WHERE text <> '')"""


@query(TEXT_LINES + " SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS INT) AS line, text FROM l")
def pdf_lines(spark, sf):
    """Objects, content, fonts and placing: the lines come out as they went in."""
    return P.lines(text_files(spark, sf)).select("doc_id", "page", "line", "text")


BREAKS = r"""lag(i) OVER o IS DISTINCT FROM i - 1"""
JOINED = r"""CASE WHEN lag(text) OVER o IS NULL OR regexp_matches(lag(text) OVER o, '\s$') OR regexp_matches(text, '^\s') OR regexp_matches(lag(text) OVER o, '[\p{L}\p{Nd}][\p{Pd}\x{AD}\x{2212}]+$') THEN '' ELSE ' ' END"""


@query(
    TEXT_LINES
    + f""", g AS (SELECT doc_id, page, i, text, {BREAKS} AS fresh, {JOINED} AS sep FROM l WINDOW o AS (PARTITION BY doc_id, page ORDER BY i)),
k AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, page ORDER BY i) AS b FROM g),
t AS (SELECT doc_id, page, b, string_agg(CASE WHEN fresh THEN text ELSE sep || text END, '' ORDER BY i) AS text FROM k GROUP BY doc_id, page, b)
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY b) - 1 AS INT) AS block_ix, text FROM t WHERE trim(text) <> ''"""
)
def pdf_blocks(spark, sf):
    """Lines to paragraphs: an empty line parts them."""
    return P.blocks(text_files(spark, sf)).select("doc_id", "page", "block_ix", "text")


@query(TEXT_LINES + ", n AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents) SELECT doc_id, CAST(lines AS BIGINT) AS shown, CAST(ceil(lines / 50.0) AS BIGINT) AS pages, CAST(lines AS BIGINT) AS ends FROM n")
def pdf_operators(spark, sf):
    """The operators of the content streams, counted."""
    found = P.operators(text_files(spark, sf))
    return found.groupBy("doc_id").agg(F.count_if(F.col("op") == "Tj").alias("shown"), F.count_if(F.col("op") == "BT").alias("pages"), F.count_if(F.col("op") == "T*").alias("ends"))


@query("SELECT doc_id, doc_id % 3 = 0 AS object_streams, doc_id % 3 = 0 AS xref_streams, false AS linearized, CAST(3 + 2 * ceil(len(string_split(text, chr(10))) / 50.0) + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS INT) AS objects FROM documents")
def pdf_stats(spark, sf):
    """How the files are laid out."""
    return P.stats(text_files(spark, sf)).select("doc_id", "object_streams", "xref_streams", "linearized", "objects")


@query("SELECT doc_id, CAST(ceil(len(string_split(text, chr(10))) / 50.0) AS INT) AS pages, 'layout' AS path, 'untagged' AS structure, CASE WHEN doc_id % 3 = 0 THEN 'ObjStm, XRefStm' ELSE 'plain xref table' END AS streams, 'Type1' AS fonts FROM documents")
def pdf_probe(spark, sf):
    """The report on each file, as text."""
    reports = P.probe(text_files(spark, sf))
    line = lambda key: F.regexp_extract("text", f"(?m)^{key} (.*)$", 1).alias(key)
    return P.report_text(reports).select("doc_id", line("pages").cast("int").alias("pages"), line("path"), line("structure"), line("streams"), line("fonts"))


# reports: a numbered part or item for each order of a customer, with a sentence below


def _report(keys: list[int], words: list[str], tagged: bool, every: int) -> bytes:
    """A heading and a sentence for each key; every third is a part, the others are items of it. With tags, each `every`-th sentence is unclaimed."""
    orders = sorted(zip(keys, words, strict=True))
    lines: list[tuple[str, str, int, str]] = []  # font, text, marked content, tag
    for i, (key, word) in enumerate(orders):
        part, item = i // 3 + 1, i % 3
        lines.append(("F2", f"{part} Part {word}" if item == 0 else f"{part}.{item} Item {key}", 2 * i, "Heading1" if item == 0 else "H2"))
        lines.append(("F1", f"Order {key} is the entry number {i + 1} of this list of orders.", -1 if tagged and i % every == 1 else 2 * i + 1, "P"))
    pages, refs = [lines[i : i + 20] for i in range(0, len(lines), 20)], []
    out = w.Writer()
    root, tree, struct, top = out.add(), out.add(), out.add(), out.add()
    fonts = {"F1": out.add(w.font()), "F2": out.add(w.font("Helvetica-Bold"))}
    for own in pages:
        parts = []
        for k, (font, text, mcid, tag) in enumerate(own):
            shown = b"BT /%s %d Tf 72 %d Td %s Tj ET" % (font.encode(), 14 if font == "F2" else 10, 740 - 30 * k, w.literal(text))
            parts.append(b"/%s <</MCID %d>> BDC %s EMC" % (tag.encode(), mcid, shown) if tagged and mcid >= 0 else shown)
        refs.append(out.add({"Type": Name("Page"), "Parent": tree, "Contents": out.stream(b"\n".join(parts), packed=True)}))
    catalog = {"Type": Name("Catalog"), "Pages": tree}
    if tagged:
        kids = [out.add({"S": Name(tag), "P": top, "Pg": refs[k // 20], "K": mcid}) for k, (_, _, mcid, tag) in enumerate(lines) if mcid >= 0]
        out.put(top, {"S": Name("Document"), "P": struct, "K": kids})
        out.put(struct, {"Type": Name("StructTreeRoot"), "K": top, "RoleMap": {"Heading1": Name("H1")}})
        catalog |= {"StructTreeRoot": struct, "MarkInfo": {"Marked": True}}
    out.put(tree, {"Type": Name("Pages"), "Kids": refs, "Count": len(refs), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": fonts}})
    out.put(root, catalog)
    return out.finish({"Root": root}, compact=True)


def reports(spark: SparkSession, sf: str, tagged: bool) -> DataFrame:
    orders = read(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("doc_id"), "o_orderkey", "o_orderpriority")
    rows = P.spread(orders, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("o"))
    return made(rows.select("doc_id", "o.o_orderkey", "o.o_orderpriority"), lambda keys, words: _report(keys, words, tagged, 4))


REPORTS = """WITH o AS (SELECT CAST(o_custkey AS BIGINT) AS doc_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderpriority) - 1 AS i FROM orders),
h AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN i % 3 = 0 THEN CAST(i // 3 + 1 AS VARCHAR) ELSE concat(i // 3 + 1, '.', i % 3) END AS number,
CASE WHEN i % 3 = 0 THEN concat('Part ', o_orderpriority) ELSE concat('Item ', o_orderkey) END AS name, concat('Order ', o_orderkey, ' is the entry number ', i + 1, ' of this list of orders.') AS body,
CAST(2 * i // 20 + 1 AS INT) AS p1, CAST((2 * i + 1) // 20 + 1 AS INT) AS p2, CASE WHEN i % 3 = 0 THEN NULL ELSE CAST(i // 3 * 3 AS INT) END AS parent_ix FROM o)"""


@query(REPORTS + " SELECT doc_id, CAST(i AS INT) AS sec_ix, parent_ix, CAST(level AS INT) AS level, number, concat(number, ' ', name) AS title, p1 AS first_page, p2 AS last_page, body AS text FROM h")
def pdf_sections(spark, sf):
    """Sections of files without tags: headings by size, weight and number."""
    return P.sections(reports(spark, sf, False)).select("doc_id", "sec_ix", "parent_ix", "level", "number", "title", "first_page", "last_page", "text")


@query(
    REPORTS
    + """ SELECT doc_id, CAST(i AS INT) AS sec_ix, parent_ix, CAST(level AS INT) AS level, concat(number, ' ', name) AS title, p1 AS first_page, CASE WHEN i % 4 = 1 THEN p1 ELSE p2 END AS last_page, CASE WHEN i % 4 = 1 THEN '' ELSE body END AS text FROM h"""
)
def pdf_tagged_sections(spark, sf):
    """Sections of tagged files: the tree says what is a heading, and claims the text."""
    return P.sections(reports(spark, sf, True)).select("doc_id", "sec_ix", "parent_ix", "level", "title", "first_page", "last_page", "text")


@query(REPORTS + " SELECT doc_id, p2 AS page, body AS text FROM h WHERE i % 4 = 1")
def pdf_unplaced(spark, sf):
    """What no element of the tree claims, by page."""
    return P.outline_blocks(reports(spark, sf, True)).where("place = 'unplaced'").select("doc_id", "page", "text")


@query(
    REPORTS
    + """ SELECT doc_id, CAST(0 AS INT) AS elem_id, 0 AS depth, 'StructTreeRoot' AS role, 0 AS page, CAST(NULL AS INT) AS mcid FROM h GROUP BY doc_id UNION ALL SELECT doc_id, 1, 1, 'Document', 0, NULL FROM h GROUP BY doc_id
UNION ALL SELECT doc_id, CAST(1 + row_number() OVER (PARTITION BY doc_id ORDER BY mcid) AS INT), 2, role, page, CAST(mcid AS INT) FROM (
SELECT doc_id, 2 * i AS mcid, CASE WHEN level = 1 THEN 'H1' ELSE 'H2' END AS role, p1 AS page FROM h UNION ALL SELECT doc_id, 2 * i + 1, 'P', p2 FROM h WHERE i % 4 <> 1)"""
)
def pdf_elements(spark, sf):
    """The tree of tags with mapped roles, depths and inherited pages."""
    return P.elements(reports(spark, sf, True)).selectExpr("doc_id", "elem_id", "depth", "role", "page", "try_element_at(claims, 1).mcid AS mcid")


@query(REPORTS + " SELECT doc_id, string_agg(concat(repeat('#', level), ' ', number, ' ', name, chr(10), chr(10), body, chr(10)), chr(10) ORDER BY i) AS markdown FROM h GROUP BY doc_id")
def pdf_markdown(spark, sf):
    """Files to Markdown."""
    return P.markdown_files(reports(spark, sf, False))


@query(
    REPORTS
    + """, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, i // 3) AS fam, lower(concat(replace(number, '.', '-'), '-', trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'))) AS s FROM h),
d AS (SELECT doc_id, i // 3 AS g, max(s) FILTER (WHERE level = 1) AS dir FROM n GROUP BY doc_id, i // 3),
f AS (SELECT n.doc_id, CASE WHEN fam = 1 THEN concat('/', s, '.md') WHEN level = 1 THEN concat('/', s, '/', s, '.md') ELSE concat('/', dir, '/', s, '.md') END AS path, concat('# ', number, ' ', name) AS heading FROM n JOIN d ON n.doc_id = d.doc_id AND n.i // 3 = d.g)
SELECT doc_id, path, heading FROM f UNION ALL SELECT DISTINCT doc_id, concat('/', dir, '/index.md'), '# Contents' FROM d JOIN n USING (doc_id) WHERE n.i // 3 = d.g AND fam > 1 UNION ALL SELECT DISTINCT doc_id, '/index.md', '# document' FROM h"""
)
def pdf_bundles(spark, sf):
    """Files to bundles: a path for each section, an index for each folder."""
    return P.bundles(reports(spark, sf, False)).select("doc_id", "path", F.regexp_extract("content", "(?m)^(# .*)$", 1).alias("heading"))


@query(REPORTS + ", p AS (SELECT doc_id, max(p2) AS n FROM h GROUP BY doc_id) SELECT h.doc_id, p1 AS page, concat('page-', lpad(CAST(p1 AS VARCHAR), CAST(len(CAST(n AS VARCHAR)) AS INT), '0'), '.md') AS file, string_agg(concat(number, ' ', name, chr(10), chr(10), body, chr(10)), chr(10) ORDER BY i) AS markdown FROM h JOIN p USING (doc_id) GROUP BY h.doc_id, p1, n")
def pdf_markdown_pages(spark, sf):
    """Files to a text a page; styles show as marks, so they are taken off for the comparison."""
    pages = P.markdown_pages(reports(spark, sf, False))
    return pages.select("doc_id", "page", "file", F.regexp_replace("markdown", r"(?m)^\*\*(.*)\*\*$", "$1").alias("markdown"))


# pages, rules, metadata, images, fonts


def _boxes(n: int) -> bytes:
    page = [{}, {"CropBox": [10, 20, 300 + n % 50, 400]}, {"MediaBox": [500, 0, 100, 700 + n % 7], "Rotate": 90}, {"CropBox": [5, 5, 5, 90]}][n % 4]
    return w.document([b"q %d 0 0 2 10 10 cm 0 0 10 5 re S 0 0 m 30 0 l S 1 1 m 2 2 l n Q" % (n % 3 + 1)] * (n % 2 + 1), page=page)


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(unnest(range(1, p_partkey % 2 + 2)) AS INT) AS page, CAST(CASE p_partkey % 4 WHEN 1 THEN 10 WHEN 2 THEN 100 ELSE 0 END AS DOUBLE) AS x0, CAST(CASE p_partkey % 4 WHEN 1 THEN 20 ELSE 0 END AS DOUBLE) AS y0,
CAST(CASE p_partkey % 4 WHEN 1 THEN 300 + p_partkey % 50 WHEN 2 THEN 500 ELSE 612 END AS DOUBLE) AS x1, CAST(CASE p_partkey % 4 WHEN 1 THEN 400 WHEN 2 THEN 700 + p_partkey % 7 ELSE 792 END AS DOUBLE) AS y1, CAST(CASE p_partkey % 4 WHEN 2 THEN 90 ELSE 0 END AS INT) AS rotate FROM part""")
def pdf_page_boxes(spark, sf):
    """Boxes of pages: cropped, own, inherited; one without an area doesn't count."""
    files = made(read(spark, sf, "part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", "p_partkey AS n"), _boxes)
    return P.pages(files).select("doc_id", "page", "box.x0", "box.y0", "box.x1", "box.y1", "rotate")


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS doc_id, p_partkey % 3 + 1 AS k, CAST(unnest(range(1, p_partkey % 2 + 2)) AS INT) AS page FROM part)
SELECT doc_id, page, v.ix AS rule_ix, v.up AS vertical, CAST(v.pos AS DOUBLE) AS pos, CAST(v.lo AS DOUBLE) AS lo, CAST(v.hi AS DOUBLE) AS hi FROM (SELECT doc_id, page, unnest([{'ix': 0, 'up': false, 'pos': 10, 'lo': 10, 'hi': 10 + 10 * k}, {'ix': 1, 'up': true, 'pos': 10 + 10 * k, 'lo': 10, 'hi': 20},
{'ix': 2, 'up': false, 'pos': 20, 'lo': 10, 'hi': 10 + 10 * k}, {'ix': 3, 'up': true, 'pos': 10, 'lo': 10, 'hi': 20}, {'ix': 4, 'up': false, 'pos': 10, 'lo': 10, 'hi': 10 + 30 * k}]) AS v FROM p)""")
def pdf_rules(spark, sf):
    """Painted segments that are level or upright; slanted and clipping ones aren't."""
    return P.rules(made(read(spark, sf, "part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", "p_partkey AS n"), _boxes))


def _described(n: int, name: str, segment: str) -> bytes:
    info = {"Title": name, "Author": b"\xfe\xff" + f"Ünï – {segment}".encode("utf-16-be"), "Subject": b"\x80 \xa0 \x93" + str(n).encode(), "CreationDate": f"D:2024{n % 12 + 1:02d}{n % 28 + 1:02d}"}
    return w.document([b""], info=info, compact=n % 2 == 0, catalog={"Lang": "en-GB"} | ({"Version": Name("2.0")} if n % 5 == 0 else {}))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, c_name AS title, concat('Ünï – ', c_mktsegment) AS author, concat('• € ﬁ', c_custkey) AS subject, concat('D:2024', lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0'), lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')) AS created, 'en-GB' AS lang,
CASE WHEN c_custkey % 5 = 0 THEN '2.0' ELSE '1.7' END AS version, false AS tagged FROM customer""")
def pdf_metadata(spark, sf):
    """Text strings in both encodings, and what the catalogue says."""
    files = made(read(spark, sf, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS doc_id", "c_custkey AS n", "c_name", "c_mktsegment"), _described)
    return P.metadata(files).select("doc_id", "title", "author", "subject", "created", "lang", "version", "tagged")


def _pictures(n: int) -> bytes:
    out = w.Writer()
    root, tree = out.add(), out.add()
    base = {"Type": Name("XObject"), "Subtype": Name("Image")}
    width, height = n % 7 + 1, n % 5 + 1
    mask = out.stream(bytes([128] * width * height), base | {"Width": width, "Height": height, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")})
    rgb = out.stream(bytes(i % 256 for i in range(3 * width * height)), base | {"Width": width, "Height": height, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB")} | ({"SMask": mask} if n % 2 else {}), packed=True)
    stencil = out.stream(bytes([0b10100000] * height), base | {"Width": 3, "Height": height, "ImageMask": True})
    photo = out.stream(b"\xff\xd8\xff", base | {"Width": 9, "Height": 9, "BitsPerComponent": 8, "ColorSpace": Name("DeviceCMYK"), "Filter": Name("DCTDecode")})
    form = out.stream(b"/B Do", {"Type": Name("XObject"), "Subtype": Name("Form"), "Resources": {"XObject": {"B": stencil, "A": rgb}}})
    page = out.add({"Type": Name("Page"), "Parent": tree, "Resources": {"XObject": {"A": rgb, "F": form} | ({"P": photo} if n % 3 == 0 else {})}})
    out.put(tree, {"Type": Name("Pages"), "Kids": [page, page], "Count": 2, "MediaBox": [0, 0, 10, 10]})
    out.put(root, {"Type": Name("Catalog"), "Pages": tree})
    return out.finish({"Root": root})


@query("""WITH n AS (SELECT CAST(p_partkey AS BIGINT) AS doc_id, p_partkey AS n FROM part)
SELECT doc_id, 1 AS image_ix, 'A' AS name, CAST(n % 7 + 1 AS INT) AS width, CAST(n % 5 + 1 AS INT) AS height, 'raw' AS codec, 'DeviceRGB' AS space, n % 2 = 1 AS alpha, 'img-1-p1.png' AS file, true AS made FROM n
UNION ALL SELECT doc_id, 2, 'B', 3, CAST(n % 5 + 1 AS INT), 'raw', 'stencil', true, 'img-2-p1.png', true FROM n UNION ALL SELECT doc_id, 3, 'P', 9, 9, 'jpeg', 'DeviceCMYK', false, 'img-3-p1.jpg', true FROM n WHERE n % 3 = 0""")
def pdf_images(spark, sf):
    """Images on pages and in forms, each once, and the files that they make."""
    files = made(read(spark, sf, "part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", "p_partkey AS n"), _pictures)
    return P.images(files, data=True).select("doc_id", "image_ix", "name", "width", "height", "codec", "space", "alpha", "file", (F.length("data") > 2).alias("made"))
