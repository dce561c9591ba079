"""PDF files as rows: each file is read in the Arrow batch that holds it, so nothing is shuffled.

Every function takes a DataFrame with an id and the bytes of a file (read_files gives one) and reads only what its rows need. A file
that can't be read gives no rows, but for probe, which says why. A very long file may be cut into tasks of pages first
(page_tasks): then the tables by page read only the pages of their task.

Defined results: null and empty bytes give no rows; a page that can't be read is an empty page; repeated rows give repeated rows;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirefold.document import bundle as B
from quirefold.document import layout, markdown, outline, tags
from quirefold.document.model import Block, Document, Outline
from quirefold.sources.pdf import images as im
from quirefold.sources.pdf.objects import Store, Stream
from quirefold.sources.pdf.page import Policy, read_document, read_page
from quirefold.sources.pdf.tokens import Name, Ref, operators as content_operators

PAGES_A_TASK, ROWS_A_BATCH = 64, 4096
TASKS_A_CORE, LEAST_TASKS = 4, 48
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
STYLE = "struct<font: string, size: double, bold: boolean, italic: boolean, mono: boolean, hidden: boolean>"


def read_files(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """doc_id, path, payload of the files under some paths or patterns."""
    found = spark.read.format("binaryFile")
    found = found.option("pathGlobFilter", glob) if glob else found
    return found.load(list(paths)).select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("payload"))


def spread(rows: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """The rows in several tasks for each core, by some columns: where a row takes Python much longer than reading it takes, a small table is more than the one task of its one row group.

    The number of tasks is given, so adaptive execution doesn't join the small ones together again; executors that aren't there yet count by the
    session's shuffle partitions, up to LEAST_TASKS of them. least: a number of tasks that the caller needs.
    """
    spark = rows.sparkSession
    known, planned = TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(known, min(planned, LEAST_TASKS), least), *by)


def page_tasks(files: DataFrame, pages: int = PAGES_A_TASK) -> DataFrame:
    """doc_id, payload, first, last: a row for every so many pages of a file."""

    def rows(store: Store, *_: Any) -> Iterator[tuple]:
        for first in range(1, len(store.pages) + 1, pages):
            yield first, min(first + pages - 1, len(store.pages))

    return _each(files, rows, "first int, last int", keep_payload=True)


def _each(files: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, keep_payload: bool = False, failed: Callable[[str], tuple] | None = None) -> DataFrame:
    """The rows that fn makes of each file's store; fn gets the range of pages too."""
    names = [c for c in ("doc_id", "payload", "first", "last") if c in files.columns]
    full = "doc_id long, " + ("payload binary, " if keep_payload else "") + schema
    arrow = to_arrow_schema(T.StructType.fromDDL(full))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in source:
            ids, payloads = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                data = payloads[i].as_py()
                if not data:
                    continue
                pages = (batch.column(2)[i].as_py(), batch.column(3)[i].as_py()) if len(names) == 4 else (1, None)
                lead = (ids[i].as_py(), data) if keep_payload else (ids[i].as_py(),)
                try:
                    for row in fn(Store(data), *pages):
                        rows.append(lead + row)
                        if len(rows) >= ROWS_A_BATCH:
                            yield _batch(rows, arrow)
                            rows = []
                except (ValueError, RecursionError) as e:
                    if failed:
                        rows.append(lead + failed(f"{type(e).__name__}: {e}"))
        if rows:
            yield _batch(rows, arrow)

    kinds = [F.col("doc_id").cast("long"), *(F.col(c) for c in names[1:])]
    return files.select(*kinds).mapInArrow(batches, full)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _box(b: tuple | None) -> dict | None:
    return dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) if b else None


def _pages(store: Store, first: int, last: int | None) -> range:
    return range(first, (last or len(store.pages)) + 1)


# what a file is


PROBE = (
    "error string, version string, pages int, encrypted boolean, object_streams boolean, xref_streams boolean, linearized boolean, hybrid boolean, tagged boolean, mark_info boolean, struct_tree_root boolean, "
    "tags struct<elements: int, headings: int, paragraphs: int, tables: int, figures: int, lists: int, mcids: int, max_depth: int, top_roles: map<string, int>>, lang string, filters array<string>, "
    "fonts array<string>, images int, path string, page_detail array<struct<page: int, width_pt: double, height_pt: double, rotate: int, content_len: int, fonts: int, xobjects: int>>"
)


def _resources(store: Store) -> tuple[set[str], set[str], int, list[dict]]:
    """Filters and font types in use, images, and what each page has; forms are gone into, each object once."""
    filters: set[str] = set()
    fonts: set[str] = set()
    seen: set[int] = set()
    count, detail = 0, []

    def walk(resources: dict | None, depth: int) -> tuple[int, int]:
        nonlocal count
        own = store.dict(resources, "Font") or {}
        for v in own.values():
            info = store.resolve(v)
            if isinstance(info, dict) and (kind := store.name(info, "Subtype")):
                fonts.add(kind)
        objects = store.dict(resources, "XObject") or {}
        for v in objects.values():
            if isinstance(v, Ref):
                if v.num in seen:
                    continue
                seen.add(v.num)
            s = store.resolve(v)
            if not isinstance(s, Stream):
                continue
            filters.update(store.filters(s))
            kind = store.name(s.info, "Subtype")
            count += kind == "Image"
            if kind == "Form" and depth + 1 < im.MAX_FORMS:
                walk(store.dict(s.info, "Resources") or resources, depth + 1)
        return len(own), len(objects)

    for number, page in enumerate(store.pages, 1):
        box = store.rect(page, "MediaBox") or (0.0, 0.0, 0.0, 0.0)
        n_fonts, n_objects = walk(store.dict(page, "Resources"), 0)
        detail.append({"page": number, "width_pt": box[2] - box[0], "height_pt": box[3] - box[1], "rotate": store.int(page, "Rotate") or 0, "content_len": len(store.content(page)), "fonts": n_fonts, "xobjects": n_objects})
    return filters, fonts, count, detail


def route_of(encrypted: bool, tagged: bool, has_fonts: bool) -> str:
    """How text is to be had from a file."""
    return "encrypted" if encrypted else "tagged" if tagged else "layout" if has_fonts else "ocr"


def probe(files: DataFrame) -> DataFrame:
    """A report on each file, also on those that can't be read."""

    def rows(store: Store, *_: Any) -> Iterator[tuple]:
        stats, root = store.stats(), tags.read(store)
        found = tags.stats(root) if root else None
        usable = bool(found and (found["headings"] or found["paragraphs"]))
        summary = {**found, "top_roles": tags.top_roles(found.pop("roles"))} if found else None
        marked = bool(store.bool(store.dict(store.catalog, "MarkInfo"), "Marked"))
        filters, fonts, count, detail = _resources(store)
        yield (
            None, store.version, len(store.pages), store.encrypted, stats["object_streams"], stats["xref_streams"], stats["linearized"], stats["hybrid"], usable, marked, root is not None,
            summary, store.text(store.catalog, "Lang") or None, sorted(filters), sorted(fonts), count, route_of(store.encrypted, usable, bool(fonts)), detail,
        )

    width = len(T.StructType.fromDDL(PROBE))
    return _each(files, rows, PROBE, failed=lambda e: (e, *[None] * (width - 3), "unknown", None))


def report_text(reports: DataFrame) -> DataFrame:
    """doc_id, text, json: each report for people and for programs."""
    structure = F.array_compact(F.array(F.when(F.col("struct_tree_root"), "StructTreeRoot"), F.when(F.col("mark_info"), "Marked")))
    structure = F.when(F.size(structure) == 0, "untagged").otherwise(F.concat(F.array_join(structure, " + "), F.when(F.col("tagged"), "").otherwise(" (stub, unusable)")))
    flags = (("ObjStm", "object_streams"), ("XRefStm", "xref_streams"), ("linearized", "linearized"), ("hybrid", "hybrid"))
    streams = F.array_compact(F.array(*[F.when(F.col(k), n) for n, k in flags]))
    streams = F.when(F.size(streams) == 0, "plain xref table").otherwise(F.array_join(streams, ", "))
    roles = F.array_sort(F.map_entries("tags.top_roles"), lambda a, b: F.when(a["value"] != b["value"], b["value"] - a["value"]).when(a["key"] < b["key"], -1).otherwise(1))
    roles = F.array_join(F.transform(roles, lambda r: F.concat(r["key"], F.lit("="), r["value"])), " ")
    listed = lambda c: F.when(F.size(c) == 0, "none").otherwise(F.array_join(c, ", "))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("version "), "version"), F.concat(F.lit("pages "), "pages"), F.concat(F.lit("structure "), structure), F.concat(F.lit("roles "), roles),
        F.concat(F.lit("streams "), streams), F.concat(F.lit("fonts "), listed("fonts")), F.concat(F.lit("images "), "images"), F.concat(F.lit("path "), "path"),
    )
    whole = F.to_json(F.struct(*[c for c in reports.columns if c != "doc_id"]))
    return reports.select("doc_id", F.when(F.col("error").isNotNull(), F.concat(F.lit("error "), "error")).otherwise(lines).alias("text"), whole.alias("json"))


METADATA = "title string, author string, subject string, keywords string, creator string, producer string, created string, modified string, lang string, version string, tagged boolean, encrypted boolean"


def metadata(files: DataFrame) -> DataFrame:
    return _each(files, lambda store, *_: [tuple(store.metadata().values())], METADATA)


def stats(files: DataFrame) -> DataFrame:
    """How each file is laid out, in bytes and objects."""
    schema = "file_size long, linearized boolean, hybrid boolean, object_streams boolean, xref_streams boolean, binary_size long, image_size long, font_size long, objects int"
    return _each(files, lambda store, *_: [tuple(store.stats().values())], schema)


def _plain(v: Any) -> Any:
    """An object for JSON: names with a slash, strings as text, references as in the file."""
    if isinstance(v, Name):
        return "/" + v
    if isinstance(v, Ref):
        return f"{v.num} {v.gen} R"
    if isinstance(v, bytes):
        return v.decode("latin-1")
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def objects(files: DataFrame) -> DataFrame:
    """doc_id, num, kind, json, data: the objects of each file, streams decoded where their filters are known."""

    def rows(store: Store, *_: Any) -> Iterator[tuple]:
        for num in sorted(n for n, e in store.entries.items() if e[0] >= 0):
            v = store.resolve(Ref(num, 0))
            kind = "stream" if isinstance(v, Stream) else "name" if isinstance(v, Name) else {dict: "dict", list: "array", bytes: "string", int: "int", float: "real", bool: "bool"}.get(type(v), "null")
            yield num, kind, json.dumps(_plain(v.info if isinstance(v, Stream) else v), ensure_ascii=False), store.decoded(v) if isinstance(v, Stream) else None

    return _each(files, rows, "num int, kind string, json string, data binary")


# pages


def pages(files: DataFrame) -> DataFrame:
    """doc_id, page, box, rotate, content: every page, with what it inherits."""

    def rows(store: Store, first: int, last: int | None) -> Iterator[tuple]:
        for n in _pages(store, first, last):
            p = store.pages[n - 1]
            yield n, _box(store.page_box(p)), store.int(p, "Rotate") or 0, store.content(p)

    return _each(files, rows, f"page int, box {BOX}, rotate int, content binary")


def operators(files: DataFrame) -> DataFrame:
    """doc_id, page, seq, op, operands (JSON), inline: the operators of each page's content."""

    def rows(store: Store, first: int, last: int | None) -> Iterator[tuple]:
        for n in _pages(store, first, last):
            for seq, op in enumerate(content_operators(store.content(store.pages[n - 1]))):
                yield n, seq, op.name, json.dumps([_plain(v) for v in op.operands], ensure_ascii=False), op.inline

    return _each(files, rows, "page int, seq int, op string, operands string, inline binary")


def glyphs(files: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The glyphs of each page in the order shown, with place, advance, style and marked content."""

    def rows(store: Store, first: int, last: int | None) -> Iterator[tuple]:
        fonts: dict = {}
        for n in _pages(store, first, last):
            for seq, g in enumerate(read_page(store, n, fonts, policy, record=True)[1].placed):
                yield n, seq, g.text, g.code, g.orient, g.along, g.end, g.cross, g.gap, g.height, g.space, g.style._asdict(), g.mcid, g.artifact

    return _each(files, rows, f"page int, seq int, text string, code long, orient int, along double, end double, cross_pos double, gap double, height double, space double, style {STYLE}, mcid int, artifact boolean")


def lines(files: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The lines of each page: text, place, extent, height, size of most characters, and whether all of it is an artifact."""

    def rows(store: Store, first: int, last: int | None) -> Iterator[tuple]:
        fonts: dict = {}
        for n in _pages(store, first, last):
            for i, ln in enumerate(read_page(store, n, fonts, policy)[1].lines, 1):
                x0, x1 = ln.extent()
                yield n, i, "".join(f.text for f in ln.fragments), ln.orient, ln.cross, x0, x1, ln.height(), ln.size(), ln.space(), all(f.artifact for f in ln.fragments)

    return _each(files, rows, "page int, line int, text string, orient int, cross_pos double, x0 double, x1 double, height double, size double, space double, artifact boolean")


def rules(files: DataFrame) -> DataFrame:
    """The painted level and upright segments of each page."""

    def rows(store: Store, first: int, last: int | None) -> Iterator[tuple]:
        for n in _pages(store, first, last):
            for i, r in enumerate(read_page(store, n)[1].rules):
                yield n, i, r.vertical, r.pos, r.lo, r.hi

    return _each(files, rows, "page int, rule_ix int, vertical boolean, pos double, lo double, hi double")


BLOCK = (
    f"page int, block_ix int, role string, level int, marker string, text string, box {BOX}, cell struct<table: int, row: int, col: int, header: boolean>, lang string, alt string, replacement string, mcids array<int>, "
    f"spans array<struct<text: string, style: {STYLE}, box: {BOX}, mcid: int>>"
)


def _block(b: Block) -> tuple:
    spans = [{"text": s.text, "style": s.style._asdict(), "box": _box(s.box), "mcid": s.mcid} for s in b.spans]
    return b.role, b.level, b.marker or None, b.text, _box(b.box), b.cell._asdict() if b.cell else None, b.lang or None, b.alt or None, b.replacement or None, b.mcids, spans


def blocks(files: DataFrame, policy: Policy | None = None, roles: bool = False) -> DataFrame:
    """The blocks of each page. roles: with tables, headings and lists from the geometry of the whole file (not in page tasks)."""

    def rows(store: Store, first: int, last: int | None) -> Iterator[tuple]:
        fonts: dict = {}
        doc = Document([read_page(store, n, fonts, policy)[0] for n in _pages(store, first, last)])
        if roles:
            layout.infer_roles(doc)
        for p in doc.pages:
            for i, b in enumerate(p.blocks):
                yield (p.number, i, *_block(b))

    return _each(files, rows, BLOCK)


def images(files: DataFrame, data: bool = False) -> DataFrame:
    """The images of each file; data: with the files that they make."""

    def rows(store: Store, *_: Any) -> Iterator[tuple]:
        found = im.images(store)
        for i, x in enumerate(found, 1):
            ext = x.extension
            name = im.file_name(i, len(found), x.page, ext) if ext else None
            mask = im.file_name(i, len(found), x.page, x.mask.extension, True) if x.mask and x.mask.extension else None
            yield (
                i, x.page, x.name, x.ref, x.width, x.height, x.bits, x.codec, "stencil" if x.stencil else x.family or "?", x.components, x.alpha, x.premultiplied, x.recoverable, ext,
                name, im.encoded(x) if data else None, mask, im.encoded(x.mask) if data and mask else None,
            )

    schema = "image_ix int, page int, name string, ref int, width int, height int, bits int, codec string, space string, components int, alpha boolean, premultiplied boolean, recoverable boolean, extension string, "
    return _each(files, rows, schema + "file string, data binary, mask_file string, mask_data binary")


# structure


def elements(files: DataFrame) -> DataFrame:
    """doc_id, elem_id, parent_id, ord, depth, role, raw_role, title, lang, actual, alt, page, claims: the tree of tags, ids in the order of the walk."""

    def rows(store: Store, *_: Any) -> Iterator[tuple]:
        root, ids, places = tags.read(store), {}, {}
        for e, depth in tags.walk(root) if root else ():
            ids[id(e)] = len(ids)
            places.update((id(x), i) for i, x in enumerate(e.inside))
            at = places[id(e)] if e.parent else None
            claims = [{"ord": i, "page": c.page, "mcid": c.mcid} for i, c in enumerate(e.inside) if isinstance(c, tags.Claim)]
            yield ids[id(e)], ids[id(e.parent)] if e.parent else None, at, depth, e.role, e.raw, e.title or None, e.lang or None, e.actual or None, e.alt or None, e.page, claims

    schema = "elem_id int, parent_id int, ord int, depth int, role string, raw_role string, title string, lang string, actual string, alt string, page int, claims array<struct<ord: int, page: int, mcid: int>>"
    return _each(files, rows, schema)


def outline_of(store: Store, policy: Policy | None = None) -> Outline:
    """By the tree of tags if the file has one, else by roles from the geometry."""
    doc = read_document(store, policy)
    root = tags.read(store)
    if root is not None:
        return outline.tagged(doc, root)
    layout.infer_roles(doc)
    return outline.untagged(doc)


def sections(files: DataFrame) -> DataFrame:
    """doc_id, sec_ix, parent_ix, level, number, title, first_page, last_page, path, text, blocks: parents first."""

    def rows(store: Store, *_: Any) -> Iterator[tuple]:
        ids: dict[int, int] = {}
        for s in outline_of(store).walk():
            ids[id(s)] = len(ids)
            yield ids[id(s)], ids[id(s.parent)] if s.parent else None, s.level, s.number or None, s.title, s.first_page, s.last_page, s.path(), s.text, len(s.blocks)

    return _each(files, rows, "sec_ix int, parent_ix int, level int, number string, title string, first_page int, last_page int, path array<string>, text string, blocks int")


def outline_blocks(files: DataFrame) -> DataFrame:
    """The blocks of the outline: place says preamble, section (sec_ix) or unplaced (page)."""

    def rows(store: Store, *_: Any) -> Iterator[tuple]:
        o = outline_of(store)
        parts = [("preamble", None, 0, o.preamble), *(("section", i, 0, s.blocks) for i, s in enumerate(o.walk())), *(("unplaced", None, p.number, p.blocks) for p in o.unplaced)]
        for place, sec, page, own in parts:
            for i, b in enumerate(own):
                yield (place, sec, page, i, *_block(b))

    return _each(files, rows, "place string, sec_ix int, " + BLOCK)


# sinks


def markdown_files(files: DataFrame, front: bool = False, artifacts: bool = False, flat: bool = False) -> DataFrame:
    """doc_id, markdown: each file as one text. flat: pages as they are, without sections or roles."""

    def rows(store: Store, *_: Any) -> Iterator[tuple]:
        policy = Policy(keep_artifacts=artifacts)
        yield (markdown.of_document(read_document(store, policy), front, artifacts) if flat else markdown.of_outline(outline_of(store, policy), front, artifacts),)

    return _each(files, rows, "markdown string")


def markdown_pages(files: DataFrame, front: bool = False, artifacts: bool = False) -> DataFrame:
    """doc_id, page, file, markdown: each page as a text, file names padded to the number of pages."""

    def rows(store: Store, first: int, last: int | None) -> Iterator[tuple]:
        fonts, meta, total = {}, store.metadata(), len(store.pages)
        for n in _pages(store, first, last):
            page = read_page(store, n, fonts, Policy(keep_artifacts=artifacts))[0]
            yield n, markdown.page_name(n, total), markdown.of_page(page, meta, total, front, artifacts)

    return _each(files, rows, "page int, file string, markdown string")


def bundles(files: DataFrame, options: B.Options | None = None) -> DataFrame:
    """doc_id, path, content: each file as a bundle of linked sections; one without sections has none."""

    def rows(store: Store, *_: Any) -> Iterator[tuple]:
        o = outline_of(store, Policy(keep_artifacts=bool(options and options.artifacts)))
        if o.sections:
            yield from B.bundle(o, options)[0]

    return _each(files, rows, "path string, content string")


def bundle_stats(files: DataFrame, options: B.Options | None = None) -> DataFrame:
    """doc_id, concepts, indexes, links, dirs."""
    return _each(files, lambda store, *_: [tuple(B.bundle(outline_of(store), options)[1].values())], "concepts int, indexes int, links int, dirs int")
