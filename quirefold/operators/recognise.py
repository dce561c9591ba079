"""Pages whose text a model has to read: which they are, what would be done, and what comes back.

The rasteriser and the model are the caller's: two functions that run in the Python workers. rasterise(payload, page, dpi) gives an
image of the page and its extent in points, engine(image) gives tagged text. Pages are spread over the cluster before they
are read, as a page may take the model minutes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.document import doctags
from quirefold.functions import geometry as G
from quirefold.operators.files import BOX, PAGES_A_TASK, _each, _pages, page_tasks, spread
from quirefold.operators.joins import replace_pages
from quirefold.sources.pdf.page import read_page

THRESHOLD = 0.05
PAGE = f"page int, box {BOX}, coverage double, blocks int, text string, rasterized boolean"


def page_coverages(files: DataFrame) -> DataFrame:
    """doc_id, page, box, coverage, blocks, text, rasterized: the share of each page that the bounding box of its text has."""

    def rows(store, first: int, last: int | None) -> Iterator[tuple]:  # noqa: ANN001
        fonts: dict = {}
        for n in _pages(store, first, last):
            p = read_page(store, n, fonts)[0]
            yield n, dict(zip(("x0", "y0", "x1", "y1"), p.box, strict=True)), p.coverage(), len(p.blocks), p.text, p.rasterized

    return _each(files, rows, PAGE)


def routed(pages: DataFrame, threshold: float = THRESHOLD, force: bool = False) -> DataFrame:
    """ocr: whether a page goes to the model: one that isn't a picture already, and whose coverage is below the threshold (with force: any)."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is a share of the page")
    low = F.lit(True) if force else F.col("coverage") < threshold
    return pages.withColumn("ocr", ~F.col("rasterized") & low)


def plan_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line: what would be done, a line a page."""
    mark = F.when(F.col("ocr"), "ocr ").otherwise("keep")
    line = F.format_string("%s page %d\tcoverage %5.1f%%\t%d block(s)", mark, "page", F.col("coverage") * 100, "blocks")
    return pages.select("doc_id", "page", line.alias("line"))


def recognised(files: DataFrame, pages: DataFrame, rasterise: Callable[..., Any], engine: Callable[[Any], str], dpi: float = 200.0) -> DataFrame:
    """doc_id, page, tags, extent, error for each page with ocr set. A failure is an error in its row, and no more; what a model wrote before it failed is kept.

    engine may raise an exception with an attribute `partial`, the text until then.
    """
    todo = spread(pages.where("ocr").select("doc_id", "page").join(files.select("doc_id", "payload"), "doc_id"), "doc_id", "page")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, page, payload in zip(frame["doc_id"], frame["page"], frame["payload"], strict=True):
                text, extent, error = _asked(bytes(payload), int(page), rasterise, engine, dpi)
                out.append((doc, page, text, list(extent) if extent else None, error))
            yield pd.DataFrame(out, columns=["doc_id", "page", "tags", "extent", "error"])

    return todo.mapInPandas(each, "doc_id long, page int, tags string, extent array<double>, error string")


def _asked(payload: bytes, page: int, rasterise: Callable[..., Any], engine: Callable[[Any], str], dpi: float) -> tuple[str | None, Any, str | None]:
    """What the model wrote of a page, the page's extent, and what failed."""
    text, extent, error = None, None, None
    try:
        image, extent = rasterise(payload, page, dpi)
        text = engine(image)
    except Exception as e:  # noqa: BLE001 - one page's failure is that page's
        text, error = getattr(e, "partial", None), f"{type(e).__name__}: {e}"
    return (text, extent, error) if text else (None, extent, error or "the model gave no text")


def recognised_texts(files: DataFrame, rasterise: Callable[..., Any], engine: Callable[[Any], str], dpi: float = 200.0, threshold: float = THRESHOLD, force: bool = False) -> DataFrame:
    """doc_id, page, text, error: the texts of all pages, with what the model read of those that routed() sends to it.

    The same as with_recognised() of recognised(), but each file is read once, and only pages for the model take its bytes along. A page whose
    recognition failed keeps its own text.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is a share of the page")

    def rows(store, first: int, last: int | None) -> Iterator[tuple]:  # noqa: ANN001
        fonts: dict = {}
        for n in _pages(store, first, last):
            p = read_page(store, n, fonts)[0]
            yield n, p.text, store.data if not p.rasterized and (force or p.coverage() < threshold) else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_A_TASK):
                part = batch.slice(at, PAGES_A_TASK)
                texts, errors = [], []
                for page, own, payload in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True):
                    tags, _, error = _asked(payload, page, rasterise, engine, dpi) if payload is not None else (None, None, None)
                    texts.append((tags and _text_of(tags, page)) or own)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["doc_id", "page", "text", "error"])

    pages = spread(_each(files, rows, "page int, text string, payload binary"), "doc_id", "page")
    return pages.mapInArrow(each, "doc_id long, page int, text string, error string")


def _text_of(tags: str, page: int) -> str:
    """The text of the blocks of tagged text; empty where it can't be read."""
    try:
        return "\n".join(b.text for b in doctags.parse_page(tags, page, (0.0, 0.0, 0.0, 0.0)).blocks)
    except ValueError:
        return ""


def rasters(files: DataFrame, draw: Callable[..., bytes], dpi: float = 200.0, max_pixels: float = 64e6, extension: str = "png") -> DataFrame:
    """doc_id, page, path, width, height, content, error: each page as an image file; draw(payload, page, width, height) makes it.

    The size is the page's at this resolution, scaled down where it has too many pixels; names are padded to the number of pages.
    """
    sizes = page_tasks(files, 1).select("doc_id", "payload", "first", "last")
    own = _each(sizes, _extents, "page int, total int, width double, height double", keep_payload=True)
    w, h = G.fit(F.col("width"), F.col("height"), F.lit(dpi), F.lit(max_pixels))
    fitted = own.select("doc_id", "payload", "page", "total", w.alias("width"), h.alias("height"))
    fitted = spread(fitted, "doc_id", "page")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                data, error = None, None
                try:
                    data = draw(bytes(r.payload), int(r.page), int(r.width), int(r.height))
                except Exception as e:  # noqa: BLE001 - one page's failure is that page's
                    error = f"{type(e).__name__}: {e}"
                out.append((r.doc_id, r.page, f"page-{r.page:0{len(str(r.total))}d}.{extension}", r.width, r.height, data, error))
            yield pd.DataFrame(out, columns=["doc_id", "page", "path", "width", "height", "content", "error"])

    return fitted.mapInPandas(each, "doc_id long, page int, path string, width long, height long, content binary, error string")


def _extents(store, first: int, last: int | None) -> Iterator[tuple]:  # noqa: ANN001
    for n in _pages(store, first, last):
        x0, y0, x1, y1 = store.page_box(store.pages[n - 1])
        yield n, len(store.pages), x1 - x0, y1 - y0


def tagged_blocks(tagged: DataFrame) -> DataFrame:
    """doc_id, page and the blocks of tagged text; columns doc_id, page, tags and, where boxes are wanted, x0, y0, width, height of the page."""
    places = [c for c in ("x0", "y0", "width", "height") if c in tagged.columns]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "page", "block_ix", "role", "level", "text", "alt", "box", "error"]
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                x0, y0, width, height = (float(getattr(row, c)) for c in places) if len(places) == 4 else (0.0, 0.0, 0.0, 0.0)
                try:
                    page = doctags.parse_page(row.tags or "", int(row.page), (x0, y0, x0 + width, y0 + height))
                    if not page.blocks:
                        raise ValueError(f"no blocks in {len(row.tags or '')} characters")
                    for i, b in enumerate(page.blocks):
                        box = dict(zip(("x0", "y0", "x1", "y1"), b.own_box, strict=True)) if b.own_box else None
                        out.append((row.doc_id, row.page, i, b.role, b.level, b.text, b.alt or None, box, None))
                except ValueError as e:
                    out.append((row.doc_id, row.page, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=names)

    return tagged.mapInPandas(each, f"doc_id long, page int, block_ix int, role string, level int, text string, alt string, box {BOX}, error string")


def with_recognised(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, text: the page's own text, or that of its recognised blocks; a page whose recognition failed keeps its own."""
    new = blocks.where("error IS NULL").groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda b: b["text"]), "\n").alias("text"))
    return replace_pages(pages.select("doc_id", "page", "text"), new).select("doc_id", "page", "text")

