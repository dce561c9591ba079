"""Roles from geometry: tables, headings, lists and numbered lists of a document without tags, in that order."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, replace

from quirefold.document import words as W
from quirefold.document.model import Block, Cell, Document, Page, Rule, Span, union

MAX_ROWS, MAX_CELLS, MIN_ROWS = 512, 4096, 2


@dataclass(frozen=True)
class Options:
    list_step: float = 1.0  # of the largest size; below 0 lists don't nest
    max_heading: int = 80
    max_level: int = 6


def body_cluster(doc: Document) -> tuple[float, bool] | None:
    """The size of most characters (the smaller of equals), and whether most of those are bold."""
    count: Counter = Counter()
    for s in (s for p in doc.pages for b in p.blocks if b.role != "artifact" for s in b.spans):
        if s.text and (size := W.quantize(s.style.size)) > 0:
            count[size, s.style.bold] += len(s.text)
    by_size: Counter = Counter()
    for (size, _), n in count.items():
        by_size[size] += n
    if not by_size:
        return None
    size = min(by_size, key=lambda k: (-by_size[k], k))
    return size, count[size, True] > count[size, False]


def headings(doc: Document, opt: Options | None = None) -> dict[str, float]:
    """Short numbered paragraphs of one style that stands out from the body become headings."""
    opt, body = opt or Options(), body_cluster(doc)
    found = {"candidates": 0, "headings": 0}
    if body is None:
        return found
    for b in (b for p in doc.pages for b in p.blocks if b.role == "paragraph"):
        styles = {(W.quantize(s.style.size), s.style.bold) for s in b.spans if s.text}
        if len(styles) != 1:
            continue
        size, bold = styles.pop()
        text = b.text.strip()
        if len(text) > opt.max_heading or not (size > body[0] or (bold and not body[1] and size == body[0])):
            continue
        found["candidates"] += 1
        if level := W.numbered_level(text) or W.annex_level(text):
            b.role, b.level = "heading", min(level, opt.max_level)
            found["headings"] += 1
    return found


def _tiers(run: list[Block], opt: Options) -> list[float]:
    """The left edges that begin a level: each a step or more right of the last."""
    edges = sorted(_left(b) for b in run)
    size = max((s.style.size for b in run for s in b.spans), default=0.0)
    out = edges[:1]
    for x in edges if opt.list_step >= 0 and size > 0 else ():
        if x - out[-1] >= (opt.list_step or 1.0) * size:
            out.append(x)
    return out


def _left(b: Block) -> float:
    return b.box[0] if b.box else 0.0


def lists(doc: Document, opt: Options | None = None) -> dict[str, int]:
    """Runs of paragraphs that begin with a bullet become items, nested by their left edges."""
    opt, found = opt or Options(), {"runs": 0, "items": 0, "max_level": 0}
    for page in doc.pages:
        run: list[Block] = []
        for b in [*page.blocks, Block("")]:
            if b.role == "paragraph" and W.bullet(b.text):
                run.append(b)
                continue
            if run:
                found["runs"] += 1
                tiers = _tiers(run, opt)
                levels = [min(max(sum(_left(x) >= t for t in tiers), 1), opt.max_level) for x in run]
                for x, level in zip(run, levels, strict=True):
                    x.own_box, x.role, x.level = x.box, "list_item", level
                    W.strip_bullet(x)
                found["items"] += len(run)
                found["max_level"] = max(found["max_level"], *levels)
            run = []
    return found


def ordered_lists(doc: Document) -> dict[str, int]:
    """Two or more paragraphs in a row whose labels count up, in one form and at one edge, become items."""
    found = {"runs": 0, "items": 0, "max_level": 0}
    for page in doc.pages:
        blocks, i = page.blocks, 0
        labels = [W.ordered_label(b.text) if b.role == "paragraph" else ("", 0) for b in blocks]
        while i < len(blocks):
            label, value = labels[i]
            j = i + 1
            while label and j < len(blocks) and labels[j][0] and labels[j][1] == value + j - i and W.same_form(label, labels[j][0]) and abs(_left(blocks[i]) - _left(blocks[j])) < 0.5:
                j += 1
            if not label or j - i < 2:
                i += 1
                continue
            for b in blocks[i:j]:
                b.own_box, b.role, b.level = b.box, "list_item", 1
                W.strip_ordered(b)
            found["runs"], found["items"], found["max_level"] = found["runs"] + 1, found["items"] + j - i, 1
            i = j
    return found


# tables


@dataclass
class Band:
    """Spans side by side: one row of a table, or of text."""

    block: int
    cells: list[list[int]]  # spans of the block
    extents: list[tuple[float, float]]
    table: int = 0
    row: int = 0
    cols: list[int] | None = None


def bands(spans: list[Span]) -> list[list[int]]:
    """Spans from the top down whose heights overlap all of their band; each band from left to right."""
    out: list[list[int]] = []
    low = high = 0.0
    for i in sorted(range(len(spans)), key=lambda i: -spans[i].box[3]):
        _, y0, _, y1 = spans[i].box
        if out and y1 > low and y0 < high:
            out[-1].append(i)
            low, high = max(low, y0), min(high, y1)
        else:
            out.append([i])
            low, high = y0, y1
    return [sorted(b, key=lambda i: spans[i].box[0]) for b in out]


def crossed(rules: list[Rule], at: list[float], a: Span, b: Span) -> bool:
    """Whether one of the vertical rules (sorted; at: their places) stands between two spans."""
    low, high = min(a.box[1], b.box[1]), max(a.box[3], b.box[3])
    k = bisect_right(at, a.box[2])
    while k < len(rules) and rules[k].pos < b.box[0]:
        if rules[k].hi >= low and rules[k].lo <= high:
            return True
        k += 1
    return False


def columns(rows: list[Band]) -> list[float]:
    """The right edges of the columns that the cells of some rows make."""
    out: list[float] = []
    for x0, x1 in sorted(e for r in rows for e in r.extents):
        if out and x0 < out[-1]:
            out[-1] = max(out[-1], x1)
        else:
            out.append(x1)
    return out


def _column(cols: list[float], x0: float) -> int:
    return next((i for i, right in enumerate(cols) if x0 < right), len(cols) - 1)


def _fits(rows: list[Band]) -> list[list[int]] | None:
    """The column of each cell; None where two cells of a row share one."""
    cols = columns(rows)
    out = [[_column(cols, x0) for x0, _ in r.extents] for r in rows]
    return out if all(len(set(r)) == len(r) for r in out) else None


def _groups(rows: list[Band]) -> list[list[Band]]:
    """Runs of rows of two cells or more that agree on columns."""
    out, i = [], 0
    while i < len(rows):
        j, cells = i + 1, len(rows[i].cells)
        if cells > 1:
            while j < len(rows) and j - i < MAX_ROWS and len(rows[j].cells) > 1 and cells + len(rows[j].cells) <= MAX_CELLS and _fits(rows[i : j + 1]):
                cells += len(rows[j].cells)
                j += 1
            if j - i >= MIN_ROWS:
                out.append(rows[i:j])
        i = j
    return out


def _page_bands(page: Page, rules: list[Rule]) -> list[Band]:
    out, at = [], [r.pos for r in rules]
    for k, b in enumerate(page.blocks):
        for band in bands(b.spans) if b.role == "paragraph" else ():
            cells = [band[:1]]
            for left, right in zip(band, band[1:], strict=False):
                if crossed(rules, at, b.spans[left], b.spans[right]):
                    cells.append([])
                cells[-1].append(right)
            out.append(Band(k, cells, [(min(b.spans[i].box[0] for i in c), max(b.spans[i].box[2] for i in c)) for c in cells]))
    return out


def _part(block: Block, spans: list[int], **more) -> Block:
    out = replace(block, spans=[block.spans[i] for i in spans], own_box=None, **more)
    for s in out.spans:
        out.own_box = union(out.own_box, s.box)
    return out


def tables(doc: Document) -> dict[str, int]:
    """Rows of spans that vertical rules part become cells; what a block has besides them stays where it was."""
    found = {"tables": 0, "rows": 0, "cells": 0}
    for page in doc.pages:
        rules = sorted((r for r in page.rules if r.vertical and r.hi > r.lo), key=lambda r: r.pos)
        rows = _page_bands(page, rules) if rules else []
        for group in _groups(rows):
            found["tables"] += 1
            for n, (row, cols) in enumerate(zip(group, _fits(group) or [], strict=True)):
                row.table, row.row, row.cols = found["tables"], n, cols
                found["rows"], found["cells"] = found["rows"] + 1, found["cells"] + len(row.cells)
        if not any(r.table for r in rows):
            continue
        out: list[Block] = []
        for k, b in enumerate(page.blocks):
            own, rest = [r for r in rows if r.block == k], []
            if not any(r.table for r in own):
                out.append(b)
                continue
            for r in own:
                if not r.table:
                    rest += [i for c in r.cells for i in c]
                    continue
                if rest:
                    out.append(_part(b, sorted(rest)))
                    rest = []
                out += [_part(b, c, role="table_cell", level=0, marker="", cell=Cell(r.table, r.row, col, r.row == 0)) for c, col in zip(r.cells, r.cols, strict=True)]
            if rest:
                out.append(_part(b, sorted(rest)))
        page.blocks = out
    return found


def infer_roles(doc: Document, opt: Options | None = None) -> None:
    tables(doc)
    headings(doc, opt)
    lists(doc, opt)
    ordered_lists(doc)
