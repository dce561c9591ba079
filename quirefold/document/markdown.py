"""Markdown of blocks, pages, documents and outlines, character by character as a reader of it needs."""

from __future__ import annotations

import math
import re
from typing import Any

from quirefold.document import words as W
from quirefold.document.model import Block, Document, Outline, Page, Span

REPLACEMENT = "�"
_TRAILING = re.compile(r"[ \t]+(?=\n)")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_SPECIAL = re.compile(r"[\\`*|\[<_~!&#>\-+=.)\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_ENTITY = re.compile(r"&#?[A-Za-z0-9]+;")
_LABEL_END = re.compile(r"\][(\[:]")


def sanitize(text: str) -> str:
    return _CONTROL.sub(REPLACEMENT, text)


def _word(c: str) -> bool:
    return c > "\x7f" or (c.isascii() and c.isalnum())


def _escaped(text: str, i: int, at_start: bool) -> str:
    """The special character at a place, escaped where Markdown would read it."""
    c, before, after = text[i], text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if c in "\\`*|":
        hit = True
    elif c == "[":
        end = text.find("]", i + 1)
        hit = end >= 0 and bool(_LABEL_END.match(text, end))
    elif c == "<":
        hit = before != "<" and bool(after) and (after in "!?/" or (after.isascii() and after.isalpha()))
    elif c in "_~":
        hit = not (_word(before) and _word(after))
    elif c == "!":
        hit = after == "["
    elif c == "&":
        return "&amp;" if _ENTITY.match(text, i) else c
    elif c in "#>-+=":
        hit = at_start and i == 0
    elif c in ".)":
        hit = at_start and i > 0 and re.fullmatch("[0-9]+", text[:i]) is not None and after in ("", " ", "\t")
    else:
        return REPLACEMENT
    return "\\" + c if hit else c


def escape(text: str, at_start: bool = False) -> str:
    return _SPECIAL.sub(lambda m: _escaped(text, m.start(), at_start), text)


def link_label(text: str) -> str:
    return "".join("\\" + p if p in ("[", "]") else escape(p) for p in re.split(r"([\[\]])", text))


def longest_run(text: str) -> int:
    return max(map(len, re.findall("`+", text)), default=0)


def _mark(s: Span, plain: bool) -> str:
    if plain:
        return ""
    if s.style.mono and not s.style.hidden:
        return "`"
    return "*" * (2 * s.style.bold + s.style.italic)


def _parts(text: str) -> tuple[str, str, str]:
    """Leading blanks, body, trailing blanks."""
    body = text.strip(" \t")
    at = len(text) - len(text.lstrip(" \t"))
    return (text[:at], body, text[at + len(body) :]) if body else (text, "", "")


def _code(text: str, cell: bool) -> str:
    text = sanitize(text)
    lead, body, trail = _parts(text.replace("|", "\\|") if cell else text)
    if not body:
        return lead
    fence, pad = "`" * (longest_run(body) + 1), " " if body[0] == "`" or body[-1] == "`" else ""
    return lead + fence + pad + body + pad + fence + trail


def inline(spans: list[Span], plain: bool = False, cell: bool = False) -> str:
    """Runs of one style between their marks, white space outside; plain: without marks."""
    out, i = "", 0
    while i < len(spans):
        if not spans[i].text.strip():
            out += sanitize(spans[i].text)
            i += 1
            continue
        mark, j = _mark(spans[i], plain), i + 1
        while j < len(spans) and _mark(spans[j], plain) == mark:
            j += 1
        text = "".join(s.text for s in spans[i:j])
        lead, body, trail = _parts(text)
        if mark == "`":
            out += _code(text, cell)
        elif not mark or not body:
            out += escape(text, at_start=not out)
        else:
            out += lead + mark + escape(body) + mark + trail
        i = j
    return out


def _instead(b: Block) -> str:
    return b.replacement or (b.alt if b.alt and not b.text.strip() else "")


def content(b: Block, plain: bool = False) -> str:
    found = _instead(b)
    return escape(W.one_line(found), at_start=True) if found else inline(b.spans, plain)


def uniform_emphasis(b: Block) -> bool:
    """Whether all text of a block is bold, or italic, in one way."""
    kinds = {(s.style.bold, s.style.italic) for s in b.spans if s.text.strip() and not s.style.mono}
    return len(kinds) == 1 and any(next(iter(kinds)))


class Table:
    """Cells in rows; a cell whose column is taken goes to the end of its row."""

    def __init__(self, cells: list[Block]):
        order = sorted({c.cell.row for c in cells})
        rows: dict[int, list[Block | None]] = {r: [] for r in order}
        for c in cells:
            row = rows[c.cell.row]
            row += [None] * (c.cell.col + 1 - len(row))
            if row[c.cell.col] is None:
                row[c.cell.col] = c
            else:
                row.append(c)
        self.rows = [rows[r] for r in order]
        self.width = max(map(len, self.rows), default=0)
        self.header = any(c.cell.header for c in cells if c.cell.row == order[0]) if order else False

    def text(self) -> str:
        lines = ([] if self.header else [[]]) + self.rows
        made = ["| " + " | ".join(self._cell(r[i] if i < len(r) else None) for i in range(self.width)) + " |" for r in lines]
        made.insert(1, "|" + " --- |" * self.width)
        return "\n".join(made)

    @staticmethod
    def _cell(b: Block | None) -> str:
        if b is None:
            return ""
        found = _instead(b)
        return (escape(W.one_line(found)) if found else W.one_line(inline(b.spans, cell=True))).strip()


class Writer:
    """Blocks one after the other, with what depends on the block before: blank lines and the nesting of lists."""

    def __init__(self, artifacts: bool = False):
        self.artifacts = artifacts
        self.out: list[str] = []
        self.list, self.level = "", 0  # kind and level of the item before
        self.fresh = True  # nothing to part from
        self.indents: list[int] = []

    def text(self) -> str:
        """Without blanks at line ends."""
        return _TRAILING.sub("", "".join(self.out)).rstrip(" \t")

    def _gap(self, kind: str = "", depth: int = 0) -> None:
        same = kind and self.list and (kind == self.list or depth > 1 or self.level > 1)
        if not self.fresh and not same:
            self.out.append("\n")
        self.fresh = False

    def _add(self, text: str, kind: str = "", depth: int = 0) -> None:
        self.out.append(text + "\n")
        self.list, self.level = kind, depth

    def blocks(self, blocks: list[Block]) -> None:
        done: set[int] = set()
        shown = [b for b in blocks if not b.is_empty() and (b.role != "artifact" or self.artifacts)]
        for i, b in enumerate(shown):
            table = b.cell.table if b.role == "table_cell" and b.cell else 0
            if not table:
                self.block(b)
            elif table not in done:
                done.add(table)
                self._gap()
                self._add(Table([c for c in shown[i:] if c.role == "table_cell" and c.cell and c.cell.table == table]).text())

    def _indent(self, depth: int, width: int) -> int:
        if not self.list:
            self.indents = []
        depth = min(depth, len(self.indents) + 1)
        if depth < 2:
            self.indents = [width]
            return 0
        indent = self.indents[depth - 2]
        self.indents = [*self.indents[: depth - 1], indent + width]
        return indent

    def block(self, b: Block) -> None:
        if b.role == "list_item":
            number, depth = W.arabic(b.marker), max(b.level, 1)
            kind = "ordered" if number else "bullet"
            self._gap(kind, depth)
            mark = f"{number}. " if number else "- "
            label = escape(W.one_line(b.marker), at_start=True) + " " if not number and W.enumerated(b.marker) else ""
            self._add(" " * self._indent(depth, len(mark)) + mark + label + content(b), kind, depth)
            return
        self._gap()
        if b.role == "heading":
            self._add("#" * min(max(b.level, 1), 6) + " " + content(b, uniform_emphasis(b)))
        elif b.role == "quote":
            self._add("> " + content(b))
        elif b.role == "code":
            text = sanitize(b.text)
            fence = "`" * max(longest_run(text) + 1, 3)
            self._add(fence + "\n" + text.rstrip("\n") + "\n" + fence)
        elif b.role in ("caption", "figure"):
            text = content(b, plain=True).strip()
            if text:
                self._add("*" + text + "*")
            else:
                self.list, self.level = "", 0
        else:
            self._add(content(b))

    def front(self, meta: dict[str, Any], page: int = 0, pages: int = 0) -> None:
        keys = {"title": "title", "author": "author", "subject": "subject", "keywords": "keywords", "lang": "lang", "source": "path", "pdf_version": "version", "creator": "creator", "producer": "producer", "created": "created", "modified": "modified"}
        rows = [f"{k}: {yaml(str(meta[v]))}" for k, v in keys.items() if meta.get(v)]
        rows += [f"page: {page}"] * (page > 0) + [f"pages: {pages}"] * (pages > 0)
        rows += [f"{k}: {'true' if meta.get(k) else 'false'}" for k in ("tagged", "encrypted")]
        self.out.append("---\n" + "\n".join(rows) + "\n---\n\n")

    def outline(self, o: Outline) -> None:
        self.blocks(o.preamble)
        for s in o.walk():
            if s.title:
                self.block(Block("heading", [Span(s.title)], s.level))
            self.blocks(s.blocks)
        for p in o.unplaced:
            if any(not b.is_empty() and (b.role != "artifact" or self.artifacts) for b in p.blocks):
                self._gap()
                self._add(f"<!-- text on page {p.number} belongs to no clause in the structure tree -->")
                self.blocks(p.blocks)


def of_document(doc: Document, front: bool = False, artifacts: bool = False) -> str:
    w = Writer(artifacts)
    if front:
        w.front(doc.meta, pages=len(doc.pages))
    for p in doc.pages:
        w.blocks(p.blocks)
    return w.text()


def of_page(page: Page, meta: dict[str, Any], total: int, front: bool = False, artifacts: bool = False) -> str:
    w = Writer(artifacts)
    if front:
        w.front(meta, page.number, total)
    w.blocks(page.blocks)
    return w.text()


def of_outline(o: Outline, front: bool = False, artifacts: bool = False) -> str:
    w = Writer(artifacts)
    if front:
        w.front(o.meta, pages=max([s.last_page for s in o.walk()] + [p.number for p in o.unplaced], default=0))
    w.outline(o)
    return w.text()


def of_blocks(blocks: list[Block], artifacts: bool = False) -> str:
    w = Writer(artifacts)
    w.blocks(blocks)
    return w.text()


def page_name(number: int, total: int) -> str:
    return f"page-{number:0{len(str(total))}d}.md"


_UNPLAIN = re.compile(r"[\x00-\x1f\x7f\x85  \\]|:(?:[ \t]|$)|[ \t]#")
_RESERVED = {"true", "false", "null", "~", "y", "n", "yes", "no", "on", "off"}
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?)", re.I)
_OTHER_FLOAT = re.compile(r"[+-]?(?:0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?[0-9]+|inf|infinity)|nan", re.I)
_YAML = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\x85": "\\N", " ": "\\L", " ": "\\P"}


def is_plain_yaml(text: str) -> bool:
    if not text or text != text.strip() or text[0] in "-?:,[]{}#&*!|>'\"%@`":
        return False
    if _UNPLAIN.search(text) or text.lower() in _RESERVED:
        return False
    return not ((_FLOAT.fullmatch(text) and math.isfinite(float(text))) or _OTHER_FLOAT.fullmatch(text))


def yaml(text: str) -> str:
    """A string as a YAML scalar, quoted where it has to be."""
    if is_plain_yaml(text):
        return text
    return '"' + re.sub(r'["\\\x00-\x1f\x7f\x85  ]', lambda m: _YAML.get(m[0]) or f"\\x{ord(m[0]):02x}", text) + '"'
