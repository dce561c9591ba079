"""From blocks, with the tree of tags where there is one, to sections."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quirefold.document import tags
from quirefold.document import words as W
from quirefold.document.model import Block, Cell, Document, Outline, Page, Section, Span, union
from quirefold.document.tags import Claim, Element

SAME_LINE, GAP, ATTACH = 0.5, 0.4, 0.15  # of a size, of a space, of a space
SPACE = 0.5  # of a size


def same_line(a: Span, b: Span) -> bool:
    return a.page == b.page and abs(a.box[1] - b.box[1]) <= SAME_LINE * max(a.style.size, b.style.size)


def _gap(a: Span, b: Span) -> bool:
    """Whether white space between two claimed spans of a line stands for a space."""
    real = a.mcid is not None and b.mcid is not None and a.text and b.text and not a.text[-1].isspace() and not b.text[0].isspace()
    return bool(real and a.style.size > 0 and b.style.size > 0 and same_line(a, b) and b.box[0] - a.box[2] > GAP * SPACE * b.style.size)


def spaced_at_gaps(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in spans:
        if out and _gap(out[-1], s):
            out.append(Span(" "))
        out.append(s)
    return out


def broken_at_baselines(spans: list[Span]) -> list[Span]:
    """A line end where the line changes between two claimed spans."""
    out: list[Span] = []
    for s in spans:
        if out and out[-1].mcid is not None and s.mcid is not None and not same_line(out[-1], s):
            out.append(Span("\n"))
        out.append(s)
    return out


class Index:
    """The spans by page and marked content; each is taken once."""

    def __init__(self, doc: Document):
        self.spans: dict[tuple[int, int], list[Span]] = {}
        self.taken: set[int] = set()
        for page in doc.pages:
            for block in page.blocks:
                for i, s in enumerate(block.spans):
                    own = s
                    if s.mcid is None:
                        after = self._indents(block, i)
                        if after is None:
                            continue
                        own = replace(s, mcid=after.mcid)
                        self.taken.add(id(s))
                    self.spans.setdefault((page.number, own.mcid), []).append(own)

    @staticmethod
    def _indents(block: Block, i: int) -> Span | None:
        """The claimed span that a blank, unclaimed one at the start of a line leads to."""
        s, after = block.spans[i], block.spans[i + 1] if i + 1 < len(block.spans) else None
        if not s.text or s.text.strip() or after is None or after.mcid is None or not same_line(s, after):
            return None
        if any(same_line(x, s) for x in block.spans[:i]) or abs(after.box[0] - s.box[2]) > ATTACH * SPACE * after.style.size:
            return None
        return after

    def take(self, claims: list[Claim]) -> list[Span]:
        out = []
        for c in claims:
            for s in self.spans.get((c.page, c.mcid), ()) if c.page > 0 else ():
                if id(s) not in self.taken:
                    self.taken.add(id(s))
                    out.append(s)
        return out

    def unplaced(self, doc: Document) -> list[Page]:
        """What no element took, by page and block."""
        out = []
        for p in doc.pages:
            left = [replace(b, spans=own, own_box=None) for b in p.blocks if (own := [s for s in b.spans if id(s) not in self.taken])]
            if left := [b for b in left if not b.is_empty()]:
                out.append(replace(p, blocks=left))
        return out


def substituted(e: Element, spans: list[Span]) -> list[Span]:
    """The replacement text of an element in place of its spans, with the box that they have on the first one's page."""
    if not e.actual or not spans:
        return spans
    box = None
    for s in spans:
        box = union(box, s.box) if s.page == spans[0].page else box
    return [replace(spans[0], text=W.inline_text(e.actual), box=box or spans[0].box)]


@dataclass
class Pages:
    first: int = 0
    last: int = 0

    def add(self, page: int) -> None:
        if page > 0:
            self.first = min(self.first, page) if self.first else page
            self.last = max(self.last, page)


@dataclass
class Builder:
    index: Index | None = None
    max_title: int = W.MAX_TITLE
    out: Outline = field(default_factory=Outline)
    stack: list[Section] = field(default_factory=list)
    tables: dict[int, int] = field(default_factory=dict)

    def open(self, title: str, level: int, pages: Pages) -> None:
        while self.stack and self.stack[-1].level >= level:
            self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        s = Section(title, level, W.clause_number(title), parent=parent, first_page=pages.first, last_page=pages.last)
        (parent.kids if parent else self.out.sections).append(s)
        self.stack.append(s)

    def place(self, block: Block, pages: Pages) -> None:
        if block.is_empty():
            return
        if not self.stack:
            self.out.preamble.append(block)
            return
        s = self.stack[-1]
        s.blocks.append(block)
        if pages.first and (not s.first_page or pages.first < s.first_page):
            s.first_page = pages.first
        s.last_page = max(s.last_page, pages.last)

    # tagged

    def visit(self, top: Element) -> None:
        todo: list[Element | tuple[Element, list[Claim]]] = [top]
        while todo:
            e = todo.pop()
            if isinstance(e, tuple):
                pages = Pages()
                for page in (e[0].page, *(c.page for c in e[1])):
                    pages.add(page)
                self._emit(e[0], "paragraph", self.index.take(e[1]), pages, "")
            elif e.is_heading():
                spans, nested, pages = self._gather(e, False, False)
                self.open(self._title(e, spans), max(e.heading_level(), 1), pages)
                todo += reversed(nested)
            elif e.role in tags.BLOCK_ROLES:
                role = tags.BLOCK_ROLES[e.role]
                marker = self._label(e) if role == "list_item" else ""
                spans, nested, pages = self._gather(e, role in ("list_item", "table_cell", "code"), role == "code")
                self._emit(e, role, spans, pages, marker)
                todo += reversed(nested)
            else:
                todo += reversed([x if isinstance(x, Element) else (e, x) for x in _runs(e)])

    def _title(self, e: Element, spans: list[Span]) -> str:
        found = W.clean(e.title) or W.clean("".join(s.text for s in spans)) or W.clean(W.inline_text(e.actual))
        return W.truncate(found, self.max_title)

    def _label(self, e: Element) -> str:
        """The text of the first label of an item."""
        label = next((k for k in e.kids if k.role == "Lbl"), None)
        return "".join(self._label_text(label)).strip() if label else ""

    def _label_text(self, e: Element) -> list[str]:
        out = []
        for x in _runs(e):
            if not isinstance(x, Element):
                out += [s.text for s in substituted(e, self.index.take(x))]
            elif x.role not in tags.BLOCK_ROLES and not x.is_heading():
                out += self._label_text(x)
        return out

    def _gather(self, e: Element, wraps: bool, lines: bool) -> tuple[list[Span], list[Element], Pages]:
        """The spans of an element and of what is inside but no block of its own; those blocks; and the pages.

        wraps: paragraphs inside belong to the element; lines: such a paragraph begins a line.
        """
        spans: list[Span] = []
        nested: list[Element] = []
        pages = Pages()

        def into(x: Element) -> None:
            pages.add(x.page)
            for part in _runs(x):
                if not isinstance(part, Element):
                    spans.extend(substituted(x, self.index.take(part)))
                    for c in part:
                        pages.add(c.page)
                    continue
                role = tags.BLOCK_ROLES.get(part.role)
                if part.is_heading() or (role and not (wraps and role == "paragraph")):
                    nested.append(part)
                    continue
                if lines and spans and role:
                    spans.append(Span("\n"))
                into(part)

        into(e)
        return spans, nested, pages

    def _emit(self, e: Element, role: str, spans: list[Span], pages: Pages, marker: str) -> None:
        b = Block(role, lang=e.lang, alt=e.alt, replacement=W.inline_text(e.actual))
        if role == "list_item":
            b.level = e.list_depth()
        if role == "table_cell" and (found := tags.cell_place(e, self.tables)):
            b.cell = Cell(*found)
        first = next((s.page for s in spans if s.page > 0), 0)
        for s in spans:
            b.own_box = union(b.own_box, s.box) if s.page == first else b.own_box
        b.spans = spaced_at_gaps([replace(s) for s in spans])
        if role == "code":
            b.spans = broken_at_baselines(b.spans)
        if role == "list_item":
            if marker:
                W.set_marker(b, marker)
            else:
                W.strip_bullet(b, W.DECLARED)
        self.place(b, pages)


def _runs(e: Element) -> list[Element | list[Claim]]:
    """What an element holds in order, with claims in a row as one."""
    out: list[Element | list[Claim]] = []
    for x in e.inside:
        if isinstance(x, Element):
            out.append(x)
        elif out and isinstance(out[-1], list):
            out[-1].append(x)
        else:
            out.append([x])
    return out


def tagged(doc: Document, root: Element) -> Outline:
    """Sections by the tree of tags; text that it doesn't claim is left over by page."""
    for page in doc.pages:
        for s in (s for b in page.blocks for s in b.spans):
            s.page = page.number
    b = Builder(Index(doc))
    b.out.meta = doc.meta
    b.visit(root)
    b.out.unplaced = b.index.unplaced(doc)
    return b.out


def untagged(doc: Document) -> Outline:
    """Sections by the headings among the blocks."""
    b = Builder(out=Outline(doc.meta))
    for page in doc.pages:
        pages = Pages(page.number, page.number)
        for block in page.blocks:
            if block.role == "heading" and not block.is_empty():
                b.open(W.truncate(W.clean(block.text)), max(block.level, 1), pages)
            else:
                b.place(block, pages)
    return b.out
