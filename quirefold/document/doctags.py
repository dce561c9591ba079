"""Recognised pages: the tagged text that a model writes for an image of a page, as blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quirefold.document.model import Block, Box, Page, Span

GRID, MAX_DEPTH = 500, 64
ELEMENTS = frozenset(
    "doctag otsl chart ordered_list unordered_list smiles inline caption footnote formula list_item page_footer page_header picture table text title document_index code checkbox_selected checkbox_unselected form "
    "key_value_region paragraph reference handwritten_text".split()
)
TABLES, FIGURES, LISTS = frozenset({"otsl", "table", "chart"}), frozenset({"picture", "chart"}), frozenset({"ordered_list", "unordered_list"})
CELLS = frozenset("ecel fcel lcel ucel xcel nl ched rhed srow column_header row_header shed data".split())
_ENDS_CELL = CELLS - {"column_header", "row_header", "shed", "data"}
KINDS = frozenset(
    "bar_chart box_plot flow_chart line_chart pie_chart scatter_plot table full_page_image page_thumbnail photograph chemistry_structure bar_code icon logo qr_code signature stamp engineering_drawing "
    "screenshot_from_computer screenshot_from_manual geographical_map topographical_map calendar crossword_puzzle music other cad_drawing chart decoration electrical_diagram map heatmap illustration infographic "
    "chemistry_markush_structure chemistry_molecular_structure natural_image person picture_group remote_sensing scatter_chart screenshot stacked_bar_chart stratigraphic_chart ui_element".split()
)
ROLES = {"caption": "caption", "picture": "figure", "chart": "figure", "code": "code", "page_header": "artifact", "page_footer": "artifact", "footnote": "artifact"}
_HEADER = re.compile(r"section_header_level_([0-5])")


def heading_level(name: str) -> int:
    """One below the title for a section header of level 0 to 5; 0 for other elements."""
    m = _HEADER.fullmatch(name)
    return 1 if name == "title" else int(m[1]) + 1 if m else 0


def _is_element(name: str) -> bool:
    return name in ELEMENTS or bool(_HEADER.fullmatch(name))


def classify(inner: str) -> tuple[str, str]:
    """Kind and name of what stands between angle brackets; kind '' for what is plain text."""
    inner = inner.removesuffix("/")
    if inner.startswith("/"):
        return ("close", inner[1:]) if _is_element(inner[1:]) else ("", "")
    if m := re.fullmatch(r"loc_(\d+)", inner, re.ASCII):
        return ("loc", m[1]) if int(m[1]) < GRID else ("", "")
    if inner == "page_break":
        return "break", inner
    if inner in CELLS:
        return "cell", inner
    if _is_element(inner):
        return "open", inner
    if inner in KINDS or re.fullmatch(r"_.+_", inner):
        return "mark", inner
    return "", ""


def scan(source: str) -> list[tuple[str, str]]:
    """Tokens (kind, name or text); tags that aren't known stay in the text."""
    out: list[tuple[str, str]] = []

    def text(t: str) -> None:
        if t and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + t)
        elif t:
            out.append(("text", t))

    at = 0
    for m in re.finditer(r"<([^>]*)>", source):
        text(source[at : m.start()])
        kind, name = classify(m[1])
        if kind:
            out.append((kind, name))
        else:
            text(m[0])
        at = m.end()
    text(source[at:])
    return out


@dataclass
class _Open:
    name: str
    locs: list[int] = field(default_factory=list)
    text: str = ""
    kind: str = ""


class _Builder:
    def __init__(self, box: Box):
        self.box, self.blocks, self.lists = box, [], 0

    def rect(self, locs: list[int]) -> Box | None:
        """A box on the grid, whose origin is at the top left."""
        x0, y0, x1, y1 = self.box
        if len(locs) != 4 or x0 == x1 or y0 == y1:
            return None
        xs = sorted(x0 + v / GRID * (x1 - x0) for v in locs[::2])
        ys = sorted(y1 - v / GRID * (y1 - y0) for v in locs[1::2])
        return xs[0], ys[0], xs[1], ys[1]

    def add(self, role: str, text: str, locs: list[int], level: int = 0, alt: str = "") -> None:
        box = self.rect(locs)
        self.blocks.append(Block(role, [Span(text, box=box or (0.0, 0.0, 0.0, 0.0))] if text else [], level, alt=alt, own_box=box))

    def cell(self, e: _Open) -> None:
        text, e.text = e.text.strip(), ""
        if text:
            self.add("table_cell", text, e.locs)

    def close(self, e: _Open) -> None:
        if e.name in TABLES:
            self.cell(e)
            return
        text, level = e.text.strip(), heading_level(e.name)
        role = "heading" if level else "list_item" if e.name == "list_item" else ROLES.get(e.name, "paragraph")
        if role == "list_item":
            level = max(self.lists, 1)
        if text or role == "figure":
            self.add(role, text, e.locs, level if text else 0, e.kind if role == "figure" else "")

    def run(self, tokens: list[tuple[str, str]]) -> list[Block]:
        stack: list[_Open] = []
        for kind, name in tokens:
            top = stack[-1] if stack else None
            if name in LISTS and kind in ("open", "close"):
                self.lists = max(self.lists + (1 if kind == "open" else -1), 0)
            elif name == "doctag" and kind in ("open", "close"):
                continue
            elif kind == "open" and not (top and name in KINDS and top.name in FIGURES):
                if len(stack) >= MAX_DEPTH:
                    raise ValueError("elements are nested too deeply")
                stack.append(_Open(name))
            elif kind == "close":
                if stack:
                    self.close(stack.pop())
            elif kind == "text" and not top:
                if name.strip():
                    self.add("paragraph", name.strip(), [])
            elif not top:
                continue
            elif kind == "text":
                top.text += name
            elif kind == "loc":
                if len(top.locs) < 4:
                    top.locs.append(int(name))
            elif kind == "cell":
                if name in _ENDS_CELL:
                    self.cell(top)
            else:
                top.kind = top.kind or name
        while stack:
            self.close(stack.pop())
        return self.blocks


def parse(source: str, box: Box = (0.0, 0.0, 0.0, 0.0)) -> list[Page]:
    """The pages of a text with page breaks; an empty one behind the last break doesn't count."""
    parts: list[list[tuple[str, str]]] = [[]]
    for token in scan(source):
        if token[0] == "break":
            parts.append([])
        else:
            parts[-1].append(token)
    pages = [Page(i, box, blocks=_Builder(box).run(p), rasterized=True) for i, p in enumerate(parts, 1)]
    return pages[:-1] if len(pages) > 1 and not pages[-1].blocks else pages


def parse_page(source: str, number: int, box: Box) -> Page:
    """One page; a page break in it is a ValueError."""
    tokens = scan(source)
    if any(kind == "break" for kind, _ in tokens):
        raise ValueError(f"page {number}: the text has more than one page")
    return Page(number, box, blocks=_Builder(box).run(tokens), rasterized=True)
