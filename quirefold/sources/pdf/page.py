"""A page's content stream read to glyphs and rules, glyphs to fragments and lines, and lines to blocks.

The steps depend on what came before (pen, graphics state, open line, shape of the open paragraph), so a page is one fold; pages
are independent of each other.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

from quirefold.document.model import Block, Document, Page, Rule, Span, Style, union
from quirefold.sources.pdf.fonts import Font, load
from quirefold.sources.pdf.objects import Store, Stream, as_number
from quirefold.sources.pdf.tokens import Name, Op, operators

MAX_STATES, MAX_FORMS, MAX_RULES = 256, 12, 4096
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
ASCENT, DESCENT, STEP = 0.8, 0.2, math.pi / 12


@dataclass(frozen=True)
class Policy:
    """The thresholds of the text walk, as parts of a size, height or space."""

    line: float = 0.5
    space: float = 0.4
    paragraph: float = 1.5
    size: float = 1.06
    indent: float = 1.0
    indent_most: float = 6.0
    equal: float = 1e-6
    keep_artifacts: bool = False
    keep_hidden: bool = True


def multiply(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def moved(m: Matrix, x: float, y: float) -> Matrix:
    """A shift, then m."""
    a, b, c, d, e, f = m
    return a, b, c, d, x * a + y * c + e, x * b + y * d + f


@dataclass
class TextState:
    font: str = ""
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    rise: float = 0.0
    render: int = 0


@dataclass
class Machine:
    """Graphics and text state, and the stack of marked content; apply() is one operator."""

    ctm: Matrix = IDENTITY
    text: TextState = field(default_factory=TextState)
    tm: Matrix = IDENTITY
    line: Matrix = IDENTITY
    saved: list[tuple[Matrix, TextState]] = field(default_factory=list)
    marked: list[list] = field(default_factory=list)  # tag, marked-content id

    def mcid(self) -> int | None:
        """The id of the innermost content that has one."""
        return next((m[1] for m in reversed(self.marked) if m[1] is not None), None)

    def artifact(self) -> bool:
        return any(m[0] == "Artifact" for m in self.marked)

    def visible(self) -> bool:
        return self.text.render not in (3, 7)

    def next_line(self) -> None:
        self.tm = self.line = moved(self.line, 0, -self.text.leading)

    def advance(self, x: float, y: float = 0.0) -> None:
        self.tm = moved(self.tm, x, y)

    def render(self) -> Matrix:
        t = self.text
        return multiply(multiply((t.size * t.scale / 100, 0.0, 0.0, t.size, 0.0, t.rise), self.tm), self.ctm)

    def apply(self, op: Op) -> bool:
        name, num, t = op.name, op.num, self.text
        if name == "q":
            if len(self.saved) < MAX_STATES:
                self.saved.append((self.ctm, replace(t)))
        elif name == "Q":
            if self.saved:
                self.ctm, self.text = self.saved.pop()
        elif name in ("cm", "Tm"):
            if len(op.operands) >= 6:
                m = tuple(num(i) for i in range(6))
                if name == "cm":
                    self.ctm = multiply(m, self.ctm)
                else:
                    self.tm = self.line = m
        elif name == "BT":
            self.tm = self.line = IDENTITY
        elif name == "Tf":
            t.font, t.size = str(op.of(0, Name) or ""), num(1)
        elif name in _SETTERS:
            setattr(t, _SETTERS[name], num(0))
        elif name == "Tr":
            t.render = int(num(0))
        elif name in ("Td", "TD"):
            t.leading = -num(1) if name == "TD" else t.leading
            self.tm = self.line = moved(self.line, num(0), num(1))
        elif name == "T*":
            self.next_line()
        elif name in ("BMC", "BDC"):
            props = (op.of(1, dict) or {}) if name == "BDC" else {}
            mcid = as_number(props.get("MCID"))
            if len(self.marked) < MAX_STATES or name == "BMC":
                self.marked.append([str(op.of(0, Name) or ""), None if mcid is None else int(mcid)])
        elif name == "EMC":
            if self.marked:
                self.marked.pop()
        else:
            return name in ("ET", "W", "W*")
        return True


_SETTERS = {"Tc": "char_space", "Tw": "word_space", "Tz": "scale", "TL": "leading", "Ts": "rise"}


class Placed(NamedTuple):
    """A glyph on the page."""

    text: str
    code: int
    orient: int
    along: float
    end: float
    cross: float
    gap: float | None  # from where the pen was
    height: float
    space: float
    style: Style
    mcid: int | None
    artifact: bool


@dataclass
class Fragment:
    text: str
    along0: float
    along1: float
    cross: float
    orient: int
    height: float
    space: float
    style: Style
    mcid: int | None
    artifact: bool
    cuts: list[tuple[int, float, float]] = field(default_factory=list)  # place in text, gap from, gap to
    apart: bool = False

    def box(self) -> tuple[float, float, float, float]:
        if self.orient == 0:
            return self.along0, self.cross - DESCENT * self.height, self.along1, self.cross + ASCENT * self.height
        dx, dy = math.cos(self.orient * STEP), math.sin(self.orient * STEP)
        xs = [a * dx - self.cross * dy for a in (self.along0, self.along1)]
        ys = [a * dy + self.cross * dx for a in (self.along0, self.along1)]
        return min(xs) - self.height, min(ys) - self.height, max(xs) + self.height, max(ys) + self.height


@dataclass
class Line:
    cross: float
    orient: int
    fragments: list[Fragment] = field(default_factory=list)

    def extent(self) -> tuple[float, float]:
        return min(f.along0 for f in self.fragments), max(f.along1 for f in self.fragments)

    def height(self) -> float:
        return max((f.height for f in self.fragments), default=0.0)

    def space(self) -> float:
        return max((f.space for f in self.fragments), default=0.0)

    def size(self) -> float:
        """The size of most characters, the smaller of equals."""
        if len(self.fragments) == 1:
            size = math.floor(self.fragments[0].style.size * 100 + 0.5) / 100
            return size if self.fragments[0].text and size > 0 else 0.0
        count: dict[float, int] = {}
        for f in self.fragments:
            size = math.floor(f.style.size * 100 + 0.5) / 100
            if f.text and size > 0:
                count[size] = count.get(size, 0) + len(f.text)
        return min(count, key=lambda s: (-count[s], s), default=0.0)


def spaced(text: str) -> tuple[bool, bool]:
    """Whether a text starts, and ends, in white space."""
    return text[:1].isspace(), text[-1:].isspace()


class Walk:
    """The fold over a page's operators."""

    def __init__(self, store: Store, fonts: dict | None = None, policy: Policy | None = None, record: bool = False):
        """record: keeps each glyph as placed; else the glyphs of a string that follow each other without a gap are placed as one."""
        self.store, self.policy, self.record = store, policy or Policy(), record
        self.fonts = {} if fonts is None else fonts
        self.placed: list[Placed] = []
        self.rules: list[Rule] = []
        self.lines: list[Line] = []
        self.open: Line | None = None
        self.pen: float | None = None
        self.segments: list[tuple[float, float, float, float]] = []
        self.at = self.begun = None

    def run(self, data: bytes, resources: Any) -> None:
        self._run(Machine(), data, resources, 0)
        self.close_line()

    def _run(self, m: Machine, data: bytes, resources: Any, depth: int) -> None:
        for op in operators(data):
            if op.name == "Tj":
                self._show(m, resources, op.of(0, bytes))
            elif m.apply(op):
                if op.name == "BDC" and (name := op.of(1, Name)) and m.marked:
                    props = self.store.dict(self.store.dict(resources, "Properties"), name)
                    if (mcid := self.store.int(props, "MCID")) is not None:
                        m.marked[-1][1] = mcid
            elif op.name in _PATHS:
                self._path(m, op)
            elif op.name == "TJ":
                self._show_parts(m, resources, op.of(0, list) or [])
            elif op.name in ("'", '"'):
                if op.name == '"':
                    m.text.word_space, m.text.char_space = op.num(0), op.num(1)
                m.next_line()
                self._show(m, resources, op.of(0 if op.name == "'" else 2, bytes))
            elif op.name == "Do":
                self._form(m, resources, op.of(0, Name), depth)

    def _form(self, m: Machine, resources: Any, name: str | None, depth: int) -> None:
        s = self.store
        form = s.get(s.dict(resources, "XObject"), name) if name else None
        if depth >= MAX_FORMS or not isinstance(form, Stream) or s.name(form.info, "Subtype") != "Form":
            return
        data = s.decoded(form)
        if data is None:
            return
        matrix = [as_number(s.resolve(x)) for x in s.array(form.info, "Matrix") or []]
        ctm = multiply(tuple(matrix), m.ctm) if len(matrix) == 6 and None not in matrix else m.ctm
        self._run(Machine(ctm, replace(m.text)), data, s.dict(form.info, "Resources") or resources, depth + 1)

    # text

    def _font(self, m: Machine, resources: Any) -> Font | None:
        return load(self.store, resources, m.text.font, self.fonts)

    def _show_parts(self, m: Machine, resources: Any, parts: list) -> None:
        font = self._font(m, resources)
        for part in parts:
            if isinstance(part, bytes):
                self._show(m, resources, part)
            elif (n := as_number(part)) is not None:
                shift = -n / 1000 * m.text.size * m.text.scale / 100
                m.advance(0 if font and font.vertical else shift, shift if font and font.vertical else 0)

    def _show(self, m: Machine, resources: Any, data: bytes | None) -> None:
        font = self._font(m, resources) if data else None
        if font is None:
            return
        t, wide = m.text, m.text.scale / 100
        shown = m.visible() or self.policy.keep_hidden
        artifact, mcid = (m.artifact(), m.mcid()) if m.marked else (False, None)
        if not self.record and not font.vertical and t.size > 0 and t.scale > 0 and t.char_space >= 0 and t.word_space >= 0 and (run := font.run(data)):
            # behind each glyph the pen is where the next one begins, so nothing inside of the string is a gap
            text, units, last, spaces, n = run
            shift = (units / 1000 * t.size + n * t.char_space + spaces * t.word_space) * wide
            if shown:
                self._place(m, font, text, 0, artifact, mcid, shift - (t.char_space + (t.word_space if data[-1:] == b" " and not font.composite else 0.0)) * wide)
            self._advance(m, shift, shown)
            return
        for g in font.decode(data):
            word = t.word_space if g.size == 1 and g.code == 32 else 0.0
            shift = (g.width / 1000 * t.size + t.char_space + word) * wide
            if shown and g.text:
                self._place(m, font, g.text, g.code, artifact, mcid, g.width / 1000 * t.size * wide)
            if font.vertical:
                m.advance(0, -shift)
            else:
                self._advance(m, shift, shown)

    def _advance(self, m: Machine, shift: float, shown: bool) -> None:
        if shown and self.pen is not None:
            at = multiply(m.tm, m.ctm)
            self.pen += shift * math.hypot(at[0], at[1])
        m.advance(shift)

    def _place(self, m: Machine, font: Font, text: str, code: int, artifact: bool, mcid: int | None, width: float) -> None:
        """width: from the start to the end of the last glyph, in text space."""
        t = m.text
        a, b, c, d, x, y = m.render()
        sx, sy = math.hypot(a, b), math.hypot(c, d)
        dx, dy = (a / sx, b / sx) if sx else (1.0, 0.0)
        orient = (_nearest(math.atan2(dy, dx) / STEP) if dy or dx < 0 else 0) if sx else 0
        along, cross = (x * dx + y * dy, -x * dy + y * dx) if sx else (x, y)
        style = Style(font.name, sy, font.bold, font.italic, font.mono, not m.visible())
        space = font.space_width / 1000 * sx
        unit = t.size * t.scale / 100
        end = along + (width / unit * sx if unit else 0.0)
        self.put(text, code, orient, along, end, cross, sy, space if space > 0 else 0.5 * sx, style, mcid, artifact)

    def put(self, text: str, code: int, orient: int, along: float, end: float, cross: float, height: float, space: float, style: Style, mcid: int | None, artifact: bool) -> None:
        """Adds a glyph to the open line, or begins one; a wide gap is a space, and a place where a rule may cut."""
        p, line = self.policy, self.open
        last = line.fragments[-1] if line else None
        gap = None if self.pen is None else along - self.pen
        if self.record:
            self.placed.append(Placed(text, code, orient, along, end, cross, gap, height, space, style, mcid, artifact))
        if line is None or line.orient != orient or abs(cross - line.cross) > p.line * max(height, last.height):
            self.close_line()
            self.open = Line(cross, orient, [Fragment(text, along, end, cross, orient, height, space, style, mcid, artifact)])
            self.pen = along
            return
        wide = gap is not None and gap > p.space * space
        written = " " if wide and not spaced(last.text)[1] and not spaced(text)[0] else ""
        if (last.mcid, last.artifact) == (mcid, artifact) and last.style.same_run(style, p.equal):
            last.text += written
            if wide:
                last.cuts.append((len(last.text), self.pen, along))
            last.text += text
            last.along0, last.along1, last.height = min(last.along0, along), max(last.along1, end), max(last.height, height)
        else:
            line.fragments.append(Fragment(written + text, along, end, cross, orient, height, space, style, mcid, artifact))
        self.pen = along

    def close_line(self) -> None:
        if self.open:
            self.lines.append(self.open)
        self.open = self.pen = None

    # rules

    def _path(self, m: Machine, op: Op) -> None:
        a, b, c, d, e, f = m.ctm
        point = lambda x, y: (x * a + y * c + e, x * b + y * d + f)
        if op.name == "m":
            self.at = self.begun = point(op.num(0), op.num(1))
        elif op.name == "l":
            to = point(op.num(0), op.num(1))
            if self.at:
                self._segment(self.at, to)
            self.at = to
        elif op.name in ("c", "v", "y"):
            if len(op.operands) > 1:
                self.at = point(op.num(len(op.operands) - 2), op.num(len(op.operands) - 1))
        elif op.name == "re":
            x, y, w, h = (op.num(i) for i in range(4))
            corners = [point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)]
            for i in range(4):
                self._segment(corners[i], corners[(i + 1) % 4])
            self.at = self.begun = corners[0]
        if op.name in ("h", "s", "b", "b*") and self.at:
            if self.begun:
                self._segment(self.at, self.begun)
            self.at = self.begun
        if op.name in _PAINTS:
            for x0, y0, x1, y1 in self.segments if op.name != "n" else ():
                upright, level = abs(x1 - x0) <= 1e-6, abs(y1 - y0) <= 1e-6
                if upright != level and len(self.rules) < MAX_RULES:
                    self.rules.append(Rule(True, x0, min(y0, y1), max(y0, y1)) if upright else Rule(False, y0, min(x0, x1), max(x0, x1)))
            self.segments, self.at, self.begun = [], None, None

    def _segment(self, a: tuple[float, float], b: tuple[float, float]) -> None:
        if len(self.segments) < MAX_RULES:
            self.segments.append((*a, *b))


_PAINTS = {"S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"}
_PATHS = _PAINTS | {"m", "l", "c", "v", "y", "h", "re"}


def _nearest(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


# lines to blocks


def split_at_rules(lines: list[Line], rules: list[Rule]) -> list[Line]:
    """Level lines cut where a vertical rule stands in a gap."""
    upright = sorted((r for r in rules if r.vertical), key=lambda r: r.pos)
    at = [r.pos for r in upright]

    def crossed(x0: float, x1: float, cross: float, height: float) -> bool:
        k = bisect_right(at, x0)
        while k < len(at) and at[k] < x1:
            if upright[k].hi >= cross and upright[k].lo <= cross + height:
                return True
            k += 1
        return False

    def pieces(f: Fragment, cross: float) -> list[Fragment]:
        out, begin, x = [], 0, f.along0
        for place, x0, x1 in f.cuts:
            if begin < place <= len(f.text) and crossed(x0, x1, cross, f.height):
                out.append(replace(f, text=f.text[begin:place], along0=x, along1=x0, cuts=[], apart=True))
                begin, x = place, x1
        return [*out, replace(f, text=f.text[begin:], along0=x, cuts=[], apart=True)] if out else [f]

    if not upright:
        return lines
    return [Line(ln.cross, ln.orient, [p for f in ln.fragments for p in pieces(f, ln.cross)]) if ln.orient == 0 else ln for ln in lines]


@dataclass
class Shape:
    """The left edge of a paragraph so far: its first line's indent, and the margin of the others with its spread."""

    first: float
    space: float
    edge: float | None = None
    spread: float = 0.0

    def observe(self, x: float) -> None:
        if self.edge is None:
            self.edge = x
        elif x < self.edge:
            self.spread += self.edge - x
            self.edge = x
        else:
            self.spread = max(self.spread, x - self.edge)

    def begins_another(self, x: float, p: Policy) -> bool:
        """Whether a line is indented as the first one was, while the others share a margin."""
        if p.indent <= 0 or self.edge is None or self.space <= 0 or self.spread > 0.5 * self.space:
            return False
        now, own = (x - self.edge) / self.space, (self.first - self.edge) / self.space
        return p.indent <= now <= p.indent_most and abs(now - own) <= 0.5


def continues(prev: Line, line: Line, p: Policy) -> bool:
    """Whether a line goes on with the block of the one before."""
    height, step = prev.height(), prev.cross - line.cross
    if prev.orient != line.orient or height <= 0 or step < 0 or step > p.paragraph * height:
        return False
    ids = {f.mcid for f in prev.fragments + line.fragments}
    if len(ids) == 1 and None not in ids:
        return True
    small, large = sorted((prev.size(), line.size()))
    return not (p.size > 1 and small > 0 and large > small * p.size)


_CJK = re.compile(r"[　-ヿ㐀-䶿一-鿿豈-﫿＀-ﾟ]")


def _dash(c: str) -> bool:
    return c in "­−" or unicodedata.category(c) == "Pd"


def _needs_space(before: str, after: str) -> bool:
    """Whether a line end between two texts stands for a space: not in CJK text, nor behind a dash that a word holds."""
    if spaced(before)[1] or spaced(after)[0] or (before and after and _CJK.match(before[-1]) and _CJK.match(after[0])):
        return False
    word = before
    while word and _dash(word[-1]):
        word = word[:-1]
    return word == before or not (word[-1:].isalpha() or word[-1:].isdecimal())


def append_line(block: Block, line: Line, p: Policy) -> None:
    for i, f in enumerate(line.fragments):
        if not f.text:
            continue
        last = block.spans[-1] if block.spans else None
        if i == 0 and last and _needs_space(block.text if last.text and all(map(_dash, last.text)) else last.text, f.text):
            last.text += " "
        box = f.box()
        if last and not f.apart and last.mcid == f.mcid and last.style.same_run(f.style, p.equal):
            last.text += f.text
            last.box = union(last.box, box) or last.box
        else:
            block.spans.append(Span(f.text, f.style, box, f.mcid))


def blocks(lines: list[Line], rules: list[Rule], policy: Policy | None = None) -> list[Block]:
    """Paragraphs from the lines in the order they were shown; lines of artifacts only are left out, and what follows begins anew."""
    p = policy or Policy()
    out: list[Block] = []
    prev, shape = None, None
    for line in split_at_rules(lines, rules):
        line.fragments.sort(key=lambda f: f.along0)
        artifact = all(f.artifact for f in line.fragments)
        if artifact and not p.keep_artifacts:
            prev = shape = None
            continue
        left = line.extent()[0]
        if prev is None or not continues(prev, line, p) or shape.begins_another(left, p):
            out.append(Block("artifact" if artifact else "paragraph"))
            shape = Shape(left, line.space())
        else:
            shape.observe(left)
        append_line(out[-1], line, p)
        prev = line
    return [b for b in out if b.text.strip()]


def read_page(store: Store, number: int, fonts: dict | None = None, policy: Policy | None = None, record: bool = False) -> tuple[Page, Walk]:
    """A page by its number from 1, and the walk over its content; a page that can't be read is empty."""
    info = store.pages[number - 1]
    page, walk = Page(number, store.page_box(info), store.int(info, "Rotate") or 0), Walk(store, fonts, policy, record)
    try:
        walk.run(store.content(info), store.dict(info, "Resources"))
    except (ValueError, RecursionError):
        walk = Walk(store, fonts, policy, record)
    page.blocks, page.rules = blocks(walk.lines, walk.rules, policy), walk.rules
    for s in (s for b in page.blocks for s in b.spans):
        s.page = number
    return page, walk


def read_document(store: Store, policy: Policy | None = None) -> Document:
    """All pages, every one that the file has."""
    fonts: dict = {}
    return Document([read_page(store, i, fonts, policy)[0] for i in range(1, len(store.pages) + 1)], store.metadata())
