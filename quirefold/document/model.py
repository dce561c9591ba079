"""Spans, blocks, pages, sections and outlines of one document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

Box = tuple[float, float, float, float]


def union(a: Box | None, b: Box | None) -> Box | None:
    """The bounding box of two; one without an area doesn't count."""
    real = [r for r in (a, b) if r and (r[2] - r[0]) * (r[3] - r[1]) > 0]
    return (min(r[0] for r in real), min(r[1] for r in real), max(r[2] for r in real), max(r[3] for r in real)) if real else None


class Style(NamedTuple):
    font: str = ""
    size: float = 0.0
    bold: bool = False
    italic: bool = False
    mono: bool = False
    hidden: bool = False

    def same_run(self, other: Style, close: float = 1e-6) -> bool:
        """Whether two spans of these styles are one run."""
        return self[:1] + self[2:] == other[:1] + other[2:] and abs(self.size - other.size) <= close


class Rule(NamedTuple):
    vertical: bool
    pos: float
    lo: float
    hi: float


class Cell(NamedTuple):
    table: int
    row: int
    col: int
    header: bool


@dataclass
class Span:
    text: str
    style: Style = Style()
    box: Box = (0.0, 0.0, 0.0, 0.0)
    mcid: int | None = None
    page: int = 0


@dataclass
class Block:
    role: str
    spans: list[Span] = field(default_factory=list)
    level: int = 0
    marker: str = ""
    cell: Cell | None = None
    lang: str = ""
    alt: str = ""
    replacement: str = ""
    own_box: Box | None = None

    @property
    def text(self) -> str:
        return "".join(s.text for s in self.spans)

    @property
    def box(self) -> Box | None:
        if self.own_box:
            return self.own_box
        out = None
        for s in self.spans:
            out = union(out, s.box)
        return out

    @property
    def mcids(self) -> list[int]:
        return list(dict.fromkeys(s.mcid for s in self.spans if s.mcid is not None))

    def is_empty(self) -> bool:
        return not (self.alt or self.replacement or self.text.strip())

    def shown(self) -> str:
        """What stands for the block in plain text: its replacement, its own text, or its description."""
        return self.replacement or (self.text if self.text.strip() or not self.alt else self.alt)


@dataclass
class Page:
    number: int
    box: Box = (0.0, 0.0, 612.0, 792.0)
    rotate: int = 0
    blocks: list[Block] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    rasterized: bool = False

    @property
    def text(self) -> str:
        return "\n".join(b.text for b in self.blocks)

    def coverage(self) -> float:
        """The share of the page that the bounding box of its text has."""
        bounds = None
        for b in self.blocks:
            bounds = union(bounds, b.box)
        whole = (self.box[2] - self.box[0]) * (self.box[3] - self.box[1])
        return min(1.0, (bounds[2] - bounds[0]) * (bounds[3] - bounds[1]) / whole) if bounds and whole > 0 else 0.0


@dataclass
class Document:
    pages: list[Page] = field(default_factory=list)
    meta: dict[str, Any] = field(default_factory=dict)

    @property
    def text(self) -> str:
        return "\n\n".join(p.text for p in self.pages)


@dataclass
class Section:
    title: str
    level: int
    number: str = ""
    blocks: list[Block] = field(default_factory=list)
    kids: list[Section] = field(default_factory=list)
    parent: Section | None = None
    first_page: int = 0
    last_page: int = 0

    @property
    def text(self) -> str:
        return "\n\n".join(b.text for b in self.blocks if b.text)

    def path(self) -> list[str]:
        return [*(self.parent.path() if self.parent else []), self.title]


@dataclass
class Outline:
    meta: dict[str, Any] = field(default_factory=dict)
    sections: list[Section] = field(default_factory=list)
    preamble: list[Block] = field(default_factory=list)
    unplaced: list[Page] = field(default_factory=list)

    def walk(self) -> Iterator[Section]:
        """The sections, parents before their kids."""
        todo = list(reversed(self.sections))
        while todo:
            s = todo.pop()
            yield s
            todo += reversed(s.kids)

    def stats(self) -> dict[str, int]:
        all_of, left = list(self.walk()), [b for p in self.unplaced for b in p.blocks]
        return {
            "sections": len(all_of), "titled": sum(bool(s.title) for s in all_of), "numbered": sum(bool(s.number) for s in all_of), "max_level": max((s.level for s in all_of), default=0),
            "blocks": len(self.preamble) + sum(len(s.blocks) for s in all_of), "unplaced_blocks": len(left), "unplaced_bytes": sum(len(b.text.encode()) for b in left),
        }
