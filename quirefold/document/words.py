"""Text rules of one document in plain Python: markers, numbering, names, sentences. functions/scalars has them as column expressions."""

from __future__ import annotations

import math
import re
from typing import Any

from quirefold.document.model import Block

_NUMBERED = re.compile(r"([0-9]+(?:\.[0-9]+)*)\.?(?=\s)")
_ANNEXED = re.compile(r"([A-Z](?:\.[0-9]+)+)\.?(?=\s)")
_CLAUSE = re.compile(r"([0-9]+(?:\.[0-9]+)*)\.*(?=[ \t])")
_REFERENCE = re.compile(r"(?:[A-Z]|[0-9]+)(?:\.[0-9]+)+")
_BREAKS = re.compile(r"[\n\r\t ]")
_LINE_ENDS = re.compile(r"\r\n|\r|\n")
_LATIN = re.compile(r"[A-Za-z0-9]+")

BULLETS = frozenset("•‣⁃■▪○●◦–—")
DECLARED = BULLETS | {"-"}
MAX_TITLE, MAX_SLUG, MAX_DESCRIPTION, MAX_PATH = 200, 60, 300, 150
_ORDERED = re.compile(r"(?:(\d{1,3})[.)]|\[(\d{1,3})\]|([a-z])[.)])(?=\s+\S)", re.ASCII)


def bullet(text: str, marks: frozenset[str] = BULLETS) -> str:
    """The bullet that a text begins with, if white space and content follow."""
    t = text.strip()
    return t[0] if len(t) > 1 and t[0] in marks and t[1].isspace() else ""


def ordered_label(text: str) -> tuple[str, int]:
    """The label of an ordered item and its value; ('', 0) for none."""
    t = text.lstrip()
    m = re.match(r"(?:([0-9]{1,3})[.)]|\[([0-9]{1,3})\]|([a-z])[.)])(?=\s+\S)", t)
    if not m:
        return "", 0
    return m[0], int(m[1] or m[2]) if m[1] or m[2] else ord(m[3]) - 96


def same_form(a: str, b: str) -> bool:
    digits = [any(c.isdigit() for c in x) for x in (a, b)]
    return digits[0] == digits[1] and re.sub("[0-9a-z]", "", a) == re.sub("[0-9a-z]", "", b)


def _strip_front(block: Block, n: int) -> None:
    """Takes n characters and the white space behind them off the spans; emptied spans stay."""
    for s in block.spans:
        if n >= len(s.text):
            n -= len(s.text)
            s.text = ""
            continue
        s.text, n = s.text[n:].lstrip(), 0
        if s.text:
            return


def strip_bullet(block: Block, marks: frozenset[str] = BULLETS) -> bool:
    """Moves the bullet from the text to the marker."""
    mark = bullet(block.text, marks)
    if mark:
        block.marker = mark
        _strip_front(block, block.text.index(mark) + 1)
    return bool(mark)


def strip_ordered(block: Block) -> bool:
    """Moves the label from the text to the marker."""
    label, _ = ordered_label(block.text)
    if label:
        block.marker = label
        _strip_front(block, block.text.index(label) + len(label))
    return bool(label)


def set_marker(block: Block, marker: str) -> None:
    block.marker = marker
    _strip_front(block, 0)


def enumerated(marker: str) -> bool:
    """Whether a marker says more than that there is an item."""
    return bool(marker) and not (len(marker) == 1 and marker in DECLARED)


def arabic(marker: str) -> str:
    """The digits of a marker like 12. or 12)."""
    m = re.fullmatch(r"([0-9]{1,9})[.)]", marker)
    return m[1] if m else ""


def numbered_level(text: str) -> int:
    """The depth of a dotted number before white space; 0 for none."""
    m = _NUMBERED.match(text)
    return m[1].count(".") + 1 if m else 0


def annex_level(text: str) -> int:
    m = _ANNEXED.match(text)
    return m[1].count(".") + 1 if m else 0


def clause_number(title: str) -> str:
    """The number that a title begins with, up to a space or tab."""
    m = _CLAUSE.match(title)
    return m[1] if m else ""


def reference_number(text: str, at: int = 0) -> str:
    """A clause number of two parts or more at the start of a text, or at a place in it; its first part may be a letter."""
    m = _REFERENCE.match(text, at)
    return m[0] if m else ""


def clean(text: str) -> str:
    return " ".join(text.split())


def collapse(text: str) -> str:
    return " ".join(text.split()) if _BREAKS.search(text) else text


def one_line(text: str) -> str:
    return _LINE_ENDS.sub(" ", text)


def inline_text(text: str) -> str:
    """Without soft hyphens, line ends as spaces."""
    return one_line(text.replace("­", ""))


def cut_bytes(text: str, most: int) -> str:
    """The longest beginning of at most so many UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore") if len(text) * 4 > most else text


def _last_space(text: str) -> int:
    """The byte offset of the last white space; -1 for none."""
    k = max((i for i, c in enumerate(text) if c.isspace()), default=-1)
    return k if k < 0 else len(text[:k].encode())


def truncate(text: str, most: int = MAX_TITLE) -> str:
    """At most so many bytes, back to the last space if that lies behind the middle."""
    if len(text.encode()) <= most:
        return text
    cut = cut_bytes(text, most)
    if (at := _last_space(cut)) > most // 2:
        cut = cut_bytes(cut, at)
    return cut.rstrip()


def first_sentence(text: str) -> str:
    """Up to an end mark before white space that isn't behind an initial, within MAX_DESCRIPTION bytes; else a cut with an ellipsis."""
    for m in re.finditer(r"[.!?](?=\s)", text):
        i = m.start()
        if i >= 2 and text[i - 2].isspace() and text[i - 1].isascii() and text[i - 1].isalpha():
            continue
        if len(text[: i + 1].encode()) <= MAX_DESCRIPTION:
            return text[: i + 1]
    if len(text.encode()) <= MAX_DESCRIPTION:
        return text
    cut = cut_bytes(text, MAX_DESCRIPTION - len("…".encode()))
    if (at := _last_space(cut)) > MAX_DESCRIPTION // 2:
        cut = cut_bytes(cut, at)
    return re.sub(r"[\s,;:]+$", "", cut) + "…"


def describe(blocks: list[Block]) -> str:
    for b in blocks:
        if b.role != "artifact" and not b.is_empty() and (t := first_sentence(collapse(b.shown()))):
            return t
    return ""


def kebab(text: str) -> str:
    return "-".join(p.lower() for p in _LATIN.findall(text))


def slug(number: str, title: str, parent: str, index: int) -> str:
    num, name, above = kebab(number), kebab(title), kebab(parent)
    name = name.removeprefix(num + "-")
    if len(name) > MAX_SLUG:
        name = name[:MAX_SLUG]
        if (k := name.rfind("-")) > MAX_SLUG // 2:
            name = name[:k]
    name = name.strip("-")
    if above and num != above:
        num = num.removeprefix(above + "-")
    return "-".join(p for p in (num, name) if p) or f"section-{index + 1}"


def names_for(number: str, title: str, parent: str, index: int) -> list[str]:
    """Names for a section's file, the best first."""
    full = slug(number, title, "", index)
    if not kebab(number):
        return [full, f"section-{index + 1}"]
    return list(dict.fromkeys([full, slug(number, title, parent, index)])) + [kebab(number)]


def fitting(folder: str, names: list[str]) -> str:
    """The first name whose path stays short; the last if none does."""
    return next((n for n in names if len(folder) + 8 + 2 * len(n) <= MAX_PATH), names[-1])


def unique(taken: set[str], base: str) -> str:
    name, n = base, 2
    while name in taken:
        name, n = f"{base}-{n}", n + 1
    taken.add(name)
    return name


def iso_id(text: str) -> str:
    m = re.match(r"(?i:iso)(?:/[^ \t]*(?=[ \t]))?[ \t]*([0-9](?:[0-9]|-(?=[0-9]))*)([:-][12][0-9]{3})?", text)
    if not m:
        return ""
    if m[2]:
        return f"iso{m[1]}:{m[2][1:]}"
    head, dash, year = m[1].rpartition("-")
    return f"iso{head}:{year}" if dash and re.fullmatch("[12][0-9]{3}", year) else f"iso{m[1]}"


def doc_id(meta: dict[str, Any]) -> str:
    source = meta.get("title") or re.split(r"[\\/]", meta.get("path") or "")[-1].removesuffix(".pdf")
    if found := iso_id(source):
        return found
    return kebab(source)[:MAX_SLUG].strip("-") or "document"


def iso_date(text: str) -> str:
    m = re.match(r"(?:D:)?([12][0-9]{3})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])", text)
    return "-".join(m.groups()) if m else ""


def fmt_pages(first: int, last: int) -> str:
    return "" if not first else f"pages {first}–{last}" if last > first else f"page {first}"


def quantize(x: float) -> float:
    return math.floor(x * 100 + 0.5) / 100
