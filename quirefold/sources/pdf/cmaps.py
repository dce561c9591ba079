"""CMaps: from the bytes of a string to codes, and from codes to character ids or text."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quirefold.sources.pdf.encodings import glyph_text
from quirefold.sources.pdf.tokens import Lexer, Name

MAX_RANGES, MAX_ENTRIES, MAX_SPAN = 256, 1 << 20, 1 << 16
TWO_BYTES = (2, 0, 0xFFFF)


@dataclass
class CMap:
    name: str = ""
    ranges: list[tuple[int, int, int]] = field(default_factory=list)  # bytes, lowest, highest code
    cids: dict[int, int] = field(default_factory=dict)
    texts: dict[int, str] = field(default_factory=dict)
    identity: bool = False

    def cid(self, code: int) -> int | None:
        return code if self.identity else self.cids.get(code)

    def code_for(self, text: str) -> int | None:
        """The smallest code that stands for a text."""
        return min((c for c, t in self.texts.items() if t == text), default=None)

    def codes(self, data: bytes) -> list[tuple[int, int]]:
        """Code and length of each character; bytes in no range are taken in the shortest length that there is."""
        ranges = self.ranges or [TWO_BYTES]
        if ranges == [TWO_BYTES]:
            return [(int.from_bytes(data[i : i + 2]), len(data[i : i + 2])) for i in range(0, len(data), 2)]
        out, at, shortest = [], 0, min(r[0] for r in ranges)
        while at < len(data):
            for n in range(1, min(4, len(data) - at) + 1):
                code = int.from_bytes(data[at : at + n])
                if any(n == size and low <= code <= high for size, low, high in ranges):
                    break
            else:
                n = min(shortest, len(data) - at)
                code = int.from_bytes(data[at : at + n])
            out.append((code, n))
            at += n
        return out


def named(name: str) -> CMap:
    """A predefined CMap: two bytes a code; only the identities are known in full."""
    return CMap(name, [TWO_BYTES], identity=name in ("Identity-H", "Identity-V"))


def utf16(data: bytes) -> str:
    return data[: len(data) // 2 * 2].decode("utf-16-be", "replace")


def nth_after(text: str, n: int) -> str:
    """The text with its last character moved on by n; as it is where there is no such character."""
    last = ord(text[-1]) + n if text and n else None
    if last is None or last > 0x10FFFF or 0xD800 <= last <= 0xDFFF:
        return text
    return text[:-1] + chr(last)


def _target(found: Any) -> str | None:
    return utf16(found) if isinstance(found, bytes) else glyph_text(str(found)) if isinstance(found, Name) else None


class _Parser:
    def __init__(self, data: bytes):
        self.lex, self.out, self.operands = Lexer(data), CMap(), []

    def rows(self, end: str):
        """The objects of a section, one by one; brackets come as such, words other than its end are left out."""
        while True:
            t = self.lex.next()
            if t.kind is None or (t.kind == "operator" and t.value == end):
                return
            if t.kind != "operator":
                yield t

    def room(self, n: int = 1) -> None:
        if len(self.out.cids) + len(self.out.texts) + n > MAX_ENTRIES:
            raise ValueError("a CMap with too many entries")

    def codespace(self) -> None:
        rows = self.rows("endcodespacerange")
        for low, high in zip(rows, rows, strict=False):
            a, b = low.value, high.value
            if isinstance(a, bytes) and isinstance(b, bytes) and 0 < len(a) == len(b) <= 4:
                if len(self.out.ranges) >= MAX_RANGES:
                    raise ValueError("a CMap with too many ranges")
                self.out.ranges.append((len(a), int.from_bytes(a), int.from_bytes(b)))

    def bfchar(self) -> None:
        rows = self.rows("endbfchar")
        for source in rows:
            if isinstance(source.value, bytes) and (target := next(rows, None)) is not None:
                self.room()
                if (text := _target(target.value)) is not None:
                    self.out.texts[int.from_bytes(source.value)] = text

    def bfrange(self) -> None:
        rows = self.rows("endbfrange")
        for first in rows:
            last = next(rows, None) if isinstance(first.value, bytes) else None
            target = next(rows, None) if last is not None and isinstance(last.value, bytes) else None
            if target is None:
                continue
            low, high = int.from_bytes(first.value), int.from_bytes(last.value)
            if target.kind == "[":
                code = low
                for item in rows:
                    if item.kind == "]":
                        break
                    if code <= high:
                        self.room()
                        if (text := _target(item.value)) is not None:
                            self.out.texts[code] = text
                        code += 1
            elif 0 <= high - low < MAX_SPAN and (text := _target(target.value)) is not None:
                self.room(high - low + 1)
                self.out.texts.update((code, nth_after(text, code - low)) for code in range(low, high + 1))

    def cidchar(self) -> None:
        rows = self.rows("endcidchar")
        for source in rows:
            if isinstance(source.value, bytes) and (target := next(rows, None)) is not None and _cid(target.value):
                self.room()
                self.out.cids[int.from_bytes(source.value)] = target.value

    def cidrange(self) -> None:
        rows = self.rows("endcidrange")
        for first in rows:
            last = next(rows, None) if isinstance(first.value, bytes) else None
            target = next(rows, None) if last is not None and isinstance(last.value, bytes) else None
            if target is not None and _cid(target.value):
                low, high = int.from_bytes(first.value), int.from_bytes(last.value)
                if 0 <= high - low < MAX_SPAN:
                    self.room(high - low + 1)
                    self.out.cids.update((code, target.value + code - low) for code in range(low, high + 1))

    def run(self) -> CMap:
        sections = {"begincodespacerange": self.codespace, "beginbfchar": self.bfchar, "beginbfrange": self.bfrange, "begincidchar": self.cidchar, "begincidrange": self.cidrange}
        while (t := self.lex.next()).kind is not None:
            if t.kind == "object":
                self.operands = [*self.operands[-7:], t.value]
                continue
            if t.kind == "operator":
                last = self.operands[-1] if self.operands else None
                if t.value in sections:
                    sections[t.value]()
                elif t.value == "usecmap" and last in ("Identity-H", "Identity-V"):
                    self.out.ranges, self.out.identity = self.out.ranges or [TWO_BYTES], True
                elif t.value == "def" and len(self.operands) > 1 and self.operands[-2] == "CMapName" and isinstance(last, Name):
                    self.out.name = str(last)
            self.operands = []
        return self.out


def _cid(found: Any) -> bool:
    return isinstance(found, int) and not isinstance(found, bool) and 0 <= found <= 0xFFFFFFFF


def parse(data: bytes) -> CMap:
    """A CMap from its program; damage is passed over, only far too many entries are a ValueError."""
    return _Parser(data).run()
