"""Fonts: from the bytes of a shown string to glyphs with text and width."""

from __future__ import annotations

import codecs
import re
from functools import lru_cache
from typing import Any, NamedTuple

from quirefold.sources.pdf import cmaps
from quirefold.sources.pdf.encodings import base_encoding, glyph_text, standard_width
from quirefold.sources.pdf.objects import Store, Stream, as_number
from quirefold.sources.pdf.tokens import Name

MAX_WIDTHS, MAX_SPAN = 1 << 20, 1 << 16


class Glyph(NamedTuple):
    code: int
    size: int
    cid: int
    text: str
    width: float


def plain_name(base_font: str) -> str:
    """The name without the mark of a subset."""
    return re.sub(r"^[A-Z]{6}\+(?=.)", "", base_font, flags=re.S)


def cid_widths(store: Store, rows: list) -> dict[int, float]:
    """A W array: a first id with a list of widths, or a first and last id with one width."""
    out: dict[int, float] = {}
    at = 0
    while at < len(rows):
        first = as_number(store.resolve(rows[at]))
        at += 1
        if first is None or at >= len(rows):
            continue
        second = store.resolve(rows[at])
        at += 1
        if isinstance(second, list):
            for i, w in enumerate(second):
                if (width := as_number(store.resolve(w))) is not None and len(out) < MAX_WIDTHS:
                    out[int(first) + i] = width
            continue
        last = as_number(second)
        if last is None or at >= len(rows):
            continue
        width = as_number(store.resolve(rows[at]))
        at += 1
        if width is not None and 0 <= first <= last and last - first < MAX_SPAN and len(out) + last - first < MAX_WIDTHS:
            out.update(dict.fromkeys(range(int(first), int(last) + 1), width))
    return out


def _tables(texts: list[str], widths: list[float]) -> tuple[str, list[float]]:
    """A character for each code (U+FFFE, which codecs takes for undefined, where a code has no single one), and the widths."""
    return "".join(t if len(t) == 1 and w >= 0 else "\ufffe" for t, w in zip(texts, widths, strict=True)), widths


@lru_cache(512)
def _standard_tables(base_font: str, names: tuple[str, ...], default: float) -> tuple[str, list[float]]:
    """The tables of a font that has neither widths nor a CMap of its own: many files have the same."""
    widths = [standard_width(base_font, n) for n in names]
    return _tables([glyph_text(n) or "" for n in names], [default if w is None else float(w) for w in widths])


class Font:
    def __init__(self, store: Store, info: dict):
        self.store = store
        self.base_font = store.name(info, "BaseFont") or ""
        self.subtype = store.name(info, "Subtype") or ""
        self.composite = self.subtype == "Type0"
        self.name = plain_name(self.base_font)
        self.vertical, self.widths, self.first, self.default = False, [], 0, 0.0
        self.names: list[str] = []
        self.to_unicode = None
        if (data := store.data_of(info, "ToUnicode")) is not None:
            try:
                found = cmaps.parse(data)
                self.to_unicode = found if found.texts else None
            except ValueError:
                pass
        self._glyphs: dict[int, Glyph] = {}
        self._table: str | None = None
        (self._composite if self.composite else self._simple)(info)
        self.space_width = self._space()

    def _simple(self, info: dict) -> None:
        s = self.store
        descriptor = s.dict(info, "FontDescriptor")
        encoding = s.get(info, "Encoding")
        named = str(encoding) if isinstance(encoding, Name) else s.name(encoding, "BaseEncoding") if isinstance(encoding, dict) else None
        if named:
            names = base_encoding(named) or base_encoding("StandardEncoding")
        else:
            symbolic = (s.int(descriptor, "Flags") or 0) & 4 if descriptor is not None else self.name in ("Symbol", "ZapfDingbats")
            names = ("",) * 256 if symbolic else base_encoding("StandardEncoding")
        self.names, code = list(names), -1
        for item in (s.array(encoding, "Differences") or []) if isinstance(encoding, dict) else []:
            item = s.resolve(item)
            if (n := as_number(item)) is not None:
                code = int(n) if 0 <= n <= 255 else -1
            elif isinstance(item, Name) and code >= 0:
                self.names[code] = str(item)
                code = code + 1 if code < 255 else -1
        self.first = s.int(info, "FirstChar") or 0
        self.widths = [as_number(s.resolve(w)) or 0.0 for w in s.array(info, "Widths") or []]
        self.default = s.num(descriptor, "MissingWidth") or 0.0
        self._traits(descriptor)
        matrix = s.array(info, "FontMatrix") or []
        scale = as_number(s.resolve(matrix[0])) if self.subtype == "Type3" and len(matrix) == 6 else None
        if scale:
            self.widths, self.default = [w * scale * 1000 for w in self.widths], self.default * scale * 1000

    def _composite(self, info: dict) -> None:
        s = self.store
        encoding = s.get(info, "Encoding")
        self.cmap = cmaps.named(str(encoding) if isinstance(encoding, Name) else "")
        if isinstance(encoding, Stream) and (data := s.decoded(encoding)) is not None:
            try:
                self.cmap = cmaps.parse(data)
            except ValueError:
                pass
        self.vertical = self.cmap.name.endswith("-V")
        self.default = 1000.0
        below = s.array(info, "DescendantFonts") or []
        own = s.resolve(below[0]) if below else None
        self.cids = cid_widths(s, s.array(own, "W") or [])
        if (dw := s.num(own, "DW")) is not None:
            self.default = dw
        self._traits(s.dict(own, "FontDescriptor"))

    def _traits(self, descriptor: dict | None) -> None:
        s, name = self.store, self.name.lower()
        flags = s.int(descriptor, "Flags") or 0
        weight, stem = s.num(descriptor, "FontWeight") or 0, s.num(descriptor, "StemV") or 0
        self.mono = bool(flags & 1) or any(w in name for w in ("mono", "courier", "consolas"))
        self.italic = bool(flags & 64) or bool(s.num(descriptor, "ItalicAngle")) or any(w in name for w in ("italic", "oblique"))
        self.bold = weight >= 600 or stem > 120 or any(w in name for w in ("bold", "black", "heavy"))

    def _width(self, code: int, cid: int) -> float:
        if self.composite:
            return self.cids.get(cid, self.default)
        if 0 <= code - self.first < len(self.widths):
            return self.widths[code - self.first]
        if self.subtype != "Type3" and (w := standard_width(self.base_font, self.names[code])) is not None:
            return float(w)
        return self.default

    def _text(self, code: int) -> str:
        found = self.to_unicode.texts.get(code, "") if self.to_unicode else ""
        return found or ("" if self.composite else glyph_text(self.names[code]) or "")

    def _glyph(self, code: int, size: int) -> Glyph:
        cid = code
        if self.composite and (found := self.cmap.cid(code)) is not None:
            cid = found
        return Glyph(code, size, cid, self._text(code), self._width(code, cid))

    def decode(self, data: bytes) -> list[Glyph]:
        out = []
        for code, size in self.cmap.codes(data) if self.composite else ((c, 1) for c in data):
            key = code << 3 | size
            if key not in self._glyphs:
                self._glyphs[key] = self._glyph(code, size)
            out.append(self._glyphs[key])
        return out

    def run(self, data: bytes) -> tuple[str, float, float, int, int] | None:
        """The text of a string, the sum of its widths, the last width, its single-byte spaces and its glyphs; None where one has no text or a negative width."""
        if self.composite:
            glyphs = self.decode(data)
            if not all(g.text and g.width >= 0 for g in glyphs):
                return None
            return "".join([g.text for g in glyphs]), sum(g.width for g in glyphs), glyphs[-1].width, sum(g.size == 1 and g.code == 32 for g in glyphs), len(glyphs)
        if self._table is None:
            if self.to_unicode or self.widths:
                self._table, self._advances = _tables([self._text(c) for c in range(256)], [self._width(c, c) for c in range(256)])
            else:
                self._table, self._advances = _standard_tables(self.base_font if self.subtype != "Type3" else "", tuple(self.names), self.default)
        try:
            text = codecs.charmap_decode(data, "strict", self._table)[0]
        except UnicodeDecodeError:
            return None
        return text, sum(map(self._advances.__getitem__, data)), self._advances[data[-1]], data.count(32), len(data)

    def _space(self) -> float:
        if self.composite:
            code = self.to_unicode.code_for(" ") if self.to_unicode else None
            return self.default if code is None else self._width(code, code if (cid := self.cmap.cid(code)) is None else cid)
        return self._width(32, 32) if glyph_text(self.names[32]) == " " else 0.0


def load(store: Store, resources: Any, name: str, known: dict) -> Font | None:
    """The font of a name in these resources; a font that several pages refer to is loaded once."""
    fonts = store.dict(resources, "Font") or {}
    raw = fonts.get(name)
    info = store.resolve(raw)
    if isinstance(info, Stream):
        info = info.info
    if not isinstance(info, dict):
        return None
    key = raw if not isinstance(raw, dict) else id(raw)
    if key not in known:
        known[key] = Font(store, info)
    return known[key]
