"""The objects of a PDF file: cross references (tables, streams, hybrid, rebuilt), object streams, pages, typed getters."""

from __future__ import annotations

import re
from typing import Any

from quirefold.functions import codecs
from quirefold.sources.pdf.encodings import text_string
from quirefold.sources.pdf.tokens import _NEXT_OR_REF, MAX_NESTING, Lexer, Name, Ref

MAX_HOPS, MAX_PAGES_DEPTH = 32, 64


class Stream:
    """A dictionary with data, decoded when it is first asked for."""

    def __init__(self, info: dict, raw: bytes):
        self.info, self.raw = info, raw


_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_OBJ = re.compile(rb"(?<!\d)(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![a-zA-Z])")
_ENTRY = re.compile(rb"\s*(\d{1,20})\s+(\d{1,10})\s+([nf])")


def value(lex: Lexer, depth: int = 0) -> Any:
    """The object at the lexer; what can't be one is null."""
    return _value(lex, *lex.scan(_NEXT_OR_REF), depth)


def _value(lex: Lexer, kind: str | None, found: Any, depth: int) -> Any:
    """The object that begins with a token."""
    if kind == "object":
        if type(found) is int and found >= 0 and (m := _REF.match(lex.data, lex.at)):
            lex.at = m.end()
            return Ref(found, int(m[1]))
        return found
    if kind not in ("[", "<<") or depth > MAX_NESTING:
        return None
    items = []
    while True:
        before = lex.at
        inner, item = lex.scan(_NEXT_OR_REF)
        if inner in (None, "]", ">>"):
            break
        if inner == "operator":
            if item in ("endobj", "stream", "endstream"):
                lex.at = before
                break
            continue
        items.append(item if inner == "object" and type(item) is not int else _value(lex, inner, item, depth + 1))
    if kind == "[":
        return items
    return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}


class Store:
    """A file's objects. A file that isn't a PDF, or has no catalogue, is a ValueError; anything else that is missing is null."""

    def __init__(self, data: bytes):
        head = data.find(b"%PDF-", 0, 1024)
        if head < 0:
            raise ValueError("not a PDF file")
        self.data, self.head = data, head
        m = re.match(rb"%PDF-(\d\.\d)", data[head:])
        self.version = m[1].decode() if m else ""
        self.entries: dict[int, tuple[int, int, bool]] = {}  # offset and generation, or object stream and index
        self.cache: dict[int, Any] = {}
        self.inside: dict[int, list[tuple[int, Any]]] = {}
        self.trailer: dict = {}
        self.hybrid = self.xref_streams = self.rebuilt = False
        self._busy: set[int] = set()
        try:
            self._read_references()
            usable = isinstance(self.dict(self.trailer, "Root"), dict) and bool(self.dict(self.dict(self.trailer, "Root"), "Pages"))
        except (ValueError, RecursionError):
            usable = False
        if not usable:
            self._rebuild()
        self.catalog = self.dict(self.trailer, "Root") or {}
        if not self.catalog:
            raise ValueError("no catalogue")
        if isinstance(later := self.get(self.catalog, "Version"), Name) and re.fullmatch(r"\d\.\d", later) and later > self.version:
            self.version = str(later)
        self.encrypted = self.get(self.trailer, "Encrypt") is not None
        self.pages = self._pages()

    # cross references

    def _read_references(self) -> None:
        tail = self.data.rfind(b"startxref")
        m = re.match(rb"startxref\s*(\d+)", self.data[tail:]) if tail >= 0 else None
        if not m:
            raise ValueError("no startxref")
        todo, seen = [int(m[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            m = re.match(rb"\s*xref\s*", self.data[at + self.head : at + self.head + 64])
            found = self._table(at + self.head + m.end()) if m else self._reference_stream(at + self.head)
            self.trailer = found | self.trailer
            if m and isinstance(found.get("XRefStm"), int):
                self.hybrid = True
                todo.append(found["XRefStm"])
            if isinstance(prev := found.get("Prev"), int | float):
                todo.append(int(prev))

    def _table(self, at: int) -> dict:
        while m := re.compile(rb"\s*(\d+)\s+(\d+)(?=\s)").match(self.data, at):
            first, n, at = int(m[1]), int(m[2]), m.end()
            for num in range(first, first + n):
                e = _ENTRY.match(self.data, at)
                if not e:
                    raise ValueError("a cross reference table breaks off")
                at = e.end()
                if e[3] == b"n":
                    self.entries.setdefault(num, (int(e[1]), int(e[2]), False))
                else:
                    self.entries.setdefault(num, (-1, 0, False))
        lex = Lexer(self.data, at)
        if lex.next().value != "trailer":
            raise ValueError("no trailer")
        found = value(lex)
        return found if isinstance(found, dict) else {}

    def _reference_stream(self, at: int) -> dict:
        s = self._at(at)
        if not isinstance(s, Stream):
            raise ValueError("no cross references")
        self.xref_streams = True
        widths = [int(w) for w in self.array(s.info, "W") or []]
        if len(widths) != 3 or sum(widths) == 0:
            raise ValueError("a cross reference stream without widths")
        data, size = self.decoded(s) or b"", sum(widths)
        index = self.array(s.info, "Index") or [0, self.int(s.info, "Size") or 0]
        row = 0
        for first, n in zip(index[::2], index[1::2], strict=False):
            for num in range(int(first), int(first) + int(n)):
                part, row = data[row * size : (row + 1) * size], row + 1
                if len(part) < size:
                    return s.info
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(part[:a]) if widths[0] else 1
                x, y = int.from_bytes(part[a:b]), int.from_bytes(part[b:])
                self.entries.setdefault(num, (x, y, kind == 2) if kind else (-1, 0, False))
        return s.info

    def _rebuild(self) -> None:
        """Finds the objects by their headings; the last of a number counts."""
        self.rebuilt, trailer = True, {}
        self.entries, self.cache, self.inside = {}, {}, {}
        for m in _OBJ.finditer(self.data, self.head):
            self.entries[int(m[1])] = (m.start() - self.head, int(m[2]), False)
        for num in list(self.entries):
            found = self.resolve(Ref(num, 0))
            if isinstance(found, Stream) and found.info.get("Type") == "ObjStm":
                for i, (inner, _) in enumerate(self._object_stream(num)):
                    self.entries.setdefault(inner, (num, i, True))
        for m in re.finditer(rb"trailer", self.data):
            found = value(Lexer(self.data, m.end()))
            if isinstance(found, dict):
                trailer |= found
        for num in list(self.entries):
            found = self.resolve(Ref(num, 0))
            if isinstance(found, Stream) and found.info.get("Type") == "XRef":
                trailer = found.info | trailer
            if isinstance(found, dict) and found.get("Type") == "Catalog" and not self.dict(trailer, "Root"):
                trailer["Root"] = Ref(num, 0)
        self.trailer = trailer

    # objects

    def _at(self, at: int) -> Any:
        """The object whose heading is at an offset."""
        m = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj").match(self.data, at)
        if not m:
            return None
        lex = Lexer(self.data, m.end())
        found = value(lex)
        m = re.compile(rb"[\x00\t\n\x0c\r ]*stream(\r\n|\n|\r)?").match(self.data, lex.at)
        if not isinstance(found, dict) or not m:
            return found
        start, length = m.end(), self.resolve(found.get("Length"))
        if isinstance(length, int) and length >= 0 and re.compile(rb"\s*endstream").match(self.data, start + length):
            return Stream(found, self.data[start : start + length])
        end = self.data.find(b"endstream", start)
        raw = self.data[start : end if end >= 0 else len(self.data)]
        return Stream(found, raw[:-2] if raw[-2:] == b"\r\n" else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw)

    def _object_stream(self, num: int) -> list[tuple[int, Any]]:
        if num not in self.inside:
            self.inside[num] = []
            s = self.resolve(Ref(num, 0))
            if isinstance(s, Stream):
                data, first = self.decoded(s) or b"", self.int(s.info, "First") or 0
                head = [int(x) for x in re.findall(rb"\d+", data[:first])][: 2 * (self.int(s.info, "N") or 0)]
                self.inside[num] = [(n, value(Lexer(data, first + at))) for n, at in zip(head[::2], head[1::2], strict=False)]
        return self.inside[num]

    def _load(self, num: int) -> Any:
        at, second, packed = self.entries.get(num, (-1, 0, False))
        if at < 0 or num in self._busy:
            return None
        self._busy.add(num)
        try:
            if not packed:
                return self._at(at + self.head)
            inside = self._object_stream(at)
            if second < len(inside) and inside[second][0] == num:
                return inside[second][1]
            return next((v for n, v in inside if n == num), None)
        finally:
            self._busy.discard(num)

    def resolve(self, found: Any) -> Any:
        """What a reference leads to, over at most MAX_HOPS others."""
        for _ in range(MAX_HOPS):
            if not isinstance(found, Ref):
                return found
            if found.num not in self.cache:
                self.cache[found.num] = self._load(found.num)
            found = self.cache[found.num]
        return None

    # typed getters: null and absent are the same

    def get(self, d: Any, key: str) -> Any:
        return self.resolve(d.get(key)) if isinstance(d, dict) else None

    def dict(self, d: Any, key: str) -> dict | None:
        found = self.get(d, key)
        return found.info if isinstance(found, Stream) else found if isinstance(found, dict) else None

    def array(self, d: Any, key: str) -> list | None:
        return found if isinstance(found := self.get(d, key), list) else None

    def name(self, d: Any, key: str) -> str | None:
        return str(found) if isinstance(found := self.get(d, key), Name) else None

    def num(self, d: Any, key: str) -> float | None:
        return as_number(self.get(d, key))

    def int(self, d: Any, key: str) -> int | None:
        found = self.num(d, key)
        return None if found is None else int(found)

    def bool(self, d: Any, key: str) -> bool | None:
        return found if isinstance(found := self.get(d, key), bool) else None

    def stream(self, d: Any, key: str) -> Stream | None:
        return found if isinstance(found := self.get(d, key), Stream) else None

    def data_of(self, d: Any, key: str) -> bytes | None:
        found = self.stream(d, key)
        return self.decoded(found) if found else None

    def text(self, d: Any, key: str) -> str:
        return text_string(self.get(d, key))

    def filters(self, s: Stream) -> list[str]:
        return [str(f) for f in map(self.resolve, as_list(self.get(s.info, "Filter") or self.get(s.info, "F"))) if isinstance(f, Name)]

    def params(self, s: Stream) -> list[dict | None]:
        found = [self.resolve(p) for p in as_list(self.get(s.info, "DecodeParms") or self.get(s.info, "DP"))]
        return [{k: self.resolve(v) for k, v in p.items()} if isinstance(p, dict) else None for p in found]

    def opened(self, s: Stream) -> tuple[bytes, list[str]]:
        """The data behind the filters, and those left from the first one for images on."""
        filters, params = self.filters(s), self.params(s)
        return codecs.decode_chain(filters, s.raw, [*params, *[None] * (len(filters) - len(params))])

    def decoded(self, s: Stream) -> bytes | None:
        """The data of a stream; null where a filter is for images, unknown or fails."""
        if not hasattr(s, "data"):
            try:
                data, left = self.opened(s)
                s.data = None if left else data
            except (ValueError, TypeError):
                s.data = None
        return s.data

    # pages

    def _pages(self) -> list[dict]:
        """The page dictionaries in order, with what they inherit."""
        out, seen = [], set()
        todo: list[tuple[Any, dict, int]] = [(self.catalog.get("Pages"), {}, 0)]
        while todo:
            at, above, depth = todo.pop()
            if isinstance(at, Ref):
                if at.num in seen:
                    continue
                seen.add(at.num)
            node = self.resolve(at)
            if not isinstance(node, dict) or depth > MAX_PAGES_DEPTH:
                continue
            own = above | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if self.get(node, k) is not None}
            if "Kids" in node and self.name(node, "Type") != "Page":
                todo += [(kid, own, depth + 1) for kid in reversed(self.array(node, "Kids") or [])]
            else:
                out.append({**node, **own, "__ref": at.num if isinstance(at, Ref) else None})
        return out

    def content(self, page: dict) -> bytes:
        """The content streams of a page in one piece; empty where there is none."""
        parts = [self.resolve(s) for s in as_list(self.get(page, "Contents"))]
        return b"\n".join(self.decoded(s) or b"" for s in parts if isinstance(s, Stream))

    def rect(self, d: dict, key: str) -> tuple[float, float, float, float] | None:
        """A rectangle with an area, its corners in order."""
        v = [as_number(self.resolve(x)) for x in self.array(d, key) or []]
        if len(v) != 4 or None in v or v[0] == v[2] or v[1] == v[3]:
            return None
        return min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])

    def page_box(self, page: dict) -> tuple[float, float, float, float]:
        return self.rect(page, "CropBox") or self.rect(page, "MediaBox") or (0.0, 0.0, 612.0, 792.0)

    def metadata(self) -> dict[str, Any]:
        info = self.dict(self.trailer, "Info") or {}
        keys = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "created": "CreationDate", "modified": "ModDate"}
        found = {k: self.text(info, v) for k, v in keys.items()}
        return found | {"lang": self.text(self.catalog, "Lang"), "version": self.version, "tagged": self.dict(self.catalog, "StructTreeRoot") is not None, "encrypted": self.encrypted}

    def stats(self) -> dict[str, Any]:
        sizes = {"total": 0, "image": 0, "font": 0}
        fonts = {v.num for f in self._all() if isinstance(f, dict) for k, v in f.items() if k in ("FontFile", "FontFile2", "FontFile3") and isinstance(v, Ref)}
        for num in self.entries:
            s = self.resolve(Ref(num, 0))
            if isinstance(s, Stream):
                sizes["total"] += len(s.raw)
                sizes["image"] += len(s.raw) if s.info.get("Subtype") == "Image" else 0
                sizes["font"] += len(s.raw) if num in fonts else 0
        linear = next((v for at, _, packed in sorted(self.entries.values())[:3] if at >= 0 and not packed and isinstance(v := self._at(at + self.head), dict) and "Linearized" in v), None)
        return {
            "file_size": len(self.data), "linearized": linear is not None, "hybrid": self.hybrid, "object_streams": any(e[2] for e in self.entries.values()), "xref_streams": self.xref_streams,
            "binary_size": sizes["total"], "image_size": sizes["image"], "font_size": sizes["font"], "objects": sum(e[0] >= 0 for e in self.entries.values()),
        }

    def _all(self) -> list[Any]:
        return [self.resolve(Ref(num, 0)) for num in self.entries]


def as_number(found: Any) -> float | None:
    return float(found) if isinstance(found, int | float) and not isinstance(found, bool) else None


def as_list(found: Any) -> list:
    return found if isinstance(found, list) else [] if found is None else [found]
