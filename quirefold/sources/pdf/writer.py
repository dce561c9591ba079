"""A small writer of PDF files, for fixtures and for queries over derived documents."""

from __future__ import annotations

import zlib
from functools import lru_cache
from typing import Any

from quirefold.sources.pdf.objects import Stream
from quirefold.sources.pdf.tokens import Name, Ref


def literal(text: str | bytes) -> bytes:
    """A literal string; characters outside Latin-1 become question marks."""
    raw = text.encode("cp1252", "replace") if isinstance(text, str) else text
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


@lru_cache(4096)
def _name(v: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c < 127 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in v.encode("utf-8", "surrogateescape"))


def dump(v: Any) -> bytes:
    if isinstance(v, bool) or v is None:
        return {True: b"true", False: b"false", None: b"null"}[v]
    if isinstance(v, Name):
        return _name(v)
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(v, bytes | str):
        return literal(v)
    if isinstance(v, list | tuple):
        return b"[" + b" ".join(map(dump, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b"".join(_name(k) + b" " + dump(x) for k, x in v.items()) + b">>"
    raise TypeError(type(v).__name__)


class Writer:
    """Collects objects, numbered from 1, and lays them out with a table, or in object streams with a reference stream."""

    def __init__(self) -> None:
        self.objects: list[Any] = []

    def add(self, value: Any = None) -> Ref:
        self.objects.append(value)
        return Ref(len(self.objects), 0)

    def put(self, ref: Ref, value: Any) -> Ref:
        self.objects[ref.num - 1] = value
        return ref

    def stream(self, data: bytes, info: dict | None = None, packed: bool = False) -> Ref:
        info = dict(info or {})
        if packed:
            data, info["Filter"] = zlib.compress(data, 1), Name("FlateDecode")
        return self.add(Stream(info | {"Length": len(data)}, data))

    def _body(self, v: Any) -> bytes:
        return dump(v.info) + b"\nstream\n" + v.raw + b"\nendstream" if isinstance(v, Stream) else dump(v)

    def finish(self, trailer: dict, version: str = "1.7", compact: bool = False) -> bytes:
        out = bytearray(b"%PDF-" + version.encode() + b"\n%\xe2\xe3\xcf\xd3\n")
        places: dict[int, tuple[int, int, int]] = {}
        inside = [(i, v) for i, v in enumerate(self.objects, 1) if not isinstance(v, Stream)] if compact else []
        if inside:
            bodies = [dump(v) for _, v in inside]
            ends = [0]
            for b in bodies:
                ends.append(ends[-1] + len(b) + 1)
            head = b" ".join(b"%d %d" % (num, at) for (num, _), at in zip(inside, ends, strict=False)) + b" "
            holder = self.stream(head + b" ".join(bodies), {"Type": Name("ObjStm"), "N": len(inside), "First": len(head)}, packed=True)
            places |= {num: (2, holder.num, i) for i, (num, _) in enumerate(inside)}
        for num, v in enumerate(self.objects, 1):
            if num not in places:
                places[num] = (1, len(out), 0)
                out += b"%d 0 obj\n" % num + self._body(v) + b"\nendobj\n"
        start, size = len(out), len(self.objects) + 1
        if not compact:
            out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % places[n][1] for n in range(1, size))
            out += b"trailer\n" + dump(trailer | {"Size": size})
        else:
            places[size] = (1, start, 0)
            rows = b"\0" * 7 + b"".join(bytes([k]) + a.to_bytes(4) + b.to_bytes(2) for k, a, b in (places[n] for n in range(1, size + 1)))
            data = zlib.compress(rows)
            info = trailer | {"Type": Name("XRef"), "Size": size + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode"), "Length": len(data)}
            out += b"%d 0 obj\n" % size + self._body(Stream(info, data)) + b"\nendobj"
        return bytes(out + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def font(base: str = "Helvetica", **more: Any) -> dict:
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(base), "Encoding": Name("WinAnsiEncoding")} | more


def document(pages: list[bytes], fonts: dict[str, dict] | None = None, info: dict | None = None, compact: bool = False, packed: bool = False, catalog: dict | None = None, page: dict | None = None) -> bytes:
    """A file of pages with these content streams; fonts and the media box are inherited from the page tree's root."""
    w = Writer()
    root, tree = w.add(), w.add()
    resources = {"Font": {k: w.add(v) for k, v in (fonts or {"F1": font()}).items()}}
    kids = [w.add({"Type": Name("Page"), "Parent": tree, "Contents": w.stream(p, packed=packed)} | (page or {})) for p in pages]
    w.put(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 612, 792], "Resources": resources})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree} | (catalog or {}))
    trailer = {"Root": root} | ({"Info": w.add(info)} if info else {})
    return w.finish(trailer, compact=compact)


def text_pages(lines: list[str], size: int = 11, lead: int = 14, per_page: int = 50) -> list[bytes]:
    """Content streams that show lines one below the other."""
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    return [b"BT /F1 %d Tf %d TL 72 740 Td " % (size, lead) + b" ".join(literal(t) + b" Tj T*" for t in p) + b" ET" for p in pages]
