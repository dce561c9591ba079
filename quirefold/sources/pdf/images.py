"""Images of a file: what they are, and their samples as PNG where the codec is known."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from quirefold.functions import codecs
from quirefold.sources.pdf.objects import Store, Stream, as_number
from quirefold.sources.pdf.tokens import Name, Ref

MAX_FORMS, MAX_SAMPLES = 8, 256 << 20
CODECS = {"DCTDecode": "jpeg", "DCT": "jpeg", "CCITTFaxDecode": "ccitt", "CCF": "ccitt", "JBIG2Decode": "jbig2", "JPXDecode": "jpx"}
EXTENSIONS = {"jpeg": "jpg", "raw": "png"}
COMPONENTS = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}


@dataclass
class Image:
    name: str
    page: int
    ref: int | None
    width: int
    height: int
    bits: int = 8
    stencil: bool = False
    codec: str = "raw"
    data: bytes = b""
    family: str = ""
    components: int = 0
    decode: list[float] = field(default_factory=list)
    base: str = ""
    highest: int = 0
    palette: bytes = b""
    mask: Image | None = None
    matte: list[float] = field(default_factory=list)

    @property
    def alpha(self) -> bool:
        return self.mask is not None or self.stencil

    @property
    def premultiplied(self) -> bool:
        return self.mask is not None and bool(self.mask.matte)

    @property
    def recoverable(self) -> bool:
        """Whether colours that were blended with a matte can be had back."""
        if not self.premultiplied:
            return True
        m = self.mask
        return self.codec == m.codec == "raw" and len(m.matte) == self.components and (m.width, m.height) == (self.width, self.height) and self.family not in ("Indexed", "Lab")

    @property
    def extension(self) -> str | None:
        """Of the file it can be written to; None for codecs that can't be."""
        return EXTENSIONS.get(self.codec)


def _numbers(store: Store, info: dict, *keys: str) -> list[float]:
    found = next((a for k in keys if (a := store.array(info, k))), [])
    out = [as_number(store.resolve(x)) for x in found]
    return [] if None in out else out


def _family(found: Any) -> str:
    return str(found) if isinstance(found, Name) else str(found[0]) if isinstance(found, list) and found and isinstance(found[0], Name) else ""


def _colours(store: Store, info: dict, im: Image) -> None:
    if im.stencil:
        im.components = 1
        return
    space = store.get(info, "ColorSpace") or store.get(info, "CS")
    im.family = _family(space)
    im.components = COMPONENTS.get(im.family, 0)
    if not isinstance(space, list):
        return
    part = lambda i: store.resolve(space[i]) if i < len(space) else None
    if im.family == "ICCBased":
        n = store.int(part(1).info, "N") if isinstance(part(1), Stream) else None
        im.components = n if n in (1, 3, 4) else 0
    elif im.family in ("Indexed", "I"):
        im.family = "Indexed"
        if len(space) >= 4:
            im.components, im.base, im.highest = 1, _family(part(1)), int(as_number(part(2)) or 0)
            table = part(3)
            im.palette = table if isinstance(table, bytes) else (store.decoded(table) or b"") if isinstance(table, Stream) else b""
    elif im.family == "DeviceN":
        im.components = len(part(1)) if isinstance(part(1), list) else 0
    elif im.family in ("Separation", "CalRGB", "Lab"):
        im.components = 1 if im.family == "Separation" else 3


def _image(store: Store, s: Stream, name: str, page: int, ref: int | None) -> Image | None:
    info = s.info
    w, h = (next((v for k in keys if (v := store.int(info, k)) is not None), 0) for keys in (("Width", "W"), ("Height", "H")))
    if w <= 0 or h <= 0 or w * h > MAX_SAMPLES:
        return None
    im = Image(name, page, ref, w, h)
    im.stencil = any(store.bool(info, k) for k in ("ImageMask", "IM"))
    bits = next((v for k in ("BitsPerComponent", "BPC") if (v := store.int(info, k)) is not None), 8)
    im.bits = 1 if im.stencil else bits if bits in (1, 2, 4, 8, 16) else 8
    im.decode = _numbers(store, info, "Decode", "D")
    _colours(store, info, im)
    im.codec = next((CODECS[f] for f in store.filters(s) if f in CODECS), "raw")
    try:
        im.data, _ = store.opened(s)
    except (ValueError, TypeError):
        im.data = b""
    mask = store.stream(info, "SMask")
    if mask is not None and (m := _image(store, mask, name + ".smask", page, None)) is not None:
        m.matte, im.mask = _numbers(store, mask.info, "Matte"), m
    return im


def images(store: Store) -> list[Image]:
    """The images of all pages and the forms on them, in order of page and name; one that several refer to counts once."""
    out: list[Image] = []
    seen: set[int] = set()

    def walk(resources: dict | None, page: int, depth: int) -> None:
        found = store.dict(resources, "XObject") or {}
        for name in sorted(found):
            raw = found[name]
            if isinstance(raw, Ref):
                if raw.num in seen:
                    continue
                seen.add(raw.num)
            s = store.resolve(raw)
            kind = store.name(s.info, "Subtype") if isinstance(s, Stream) else None
            if kind == "Image":
                im = _image(store, s, str(name), page, raw.num if isinstance(raw, Ref) else None)
                if im is not None:
                    out.append(im)
            elif kind == "Form" and depth + 1 < MAX_FORMS:
                walk(store.dict(s.info, "Resources") or resources, page, depth + 1)

    for number, page in enumerate(store.pages, 1):
        walk(store.dict(page, "Resources"), number, 0)
    return out


# samples


def unpacked(data: bytes, bits: int, columns: int, rows: int) -> tuple[np.ndarray, int]:
    """Values of a number of bits, most significant first, each row from a whole byte on; and how many whole values there are before the data ends."""
    stride = (columns * bits + 7) // 8
    have = min(len(data), stride * rows)
    raw = np.zeros(stride * rows, np.uint8)
    raw[:have] = np.frombuffer(data, np.uint8, have)
    raw = raw.reshape(rows, stride)
    if bits == 8:
        out = raw.astype(np.uint32)
    elif bits == 16:
        out = raw.reshape(rows, -1, 2).astype(np.uint32) @ np.array([256, 1], np.uint32)
    else:
        flat = np.unpackbits(raw, axis=1)[:, : columns * bits].reshape(rows, columns, bits)
        out = flat.astype(np.uint32) @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint32)
    whole, rest = divmod(have, stride) if stride else (rows, 0)
    return out, min(whole * columns + min(rest * 8 // bits, columns), rows * columns)


def clamp8(v: np.ndarray) -> np.ndarray:
    """From 0..1 to 0..255, half up."""
    return np.floor(np.clip(v, 0, 1) * 255 + 0.5).astype(np.uint8)


def cmyk_to_rgb(c: np.ndarray) -> np.ndarray:
    return (1 - c[..., :3]) * (1 - c[..., 3:4])


def lab_to_rgb(c: np.ndarray) -> np.ndarray:
    fy = (c[..., 0] * 100 + 16) / 116
    f = np.stack([fy + (c[..., 1] * 255 - 128) / 500, fy, fy - (c[..., 2] * 255 - 128) / 200], -1)
    edge = 6 / 29
    xyz = np.where(f > edge, f**3, 3 * edge**2 * (f - 4 / 29)) * np.array([0.9642, 1.0, 0.8249])
    linear = xyz @ np.array([[3.1339, -0.9785, 0.0720], [-1.6170, 1.9160, -0.2290], [-0.4906, 0.0333, 1.4057]])
    linear = np.clip(linear, 0, 1)
    return np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)


def unblended(c: np.ndarray, matte: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Colours before they were blended with a matte."""
    a = alpha[..., None]
    free = np.clip(matte + (c - matte) / np.where(a > 0, a, 1), 0, 1)
    return np.where(a >= 1, c, np.where(a > 0, free, matte))


def _alpha(im: Image) -> np.ndarray:
    """The mask at the size of the image, by the nearest sample; where its data ends, all is opaque."""
    m = im.mask
    if m is None or m.codec != "raw":
        return np.full((im.height, im.width), 255, np.uint8)
    v, have = unpacked(m.data, m.bits, m.width, m.height)
    f = v / ((1 << m.bits) - 1)
    if len(m.decode) == 2:
        f = m.decode[0] + f * (m.decode[1] - m.decode[0])
    a = clamp8(f)
    a.reshape(-1)[have:] = 255
    return a[np.arange(im.height) * m.height // im.height][:, np.arange(im.width) * m.width // im.width]


def _palette(im: Image, c: np.ndarray) -> np.ndarray:
    n = COMPONENTS.get(im.base, 3)
    at = np.clip(np.floor(c[..., 0] * ((1 << im.bits) - 1) + 0.5).astype(np.int64), 0, max(im.highest, 0))
    table = np.zeros(((im.highest + 1) * n,), np.uint8)
    have = min(len(im.palette) // n * n, len(table))
    table[:have] = np.frombuffer(im.palette, np.uint8, have)
    found = table.reshape(-1, n)[at]
    if n == 4:
        return clamp8(cmyk_to_rgb(found / 255)) * (at < have // n)[..., None]
    return np.repeat(found, 3, -1) if n == 1 else found


def pixels(im: Image) -> np.ndarray:
    """Height x width x RGBA; samples that the data lacks are transparent."""
    if im.stencil:
        v, have = unpacked(im.data, 1, im.width, im.height)
        out = np.zeros((im.height, im.width, 4), np.uint8)
        out[..., 3] = np.where(v == (1 if im.decode[:1] == [1] and len(im.decode) > 1 else 0), 255, 0)
        out.reshape(-1, 4)[have:] = 0
        return out
    if not im.components:
        raise ValueError(f"{im.family or 'no colour space'}: samples of unknown number")
    n = im.components
    v, have = unpacked(im.data, im.bits, im.width * n, im.height)
    c = (v / ((1 << im.bits) - 1)).reshape(im.height, im.width, n)
    if len(im.decode) == 2 * n:
        low, high = np.array(im.decode[::2]), np.array(im.decode[1::2])
        c = low + c * (high - low)
    alpha = _alpha(im)
    if im.premultiplied and im.recoverable:
        c = unblended(c, np.array(im.mask.matte), alpha / 255)
    if im.family == "Indexed" and im.palette:
        rgb = _palette(im, c)
    elif n == 1:
        rgb = np.repeat(clamp8(c), 3, -1)
    elif n == 3:
        rgb = clamp8(lab_to_rgb(c) if im.family == "Lab" else c)
    elif n == 4:
        rgb = clamp8(cmyk_to_rgb(c))
    else:
        rgb = np.repeat(clamp8(1 - c[..., :1]), 3, -1)
    out = np.concatenate([rgb, alpha[..., None]], -1)
    out.reshape(-1, 4)[have // n :] = 0
    return out


def png(rgba: np.ndarray) -> bytes:
    """A PNG file of 8-bit RGBA."""
    h, w = rgba.shape[:2]
    rows = np.zeros((h, 1 + 4 * w), np.uint8)
    rows[:, 1:] = rgba.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def encoded(im: Image) -> bytes | None:
    """The image as a file: JPEG as it is, raw samples as PNG; None for other codecs and for samples of unknown number."""
    if im.codec == "jpeg":
        return im.data
    try:
        return png(pixels(im)) if im.codec == "raw" else None
    except ValueError:
        return None


def file_name(number: int, total: int, page: int, extension: str, mask: bool = False) -> str:
    return f"img-{number:0{len(str(total))}d}-p{page}{'-mask' if mask else ''}.{extension}"


def is_image_filter(name: str) -> bool:
    return name in codecs.IMAGE_FILTERS
