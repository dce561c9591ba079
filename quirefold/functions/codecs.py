"""Byte filters of page-description files: binary to binary, one Arrow batch at a time."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT, SHORT_ROW, PART_BYTES = 512 << 20, 128, 1 << 20
IMAGE_FILTERS = {"DCTDecode", "DCT", "CCITTFaxDecode", "CCF", "JBIG2Decode", "JPXDecode"}
SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode"}
_SPACE = b" \t\r\n\x0c\x00"


def _inflate(data: bytes, wbits: int) -> tuple[bytes, bool]:
    """What comes out before the end or the first damage, and whether that was all in order."""
    d, parts, size = zlib.decompressobj(wbits), [], 0
    for at in range(0, len(data), 4096):
        try:
            parts.append(d.decompress(data[at : at + 4096], LIMIT - size + 1))
        except zlib.error:
            again = zlib.decompressobj(wbits)
            parts = [again.decompress(data[:at])]
            try:
                for i in range(at, at + 4096):  # the damage lies in this block: its beginning may still give something
                    parts.append(again.decompress(data[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(parts), False
        size += len(parts[-1]) if parts else 0
        if size > LIMIT:
            raise ValueError("too much data")
        if d.eof:
            break
    return b"".join(parts), True


def _empty_deflate(data: bytes) -> bool:
    """Whether this is raw deflate of nothing."""
    d = zlib.decompressobj(-15)
    try:
        return not d.decompress(data) and d.eof and not d.unused_data.strip(_SPACE)
    except zlib.error:
        return False


def flate(data: bytes, params: dict | None = None) -> bytes:
    """zlib, then raw deflate, then zlib behind leading junk; what came out before damage is kept."""
    best = b""
    for wbits, start in [(15, 0), (-15, 0), *((15, i) for i in range(1, min(len(data), 8)) if data[i] == 0x78)]:
        out, whole = _inflate(data[start:], wbits)
        if whole and out:
            return predict(out, params)
        best = best or out
    if best:
        return predict(best, params)
    if data.strip(_SPACE) and not _inflate(data, 15)[1] and not _empty_deflate(data):
        raise ValueError("not deflate data")
    return b""


_NOT_HEX = bytes(c for c in range(256) if c not in b"0123456789abcdefABCDEF")


def ascii_hex(data: bytes, params: dict | None = None) -> bytes:
    digits = data.partition(b">")[0].translate(None, _NOT_HEX)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


_BASE85 = re.compile(rb"[!-u]*")


def ascii85(data: bytes, params: dict | None = None) -> bytes:
    data = data.strip(_SPACE)
    body = (data[2:] if data[:2] == b"<~" else data).partition(b"~")[0].translate(None, _SPACE)
    parts = body.split(b"z")  # a z stands between groups, for four zeros
    if any(not _BASE85.fullmatch(p) for p in parts) or any(len(p) % 5 for p in parts[:-1]):
        raise ValueError("a character that base 85 lacks")
    return bytes(4).join(map(_groups85, parts))


def _groups85(digits: bytes) -> bytes:
    left = len(digits) % 5
    if left == 1:
        raise ValueError("one digit is left over")
    groups = np.frombuffer(digits + b"u" * (-len(digits) % 5), np.uint8).reshape(-1, 5).astype(np.uint64) - np.uint64(33)
    values = groups @ np.array([85**4, 85**3, 85**2, 85, 1], np.uint64)
    if (values >> np.uint64(32)).any():
        raise ValueError("a group is too large")
    out = values.astype(">u4").tobytes()
    return out[: len(out) - (5 - left if left else 0)]


def run_length(data: bytes, params: dict | None = None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def lzw(data: bytes, params: dict | None = None) -> bytes:
    early = int((params or {}).get("EarlyChange", 1))
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    out, at, end = [], 0, 8 * len(data)
    raw = np.frombuffer(data + bytes(3), np.uint8).astype(np.uint32)
    while True:  # from one clear code to the next
        table, prior, read = base.copy(), b"", 0
        for width in chain((9, 10, 11), repeat(12)):
            # the table grows by a code from the second on, so it is known beforehand how many codes have a width
            most = max((1 << width) - early - 257, width == 9) - read if width < 12 else 4096
            most = min(most, (end - at) // width)
            if most <= 0:
                if end - at < width:
                    return predict(b"".join(out), params)
                continue
            begin = at + width * np.arange(most)
            first = begin >> 3
            codes = (((raw[first] << 16 | raw[first + 1] << 8 | raw[first + 2]) >> (24 - width - (begin & 7)).astype(np.uint32)) & ((1 << width) - 1)).tolist()
            stop = False
            for code in codes:
                at, read = at + width, read + 1
                if code < len(table):
                    if 256 <= code <= 257:
                        stop = True
                        break
                    entry = table[code]
                elif code == len(table) and prior:
                    entry = prior + prior[:1]
                else:
                    raise ValueError("a code before it is defined")
                out.append(entry)
                if prior and len(table) < 4096:
                    table.append(prior + entry[:1])
                prior = entry
            if stop:
                if code == 257:
                    return predict(b"".join(out), params)
                break


def predict(data: bytes, params: dict | None) -> bytes:
    """Undoes the PNG predictors and TIFF's (8 bits a component); rows at a time, bytes in order only where a row needs it."""
    p = params or {}
    kind, colors, bits, columns = (int(p.get(k, d)) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind < 2 or not data:
        return data
    if not (0 < colors <= 32 and 0 < bits <= 32 and 0 < columns <= 1 << 24) or (colors * bits * columns + 7) // 8 >= LIMIT:
        raise ValueError("a predictor of an impossible shape")
    bpp, row = max(1, (colors * bits + 7) // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8:
            raise ValueError("a TIFF predictor of other than 8 bits")
        whole = len(data) // row * row
        rows = np.frombuffer(data, np.uint8, whole).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[whole:]
    count = -(-len(data) // (row + 1))
    rows = np.zeros((count, row + 1), np.uint8)
    rows.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    how, out = rows[:, 0], rows[:, 1:]
    if how.max() > 4:
        raise ValueError("an unknown PNG filter")
    if row < SHORT_ROW:
        return _short_rows(how.tolist(), out, bpp)
    above = np.zeros(row, np.uint8)
    at = 0
    while at < count:
        end = at + 1
        while end < count and how[end] == how[at]:
            end += 1
        some = out[at:end]
        if how[at] == 1:  # each byte adds the one bpp before it
            wide = np.zeros((len(some), -(-row // bpp) * bpp), np.uint8)
            wide[:, :row] = some
            some[:] = np.cumsum(wide.reshape(len(some), -1, bpp), axis=1, dtype=np.uint8).reshape(len(some), -1)[:, :row]
        elif how[at] == 2:
            some[0] += above
            np.cumsum(some, axis=0, dtype=np.uint8, out=some)
        elif how[at] > 2:
            up = above.tolist()
            for line in some:
                up = _sequential(line.tolist(), up, bpp, how[at] == 4)
                line[:] = up
        above, at = out[end - 1], end
    return out.tobytes()


def _short_rows(how: list[int], rows: np.ndarray, bpp: int) -> bytes:
    """Rows of so few bytes that setting up an array operation for each would take longer than the bytes do."""
    parts, up = [], [0] * rows.shape[1]
    for kind, line in zip(how, rows.tolist(), strict=True):
        if kind == 1:
            for k in range(bpp):
                line[k::bpp] = [v & 255 for v in accumulate(line[k::bpp])]
        elif kind == 2:
            line = [(v + b) & 255 for v, b in zip(line, up, strict=True)]
        elif kind > 2:
            _sequential(line, up, bpp, kind == 4)
        parts.append(bytes(line))
        up = line
    return b"".join(parts)


def _sequential(line: list[int], up: list[int], bpp: int, paeth: bool) -> list[int]:
    for k in range(bpp):
        a = c = 0
        for i in range(k, len(line), bpp):
            b = up[i]
            if paeth:
                x, y = b - c, a - c
                z = abs(x + y)
                x, y = abs(x), abs(y)
                add = a if x <= y and x <= z else b if y <= z else c
            else:
                add = (a + b) >> 1
            a = line[i] = (line[i] + add) & 255
            c = b
    return line


def is_image(name: str) -> bool:
    return name in IMAGE_FILTERS


DECODERS: dict[str, Callable[[bytes, dict | None], bytes]] = {"FlateDecode": flate, "LZWDecode": lzw, "ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length, "Crypt": lambda d, _: d}


def decode(name: str, data: bytes, params: dict | None = None) -> bytes:
    full = SHORT.get(name, name)
    if full not in DECODERS:
        raise ValueError(f"unknown filter {name}")
    return DECODERS[full](data, params)


def decode_chain(filters: list[str], data: bytes, params: list[dict | None] | None = None) -> tuple[bytes, list[str]]:
    """The data, and the filters left from the first one for images on."""
    for i, name in enumerate(filters):
        if name in IMAGE_FILTERS:
            return data, filters[i:]
        data = decode(name, data, params[i] if params else None)
    return data, []


def _decoded(name: str, data: bytes | None, params: dict) -> bytes | None:
    try:
        return None if data is None else decode(name, bytes(data), params)
    except ValueError:
        return None


def _by_rows(fn: Callable[..., bytes | None], *columns: pa.Array) -> pa.Array:
    """fn on the values of each row; only so many rows at a time are Python objects."""
    parts, at, rows = [], 0, len(columns[0])
    while at < rows:
        size = sum(c.slice(at, 1024).nbytes for c in columns) // min(1024, rows - at)
        many = max(1, min(1024, PART_BYTES // max(size, 1)))
        parts.append(pa.array([fn(*row) for row in zip(*(c.slice(at, many).to_pylist() for c in columns), strict=True)], pa.binary()))
        at += many
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def decoded(filter_name: str, data: Column, **params: int) -> Column:
    """The filter as a column; damaged data becomes null."""

    @F.arrow_udf("binary")
    def run(s: pa.Array) -> pa.Array:
        return _by_rows(lambda b: _decoded(filter_name, b, params), s)

    return run(data)


def decoded_each(names: Column, data: Column, params: Column) -> Column:
    """The filter that each row names, with the row's parameters (a map, or null); damaged data becomes null."""

    @F.arrow_udf("binary")
    def run(filters: pa.Array, s: pa.Array, maps: pa.Array) -> pa.Array:
        return _by_rows(lambda f, b, m: _decoded(f, b, dict(m or ())), filters, s, maps)

    return run(names, data, params)
