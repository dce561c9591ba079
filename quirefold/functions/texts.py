"""Text rules that scan character by character, as Arrow columns; what regular expressions can say is in scalars."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.document import bundle, markdown
from quirefold.sources.pdf import cmaps
from quirefold.sources.pdf.encodings import glyph_text as _glyph_text
from quirefold.sources.pdf.encodings import text_string as _text_string


def _text(fn: Callable, kind: str = "string") -> Callable[..., Column]:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fn(v))

    return run


def escape(c: Column, at_start: bool = False) -> Column:
    """A text as Markdown that reads back as it is."""
    return _text(lambda t: markdown.escape(t, at_start))(c)


def link_label(c: Column) -> Column:
    return _text(markdown.link_label)(c)


def code_span(c: Column) -> Column:
    """A text as inline code, between more backticks than it has in a row."""
    return _text(lambda t: markdown._code(t, False))(c)


def glyph_text(c: Column) -> Column:
    """The text that a glyph name stands for; null for none."""
    return _text(_glyph_text)(c)


def text_string(c: Column) -> Column:
    """The text of the bytes of a text string."""
    return _text(lambda b: _text_string(bytes(b)))(c)


#: CMaps of programs that came before: columns have few different ones. Only short ones, and so many at most.
_CMAPS: dict[bytes, cmaps.CMap] = {}
MAX_CMAPS, MAX_PROGRAM, MAX_KNOWN = 256, 4096, 1024


def _cmap(program: bytes) -> cmaps.CMap:
    found = _CMAPS.get(program)
    if found is None:
        found = cmaps.parse(program)
        if len(program) <= MAX_PROGRAM and len(found.texts) + len(found.cids) <= MAX_KNOWN:
            if len(_CMAPS) >= MAX_CMAPS:
                _CMAPS.clear()
            _CMAPS[program] = found
    return found


def cmap_texts(c: Column) -> Column:
    """Code and text of each entry of a CMap program, by code."""

    @F.arrow_udf("array<struct<code: long, text: string>>")
    def run(programs: pa.Array) -> pa.Array:
        codes, texts, ends = [], [], []
        for p in programs.to_pylist():
            ends.append(None if p is None else len(codes))
            for code, text in sorted(_cmap(p).texts.items()) if p is not None else ():
                codes.append(code)
                texts.append(text)
        return pa.ListArray.from_arrays(pa.array([*ends, len(codes)], pa.int32()), pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(texts, pa.string())], ["code", "text"]))

    return run(c)


def cmap_cids(program: Column, data: Column) -> Column:
    """The character ids of a string's codes by a CMap program; codes without one are their own."""

    def one(p: bytes | None, s: bytes | None) -> list[int] | None:
        if p is None or s is None:
            return None
        cm = _cmap(p)
        return [code if (cid := cm.cid(code)) is None else cid for code, _ in cm.codes(s)]

    @F.arrow_udf("array<long>")
    def run(programs: pa.Array, strings: pa.Array) -> pa.Array:
        return pa.array([one(p, s) for p, s in zip(programs.to_pylist(), strings.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return run(program, data)


def linked(c: Column, paths: Column, own: Column) -> Column:
    """Text and number of links: references to clauses become links to the paths of a map, but to the text's own."""

    @F.pandas_udf("text string, links int")
    def run(texts: pd.Series, maps: pd.Series, owns: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else bundle.link(t, dict(m or {}), o or "") for t, m, o in zip(texts, maps, owns, strict=True)]
        return pd.DataFrame(rows, columns=["text", "links"])

    return run(c, paths, own)
