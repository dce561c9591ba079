"""Tokens of PDF syntax, and the operators of a content stream with their operands. Nothing here raises on damaged input."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple

MAX_OPERANDS, MAX_NESTING = 512, 64
SPACE, DELIMITER = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"


class Name(str):
    """A name object; a plain str never stands for one."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Token(NamedTuple):
    """kind: object, operator, or one of [ ] << >>; end of input gives kind None."""

    kind: str | None
    value: Any


_REGULAR = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
_SKIPPED = rb"(?:[\x00\t\n\x0c\r {}]|%[^\r\n]*+|>(?!>))*+(?:"
_TOKENS = (
    rb"(?P<number>[-+.0-9]+)|/(?P<name>" + _REGULAR + rb"*)|(?P<open>\[)|(?P<close>\])|(?P<dict><<)|(?P<end>>>)"
    rb"|\((?P<plain>[^()\\\r]*+)\)|(?P<string>\()|<(?P<hex>[^>]*)>?|(?P<word>" + _REGULAR + rb"+)|(?P<other>[^\x00\t\n\x0c\r >{}%]))"
)
_NEXT = re.compile(_SKIPPED + _TOKENS)
#: In objects three tokens may be a reference.
_NEXT_OR_REF = re.compile(_SKIPPED + rb"(?P<ref>(?P<num>\d++)[\x00\t\n\x0c\r ]++(?P<gen>\d++)[\x00\t\n\x0c\r ]++R(?!" + _REGULAR + rb"))|" + _TOKENS)
_STRING = re.compile(rb"[()\\\r]")
_HEX = re.compile(rb"[^0-9A-Fa-f]+")
_ESCAPED = re.compile(rb"#([0-9A-Fa-f]{2})")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_ESCAPES = {ord(k): v for k, v in {"n": b"\n", "r": b"\r", "t": b"\t", "b": b"\b", "f": b"\f"}.items()}
_WORDS = {b"true": True, b"false": False, b"null": None}
_BRACKETS = {"open": "[", "close": "]", "dict": "<<", "end": ">>"}
_INT64 = 1 << 63


def number(raw: bytes) -> int | float:
    """An integer or a real; of a run that is neither, what can be saved: its sign, and digits up to the next sign or second dot."""
    real = b"." in raw
    try:
        return float(raw) if real else max(-_INT64, min(_INT64 - 1, int(raw)))
    except ValueError:
        pass
    sign = -1 if raw[:1] == b"-" else 1
    body = re.match(rb"[-+]*(\.?)[-+]*([0-9]*)(?:(\.)([0-9]*))?", raw)
    lead, whole, dot, rest = (g or b"" for g in body.groups())
    digits = lead + whole + (b"" if lead else dot + rest)
    if not digits.strip(b"."):
        return 0
    return sign * (float(digits) if real and b"." in digits else float(digits) if real else int(digits))


def _object(kind: str, raw: bytes) -> Any:
    """The object that is a token of its own."""
    if kind == "number":
        return int(raw) if raw.isdigit() and len(raw) < 18 else number(raw)
    if kind == "plain":
        return raw
    if kind == "name":
        raw = _ESCAPED.sub(lambda x: bytes([int(x[1], 16)]), raw) if b"#" in raw else raw
        return Name(raw.decode("utf-8", "surrogateescape"))
    if kind == "word":
        return _WORDS[raw]
    digits = _HEX.sub(b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def next(self) -> Token:
        return Token(*self.scan())

    def scan(self, pattern: re.Pattern = _NEXT) -> tuple[str | None, Any]:
        """Kind and value of the next token."""
        m = pattern.match(self.data, self.at)
        if not m:
            self.at = len(self.data)
            return None, None
        kind, self.at = m.lastgroup, m.end()
        raw = m[m.lastindex]
        if kind == "ref":
            return "object", Ref(min(int(m["num"]), _INT64 - 1), int(m["gen"]))
        if kind == "string":
            return "object", self._string()
        if kind == "other" or (kind == "word" and raw not in _WORDS):
            return "operator", raw.decode("latin-1")
        return (_BRACKETS[kind], None) if kind in _BRACKETS else ("object", _object(kind, raw))

    def _string(self) -> bytes:
        """The literal string whose first parenthesis was just read; one that never ends goes to the end of the data."""
        data, out, depth = self.data, [], 1
        while True:
            m = _STRING.search(data, self.at)
            if not m:
                out.append(data[self.at :])
                self.at = len(data)
                break
            out.append(data[self.at : m.start()])
            self.at, c = m.end(), m[0]
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    break
            elif c == b"\r":
                self.at += data[self.at : self.at + 1] == b"\n"
                c = b"\n"
            else:
                c = self._escape()
            out.append(c)
        return b"".join(out)

    def _escape(self) -> bytes:
        data = self.data
        if m := _OCTAL.match(data, self.at):
            self.at = m.end()
            return bytes([int(m[0], 8) & 255])
        e = data[self.at : self.at + 1]
        self.at += 1
        if e == b"\r":
            self.at += data[self.at : self.at + 1] == b"\n"
        return b"" if e in (b"\r", b"\n", b"") else _ESCAPES.get(e[0], e)


def _closed(kind: str, items: list) -> Any:
    """An array, or a dictionary of the pairs that start with a name."""
    if kind == "[":
        return items
    return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}


class Builder:
    """Operands as they come in; arrays and dictionaries close whatever bracket ends them."""

    def __init__(self) -> None:
        self.operands: list[Any] = []
        self.open: list[tuple[str, list]] = []

    def push(self, value: Any) -> None:
        if self.open:
            if len(self.open[-1][1]) < MAX_OPERANDS:
                self.open[-1][1].append(value)
            return
        if len(self.operands) >= MAX_OPERANDS:
            del self.operands[0]
        self.operands.append(value)

    def take(self, token: Token) -> None:
        if token.kind == "object":
            self.push(token.value)
        elif token.kind in ("[", "<<"):
            if len(self.open) < MAX_NESTING:
                self.open.append((token.kind, []))
        elif token.kind in ("]", ">>"):
            self.close()

    def close(self) -> None:
        if self.open:
            kind, items = self.open.pop()
            self.push(_closed(kind, items))


class Op(NamedTuple):
    name: str
    operands: list[Any]
    inline: bytes | None = None

    def num(self, i: int) -> float:
        v = self.operands[i] if i < len(self.operands) else 0
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else 0.0

    def of(self, i: int, kind: type) -> Any:
        v = self.operands[i] if i < len(self.operands) else None
        return v if isinstance(v, kind) else None


_END_IMAGE = re.compile(rb"(?<=[\x00\t\n\x0c\r ])EI(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$)")


def _inline_image(lex: Lexer) -> Op | None:
    """The dictionary between BI and ID, and the data up to an EI that stands between white space."""
    found, key = {}, None
    while True:
        token = lex.next()
        if token.kind is None:
            return None
        if token.kind == "operator":
            if token.value == "ID":
                break
            continue
        if token.kind == "object":
            value = token.value
        elif token.kind in ("[", "<<"):
            parts = Builder()
            parts.take(token)
            while parts.open:
                token = lex.next()
                if token.kind is None:
                    return None
                parts.take(token)
            value = parts.operands[-1]
        else:
            continue
        if key is None:
            key = value if isinstance(value, Name) else None
        else:
            found[key], key = value, None
    start = lex.at + (lex.data[lex.at : lex.at + 1] in (bytes([c]) for c in SPACE))
    m = _END_IMAGE.search(lex.data, start + 1)
    lex.at = m.end() if m else len(lex.data)
    return Op("INLINE_IMAGE", [found], lex.data[start : m.start() - 1] if m else lex.data[start:])


def operators(data: bytes) -> Iterator[Op]:
    """The operators of a content stream; open brackets end where an operator begins."""
    lex, parts = Lexer(data), Builder()
    inner, following = parts.open, _NEXT.scanner(data).match
    while m := following():
        kind, raw = m.lastgroup, m[m.lastindex]
        if kind == "other" or (kind == "word" and raw not in _WORDS):
            while inner:
                parts.close()
            if raw != b"BI":
                yield Op(raw.decode("latin-1"), parts.operands)
            else:
                lex.at = m.end()
                if op := _inline_image(lex):
                    yield op
                following = _NEXT.scanner(data, lex.at).match
            parts.operands = []
            continue
        if kind in _BRACKETS:
            parts.take(Token(_BRACKETS[kind], None))
            continue
        if kind == "string":
            lex.at = m.end()
            found = lex._string()
            following = _NEXT.scanner(data, lex.at).match
        else:
            found = _object(kind, raw)
        if inner or len(parts.operands) >= MAX_OPERANDS:
            parts.push(found)
        else:
            parts.operands.append(found)
