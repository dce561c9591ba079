"""PII: entities in a text are replaced by keyed surrogates of the same type, script and format.

E-mail addresses, phone and card numbers, IBANs, IPv4 addresses, social security numbers, keys and passwords, and personal
names. A name is a title with the capitalised words behind it, a known given name with a capitalised word, or two capitalised
words behind a cue ("my name is", "contact", "Dear"), and what a conjunction adds to one of these. Every other mention of a
part of a name in the same text (alone, possessive, in capitals) gets the surrogate of that part.

Every surrogate comes from a keyed cycle through the finite set of values that share the entity's format: x becomes
P'(P(x) + 1), where P is a keyed permutation and P' its inverse. The step never gives x itself, can't map two values to one, and
needs no table, so distinct entities stay distinct over any number of machines and every mention of one gets the same
surrogate. Digits stay digits, case and script stay, given names map among those of the same gender and script, private networks
stay private. The collision checks take further steps until the result is allowed (a surname that no list has stays off the
lists, and so on); as the steps run through all values, they end, and only a value that is alone in its set stays as it is.

Sixteen digits that start with 3 to 6, and 13 to 19 digits with a right Luhn sum, are cards, right or wrong as before in the
surrogate; other such digits, and IBANs with a wrong sum, are no entities and stay.

The key is the session's spark.quirefold.pii.key; without it a random one is made for the session, so that nobody can invert
the surrogates. Set it to get the same surrogates in every run.

Defined results: a null text stays null, an empty one stays empty; repeated rows get equal results; other columns pass
through, n_chars (if there is one) is the new length of a text that changed; an empty table stays empty. Only text is read.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import map_batches

KEY_CONF = "spark.quirefold.pii.key"
GIVEN = {
    "f": "Mary Anna Emma Laura Sarah Julia Sophie Linda Susan Karen Lisa Nancy Helen Sandra Donna Carol Ruth Alice Grace Claire Marie Camille Juliette Chloé Élodie Aurélie Hélène Isabelle Ingrid Heike Sabine Petra Greta Ursula Carmen Lucía Sofía Elena Isabel Pilar Rosario Marta Patricia Jennifer Elizabeth Barbara Jessica".split(),
    "m": "John James Robert Michael William David Richard Thomas Charles Daniel Matthew Mark Paul Steven Andrew Kevin Brian George Edward Peter Henry Jean Pierre Luc Antoine François Benoît Étienne Olivier Hans Klaus Jürgen Günther Stefan Wolfgang Dieter Carlos Miguel José Javier Diego Pablo Andrés Luis Alejandro Joseph Christopher Anthony".split(),
    "f-cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    "m-cyrillic": "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел".split(),
    "f-greek": "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα".split(),
    "m-greek": "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(),
}
SURNAMES = {
    "latin": "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Walker Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Dubois Durand Lefèvre Moreau Laurent Simon Michel García Fernández González Rodríguez López Martínez Sánchez Pérez".split(),
    "cyrillic": "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Петров".split(),
    "greek": "Παπαδόπουλος Οικονόμου Γεωργίου Νικολάου Δημητρίου".split(),
}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Mme", "Mlle", "Monsieur", "Madame", "Señor", "Señora", "Sra"]
NOUN_TITLES = ["Herr", "Frau"]  # in German a noun behind the name has a capital too: only one word, or a known given name and one, belongs to them
CUES = ["name is", "name:", "Name:", "Name ist", "heiße", "m'appelle", "m’appelle", "me llamo", "Me llamo", "nombre es", "Dear", "Sincerely,", "Regards,", "regards,", "Contact", "contact", "Contact:", "contact:", "Attn:", "Call", "call", "Ask for", "ask for", "Signed by", "signed by", "spoke to", "spoke with", "speak to", "speak with", "met with"]
_JOIN = r"(?:,|,? (?:and|or|und|oder|et|ou|y|e|o))[ ]"
_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
_LETTERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def _round(key: bytes, tweak: bytes, r: int, x: int, bits: int) -> int:
    h = hashlib.blake2b(x.to_bytes((x.bit_length() + 7) // 8 or 1, "big") + bytes([r]) + tweak, key=key[:64], digest_size=max(8, (bits + 7) // 8) if bits <= 512 else 64).digest()
    while len(h) * 8 < bits:
        h += hashlib.blake2b(h, key=key[:64]).digest()
    return int.from_bytes(h, "big") & ((1 << bits) - 1)


def _walk(x: int, n: int, key: bytes, tweak: bytes, rounds: range) -> int:
    """An unbalanced Feistel network, walked on until it is back in [0, n)."""
    bits = max(2, (n - 1).bit_length())
    lo_bits = bits // 2
    hi_bits = bits - lo_bits
    while True:
        hi, lo = x >> lo_bits, x & ((1 << lo_bits) - 1)
        for r in rounds:
            if r % 2:
                hi ^= _round(key, tweak, r, lo, hi_bits)
            else:
                lo ^= _round(key, tweak, r, hi, lo_bits)
        x = hi << lo_bits | lo
        if x < n:
            return x


def permute(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of [0, n)."""
    return _walk(x, n, key, tweak, range(8)) if n > 1 else x


def step(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """The next value of a keyed cycle through [0, n): another one than x, and each is the next of one."""
    return _walk((permute(x, n, key, tweak) + 1) % n, n, key, tweak, range(7, -1, -1)) if n > 1 else x


def _by_format(s: str, key: bytes, kind: str, classes: list[str], allowed: Callable[[str], bool] = lambda _: True) -> str:
    """Each character becomes one of its class, others stay: the next allowed string of the cycle through this format; s itself is allowed."""
    at = [next((c for c in classes if ch in c), None) for ch in s]
    n = 1
    for c in at:
        n *= len(c) if c else 1
    tweak = (kind + "|" + "".join(str(classes.index(c)) + "," if c else ch for c, ch in zip(at, s, strict=True))).encode()

    def number(t: str) -> int:
        x = 0
        for c, ch in zip(at, t, strict=True):
            x = x * len(c) + c.index(ch) if c else x
        return x

    def text(x: int) -> str:
        out = []
        for c, ch in zip(reversed(at), reversed(s), strict=True):
            if c:
                x, k = divmod(x, len(c))
                ch = c[k]
            out.append(ch)
        return "".join(reversed(out))

    x = number(s)
    while True:
        x = step(x, n, key, tweak)
        if (t := text(x)) == s or allowed(t):
            return t


def _next_in(items: list[str], value: str, key: bytes, kind: str) -> str:
    """The successor in a keyed order of a list: never the value itself."""
    order = sorted(items, key=lambda v: hashlib.blake2b(kind.encode() + v.encode(), key=key[:64], digest_size=8).digest())
    return order[(order.index(value) + 1) % len(order)]


def luhn(digits: str) -> int:
    """0 for a valid number."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def _email(s: str, key: bytes) -> str:
    local, _, domain = s.rpartition("@")
    host, _, tld = domain.rpartition(".")
    return _by_format(local, key, "email", _LETTERS) + "@" + _by_format(host, key, "host", _LETTERS) + "." + tld


def _phone(s: str, key: bytes) -> str:
    m = re.match(r"\+\d{1,3}(?=[ .(-])", s)
    head = m[0] if m else ""
    first = next((i for i, ch in enumerate(s[len(head) :]) if ch.isdigit()), 0)
    body = s[len(head) :]
    leading = body[first] > "1"
    return head + _by_format(body, key, "phone" + head, ["0123456789"], lambda t: (t[first] > "1") == leading)


def _card(s: str, key: bytes) -> str:
    digits = [c for c in s if c.isdigit()]
    off = luhn("".join(digits))
    body = digits[0] + _by_format("".join(digits[1:-1]), key, "card" + digits[0] + str(len(digits)), ["0123456789"])
    last = next(d for d in "0123456789" if luhn(body + d) == off)
    new = iter(body + last)
    return "".join(next(new) if c.isdigit() else c for c in s)


_PUBLIC = [i for i in range(1, 224) if i not in (10, 127, 169, 172, 192)]


def _ip(s: str, key: bytes) -> str:
    a, b, c, d = map(int, s.split("."))
    if a in _PUBLIC:
        x = step((_PUBLIC.index(a) << 24) | b << 16 | c << 8 | d, len(_PUBLIC) << 24, key, b"ip")
        return f"{_PUBLIC[x >> 24]}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"
    if a in (172, 192, 169):
        x = step(c << 8 | d, 1 << 16, key, f"ip{a}.{b}".encode())
        return f"{a}.{b}.{x >> 8}.{x & 255}"
    x = step(b << 16 | c << 8 | d, 1 << 24, key, f"ip{a}".encode())
    return f"{a}.{x >> 16}.{x >> 8 & 255}.{x & 255}"


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str, key: bytes) -> str:
    plain = s.replace(" ", "")
    body = _by_format(plain[4:], key, "iban" + plain[:2] + ("" if _iban_rest(plain) == 1 else plain[2:4]), _LETTERS)
    check = f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" if _iban_rest(plain) == 1 else plain[2:4]
    new = iter(plain[:2] + check + body)
    return "".join(c if c == " " else next(new) for c in s)


def _secret(s: str, key: bytes) -> str:
    m = re.match(r"AKIA|ASIA|gh[pousr]_|sk-(?:[a-z]+-)?|xox[bap]-|AIza", s)
    head = m[0] if m else ""
    body = s[len(head) :]
    if re.fullmatch(r"[0-9a-f]+", body):
        return head + _by_format(body, key, "hex", ["0123456789abcdef"])
    if re.fullmatch(r"[0-9A-F]+", body):
        return head + _by_format(body, key, "HEX", ["0123456789ABCDEF"])
    return head + _by_format(body, key, "secret" + head, _LETTERS)


def _given(s: str, key: bytes) -> str:
    if len(s) > 1 and s.isupper():
        return _given(s.title(), key).upper()
    for group, names in GIVEN.items():
        if s in names:
            return _next_in(names, s, key, group)
    return _by_format(s, key, "given", _CLASSES, lambda t: t not in _ALL_GIVEN)


def _surname(s: str, key: bytes) -> str:
    if len(s) > 1 and s.isupper():
        return _surname(s.title(), key).upper()
    own = SURNAMES[_script(s)]
    return _next_in(own, s, key, "surname") if s in own else _by_format(s, key, "surname", _CLASSES, lambda t: t not in own)


_ALL_GIVEN = {n for names in GIVEN.values() for n in names}
_CAP = r"\p{Lu}['’]?\p{L}+(?:-\p{L}+)*(?![\w'’-]\w)"
_PARTICLE = r"(?:(?:van|von|de|der|den|la|del|di|da|du|le|bin|al|el)[ ]){0,3}"
_INITIAL = r"(?:\p{Lu}\.[ ])?"
_NAMES = "|".join(sorted(map(re.escape, _ALL_GIVEN), key=len, reverse=True))
_TITLED = "|".join(TITLES)
NAME = regex.compile(
    rf"\b(?:(?:{_TITLED})(?:\.|\b)[ ](?:(?P<g1>{_CAP})[ ]{_INITIAL}(?={_PARTICLE}{_CAP}))?|(?:{'|'.join(NOUN_TITLES)})[ ](?:(?P<g2>{_NAMES})[ ])?"
    rf"|(?P<g3>{_NAMES})[ ]{_INITIAL}|(?:{'|'.join(map(re.escape, CUES))})\s(?P<g4>{_CAP})[ ]{_INITIAL}){_PARTICLE}(?P<sur>{_CAP})"
)
ANOTHER = regex.compile(rf"{_JOIN}(?P<g1>{_CAP})[ ]{_INITIAL}{_PARTICLE}(?P<sur>{_CAP})")
_IP = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
# a phone number ends with its format's last digit, or before a space and a number of another kind (where it can: else all of it goes)
_NANP = r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w|[.-]\d)"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})"
_OTHER = rf"(?:{_IP}|\d{{3}}-\d{{2}}-\d{{4}}(?![\d-])|\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?!\w)|[3-6]\d{{3}}(?:[ -]\d{{4}}){{3}}(?![ -]?\d)|3\d{{3}}[ -]\d{{6}}[ -]\d{{5}}(?![ -]?\d)|\d{{13,19}}(?!\d))"
CODE = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,})"
    r"|(?P<secret>\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-(?:[a-z]+-)?[A-Za-z0-9_-]{20,}|xox[bap]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9]))"
    r"|(?P<named>\b(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9+/_.~-]{6,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    rf"|(?P<ip>(?<![\d.]){_IP})"
    rf"|(?P<phone>(?<![\w+])(?:{_NANP}|{_PHONE}(?:(?:[ ](?!{_OTHER})|[.-])?\d{{2,4}}){{2,4}}(?!\w|\.\d+\.\d)|{_PHONE}(?:[ .-]?\d{{2,4}}){{2,4}}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}})(?!\w))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]))"
)
# what no match can do without, whatever stands next to it: a digit, sign or key prefix; a title or given name and a space
_CODE_NEEDS = r"[\d@=:]|AKIA|ASIA|gh[pousr]_|sk-|xox[bap]-|AIza"
_NAME_NEEDS = rf"(?:{'|'.join(TITLES + NOUN_TITLES)})\.? |(?:{_NAMES}) |(?:{'|'.join(map(re.escape, CUES))})[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]"
_CODE_HINT = re.compile(_CODE_NEEDS)
_MAKE = {"email": _email, "secret": _secret, "iban": _iban, "ssn": lambda s, k: _by_format(s, k, "ssn", ["0123456789"]), "ip": _ip, "phone": _phone, "card": _card}


@lru_cache(200_000)
def surrogate(kind: str, value: str, key: bytes) -> str:
    return _MAKE[kind](value, key) if kind in _MAKE else {"value": _secret, "given": _given, "surname": _surname}[kind](value, key)


def _codes(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in CODE.finditer(text):
        kind = m.lastgroup if m.lastgroup != "named" else "value"
        value = m[kind]
        if kind == "card":
            digits = re.sub(r"\D", "", value)
            if luhn(digits) and not (len(digits) == 16 and digits[0] in "3456"):
                continue
        if kind == "iban" and _iban_rest(value.replace(" ", "")) != 1:
            continue
        yield *m.span(kind), kind, value


def _named(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The parts of the names that stand out, and of those that a conjunction adds."""
    m = NAME.search(text)
    while m:
        for group, value in m.groupdict().items():
            if value:
                yield *m.span(group), "surname" if group == "sur" else "given", value
        m = ANOTHER.match(text, m.end()) or NAME.search(text, m.end())


def find(text: str, names: bool = True) -> list[tuple[int, int, str, str, bool]]:
    """Start, end, type and entity of all mentions, in order, none over another; and whether it stands in capitals."""
    found = [(a, z, kind, value, False) for a, z, kind, value in (_codes(text) if _CODE_HINT.search(text) else ())]
    if not names:
        return found
    taken = np.array([x[:2] for x in found], np.int64).reshape(-1, 2)

    def free(a: int, z: int) -> bool:
        k = int(np.searchsorted(taken[:, 1], a, "right"))
        return k == len(taken) or taken[k, 0] >= z

    named = [x for x in _named(text) if free(x[0], x[1])]
    kinds: dict[str, tuple[str, str]] = {}
    for _, _, kind, value in named:
        kinds.setdefault(value, (kind, value))
    for value in list(kinds):
        kinds.setdefault(value.upper(), kinds[value])
    mentions = [(a, z, kind, value, False) for a, z, kind, value in named]
    own = {x[0] for x in named}
    if kinds:
        again = regex.compile(r"(?<!\w)\L<parts>(?!\w)", parts=list(kinds))
        for m in again.finditer(text):
            if m.start() not in own and free(*m.span()):
                kind, value = kinds[m[0]]
                mentions.append((*m.span(), kind, value, m[0] != value))
    out: list[tuple[int, int, str, str, bool]] = []
    for x in sorted(found + mentions):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def replace(text: str, key: bytes, seen: list | None = None, names: bool = True) -> str:
    """The text with surrogates; seen gets (type, entity, surrogate) of each replacement."""
    parts, at = [], 0
    for a, z, kind, value, capitals in find(text, names):
        new = surrogate(kind, value, key)
        if seen is not None:
            seen.append((kind, value, new))
        parts += [text[at:a], new.upper() if capitals else new]
        at = z
    return "".join([*parts, text[at:]])


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's configuration; where there is none, a random one is made and set for this session."""
    if not spark.conf.get(KEY_CONF, None):
        spark.conf.set(KEY_CONF, secrets.token_hex(32))
    return spark.conf.get(KEY_CONF).encode()


def _hits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have what every code needs, and what every name needs; a text that has neither can't match."""
    has = lambda pattern: pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
    return has(_CODE_NEEDS.replace(r"\d", r"\p{Nd}")), has(_NAME_NEEDS)


def replace_all(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with surrogates in text, and n_chars set where a text changed."""
    key = key or session_key(docs.sparkSession)
    names = docs.schema.names
    at = names.index("text")

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        code, name = _hits(b.column(at))
        rows = np.flatnonzero(code | name)
        if not len(rows):
            return b
        cols = list(b.columns)
        texts = cols[at].to_pylist()
        new = {int(i): replace(texts[i], key, names=bool(name[i])) for i in rows}
        new = {i: t for i, t in new.items() if t != texts[i]}
        for i, t in new.items():
            texts[i] = t
        cols[at] = pa.array(texts, cols[at].type)
        if "n_chars" in names:
            sizes = cols[names.index("n_chars")].to_pylist()
            for i, t in new.items():
                sizes[i] = len(t)
            cols[names.index("n_chars")] = pa.array(sizes, cols[names.index("n_chars")].type)
        return pa.RecordBatch.from_arrays(cols, names)

    return map_batches(docs, each, docs.schema)


def entities(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, type, entity, surrogate of every replacement."""
    key = key or session_key(docs.sparkSession)

    def each(b: pa.RecordBatch) -> pa.RecordBatch | None:
        code, name = _hits(b.column(1))
        out: list[tuple] = []
        for i in np.flatnonzero(code | name):
            seen: list = []
            replace(b.column(1)[int(i)].as_py(), key, seen, bool(name[i]))
            out += [(b.column(0)[int(i)].as_py(), *x) for x in seen]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.string()] * 3), strict=True)], ["doc_id", "type", "entity", "surrogate"]) if out else None

    return map_batches(docs.select(F.col("doc_id").cast(T.LongType()), "text"), each, "doc_id long, type string, entity string, surrogate string")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity of their type (none), or equal their own."""
    pairs = found.groupBy("type", "surrogate").agg(F.countDistinct("entity").alias("entities"), F.max(F.col("entity") == F.col("surrogate")).alias("unchanged"))
    return pairs.where("entities > 1 OR unchanged")
