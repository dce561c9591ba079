"""Text rules as column expressions: markers, labels, numbering, slugs, quoting. All run inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for regular expressions.
WS = r"[\s\x0b\x{85}\p{Z}]"
BULLETS = "•‣⁃■▪○●◦–—"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def clean(c: Column) -> Column:
    """White space of any kind collapsed to one space, and trimmed."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|\r|\n", " ")


def inline_text(c: Column) -> Column:
    """Soft hyphens dropped, line ends become one space."""
    return one_line(F.regexp_replace(c, "­", ""))


def sanitize(c: Column) -> Column:
    """Control characters but tab and line ends become U+FFFD."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "�")


def list_marker(c: Column) -> Column:
    """The bullet that opens a text and is followed by white space; null where none does."""
    return F.nullif(F.regexp_extract(strip(c), rf"^([{BULLETS}]){WS}", 1), F.lit(""))


def strip_marker(c: Column) -> Column:
    return F.when(list_marker(c).isNotNull(), strip(F.regexp_replace(strip(c), rf"^[{BULLETS}]{WS}+", ""))).otherwise(c)


def ordered_label(c: Column) -> Column:
    """The label of an ordered item: n. n) [n] a. a)."""
    return F.nullif(F.regexp_extract(c, rf"^{WS}*(\d{{1,3}}[.)]|\[\d{{1,3}}\]|[a-z][.)]){WS}+[^\s]", 1), F.lit(""))


def label_value(label: Column) -> Column:
    core = F.regexp_replace(label, r"[.)\[\]]", "")
    return F.when(core.rlike(r"^\d+$"), core.try_cast("int")).otherwise(F.ascii(core) - 96)


def label_form(label: Column) -> Column:
    """What two labels of one list share: the delimiters, and digits or letters."""
    return F.regexp_replace(F.regexp_replace(label, r"\d+", "9"), "[a-z]", "a")


def _depth(number: Column) -> Column:
    return F.when(number != "", F.size(F.split(number, r"\."))).otherwise(F.lit(None).cast("int"))


def numbered_level(c: Column) -> Column:
    """Depth of a dotted decimal number that opens a text."""
    return _depth(F.regexp_extract(c, rf"^([0-9]+(?:\.[0-9]+)*)\.?{WS}", 1))


def annex_level(c: Column) -> Column:
    """Depth of an annex number: a capital letter and at least one dotted component."""
    return _depth(F.regexp_extract(c, rf"^([A-Z](?:\.[0-9]+)+)\.?{WS}", 1))


def clause_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)*)\.*[ \t]", 1), F.lit(""))


def reference_number(c: Column) -> Column:
    """A clause number of two components or more, the first of which may be a capital letter."""
    return F.nullif(F.regexp_extract(c, r"^((?:[0-9]+|[A-Z])(?:\.[0-9]+)+)", 1), F.lit(""))


def kebab(c: Column) -> Column:
    """Lower-case ASCII letters and digits; everything else collapses to one hyphen."""
    low = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-|-$", "")


def slug(number: Column, title: Column, index: Column, parent: Column | None = None) -> Column:
    """Number and title of a section as one path segment: at most 60 bytes of title, cut at a hyphen behind its middle; section-N where nothing is left.

    parent: the number of the section around it, which the number then doesn't repeat.
    """
    parts = F.struct(*[F.coalesce(F.lit("") if c is None else kebab(c), F.lit("")).alias(n) for n, c in (("num", number), ("title", title), ("above", parent))])
    return _let(parts, lambda p: _segment(p["num"], p["title"], p["above"], index))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once, however often fn refers to it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _segment(num: Column, title: Column, above: Column, index: Column) -> Column:
    """A path segment of parts that are in lower case with hyphens already."""
    tail = F.when((num != "") & F.startswith(title, F.concat(num, F.lit("-"))), F.substring(title, F.length(num) + 2, F.length(title))).otherwise(title)
    tail = _let(tail, lambda t: F.when(F.length(t) <= 60, t).otherwise(_at_hyphen(F.substring(t, 1, 60))))
    num = F.when((above != "") & (num != above) & F.startswith(num, F.concat(above, F.lit("-"))), F.substring(num, F.length(above) + 2, F.length(num))).otherwise(num)
    return _let(F.concat_ws("-", F.nullif(num, F.lit("")), F.nullif(tail, F.lit(""))), lambda both: F.when(both != "", both).otherwise(F.concat(F.lit("section-"), index + 1)))


def _at_hyphen(text: Column) -> Column:
    """A text without what follows its last hyphen, if more than half of it stays."""
    return _let(
        F.struct(text.alias("cut"), F.regexp_replace(text, "-[^-]*$", "").alias("back")),
        lambda v: F.when(F.contains(v["cut"], F.lit("-")) & (F.length(v["back"]) > 30), v["back"]).otherwise(F.rtrim(v["cut"], F.lit("-"))),
    )


def path_name(folder: Column, number: Column, title: Column, index: Column, parent: Column) -> Column:
    """The first of the readable slug, the one without the parent's number and the bare number (or section-N) whose path stays short; else the last."""
    parts = F.struct(*[F.coalesce(kebab(c), F.lit("")).alias(n) for n, c in (("num", number), ("title", title), ("above", parent))])

    def first(p: Column) -> Column:
        last = F.when(p["num"] != "", p["num"]).otherwise(F.concat(F.lit("section-"), index + 1))
        names = F.array(_segment(p["num"], p["title"], F.lit(""), index), _segment(p["num"], p["title"], p["above"], index), last)
        return F.coalesce(F.try_element_at(F.filter(names, lambda n: F.octet_length(folder) + 8 + 2 * F.octet_length(n) <= 150), F.lit(1)), last)

    return _let(parts, first)


def iso_id(c: Column) -> Column:
    """isoN[-part][:year] of a standard's title."""
    pattern = r"^(?i:iso)(?:/[^ \t]*(?=[ \t]))?[ \t]*([0-9](?:[0-9]|-(?=[0-9]))*)(?:[:-]([12][0-9]{3}))?"
    n, year = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    own = F.regexp_replace(n, "-([12][0-9]{3})$", ":$1")  # a year after a hyphen is part of the digits
    return F.when(n != "", F.concat(F.lit("iso"), F.when(year != "", F.concat(n, F.lit(":"), year)).otherwise(own)))


def doc_id(title: Column) -> Column:
    return F.coalesce(iso_id(title), F.nullif(F.trim(F.substring(kebab(title), 1, 60), F.lit("-")), F.lit("")), F.lit("document"))


def iso_date(c: Column) -> Column:
    """YYYY-MM-DD of D:YYYYMMDD...; months and days are only held against 12 and 31."""
    get = lambda i: F.regexp_extract(c, r"^D:([0-9]{4})([0-9]{2})([0-9]{2})", i)
    ok = (get(1) != "") & get(2).try_cast("int").between(1, 12) & get(3).try_cast("int").between(1, 31)
    return F.when(ok, F.concat_ws("-", get(1), get(2), get(3)))


def _cut(c: Column, most: int) -> Column:
    """The longest beginning of at most so many UTF-8 bytes."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(c.cast("binary"), 1, most).cast("string")), "\\x{FFFD}+$", "")


def first_sentence(c: Column) -> Column:
    """Up to an end mark before white space that isn't behind an initial, within 300 bytes; else the text, cut at a space and with an ellipsis if it is longer."""
    found = F.regexp_extract(c, rf"(?s)^(.*?(?<!{WS}[A-Za-z])[.!?])(?={WS})", 1)
    cut = _cut(c, 297)
    back = F.regexp_extract(cut, rf"(?s)^(.*){WS}", 1)
    cut = F.when(F.octet_length(back) > 150, back).otherwise(cut)
    short = F.concat(F.regexp_replace(cut, rf"(?:{WS}|[,;:])+$", ""), F.lit("…"))
    return F.when((found != "") & (F.octet_length(found) <= 300), found).when(F.octet_length(c) <= 300, c).otherwise(short)


def truncate(c: Column, most: int = 200) -> Column:
    """At most so many bytes, back to the last space if that lies behind the middle."""
    cut = _cut(c, most)
    back = F.regexp_extract(cut, rf"(?s)^(.*){WS}", 1)
    cut = F.when(F.octet_length(back) > most // 2, back).otherwise(cut)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(cut, rf"{WS}+$", ""))


def collapse(c: Column) -> Column:
    """White space collapsed and trimmed, if there is a plain space, tab or line end at all."""
    return F.when(c.rlike(r"[\n\r\t ]"), clean(c)).otherwise(c)


def title_of(title: Column, glyphs: Column, actual: Column) -> Column:
    """The title of a heading: its own, that of its text, or its replacement."""
    return truncate(F.coalesce(F.nullif(clean(title), F.lit("")), F.nullif(clean(glyphs), F.lit("")), clean(inline_text(actual)), F.lit("")))


def declared_marker(c: Column) -> Column:
    """The bullet or hyphen that opens the text of a declared item."""
    return F.nullif(F.regexp_extract(strip(c), rf"^([{BULLETS}-]){WS}", 1), F.lit(""))


def enumerated(marker: Column) -> Column:
    """Whether a marker says more than that there is an item."""
    return (F.coalesce(marker, F.lit("")) != "") & ~marker.rlike(rf"^[{BULLETS}-]$")


def same_form(a: Column, b: Column) -> Column:
    """Whether two labels are of one form: the delimiters, and digits or letters."""
    return (a.rlike("[0-9]") == b.rlike("[0-9]")) & (F.regexp_replace(a, "[0-9a-z]", "") == F.regexp_replace(b, "[0-9a-z]", ""))


def is_cued(before: Column) -> Column:
    """Whether the text before a number says that it is a reference: a word for one, or a section sign, and white space."""
    return before.rlike(r"(?i)(?:^|[^a-z])(?:clauses?|subclauses?|annex|annexes|see)[ \t]+$") | before.rlike(r"§[ \t]+$")


def heading_level(c: Column) -> Column:
    return F.least(F.lit(6), F.greatest(F.lit(1), c))


def code_fence(c: Column) -> Column:
    """A fence that no run of backticks in a code block is as long as."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def escape_markdown(c: Column) -> Column:
    """The four characters that always need a backslash."""
    return F.regexp_replace(c, r"([\\`*|])", r"\\$1")


def link_label(c: Column) -> Column:
    return F.regexp_replace(escape_markdown(c), r"([\[\]])", r"\\$1")


def yaml_string(c: Column) -> Column:
    """A YAML scalar: plain where it reads back as this string, else in double quotes."""
    low = F.lower(c)
    reserved = low.isin("true", "false", "null", "yes", "no", "on", "off", "~", "y", "n")
    decimal = c.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$") & (F.abs(c.try_cast("double")) < float("inf"))
    numeric = decimal | low.rlike(r"^(?:[+-]?(?:0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?[0-9]+|inf|infinity)|nan)$")
    odd = (c == "") | c.rlike(rf"^{WS}|{WS}$|^[-?:,\[\]{{}}#&*!|>'\"%@`]|:[ \t]|:$|[ \t]#|[\\\x00-\x1f\x7f\x{{85}}\x{{2028}}\x{{2029}}]")
    body = F.regexp_replace(c, r'([\\"])', r"\\$1")
    for char, escape in {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\x85": "\\N", "\u2028": "\\L", "\u2029": "\\P"}.items():
        body = F.replace(body, F.lit(char), F.lit(escape))
    rare = body
    for code in (*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    quoted = F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), rare).otherwise(body), F.lit('"'))
    return F.when(reserved | numeric | odd, quoted).otherwise(c)


def arabic_marker(c: Column) -> Column:
    return c.rlike(r"^\d{1,9}[.)]$")


CJK = r"\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF9F}"


def spaceless(ch: Column) -> Column:
    """Han, kana and their punctuation: no space where lines are joined. Hangul isn't among them."""
    return ch.rlike(f"^[{CJK}]$")


def glued(before: Column, after: Column) -> Column:
    """Whether no space belongs between two lines: one side has it, both are CJK, or a dash that a word holds ends the first."""
    dash = before.rlike(r"[\p{L}\p{Nd}][\p{Pd}\x{AD}\x{2212}]+$")
    return (before == "") | (after == "") | before.rlike(rf"{WS}$") | after.rlike(rf"^{WS}") | (before.rlike(f"[{CJK}]$") & after.rlike(f"^[{CJK}]")) | dash


def joined_lines(lines: Column) -> Column:
    """An array of lines as one text; nothing leaves the row."""
    piece = lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.when(glued(F.get(lines, i - 1), x), "").otherwise(" "), x))
    return F.array_join(F.transform(lines, piece), "")


def is_dash(ch: Column) -> Column:
    return ch.rlike(r"^[\p{Pd}\x{AD}\x{2212}]$")


def quantize(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def strip_subset_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^[A-Z]{6}\+(?=.)", "")


def font_traits(name: Column, flags: Column, weight: Column, stem: Column) -> Column:
    low = F.lower(name)
    return F.struct(
        (low.rlike("bold|black|heavy|semibold") | (F.coalesce(weight, F.lit(0)) >= 600) | (F.coalesce(stem, F.lit(0)) > 120)).alias("bold"),
        (low.rlike("italic|oblique") | (flags.bitwiseAND(64) != 0)).alias("italic"),
        (low.rlike("mono|courier|consolas") | (flags.bitwiseAND(1) != 0)).alias("mono"),
    )


def fmt_pages(first: Column, last: Column) -> Column:
    """page n, or pages a to b; empty where the first page isn't known."""
    return F.when(F.coalesce(first, F.lit(0)) == 0, "").when(last > first, F.concat(F.lit("pages "), first, F.lit("–"), last)).otherwise(F.concat(F.lit("page "), first))


def image_extension(codec: Column) -> Column:
    """Of the file that an image can be written to; null for codecs that can't be."""
    return F.when(codec == "jpeg", "jpg").when(codec == "raw", "png")


def valid_bits(bits: Column, stencil: Column) -> Column:
    """Bits of a component: one for stencils, eight where the number is none of the format's."""
    return F.when(stencil, 1).when(bits.isin(1, 2, 4, 8, 16), bits).otherwise(8)


def count_list(counts: Column) -> Column:
    """A map of counts as key=n, the largest first, equals by key."""
    order = lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1)).when(a["key"] < b["key"], -1).otherwise(1)
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts), order), lambda r: F.concat(r["key"], F.lit("="), r["value"])), " ")
