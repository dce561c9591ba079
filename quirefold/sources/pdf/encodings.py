"""Character encodings of simple fonts, glyph names, and advance widths of the standard fonts."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

_MARKS = {
    "GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron",
    "STROKE": "slash", "MACRON": "macron", "BREVE": "breve", "OGONEK": "ogonek", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut",
}
_DIGITS = "zero one two three four five six seven eight nine".split()
#: name, then its character; letters, and letters with one mark, have names by rule
_OTHERS = (
    "space \x20 exclam ! quotedbl \" numbersign # dollar $ percent % ampersand & quotesingle ' parenleft ( parenright ) asterisk * plus + comma , hyphen - period . slash / colon : semicolon ; less < equal = "
    "greater > question ? at @ bracketleft [ backslash \\ bracketright ] asciicircum ^ underscore _ grave ` braceleft { bar | braceright } asciitilde ~ "
    "exclamdown ¡ cent ¢ sterling £ currency ¤ yen ¥ brokenbar ¦ section § dieresis ¨ copyright © ordfeminine ª guillemotleft « logicalnot ¬ registered ® macron ¯ degree ° plusminus ± twosuperior ² threesuperior ³ "
    "acute ´ mu µ paragraph ¶ periodcentered · cedilla ¸ onesuperior ¹ ordmasculine º guillemotright » onequarter ¼ onehalf ½ threequarters ¾ questiondown ¿ multiply × divide ÷ AE Æ ae æ Eth Ð eth ð Thorn Þ thorn þ germandbls ß "
    "OE Œ oe œ dotlessi ı florin ƒ circumflex ˆ caron ˇ breve ˘ dotaccent ˙ ring ˚ ogonek ˛ tilde ˜ hungarumlaut ˝ endash – emdash — quoteleft ‘ quoteright ’ quotesinglbase ‚ quotedblleft “ quotedblright ” quotedblbase „ "
    "dagger † daggerdbl ‡ bullet • ellipsis … perthousand ‰ guilsinglleft ‹ guilsinglright › fraction ⁄ Euro € trademark ™ minus − fi ﬁ fl ﬂ ff ﬀ ffi ﬃ ffl ﬄ nbspace \xa0 sfthyphen \xad "
    "partialdiff ∂ Delta ∆ product ∏ summation ∑ radical √ infinity ∞ integral ∫ approxequal ≈ notequal ≠ lessequal ≤ greaterequal ≥ lozenge ◊ Omega Ω arrowleft ← arrowup ↑ arrowright → arrowdown ↓ "
    "element ∈ emptyset ∅ intersection ∩ union ∪ logicaland ∧ logicalor ∨ similar ∼ equivalence ≡ dotmath ⋅ prime ′ minute ′ second ″ apple  figuredash ‒ horizontalbar ― afii61352 № "
    "afii00208 ― aleph ℵ angle ∠ arrowboth ↔ arrowdblboth ⇔ arrowdbldown ⇓ arrowdblleft ⇐ arrowdblright ⇒ arrowdblup ⇑ arrowupdn ↕ asteriskmath ∗ circle ○ circlemultiply ⊗ circleplus ⊕ club ♣ "
    "congruent ≅ Dcroat Đ dcroat đ Deltagreek Δ diamond ♦ eightinferior ₈ eightsuperior ⁸ Eng Ŋ eng ŋ estimated ℮ exclamdbl ‼ existential ∃ female ♀ filledbox ■ fiveeighths ⅝ fiveinferior ₅ "
    "fivesuperior ⁵ fourinferior ₄ foursuperior ⁴ fraction1 ∕ gradient ∇ Hbar Ħ hbar ħ heart ♥ house ⌂ Ifraktur ℑ IJ Ĳ ij ĳ integralbt ⌡ integraltp ⌠ invbullet ◘ invcircle ◙ invsmileface ☻ "
    "Kcommaaccent Ķ kcommaaccent ķ kgreenlandic ĸ Lcommaaccent Ļ lcommaaccent ļ Ldot Ŀ ldot ŀ longs ſ longst ﬅ male ♂ mugreek μ musicalnote ♪ musicalnotedbl ♫ napostrophe ŉ Ncommaaccent Ņ "
    "ncommaaccent ņ nineinferior ₉ ninesuperior ⁹ notelement ∉ notsubset ⊄ nsuperior ⁿ omega1 ϖ Omegagreek Ω onedotenleader ․ oneeighth ⅛ oneinferior ₁ onethird ⅓ openbullet ◦ orthogonal ∟ "
    "parenleftinferior ₍ parenleftsuperior ⁽ parenrightinferior ₎ parenrightsuperior ⁾ periodcentered1 ∙ perpendicular ⊥ phi1 ϕ prescription ℞ propersubset ⊂ propersuperset ⊃ proportional ∝ "
    "quotereversed ‛ Rcommaaccent Ŗ rcommaaccent ŗ reflexsubset ⊆ reflexsuperset ⊇ revlogicalnot ⌐ Rfraktur ℜ seveneighths ⅞ seveninferior ₇ sevensuperior ⁷ sixinferior ₆ sixsuperior ⁶ "
    "smileface ☺ spade ♠ st ﬆ suchthat ∋ sun ☼ Tbar Ŧ tbar ŧ Tcommaaccent Ţ tcommaaccent ţ therefore ∴ theta1 ϑ threeeighths ⅜ threeinferior ₃ triagdn ▼ triaglf ◄ triagrt ► triagup ▲ "
    "twodotenleader ‥ twoinferior ₂ twothirds ⅔ underscoredbl ‗ universal ∀ weierstrass ℘ zeroinferior ₀ zerosuperior ⁰"
)


@cache
def glyph_list() -> dict[str, str]:
    out = {}
    for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180)]:
        m = re.fullmatch(r"LATIN (CAPITAL|SMALL) LETTER (\w)(?: WITH (.+))?", unicodedata.name(chr(c), ""))
        if m and (m[3] is None or m[3] in _MARKS):
            out[(m[2] if m[1] == "CAPITAL" else m[2].lower()) + _MARKS.get(m[3], "")] = chr(c)
    for c in range(0x391, 0x3CA):
        m = re.fullmatch(r"GREEK (CAPITAL|SMALL) LETTER (\w+)", unicodedata.name(chr(c), ""))
        if m:
            name = m[2].lower().replace("lamda", "lambda")
            out[name.capitalize() if m[1] == "CAPITAL" else name] = chr(c)
    out |= {"sigma1": "ς"} | {n: str(i) for i, n in enumerate(_DIGITS)}
    parts = re.split(r"(?<=[^ ]) | (?= (?: |$))", _OTHERS.replace("space   ", "space \x00 ", 1))
    out |= {n: " " if c == "\x00" else c for n, c in zip(parts[::2], parts[1::2], strict=True)}
    return out


def _code(digits: str) -> str | None:
    if not re.fullmatch(r"[0-9A-Fa-f]+", digits):
        return None
    v = int(digits, 16)
    return chr(v) if v <= 0x10FFFF and not 0xD800 <= v <= 0xDFFF else None


def glyph_text(name: str) -> str | None:
    """The text that a glyph name stands for: listed, uniXXXX..., uXXXX to uXXXXXX, with a suffix, or parts joined by underscores."""
    if not name:
        return None
    if (found := glyph_list().get(name)) is not None:
        return found
    rest = name[3:]
    if name.startswith("uni") and len(rest) >= 4 and len(rest) % 4 == 0:
        runs = [_code(rest[i : i + 4]) for i in range(0, len(rest), 4)]
        if None not in runs:
            return "".join(runs)
    if name[0] == "u" and 4 <= len(name) - 1 <= 6 and (one := _code(name[1:])):
        return one
    if (dot := name.find(".")) > 0:
        return glyph_text(name[:dot])
    if "_" in name:
        parts = [glyph_text(p) for p in name.split("_")]
        return None if None in parts else "".join(parts)
    return None


_STANDARD_HIGH = {
    0xA1: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl", 0xB1: "endash dagger daggerdbl periodcentered",
    0xB6: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand", 0xBF: "questiondown", 0xC1: "grave acute circumflex tilde macron breve dotaccent dieresis",
    0xCA: "ring cedilla", 0xCD: "hungarumlaut ogonek caron emdash", 0xE1: "AE", 0xE3: "ordfeminine", 0xE8: "Lslash Oslash OE ordmasculine", 0xF1: "ae", 0xF5: "dotlessi", 0xF8: "lslash oslash oe germandbls",
}
_PDF_DOC = {
    0x18: "breve caron circumflex dotaccent hungarumlaut ogonek ring tilde",
    0x80: "bullet dagger daggerdbl ellipsis emdash endash florin fraction guilsinglleft guilsinglright minus perthousand quotedblbase quotedblleft quotedblright quoteleft quoteright quotesinglbase trademark fi fl "
    "Lslash OE Scaron Ydieresis Zcaron dotlessi lslash oe scaron zcaron",
    0xA0: "Euro",
}
#: places of MacRoman that the encoding for fonts leaves empty
_MAC_EMPTY = {0xAD, 0xB0, 0xB2, 0xB3, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xBD, 0xC3, 0xC5, 0xC6, 0xD7, 0xF0}


@cache
def base_encoding(name: str) -> tuple[str, ...] | None:
    """The glyph name of each of 256 codes ('' for none); None for an encoding that isn't known."""
    by_char = {c: n for n, c in reversed(glyph_list().items())}
    names = [""] * 256

    def put(code: int, char: str) -> None:
        names[code] = by_char.get(char, "")

    def rows(table: dict[int, str]) -> None:
        for start, text in table.items():
            for i, n in enumerate(text.split()):
                names[start + i] = n

    if name not in ("StandardEncoding", "WinAnsiEncoding", "MacRomanEncoding", "PDFDocEncoding"):
        return None
    for c in range(0x20, 0x7F):
        put(c, chr(c))
    if name == "StandardEncoding":
        names[0x27], names[0x60] = "quoteright", "quoteleft"
        rows(_STANDARD_HIGH)
    elif name == "PDFDocEncoding":
        for c in range(0xA1, 0x100):
            put(c, chr(c))
        names[0xAD] = ""
        rows(_PDF_DOC)
    elif name == "WinAnsiEncoding":
        for c in range(0x7F, 0x100):
            char = bytes([c]).decode("cp1252", "ignore")
            put(c, char if char and c != 0x7F else "•")
        names[0xA0], names[0xAD] = "space", "hyphen"
    else:
        for c in set(range(0x80, 0x100)) - _MAC_EMPTY:
            put(c, bytes([c]).decode("mac_roman"))
        names[0xCA], names[0xDB] = "space", "currency"
    return tuple(names)


@cache
def _doc_text() -> list[str]:
    return [glyph_text(n) or chr(c) for c, n in enumerate(base_encoding("PDFDocEncoding"))]


def text_string(value: object) -> str:
    """A text string: UTF-16 behind its mark, else PDFDocEncoding; a name is its own text; anything else has none."""
    if isinstance(value, bytes):
        if value[:2] == b"\xfe\xff":
            return value[2 : len(value) - len(value) % 2].decode("utf-16-be", "replace")
        table = _doc_text()
        return "".join([table[c] for c in value])
    return str(value) if isinstance(value, str) else ""


_WIDTHS = {
    "Helvetica": """191 quotesingle|222 i j l quoteleft quoteright quotesinglbase lslash|260 bar brokenbar|278 space exclam comma period slash colon semicolon I bracketleft backslash bracketright f t dotlessi periodcentered
        |333 parenleft parenright hyphen grave r exclamdown quotedblleft quotedblright quotedblbase guilsinglleft guilsinglright acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron onesuperior twosuperior threesuperior
        |334 braceleft braceright|350 bullet|355 quotedbl|365 ordmasculine|370 ordfeminine|389 asterisk|400 degree|469 asciicircum|500 J c k s v x y z fi fl|537 paragraph
        |556 numbersign dollar underscore zero one two three four five six seven eight nine question L a b d e g h n o p q u cent sterling yen florin section currency guillemotleft guillemotright endash dagger daggerdbl Lslash mu eth thorn Euro
        |584 plus less equal greater asciitilde plusminus multiply divide minus logicalnot|611 F T Z questiondown oslash germandbls|667 ampersand A B E K P S V X Y Thorn|722 C D H N R U w Eth|737 copyright registered|778 G O Q Oslash
        |833 M m|834 onehalf onequarter threequarters|889 percent ae|944 W oe|1000 ellipsis perthousand emdash AE OE trademark|1015 at|167 fraction""",
    "Helvetica-Bold": """238 quotesingle|278 space comma period slash I backslash i j l quoteleft quoteright quotesinglbase lslash dotlessi periodcentered|280 bar brokenbar
        |333 exclam parenleft parenright hyphen colon semicolon bracketleft bracketright grave f t exclamdown guilsinglleft guilsinglright acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron onesuperior twosuperior threesuperior
        |350 bullet|365 ordmasculine|370 ordfeminine|389 asterisk r braceleft braceright|400 degree|474 quotedbl|500 z quotedblleft quotedblright quotedblbase
        |556 numbersign dollar zero one two three four five six seven eight nine J underscore a c e k s v x y cent sterling yen florin section currency guillemotleft guillemotright endash dagger daggerdbl paragraph Euro
        |584 plus less equal greater asciicircum asciitilde plusminus multiply divide minus logicalnot|611 question F L T Z b d g h n o p q u questiondown fi fl Lslash oslash germandbls mu eth thorn|667 E P S V X Y Thorn
        |722 ampersand A B C D H K N R U Eth|737 copyright registered|778 G O Q w Oslash|833 M|834 onehalf onequarter threequarters|889 percent m ae|944 W oe|975 at|1000 ellipsis perthousand emdash AE OE trademark|167 fraction""",
    "Times-Roman": """180 quotesingle|200 bar brokenbar|250 space comma period periodcentered|276 ordfeminine|278 slash colon semicolon backslash i j l t dotlessi lslash|300 onesuperior twosuperior threesuperior|310 ordmasculine
        |333 exclam parenleft parenright hyphen I bracketleft bracketright grave f r exclamdown quoteleft quoteright quotesinglbase guilsinglleft guilsinglright acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron
        |350 bullet|389 J s|400 degree|408 quotedbl|444 question a c e z quotedblleft quotedblright quotedblbase questiondown|453 paragraph|469 asciicircum|480 braceleft braceright
        |500 numbersign dollar zero one two three four five six seven eight nine asterisk underscore b d g h k n o p q u v x y cent sterling yen florin section currency guillemotleft guillemotright endash dagger daggerdbl oslash germandbls mu eth thorn Euro
        |541 asciitilde|556 F P S fi fl Thorn|564 plus less equal greater plusminus multiply divide minus logicalnot|611 E L T Z Lslash|667 B C R ae|722 A D G H K N O Q U V X Y w oe Oslash Eth|750 onehalf onequarter threequarters|760 copyright registered
        |778 ampersand m|833 percent|889 M AE OE|921 at|944 W|980 trademark|1000 ellipsis perthousand emdash|167 fraction""",
    "Times-Bold": """220 bar brokenbar|250 space comma period periodcentered|278 quotesingle slash backslash i l dotlessi lslash|300 ordfeminine onesuperior twosuperior threesuperior|330 ordmasculine
        |333 exclam parenleft parenright hyphen colon semicolon bracketleft bracketright grave f j t exclamdown quoteleft quoteright quotesinglbase guilsinglleft guilsinglright acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron
        |350 bullet|389 I s|394 braceleft braceright|400 degree|444 c e r z
        |500 numbersign dollar zero one two three four five six seven eight nine asterisk question J underscore a g o v x y cent sterling yen florin section currency guillemotleft guillemotright quotedblleft quotedblright quotedblbase endash dagger daggerdbl questiondown oslash eth Euro
        |520 asciitilde|540 paragraph|555 quotedbl|556 S b d h k n p q u fi fl germandbls mu thorn|570 plus less equal greater plusminus multiply divide minus logicalnot|581 asciicircum|611 F P Thorn|667 B E L T Z Lslash
        |722 A C D N R U V X Y w ae oe Eth|747 copyright registered|750 onehalf onequarter threequarters|778 G H K O Q Oslash|833 ampersand m|930 at|944 M|1000 percent W ellipsis perthousand emdash AE OE trademark|167 fraction""",
    "Times-Italic": """214 quotesingle|250 space comma period periodcentered|275 bar brokenbar|276 ordfeminine|278 slash backslash f i j l t dotlessi lslash|300 onesuperior twosuperior threesuperior|310 ordmasculine
        |333 exclam parenleft parenright hyphen colon semicolon I grave quoteleft quoteright quotesinglbase guilsinglleft guilsinglright acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron
        |350 bullet|389 bracketleft bracketright r s z exclamdown|400 braceleft braceright degree|420 quotedbl|422 asciicircum|444 J c e k v x y
        |500 numbersign dollar zero one two three four five six seven eight nine asterisk question S underscore a b d g h n o p q u cent sterling yen florin section currency guillemotleft guillemotright endash dagger daggerdbl questiondown fi fl oslash germandbls mu eth thorn Euro
        |523 paragraph|541 asciitilde|556 L T Y Z quotedblleft quotedblright quotedblbase Lslash|611 A B E F P R V X Thorn|667 C K N w ae oe|675 plus less equal greater plusminus multiply divide minus logicalnot|722 D G H O Q U m Oslash Eth
        |750 onehalf onequarter threequarters|760 copyright registered|778 ampersand|833 percent M W|889 ellipsis emdash AE|920 at|944 OE|980 trademark|1000 perthousand|167 fraction""",
    "Times-BoldItalic": """220 bar brokenbar|250 space comma period periodcentered|266 ordfeminine|278 quotesingle slash backslash i j l t dotlessi lslash|300 ordmasculine onesuperior twosuperior threesuperior
        |333 parenleft parenright hyphen colon semicolon bracketleft bracketright grave f quoteleft quoteright quotesinglbase guilsinglleft guilsinglright acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron
        |348 braceleft braceright|350 bullet|389 exclam I r s z exclamdown|400 degree|444 c e v y
        |500 numbersign dollar zero one two three four five six seven eight nine asterisk question J underscore a b d g k o p q x cent sterling yen florin section currency guillemotleft guillemotright quotedblleft quotedblright quotedblbase endash dagger daggerdbl questiondown paragraph oslash germandbls eth thorn Euro
        |555 quotedbl|556 S h n u fi fl|570 plus less equal greater asciicircum asciitilde plusminus multiply divide|576 mu|606 minus logicalnot|611 L P T Y Z Lslash Thorn|667 A B C E F K R V X w|722 D G N O Q U ae oe Oslash Eth|747 copyright registered
        |750 onehalf onequarter threequarters|778 H ampersand m|832 at|833 percent|889 M W|944 AE OE|1000 ellipsis perthousand emdash trademark|167 fraction""",
}
_FAMILY = {"arial": "Helvetica", "arialmt": "Helvetica", "helvetica": "Helvetica", "times": "Times", "timesnewroman": "Times", "timesnewromanps": "Times", "timesnewromanpsmt": "Times", "couriernew": "Courier", "couriernewpsmt": "Courier", "courier": "Courier"}


@cache
def _widths(font: str) -> dict[str, int]:
    found = {name: int(w) for w, *names in (part.split() for part in _WIDTHS[font].split("|")) for name in names}
    for name, char in glyph_list().items():  # a letter with a mark is as wide as the letter
        plain = unicodedata.normalize("NFD", char)
        if name not in found and len(plain) == 2 and plain[0].isascii() and plain[0].isalpha():
            found[name] = found[plain[0]] if plain[0] != "i" else found["dotlessi"]
    return found


@cache
def standard_font(base_font: str) -> str | None:
    """The standard font that a name, perhaps of a subset or of a look-alike, stands for."""
    name = re.sub(r"^[A-Z]{6}\+(?=.)", "", base_font)
    m = re.fullmatch(r"([A-Za-z]+?)(?:[-,](Roman|Bold|BoldItalic|BoldOblique|Italic|Oblique)?(MT)?)?", name)
    family = _FAMILY.get(m[1].lower()) if m else None
    if not family or (m[1].lower() != m[1] and m[1] not in ("Arial", "ArialMT", "Helvetica", "Times", "TimesNewRoman", "TimesNewRomanPS", "TimesNewRomanPSMT", "CourierNew", "CourierNewPSMT", "Courier")):
        return None
    style = (m[2] or "").replace("Oblique", "Italic").replace("Roman", "")
    if family == "Helvetica":
        return "Helvetica-Bold" if "Bold" in style else "Helvetica"
    return "Courier" if family == "Courier" else f"Times-{style or 'Roman'}"


def standard_width(base_font: str, glyph: str) -> int | None:
    font = standard_font(base_font)
    if font is None:
        return None
    return 600 if font == "Courier" else _widths(font).get(glyph)
