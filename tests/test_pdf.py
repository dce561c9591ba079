"""The reader of PDF files: tokens, objects, CMaps, fonts, the walk over a page, images."""

import random
import zlib

import numpy as np
import pytest

from quirefold.sources.pdf import cmaps, encodings, fonts, images
from quirefold.sources.pdf import writer as w
from quirefold.sources.pdf.objects import Store, Stream
from quirefold.sources.pdf.page import Policy, Walk, blocks, read_page
from quirefold.sources.pdf.tokens import Lexer, Name, Ref, number, operators


def test_numbers_are_saved():
    cases = {b"17": 17, b"-4": -4, b"+3": 3, b"2.5": 2.5, b".5": 0.5, b"6.": 6.0, b"--9": -9, b"8-1": 8, b"1.5.7": 1.5, b".": 0, b"-": 0, b"-.25-": -0.25}
    assert {k: number(k) for k in cases} == cases


def test_tokens():
    lex = Lexer(b"/A#42c (a\\(b\\)\\101\\\r\nz(in)) <4 14> [ << >> ] true nul % gone\n}{ 5 x")
    got = []
    while (t := lex.next()).kind:
        got.append(t.value if t.kind in ("object", "operator") else t.kind)
    assert got == ["ABc", b"a(b)Az(in)", b"A@", "[", "<<", ">>", "]", True, "nul", 5, "x"]
    assert Lexer(b"(open (still").next().value == b"open (still" and Lexer(b"%").next().kind is None


def test_operators_and_inline_images():
    ops = list(operators(b"<</K [1 /N<41>]>> BDC [ (open 3 Tj BI /W 2 /F [/A85 /Fl] ID x EIx y\nEI Q 1 2 > cm"))
    assert [o.name for o in ops] == ["BDC"] + [o.name for o in ops][1:]
    assert ops[0].operands == [{"K": [1, "N", b"A"]}]
    ops = list(operators(b"q BI /W 2 /F [/A85 /Fl] ID x EIx y\nEI Q [ 3 << /A 4 Tj"))
    assert [(o.name, o.inline) for o in ops] == [("q", None), ("INLINE_IMAGE", b"x EIx y"), ("Q", None), ("Tj", None)]
    assert ops[1].operands == [{"W": 2, "F": ["A85", "Fl"]}] and ops[3].operands == [[3, {"A": 4}]]
    assert len(list(operators(b"1 " * 600 + b"x"))[0].operands) == 512 and list(operators(b"BI /W 1")) == []


def test_random_bytes_never_raise():
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice(b"()<>[]/% \\\n0123456789.-BIDEqTjabc\x00\xff") for _ in range(rng.randrange(80)))
        list(operators(data))
        cmaps.parse(data)


@pytest.mark.parametrize("compact", [False, True])
def test_store(compact):
    data = w.document([b"BT ET", b"q Q"], info={"Title": "T"}, compact=compact, packed=True, page={"Rotate": 90})
    s = Store(data)
    assert len(s.pages) == 2 and s.content(s.pages[1]) == b"q Q" and s.page_box(s.pages[0]) == (0, 0, 612, 792)
    assert s.int(s.pages[0], "Rotate") == 90 and s.dict(s.pages[0], "Resources")["Font"] and s.metadata()["title"] == "T"
    assert s.stats()["xref_streams"] is compact and not s.rebuilt
    shifted = Store(b"junk before\n" + data)
    assert len(shifted.pages) == 2
    damaged = Store(data[: data.rindex(b"startxref")] + b"startxref\n7\n%%EOF")
    assert damaged.rebuilt and len(damaged.pages) == 2 and damaged.content(damaged.pages[0]) == b"BT ET"
    for bad in (b"", b"no file at all", b"%PDF-1.4 and nothing"):
        with pytest.raises(ValueError):
            Store(bad)


def test_references_and_loops():
    out = w.Writer()
    root, tree, a, b = out.add(), out.add(), out.add(), out.add()
    out.put(a, b)
    out.put(b, a)
    page = out.add({"Type": Name("Page"), "Parent": tree, "Contents": [a, out.stream(b"one"), out.stream(b"two")]})
    out.put(tree, {"Kids": [page, tree, page, out.add(None)], "MediaBox": [9, 9, 1, 2]})
    out.put(root, {"Pages": tree})
    s = Store(out.finish({"Root": root}))
    assert s.resolve(a) is None and s.resolve(Ref(99, 0)) is None and len(s.pages) == 1
    assert s.content(s.pages[0]) == b"one\ntwo" and s.page_box(s.pages[0]) == (1, 2, 9, 9)
    assert s.int({"x": 2.9}, "x") == 2 and s.num({"x": 2}, "x") == 2.0 and s.bool({"x": 1}, "x") is None and s.name({"x": b"n"}, "x") is None


def test_updates_count():
    data = w.document([b"old"])
    num = next(n for n, e in Store(data).entries.items() if isinstance(Store(data).resolve(Ref(n, 0)), Stream))
    at = len(data)
    more = b"%d 0 obj <</Length 3>> stream\nnew\nendstream endobj\n" % num
    prev = int(data[data.rindex(b"startxref") + 9 :].split()[0])
    root = Store(data).trailer["Root"]
    tail = b"xref\n%d 1\n%010d 00000 n \ntrailer <</Root %d 0 R /Size 9 /Prev %d>>\nstartxref\n%d\n%%%%EOF" % (num, at, root.num, prev, at + len(more))
    assert Store(data + more + tail).content(Store(data + more + tail).pages[0]) == b"new"


def test_text_strings_and_glyph_names():
    assert encodings.text_string(b"\xfe\xff\xd8\x3d\xde\x00x") == "\U0001f600" and encodings.text_string(b"caf\xe9 \x80\xa0") == "café •€" and encodings.text_string(Name("N")) == "N" and encodings.text_string(5) == ""
    names = {"A": "A", "eacute": "é", "uni00480069": "Hi", "u1F600": "\U0001f600", "a.sc": "a", "f_f_i": "ffi", "uniD800": None, ".notdef": None, "zzz": None, "Omega": "\u2126"}
    assert {n: encodings.glyph_text(n) for n in names} == names
    for code in range(0xA1, 0x100):
        if code != 0xAD:
            assert encodings.glyph_text(encodings.base_encoding("WinAnsiEncoding")[code]) == bytes([code]).decode("cp1252")
    assert encodings.base_encoding("StandardEncoding")[0x27] == "quoteright" and encodings.base_encoding("None") is None
    assert encodings.standard_width("ABCDEF+Arial,Bold", "a") == 556 and encodings.standard_width("CourierNew", "W") == 600 and encodings.standard_width("Times-Roman", "Aacute") == 722 and encodings.standard_width("Georgia", "a") is None


def test_cmaps():
    c = cmaps.parse(b"/X-V /CMapName exch def /CMapName /My-V def 2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 beginbfrange <10> <12> <D83DDE00> endbfrange 1 begincidrange <8001> <8003> 40 endcidrange")
    assert c.name == "My-V" and c.codes(b"\x10\x80\x02\x81") == [(16, 1), (0x8002, 2), (0x81, 1)]
    assert c.texts[17] == "\U0001f601" and c.cid(0x8003) == 42 and c.cid(5) is None and c.code_for("\U0001f602") == 18
    assert cmaps.parse(b"/Identity-H usecmap").cid(77) == 77 and cmaps.nth_after("x\uffff", 0) == "x\uffff" and cmaps.nth_after("\ud7ff", 1) == "\ud7ff"
    assert cmaps.parse(b"1 beginbfrange <00> <FFFFFFFF> <0041> endbfrange 1 beginbfchar <01> 5 <02> <0042>").texts == {2: "B"}


class Plain(Store):
    """A store without a file, for dictionaries written here."""

    def __init__(self):
        self.cache, self.entries = {}, {}


def test_fonts():
    s = Plain()
    to_unicode = Stream({}, b"1 beginbfchar <41> <0391> endbfchar")
    f = fonts.Font(s, {"Subtype": Name("Type1"), "BaseFont": Name("ABCDEF+My-BoldOblique"), "FirstChar": 65, "Widths": [500, 600], "ToUnicode": to_unicode, "Encoding": {"Differences": [66, Name("eacute"), Name("uni0042"), 300, Name("x")]}, "FontDescriptor": {"MissingWidth": 250, "Flags": 1}})
    assert [(g.text, g.width) for g in f.decode(b"ABC ")] == [("Α", 500.0), ("é", 600.0), ("B", 250.0), (" ", 250.0)]
    assert (f.name, f.bold, f.italic, f.mono, f.space_width) == ("My-BoldOblique", True, True, True, 250.0)
    base14 = fonts.Font(s, {"Subtype": Name("Type1"), "BaseFont": Name("Helvetica")})
    assert base14.decode(b"W")[0].width == 944 and base14.space_width == 278
    kind3 = fonts.Font(s, {"Subtype": Name("Type3"), "FirstChar": 65, "Widths": [10], "FontMatrix": [0.01, 0, 0, 0.01, 0, 0]})
    assert kind3.decode(b"A")[0].width == 100
    below = {"W": [1, [300, 400], 7, 9, 555], "DW": 900}
    comp = fonts.Font(s, {"Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-V"), "DescendantFonts": [below], "ToUnicode": Stream({}, b"1 beginbfrange <0001> <0002> <0061> endbfrange")})
    assert [(g.text, g.width, g.cid) for g in comp.decode(b"\0\1\0\2\0\x08\0\5")] == [("a", 300, 1), ("b", 400, 2), ("", 555, 8), ("", 900, 5)] and comp.vertical
    assert fonts.Font(s, {"BaseFont": Name("Symbol")}).decode(b"A")[0].text == ""


def page_of(content, **more):
    s = Store(w.document([content], fonts={"F1": w.font(), "F2": w.font("Courier")}, **more))
    return read_page(s, 1)


def texts(content, **more):
    return [b.text for b in page_of(content, **more)[0].blocks]


def test_spaces_lines_and_paragraphs():
    assert texts(b"BT /F1 10 Tf 50 700 Td [(A) -100 (B) -150 (C)] TJ ET") == ["AB C"]
    assert texts(b"BT /F1 10 Tf 50 700 Td (one) Tj 0 -12 Td (two-) Tj 0 -12 Td (three) Tj 0 -40 Td (four) Tj ET") == ["one two-three", "four"]
    assert texts(b"BT /F1 10 Tf 50 700 Td (small) Tj 0 -12 Td /F1 14 Tf (large) Tj ET") == ["small", "large"]
    assert texts(b"BT /F1 10 Tf 12 TL 50 700 Td (a) Tj (b) \' 2 3 (c d) \" ET".replace(b"\\", b"")) == ["a b c d"]
    assert texts(b"BT /F1 10 Tf 62 700 Td (in) Tj -12 -12 Td (margin) Tj 0 -12 Td (margin) Tj 12 -12 Td (again) Tj ET") == ["in margin margin", "again"]


def test_marks_artifacts_and_hidden_text():
    content = b"/P <</MCID 4>> BDC BT /F1 10 Tf 50 700 Td (claimed) Tj ET EMC /Artifact BMC BT /F1 10 Tf 50 660 Td (header) Tj ET EMC BT /F1 10 Tf 3 Tr 50 620 Td (unseen) Tj ET"
    page, walk = page_of(content)
    assert [(b.text, b.mcids, b.spans[0].style.hidden) for b in page.blocks] == [("claimed", [4], False), ("unseen", [], True)]
    kept = blocks(walk.lines, walk.rules, Policy(keep_artifacts=True))
    assert [b.role for b in kept] == ["paragraph", "artifact", "paragraph"]
    s = Store(w.document([content]))
    shown = Walk(s, policy=Policy(keep_hidden=False))
    shown.run(s.content(s.pages[0]), s.dict(s.pages[0], "Resources"))
    assert [b.text for b in blocks(shown.lines, shown.rules)] == ["claimed"]


def test_runs_and_single_glyphs_agree():
    rng = random.Random(8)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 12)):
            text = w.literal("".join(rng.choice("ab cd-.e\x95W") for _ in range(rng.randint(0, 6))))
            parts.append(rng.choice([text + b" Tj", b"[" + text + b" %d " % rng.randint(-900, 200) + text + b"] TJ", b"%d Tc" % rng.randint(0, 2), b"%d Tw" % rng.randint(-1, 3), b"/F%d %d Tf" % (rng.randint(1, 2), rng.choice((8, 10))), b"%d %d Td" % (rng.randint(-9, 60), -rng.choice((0, 0, 12, 30))), b"80 Tz"]))
        s = Store(w.document([b"BT /F1 10 Tf 50 700 Td " + b" ".join(parts) + b" ET"], fonts={"F1": w.font(), "F2": w.font("Courier")}))
        shown = []
        for record in (False, True):
            page, walk = read_page(s, 1, record=record)
            shown.append([(sp.text, sp.style, [round(v, 6) for v in sp.box]) for b in page.blocks for sp in b.spans])
        assert shown[0] == shown[1], parts


def test_forms_states_and_rotation():
    out = w.Writer()
    root, tree = out.add(), out.add()
    font = out.add(w.font())
    form = out.stream(b"BT /F1 10 Tf 1 0 0 1 0 0 Tm (inside) Tj ET /Me Do", {"Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 10, 20]})
    page = out.add({"Type": Name("Page"), "Contents": out.stream(b"q 2 0 0 2 100 100 cm /Me Do Q BT 0 1 -1 0 300 300 Tm /F1 10 Tf (up) Tj ET"), "Resources": {"Font": {"F1": font}, "XObject": {"Me": form}, "Properties": {"M": {"MCID": 8}}}})
    out.put(tree, {"Kids": [page]})
    out.put(root, {"Pages": tree})
    page, walk = read_page(Store(out.finish({"Root": root})), 1, record=True)
    first = walk.placed[0]
    assert (first.text, round(first.along), round(first.cross), round(first.height)) == ("i", 120, 140, 20)
    assert walk.placed[-1].orient == 6 and page.blocks[-1].text == "up"


def test_rules_and_cuts():
    content = b"BT /F1 10 Tf 50 700 Td (left) Tj 100 0 Td (right) Tj ET 120 690 m 120 715 l S 0 0 m 5 5 l S 10 10 20 0 re f 1 1 m 9 1 l n"
    page, walk = page_of(content)
    assert [s.text.strip() for s in page.blocks[0].spans] == ["left", "right"]
    assert [(r.vertical, r.pos) for r in walk.rules] == [(True, 120.0), (False, 10.0), (False, 10.0)]


def test_image_samples():
    im = images.Image("x", 1, None, 3, 2, 4, data=bytes([0x0F, 0x70, 0x10]), components=1, family="DeviceGray")
    v, have = images.unpacked(im.data, 4, 3, 2)
    assert v.tolist() == [[0, 15, 7], [1, 0, 0]] and have == 5
    assert images.pixels(im)[..., 0].tolist() == [[0, 255, 119], [17, 0, 0]] and images.pixels(im)[1, 2].tolist() == [0, 0, 0, 0]
    palette = images.Image("p", 1, None, 2, 1, 8, data=b"\x01\x09", components=1, family="Indexed", base="DeviceRGB", highest=1, palette=b"\1\2\3\4\5\6")
    assert images.pixels(palette)[0, :, :3].tolist() == [[4, 5, 6], [4, 5, 6]]
    cmyk = images.Image("c", 1, None, 1, 1, 8, data=bytes([255, 0, 0, 0]), components=4, family="DeviceCMYK")
    assert images.pixels(cmyk)[0, 0].tolist() == [0, 255, 255, 255]
    mask = images.Image("m", 1, None, 1, 1, 8, data=b"\x80", components=1, matte=[0.5, 0.5, 0.5])
    soft = images.Image("s", 1, None, 1, 1, 8, data=bytes([191, 128, 64]), components=3, family="DeviceRGB", mask=mask)
    assert soft.premultiplied and soft.recoverable and np.abs(images.pixels(soft)[0, 0].astype(int) - [254, 128, 0, 128]).max() <= 1
    raw = images.png(images.pixels(palette))
    rows = zlib.decompress(raw[raw.index(b"IDAT") + 4 : raw.index(b"IEND") - 8])
    assert rows == b"\0" + bytes([4, 5, 6, 255, 4, 5, 6, 255])
    assert images.encoded(images.Image("j", 1, None, 1, 1, codec="jbig2")) is None and images.encoded(images.Image("?", 1, None, 1, 1)) is None
    lab = images.lab_to_rgb(np.array([[[1.0, 128 / 255, 128 / 255]], [[0.0, 128 / 255, 128 / 255]]]))
    assert lab[0].min() > 0.97 and lab[1].max() < 0.01
