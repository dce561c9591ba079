"""Layout, tags, outlines, Markdown, bundles and recognised text of one document, and the rules that exist twice."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.document import bundle, doctags, layout, markdown, outline, tags
from quirefold.document import words as W
from quirefold.document.model import Block, Cell, Document, Outline, Page, Rule, Section, Span, Style
from quirefold.functions import scalars as S

BODY, BIG, BOLD, MONO = Style("F", 10.0), Style("F", 14.0), Style("F", 10.0, bold=True), Style("M", 10.0, mono=True)


def para(text, style=BODY, x=72.0, y=700.0, role="paragraph", **more):
    return Block(role, [Span(text, style, (x, y, x + 5 * max(len(text), 1), y + 10))], **more)


def test_roles_from_geometry():
    doc = Document([Page(1, blocks=[para("1 Scope", BIG), para("some long body text of the page " * 3), para("1.1 Terms", BOLD), para("• a"), para("• b", x=90), para("◦ c", x=90.5), para("1. x"), para("2. y"), para("2. z"), para("A.2 Annex", BIG), para("No number", BIG)])])
    layout.infer_roles(doc)
    got = [(b.role, b.level, b.marker, b.text) for b in doc.pages[0].blocks]
    assert got[0] == ("heading", 1, "", "1 Scope") and got[2][:2] == ("heading", 2) and got[9][:2] == ("heading", 2) and got[10][0] == "paragraph"
    assert [g[1:] for g in got[3:6]] == [(1, "•", "a"), (2, "•", "b"), (2, "◦", "c")]
    assert [g[0] for g in got[6:9]] == ["list_item", "list_item", "paragraph"] and got[6][2:] == ("1.", "x")


def test_tables_keep_what_is_beside_them():
    cell = lambda t, r, c: Span(t, BODY, (100 + 50 * c, 600 - 20 * r, 130 + 50 * c, 610 - 20 * r))
    rows = [cell(f"{r}{c}", r, c) for r in range(3) for c in range(3)]
    text = Span("before", BODY, (100, 650, 160, 660))
    rules = [Rule(True, x, 500, 615) for x in (140.0, 190.0)]
    doc = Document([Page(1, blocks=[Block("paragraph", [text, *rows]), para("after")], rules=rules)])
    assert layout.tables(doc) == {"tables": 1, "rows": 3, "cells": 9}
    got = doc.pages[0].blocks
    assert [b.text for b in got] == ["before", *[s.text for s in rows], "after"]
    assert [b.cell for b in got[1:10]] == [Cell(1, r, c, r == 0) for r in range(3) for c in range(3)]
    assert layout.tables(Document([Page(1, blocks=[Block("paragraph", rows)])])) == {"tables": 0, "rows": 0, "cells": 0}


def element(role, *inside, **more):
    e = tags.Element(role, role, inside=list(inside), **more)
    for x in e.kids:
        x.parent = e
    return e


def claimed(*texts, y=700.0):
    spans, x = [], 72.0
    for i, t in enumerate(texts):
        spans.append(Span(t, BODY, (x, y - 20 * i, x + 5 * len(t), y - 20 * i + 10), mcid=i))
    return Document([Page(1, blocks=[Block("paragraph", [s]) for s in spans])])


def test_tagged_outline():
    c = lambda i: tags.Claim(i, 1)
    doc = claimed("Intro", "1 Scope", "body", "• item", "a.", "labelled", "th", "td", "left over", "code 1", "code 2")
    root = element("StructTreeRoot", element("Document", c(0), element("H1", c(1)), element("P", c(2)), element("L", element("LI", element("LBody", c(3))), element("LI", element("Lbl", c(4)), element("LBody", c(5)))), element("Table", element("TR", element("TH", c(6)), element("TD", c(7)))), element("Code", c(9), c(10)), element("Figure", alt="a picture")))
    o = outline.tagged(doc, root)
    assert [b.text for b in o.preamble] == ["Intro"] and [(s.title, s.number) for s in o.sections] == [("1 Scope", "1")]
    got = [(b.role, b.level, b.marker, b.text) for b in o.sections[0].blocks]
    assert got == [("paragraph", 0, "", "body"), ("list_item", 1, "•", "item"), ("list_item", 1, "a.", "labelled"), ("table_cell", 0, "", "th"), ("table_cell", 0, "", "td"), ("code", 0, "", "code 1\ncode 2"), ("figure", 0, "", "")]
    assert [b.cell for b in o.sections[0].blocks if b.cell] == [Cell(1, 0, 0, True), Cell(1, 0, 1, False)]
    assert [(p.number, [b.text for b in p.blocks]) for p in o.unplaced] == [(1, ["left over"])]
    text = markdown.of_outline(o)
    assert "# 1 Scope" in text and "- item\n- a. labelled\n" in text and "| th | td |\n| --- | --- |" in text and "```\ncode 1\ncode 2\n```" in text and "*a picture*" in text and "page 1 belongs to no clause" in text
    before = sum(len(b.text) for p in claimed("Intro").pages for b in p.blocks)
    assert before == 5  # nothing is lost: every claimed text is somewhere once
    whole = "".join(b.text for b in [*o.preamble, *o.sections[0].blocks, *o.unplaced[0].blocks])
    for t in ("Intro", "body", "item", "labelled", "th", "td", "left over", "code 1", "code 2"):
        assert whole.count(t) == 1


def test_replacements_gaps_and_order():
    doc = Document([Page(1, blocks=[Block("paragraph", [Span("ab", BODY, (72, 700, 82, 710), 0), Span("cd", BODY, (90, 700, 100, 710), 1), Span("x", BODY, (0, 650, 9, 660), 2), Span("first", BODY, (0, 640, 9, 650), 3)])])])
    c = lambda i: tags.Claim(i, 1)
    o = outline.tagged(doc, element("StructTreeRoot", element("P", c(0), c(1)), element("P", element("Span", c(2), actual="re\u00adplaced\r\ntext")), element("P", c(3), c(0))))
    assert [b.text for b in o.preamble] == ["ab cd", "replaced text", "first"]
    h = element("Sect", element("Sect", element("H")))
    assert h.kids[0].kids[0].heading_level() == 2 and tags.normalized("X", {"X": "Y", "Y": "Z"}) == "Z" and tags.normalized("X", {"X": "Y", "Y": "X"}) in "XY"


def test_markdown_escapes():
    cases = {"*a_b_ c~d": "\\*a_b\\_ c~d", "[x](y) [z]": "\\[x](y) [z]", "a <b> << 3 <3": "a \\<b> << 3 <3", "x &amp; & y": "x &amp;amp; & y", "![i]": "\\![i]", "\x01": "\ufffd", "é_é": "é_é"}
    assert {k: markdown.escape(k) for k in cases} == cases
    starts = {"# h": "\\# h", "12. x": "12\\. x", "12.x": "12.x", "- x": "\\- x", "a # b": "a # b", "7) y": "7\\) y", "= =": "\\= ="}
    assert {k: markdown.escape(k, True) for k in starts} == starts


def test_inline_styles():
    spans = [Span("plain ", BODY), Span(" bold ", BOLD), Span("both", Style("F", 10, True, True)), Span(" ", BODY), Span("co`de", MONO)]
    assert markdown.inline(spans) == "plain  **bold** ***both*** ``co`de``"
    assert markdown.inline([Span("`x|", MONO)], cell=True) == "`` `x\\| ``" and markdown.inline(spans, plain=True).count("*") == 0
    assert markdown.content(Block("heading", [Span("1 A", BOLD), Span(" ", BODY), Span("B", BOLD)]), markdown.uniform_emphasis(Block("heading", [Span("1 A", BOLD), Span("B", BOLD)]))) == "1 A B"


def item(text, level=1, marker=""):
    return para(text, role="list_item", level=level, marker=marker)


def test_list_state():
    text = markdown.of_blocks([item("a"), item("b", 2), item("c", 3), item("d", 2, "1."), item("e"), para("p"), item("f", 3, "2."), item("g", 2, "2."), item("h", 1), item("i", 1, "iv.")])
    assert text == "- a\n  - b\n    - c\n  1. d\n- e\n\np\n\n2. f\n   2. g\n- h\n- iv. i\n"


def test_table_cells_that_meet():
    cell = lambda t, r, c, h=False: Block("table_cell", [Span(t)], cell=Cell(1, r, c, h))
    text = markdown.of_blocks([cell("a", 0, 0, True), cell("b", 1, 0), cell("c", 1, 0), cell("d|", 2, 2), para("end")])
    assert text == "| a |  |  |\n| --- | --- | --- |\n| b | c |  |\n|  |  | d\\| |\n\nend\n"
    assert markdown.of_blocks([cell("a", 3, 0)]) == "|  |\n| --- |\n| a |\n"


def test_yaml():
    plain = ["plain text", "a:b", "x#y", "1_000", "0x1F", "+nan", ".inf", "é"]
    assert [markdown.yaml(t) for t in plain] == plain
    quoted = ["", " x", "- x", "a: b", "x #y", "back\\slash", "Yes", "~", "12", "1e3", "-.5", "0x1p3", "Infinity", "nan", "a:", "tab\there", "nel\x85", "bell\x07"]
    assert all(markdown.yaml(t)[0] == '"' for t in quoted)
    assert markdown.yaml('say "x"\n\x07\u2028') == '"say \\"x\\"\\n\\x07\\L"' or markdown.yaml('x\n\x07\u2028') == '"x\\n\\x07\\L"'


def test_links():
    paths = {"7.4": "/a.md", "A.2": "/b.md"}
    one = lambda t: bundle.link(t, paths, "/self.md")[1]
    assert [one(t) for t in ("clause 7.4", "See 7.4 and see A.2", "annex A.2.", "§ 7.4", "§7.4", "clause7.4", "table 7.4", "clause 7.4.1", "clause 9.9", "`see 7.4`", "[x](see 7.4)", "see 17.4", "```\nsee 7.4\n```\nsee 7.4")] == [1, 2, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert bundle.link("see 7.4.", paths, "/a.md") == ("see 7.4.", 0) and bundle.link("see 7.4.", paths, "")[0] == "see [7.4](/a.md)."


def section(title, level, *kids, number="", blocks=()):
    s = Section(title, level, number or W.clause_number(title), list(blocks), list(kids), first_page=1, last_page=2)
    for k in kids:
        k.parent = s
    return s


def test_bundle_links_are_resolvable():
    o = Outline({"title": "ISO 19005-1:2005 x", "path": "dir/file.pdf", "modified": "D:20240131"}, [section("1 Scope", 1, section("1.1 Terms", 2, blocks=[para("see 2.1")]), section("1.1 Terms", 2)), section("2 More", 1, section("2.1 Deep", 2)), section("", 1)], [para("front")], [Page(7, blocks=[para("lost")])])
    files, stats = bundle.bundle(o, bundle.Options(generated_at="2024-05-06T07:08"))
    paths = dict(files)
    assert list(paths) == sorted(paths) and {"/index.md", "/log.md", "/front-matter.md", "/unplaced/page-0007.md", "/1-scope/1-1-terms-2.md", "/2-more/2-more.md", "/section-3.md"} <= set(paths)
    targets = [t for text in paths.values() for t in re.findall(r"\]\((/[^)]*)\)", text)]
    assert targets and set(targets) <= set(paths) and stats["links"] == 1 and stats["concepts"] == 8
    assert "resource: iso19005-1:2005#1.1" in paths["/1-scope/1-1-terms.md"] and "tags:\n  - 1 Scope" in paths["/1-scope/1-1-terms.md"] and "last_modified: 2024-01-31" in paths["/section-3.md"]
    assert "pages 1–2" in paths["/1-scope/1-scope.md"] and "## Subclauses" in paths["/1-scope/1-scope.md"]


def test_doctags():
    pages = doctags.parse("<doctag><title><loc_0><loc_0><loc_500><loc_10>T</title><page_break/><text>a</text><page_break></doctag>", (0.0, 0.0, 100.0, 200.0))
    assert [[b.text for b in p.blocks] for p in pages] == [["<loc_500>T"], ["a"]] and all(p.rasterized for p in pages)
    page = doctags.parse_page("<list_item>x<text><loc_100><loc_50><loc_200><loc_100>in</text></list_item><chart><bar_chart><ched>h<nl><fcel>v</chart></odd><b>loose</b>", 3, (0.0, 0.0, 100.0, 200.0))
    assert [(b.role, b.text) for b in page.blocks] == [("paragraph", "in"), ("list_item", "x"), ("table_cell", "h"), ("table_cell", "v"), ("paragraph", "</odd><b>loose</b>")]
    assert page.blocks[0].own_box == (20.0, 160.0, 40.0, 180.0)
    with pytest.raises(ValueError):
        doctags.parse_page("a<page_break>b", 1, (0, 0, 1, 1))
    with pytest.raises(ValueError):
        doctags.parse("<text>" * 70)


TEXT = st.text(st.sampled_from("aB1.!? \t\n-•#:\\\"'_[]<&é漢\u00a0~*0x"), max_size=60)


@settings(max_examples=15, deadline=None)
@given(st.lists(TEXT, min_size=20, max_size=40))
def test_column_rules_equal_plain_ones(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    rules = {
        "sentence": (S.first_sentence(c), W.first_sentence), "kebab": (S.kebab(c), W.kebab), "yaml": (S.yaml_string(c), markdown.yaml), "number": (S.clause_number(c), lambda t: W.clause_number(t) or None),
        "level": (S.numbered_level(c), lambda t: W.numbered_level(t) or None), "annex": (S.annex_level(c), lambda t: W.annex_level(t) or None), "bullet": (S.list_marker(c), lambda t: W.bullet(t) or None),
        "inline": (S.inline_text(c), W.inline_text), "iso": (S.iso_id(c), lambda t: W.iso_id(t) or None), "cut": (S.truncate(c, 20), lambda t: W.truncate(t, 20)),
        "ref": (S.reference_number(c), lambda t: W.reference_number(t) or None), "cued": (S.is_cued(c), bundle.is_cued), "label": (S.ordered_label(c), lambda t: W.ordered_label(t)[0] or None),
    }
    rows = df.select("i", "t", *[col.alias(k) for k, (col, _) in rules.items()]).collect()
    for r in rows:
        for k, (_, fn) in rules.items():
            assert r[k] == fn(r["t"]), (k, r["t"])
