"""A bundle of linked Markdown files: one for each section, an index for each folder, and what no section holds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from quirefold.document import markdown as M
from quirefold.document import words as W
from quirefold.document.model import Block, Outline, Section

LEFT_OVER = "Text the reconstruction could not attribute to any clause. It is kept here rather than dropped or filed under a clause it may not belong to."
BEFORE = "Content before the first heading of the source. Its place in the structure isn't known."


@dataclass(frozen=True)
class Options:
    type: str = "PDF Spec Clause"
    doc_id: str = ""
    generator: str = "quirefold"
    generated_at: str = ""
    artifacts: bool = False
    preamble: bool = True
    unplaced: bool = True


class Layout:
    """The path of each section: one with kids lives inside its own folder."""

    def __init__(self, o: Outline):
        self.file: dict[int, str] = {}
        self.folder: dict[int, str] = {}
        self._assign(o.sections, "/", "", {"index", "log", "front-matter"})

    def _assign(self, sections: list[Section], folder: str, parent: str, taken: set[str]) -> None:
        names = [W.unique(taken, W.fitting(folder, W.names_for(s.number, s.title, parent, i))) for i, s in enumerate(sections)]
        for s, name in zip(sections, names, strict=True):
            at = folder.rstrip("/") + "/" + name
            if s.kids:
                self.folder[id(s)] = at
                self.file[id(s)] = f"{at}/{name}.md"
                self._assign(s.kids, at, s.number, {"index", name})
            else:
                self.file[id(s)] = at + ".md"

    def resource(self, doc: str, s: Section) -> str:
        return f"{doc}#{s.number or self.file[id(s)].removeprefix('/').removesuffix('.md')}"


# cross references

def is_cued(before: str) -> bool:
    """Whether the text before a number says that it is a reference: a word for one, or a section sign, and white space."""
    end = before.rstrip(" \t")
    if end == before:
        return False
    word = re.search(r"[A-Za-z]*$", end)[0]
    return word.lower() in ("clause", "clauses", "subclause", "subclauses", "annex", "annexes", "see") if word else end.endswith("§")


def starts_reference(line: str, i: int) -> bool:
    """A digit or capital at a place that doesn't go on a word or number."""
    c, before = line[i], line[i - 1] if i else ""
    if not (c.isascii() and (c.isdigit() or c.isupper())):
        return False
    return not (before.isascii() and before.isalnum()) and before not in (".", "-") if before else True


_STEP = re.compile(r"`+|\\.|(?<=\])\([^)]*\)?|(?<![0-9A-Za-z.\-])[0-9A-Z]", re.S)


def link_line(line: str, paths: dict[str, str], own: str) -> tuple[str, int]:
    """The line with references to sections as links; code, escapes and targets of links stay as they are."""
    out, at, code, n = [], 0, False, 0
    while m := _STEP.search(line, at):
        out.append(line[at : m.start()])
        at, c = m.end(), m[0]
        if c[0] == "`":
            code = not code
        elif not code and len(c) == 1 and starts_reference(line, m.start()) and (number := W.reference_number(line, m.start())):
            at = m.start() + len(number)
            path, c = paths.get(number), number
            if path and path != own and is_cued(line[: m.start()]):
                c, n = f"[{number}]({path})", n + 1
        out.append(c)
    return "".join([*out, line[at:]]), n


def fence_length(line: str) -> int:
    t = line.rstrip(" ")
    return len(t) if len(t) >= 3 and not t.strip("`") else 0


def link(text: str, paths: dict[str, str], own: str) -> tuple[str, int]:
    """The same over all lines outside of fenced code, and the number of links."""
    out, fence, total = [], 0, 0
    for line in text.split("\n"):
        if f := fence_length(line):
            fence = f if not fence else 0 if f >= fence else fence
        elif not fence and paths:
            line, n = link_line(line, paths, own)
            total += n
        out.append(line)
    return "\n".join(out), total


# files


def _front(type: str, title: str, description: str, resource: str, tags: list[str], source: dict[str, str], opt: Options, extra: list[tuple[str, str]]) -> str:
    rows = [f"{k}: {M.yaml(v)}" for k, v in (("type", type), ("title", title), ("description", description), ("resource", resource)) if v]
    if tags:
        rows += ["tags:", *(f"  - {M.yaml(t)}" for t in tags)]
    if source.get("resource"):
        rows += ["sources:", f"  - resource: {M.yaml(source['resource'])}", *(f"    {k}: {M.yaml(source[k])}" for k in ("title", "author", "last_modified") if source.get(k))]
    if opt.generator:
        rows += ["generated:", f"  by: {M.yaml(opt.generator)}", *([f"  at: {M.yaml(opt.generated_at)}"] if opt.generated_at else [])]
    rows += ["status: draft", *(f"{k}: {M.yaml(v)}" for k, v in extra if v)]
    return "---\n" + "\n".join(rows) + "\n---\n\n"


def _join(parts: list[str]) -> str:
    return "\n".join(p.strip("\n") + "\n" for p in parts if p.strip("\n"))


class Bundle:
    """files() gives paths and contents in order of path; stats has their numbers."""

    def __init__(self, o: Outline, opt: Options | None = None):
        self.o, self.opt, self.layout = o, opt or Options(), Layout(o)
        self.id = self.opt.doc_id or W.doc_id(o.meta)
        self.paths: dict[str, str] = {}
        for s in o.walk():
            if s.number:
                self.paths.setdefault(s.number, self.layout.file[id(s)])
        meta = o.meta
        path = (meta.get("path") or "").replace("\\", "/")
        self.name = W.collapse(meta.get("title") or "") or path.rsplit("/", 1)[-1]
        self.source = {"resource": path, "title": W.collapse(meta.get("title") or ""), "last_modified": W.iso_date(meta.get("modified") or "")} if path else {}
        self.stats = {"concepts": 0, "indexes": 0, "links": 0, "dirs": 0}
        self.top: list[tuple[str, str, str]] = []  # path, title, description
        self._files: dict[str, str] = {}
        for s in o.walk():
            self._concept(s)
        self._loose()
        self._indexes()
        self._log()

    def files(self) -> Iterator[tuple[str, str]]:
        yield from sorted(self._files.items())

    def _add(self, path: str, content: str) -> None:
        if path in self._files:
            raise ValueError(f"two files for {path}")
        self._files[path] = content

    def _body(self, blocks: list[Block], own: str) -> str:
        text, n = link(M.of_blocks(blocks, self.opt.artifacts), self.paths, own)
        self.stats["links"] += n
        return text

    def _provenance(self, pages: str) -> str:
        return f"---\n\nSource: {M.escape(self.name) + ', ' if self.name else ''}{pages}.\n" if pages else ""

    def _entry(self, s: Section) -> tuple[str, str, str]:
        return self.layout.file[id(s)], W.collapse(s.title), W.describe(s.blocks)

    def _concept(self, s: Section) -> None:
        own, title, description = self._entry(s)
        extra = [("pdf_clause", s.number), ("pdf_page", str(s.first_page) if s.first_page else ""), ("pdf_page_last", str(s.last_page) if s.last_page > s.first_page > 0 else "")]
        above = [t for t in map(W.collapse, s.path()[:-1]) if t]
        front = _front(self.opt.type, title, description, self.layout.resource(self.id, s), above, self.source, self.opt, extra)
        kids = "".join(f"- [{M.link_label(W.collapse(k.title))}]({self.layout.file[id(k)]})\n" for k in s.kids)
        parts = ["# " + M.escape(title), self._body(s.blocks, own), "## Subclauses\n\n" + kids if kids else "", self._provenance(W.fmt_pages(s.first_page, s.last_page))]
        self._add(own, front + _join(parts))
        self.stats["concepts"] += 1
        if s.parent is None:
            self.top.append((own, title, description))

    def _loose(self) -> None:
        todo: list[tuple[str, str, str, list[Block], str]] = []
        if self.opt.preamble and self.o.preamble:
            todo.append(("/front-matter.md", "Front matter", BEFORE, self.o.preamble, ""))
        for p in self.o.unplaced if self.opt.unplaced else ():
            todo.append((f"/unplaced/page-{p.number:04d}.md", f"Unplaced text, page {p.number}", LEFT_OVER, p.blocks, f"page {p.number}" if p.number > 0 else ""))
        for path, title, note, blocks, pages in todo:
            body = self._body(blocks, path)
            if not body:
                continue
            resource = f"{self.id}#{path.removeprefix('/').removesuffix('.md')}"
            front = _front(self.opt.type, title, note, resource, [], self.source, self.opt, [("pdf_unattributed", "true")])
            self._add(path, front + _join(["# " + M.escape(title), body, self._provenance(pages)]))
            self.stats["concepts"] += 1
            self.top.append((path, title, note))

    def _index(self, folder: str, head: str, entries: list[tuple[str, str, str]]) -> None:
        rows = "".join(f"* [{M.link_label(t)}]({p}){' - ' + M.escape(W.collapse(d)) if d else ''}\n" for p, t, d in entries)
        self._add(folder.rstrip("/") + "/index.md", head + rows)
        self.stats["indexes"] += 1

    def _indexes(self) -> None:
        self._index("/", f'---\nokf_version: "0.2"\n---\n\n# {M.escape(self.name or self.id)}\n\n', self.top)
        for s in self.o.walk():
            if s.kids:
                self.stats["dirs"] += 1
                self._index(self.layout.folder[id(s)], "# Contents\n\n", [self._entry(s), *map(self._entry, s.kids)])
        if left := [e for e in self.top if e[0].startswith("/unplaced/")]:
            self.stats["dirs"] += 1
            self._index("/unplaced", "# Unplaced text\n\n", left)

    def _log(self) -> None:
        date = self.opt.generated_at.split("T")[0]
        if re.fullmatch(r"[12][0-9]{3}-[0-9]{2}-[0-9]{2}", date):
            text = f"* **Creation**: Generated {self.stats['concepts']} concept documents from {M.escape(self.name or 'a PDF')} by {self.opt.generator}.\n"
            self._add("/log.md", f"# Update Log\n\n## {date}\n\n" + text)


def bundle(o: Outline, opt: Options | None = None) -> tuple[list[tuple[str, str]], dict[str, Any]]:
    b = Bundle(o, opt)
    return list(b.files()), b.stats
