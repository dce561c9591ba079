"""The tree of tags of a file: elements with roles, texts and the marked content that they claim."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from quirefold.sources.pdf.encodings import text_string
from quirefold.sources.pdf.objects import Store, as_list, as_number
from quirefold.sources.pdf.tokens import Name, Ref

MAX_DEPTH, MAX_ROLE_HOPS = 512, 8
HEADINGS = {"H1": 1, "H2": 2, "H3": 3, "H4": 4, "H5": 5, "H6": 6}
GROUPS = {"Document", "Part", "Art", "Sect", "Div", "NonStruct"}
BLOCK_ROLES = {
    "P": "paragraph", "Formula": "paragraph", "LI": "list_item", "TOCI": "list_item", "TD": "table_cell", "TH": "table_cell", "Code": "code", "BlockQuote": "quote", "Caption": "caption",
    "Figure": "figure", "Artifact": "artifact",
}


@dataclass
class Claim:
    """Marked content of a page that an element claims."""

    mcid: int
    page: int = 0
    page_ref: int | None = None


@dataclass
class Element:
    role: str
    raw: str
    parent: Element | None = None
    title: str = ""
    lang: str = ""
    actual: str = ""
    alt: str = ""
    page: int = 0
    page_ref: int | None = None
    #: claims and elements in the order of the file
    inside: list[Claim | Element] = field(default_factory=list)

    @property
    def kids(self) -> list[Element]:
        return [x for x in self.inside if isinstance(x, Element)]

    @property
    def claims(self) -> list[Claim]:
        return [x for x in self.inside if isinstance(x, Claim)]

    def is_heading(self) -> bool:
        return self.role == "H" or self.role in HEADINGS

    def above(self) -> Iterator[Element]:
        e = self.parent
        while e:
            yield e
            e = e.parent

    def heading_level(self) -> int:
        """That of the role; a plain H is as deep as the groups around it, documents aside."""
        if self.role != "H":
            return HEADINGS.get(self.role, 0)
        return min(max(sum(e.role in GROUPS and e.role != "Document" for e in self.above()), 1), 6)

    def list_depth(self) -> int:
        return max((self.role == "L") + sum(e.role == "L" for e in self.above()), 1)


def normalized(role: str, role_map: dict[str, str]) -> str:
    for _ in range(MAX_ROLE_HOPS):
        if role_map.get(role, role) == role:
            break
        role = role_map[role]
    return role


def walk(e: Element, depth: int = 0) -> Iterator[tuple[Element, int]]:
    """Elements with their depth, parents first."""
    todo = [(e, depth)]
    while todo:
        e, depth = todo.pop()
        yield e, depth
        todo += [(k, depth + 1) for k in reversed(e.kids)]


def read(store: Store) -> Element | None:
    """The root of the tree with all pages known; None for a file without one."""
    top = store.dict(store.catalog, "StructTreeRoot")
    if top is None:
        return None
    role_map = {str(k): str(v) for k, v in (store.dict(top, "RoleMap") or {}).items() if isinstance(v, Name)}
    seen: set[int] = set()
    root = Element("StructTreeRoot", "StructTreeRoot")
    todo = [(top, root, 0)]
    while todo:
        info, parent, depth = todo.pop()
        for item in as_list(store.get(info, "K")):
            if isinstance(item, Ref):
                if item.num in seen:
                    continue
                seen.add(item.num)
            kid = store.resolve(item)
            if isinstance(kid, int) and not isinstance(kid, bool):
                parent.inside.append(Claim(kid))
            elif isinstance(kid, dict):
                _kid(store, kid, parent, role_map, todo, depth)
    _pages(store, root)
    return root


def _kid(store: Store, info: dict, parent: Element, role_map: dict[str, str], todo: list, depth: int) -> None:
    page = info["Pg"].num if isinstance(info.get("Pg"), Ref) else None
    kind = store.name(info, "Type")
    if kind == "MCR":
        mcid = as_number(store.get(info, "MCID"))
        if mcid is not None:
            parent.inside.append(Claim(int(mcid), page_ref=page))
        return
    raw = store.name(info, "S")
    if kind == "OBJR" or raw is None:
        return
    text = lambda key: text_string(store.get(info, key))
    e = Element(normalized(raw, role_map), raw, parent, text("T"), text("Lang"), text("ActualText"), text("Alt"), page_ref=page)
    parent.inside.append(e)
    if depth < MAX_DEPTH:
        todo.append((info, e, depth + 1))


def _pages(store: Store, root: Element) -> None:
    """Page numbers from references; what has none takes that of the element around it."""
    number = {p["__ref"]: i for i, p in enumerate(store.pages, 1) if p["__ref"] is not None}
    for e, _ in walk(root):
        e.page = number.get(e.page_ref, e.parent.page if e.parent else 0)
        for c in e.claims:
            c.page = number.get(c.page_ref, e.page)


def stats(root: Element) -> dict[str, object]:
    out = {"elements": 0, "headings": 0, "paragraphs": 0, "tables": 0, "figures": 0, "lists": 0, "mcids": 0, "max_depth": 0}
    roles: dict[str, int] = {}
    for e, depth in walk(root):
        roles[e.role] = roles.get(e.role, 0) + 1
        kind = "headings" if e.is_heading() else {"P": "paragraphs", "Table": "tables", "Figure": "figures", "L": "lists"}.get(e.role)
        if kind:
            out[kind] += 1
        out["elements"] += 1
        out["mcids"] += len(e.claims)
        out["max_depth"] = max(out["max_depth"], depth)
    return out | {"roles": roles}


def top_roles(roles: dict[str, int], most: int = 6) -> dict[str, int]:
    return dict(sorted(roles.items(), key=lambda x: (-x[1], x[0]))[:most])


def cell_place(e: Element, tables: dict[int, int]) -> tuple[int, int, int, bool] | None:
    """Table number (in order of first cells), row, column and header of a cell; None where rows or table are missing.

    tables: the numbers so far, by the identity of the table.
    """
    row = next((x for x in e.above() if x.role in ("TR", "Table")), None)
    table = next((x for x in e.above() if x.role == "Table"), None)
    if table is not None:
        tables.setdefault(id(table), len(tables) + 1)
    if row is None or row.role != "TR" or table is None or e not in row.kids:
        return None
    col = sum(k.role in ("TD", "TH") for k in row.kids[: next(i for i, k in enumerate(row.kids) if k is e)])
    rows = [x for k in table.kids for x in (k.kids if k.role in ("THead", "TBody", "TFoot") else [k]) if x.role == "TR"]
    at = next((i for i, x in enumerate(rows) if x is row), len(rows))
    return tables[id(table)], at, col, e.role == "TH"
