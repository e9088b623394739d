"""Pages as rows: sections, tables with spans, definition lists, boards, schedules.

The standard library's parser builds a small tree; readers turn it into rows and run in
``mapInPandas`` over pages, so a page's failure to be parsed is a row's, never the job's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript template head nav footer header aside form".split())
#: End tags that may be missing: what an opening tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What ``sections`` makes rows of.
READ = frozenset((*HEADINGS, "table", "dl", "ul", "ol", "p"))
MOST_SPAN, LEAST_PARAGRAPH = 20, 25


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags and n is not self]

    def text(self, own: bool = False) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag == "br":
                parts.append("\n")
            elif node is self or not own or node.tag not in ("ul", "ol", "table", "dl"):
                if node.tag not in SKIPPED:
                    stack.extend(reversed(node.children))
        if len(parts) == 1 and "\n" not in parts[0]:
            return " ".join(parts[0].split())
        return "\n".join(x for line in "".join(parts).split("\n") if (x := " ".join(line.split())))

    def inside(self, *tags: str) -> bool:
        node = self.parent
        while node:
            if node.tag in tags:
                return True
            node = node.parent
        return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("page", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = CLOSES.get(tag, ())
        while self.at.tag in closes:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def span(cell: Node, name: str, most: int | None = MOST_SPAN) -> int:
    """A span of at least one; nonsense counts as one, and no span is over ``most``."""
    raw = cell.attrs.get(name, "1").strip()
    n = int(raw) if raw.isdigit() and int(raw) > 0 else 1
    return n if most is None else min(n, most)


def grid(table: Node, most: int | None = MOST_SPAN) -> list[list[tuple[str, bool]]]:
    """Rows of a table with spans written out: text, and whether the cell begins there."""
    rows, hanging = [], {}
    for tr in (n for n in table.find("tr") if _nearest(n, "table") is table):
        row, at = [], 0
        cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
        while cells or at in hanging:
            if at in hanging:
                text, left = hanging.pop(at)
                row.append((text, False))
                if left > 1:
                    hanging[at] = (text, left - 1)
                at += 1
                continue
            cell = cells.pop(0)
            text, down = cell.text(), span(cell, "rowspan", most)
            for k in range(span(cell, "colspan", most)):
                row.append((text, k == 0))
                if down > 1:
                    hanging[at] = (text, down - 1)
                at += 1
        rows.append(row)
    return rows


def _nearest(node: Node, tag: str) -> Node | None:
    while node and node.tag != tag:
        node = node.parent
    return node


def table_label(table: Node, fallback: str) -> str:
    """The caption, else the summary, else the heading before the table."""
    for caption in table.find("caption"):
        if caption.text():
            return caption.text()
    return table.attrs.get("summary", "").strip() or fallback


def sections(html: str) -> list[dict]:
    """A page's blocks: quotes (whole tables, lists, definition lists) and leaves under them."""
    root, out, path, key = parse(html), [], [], 0

    def add(kind: str, text: str, leaf: bool, parent: int | None) -> int:
        nonlocal key
        out.append({"ordinal": key, "kind": kind, "path": " > ".join(t for _, t in path), "text": text, "is_leaf": leaf, "parent": parent, "depth": 0 if parent is None else 1})
        key += 1
        return key - 1

    def lists(node: Node, parent: int | None) -> None:
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        whole = add("list", "\n".join(i.text() for i in items), False, parent)
        for item in items:
            inner = [c for c in item.walk() if c.tag in ("ul", "ol") and c is not item and _nearest_list(c) is item]
            own = item.text(own=True)
            if inner:
                branch = add("list_branch", item.text(), False, whole)
                if own:
                    add("list_item", own, True, branch)
                for sub in inner:
                    lists(sub, branch)
            elif own:
                add("list_item", own, True, whole)

    for node in root.walk():
        if node.tag not in READ or node.inside(*SKIPPED):
            continue
        if node.tag in HEADINGS:
            level = int(node.tag[1])
            path[:] = [(n, t) for n, t in path if n < level] + ([(level, node.text())] if node.text() else [])
        elif node.tag == "table" and not node.inside("table"):
            rows = grid(node)
            if len(rows) >= 2:
                label = table_label(node, path[-1][1] if path else "")
                whole = add("table", "\n".join(" | ".join(t for t, _ in r) for r in rows), False, None)
                head = [t for t, _ in rows[0]]
                for row in rows[1:]:
                    pairs = [f"{h}: {t}" if h and h != t else t for h, (t, _) in zip(head + [""] * len(row), row, strict=False) if t]
                    add("table_row", ": ".join(x for x in (label, " | ".join(pairs)) if x), True, whole)
        elif node.tag == "dl":
            pairs = definitions(node)[0]
            if len(pairs) >= 2:
                whole = add("deflist", "\n".join(f"{a}: {b}" for a, b in pairs), False, None)
                for a, b in pairs:
                    add("definition", f"{a}: {b}", True, whole)
        elif node.tag in ("ul", "ol") and not node.inside("ul", "ol", "table", "dl"):
            lists(node, None)
        elif node.tag == "p" and not node.inside("table", "ul", "ol", "dl"):
            text = node.text()
            if len(text) >= LEAST_PARAGRAPH:
                add("paragraph", text, True, None)
    if not out and (text := root.text()):
        add("page", text, True, None)
    return out


def _nearest_list(node: Node) -> Node | None:
    node = node.parent
    while node and node.tag not in ("li", "ul", "ol"):
        node = node.parent
    return node


def definitions(dl: Node) -> tuple[list[tuple[str, str]], bool]:
    """Terms with their definitions in page order, and whether every term has one."""
    pairs, term, whole = [], None, True
    for node in dl.find("dt", "dd"):
        if node.tag == "dt":
            whole = whole and term is None
            term = node.text()
        elif term is None:
            whole = False
        else:
            pairs.append((term, node.text()))
            term = None
    return pairs, whole and term is None


def board(html: str) -> list[dict]:
    """Rows of a notice list: a link with a title, and a date in the same row."""
    out = []
    for tr in parse(html).find("tr", "li"):
        links = [a for a in tr.find("a") if a.text()]
        date = re.search(r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", tr.text())
        if links and date:
            a = max(links, key=lambda x: len(x.text()))
            onclick = re.search(r"['\"(](\d+)['\")]", a.attrs.get("onclick", ""))
            href = a.attrs.get("href", "")
            link = href if href and not href.startswith(("#", "javascript:")) else (onclick[1] if onclick else "")
            out.append({"title": a.text(), "link": link, "published_at": "{}-{:0>2}-{:0>2}".format(*date.groups())})
    return out


def is_board(html: str, least: int = 3) -> bool:
    return len(board(html)) >= least


def calendar(html: str) -> list[dict]:
    """Dated entries of definition lists; a list whose terms don't pair up gives an error row."""
    out = []
    for dl in parse(html).find("dl"):
        pairs, whole = definitions(dl)
        if not whole:
            out.append({"when": "", "title": "", "error": "unpaired"})
            continue
        out += [{"when": a, "title": b, "error": ""} for a, b in pairs]
    return out


def fragments(html: str, least: int = 6) -> list[dict]:
    """Texts of a page's blocks, each once."""
    kinds = ("p", "li", "td", "th", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "caption", "address")
    return [{"text": t} for t in dict.fromkeys(n.text() for n in parse(html).find(*kinds)) if len(t) >= least]


#: What a character of a link takes off, and what share of the best value an inner container needs.
LINK_PENALTY, INNER_SHARE = 1.5, 0.9


def density_root(html: str) -> Node:
    """The container with the most text that isn't in links, or the innermost in it that has nearly as much."""
    root = parse(html)
    nodes = list(root.walk())
    place = {id(node): k for k, node in enumerate(nodes)}
    # Nodes come in page order, so those below a node are the run behind it: sums and ends go upwards once.
    chars, links, end = [0] * len(nodes), [0] * len(nodes), list(range(1, len(nodes) + 1))
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.tag in SKIPPED:
            chars[k] = links[k] = 0
        else:
            chars[k] += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
            links[k] = chars[k] if node.tag == "a" else links[k]
        if node.parent is not None:
            above = place[id(node.parent)]
            chars[above] += chars[k]
            links[above] += links[k]
            end[above] = max(end[above], end[k])
    value = [c - LINK_PENALTY * n for c, n in zip(chars, links, strict=True)]
    held = [k for k, node in enumerate(nodes) if node.tag in ("div", "section", "article", "main", "body", "td")]
    if not held:
        return root
    best = max(held, key=lambda k: (value[k], -k))
    for k in held:
        if best < k < end[best] and value[k] >= INNER_SHARE * value[best]:
            best = k
    return nodes[best]


def rows_of(pages: DataFrame, reader: Callable[[str], list[dict]], fields: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """The rows a reader makes of each page, with the page's key."""
    names = [f.split()[0] for f in re.split(r",\s*(?![^<]*>)", fields)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(k, *(r[n] for n in names)) for k, h in zip(batch[key], batch[html], strict=True) for r in reader(h or "")]
            yield pd.DataFrame(made, columns=[key, *names])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, {fields}")
