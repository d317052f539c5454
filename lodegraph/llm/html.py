"""Visible text of web pages, laid out.

A page becomes a tree: tags that HTML lets authors leave out are implied, wrong
end tags are dropped, raw text (scripts, styles) is never markup. Elements that a
browser doesn't show are left out; everything else is text: blocks stand on lines
of their own, paragraphs and headings apart by an empty line, list items get a
mark and an indent, cells of a table are aligned in columns, also over spans,
preformatted text keeps its spaces, and white space elsewhere collapses. Forms show
what a browser shows: the text of text areas, the chosen options, labels of buttons.

Columns are aligned up to WIDE characters; longer lines reach over. Where aligning a
table would still make it more than SPREAD times its text, its cells just follow
each other, so a page's text is bounded by the page, never cut.

Defined results: a null or empty page has an empty text; broken markup gives the
text that is there; repeated rows give repeated results; an empty table gives no
rows; only page_id and html are read. A page is worked on as a whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|[!?][^>]*+>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist desc defs metadata symbol annotation annotation-xml".split())
WIDE, SPREAD = 80, 8
#: The most that the HTML standard lets cells span.
COLUMNS, ROWS = 1000, 65534
HEAD = frozenset("base link meta noscript script style template title".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr form fieldset".split())
BLOCK = APART | frozenset("html body div section article aside nav header footer main address li dt dd tr caption thead tbody tfoot td th figcaption details summary legend center dir menu hgroup search".split())
#: A start tag of the key ends open elements of the value, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: End tags of these don't close what stands outside.
WALLS = frozenset("table td th caption html body template object".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "caption", "thead", "tbody", "tfoot", "legend"}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    if not raw or raw == "/":
        return {}
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def parse(page: str) -> Node:
    """The tree of a page, under an html element."""
    root, at = Node("html", {}), 0
    stack, body = [root], None

    def in_body() -> None:
        nonlocal body
        if body is None:
            del stack[1:]
            body = Node("body", {})
            root.children.append(body)
            stack.append(body)

    def text(s: str) -> None:
        if s:
            if body is None and stack[-1].tag in ("html", "head"):
                if not s.strip():
                    return
                in_body()
            stack[-1].children.append(s if "&" not in s else entities.unescape(s))

    def close(tags, walls) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in walls:
                return

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                in_body()
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                in_body()
                stack[-1].children.append(Node("p", {}))
            elif tag == "head":
                if body is None:
                    del stack[1:]
            elif tag not in ("html", "body"):
                close({tag}, {"table"} - {tag} if tag in TABLE else WALLS - {tag})
            continue
        if tag in ("html", "body", "head"):
            attrs = attributes(m[3])
            if tag == "html":
                root.attrs |= attrs
            elif tag == "body":
                in_body()
                body.attrs |= attrs
            elif body is None and len(stack) == 1:
                root.children.append(Node("head", attrs))
                stack.append(root.children[-1])
            continue
        if body is None and tag not in HEAD and stack[-1].tag in ("html", "head"):
            in_body()
        if tag in ENDS_P:
            close({"p"}, WALLS | {"button"})
        if tag in IMPLIED:
            ends, walls = IMPLIED[tag]
            for _ in range(3):
                close(ends, walls)
        node = Node(tag, attributes(m[3]))
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            stack[-1].children.append(row := Node("tr", {}))
            stack.append(row)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            if inner:
                node.children.append(entities.unescape(inner) if tag in ("textarea", "title") else inner)
            close_at = page.find(">", end.end()) if end else -1
            at = close_at + 1 if close_at >= 0 else len(page)
        elif tag not in VOID:
            stack.append(node)
    text(page[at:])
    return root


def unseen(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return True
    style = node.attrs.get("style")
    if style and re.search(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", style, re.I):
        return True
    return node.tag == "dialog" and "open" not in node.attrs


class Lines:
    """Text being laid out: a current line, and how many line ends are due before it."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.due, self.space, self.indent, self.mark = 0, False, "", ""

    def add(self, s: str, keep: bool = False) -> None:
        if keep:
            for k, part in enumerate(s.split("\n")):
                if k:
                    self.end(1, True)
                if part:
                    self._put(part)
            return
        if not s:
            return
        if s[0] in " \t\n\r\f" and self.line:
            self.space = True
        body = SPACE.sub(" ", s).strip(" ")
        if body:
            self._put((" " if self.space and self.line else "") + body)
            self.space = s[-1] in " \t\n\r\f"

    def _put(self, s: str) -> None:
        if not self.line:
            if self.done and self.due > 1:
                self.done.append("")
            self.line.append(self.indent + self.mark)
            if self.mark:
                self.indent, self.mark = self.indent + " " * len(self.mark), ""
            self.due = 0
        self.line.append(s)

    def end(self, due: int, blank: bool = False) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip(" "))
            self.line = []
        elif blank and self.done:
            self.done.append("")
        self.due, self.space = max(self.due, due), False

    def text(self) -> str:
        self.end(0)
        return "\n".join(self.done).strip("\n")


def span(node: Node, name: str, most: int) -> int:
    """How many columns or rows a cell takes up; 0 rows are all that follow."""
    raw = node.attrs.get(name, "").strip()
    n = int(raw[:9]) if re.match(r"\d+$", raw) else 1
    return min(n, most) or (most if name == "rowspan" else 1)


def grid(rows: list[list[tuple[str, int, int]]]) -> str:
    """Rows of cells (text, columns, rows that they take up) as aligned columns."""
    placed: list[list[tuple[int, list[str], int]]] = []
    above: list[tuple[int, int, int]] = []  # columns that cells of former rows take up, and up to which row
    for r, row in enumerate(rows):
        above = sorted(x for x in above if x[2] > r)
        at, k, cells, new = 0, 0, [], []
        for text, across, down in row:
            while k < len(above) and above[k][0] <= at:
                at, k = max(at, above[k][1]), k + 1
            cells.append((at, text.split("\n"), across))
            if down > 1:
                new.append((at, at + across, r + down))
            at += across
        above += new
        placed.append(cells)
    width: dict[int, int] = {}
    for cells in placed:
        for at, lines, across in cells:
            if across == 1:
                width[at] = max(width.get(at, 0), *(len(x) for x in [*lines, ""] if len(x) <= WIDE))
            else:
                width.setdefault(at, 0)
    starts, total = {}, 0
    for at in sorted(width):
        starts[at] = total
        total += width[at] + 2 if width[at] else 0
    full = lambda cells, i: [(starts[at], lines[i]) for at, lines, _ in cells if i < len(lines) and lines[i]]
    deep = lambda cells: max((len(lines) for _, lines, _ in cells), default=0)
    text = sum(len(x) - x.count(" ") for cells in placed for _, lines, _ in cells for x in lines)
    size = sum(max((start + len(x) for start, x in full(cells, i)), default=0) for cells in placed for i in range(deep(cells)))
    aligned, out = size <= SPREAD * text + 4096, []
    for cells in placed:
        for i in range(deep(cells)):
            line = ""
            for start, x in full(cells, i):
                line += " " * max(start - len(line) if aligned else 0, 2 if line else 0) + x
            out.append(line.rstrip())
    return "\n".join(out)


def shown_options(node: Node) -> list[Node]:
    """The options of a select that are seen while it is closed, or all of a list."""
    found, work = [], list(reversed(node.children))
    while work:
        x = work.pop()
        if isinstance(x, Node):
            if x.tag == "option":
                found.append(x)
            else:
                work.extend(reversed(x.children))
    size = node.attrs.get("size", "1")
    if "multiple" in node.attrs or (size.isdigit() and int(size[:9]) > 1):
        return found
    return [x for x in found if "selected" in x.attrs][-1:] or found[:1]


def render(root: Node) -> str:
    """The laid-out text of a tree, without recursion."""
    outs, tables, lists = [Lines()], [], []
    work: list[tuple] = [("node", root, False)]
    while work:
        kind, node, pre = work.pop()
        out = outs[-1]
        if kind == "node":
            if isinstance(node, str):
                out.add(node, pre)
                continue
            tag = node.tag
            if unseen(node):
                continue
            if tag == "br":
                out.end(0, True)
                continue
            if tag == "input":
                if node.attrs.get("type", "").lower() in ("submit", "reset", "button"):
                    out.add(" " + node.attrs.get("value", "") + " ")
                continue
            if tag == "select":
                out.add(" ")
                work.append(("exit", node, pre))
                work.extend(("node", x, pre) for x in reversed(shown_options(node)))
                continue
            if tag == "textarea" and out.line:
                out.line.append(" ")
            pre = pre or tag in ("pre", "textarea")
            if tag == "table":
                out.end(2)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                outs.append(Lines())
            elif tag == "caption" and tables:
                outs.append(Lines())
            elif tag in BLOCK:
                out.end(2 if tag in APART and not (tag in ("ul", "ol") and lists) else 1)
                if tag in ("ul", "ol", "menu", "dir"):
                    start = node.attrs.get("start", "")
                    lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, out.indent])
                elif tag == "li":
                    out.indent, out.mark = lists[-1][2] if lists else "", f"{lists[-1][1]}. " if lists and lists[-1][0] else "* "
                    if lists:
                        lists[-1][1] += 1
                elif tag in ("blockquote", "dd"):
                    out.indent += "  "
            elif tag == "q":
                out.add('"')
            work.append(("exit", node, pre))
            work.extend(("node", c, pre) for c in reversed(node.children))
            continue
        tag = node.tag
        if tag == "table":
            rows = tables.pop()
            rows = rows if any(x[0] for r in rows for x in r) else []
            outs[-1].end(2)
            if rows:
                outs[-1].add(grid(rows), True)
            outs[-1].end(2)
        elif tag in ("td", "th") and tables:
            tables[-1][-1].append((outs.pop().text(), span(node, "colspan", COLUMNS), span(node, "rowspan", ROWS)))
        elif tag == "caption" and tables:
            cell = outs.pop().text()
            outs[-1].add(cell, True)
            outs[-1].end(1)
        elif tag in ("ul", "ol", "menu", "dir") and lists:
            out.end(1 if len(lists) > 1 else 2)
            out.indent = lists.pop()[2]
        elif tag == "li":
            out.end(1)
            out.mark, out.indent = "", lists[-1][2] if lists else ""
        elif tag in ("blockquote", "dd"):
            out.end(2 if tag == "blockquote" else 1)
            out.indent = out.indent[:-2]
        elif tag == "q":
            out.add('"')
        elif tag in ("option", "select", "textarea"):
            out.add(" ")
        elif tag in BLOCK:
            out.end(2 if tag in APART else 1)
    while len(outs) > 1:
        tail = outs.pop().text()
        outs[-1].add(tail, True)
    return outs[0].text()


def extract(page: str | None) -> str:
    return render(parse(page)) if page else ""


def texts(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, 1):
            out = [extract(p) for p in batch.column(1).to_pylist()]
            yield {"page_id": batch.column(0), "text": out, "n_chars": [len(t) for t in out]}

    return common.arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")), run, "page_id long, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(common.table(spark, sf_dir, "pages", "page_id", "html"))
