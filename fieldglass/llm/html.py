"""Layout-aware HTML rendering: all visible text, with block spacing, lists and aligned tables.

A small tree builder understands implied end tags (p, li, dt, dd, option, tr,
td, th, thead, tbody, tfoot), void elements and raw-text elements; a renderer
walks the tree, leaves out what is not shown, and lays out the rest.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe object embed canvas audio video datalist meta link title noembed noframes param".split())
#: Inside svg and math: what is not drawn, and the elements that end them.
FOREIGN_HIDDEN = frozenset("desc metadata defs symbol clippath mask pattern marker filter annotation annotation-xml".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split()
)
#: A foreign element whose content is HTML again.
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
IN_HEAD = frozenset("title meta link script style base noscript template basefont bgsound noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
CLOSES_P = BLOCK - {"html", "body", "dd", "dt", "li", "tr", "caption", "legend", "summary"} | {"li", "dd", "dt"}
#: Opening one of these ends an open one of those, up to the boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: An element's end tag does not reach beyond these.
SCOPE = frozenset({"table", "td", "th", "html", "body"})

#: A quote opens a value only right after the equals sign; one that is never closed is part of a bare value.
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s>]*))"""
_ATTR = re.compile(rf"""([^\s/>][^\s/>=]*)(?:\s*=\s*{_VALUE})?""")
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|(?>[^\s/>][^\s/>=]*(?:\s*=\s*(?>"[^"]*"|'[^']*'|[^\s>]*))?))*+)(?:>|\Z)""", re.S)
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "foreign", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False) -> None:
        self.tag, self.attrs, self.children, self.foreign = tag, attrs, [], foreign


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def build_tree(html: str) -> Node:
    """The element tree.  Unclosed elements end with their parent; stray end tags are ignored (a stray ``</p>`` is an empty paragraph)."""
    root = Node("html", {})
    stack = [root]

    def cut(tags: set[str], stops: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                return
            if stack[i].tag in tags:
                del stack[i:]
                if not tags & {"tr", "thead"}:
                    return

    begun = False  # the head is over, or cannot come any more

    def text(s: str) -> None:
        nonlocal begun
        if stack[-1].tag in ("head", "html") and not begun and not s.isspace():
            begun = True
            del stack[1:]
        stack[-1].children.append(unescape(s))

    pos, size = 0, len(html)
    while pos < size:
        m = _TOKEN.search(html, pos)
        if m is None:
            text(html[pos:])
            break
        if m.start() > pos:
            text(html[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            begun = begun or tag == "head"
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                    if tag == "p":
                        stack[-1].children.append(Node("p", {}))
                    break
            continue
        if tag in ("html", "body"):
            stack[0].attrs = {**_attributes(m[3]), **stack[0].attrs}
            if tag == "body":
                begun = True
                if stack[-1].tag == "head":
                    stack.pop()
            continue
        if tag == "head" and (begun or stack[-1].tag == "head"):
            continue
        if stack[-1].foreign and tag in BREAKOUT:
            while stack[-1].foreign:
                stack.pop()
        if tag in CLOSES_P:
            cut({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            cut(*IMPLIED[tag])
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if stack[-1] is root and tag != "head" and tag not in IN_HEAD:
            begun = True
        within = stack[-1].foreign and stack[-1].tag not in HTML_INSIDE
        node = Node(tag, _attributes(m[3]) if m[3] else {}, within or tag in ("svg", "math"))
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and node.foreign:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, pos)
            body = html[pos : end.start()] if end else html[pos:]
            if tag in ("textarea", "title", "xmp"):
                node.children.append(body if tag == "xmp" else unescape(body))
            pos = end.end() if end else size
            continue
        stack.append(node)
    return root


def is_hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in HIDDEN or node.foreign and node.tag in FOREIGN_HIDDEN or "hidden" in a or (node.tag == "input") or (node.tag == "dialog" and "open" not in a) or bool("style" in a and _HIDES.search(a["style"]))


class _Lines:
    """Lines under construction; ``gap`` blank lines are due before the next text."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line, self.gap, self.prefix, self.first = "", 0, "", ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if not self.line or self.line.endswith(" "):
            s = s.lstrip(" ")
        self.line += s

    def end_line(self) -> None:
        s = self.line.rstrip(" ")
        if s:
            self.raw(s)
        self.line = ""

    def raw(self, s: str) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = 0
        self.done.append((self.first or self.prefix) + s)
        self.first = ""

    def space(self) -> None:
        self.end_line()
        self.gap = 1


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"[0-9]{1,6}", text) else default


def _shown_options(select: Node) -> list[str]:
    """What a select shows when closed: the last selected option, else the first that is not disabled; a list box shows all."""
    shown: list[tuple[bool, bool, str]] = []
    work = list(reversed(select.children))
    while work:
        node = work.pop()
        if isinstance(node, str) or is_hidden(node):
            continue
        if node.tag != "option":
            work.extend(reversed(node.children))
            continue
        parts, inner = [], list(reversed(node.children))
        while inner:
            x = inner.pop()
            if isinstance(x, str):
                parts.append(x)
            elif not is_hidden(x):
                inner.extend(reversed(x.children))
        shown.append(("selected" in node.attrs, "disabled" in node.attrs, node.attrs.get("label") or "".join(parts)))
    if "multiple" in select.attrs or _number(select.attrs.get("size"), 1) > 1:
        return [t for *_, t in shown]
    chosen = [t for on, _, t in shown if on][-1:] or [t for _, off, t in shown if not off][:1]
    return chosen


def _run(task: Generator) -> list[str]:
    """The result of ``task``; generators it yields are run first, on a stack of their own, and their results sent back."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _walk(root: Node, out: _Lines) -> Generator:
    """Depth-first with an explicit stack, so deep nesting is no limit; tables are yielded."""
    work: list[tuple[str, object]] = [("open", root)]
    lists: list[list] = []
    while work:
        what, node = work.pop()
        if what == "close":
            tag, saved = node
            out.end_line()
            if tag in SPACED:
                out.gap = 1
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if saved is not None:
                out.prefix, out.first = saved, ""
            continue
        if isinstance(node, str):
            if what == "pre":
                parts = node.split("\n")
                for i, p in enumerate(parts):
                    out.line += p
                    if i < len(parts) - 1:
                        out.raw(out.line)
                        out.line = ""
            else:
                out.text(node)
            continue
        if is_hidden(node):
            continue
        tag = node.tag
        if tag == "br":
            out.end_line() if out.line.strip() else out.raw("")
            continue
        if tag == "hr":
            out.space()
            continue
        if tag == "img":
            if node.attrs.get("alt"):
                out.text(node.attrs["alt"])
            continue
        if tag == "table":
            out.space()
            for line in (yield _table(node)):
                out.raw(line)
            out.gap = 1
            continue
        if tag == "select":
            for option in _shown_options(node):
                out.text(f" {option} ")
            continue
        saved = None
        if tag in BLOCK or tag == "text" and node.foreign:
            out.end_line()
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                out.gap = 1
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, _number(node.attrs.get("start"), 1)])
            if tag == "li":
                saved = out.prefix
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] = _number(node.attrs.get("value"), lists[-1][1])
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                out.first, out.prefix = saved + mark, saved + " " * len(mark)
            elif tag in ("dd", "blockquote"):
                saved = out.prefix
                out.prefix = saved + "  "
            work.append(("close", (tag, saved)))
        inner = "pre" if what == "pre" or tag in ("pre", "textarea", "xmp") else "open"
        work.extend((inner, c) for c in reversed(node.children))


def _lines(node: Node) -> Generator:
    out = _Lines()
    yield from _walk(node, out)
    out.end_line()
    return out.done


def render_table(table: Node) -> list[str]:
    """The lines of a table, as :func:`_table` lays them out."""
    return _run(_table(table))


def _table(table: Node) -> Generator:
    """A caption, then rows of cells padded to their columns' widths and parted by `` | ``; a cell over several columns is followed by empty ones."""
    lines: list[str] = []
    rows: list[list[str]] = []
    carried: dict[int, int] = {}
    work = list(reversed(table.children))
    while work:
        node = work.pop()
        if isinstance(node, str):
            if node.strip():
                rows.append([_SPACE.sub(" ", node).strip()])
            continue
        if is_hidden(node):
            continue
        if node.tag in ("thead", "tbody", "tfoot", "colgroup"):
            work.extend(reversed(node.children))
        elif node.tag == "tr":
            row: list[str] = []
            for cell in node.children:
                while carried.get(len(row), 0) > 0:
                    carried[len(row)] -= 1
                    row.append("")
                if isinstance(cell, str):
                    if cell.strip():
                        row.append(_SPACE.sub(" ", cell).strip())
                    continue
                if is_hidden(cell):
                    continue
                text = " ".join(x.strip() for x in (yield _lines(_as_div(cell))) if x.strip())
                span, down = min(_number(cell.attrs.get("colspan"), 1) or 1, 1000), min(_number(cell.attrs.get("rowspan"), 1) or 1, 1000)
                for i in range(span):
                    if down > 1:
                        carried[len(row)] = down - 1
                    row.append(text if i == 0 else "")
            rows.append(row)
        else:
            lines += yield _lines(node)
    rows = [r for r in rows if any(r)]
    widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
    for r in rows:
        lines.append(" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=False)).rstrip())
    return lines


def _as_div(cell: Node) -> Node:
    plain = cell.tag in ("td", "th")
    div = Node("div", cell.attrs if plain else {})
    div.children = cell.children if plain else [cell]
    return div


def render(html: str | None) -> str:
    """The visible text of a page; null and empty pages give an empty text."""
    if not html:
        return ""
    return "\n".join(x.rstrip() for x in _run(_lines(build_tree(html)))).strip("\n")


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the rendered text of each page.

    A narrow map: one row in gives one row out, repeated rows too.  Null and
    empty pages give an empty text.  An existing column ``out`` is replaced.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([render(t) for t in texts], dtype=object)

    return pages.withColumn(out, run(F.col(html)))
