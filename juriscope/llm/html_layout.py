"""HTML extraction by layout-aware rendering.

A tolerant tokenizer feeds a tree builder that implies the end tags HTML leaves out; a renderer
walks the tree without recursion, drops what a browser would not show, and writes the rest with
block spacing, list markers and aligned table cells.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist area base link meta param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup hr html legend li main nav option optgroup search section summary tr caption".split())
#: A start tag closes these open elements, up to the nearest of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
_CLOSES_P = BLOCK - {"li", "dd", "dt", "option", "optgroup", "tr", "caption", "body", "html"} | {"li", "dd", "dt"}
_P_STOPS = frozenset("td th caption button table".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


#: End tags that reach out of a cell or a table.
_REACHING = frozenset("table tbody thead tfoot tr body html".split())
_CELLS = ("table", "td", "th")


class _Open:
    """The open elements, and where those of each tag stand, so that none is looked for one by one."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.where: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags) -> int:
        """The place of the innermost open element with one of these tags; 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Closes the element at this place and all inside it."""
        while len(self.stack) > place:
            self.where[self.stack.pop().tag].pop()

    def close(self, tags, stops) -> None:
        """Closes elements with these tags, as far as none of the stops stands inside them."""
        while (place := self.nearest(tags)) > self.nearest(stops):
            self.cut(place)


def _attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), _html.unescape(next((v for v in values if v), "")))
    return out


def build(page: str) -> Node:
    """The tree of a page, in time that grows with the page."""
    root = Node("html", {})
    opened = _Open(root)
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:
            opened.stack[-1].children.append(page[at])
            at += 1
            continue
        at = m.end()
        if m["text"] is not None:
            opened.stack[-1].children.append(_html.unescape(m["text"]))
        elif m["cdata"] is not None:
            opened.stack[-1].children.append(m["cdata"])
        elif m["tag"] is not None:
            tag = m["tag"].lower()
            if m["close"]:
                if tag == "p" and not opened.where.get("p"):
                    opened.stack[-1].children.append(Node("p", {}))
                place = opened.nearest((tag,))
                # an end tag inside a cell does not reach out of it
                if place and (tag in _REACHING or place >= opened.nearest(_CELLS)):
                    opened.cut(place)
                continue
            attrs = _attributes(m["attrs"])
            if tag == "body" or tag == "html":
                opened.close({"head"}, ())
                if tag == "html":
                    root.attrs |= attrs
                    continue
                node = Node(tag, attrs)
                opened.stack[-1].children.append(node)
                opened.push(node)
                continue
            if tag in BLOCK and opened.stack[-1].tag == "head":
                opened.close({"head"}, ())
            if tag in _CLOSES_P:
                opened.close({"p"}, _P_STOPS)
            if tag in CLOSES:
                opened.close(*CLOSES[tag])
            node = Node(tag, attrs)
            opened.stack[-1].children.append(node)
            if tag in RAW:
                shut = re.compile(f"</{tag}", re.I | re.A).search(page, at)
                stop = shut.start() if shut else end
                body = page[at:stop]
                node.children.append(_html.unescape(body) if tag in ("textarea", "title") else body)
                at = stop
                shut = page.find(">", at)
                at = end if shut < 0 else shut + 1
            elif tag not in VOID and (tag in BLOCK or not m["attrs"].rstrip().endswith("/")):
                opened.push(node)  # a slash does not close an element of HTML's own blocks
    return root


_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"\s*([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)\s*\Z")


class Styles:
    """What a page's style elements say of display and visibility, for selectors of a tag, classes and an id.

    Selectors with combinators, attributes or pseudo-classes, and rules inside @-rules, are not read.
    """

    def __init__(self, root: Node):
        self.rules: list[tuple[str | None, frozenset[str], str | None, str]] = []
        work = [root]
        while work:
            node = work.pop()
            if node.tag == "style":
                self._read("".join(c for c in node.children if isinstance(c, str)))
            else:
                work.extend(c for c in node.children if isinstance(c, Node))

    def _read(self, sheet: str) -> None:
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
        depth, plain = 0, []
        for piece in re.split(r"(@[^{};]*[{;])", sheet):  # what stands in an @-rule goes
            if piece.startswith("@"):
                depth = int(piece.endswith("{"))
                continue
            if depth:
                level = 1
                for k, ch in enumerate(piece):
                    level += (ch == "{") - (ch == "}")
                    if level == 0:
                        piece, depth = piece[k + 1 :], 0
                        break
                else:
                    continue
            plain.append(piece)
        for selectors, body in _RULE.findall("".join(plain)):
            if _NO_DISPLAY.search(body) or _VISIBILITY.search(body):
                for selector in selectors.split(","):
                    m = _SELECTOR.match(selector)
                    if m and (m[1] or m[2]):
                        names = re.findall(r"[.#][\w-]+", m[2])
                        ids = [n[1:] for n in names if n[0] == "#"]
                        self.rules.append((m[1].lower() if m[1] else None, frozenset(n[1:] for n in names if n[0] == "."), ids[0] if ids else None, body))

    def of(self, node: Node) -> str:
        """The declarations for an element: those of the rules in their order, then its own."""
        own = node.attrs.get("style", "")
        if not self.rules:
            return own
        classes = set(node.attrs.get("class", "").split())
        said = [body for tag, names, ident, body in self.rules if tag in (None, node.tag) and names <= classes and ident in (None, node.attrs.get("id"))]
        return ";".join([*said, own])


def laid_out(node: Node, style: str) -> bool:
    """Whether an element and what it holds has a place on the page at all."""
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return False
    if node.tag == "dialog" and "open" not in node.attrs or node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    return not _NO_DISPLAY.search(style)


#: Columns at most that nested lists and quotations are moved to the right, and that a cell is filled up to.
MOST_INDENT = 40
MOST_WIDTH = 80
#: Tables inside tables that are rendered as such; what lies deeper is written as blocks, since every level copies its text.
MOST_TABLES = 12


class Writer:
    """Lines of text with collapsed space and margins."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False
        self.margin = 0
        self.indent = ""
        self.marker = ""

    def write(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.gap = True
            words = words[1:]
        if not words:
            return
        trailing = words.endswith(" ")
        words = words[:-1] if trailing else words
        if self.gap and self.parts:
            self.parts.append(" ")
        self.parts.append(words)
        self.gap = trailing

    def exact(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.parts.append(first)
        for line in rest:
            self.end_line(True)
            self.parts.append(line)
        self.gap = False

    def end_line(self, keep_empty: bool = False) -> None:
        self.gap = False
        if self.parts or keep_empty:
            line = "".join(self.parts)
            self.parts = []
            if self.lines and self.margin > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.margin = 0
            self.lines.append((self.indent + self.marker + line).rstrip())
            if self.marker:
                self.deeper(len(self.marker))
                self.marker = ""

    def deeper(self, columns: int) -> None:
        self.indent = " " * min(MOST_INDENT, len(self.indent) + columns)

    def block(self, margin: int) -> None:
        self.end_line()
        self.margin = max(self.margin, margin)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _table(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (text, columns) as lines, the columns aligned; a cell of several lines makes its row as many lines high.

    Only columns where some cell begins count, and a cell is filled up to MOST_WIDTH, so the output grows with
    the input whatever the spans and the widest cell are; longer cells stay whole.
    """
    begins: set[int] = set()
    for row in rows:
        c = 0
        for _, span in row:
            begins.add(c)
            c += span
    order = sorted(begins)
    place = {c: k for k, c in enumerate(order)}
    widths = [0] * len(order)
    laid = []
    for row in rows:
        cells, c = [], 0
        for text, span in row:
            first, last = place[c], bisect_left(order, c + span)
            c += span
            lines = text.split("\n")
            cells.append((lines, first, last))
            if last - first == 1:
                widths[first] = max(widths[first], min(MOST_WIDTH, max(map(len, lines))))
        laid.append(cells)
    out = []
    for cells in laid:
        for k in range(max((len(lines) for lines, _, _ in cells), default=0)):
            out.append(" | ".join((lines[k] if k < len(lines) else "").ljust(min(MOST_WIDTH, sum(widths[a:b]) + 3 * (b - a - 1))) for lines, a, b in cells).rstrip(" |"))
    return out


def _is_layout(table: Node, rows: list[list[tuple[str, int]]], nested: bool) -> bool:
    """A table that arranges the page rather than data: said so, around other tables, or with one cell in every row."""
    return table.attrs.get("role", "").lower() in ("presentation", "none") or nested or all(sum(bool(t) for t, _ in row) <= 1 for row in rows)


def _number(text: str, most: int, otherwise: int = 1) -> int:
    return min(int(text), most) if text.isascii() and text.isdigit() and 0 < len(text) < 9 and int(text) > 0 else otherwise


def _spanned(rows: list[list], groups: set[int]) -> list[list]:
    """Rows of (text, colspan) in which the columns of cells from rows above are empty cells; no cell reaches out of its row group."""
    out, held = [], []  # held: first column, width, rows left
    for i, row in enumerate(rows):
        if i in groups:
            held = []
        line, column, at, new = [], 0, 0, []
        for text, wide, high in row:
            while at < len(held) and held[at][0] <= column:
                line.append(("", held[at][1]))
                column = max(column, held[at][0] + held[at][1])
                at += 1
            line.append((text, wide))
            if high > 1:
                new.append((column, wide, high - 1))
            column += wide
        out.append(line)
        held = sorted([(c, n, k - 1) for c, n, k in held if k > 1] + new)
    return out


class _Table:
    def __init__(self):
        self.rows: list[list] = []
        self.groups: set[int] = set()
        self.nested = False


def render(root: Node) -> str:
    """Everything visible, as text."""
    styles = Styles(root)
    writers, tables, lists, pre, flat = [Writer()], [], [], 0, 0
    # element or text; whether it is seen; None on the way in, the indent to go back to on the way out
    work: list = [(root, True, None)]
    while work:
        item, seen, back = work.pop()
        w = writers[-1]
        if isinstance(item, str):
            if seen:
                (w.exact if pre else w.write)(item)
            continue
        tag = item.tag
        if back is None:
            style = styles.of(item)
            if not laid_out(item, style):
                continue
            if said := _VISIBILITY.findall(style):
                seen = said[-1].lower() == "visible"
            if tag == "br":
                w.end_line(True)
                continue
            if tag == "wbr":
                continue
            if tag in ("img", "input"):
                label = item.attrs.get("alt") if tag == "img" else item.attrs.get("value") or item.attrs.get("placeholder")
                if label and seen:
                    w.write(f" {label} ")
                continue
            back = w.indent
            inner = tables and not flat  # the innermost table is one that is rendered as such
            if tag in ("td", "th") and inner:
                writers.append(Writer())
            elif tag == "tr" and inner:
                tables[-1].rows.append([])
            elif tag in BLOCK or tag in ("td", "th"):
                nested = tag in ("ul", "ol", "menu") and bool(lists)
                w.block(2 if tag in SPACED and not nested else 1)
            if tag == "table" and (flat or len(tables) >= MOST_TABLES):
                flat += 1
            elif tag == "table":
                if tables:
                    tables[-1].nested = True
                tables.append(_Table())
            elif tag in ("thead", "tbody", "tfoot") and inner:
                tables[-1].groups.add(len(tables[-1].rows))
            elif tag in ("ul", "ol", "menu"):
                lists.append([tag, _number(item.attrs.get("start", ""), 10**8), w.indent])
            elif tag == "li":
                kind, n, indent = lists[-1] if lists else ["ul", 1, w.indent]
                w.indent = indent
                if lists and kind == "ol":
                    n = _number(item.attrs.get("value", ""), 10**8, n)
                    lists[-1][1] = n + 1
                w.marker = f"{n}. " if kind == "ol" else "- "
            elif tag == "pre" or tag == "textarea":
                pre += 1
            elif tag == "dd" or tag == "blockquote":
                w.deeper(2)
            elif tag == "q" and seen:
                w.write('"')
            work.append((item, seen, back))
            inside = item.children
            if tag in ("pre", "textarea") and inside and isinstance(inside[0], str) and inside[0].startswith("\n"):
                inside = [inside[0][1:], *inside[1:]]  # a line end right after the tag is not shown
            if tag == "details" and "open" not in item.attrs:
                inside = [next((c for c in inside if isinstance(c, Node) and c.tag == "summary"), "")]
            work.extend((c, seen, None) for c in reversed(inside))
            continue
        inner = tables and not flat
        if tag in ("td", "th") and inner:
            text = writers.pop().text()
            if not tables[-1].rows:
                tables[-1].rows.append([])
            high = item.attrs.get("rowspan", "").strip()
            tables[-1].rows[-1].append((text, _number(item.attrs.get("colspan", ""), 1000), 65534 if high == "0" else _number(high, 65534)))
            continue
        if tag == "table" and flat:
            flat -= 1
        elif tag == "table":
            table = tables.pop()
            rows = [r for r in _spanned(table.rows, table.groups) if any(t for t, _ in r)]
            w.block(2)
            if _is_layout(item, rows, table.nested):
                for cell in (t for row in rows for t, _ in row if t):
                    for line in cell.split("\n"):
                        w.parts.append(line)
                        w.end_line(True)
                    w.block(1)
            else:
                for line in _table(rows):
                    w.parts.append(line)
                    w.end_line(True)
        elif tag in ("ul", "ol", "menu"):
            w.end_line()
            w.indent = lists.pop()[2]
            w.marker = ""
        elif tag == "li":
            w.end_line()
            w.marker = ""
            w.indent = lists[-1][2] if lists else back
        elif tag == "pre" or tag == "textarea":
            pre -= 1
        elif tag == "q" and seen:
            w.parts.append('"')
        if tag in BLOCK and not (tag == "tr" and inner) or tag in ("td", "th"):
            w.block(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
        if tag == "dd" or tag == "blockquote":
            w.indent = back
    return writers[0].text()


def extract(page: str | None) -> str:
    """The visible text of a page; null and empty pages give the empty text."""
    return render(build(page)) if page else ""


def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([extract(x) for x in batch.to_pylist()], pa.string())


_extract.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def extract_text(pages: DataFrame, name: str = "text") -> DataFrame:
    """pages with one more column, the visible text of ``html``; ``name`` must not be among the columns.

    Rows stand alone: null and empty pages give the empty text, pages of any length are rendered
    whole, rows that repeat give the same text, an empty table gives an empty result.
    """
    return pages.withColumn(name, F.arrow_udf(_extract, "string")(F.col("html")))


def op7_html(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "html")).select("page_id", F.length("text").cast("long").alias("n_chars"), "text")
