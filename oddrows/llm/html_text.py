"""Visible text of web pages, laid out: a tree builder with implied tags, visibility rules, and block rendering.

Paragraphs, headings, lists and tables are set apart by an empty line, other blocks by a line end. List items get their marker
and hang from it; table cells stand in aligned columns. Nothing visible is left out. What elements nested deeper than ``DEPTH``
hold is kept at that depth, as browsers do, unless they are hidden. A drop-down shows its choice, a list box all options.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.llm.common import with_arrow

DEPTH = 200
# Cells pad to at most this width, so that one long cell does not fill every row with spaces.
PAD = 80

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title meta link datalist iframe noembed noframes audio video canvas object param".split())
# Blocks with an empty line around them, and without.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table pre xmp blockquote figure hr fieldset".split())
BLOCKS = SPACED | frozenset(
    "address article aside body center details dialog div dd dt figcaption footer form header hgroup html legend li main nav optgroup "
    "search section summary caption thead tbody tfoot tr td th textarea".split()
)
CLOSES_P = (BLOCKS - {"body", "html", "li", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "textarea", "optgroup", "legend"}) | {"li"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("thead tbody tfoot".split())
# Start tag: what it ends if open, and the elements that shield what lies outside of them.
LISTS, CELLS = frozenset("ul ol menu dir td th table".split()), frozenset(("table",))
ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, frozenset(("dl", "td", "th", "table"))),
    "dd": ({"dt", "dd"}, frozenset(("dl", "td", "th", "table"))),
    "tr": ({"tr", "caption", "colgroup"}, CELLS),
    "td": ({"td", "th", "caption"}, frozenset(("tr", "table"))),
    "th": ({"td", "th", "caption"}, frozenset(("tr", "table"))),
    "thead": (SECTIONS | {"tr", "caption", "colgroup"}, CELLS),
    "tbody": (SECTIONS | {"tr", "caption", "colgroup"}, CELLS),
    "tfoot": (SECTIONS | {"tr", "caption", "colgroup"}, CELLS),
    "option": ({"option"}, frozenset(("select", "datalist"))),
    "optgroup": ({"option", "optgroup"}, frozenset(("select",))),
    "a": ({"a"}, frozenset(("td", "th", "table"))),
    "button": ({"button"}, frozenset(("td", "th", "table"))),
}
# Elements that are no blocks but end across open ones.
SCOPED = frozenset("object applet marquee button".split())
P_SHIELD = frozenset("table td th button caption template object".split())
HEAD_ONLY = frozenset("head title meta link base style script noscript template".split())

# Quotes guard a ">" inside of them; where they do not pair up, the tag ends at the next one.
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<given>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|(?P<loose>[^>]*)>)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)\b", re.I)


class Node:
    __slots__ = ("children", "given", "tag")

    def __init__(self, tag: str, given: str = ""):
        self.tag, self.given, self.children = tag, given, []

    def attributes(self) -> dict[str, str]:
        if not self.given.strip("/ \n\t"):
            return {}
        # of a repeated attribute the first counts
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(self.given)))}


def build(html: str) -> Node:
    """The tree of a page; texts are children as strings, with character references resolved."""
    root = Node("html")
    # open elements, and the nodes that their children go to: below DEPTH that of the element above, or one that is not shown
    stack, into = [root], [root]
    count: dict[str, int] = {}

    def cut(k: int) -> None:
        for n, target in zip(stack[k:], into[k:]):
            count[n.tag] -= 1
            if target is not n and n.tag in BLOCKS:
                target.children.append(Node("div"))  # the end of the block is an edge
        del stack[k:], into[k:]

    def close(tags, shield) -> bool:
        if not any(count.get(t) for t in tags):
            return False
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in tags:
                cut(k)
                return True
            if tag in shield:
                return False
        return False

    def add_text(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                cut(len(stack) - 1)
            into[-1].children.append(unescape(text) if "&" in text else text)

    def push(node: Node) -> None:
        into[-1].children.append(node)
        shallow = len(stack) < DEPTH or not visible(node, node.attributes() if node.given else {})
        stack.append(node)
        into.append(node if shallow else into[-1])
        count[node.tag] = count.get(node.tag, 0) + 1

    at, size = 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        if m is None:
            # a tag that never ends is dropped with what follows, like any other broken off page
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!][^<]*\Z", rest)
            add_text(rest[: cut.start()] if cut else rest)
            break
        add_text(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        given = m["given"] or m["loose"] or ""
        if m["end"]:
            if tag == "br":
                into[-1].children.append(Node("br"))
            elif tag == "p" and not count.get("p"):
                into[-1].children.append(Node("p"))
            elif tag in HEADINGS:
                close(HEADINGS, P_SHIELD)
            elif tag in SCOPED:
                close({tag}, frozenset(("td", "th", "table", "caption")))
            elif tag not in BLOCKS:
                # an inline element does not end across the edge of a block
                close({tag}, BLOCKS)
            elif tag not in ("body", "html"):
                shield = CELLS - {tag} if tag in ("table", "tr", "thead", "tbody", "tfoot") else frozenset(("td", "th", "table", "caption")) - {tag}
                close({tag}, shield)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                close({"head"}, frozenset())
                body = Node("body", given)
                if not count.get("body"):
                    push(body)
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            cut(len(stack) - 1)
        if tag in CLOSES_P:
            close({"p"}, P_SHIELD)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            cut(len(stack) - 1)
        if tag in ENDS:
            while close(*ENDS[tag]) and tag in SECTIONS:
                pass
        if tag == "table" and stack[-1].tag in ("table", "thead", "tbody", "tfoot", "tr"):
            close({"table"}, frozenset())
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(Node("tr"))
        node = Node(tag, given)
        if tag in RAW:
            into[-1].children.append(node)
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            inside = html[at : end.start()] if end else html[at:]
            at = end.end() if end else size
            node.children.append(unescape(inside) if tag in ("textarea", "title") else inside)
        elif tag in VOID:
            into[-1].children.append(node)
        else:
            push(node)
    return root


class Flow:
    """Lines of a block: inline text is gathered, blocks are set below each other."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False

    def flush(self) -> None:
        if self.inline:
            text = "".join(self.inline)
            self.inline = []
            lines = [SPACE.sub(" ", s).strip(" ") for s in text.split("\x00")]
            while lines and not lines[-1]:
                lines.pop()
            if any(lines):
                self.put(lines, False)

    def put(self, lines: list[str], spaced: bool) -> None:
        if lines:
            if self.lines and (spaced or self.gap):
                self.lines.append("")
            self.lines.extend(lines)
            self.gap = spaced

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def visible(node: Node, given: dict[str, str]) -> bool:
    if node.tag in UNSEEN or "hidden" in given and given["hidden"].lower() != "until-found":
        return False
    if node.tag == "input" and given.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in given:
        return False
    return not ("style" in given and HIDING.search(given["style"]))


def walk(node: Node, flow: Flow, pre: bool = False) -> None:
    """Render the children of an element into a flow."""
    tag = node.tag
    for child in node.children:
        if isinstance(child, str):
            flow.inline.append(child.replace("\x00", ""))
            continue
        given = child.attributes() if child.given else {}
        if not visible(child, given):
            continue
        kind = child.tag
        if kind == "br":
            flow.inline.append("\x00")
        elif kind == "input":
            if given.get("type", "text").lower() not in ("checkbox", "radio", "file", "image", "color", "range", "password"):
                flow.inline.append(f" {given.get('value', '')} ")
        elif kind == "select":
            options = [n for n in descend(child) if n.tag == "option" and visible(n, n.attributes())]
            if "multiple" in given or number(given.get("size"), 0, 1000) > 1:
                flow.inline.append(("\x00" if flow.inline else "") + "\x00".join([*map(texts_of, options), ""]))
            else:
                chosen = [n for n in options if "selected" in n.attributes()] or options[:1]
                flow.inline.append(" " + " ".join(texts_of(n) for n in chosen) + " ")
        elif kind in BLOCKS:
            flow.flush()
            flow.put(block(child, given, tag), kind in SPACED and not (kind in LISTS and tag == "li"))
        elif kind == "q":
            flow.inline.append("“")
            walk(child, flow)
            flow.inline.append("”")
        else:
            walk(child, flow)


def descend(node: Node):
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def texts_of(node: Node) -> str:
    return SPACE.sub(" ", "".join(c for n in descend(node) for c in n.children if isinstance(c, str))).strip(" ")


def number(value: str | None, otherwise: int, most: int) -> int:
    return min(int(value), most) if value and re.fullmatch(r"-?\d{1,9}", value.strip()) else otherwise


def block(node: Node, given: dict[str, str], parent: str = "") -> list[str]:
    """Lines of a block element."""
    tag = node.tag
    if tag == "hr":
        return ["-" * 20]
    if tag in ("pre", "xmp", "textarea"):
        return preformatted(node)
    if tag in ("ul", "ol", "menu", "dir"):
        return list_lines(node, given)
    if tag == "table":
        return table_lines(node)
    flow = Flow()
    if tag == "details" and "open" not in given:
        shut = Node("details")
        shut.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        walk(shut, flow)
    else:
        walk(node, flow)
    lines = flow.done()
    if tag in ("blockquote", "dd"):
        return [f"    {s}" if s else s for s in lines]
    return lines


def preformatted(node: Node) -> list[str]:
    out: list[str] = []
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "br":
            out.append("\n")
        elif n is node or visible(n, n.attributes()):
            todo += reversed(n.children)
    lines = "".join(out).replace("\r\n", "\n").split("\n")
    lines = lines[1:] if not lines[0] else lines
    while lines and not lines[-1].strip():
        lines.pop()
    return [s.rstrip() for s in lines]


def list_lines(node: Node, given: dict[str, str]) -> list[str]:
    flow = Flow()
    count = number(given.get("start"), 1, 10**9)
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            holder = Node("div")
            holder.children = [child]
            flow.flush()
            inner = Flow()
            walk(holder, inner)
            flow.put(inner.done(), False)
            continue
        attributes = child.attributes()
        if not visible(child, attributes):
            continue
        count = number(attributes.get("value"), count, 10**9)
        marker = f"{count}. " if node.tag == "ol" else "- "
        count += 1
        lines = block(child, attributes, node.tag) or [""]
        flow.put([(marker + lines[0]).rstrip(), *[" " * len(marker) + s if s else s for s in lines[1:]]], False)
    return flow.done()


def text_width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table_lines(node: Node) -> list[str]:
    """Caption, then rows with their cells in columns; a cell that spans columns or rows holds its place in the grid."""
    flow = Flow()
    rows: list[Node] = []
    foot: list[Node] = []

    def gather(part: Node, into: list[Node]) -> None:
        for child in part.children:
            if isinstance(child, str) or child.tag in ("colgroup", "col"):
                if isinstance(child, str) and child.strip():
                    flow.inline.append(child)
                continue
            given = child.attributes()
            if not visible(child, given):
                continue
            if child.tag == "tr":
                into.append(child)
            elif child.tag in ("thead", "tbody", "tfoot"):
                gather(child, foot if child.tag == "tfoot" else into)
            else:
                # a caption, or what does not belong in a table and is shown before it
                holder = Node("div")
                holder.children = [child]
                walk(holder, flow)

    gather(node, rows)
    grid: list[list[tuple[int, int, list[str]]]] = []
    below: dict[int, int] = {}
    for row in rows + foot:
        cells, column = [], 0
        for child in row.children:
            if isinstance(child, str) and not child.strip():
                continue
            cell = child if isinstance(child, Node) and child.tag in ("td", "th") else None
            if cell is None:
                cell = Node("td")
                cell.children = [child]
            given = cell.attributes()
            if not visible(cell, given):
                continue
            while below.get(column, 0):
                column += 1
            span = max(1, number(given.get("colspan"), 1, 1000))
            deep = max(1, number(given.get("rowspan"), 1, 10_000))
            inner = Flow()
            walk(cell, inner)
            cells.append((column, span, inner.done()))
            for k in range(column, column + span):
                below[k] = deep
            column += span
        below = {k: n - 1 for k, n in below.items() if n > 1}
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, span, lines in cells:
            if span == 1:
                widths[column] = max(widths.get(column, 0), min(PAD, max(map(text_width, lines), default=0)))
    made = []
    for cells in grid:
        height = max((len(lines) for _, _, lines in cells), default=0)
        for k in range(height):
            parts, at, where = [], 0, 0
            for column, span, lines in cells:
                text = lines[k] if k < len(lines) else ""
                start = sum(widths.get(c, 0) + 2 for c in range(column)) if column else 0
                if text:
                    parts.append(" " * max(start - where, 2 if parts else 0) + text)
                    where = max(start, where + 2 if len(parts) > 1 else 0) + text_width(text)
                at = column + span
            line = "".join(parts).rstrip()
            if line:
                made.append(line)
    flow.flush()
    flow.put(made, False)
    return flow.lines


def render(html: str | None) -> tuple[str, str]:
    """Title and visible text of a page; of a null or empty page, two empty strings."""
    if not html:
        return "", ""
    tree = build(html)
    title = next((texts_of(n) for n in descend(tree) if n.tag == "title"), "")
    flow = Flow()
    walk(tree, flow)
    return title, "\n".join(s.replace("\xa0", " ").rstrip() for s in flow.done())


def with_visible_text(df: DataFrame, html: str = "html", title: str = "title", text: str = "text") -> DataFrame:
    """Add the title and the laid out visible text of each page."""
    schema = T.StructType([T.StructField(title, T.StringType()), T.StructField(text, T.StringType())])
    return with_arrow(df, [html], schema, lambda: lambda pages: list(zip(*map(render, pages))))


def page_texts(pages: DataFrame) -> DataFrame:
    """Per page: id, address, title, text and its length; repeated rows are rendered alike."""
    made = with_visible_text(pages.select("page_id", "url", "html")).drop("html")
    return made.withColumn("n_chars", F.length("text").cast("long"))
