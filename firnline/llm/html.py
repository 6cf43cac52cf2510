"""Text of web pages as they would be laid out.

A tree builder reads tags with the usual implied ends (a paragraph ends where a block begins, a cell where the next
one does), keeps raw text elements whole and takes stray end tags. The renderer walks the tree without recursion: it leaves out
what is not shown (scripts, styles, templates, hidden elements and those that an inline style hides, closed details), collapses
blanks except in preformatted text, puts blocks on lines of their own with empty lines where paragraphs, headings, lists and tables have
a margin, marks and indents list items, and aligns the cells of a table in columns. All visible text is kept, that of formulas, drawings and
the contents of objects too. Work grows in proportion to the page, however its tags are nested.

Defined cases: NULL and empty pages give the empty text; a comment or an element that is cut off goes to the end, a tag that is cut off and a lone `<` are text; repeated
ids are rendered per row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import column, map_batches

# Element names of the HTML standard by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe noembed noframes noscript textarea title xmp".split())
NOT_SHOWN = set("head script style template iframe noembed noframes noscript title datalist audio video canvas annotation annotation-xml defs desc metadata".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary ul xmp caption".split())
MARGIN = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul xmp".split())
TABLE_PARTS = set("table thead tbody tfoot tr td th caption colgroup".split())
# Start tags that end an open element, and the elements at which the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
ENDS_PARAGRAPH = BLOCK - {"html", "body", "option", "optgroup", "legend", "caption"} | {"table"}
HEAD_PARTS = set("base link meta title style script noscript template head html".split())

# A tag that does not end before the next one begins is text, so no part of a page is looked through again and again.
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")

#: A column is as wide as its widest cell of at most so many characters; longer cells stand out.
MOST_WIDTH = 80
MOST_SPAN = 1000
#: Lines are indented by at most so many blanks, and tables inside more tables than this are laid out as blocks.
MOST_INDENT = 60
#: Columns that would begin behind this place in a line are not aligned.
MOST_EDGE = 500
MOST_TABLES = 20


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(html: str) -> Node:
    """Tree of a page; texts are strings among the children."""
    root = Node("#root", {})
    stack = [root]
    # Places in the stack of the open elements of each name.
    places: defaultdict[str, list[int]] = defaultdict(list)
    at, size = 0, len(html)

    def text(raw: str) -> None:
        if raw:
            # Text ends the head.
            if places["head"] and raw.strip():
                close({"head"}, set())
            stack[-1].children.append(unescape(raw))

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def close(tags: set[str], stops: set[str]) -> bool:
        """End the innermost open element of these, and what is inside it, unless one of the stops is inside it."""
        i = innermost(tags)
        if not i or innermost(stops) > i:
            return False
        while len(stack) > i:
            places[stack.pop().tag].pop()
        return True

    while at < size:
        found = TOKEN.search(html, at)
        if not found:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p":
                if not close({"p"}, {"td", "th", "table"}):
                    stack[-1].children.append(Node("p", {}))
            else:
                close({tag}, set() if tag in TABLE_PARTS - {"caption"} or tag in ("body", "html") else {"td", "th", "table", "caption"} - {tag})
            continue
        attributes = {}
        if found[3]:
            for a in ATTRIBUTE.finditer(found[3]):
                attributes.setdefault(a[1].lower(), unescape(next((v for v in a.groups()[1:] if v is not None), "")))
        if tag not in HEAD_PARTS and places["head"]:
            close({"head"}, set())
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"td", "th", "table", "caption", "button", "object"})
        if tag in ENDS:
            if tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                close(*ENDS[tag])
                if tag == "tr":
                    close({"tr"}, {"table", "thead", "tbody", "tfoot"})
            else:
                close(ENDS[tag][0], ENDS[tag][1] | ({"td", "th", "table"} if tag != "body" else set()))
        if tag in ("html", "body") and places[tag]:
            continue
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            raw = html[at : end.start() if end else size]
            at = end.end() if end else size
            if tag in ("textarea", "title"):
                raw = unescape(raw)
            node.children.append(raw)
        elif not (found[3].rstrip().endswith("/") and (tag in ("svg", "math") or places["svg"] or places["math"])):
            # Only formulas and drawings have elements that end themselves.
            places[tag].append(len(stack))
            stack.append(node)
    return root


def shown(node: Node) -> bool:
    if node.tag in NOT_SHOWN:
        return False
    a = node.attributes
    if "hidden" in a and a["hidden"].lower() != "until-found" or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return not ("style" in a and HIDING.search(a["style"]))


class Flow:
    """Lines of a block container: inline text runs are collected until a block begins or ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.indents: list[str] = []
        self.mark = ""
        self.gap = False

    def put(self, text: str, keep: bool) -> None:
        if keep:
            *whole, rest = text.split("\n")
            for line in whole:
                self.run.append(line)
                self.line(True)
            self.run.append(rest)
            return
        text = BLANKS.sub(" ", text)
        if text.startswith(" ") and (not self.run or self.run[-1].endswith((" ", "\n"))):
            text = text[1:]
        if text:
            self.run.append(text)

    def line(self, forced: bool = False) -> None:
        """End the line; an empty one only counts if it is forced."""
        text = "".join(self.run)
        self.run = []
        if text.strip(" ") or forced:
            self.add(text.rstrip(" "))

    def add(self, text: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        # The innermost ones first: of deep lists only the last levels are told apart anyway.
        depth, indent = len(self.indents), ""
        while depth and len(indent) < MOST_INDENT:
            depth -= 1
            indent += self.indents[depth]
        if self.mark:
            indent = indent[: len(indent) - len(self.mark)] + self.mark
            self.mark = ""
        self.lines.append((indent + text).rstrip(" "))

    def text(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        first = next((i for i, x in enumerate(self.lines) if x), 0)
        return self.lines[first:]


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int]]] = []

    def cell(self, lines: list[str], span: int) -> None:
        if not self.rows:
            self.rows.append([])
        self.rows[-1].append((lines, span))

    def text(self) -> list[str]:
        """Rows with cells under each other. A line of a cell begins where its column does, or two blanks behind a longer one before it."""
        widths: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for lines, span in row:
                if span == 1:
                    widths[at] = max([widths.get(at, 0), *(len(x) for x in lines if len(x) <= MOST_WIDTH)])
                at += span
        columns = sorted(widths)
        upto = [0, *accumulate(widths[c] for c in columns)]
        out = []
        for row in self.rows:
            height = max((len(lines) for lines, _ in row), default=0)
            parts: list[list[str]] = [[] for _ in range(height)]
            ends = [0] * height
            at = 0
            for i, (lines, span) in enumerate(row):
                edge = min(upto[bisect_left(columns, at)] + 2 * at, MOST_EDGE)
                for k, line in enumerate(lines):
                    if i:
                        gap = max(edge - ends[k], 2) if ends[k] else edge
                        parts[k].append(" " * gap)
                        ends[k] += gap
                    parts[k].append(line)
                    ends[k] += len(line)
                at += span
            out += ["".join(p).rstrip(" ") for p in parts]
        return out


def render(root: Node) -> str:
    """Visible text of a tree."""
    flows, tables, lists = [Flow()], [], []
    pre = 0
    work: list[tuple[Node | str, bool]] = [(root, True)]
    while work:
        node, entering = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            # Blanks between rows and cells are no text of the table.
            flow.put(node, pre > 0)
            continue
        tag = node.tag
        if entering:
            if not shown(node):
                continue
            if tag == "br":
                flow.line(True)
                continue
            if tag == "hr":
                flow.line()
                flow.gap = True
                continue
            if tag in VOID:
                if tag == "img" and node.attributes.get("alt"):
                    flow.put(node.attributes["alt"], False)
                elif tag == "input" and node.attributes.get("value") and node.attributes.get("type", "text").lower() in ("text", "button", "submit", "reset"):
                    flow.put(node.attributes["value"], False)
                continue
            if tag in BLOCK or tag == "table":
                flow.line()
                flow.gap |= tag in MARGIN and not (tag in ("ul", "ol", "menu") and lists)
            if tag in ("pre", "xmp", "textarea"):
                pre += 1
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "")
                lists.append([tag, int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    value = node.attributes.get("value", "")
                    lists[-1][1] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else lists[-1][1] + 1
                    mark = f"{lists[-1][1]}. "
                flow.indents.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("dd", "blockquote"):
                flow.indents.append("  ")
            elif tag == "table":
                tables.append(Table() if len(tables) < MOST_TABLES else None)
                lists.append(["table", 0])
            elif tag in ("tr", "td", "th") and tables and not tables[-1]:
                flow.line()
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables:
                flows.append(Flow())
            elif tag == "text":
                flow.put(" ", False)
            work.append((node, False))
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag in ("table", "thead", "tbody", "tfoot", "tr"):
                children = [c for c in children if isinstance(c, Node) or c.strip()]
            work.extend((c, True) for c in reversed(children))
            continue
        if tag in ("td", "th") and tables and tables[-1]:
            span = node.attributes.get("colspan", "")
            done = flows.pop().text()
            tables[-1].cell(done, min(max(int(span), 1), MOST_SPAN) if re.fullmatch(r"\d{1,9}", span) else 1)
            continue
        if tag == "table":
            lists.pop()
            done = tables.pop()
            flow.line()
            for x in done.text() if done else []:
                flow.add(x)
            flow.gap = True
            continue
        if tag in ("pre", "xmp", "textarea"):
            pre -= 1
        if tag in BLOCK:
            flow.line()
            if tag == "li":
                flow.indents.pop()
                flow.mark = ""
            elif tag in ("dd", "blockquote"):
                flow.indents.pop()
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            flow.gap |= tag in MARGIN and not (tag in ("ul", "ol", "menu") and bool(lists))
    return "\n".join(flows[0].text())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) for every row."""

    def work(batch: pa.RecordBatch):
        html = column(batch, "html")
        for lo in range(0, len(html), 64):
            some = html.slice(lo, 64).to_pylist()
            yield {"page_id": column(batch, "page_id").slice(lo, len(some)), "text": [render(parse(h)) if h else "" for h in some]}

    return map_batches(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")), work, "page_id long, text string")
