"""Visible text of web pages, laid out: a small tree of elements, then one walk over it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head script style template noscript iframe object svg canvas audio video datalist title meta link".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure form fieldset hr".split())
BLOCKS = PARAGRAPHS | set("address article aside body center dd details dialog div dt figcaption footer header hgroup html legend li main menu nav option optgroup section summary tr caption".split())
#: What a start tag ends, and the elements behind which open ones are left alone.
ENDS = {
    **dict.fromkeys(BLOCKS - set("li dd dt option optgroup tr caption body html".split()), ({"p"}, {"button", "td", "th", "caption", "object"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu", "td", "th"}),
    "dt": ({"dt", "dd", "p"}, {"dl", "td", "th"}),
    "dd": ({"dt", "dd", "p"}, {"dl", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    **dict.fromkeys(("td", "th"), ({"td", "th", "caption", "colgroup", "p"}, {"table", "tr"})),
    "tr": ({"tr", "td", "th", "caption", "colgroup", "p"}, {"table", "tbody", "thead", "tfoot"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup", "p"}, {"table"})),
}
LISTS, INDENTED = ("ul", "ol", "menu"), ("blockquote", "dd")
HEAD = set("title meta link style script base noscript template".split())
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Builds the tree; a start tag ends the elements that it implies the end of, an end tag without a start is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.counts: dict[str, int] = {}

    def pop(self) -> None:
        self.counts[self.open.pop().tag] -= 1

    def end(self, tags: set[str], fence: set[str]) -> None:
        """Ends the outermost open element of ``tags`` this side of the fence, with all within it."""
        if not any(self.counts.get(t) for t in tags):
            return
        last = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in fence:
                break
            if self.open[i].tag in tags:
                last = i
        while last is not None and len(self.open) > last:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" or tag == "body" and "body" in self.counts:
            return
        if self.counts.get("head") and tag not in HEAD:
            self.end({"head"}, set())
        if tag in ENDS:
            self.end(*ENDS[tag])
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif self.counts.get(tag) and tag not in ("html", "body"):
            fence = {"table"} if tag not in ("table", "article", "section", "div", "main") else set()
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    while len(self.open) > i:
                        self.pop()
                    break
                if self.open[i].tag in fence:
                    break

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.end({"head"}, set())
        self.open[-1].children.append(data)


def hidden(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a or node.tag == "input":
        return True
    return "style" in a and bool(HIDING.search(a["style"] or ""))


class Page:
    """Text that grows line by line: white space collapses, blocks ask for line ends before what follows."""

    def __init__(self):
        self.out: list[str] = []
        self.need, self.space, self.prefix, self.lead = 0, False, "", ""
        self.marks: list[str] = []  # list marks that wait for their item's first text
        self.indents: list[int] = []

    def start(self) -> None:
        """What stands before a run of text: line ends, indents, list marks, or a space."""
        if self.need or not self.out:
            marks = "".join(self.marks)
            self.out.append("\n" * (self.need if self.out else 0) + self.prefix[: len(self.prefix) - len(marks)] + marks)
        elif self.space:
            self.out.append(" ")
        self.marks.clear()
        self.need, self.space = 0, False

    def block(self, lines: int) -> None:
        if not self.marks:
            self.need = max(self.need, lines)

    def text(self, data: str) -> None:
        words = SPACE.sub(" ", data)
        if words.strip(" "):
            self.space |= words[0] == " "
            self.start()
            self.out.append(words.strip(" "))
            self.space = words[-1] == " "
        elif words:
            self.space = True

    def raw(self, data: str) -> None:
        """Lines as they stand, of preformatted text or a table; of blank lines in a row one stays."""
        for i, line in enumerate(data.split("\n")):
            if i:
                self.need, self.lead = min(self.need + 1, 2), ""
            if not line.strip() and self.need:
                self.lead += line
            elif line:
                self.space = False
                self.start()
                self.out.append(self.lead + line)
                self.lead = ""

    def item(self, mark: str) -> None:
        self.marks.append(mark)
        self.indents.append(len(mark))
        self.prefix += " " * len(mark)

    def item_end(self) -> None:
        self.prefix = self.prefix[: len(self.prefix) - self.indents.pop()]
        if self.marks:
            self.marks.pop()


def _span(node: Node, name: str) -> int:
    given = node.attrs.get(name) or "1"
    return max(1, min(int(given), 1000)) if given.isascii() and given.isdigit() else 1


def cell_rows(table: Node) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Captions and rows of (text, columns, rows) of a table; blocks and tables within a cell run on in its line."""
    captions, rows, todo = [], [], [*reversed(table.children)]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if node.strip():
                captions.append(SPACE.sub(" ", node).strip())
        elif hidden(node):
            continue
        elif node.tag in ("td", "th"):
            if not rows:
                rows.append([])
            rows[-1].append((render(node, True), _span(node, "colspan"), _span(node, "rowspan")))
        elif node.tag in ("tr", "tbody", "thead", "tfoot"):
            if node.tag == "tr":
                rows.append([])
            todo.extend(reversed(node.children))
        else:
            captions.append(render(node, True))
    return [c for c in captions if c], rows


def columns(text: str) -> int:
    """Places a text takes in a line of even letters: two for each wide character, none for a combining one."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def placed_rows(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, str, int]]]:
    """Rows of (first column, text, columns): a cell goes to the first place that no cell from above reaches into."""
    out, taken = [], {}  # column -> rows below that a cell still covers
    for row in rows:
        line, at, fresh = [], 0, {}
        for text, wide, deep in row:
            while taken.get(at, 0):
                at += 1
            line.append((at, text, wide))
            if deep > 1:
                fresh.update(dict.fromkeys(range(at, at + wide), deep - 1))
            at += wide
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | fresh
        out.append(line)
    return out


def table_lines(table: Node) -> str:
    """Cells of a column start below one another, two spaces behind the widest of the column before.

    A cell of several rows stands in the first of them and keeps its columns free in the others. Rows without text give no line.
    """
    captions, rows = cell_rows(table)
    widths: dict[int, int] = {}
    placed = placed_rows(rows)
    for row in placed:
        for at, text, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), columns(text))
    lines, starts = list(captions), [0]
    for c in range(max(widths, default=-1) + 1):
        starts.append(starts[-1] + widths.get(c, 0) + 2)
    begin = lambda c: starts[c] if c < len(starts) else starts[-1] + 2 * (c - len(starts) + 1)
    for row in placed:
        line, used = "", 0
        for at, text, _ in row:
            gap = max(begin(at) - used, 2 if line else 0)
            line, used = line + " " * gap + text, used + gap + columns(text)
        if line.strip():
            lines.append(line.rstrip())
    return "\n".join(lines)


def render(root: Node, inline: bool = False) -> str:
    """Visible text of a tree. ``inline``: all in one line. The walk keeps a stack of its own, so depth is no matter."""
    page, todo, lists, pre, seen = Page(), [(root, False)], [], 0, [True]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if seen[-1]:
                page.raw(node) if pre and not inline else page.text(node)
            continue
        tag, lines = node.tag, 2 if node.tag in PARAGRAPHS else 1 if node.tag in BLOCKS else 0
        if lists and tag in ("ul", "ol", "p"):
            lines = 1  # no blank lines within a list
        if inline and (lines or tag in ("br", "td", "th")):
            page.space, lines = True, 0
        if leaving:
            seen.pop()
            pre -= tag == "pre"
            if tag in LISTS:
                lists.pop()
                lines = 0 if inline else 1 if lists else 2
            elif tag == "li" and not inline:
                page.item_end()
            elif tag in INDENTED and not inline:
                page.prefix = page.prefix[:-2]
            page.block(lines)
            continue
        if hidden(node):
            continue
        if tag == "br" and not inline:
            page.need = min(page.need + 1, 2)
        page.block(lines)
        if tag in VOID:
            continue
        style = VISIBILITY.search(node.attrs["style"] or "") if "style" in node.attrs else None
        seen.append(style[1].lower() == "visible" if style else seen[-1])
        todo.append((node, True))
        if tag == "table" and not inline:
            page.raw(table_lines(node) if seen[-1] else "")
            continue
        pre += tag == "pre"
        if tag in LISTS:
            first = node.attrs.get("start") or "1"
            lists.append([int(first) - 1 if re.fullmatch(r"-?[0-9]{1,9}", first) else 0, tag == "ol"])
        elif tag == "li" and not inline:
            top = lists[-1] if lists else [0, False]
            top[0] += 1
            page.item(f"{top[0]}. " if top[1] else "- ")
        elif tag in INDENTED and not inline:
            page.prefix += "  "
        shown = node.children
        if tag == "details" and "open" not in node.attrs:
            shown = [c for c in shown if not isinstance(c, str) and c.tag == "summary"]
        todo.extend((c, False) for c in reversed(shown))
    return "".join(page.out)


def visible_text(html: str | None) -> str | None:
    """Text of a page as a reader sees it; null for null."""
    if html is None:
        return None
    tree = Tree()
    tree.feed(html)
    tree.close()
    return render(tree.root)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines, n_words) of every row of ``pages`` (page_id, html, any others).

    Blocks start lines, paragraphs are set apart by a blank line, list items carry marks and indents, cells of a table
    stand in columns. Hidden elements, scripts and the like give no text. A null page has null text and counts of 0, an
    empty one empty text; broken markup is read as far as it goes. Repeated rows and rows with a null page_id stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(h.as_py()) for h in batch.column("html")]
            lines = [sum(1 for x in (t or "").split("\n") if x.strip()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array([len((t or "").split()) for t in texts], pa.int64())], names=["page_id", "text", "n_lines", "n_words"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id bigint, text string, n_lines bigint, n_words bigint")


def op10_html_layout(spark: SparkSession, sf: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf}/pages.parquet"))


QUERIES = {"op10_html_layout": (op10_html_layout, None)}
