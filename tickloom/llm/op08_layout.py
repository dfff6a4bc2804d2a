"""HTML to text as it is laid out: all visible text, with block spacing, lists and aligned table cells.

A tokenizer splits tags, comments and text. A tree builder keeps the stack of
open elements: void elements, end tags that are implied (a block closes an open
p; li, dt, dd, tr, td, th, option, thead and the like close their own kind up to
the list or table they belong to), end tags without a start are ignored, and
everything open at the end is closed. Attributes are read into names and values,
as browsers read them.

Invisible: head and its contents, script, style, template, noscript, embedded
media with their fallbacks, closed dialogs, all but the first summary of closed
details, comments; elements with `hidden` (if
their style doesn't set another display) or a style of display: none, with all
that is inside; text under visibility: hidden or collapse, up to an element that
is visible again. Of form controls the text that they show: textarea, values of
text fields and buttons, the selected option of a select, all options of a list.

Layout: blocks stand on lines of their own, paragraphs, headings, lists and
tables between blank lines; br breaks a line; list items have "- " or their
number, nested lists are indented by two, up to `DEEPEST`; text in pre keeps its
spaces; elsewhere runs of white space are one space. Rows of a table are lines
of cells with " | " between; cells start where their column does, after colspan
and rowspan. Columns are as wide as their widest cell of at most `WIDEST`
characters, and nothing is padded beyond character `LINE`: longer cells stay
whole and push the rest of their row aside, so a page grows by a bounded factor.
A table within a cell is one line, as all of the cell, and isn't padded.

Defined cases: null or empty html gives an empty text; text without any tag is
one block; an unclosed tag or comment swallows the rest, as in browsers; a table
without rows gives its caption only; any depth of nesting is laid out, without
recursion; repeated rows render each; other columns pass through in `row`.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDEST, LINE, DEEPEST, MOST_SPAN = 60, 240, 40, 100
#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object canvas audio video datalist progress meter noembed noframes rp annotation annotation-xml desc metadata defs symbol clippath mask pattern marker".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = HEADINGS | frozenset("p ul ol menu dl table pre xmp listing blockquote figure".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd div dt fieldset figcaption footer form header html legend li main nav optgroup option search section summary tr caption".split())
CLOSES_P = SPACED | frozenset("hr address article aside center details dialog dir div fieldset figcaption footer form header main nav search section summary".split())
KEEPS_P = frozenset("table td th li button blockquote div article section".split())
FOREIGN = frozenset(("svg", "math"))
KEPT = frozenset("pre xmp listing textarea".split())
ROWS = frozenset("thead tbody tfoot tr".split())
TABLE_PARTS = ROWS | frozenset("td th caption colgroup table".split())
CELL_SCOPE = frozenset("table td th caption".split())
#: Types of input that show their value.
SHOWN_INPUTS = frozenset("text search email url tel number date time month week datetime-local submit button reset".split())
#: Element -> elements that its start tag closes, and where the search for them stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: A comment; a declaration or other non-element; or a tag: slash, name, and its attributes, where quotes count only after an equals sign.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
INTEGER = re.compile(r"\s*([+-]?\d{1,9})")
WHITE = re.compile(r"[ \t\n\r\f]+")


def attributes(raw: str) -> dict[str, str]:
    """Names (in lower case) and values; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def styles(style: str) -> dict[str, str]:
    """Property -> value in lower case; later ones win, `!important` ones over others."""
    out: dict[str, str] = {}
    strong: set[str] = set()
    for part in re.sub(r"/\*.*?\*/", "", style, flags=re.S).split(";"):
        name, colon, value = part.partition(":")
        name, (value, bang, rest) = name.strip().lower(), value.strip().lower().partition("!")
        important = bool(bang) and rest.strip() == "important"
        if colon and (important or name not in strong):
            out[name] = value.strip()
            if important:
                strong.add(name)
    return out


class Node:
    """An element with its children: nodes and text."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.children = tag, []
        self.attributes = attributes(raw) if raw and not raw.isspace() else {}

    def number(self, name: str, default: int) -> int:
        m = INTEGER.match(self.attributes.get(name, ""))
        return int(m[1]) if m else default


class Stack:
    """The open elements, with how many of each kind are open, so that a search for what isn't there ends at once."""

    def __init__(self, root: Node):
        self.nodes, self.count = [root], {}

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def cut(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.count[node.tag] -= 1
        del self.nodes[at:]

    def close(self, tags, within=frozenset(), every: bool = False) -> bool:
        """Closes the innermost open element of `tags` (with `every`, all of them), looking no further than one of `within`."""
        if not any(self.count.get(t) for t in tags):
            return False
        done = False
        for k in range(len(self.nodes) - 1, 0, -1):
            tag = self.nodes[k].tag
            if tag in tags:
                self.cut(k)
                done = True
                if not every:
                    break
            elif tag in within:
                break
        return done


def tree(source: str) -> Node:
    """The tree of all elements, with implied end tags."""
    root = Node("html")
    stack = Stack(root)
    at, end = 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else end]
        if text:
            if stack.nodes[-1].tag == "head" and not text.isspace():
                stack.cut(len(stack.nodes) - 1)
            stack.nodes[-1].children.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack.nodes[-1].children.append(Node("br"))
            elif tag in HEADINGS:
                stack.close(HEADINGS, CELL_SCOPE)
            else:
                stack.close((tag,), () if tag == "table" else ("table",) if tag in TABLE_PARTS else CELL_SCOPE)
            continue
        if tag == "html":
            continue
        if stack.nodes[-1].tag == "head" and tag not in UNSEEN and tag not in VOID:
            stack.cut(len(stack.nodes) - 1)
        if tag in CLOSES_P:
            stack.close(("p",), KEEPS_P)
        if tag in HEADINGS and stack.nodes[-1].tag in HEADINGS:
            stack.cut(len(stack.nodes) - 1)
        if tag in IMPLIED:
            closes, within = IMPLIED[tag]
            stack.close(closes, within, every=True)
        node = Node(tag, m[3])
        stack.nodes[-1].children.append(node)
        foreign = tag in FOREIGN or any(stack.count.get(t) for t in FOREIGN)
        if tag in VOID or foreign and m[3].endswith("/"):
            continue
        if tag in RAW:
            stop = RAW_END[tag].search(source, at)
            inner = source[at : stop.start() if stop else end]
            node.children.append(entities.unescape(inner) if tag == "textarea" else inner)
            at = stop.end() if stop else end
            continue
        stack.push(node)
    return root


class Page:
    """Lines of laid-out text; `wanted` counts the line breaks due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []  # pieces of the line that is being written
        self.written, self.wanted, self.space, self.indent, self.marker = False, 0, False, "", ""

    def gap(self, n: int) -> None:
        self.wanted, self.space = max(self.wanted, n), False

    def _break(self) -> None:
        self.lines.append("".join(self.now))
        self.now = []

    def put(self, text: str, keep: bool = False) -> None:
        if self.wanted:
            if self.written:
                for _ in range(self.wanted):
                    self._break()
            self.wanted = 0
        if not self.now:
            self.now = [self.indent, self.marker]
            self.indent = (self.indent + " " * len(self.marker))[: max(DEEPEST, len(self.indent))]
            self.marker = ""
        elif self.space and not self.now[-1].endswith(" "):
            self.now.append(" ")
        self.space, self.written = False, True
        if keep:
            first, *rest = text.split("\n")
            self.now.append(first)
            for line in rest:
                self._break()
                self.now = [self.indent, line]
        else:
            self.now.append(text)

    def text(self, raw: str, keep: bool) -> None:
        if keep:
            self.put(raw.expandtabs(8), True)
            return
        inner = WHITE.sub(" ", raw)
        lead, trail, inner = inner.startswith(" "), inner.endswith(" "), inner.strip(" ")
        if lead:
            self.space = True
        if inner:
            self.put(inner)
            self.space = trail

    def done(self) -> list[str]:
        if self.now:
            self._break()
        return self.lines

    def one_line(self) -> str:
        return " ".join(x for x in (line.strip() for line in self.done()) if x)


class Table:
    """Cells by row and column; `taken` has the columns that cells above still fill, and for how many rows."""

    def __init__(self):
        self.captions: list[str] = []
        self.rows: list[list[tuple[int, str, int]]] = []
        self.taken: dict[int, int] = {}
        self.column = 0

    def row(self) -> None:
        if self.rows:
            self.taken = {k: n - 1 for k, n in self.taken.items() if n > 1}
        self.rows.append([])
        self.column = 0

    def cell(self, node: Node, text: str) -> None:
        if not self.rows:
            self.row()
        while self.taken.get(self.column):
            self.column += 1
        wide, high = (min(max(node.number(k, 1), 1), MOST_SPAN) for k in ("colspan", "rowspan"))
        self.rows[-1].append((self.column, text, wide))
        if high > 1:
            for k in range(wide):
                self.taken[self.column + k] = high
        self.column += wide

    def laid_out(self, aligned: bool) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for k, text, wide in row:
                if wide == 1 and len(text) <= WIDEST:
                    width[k] = max(width.get(k, 0), len(text))
        starts, total = [0], 0
        for k in range(max((k for row in self.rows for k, _, _ in row), default=0)):
            total += width.get(k, 0) + 3
            starts.append(total)
        out = []
        for row in self.rows:
            if not any(text for _, text, _ in row):
                continue
            pieces, length = [], 0
            for n, (k, text, _) in enumerate(row):
                if k:
                    before = starts[k] - 3
                    if aligned and length < before <= LINE:
                        pieces.append(" " * (before - length))
                        length = before
                    if n or aligned:
                        pieces.append(" | ")
                        length += 3
                pieces.append(text)
                length += len(text)
            out.append("".join(pieces).rstrip())
        return self.captions + out


def render(source: str | None) -> str:
    """The visible text of a page."""
    page = Page()
    _lay(tree(source or ""), page)
    return "\n".join(x.rstrip() for x in page.done()).strip("\n")


def _appearance(node: Node, shown: bool) -> bool | None:
    """None: not laid out, nor what is inside. Else whether its own text is visible."""
    if node.tag in UNSEEN:
        return None
    a = node.attributes
    if not a:
        return None if node.tag == "dialog" else shown
    style = styles(a["style"]) if "style" in a else {}
    display = style.get("display")
    if display == "none" or display is None and ("hidden" in a or node.tag == "dialog" and "open" not in a):
        return None
    seen = style.get("visibility")
    return False if seen in ("hidden", "collapse") else True if seen == "visible" else shown


def _shown_options(select: Node) -> list[Node]:
    """The options that a select shows: all of a list, else the last selected one, or the first that isn't disabled."""
    options, walk = [], list(reversed(select.children))
    while walk:
        x = walk.pop()
        if isinstance(x, Node):
            if x.tag == "option":
                options.append(x)
            else:
                walk += reversed(x.children)
    if "multiple" in select.attributes or select.number("size", 1) > 1:
        return options
    chosen = [x for x in options if "selected" in x.attributes]
    return chosen[-1:] or [x for x in options if "disabled" not in x.attributes][:1]


def _lay(root: Node, page: Page) -> None:
    """Lays out a tree by a list of things to do; cells and captions are filled on pages of their own, on top of `pages`."""
    pages, tables = [page], []
    work: list[tuple] = [("open", root, False, True, None)]
    while work:
        what, item, keep, shown, extra = work.pop()
        page = pages[-1]
        if what == "open" and isinstance(item, str):
            if shown:
                page.text(item, keep)
        elif what == "open":
            if (shown := _appearance(item, shown)) is None:
                continue
            _open(item, page, tables, work, keep, shown, extra)
        elif what == "part":
            _part(item, pages, tables[-1], work, shown)
        elif what == "gap":
            page.gap(extra)
        elif what == "space":
            page.space = True
        elif what == "indent":
            page.indent, page.marker = item, ""
        elif what == "cell":
            tables[-1].cell(item, pages.pop().one_line())
        elif what == "caption":
            tables[-1].captions += [x for x in [pages.pop().one_line()] if x]
        elif what == "table":
            lines = tables.pop().laid_out(aligned=len(pages) == 1)
            for line in lines:
                page.put(line)
                page.gap(1)
            page.gap(2)


def _open(node: Node, page: Page, tables: list[Table], work: list[tuple], keep: bool, shown: bool, number: int | None) -> None:
    """Begins an element, and puts what it holds and what ends it on the list."""
    tag = node.tag
    if tag == "br":
        if page.wanted:
            page.put("")
        page.gap(1)
        return
    if tag == "hr":
        page.gap(2)
        return
    if tag == "input":
        if shown and node.attributes.get("type", "text").strip().lower() in SHOWN_INPUTS and node.attributes.get("value"):
            page.text(f" {node.attributes['value']} ", False)
        return
    if tag == "table":
        page.gap(2)
        tables.append(Table())
        work.append(("table", None, keep, shown, 0))
        work += [("part", x, False, shown, 0) for x in reversed(node.children)]
        return
    inner = node.children
    if tag == "select":
        inner = [x for o in _shown_options(node) for x in (" ", *o.children, " ")]
    elif tag == "details" and "open" not in node.attributes:
        inner = [x for x in inner if isinstance(x, Node) and x.tag == "summary"][:1]
    nested = tag in ("ul", "ol", "menu") and page.indent
    gap = 1 if nested else 2 if tag in SPACED else 1 if tag in BLOCK else 0
    if gap:
        page.gap(gap)
        work.append(("gap", None, keep, shown, gap))
    elif tag in ("text", "button", "textarea"):  # boxes of their own within a line
        page.space = True
        work.append(("space", None, keep, shown, 0))
    keep = keep or tag in KEPT
    if tag in KEPT and inner and isinstance(inner[0], str) and inner[0].startswith("\n"):
        inner = [inner[0][1:], *inner[1:]]
    if tag in ("li", "dd", "blockquote"):
        work.append(("indent", page.indent, keep, shown, 0))
        if tag == "li":
            page.marker = "- " if number is None else f"{number}. "
        elif len(page.indent) < DEEPEST:
            page.indent += "  "
    todo, count = [], node.number("start", 1) if tag == "ol" else 0
    for child in inner:
        n = None
        if tag == "ol" and isinstance(child, Node) and child.tag == "li":
            count = child.number("value", count)
            n, count = count, count + 1
        todo.append(("open", child, keep, shown, n))
    work += reversed(todo)


def _part(item: Node | str, pages: list[Page], table: Table, work: list[tuple], shown: bool) -> None:
    """A child of a table or of its row groups and rows; what doesn't belong there stands before the table."""
    if isinstance(item, str):
        if shown and not item.isspace():
            table.captions.append(WHITE.sub(" ", item).strip(" "))
        return
    if (shown := _appearance(item, shown)) is None:
        return
    if item.tag in ROWS or item.tag == "form":
        if item.tag == "tr":
            table.row()
        work += [("part", x, False, shown, 0) for x in reversed(item.children)]
        return
    pages.append(Page())
    if item.tag in ("td", "th"):
        work.append(("cell", item, False, shown, 0))
        work += [("open", x, False, shown, None) for x in reversed(item.children)]
    else:
        work.append(("caption", item, False, shown, 0))
        work.append(("open", item, False, shown, None))


def rendered(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """`row` (the input row, or its columns in `carry`) and `text`, page by page where the page is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([render(x.as_py()) for x in part.column("html")], pa.string())], names=["row", "text"])

    source = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry or pages.columns]).alias("row"), F.col(html_col).alias("html"))
    return source.mapInArrow(run, T.StructType([source.schema["row"], T.StructField("text", T.StringType())]))


def digest(pages: DataFrame) -> DataFrame:
    return rendered(pages, carry=["page_id"]).select(F.col("row.page_id").alias("page_id"), "text", F.char_length("text").cast("long").alias("n_chars"))
