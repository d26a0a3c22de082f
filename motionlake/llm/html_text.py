"""Layout-aware text of HTML pages.

A tree builder reads any input: missing html, head, body, tbody and tr are implied, paragraphs, list items, table parts
and options end where a browser ends them, misnested inline tags don't end blocks, and text that stands in a table but
in no cell goes before it. Visibility rules leave out what a browser doesn't show: scripts, the head, hidden and closed
elements, and what inline styles or simple rules of style sheets take out. The rest is laid out: blocks on lines of
their own, one blank line where blocks have margins, lists with bullets or numbers and indentation, preformatted text as
it is, and table cells padded to their columns. All visible text is emitted.

A page is parsed in one pass, in memory that follows its size; pages are independent, so nothing is shuffled.

Edge cases: null and empty pages give an empty text; a null key stays null; text without tags is one paragraph; elements
nested deeper than ``MAX_DEPTH`` become siblings, as in browsers, so no text is lost; repeated rows give equal rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_DEPTH = 256
#: Widest padding of a table's column; longer cells run over.
MAX_COLUMN = 60

# Fixed values of HTML: elements by what ends or hides them, and how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("textarea title".split())
HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span abbr cite kbd samp var sub sup label mark q".split())
SCOPE = frozenset("html table td th caption template object marquee applet".split())
SECTIONS = frozenset("tbody thead tfoot".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
TABLE_CONTENT = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())
BLOCKS = ENDS_P | frozenset("html body caption legend optgroup option tr td th tbody thead tfoot".split()) - {"optgroup", "option"}
MARGINS = frozenset("p ul ol dl dir menu blockquote h1 h2 h3 h4 h5 h6 pre xmp table figure hr fieldset".split())
HIDDEN = frozenset("head script style template title noframes noembed iframe datalist rp area param audio video canvas object meta link base col colgroup".split())
LISTS = frozenset("ul ol dir menu".split())

TAG = re.compile(r"<!--(.*?)(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))|(?!\s*=))""")
TAG_END = re.compile(r"[\s/]*+>")
SPACE = re.compile(r"[ \t\n\r\f]+")
STYLE_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
GONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.IGNORECASE)
SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class Builder:
    """Open elements as a stack, from the root on."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack, self.open = [self.root], Counter(["html"])
        self.head_done, self.styles = False, []

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        while len(self.stack) >= MAX_DEPTH:
            self.pop()
        self.place(node, tag not in TABLE_CONTENT)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def place(self, child: Node | str, outside: bool) -> None:
        """Append to the innermost element, or before the table if that element takes no such content."""
        top = self.stack[-1]
        if outside and top.tag in TABLE_PARTS and len(self.stack) > 1:
            k = max((i for i, n in enumerate(self.stack) if n.tag == "table"), default=0)
            if k:
                siblings = self.stack[k - 1].children
                at = next((i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is self.stack[k]), len(siblings))
                siblings.insert(at, child)
                return
        top.children.append(child)

    def pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def pop_to(self, index: int) -> None:
        while len(self.stack) > max(1, index):
            self.pop()

    def find(self, names: frozenset[str] | set[str], barrier: frozenset[str] | set[str]) -> int:
        """Place of the innermost open element of the names, or 0 if there is none or a barrier stands before it."""
        if not any(self.open[n] for n in names):
            return 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in names:
                return i
            if self.stack[i].tag in barrier:
                break
        return 0

    def close(self, names: set[str], barrier: frozenset[str] | set[str] = SCOPE) -> None:
        if i := self.find(names, barrier):
            self.pop_to(i)

    def to_body(self) -> None:
        if not self.head_done:
            self.head_done = True
            self.close({"head"})
            if not self.open["body"]:
                self.push("body", {})

    def clear_to(self, names: set[str]) -> None:
        if i := self.find(names, {"html"}):
            self.pop_to(i + 1)

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head" and not self.head_done and not self.open["head"]:
                self.push("head", attributes)
            if tag == "body":
                self.head_done = self.head_done or bool(self.open["body"])
                self.to_body()
                for n in self.stack:
                    if n.tag == "body":
                        n.attributes |= {k: v for k, v in attributes.items() if k not in n.attributes}
            return
        if tag not in HEAD:
            self.to_body()
        if tag in ENDS_P and self.open["p"]:
            self.close({"p"}, SCOPE | {"button"})
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        elif tag == "li":
            self.close({"li"}, SCOPE | LISTS)
        elif tag in ("dt", "dd"):
            self.close({"dt", "dd"}, SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            self.close({"option"} if tag == "option" else {"option", "optgroup"}, SCOPE | {"select"})
        elif tag == "a" and self.open["a"]:
            self.end("a")
        elif tag == "table" and self.stack[-1].tag in TABLE_PARTS:
            self.close({"table"}, {"td", "th", "caption"})
        elif tag in TABLE_CONTENT and tag not in HEAD and self.open["table"]:
            cell = self.find({"td", "th", "caption"}, {"table"})
            if cell:
                self.pop_to(cell)
            if tag in ("td", "th"):
                if not self.find({"tr"}, {"table"}):
                    self.start("tr", {}, False)
                self.clear_to({"tr"})
            elif tag == "tr":
                if not self.find(SECTIONS, {"table"}):
                    self.clear_to({"table"})
                    self.push("tbody", {})
                self.clear_to(set(SECTIONS))
            else:
                self.clear_to({"table"})
        elif tag in TABLE_CONTENT and tag not in HEAD:
            return  # parts of no table
        self.push(tag, attributes)
        if closed and self.open["svg"] and self.stack[-1].tag == tag:
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "head":
            self.close({"head"})
        elif tag == "p" and not self.find({"p"}, SCOPE | {"button"}):
            self.start("p", {}, False)
            self.pop()
        elif tag in ("body", "html") or not self.open[tag]:
            return
        elif tag in FORMATTING:
            i = self.find({tag}, SCOPE)
            if i and any(n.tag in BLOCKS for n in self.stack[i + 1 :]):
                del self.stack[i]
                self.open[tag] -= 1
            elif i:
                self.pop_to(i)
        elif tag in HEADINGS:
            self.close(set(HEADINGS))
        elif tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            self.close({tag}, {"html"} if tag == "table" else {"table"})
        else:
            self.close({tag}, SCOPE | LISTS if tag == "li" else SCOPE)

    def text(self, text: str) -> None:
        if not text:
            return
        if text.isspace():
            if self.head_done and self.stack[-1].tag not in TABLE_PARTS:
                self.stack[-1].children.append(text)
            return
        if not (self.open["title"] or self.open["textarea"]):
            self.to_body()
        self.place(text, True)


def attributes_at(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes of a tag, whether it ends in a slash, and where it ends; -1 if it never does."""
    found: dict[str, str] = {}
    while True:
        if m := TAG_END.match(page, at):
            return found, "/" in m[0], m.end()
        m = ATTRIBUTE.match(page, at)
        if not m or m.end() == at:
            return found, False, -1
        value = m[2] or ""
        found.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
        at = m.end()


def parse(page: str) -> Builder:
    build, at = Builder(), 0
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    while m := TAG.search(page, at):
        build.text(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        attributes, closed, at = attributes_at(page, at)
        if at < 0:  # the page ends inside the tag
            return build
        if m[2]:
            build.end(tag)
            continue
        build.start(tag, attributes, closed)
        if tag in RAW or tag in RCDATA:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            body = page[at : stop.start() if stop else len(page)]
            if tag == "style":
                build.styles.append(body)
            elif tag in RCDATA and build.stack[-1].tag == tag:
                build.stack[-1].children.append(html.unescape(body.removeprefix("\n") if tag == "textarea" else body))
            elif tag == "xmp":
                build.stack[-1].children.append(body)
            at = attributes_at(page, stop.end())[2] if stop else len(page)
            if build.stack[-1].tag == tag:
                build.pop()
            if at < 0:
                return build
    build.text(html.unescape(page[at:]))
    return build


def hiding_rules(styles: list[str]) -> list[tuple[str, frozenset[str]]]:
    """(tag or '', classes and ids) of simple selectors whose rule takes elements out."""
    rules = []
    for sheet in styles:
        for selectors, body in STYLE_RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.DOTALL)):
            if GONE.search(body):
                for s in selectors.split(","):
                    if (m := SIMPLE.fullmatch(s.strip())) and m[0]:
                        rules.append(((m[1] or "").lower(), frozenset(re.findall(r"[.#][\w-]+", m[2]))))
    return rules


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def numeral(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            while n >= value:
                n, out = n - value, out + sign
        return out if kind == "i" else out.upper()
    return str(n)


def whole(text: str | None, default: int, least: int, most: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return min(max(int(m[1]), least), most) if m else default


class Page:
    """Lines laid out so far, and the line that is being filled."""

    def __init__(self, rules: list[tuple[str, frozenset[str]]]):
        self.rules, self.lines, self.line, self.gap, self.indent, self.bullet, self.tables = rules, [], [], 0, "", None, 0

    def write(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self.line.append(first)
            for part in rest:
                self.end_line(True)
                self.line.append(part)
            return
        text = SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.line.append(text)

    def end_line(self, blank: bool = False) -> None:
        """End the line; an empty one stays if it is asked for."""
        text = "".join(self.line).rstrip(" ")
        self.line = []
        if not text and not blank:
            return
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        head = self.indent
        if self.bullet is not None:
            head, self.bullet = self.indent[: len(self.indent) - len(self.bullet)] + self.bullet, None
        self.lines.append((head + text).rstrip(" "))

    def hidden(self, node: Node) -> bool:
        tag, a = node.tag, node.attributes
        if tag in HIDDEN or "hidden" in a or (tag == "input" and a.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in a):
            return True
        if GONE.search(a.get("style", "")):
            return True
        if self.rules:
            own = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set())
            return any((not t or t == tag) and names <= own for t, names in self.rules)
        return False

    def flow(self, node: Node, pre: bool, seen: bool, in_list: bool) -> None:
        """Lay out the children of an element; seen: whether its own text is visible."""
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    self.write(child, pre)
            elif not self.hidden(child):
                self.element(child, pre, seen, in_list)

    def element(self, node: Node, pre: bool, seen: bool, in_list: bool) -> None:
        tag, a = node.tag, node.attributes
        if m := VISIBILITY.search(a.get("style", "")):
            seen = m[1].lower() == "visible" or (seen and m[1].lower() not in ("hidden", "collapse"))
        if tag == "br":
            self.end_line(True)
        elif tag == "input":
            if seen and a.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number", "date"):
                self.write(a.get("value", ""), False)
        elif tag == "select":
            options, stack = [], [node]
            while stack:
                n = stack.pop()
                if n.tag == "option" and not self.hidden(n):
                    options.append(n)
                stack += [c for c in reversed(n.children) if isinstance(c, Node)]
            if "multiple" not in a and options:
                options = [next((o for o in reversed(options) if "selected" in o.attributes), options[0])]
            for o in options:
                self.write(" ", False)
                self.flow(o, False, seen, in_list)
                self.write(" ", False)
        elif tag == "q":
            self.write('"', pre)
            self.flow(node, pre, seen, in_list)
            self.write('"', pre)
        elif tag == "table":
            self.table(node, seen)
        elif tag not in BLOCKS:
            self.flow(node, pre or tag == "textarea", seen, in_list)
        else:
            self.block(node, pre, seen, in_list)

    def block(self, node: Node, pre: bool, seen: bool, in_list: bool) -> None:
        tag = node.tag
        gap = tag in MARGINS and not (in_list and tag in LISTS)
        self.end_line()
        self.gap = max(self.gap, int(gap))
        indent = self.indent
        if tag == "hr":
            self.write("---" if seen else "", True)
        elif tag in LISTS:
            self.items(node, seen)
        elif tag == "details" and "open" not in node.attributes:
            if first := next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None):
                self.block(first, pre, seen, in_list)
        else:
            if tag in ("dd", "blockquote"):
                self.indent += "  "
            if tag in ("pre", "xmp") and node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
            self.flow(node, pre or tag in ("pre", "xmp"), seen, in_list and tag != "blockquote")
        self.end_line()
        self.indent = indent
        self.gap = max(self.gap, int(gap))

    def items(self, node: Node, seen: bool) -> None:
        a, own = node.attributes, [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        down = "reversed" in a
        n = whole(a.get("start"), len(own) if down else 1, -(10**9), 10**9)
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    self.write(child, False)
            elif self.hidden(child):
                continue
            elif child.tag != "li":
                self.element(child, False, seen, True)
            else:
                self.end_line()
                n = whole(child.attributes.get("value"), n, -(10**9), 10**9)
                mark = f"{numeral(n, a.get('type', '1'))}. " if node.tag == "ol" else "- "
                n += -1 if down else 1
                indent = self.indent
                self.indent, self.bullet = indent + " " * len(mark), mark
                self.block(child, False, seen, True)
                self.indent, self.bullet = indent, None

    def cell(self, node: Node, seen: bool) -> list[str]:
        part = Page(self.rules)
        part.block(node, False, seen, False)
        part.end_line()
        self.tables += part.tables
        return part.lines

    def table(self, node: Node, seen: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, 1)
        self.tables += 1
        rows: list[Node] = []

        def gather(part: Node, inner: frozenset[str]) -> None:
            """The rows below a part; what else stands there, such as a caption, is laid out before the rows."""
            for c in part.children:
                if isinstance(c, str):
                    self.write(c if seen else "", False)
                elif self.hidden(c):
                    continue
                elif c.tag == "tr" and "tr" in inner:
                    rows.append(c)
                    gather(c, frozenset(("td", "th")))
                elif c.tag in SECTIONS and c.tag in inner:
                    gather(c, frozenset(("tr",)))
                elif c.tag not in inner:
                    self.element(c, False, seen, False)

        gather(node, SECTIONS | {"tr"})
        self.end_line()
        grid: list[list[tuple[int, int, list[str]]]] = []  # of each row: column, columns, lines
        taken: dict[int, int] = {}  # columns that cells from above still cover, and for how many rows
        widths: Counter = Counter()
        wide: list[tuple[int, int, int]] = []
        for row in rows:
            cells, column, covered = [], 0, dict(taken)
            for c in row.children:
                if not isinstance(c, Node) or c.tag not in ("td", "th") or self.hidden(c):
                    continue
                while covered.get(column, 0):
                    column += 1
                span = whole(c.attributes.get("colspan"), 1, 1, 1000)
                down = whole(c.attributes.get("rowspan"), 1, 1, 65534)
                lines = self.cell(c, seen)
                size = max(map(width, lines), default=0)
                cells.append((column, span, lines))
                if span == 1:
                    widths[column] = max(widths[column], size)
                else:
                    wide.append((column, span, size))
                if down > 1:
                    taken.update(dict.fromkeys(range(column, column + span), down))
                column += span
            taken = {k: n - 1 for k, n in taken.items() if n > 1}
            grid.append(cells)
        for column, span, size in wide:
            missing = size - sum(widths[k] for k in range(column, column + span)) - 2 * (span - 1)
            if missing > 0:
                widths[column + span - 1] += missing
        last = max(widths, default=-1)
        starts, at = {}, 0
        for k in range(last + 2):
            starts[k] = at
            at += min(widths[k], MAX_COLUMN) + 2 if widths[k] else 0
        for cells in grid:
            for i in range(max((len(c[2]) for c in cells), default=0)):
                text, size = [], 0
                for column, _, lines in cells:
                    if i < len(lines) and lines[i]:
                        pad = max(starts.get(column, size) - size, 2 if size else 0)
                        text.append(" " * pad + lines[i])
                        size += pad + width(lines[i])
                self.line.append("".join(text))
                self.end_line(True)
        self.gap = max(self.gap, 1)


def text_of(page: str | None) -> tuple[str, int, int]:
    """Text, lines that aren't blank, tables."""
    if not page:
        return "", 0, 0
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * MAX_DEPTH))
    built = parse(page)
    laid = Page(hiding_rules(built.styles))
    laid.flow(built.root, False, True, False)
    laid.end_line()
    text = "\n".join(laid.lines).strip("\n")
    return text, sum(1 for x in laid.lines if x.strip()), laid.tables


def extract(pages: DataFrame, payload: str = "html", key: str = "page_id") -> DataFrame:
    """key, text, n_lines and n_tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_of(t) for t in batch.column(1).to_pylist()]
            text, lines, tables = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column(0), pa.array(text, pa.string()), pa.array(lines, pa.int64()), pa.array(tables, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "text", "n_lines", "n_tables"])

    return pages.select(key, payload).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, text string, n_lines long, n_tables long")
