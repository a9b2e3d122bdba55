"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, blocks, lists and tables.

All visible text comes out in reading order.  Blocks start on lines of their own, paragraphs
and headings are set off by an empty line, list items have markers, the cells of a table are
aligned in columns, over the columns and rows that they span.  Elements nest to any depth.

Not shown are elements that HTML never shows, those that an attribute, a style or a rule of a ``style`` element for one
tag, class or id hides, the body of a closed ``details`` and the options of a list that are not chosen.  What
``visibility`` hides may hold something that is visible.
"""

from __future__ import annotations

import html
import re
import sys
import textwrap
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .base import per_text

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist".split())
#: Parts of drawings and formulas that are not shown.
UNSEEN = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset(("annotation", "annotation-xml"))}
_UNSEEN = frozenset().union(*UNSEEN.values())
#: Elements that hold the rows of a table.
ROW_GROUPS = frozenset("tbody thead tfoot".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
                  "summary table tbody td tfoot th thead tr caption ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir hr".split())
#: Start tag -> open elements it closes, and the elements such a search stops at.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
#: Elements that end an open paragraph.
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "frameset"}
P_SCOPE = frozenset("table td th button object caption".split())
HEAD_ONLY = frozenset("meta link base title style script noscript template head html".split())
#: Characters at which the lines of a cell are wrapped, between words.
COLUMN = 60
# The most columns and rows that HTML lets a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Inputs whose value is their label, with the label that they have without one.
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}

# An attribute as HTML reads it: a quote opens a value only behind ``=``.
_NAME, _VALUE = r"(?:=[^\s/>=]*|[^\s/>=]+)", r"\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?"
_TOKEN = re.compile(r"<!---?>|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    rf"<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|{_NAME}(?:{_VALUE})?)*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))?)?")
_GONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VEIL = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?([.#][\w-]+)?", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings
    rows: bool = False                            # holds rows of a table, whatever is between

    @property
    def hidden(self) -> bool:
        a = self.attributes
        return (self.tag in HIDDEN or "hidden" in a or self.tag == "dialog" and "open" not in a
                or self.tag == "input" and a.get("type", "").lower() not in BUTTONS or bool(_GONE.search(a.get("style", ""))))

    @property
    def veil(self) -> bool | None:
        """Whether the element's own text is invisible; None: as around it."""
        m = _VEIL.search(self.attributes.get("style", ""))
        return m and m[1].lower() != "visible"


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text.strip(" /\n\t"):
        for m in _ATTRIBUTE.finditer(text):  # the first of equal names counts
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _styled(node: Node, rules: dict[tuple[str, str], str]) -> None:
    """Puts what rules say of the element in front of its own style."""
    names = [""] + ["." + c for c in node.attributes.get("class", "").split()]
    if "id" in node.attributes:
        names.append("#" + node.attributes["id"])
    found = [rules[tag, name] for tag in ("*", node.tag) for name in names if (tag, name) in rules]
    own = node.attributes.get("style", "")
    if found and not _VEIL.search(own) and not re.search(r"display\s*:", own, re.IGNORECASE):
        node.attributes["style"] = ";".join([*found, own])


def _rules_of(sheet: str, rules: dict[tuple[str, str], str]) -> None:
    """Rules that hide, for selectors of one tag, class or id.  Rules inside other rules (of printers, say) are passed over."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.DOTALL)
    flat, depth, at = [], 0, 0
    for m in re.finditer(r"@[^;{}]*\{|[{}]", sheet):
        if depth == 0 and m.group().startswith("@"):
            flat.append(sheet[at:m.start()])
            depth = 1
        elif depth:
            depth += 1 if m.group().endswith("{") else -1
            at = m.end() if not depth else at
    if not depth:
        flat.append(sheet[at:])
    for m in _RULE.finditer("".join(flat)):
        for selector in m[1].split(","):
            one = _SELECTOR.fullmatch(selector.strip())
            if one and selector.strip():
                key = ((one[1] or "*").lower(), one[2] or "")
                if _GONE.search(m[2]) or _VEIL.search(m[2]):
                    rules[key] = m[2]
                elif re.search(r"display\s*:", m[2], re.IGNORECASE):
                    rules.pop(key, None)  # a later rule shows it again


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind text, open or close; comments and declarations are left out."""
    at = 0
    for_raw = None
    while at < len(page):
        m = _TOKEN.search(page, at) if for_raw is None else re.compile(rf"</{re.escape(for_raw)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.IGNORECASE).search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        if for_raw is not None:
            yield "close", for_raw, ""
            for_raw = None
            at = max(m.end(), at)
            if m.end() == m.start():
                return
            continue
        if m.group().startswith("<![CDATA["):
            yield "text", html.escape(m.group()[9:].removesuffix("]]>")), ""
        elif m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
            else:
                yield "open", name, m[3]
                if name in RAW:
                    for_raw = name
        at = m.end()


def tree(page: str) -> Node:
    """The document's tree; end tags that are left out are implied, stray ones are ignored."""
    root = Node("html")
    stack, count = [root], Counter(("html",))  # open elements, and how many there are of each tag
    rules: dict[tuple[str, str], str] = {}

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        count[node.tag] += 1
        if node.tag == "tr":
            for outer in reversed(stack[:-1]):
                if outer.rows or outer.tag == "table":
                    break
                outer.rows = True

    def close_to(index: int) -> None:
        for node in stack[index:]:
            count[node.tag] -= 1
        del stack[index:]

    def close_in(names: set, scope: set) -> None:
        if not any(count[n] for n in names):
            return
        lowest = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                break
            if stack[i].tag in names:
                lowest = i
        if lowest is not None:
            close_to(lowest)

    for kind, name, rest in tokens(page):
        if kind == "text":
            tag = stack[-1].tag
            text = name if tag == "xmp" else html.unescape(name)
            if tag == "style":
                _rules_of(name, rules)
            if tag == "head" and text.strip():
                close_to(len(stack) - 1)
            stack[-1].children.append(text)
        elif kind == "close":
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not count["p"]:
                stack[-1].children.append(Node("p"))
            elif name not in ("html", "body") and count[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        close_to(i)
                        break
                    if stack[i].tag in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
        else:
            if name == "html":
                root.attributes = root.attributes or _attributes(rest)
                continue
            if stack[-1].tag == "head" and name not in HEAD_ONLY:
                close_to(len(stack) - 1)
            if name in ENDS_P:
                close_in({"p"}, P_SCOPE)
            if name in CLOSES:
                close_in(*CLOSES[name])
            if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", stack[-1].tag):
                close_to(len(stack) - 1)
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(Node("tr"))
            node = Node(name, _attributes(rest))
            if name in _UNSEEN and any(name in UNSEEN[outer] for outer in UNSEEN if count[outer]):
                node.attributes["hidden"] = ""
            push(node)
            if name in VOID or rest.rstrip().endswith("/") and name not in BLOCK | RAW:
                close_to(len(stack) - 1)
    # A style sheet also holds for what is before it.
    todo = [root]
    while todo:
        node = todo.pop()
        if rules:
            _styled(node, rules)
        if node.tag == "details" and "open" not in node.attributes:
            _fold(node)
        elif node.tag == "select" and "multiple" not in node.attributes and node.attributes.get("size", "1") in ("", "0", "1"):
            _choose(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    return root


def _fold(node: Node) -> None:
    """Leaves the first summary of a closed element."""
    first = next((c for c in node.children if not isinstance(c, str) and c.tag == "summary"), None)
    node.children = [first] if first else ["Details"]


def _choose(node: Node) -> None:
    """Leaves the chosen option of a list: the last one that says so, else the first."""
    options = [o for c in node.children if not isinstance(c, str)
               for o in ([c] if c.tag == "option" else [o for o in c.children if not isinstance(o, str) and o.tag == "option"])]
    chosen = [o for o in options if "selected" in o.attributes] or options[:1]
    node.children = chosen[-1:]


class _Flow:
    """Lines of text with pending line ends and blanks."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []   # of the line at hand
        self.space = False
        self.gap = False             # an empty line is due before the next text
        self.prefixes: list[str] = []
        self.marker: str | None = None
        self.lists = 0               # open lists; inner ones are not set off
        self.veiled = False          # text is there but not visible

    def text(self, value: str) -> None:
        if self.veiled:
            return
        value = _SPACE.sub(" ", value)
        if value.startswith(" "):
            self.space = True
        body = value.strip(" ")
        if not body:
            return
        if self.parts and self.space:
            self.parts.append(" ")
        self.parts.append(body)
        self.space = value.endswith(" ")

    def end(self) -> None:
        if self.parts:
            self.line("".join(self.parts))
            self.parts = []
        self.space = False

    def line(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.prefixes)
        if self.marker is not None:
            lead = "".join(self.prefixes[:-1]) + self.marker
            self.marker = None
        self.lines.append((lead + text).rstrip(" "))


def _block(node: Node, flow: _Flow) -> None:
    """Appends a node's children to the flow."""
    for child in node.children:
        if isinstance(child, str):
            flow.text(child)
        elif child.hidden:
            continue
        else:
            _element(child, flow)


def _element(node: Node, flow: _Flow) -> None:
    around, veil = flow.veiled, node.veil
    if veil is not None:
        flow.veiled = veil
    _shown(node, flow)
    flow.veiled = around


def _shown(node: Node, flow: _Flow) -> None:
    tag = node.tag
    if tag == "br":
        if flow.parts:
            flow.end()
        else:
            flow.gap = bool(flow.lines)
        return
    if tag == "img":
        flow.text(node.attributes.get("alt", ""))
        return
    if tag == "input":
        flow.text(node.attributes.get("value", BUTTONS[node.attributes["type"].lower()]))
        return
    if tag not in BLOCK:
        if tag == "text":  # labels of a drawing stand apart
            flow.text(" ")
        _block(node, flow)
        if tag == "text":
            flow.text(" ")
        return
    flow.end()
    spaced = tag in SPACED and not (flow.lists and tag in ("ul", "ol", "menu", "dir"))
    if spaced and flow.marker is None:
        flow.gap = True
    if tag == "hr":
        if not flow.veiled:
            flow.line("-" * 8)
    elif tag == "pre":
        text = _plain(node, flow.veiled).removeprefix("\n")
        for line in text.split("\n") if text or not flow.veiled else ():
            flow.line(line)
    elif tag == "table":
        for line in _table(node, flow.veiled):
            flow.line(line)
    elif tag in ("ul", "ol", "menu", "dir"):
        flow.lists += 1
        _list(node, flow)
        flow.lists -= 1
    elif tag in ("blockquote", "dd"):
        flow.prefixes.append("  ")
        _block(node, flow)
        flow.end()
        flow.prefixes.pop()
    else:
        _block(node, flow)
    flow.end()
    if spaced:
        flow.gap = True


def _list(node: Node, flow: _Flow) -> None:
    start = node.attributes.get("start", "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            flow.text(child)
        elif child.hidden:
            continue
        elif child.tag != "li":
            _element(child, flow)
        else:
            flow.end()
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            outer, flow.marker = flow.marker, None
            flow.prefixes.append(" " * len(mark))
            flow.marker = mark if outer is None else outer + mark
            _element(Node("span", child.attributes, child.children), flow)
            flow.end()
            if flow.marker is not None:  # an item without text leaves nothing
                flow.marker = None
            flow.prefixes.pop()
            flow.gap = False


def _plain(node: Node, veiled: bool = False) -> str:
    """Text as it stands, for preformatted elements."""
    out, todo = [], [(node, veiled)]
    while todo:
        one, veiled = todo.pop()
        if isinstance(one, str):
            out.append("" if veiled else one)
        elif one.tag == "br":
            out.append("\n")
        elif one is node or not one.hidden:
            veil = one.veil if one.veil is not None else veiled
            todo += [(c, veil) for c in reversed(one.children)]
    return "".join(out)


def _parts(node: Node, veiled: bool) -> list[tuple[str | Node, bool]]:
    """Rows of a table, and the text and elements beside them, through row groups and whatever else holds rows; and whether they are veiled."""
    out, todo = [], [(c, veiled) for c in reversed(node.children)]
    while todo:
        child, veiled = todo.pop()
        if isinstance(child, str):
            out.append((child, veiled))
        elif not child.hidden:
            if child.tag in ROW_GROUPS or child.tag not in ("tr", "table") and child.rows:
                veiled = child.veil if child.veil is not None else veiled
                todo += [(c, veiled) for c in reversed(child.children)]
            else:
                out.append((child, veiled))
    return out


def _lines_of(node: Node, veiled: bool) -> list[str]:
    flow = _Flow()
    flow.veiled = veiled if node.veil is None else node.veil
    _block(node, flow)
    flow.end()
    return flow.lines


def _spans(cell: Node) -> tuple[int, int]:
    """Columns and rows of a cell; a row span of 0 goes on to the end."""
    def number(name: str) -> int:
        text = cell.attributes.get(name, "1").strip()
        return int(text) if re.fullmatch(r"\d{1,9}", text) else 1
    return min(max(number("colspan"), 1), MOST_COLUMNS), min(number("rowspan") or MOST_ROWS, MOST_ROWS)


def _table(node: Node, veiled: bool = False) -> list[str]:
    """Caption, stray text, then rows with their cells in aligned columns, two blanks apart.

    Lines of a cell are wrapped at ``COLUMN`` characters where the table has several columns.  A word that is longer has the
    rest of the line: cells to its right go on one line further down.
    """
    out: list[str] = []
    grid: list[dict[int, list[str]]] = []
    parts = _parts(node, veiled)
    for child, veil in parts:
        if isinstance(child, str):
            out += [_SPACE.sub(" ", child).strip(" ")] if child.strip() and not veil else []
        elif child.tag != "tr":
            out += _lines_of(Node("div", {}, [child]), veil)
    taken: dict[int, int] = {}  # columns that cells of earlier rows reach into, and for how many rows
    for row, veil in parts:
        if isinstance(row, str) or row.tag != "tr":
            continue
        veil = row.veil if row.veil is not None else veil
        cells, column, below = {}, 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row.children:
            if isinstance(cell, str):
                lines, columns, rows = [_SPACE.sub(" ", cell).strip(" ")] if cell.strip() and not veil else [], 1, 1
                if not lines:
                    continue
            elif cell.hidden:
                continue
            else:
                lines = _lines_of(cell if cell.tag in ("td", "th") else Node("td", {}, [cell]), veil)
                columns, rows = _spans(cell)
            while column in taken:
                column += 1
            cells[column] = lines
            for c in range(column, column + columns):
                if rows > 1:
                    below[c] = max(below.get(c, 0), rows - 1)
            column += columns
        taken = below
        if any(cells.values()):
            grid.append(cells)
    # Columns without any text take no room.
    used = sorted({c for cells in grid for c, lines in cells.items() if any(lines)})
    if len(used) > 1:
        for cells in grid:
            for c, lines in cells.items():
                cells[c] = [w for line in lines for w in ([line] if len(line) <= COLUMN else textwrap.wrap(
                    line, COLUMN, break_long_words=False, break_on_hyphens=False, subsequent_indent=" " * (len(line) - len(line.lstrip(" ")))) or [line])]
    width = {c: max((len(line) for cells in grid for line in cells.get(c, ()) if len(line) <= COLUMN or len(used) == 1), default=0) for c in used}
    at, edge = {}, 0
    for c in used:
        at[c] = edge
        edge += width[c] + 2
    for cells in grid:
        for k in range(max(map(len, cells.values()))):
            line = ""
            for c in used:
                piece = cells[c][k] if k < len(cells.get(c, ())) else ""
                if not piece:
                    continue
                if line and len(line) + 2 > at[c]:  # a longer word is in the way
                    out.append(line)
                    line = ""
                line = line.ljust(at[c]) + piece
            out.append(line.rstrip(" "))
    return out


def _depth(root: Node) -> int:
    deepest, todo = 0, [(root, 1)]
    while todo:
        node, depth = todo.pop()
        deepest = max(deepest, depth)
        todo += [(c, depth + 1) for c in node.children if not isinstance(c, str)]
    return deepest


def render(page: str) -> str:
    """The visible text of a page; empty for an empty page."""
    flow, root = _Flow(), tree(page)
    limit, needed = sys.getrecursionlimit(), 8 * _depth(root) + 1000
    sys.setrecursionlimit(max(limit, needed))  # calls of Python functions are on the heap
    try:
        _block(root, flow)
    finally:
        sys.setrecursionlimit(limit)
    flow.end()
    return "\n".join(flow.lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines) per row; null and empty pages give an empty text.

    Nothing is cut: very long pages and deep ones are rendered whole.  Ids and repeated rows are passed through, other
    columns are not read; no rows give no rows.
    """
    def one(data: bytes) -> tuple:
        text = render(data.decode("utf-8", "replace"))
        return text, len(text), text.count("\n") + 1 if text else 0

    return per_text(pages, "text string, n_chars long, n_lines long", one, id_col, html_col).withColumnRenamed("doc_id", "page_id")
