"""Layout-aware text of HTML pages.

A tokenizer (one pass, whole page) feeds a tree builder with the implied ends and starts of HTML's optional tags; visibility rules drop
what a page does not show; the renderer writes all other text with its layout:

* white space collapses outside of pre and textarea; inline elements join, br breaks;
* p, headings, lists, tables, quotes and pre stand between blank lines, other blocks on lines of their own;
* li gets "- " or its number, nested lists are indented; dd is indented; quotes get "> ";
* table cells are padded to their column's width and parted by " | "; colspan and rowspan count;
* indents grow to INDENT characters and no further.

Hidden with all they hold: head, script, style, template, noscript (a page is taken to run scripts), object fallbacks, hidden inputs, closed
details but their summary, and what the hidden attribute or display:none hides, by style attribute or by a style sheet rule for
a tag, class or id, at top level or for all screens (print and size-dependent rules hide nothing). visibility:hidden is inherited, and what is
visible again inside is shown. Of several rules the cascade's last one counts: important, then style attribute, id, class, tag, then the later one.

Tags are scanned once from left to right, with quotes read as the standard has it, and open elements are found by their place on the stack, so
time follows a page's length whatever stands in it.

Defined results: null and empty pages give an empty text; broken markup never fails: stray ends are skipped, an unclosed element ends with the page, a tag or
comment that the page's end cuts off is dropped, a "<" that opens nothing is text; nesting is walked without recursion; null and repeated page
ids pass through; other columns are left out, so their names can't clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.shared import bound_batches

_SKIP = re.compile(r"[ \t\n\r\f/]*+")
_NAME = re.compile(r"[^ \t\n\r\f/>]++")
_ATTRIBUTE = re.compile(r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+")
_EQUALS = re.compile(r"[ \t\n\r\f]*+=[ \t\n\r\f]*+")
_UNQUOTED = re.compile(r"[^ \t\n\r\f>]*+")
_COMMENT_END = re.compile(r"--!?>")
INDENT = 64
COLUMNS = 1000  # the standard's bound of colspan; row spans count among so many columns
_CSS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{};]", re.S)
_DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([\w-]+)([^;]*)", re.I)
_ON_SCREEN = re.compile(r"(?:(?:only\s+)?(?:screen|all)|not\s+(?!(?:screen|all)\Z)[\w-]+)?")
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HEAD = frozenset("title meta link base style script noscript template".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist noembed noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure hr".split())
BLOCK = CLOSES_P | frozenset("html body li dt dd tr caption legend optgroup option".split())
#: An opening tag ends these, looking no further up than the second set.
ENDS = {
    "li": (("li",), frozenset("ul ol menu dir".split())),
    "dt": (("dt", "dd"), frozenset(["dl"])),
    "dd": (("dt", "dd"), frozenset(["dl"])),
    "tr": (("tr", "td", "th", "caption", "colgroup"), frozenset(["table"])),
    "td": (("td", "th"), frozenset(["table", "tr"])),
    "th": (("td", "th"), frozenset(["table", "tr"])),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), frozenset(["table"])),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), frozenset(["table"])),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), frozenset(["table"])),
    "option": (("option",), frozenset(["select", "datalist"])),
    "optgroup": (("option", "optgroup"), frozenset(["select"])),
}
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html".split())


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings

    def attribute(self, name: str) -> str | None:
        value = self.attrs.get(name)
        return unescape(value) if value and "&" in value else value


def scan_tag(page: str, at: int) -> tuple[dict, int] | None:
    """Attributes (the first of a name counts) from a tag's name on, and the place after its ">"; None if the page ends before."""
    attrs: dict = {}
    size = len(page)
    while True:
        at = _SKIP.match(page, at).end()
        if at >= size:
            return None
        if page[at] == ">":
            return attrs, at + 1
        name = _ATTRIBUTE.match(page, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            if page[at : at + 1] in ('"', "'"):
                close = page.find(page[at], at + 1)
                if close < 0:
                    return None
                value, at = page[at + 1 : close], close + 1
            else:
                plain = _UNQUOTED.match(page, at)
                value, at = plain[0], plain.end()
        attrs.setdefault(name[0].lower(), value)


def scan(page: str, at: int) -> tuple[int, int, str, bool, dict]:
    """The next token at or after a place: start, end, tag ("" for comments and the page's end), whether it is an end tag, attributes."""
    size = len(page)
    look = at
    while True:
        start = page.find("<", look)
        if start < 0 or start + 1 >= size:
            return size, size, "", False, {}
        sign = page[start + 1]
        closing = sign == "/"
        letter = page[start + 2 : start + 3] if closing else sign
        if letter.isascii() and letter.isalpha():
            name = _NAME.match(page, start + 1 + closing)
            found = scan_tag(page, name.end())
            if found is None:
                return start, size, "", False, {}
            return start, found[1], name[0].lower(), closing, found[0]
        if page.startswith("<!--", start):
            if page.startswith(("<!-->", "<!--->"), start):
                return start, page.index(">", start) + 1, "", False, {}
            end = _COMMENT_END.search(page, start + 4)
            return start, end.end() if end else size, "", False, {}
        if sign in "!?" or closing and letter:
            end = page.find(">", start)
            return start, end + 1 if end >= 0 else size, "", False, {}
        look = start + 1


def on_screen(media: str) -> bool:
    """Whether a media query list holds for screens of every size."""
    return any(_ON_SCREEN.fullmatch(q.strip().lower()) for q in media.split(","))


def _group_applies(head: str) -> bool:
    name, rest = re.match(r"@([\w-]*)\s*(.*)", head, re.S).groups()
    if name.lower() == "media":
        return on_screen(rest)
    return name.lower() == "layer" or name.lower() == "supports" and not rest.lower().startswith("not")


def css_rules(css: str):
    """(selectors, body) of the rules that apply on screens; blocks nest, rules inside of rules are left out."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", css, flags=re.S)
    stack: list[list] = []  # [selectors or None for a group, applies, body so far, where it goes on]
    start = 0
    for m in _CSS.finditer(css):
        if m[0] == ";":
            start = m.end()
        elif m[0] == "{":
            head, applies = css[start : m.start()].strip(), stack[-1][1] if stack else True
            if stack and stack[-1][0] is not None:
                stack[-1][2] += css[stack[-1][3] : start]
                stack.append([None, False, "", 0])
            elif head.startswith("@"):
                stack.append([None, applies and _group_applies(head), "", 0])
            else:
                stack.append([head, applies, "", m.end()])
            start = m.end()
        elif m[0] == "}":
            start = m.end()
            if stack:
                selectors, applies, body, at = stack.pop()
                if selectors is not None and applies:
                    yield selectors, body + css[at : m.start()]
                if stack and stack[-1][0] is not None:
                    stack[-1][3] = start
    if stack and stack[-1][0] is not None and stack[-1][1]:  # the end of the sheet closes all
        yield stack[-1][0], stack[-1][2] + css[stack[-1][3] :]


def _declared(body: str) -> dict[str, tuple[bool, bool | None]]:
    """(important, hides) of display and visibility; None: as the element around."""
    out: dict[str, tuple[bool, bool | None]] = {}
    for m in _DECLARED.finditer(body):
        name, important = m[1].lower(), "!important" in m[3].lower().replace(" ", "")
        if important or not out.get(name, (False,))[0]:
            value = m[2].lower()
            out[name] = important, value == "none" if name == "display" else {"hidden": True, "collapse": True, "visible": False, "initial": False}.get(value)
    return out


class Sheet:
    """What style sheets say of display and visibility of tags, classes and ids."""

    def __init__(self):
        self.rules: dict[tuple[str, str], dict[str, tuple[bool, int, bool]]] = {}  # important, order, hides
        self.order = 0

    def add(self, css: str) -> None:
        for selectors, body in css_rules(css):
            if found := _declared(body):
                self.order += 1
                for s in map(str.strip, selectors.split(",")):
                    if m := re.fullmatch(r"([.#]?)([\w-]+)", s):
                        said = self.rules.setdefault((m[1], m[2] if m[1] else m[2].lower()), {})
                        for name, (important, hides) in found.items():
                            if important or not said.get(name, (False,))[0]:
                                said[name] = important, self.order, hides

    def says(self, node: Node) -> tuple[bool | None, bool | None]:
        """Whether display and visibility hide a node; None where nothing is said."""
        style = _declared(node.attribute("style") or "") if "style" in node.attrs else {}
        if not self.rules and not style:
            return None, None
        keys = [("", node.tag)]
        if self.rules and node.attrs:
            keys += [(".", c) for c in (node.attribute("class") or "").split()] + [("#", node.attribute("id") or "")]
        said = [(" .#".index(k[0] or " "), self.rules[k]) for k in keys if k in self.rules]
        out = []
        for name in ("display", "visibility"):
            ranked = [(important, rank, order, hides) for rank, found in said for n, (important, order, hides) in found.items() if n == name]
            ranked += [(important, 3, 0, hides) for n, (important, hides) in style.items() if n == name]
            out.append(max(ranked, key=lambda x: x[:3])[3] if ranked else None)
        return out[0], out[1]


class _Stack:
    """Open elements, outermost first, with the places of each tag."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open one of tags, -1 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def add(self, child) -> None:
        self.nodes[-1].children.append(child)


def parse(page: str) -> tuple[Node, Sheet]:
    """The tree of a page, with implied tags put in, and its style sheets' hiding rules."""
    root = Node("html")
    stack, sheet = _Stack(root), Sheet()
    state = "start"  # then head, then body

    def open_node(tag: str, attrs: dict | None = None) -> None:
        node = Node(tag, attrs or {})
        stack.add(node)
        stack.push(node)

    def body() -> None:
        nonlocal state
        if state != "body":
            stack.cut(1)
            open_node("body")
            state = "body"

    def end(tags: tuple, bound: frozenset) -> None:
        """Close the innermost open one of tags inside the bound, and those right around it."""
        i = stack.last(tags)
        if i > max(0, stack.last(bound)):
            while i > 1 and stack.nodes[i - 1].tag in tags:
                i -= 1
            stack.cut(i)

    at, size = 0, len(page)
    while at < size:
        start, stop, tag, closing, attrs = scan(page, at)
        if start > at:
            chunk = page[at:start]
            if state == "body" or chunk.strip(" \t\n\r\f"):
                body()
                stack.add(unescape(chunk) if "&" in chunk else chunk)
        at = stop
        if not tag:
            continue
        if closing:
            if tag in ("html", "body"):
                continue
            if tag == "head":
                if state == "head":
                    stack.cut(1)
            elif tag == "br" or tag == "p" and stack.last(("p",)) < 0:
                body()
                stack.add(Node(tag))
            else:
                i = stack.last((tag,))
                if i > 0 and (i >= stack.last(SCOPE) or tag in ("table", "tr", "tbody", "thead", "tfoot")):
                    stack.cut(i)
            continue
        if tag == "html":
            root.attrs = root.attrs or attrs
            continue
        if tag == "head":
            if state == "start":
                open_node("head", attrs)
                state = "head"
            continue
        if tag == "body":
            body()
            stack.nodes[1].attrs = stack.nodes[1].attrs or attrs
            continue
        if state != "body":
            if tag not in HEAD:
                body()
            elif state == "start":
                open_node("head")
                state = "head"
        if tag in CLOSES_P:
            end(("p",), frozenset(["table", "td", "th", "button", "caption", "body"]))
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in ("td", "th") and stack.nodes[-1].tag not in ("tr", "td", "th") and stack.last(("table",)) >= 0:
            open_node("tr")
        node = Node(tag, attrs)
        stack.add(node)
        if tag in VOID or tag in ("svg", "path", "circle", "rect") and page.endswith("/>", 0, at):
            continue
        if tag in RAW or tag in RCDATA:
            close = re.compile(rf"</{re.escape(tag)}(?=[ \t\n\r\f/>])", re.I).search(page, at)
            inner = page[at : close.start() if close else size]
            ended = scan_tag(page, close.end()) if close else None
            at = ended[1] if ended else size
            node.children.append(unescape(inner) if tag in RCDATA else inner)
            if tag == "style" and on_screen(node.attribute("media") or ""):
                sheet.add(inner)
            continue
        stack.push(node)
    return root, sheet


def _hides(node: Node, sheet: Sheet) -> tuple[bool, bool | None]:
    """Whether a node is hidden with all it holds, and what is said of its visibility."""
    if node.tag in HIDDEN:
        return True, None
    display, visibility = sheet.says(node)
    if node.attrs and (node.tag == "input" and (node.attribute("type") or "").lower() == "hidden" or display is None and "hidden" in node.attrs):
        return True, None
    return bool(display), visibility


class _Lines:
    """Collected lines; gap asks for a blank line before the next text, newline for a new one."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = False
        self.marker = ""
        self.indents: list[str] = []  # each with those around it, INDENT characters at most

    def text(self, value: str) -> None:
        parts = _SPACE.sub(" ", value)
        if parts == " " or not parts:
            self.space = self.space or bool(parts and self.now)
            return
        if not self.now:
            parts = parts.lstrip(" ")
            self._begin()
        elif self.space and parts[0] != " ":
            self.now.append(" ")
        elif self.space or parts[0] == " ":
            parts = " " + parts.lstrip(" ")
        self.space = parts[-1] == " "
        self.now.append(parts.rstrip(" "))

    def indent(self, more: str) -> None:
        self.indents.append(((self.indents[-1] if self.indents else "") + more)[:INDENT])

    def _begin(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        outer, inner = ["", "", *self.indents[-2:]][-2:]
        self.now.append(outer + self.marker if self.marker else inner)
        self.marker = ""  # further lines of the item get its last indent instead

    def newline(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False

    def blank(self) -> None:
        self.newline()
        self.gap = True

    def line_break(self) -> None:
        if self.now:
            self.newline()
        elif self.lines and self.lines[-1] != "" and not self.gap:
            self.lines.append("")

    def whole(self, lines: list[str]) -> None:
        """Lines taken as they are."""
        self.newline()
        for x in lines:
            self._begin()
            self.now.append(x)
            self.newline()

    def done(self) -> str:
        self.newline()
        return "\n".join(self.lines).strip("\n")


def render(root: Node, sheet: Sheet) -> str:
    """The visible text of a tree. Tables are rendered inside out; nothing recurses on the page's depth."""
    out = _Lines()
    outputs = [out]
    todo: list = [root]
    counters: list[list] = []
    tables: list[list] = []
    pre = 0
    unseen = False  # inside of visibility:hidden
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if unseen:
                continue
            if not pre:
                out.text(item)
            else:
                for i, line in enumerate(item.split("\n")):
                    if i:
                        out.newline()
                    if line:
                        if not out.now:
                            out._begin()
                        out.now.append(line)
            continue
        if callable(item):
            got = item()
            if got is not None:
                out = got
            continue
        hidden, visibility = _hides(item, sheet)
        if hidden:
            continue
        tag = item.tag
        children = item.children
        if visibility is not None and visibility != unseen:

            def as_before(value=unseen):
                nonlocal unseen
                unseen = value

            todo.append(as_before)
            unseen = visibility
        if tag == "br":
            out.line_break()
            continue
        if tag == "hr":
            out.blank()
            continue
        if tag == "input":
            if not unseen and (item.attribute("type") or "").lower() in ("submit", "button", "reset"):
                out.text(item.attribute("value") or "")
            continue
        if tag == "details" and item.attribute("open") is None:
            children = [x for x in children if isinstance(x, Node) and x.tag == "summary"]
        after: list = []
        if tag in SPACED:
            nested = tag in ("ul", "ol", "menu", "dir") and counters
            out.newline() if nested else out.blank()
            after.append(out.newline if nested else out.blank)
        elif tag in BLOCK:
            out.newline()
            after.append(out.newline)
        if tag in ("ul", "ol", "menu", "dir"):
            start = item.attribute("start") if tag == "ol" else None
            counters.append([int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1, tag == "ol"])
            after.append(lambda: counters.pop() and None)
        elif tag == "li":
            here = counters[-1] if counters else [1, False]
            mark = f"{here[0]}. " if here[1] else "- "
            here[0] += 1
            out.marker = "" if unseen else mark
            out.indent(" " * len(mark))

            def close_li(o=out):
                o.newline()
                o.indents.pop()
                o.marker = ""

            after = [close_li]
        elif tag == "dd":
            out.indent("    ")
            after.insert(0, lambda o=out: (o.newline(), o.indents.pop()) and None)
        elif tag == "blockquote":
            out.indent("> ")
            after.insert(0, lambda o=out: (o.newline(), o.indents.pop()) and None)
        elif tag in ("pre", "textarea"):
            pre += 1

            def close_pre(o=out):
                nonlocal pre
                pre -= 1
                o.newline()

            after.insert(0, close_pre)
        elif tag == "table":
            tables.append([])

            def close_table(o=out):
                rows = tables.pop()
                o.whole(align(rows))
                o.gap = True

            after = [close_table]
        elif tag == "tr" and tables:
            tables[-1].append([])
            after = []
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            wide, high = (int(x) if (x := item.attribute(name) or "1").isdecimal() and len(x) < 6 else 1 for name in ("colspan", "rowspan"))
            cell = _Lines()
            outputs.append(cell)
            saved = counters
            counters = []

            def close_cell(row=tables[-1][-1], wide=min(max(wide, 1), COLUMNS), high=high, saved=saved):
                nonlocal counters
                counters = saved
                row.append((outputs.pop().done().split("\n"), wide, high))
                return outputs[-1]

            out = cell
            after = [close_cell]
        todo.extend(reversed(after))
        todo.extend(reversed(children))
    return outputs[0].done()


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int, int]]]:
    """Cells (lines, columns, rows) -> cells (lines, first column, columns); columns that a cell above still takes hold an empty one. 0 rows: all below.
    Columns beyond COLUMNS are not held."""
    out, taken = [], {}  # column -> rows still taken
    for row in rows:
        at, cells, below = 0, [], {}
        for lines, wide, high in row:
            while at in taken:
                cells.append(([""], at, 1))
                at += 1
            cells.append((lines, at, wide))
            if high != 1 and at + wide <= COLUMNS:
                below.update(dict.fromkeys(range(at, at + wide), high - 1 if high else len(rows)))
            at += wide
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | below
        out.append(cells)
    return out


def align(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: cells (lines, columns, rows) padded to their column's width."""
    placed = _placed(rows)
    width: dict[int, int] = {}
    for row in placed:
        for lines, at, n in row:
            if n == 1:
                width[at] = max(width.get(at, 0), max(map(len, lines)))
    out = []
    for row in placed:
        if not any(any(lines) for lines, _, _ in row):
            continue
        widths = [sum(width.get(at + j, 0) for j in range(n)) + 3 * (n - 1) for _, at, n in row]
        for k in range(max(len(lines) for lines, _, _ in row)):
            parts = [(lines[k] if k < len(lines) else "").ljust(w) for (lines, _, _), w in zip(row, widths, strict=True)]
            out.append(" | ".join(parts).rstrip(" "))
    return out


def extract(page: str | None) -> tuple[str, str]:
    """(title, visible text)."""
    if not page:
        return "", ""
    root, sheet = parse(page)
    title = ""
    todo = [root]
    while todo and not title:
        node = todo.pop()
        if node.tag == "title":
            title = _SPACE.sub(" ", "".join(x for x in node.children if isinstance(x, str))).strip(" ")
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return title, render(root, sheet)


def extract_pages(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, title, text of every page."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))

    def run(batches):
        for batch in batches:
            got = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], names=["page_id", "title", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, title string, text string")
