"""Pages made of random trees against a plain renderer of those trees; visibility, spans, broken markup, and time."""

import html as std
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lattica.llm import html

BLOCKS = ("p", "h2", "div", "ul", "table")


def inline(r, depth=0):
    """A list of strings and (b | hidden, children)."""
    out = []
    for _ in range(r.randint(1, 3)):
        kind = r.random()
        if kind < 0.7 or depth > 2:
            out.append(" ".join(r.choice(["one", "two", "x<y", "a&b", "é", "III"]) for _ in range(r.randint(1, 3))) + r.choice(["", " "]))
        else:
            out.append((r.choice(["b", "i", "hidden"]), inline(r, depth + 1)))
    return out


def tree(r, depth=0):
    out = []
    for _ in range(r.randint(1, 4)):
        tag = r.choice(BLOCKS if depth < 3 else BLOCKS[:2])
        if tag in ("p", "h2"):
            out.append((tag, inline(r)))
        elif tag == "div":
            out.append((r.choice(["div", "div", "gone"]), tree(r, depth + 1)))
        elif tag == "ul":
            out.append((tag, [("li", inline(r)) for _ in range(r.randint(1, 3))]))
        else:
            columns = r.randint(1, 3)
            out.append((tag, [("tr", [("td", inline(r)) for _ in range(columns)]) for _ in range(r.randint(1, 3))]))
    return out


def written(nodes, r, last=True):
    """HTML of a tree, with optional end tags left out now and then."""
    out = []
    for k, node in enumerate(nodes):
        if isinstance(node, str):
            out.append(std.escape(node))
            continue
        tag, children = node
        inner = written(children, r)
        name = {"hidden": "span", "gone": "div"}.get(tag, tag)
        attrs = {"hidden": r.choice([" hidden", ' style="display:none"']), "gone": ' class="gone"'}.get(tag, r.choice(["", " title='<b> \" >'", ' data-x="a>b"']))
        closed = tag not in ("p", "li", "td", "tr") or r.random() < 0.5
        out.append(f"<{name}{attrs}>{inner}" + (f"</{name}>" if closed else ""))
    return "".join(out)


def seen(nodes):
    return "".join(x if isinstance(x, str) else "" if x[0] == "hidden" else seen(x[1]) for x in nodes)


def flow(nodes):
    """Lines, "nl" for a new line and "gap" for a blank one."""
    for tag, children in nodes:
        line = lambda x: re.sub(" +", " ", seen(x)).strip(" ")
        if tag in ("p", "h2"):
            yield from (("gap", None), ("line", line(children)), ("gap", None))
        elif tag == "div":
            yield from (("nl", None), *flow(children), ("nl", None))
        elif tag == "ul":
            yield ("gap", None)
            for _, x in children:
                yield from (("nl", None), ("line", "- " + line(x) if line(x) else ""))
            yield ("gap", None)
        elif tag == "table":
            cells = [[line(x) for _, x in row] for _, row in children]
            width = [max(len(row[c]) for row in cells) for c in range(len(cells[0]))]
            yield ("gap", None)
            for row in cells:
                if any(row):
                    yield from (("nl", None), ("line", " | ".join(x.ljust(w) for x, w in zip(row, width, strict=True)).rstrip(" ")))
            yield ("gap", None)


def plain(nodes):
    lines, gap = [], False
    for kind, value in flow(nodes):
        gap = gap or kind == "gap"
        if kind == "line" and value:
            lines += [""] * (gap and bool(lines)) + [value]
            gap = False
    return "\n".join(lines)


@pytest.mark.parametrize("seed", range(300))
def test_pages_equal_a_plain_rendering_of_their_trees(seed):
    r = random.Random(seed)
    nodes = tree(r)
    page = "<style>.gone{display:none}</style>" + written(nodes, r)
    assert html.extract(page)[1] == plain(nodes)


def test_visibility_is_inherited_and_can_come_back():
    assert html.extract("<div style='visibility:hidden'>no<b style='visibility:visible'>yes<i>too</i></b>no</div>end")[1] == "yestoo\nend"
    assert html.extract("<style>.h{visibility:hidden}.v{visibility:visible}.n{display:none}</style><p class=h>a<span class=v>b<span class=h>c</span>d</span>e<p>f<p class=n>g<b class=v>h</b>")[1] == "bd\n\nf"
    assert html.extract("<div hidden style='display:block'>shown</div><div hidden>not</div>")[1] == "shown"
    assert html.extract("<ul style='visibility:collapse'><li>a<li style='visibility:visible'>b</ul>")[1] == "- b"


def test_row_spans_hold_their_columns():
    assert html.extract("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>")[1] == "a | b\n  | c\nd | e"
    assert html.extract("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>")[1] == "a | b\n  | c\n  | d"
    assert html.extract("<table><tr><td rowspan=2 colspan=2>wide<td>b<tr><td>c<tr><td>x<td>y<td>z</table>")[1] == "wide  | b\n  |   | c\nx | y | z"


def test_broken_markup():
    assert html.extract("</b></p>x<z>y</q> < 3 <")[1] == "xy < 3 <"
    assert html.extract("a<b title='x>y' class=\"'\">b</b><i \"' x>c</i>")[1] == "abc"
    assert html.extract("a<!-- b --!>c<!-->d<!x>e<?y>f</>g</ h>i")[1] == "acdefgi"
    assert html.extract("kept<i title='never closed>lost")[1] == "kept"
    assert html.extract("kept<script>x</script y='>'>z<!-- open")[1] == "keptz"


PIECES = {"<a ": "'", "": "<i <i ", "<p>": "a < b <", "<div>": "</p>", "<p><table><tr><td>": "<span><div>", "<b>": "</i></b x", "<script>": "</script ", "<ul>": "<ul><li>x", "<a": " x=1", "x": "<!--", "<table>": "<tr><td rowspan=2>x<td>y", "<x>": "&", "<style>": ".a{", "<y>": "</", "<a =": "=", "<td>": "<table><tr><td>"}


@pytest.mark.parametrize("head", PIECES)
def test_time_follows_length(head):
    def seconds(n):
        page, start = head + PIECES[head] * (n // len(PIECES[head])), time.perf_counter()
        html.extract(page)
        return time.perf_counter() - start

    seconds(10_000)
    assert seconds(200_000) < 80 * max(seconds(10_000), 0.01)  # 20 times the page


def test_clashing_columns_and_other_ids(spark):
    rows = [("a", "<title>t</title><p>x"), ("a", "<p>x"), (None, None), ("long", "<p>" + "word " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id string, html string").withColumns({"text": F.lit(1), "title": F.lit(2.0)})
    got = sorted(((r["page_id"] or "", r["title"], len(r["text"])) for r in html.extract_pages(pages).collect()))
    assert got == [("", "", 0), ("a", "", 1), ("a", "t", 1), ("long", "", 1_499_999)]
