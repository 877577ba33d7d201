import random
import time

import pytest
from sparkloom.llm.html import extracted, render

CASES = {
    "<p>One <b>two</b>\n three<p>Four<br>five": "One two three\n\nFour\nfive",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>": "- a\n- b\n  3. c\n  4. d\n- e",
    "<table><tr><th>Name<th>Val<tr><td>x<td>1<tr><td>longer<td>22</table>": "Name    Val\nx       1\nlonger  22",
    "<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>": "ab     c\n1   2  3",
    "<head><title>t</title></head><body>x<script>var a='<p>';</script>y<style>p{}</style>": "xy",
    '<div style="color:red;display: none">no</div><div hidden>no</div><input type=hidden value=q>yes': "yes",
    "<pre>\n a\n   b</pre>c": " a\n   b\n\nc",
    "a<!-- b -->c<!-- open <p>d": "ac",
    '<a title="1 > 0" href=x>l</a><a href="u"">m</a> &lt;&eacute;&#x41;': "lm <éA",
    "<details><summary>S</summary>gone</details><details open><summary>T</summary>here</details>": "S\nT\nhere",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "": "",
    "1 < 2 and <3": "1 < 2 and <3",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "</p></div>x</table>": "x",
    "<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>": "yes",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<table><tr><td><ul><li>a<li>b</ul><td>x<tr><td>c<td>d</table>": "- a\n- b\nx\nc  d",
    "<table><tr><td>a<br>b<td>x<br>y<tr><td>cc<td>d</table>": "a   x\nb   y\ncc  d",
    "<table><tr><td><table><tr><td>a<td>b<tr><td>cc<td>d</table><td>e</table>": "a   b\ncc  d\ne",
    f"<table><tr><td>{'w' * 41}<td>x<tr><td>a<td>b</table>": f"{'w' * 41}  x\na{' ' * 42}b",
    f"<table><tr><td>{'w' * 90}<td>x<tr><td>a<td>b</table>": f"{'w' * 90}\n{' ' * 82}x\na{' ' * 81}b",
    f"<table><tr><td>{'w ' * 60}<td>x<tr><td>a<td>b</table>": f"{('w ' * 40).strip()}  x\n{('w ' * 20).strip()}\na{' ' * 80}b",
    "<table><tr><td colspan=70>a<td>b<tr>" + "<td>c" * 71 + "</table>": "a" + " " * 209 + "b\n" + "  ".join("c" * 71),
    "<ol start=-1><li>a<li>b<li value=1234567890>c<li>d</ol>": "-1. a\n0. b\n1234567890. c\n1234567891. d",
}


@pytest.mark.parametrize("page", CASES)
def test_rendering(page):
    assert render(page) == CASES[page]


def test_hard_pages():
    assert render("<div>" * 5000 + "deep") == "deep"
    assert render("<a b=\"" * 3000) == ""
    assert render("<table>" + "<tr><td>" + "w" * 5000 + "<tr><td>a<td>b" * 500 + "</table>").count("\n") == 500
    assert len(render("<p>x " * 20000).split()) == 20000


def test_table(spark):
    rows = [(1, "<p>a<p>b", "u", "t"), (2, None, "u", "t"), (3, "", None, "t")]
    got = {r.page_id: (r.text, r.n_lines, r.n_chars) for r in extracted(spark.createDataFrame(rows, "page_id long, html string, url string, text string")).collect()}
    assert got == {1: ("a\n\nb", 3, 4), 2: ("", 0, 0), 3: ("", 0, 0)}


TABLES = {
    "<table><tr><form><td>x</td></form></tr></table>": "x",
    "<table><tbody><form><tr><td>x</td></tr></form></tbody></table>": "x",
    "<table><tbody><td>x<td>y</table>": "x  y",
    "<table><td>x<td>y<tr><td>z</table>": "x  y\nz",
    "<table><tr>a<td>x</td></tr></table>": "a\n\nx",
    "<table><tbody><div>a</div><tr><td>x</table>b": "a\n\nx\n\nb",
    "<table><tr><a>a<td>x</a><td>y</table>": "a\n\nx  y",
    "<table><tr><td>o<table><tr><p>a</p><td>i</table><td>e</table>": "o a i  e",
    "<table><colgroup><col><tr><td>x<caption>c</table>": "c\n\nx",
    "a <svg><title>t</title><desc>d</desc><path/><text>s</text></svg> <math><mi>m</mi><annotation>n</annotation></math> <map>p</map>": "a s m p",
}


@pytest.mark.parametrize("page", TABLES)
def test_every_visible_word_of_a_table_once(page):
    assert render(page).split() == TABLES[page].split()


@pytest.mark.parametrize("deep", ["<div>", "<span>", "<font><b>", "<ul><li>", "<table><tr><td>"])
def test_visibility_holds_at_any_depth(deep):
    page = deep * 3000 + "a <div style='display:none'>secret<div>more</div> still <i>secret</i></div> b"
    assert [w for w in render(page).split() if w != "-"] == ["a", "b"]


def random_page(rng, shown, depth=0, hidden=False, pre=""):
    """Markup of a random tree; the visible words are appended to `shown` in the order of the page."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["text", "p", "div", "span", "b", "li", "table", "none", "hidden", "visible", "script", "comment"])
        if kind == "text" or depth > 4:
            word = f"w{len(shown)}" if not hidden else "secret"
            if not hidden:
                shown.append(word)
            out.append(f" {word} ")
        elif kind == "none":
            out.append(f"<div style='display:none'>{random_page(rng, [], depth + 1, True)}</div>".replace("visibility:visible", "").replace("w0", "secret"))
        elif kind in ("hidden", "visible"):
            out.append(f"<div style='visibility:{kind}'>{random_page(rng, shown, depth + 1, kind == 'hidden')}</div>")
        elif kind == "script":
            out.append("<script>secret()</script>")
        elif kind == "comment":
            out.append("<!-- secret -->")
        elif kind == "table":  # a single column: rows keep the order of the page
            out.append("<table>" + "".join(f"<tr><td>{random_page(rng, shown, depth + 1, hidden)}" for _ in range(2)) + "</table>")
        elif kind == "li":
            out.append("<ul>" + "".join(f"<li>{random_page(rng, shown, depth + 1, hidden)}" for _ in range(2)) + "</ul>")
        else:
            out.append(f"<{kind}>{random_page(rng, shown, depth + 1, hidden)}</{kind}>")
    return "".join(out)


def test_visible_words_of_random_pages():
    """Every visible word once and in order, nothing else: the generator knows which words are visible."""
    rng = random.Random(8)
    for _ in range(400):
        shown = []
        page = random_page(rng, shown)
        assert [w for w in render(page).split() if w != "-"] == shown, page


def test_long_runs_and_very_long_pages(spark):
    page = "<i>x</i>" * 200_000
    assert render(page) == "x" * 200_000
    rows = [(1, "<p>word</p>" * 50_000), (2, "<p>a"), (2, "<p>a")]
    got = sorted((r.page_id, r.n_lines) for r in extracted(spark.createDataFrame(rows, "page_id long, html string")).collect())
    assert got == [(1, 99_999), (2, 1), (2, 1)]
    assert extracted(spark.createDataFrame([], "page_id long, html string, text string")).count() == 0


def test_hostile_tables_take_little_time_and_memory():
    many = 20_000
    assert render("<table><tr>" + "<td colspan=1000 rowspan=65534>a" * many + "</table>").split() == ["a"] * many
    assert render("<table>" + "<tr><td rowspan=65534>a" * many + "</table>").split() == ["a"] * many
    assert render("<table><tr>" + "<td>a" * many + "<tr><td>b" * many + "</table>").split() == ["a"] * many + ["b"] * many


@pytest.mark.parametrize("page", ["<font>" * 100_000 + "<td></p>" * 100_000, "<div>" * 100_000 + "<li>" * 100_000, "<p><button>" + "<div>" * 100_000, "<b><p>" * 100_000 + "</i>" * 100_000])
def test_time_follows_the_page_at_any_depth(page):
    began = time.perf_counter()
    assert render(page + "x").split()[-1:] in (["x"], [])
    assert time.perf_counter() - began < 5


class Laid:
    """A plain second layout of a page model, built from rules alone: blocks are lists of lines, and two blocks
    have an empty line between if either asks for it."""

    def __init__(self):
        self.lines, self.spaced = [], False

    def add(self, lines, spaced):
        if not lines:
            return
        if self.lines and (spaced or self.spaced):
            self.lines.append("")
        self.lines += lines
        self.spaced = spaced


def laid_list(model, indent=""):
    """Lines of nested lists: items (text, sublist), each sublist one mark deeper."""
    ordered, items = model
    out = []
    for n, (text, below) in enumerate(items, 1):
        mark = f"{n}. " if ordered else "- "
        out.append(indent + mark + text)
        if below:
            out += laid_list(below, indent + " " * len(mark))
    return out


def laid_table(rows):
    """Lines of a table of one-line cells (text, columns, rows): all columns two spaces apart."""
    taken, placed, wide = set(), [], {}
    for r, row in enumerate(rows):
        c, line = 0, []
        for text, across, down in row:
            while (r, c) in taken:
                c += 1
            line.append((c, text))
            wide[c] = max(wide.get(c, 0), len(text))
            taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
            c += across
        placed.append(line)
    start, at = {}, 0
    for c in sorted(wide):
        start[c], at = at, at + wide[c] + 2
    out = []
    for line in placed:
        text = ""
        for c, word in line:
            text = text.ljust(start[c]) + word
        out.append(text.rstrip())
    return out


def random_list(rng, depth=0):
    items = [(f"i{rng.randrange(1000)}", random_list(rng, depth + 1) if depth < 3 and rng.random() < 0.3 else None) for _ in range(rng.randrange(1, 5))]
    return rng.random() < 0.4, items


def list_markup(model):
    tag = "ol" if model[0] else "ul"
    return f"<{tag}>" + "".join(f"<li>{t}{list_markup(b) if b else ''}" for t, b in model[1]) + f"</{tag}>"


def random_table(rng):
    """Rows of cells without overlaps: spans over rows stand only in the first column."""
    rows, free = [], 0
    count = rng.randrange(1, 6)
    for r in range(count):
        row = []
        if r >= free:
            down = rng.choice((1, 1, 1, 2, 3))
            down = min(down, count - r)
            row.append((f"r{rng.randrange(10 ** rng.randrange(1, 7))}", 1, down))
            free = r + down
        row += [("c" * rng.randrange(1, 9), rng.choice((1, 1, 1, 2, 3)), 1) for _ in range(rng.randrange(1, 5))]
        rows.append(row)
    return rows


def table_markup(rows):
    cell = lambda text, across, down: "<td" + (f" colspan={across}" if across > 1 else "") + (f" rowspan='{down}'" if down > 1 else "") + f">{text}"
    return "<table>" + "".join("<tr>" + "".join(cell(*c) for c in row) for row in rows) + "</table>"


def test_layout_equals_a_second_renderer():
    """Spacing of blocks, marks and indents of lists, columns and spans of tables on random pages."""
    rng = random.Random(4)
    for _ in range(400):
        want, page = Laid(), []
        for _ in range(rng.randrange(1, 7)):
            kind = rng.choice(["p", "div", "list", "table", "pre", "h2", "br"])
            words = [f"w{rng.randrange(100)}" for _ in range(rng.randrange(1, 8))]
            if kind in ("p", "h2", "div"):
                page.append(f"<{kind}>{'  '.join(words)}\n</{kind}>")
                want.add([" ".join(words)], kind != "div")
            elif kind == "br":
                page.append(f"<div>{'<br>'.join(words)}</div>")
                want.add(words, False)
            elif kind == "pre":
                page.append(f"<pre>{chr(10).join('  ' + w for w in words)}</pre>")
                want.add(["  " + w for w in words], True)
            elif kind == "list":
                model = random_list(rng)
                page.append(list_markup(model))
                want.add(laid_list(model), True)
            else:
                rows = random_table(rng)
                page.append(table_markup(rows))
                want.add(laid_table(rows), True)
        assert render("".join(page)) == "\n".join(want.lines), "".join(page)
