import random
import time

import pytest

from gridloom.llm.html_text import rendered, text_column, tree

CASES = {
    "": "",
    "plain &amp; text": "plain & text",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b<span> c</span></div>": "a\nb c",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>x<li>y<ul><li>z</ul></ul>": "- x\n- y\n  - z",
    "<ol start=3><li>x<li>y</ol>": "3. x\n4. y",
    "<table><tr><th>a<th>bb<tr><td>ccc<td>d</table>": "a    bb\nccc  d",
    "<table><tr><td>1<td><table><tr><td>x<td>y</table><tr><td>22<td>z</table>": "1   x  y\n22  z",
    "<head><title>t</title><style>p{}</style></head><script>if (a<b) x='</p>'</script>body": "body",
    "<p hidden>no<p style='display: none'>no<p>yes": "yes",
    "<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no": "yes",
    "<!-- no --><!DOCTYPE html><?php no ?>yes<!-- open": "yes",
    "<pre> a\n  b</pre>c": " a\n  b\n\nc",
    "a < b and 1<2": "a < b and 1<2",
    "<b>x</i></b> y</p>z": "x y\n\nz",
    "<p>one</div> two": "one two",
    "<dl><dt>k<dd>v</dl>": "k\n  v",
    "  a \n\t b  ": "a b",
    "<a href='x>y'>in</a> out": "in out",
    "<textarea>a\n b</textarea>": "a\n b",
}


@pytest.mark.parametrize("page", list(CASES))
def test_layout(page):
    assert rendered(page).strip("\n") == CASES[page].strip("\n")


def test_no_visible_word_is_lost():
    page = "<html><body>" + "".join(f"<{t}>w{i}x " for i, t in enumerate("div p ul li table tr td b span h1 ol li dl dt dd blockquote section a em".split() * 3)) + "<p>end"
    got = rendered(page).split()
    assert sorted(w for w in got if w.startswith("w")) == sorted(f"w{i}x" for i in range(57)) and "end" in got


DRAWN = {
    "so <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds": "so E=mc2 holds",
    "<math><mfrac><mi>a</mi><mi>b</mi></mfrac><semantics><mi>x</mi><annotation>\\x</annotation></semantics><mphantom>no</mphantom></math>": "a bx",
    "a<svg><title>no</title><defs><text>no</text></defs><desc/><metadata>no</metadata>no<g><text x=1>one</text><text>t<tspan>wo</tspan></text></g></svg>b": "a\none\ntwo\nb",
    "<svg><title/><style/><foreignObject><p>in</p></foreignObject><text display='none'>no</text><path d='M0'/></svg>after": "in\n\nafter",
    "<svg><path d=1><p>open": "open",
    "<desc>html</desc>": "html",
    "<form>Size <select><option>S<option selected>M</select> go</form>": "Size\nS\nM\ngo",
    "<select><optgroup label='A&amp;B'><option label=x>no</option><option>y</optgroup></select>": "A&B\nx\ny",
    "<select hidden><option>no</select><datalist><option>no</datalist>yes": "yes",
}


@pytest.mark.parametrize("page", list(DRAWN))
def test_formulas_drawings_and_options_show(page):
    assert rendered(page).strip("\n") == DRAWN[page]


STYLED = {
    "<style>.h{display:none} #x{visibility:hidden}</style><p class='a h'>secret<p id=x>no <b style='visibility:visible'>yes</b><p>shown": "yes\n\nshown",
    "<style>/* p{display:none} */ p.n, div > .k {display: none !important}</style><p class=n style='display:block'>no<div><b class=k>no</b><i><b class=k>yes</b></i></div>": "yes",
    "<style>@media print{p{display:none}} @media (max-width:600px){p{display:none}} @media screen and (min-width:800px){b{display:none}}</style><p>yes <b>no</b>": "yes",
    "<style>p{display:none} p.s{display:block} p:hover{display:none}</style><p>no<p class=s>yes": "yes",
    "<style>[data-x=off]{display:none}</style><p data-x=off>no<p data-x=on>yes<p hidden style='display:block'>too": "yes\n\ntoo",
    "<style>.c b{display:none}</style><div class=c><p>a<i><b>no</b></i></p></div><b>yes</b>": "a\n\nyes",
    "<style>.pre{white-space:pre}</style><div class=pre>a  b\n c</div>": "a  b\n c",
    "<dialog>no</dialog><dialog open>yes</dialog><input type=submit value='Send it'>": "yesSend it",
}
TABLES = {
    "<table><tr><td colspan=2>wide<td>c<tr><td>1<td>2<td>3</table>": "wide  c\n1  2  3",
    "<table><tr><td rowspan=2>r<td>a<tr><td>b<tr><td>x<td>y</table>": "r  a\n   b\nx  y",
    "<table><tr><td colspan=3>a long heading<tr><td>1<td>2<td>3</table>": "a long heading\n1  2  3",
    "<table><tr><td>one<br>two<td>x<tr><td>y<td>z</table>": "one  x\ntwo\ny    z",
    "<table><tr><td>k<td><table><tr><td>a<td>b<tr><td>cc<td>d</table><td>e</table>": "k  a   b  e\n   cc  d",
    "<table><tr><td>\u6f22\u5b57<td>x<tr><td>abcdef<td>y</table>": "\u6f22\u5b57    x\nabcdef  y",
    "<table><caption>cap</caption><thead><tr><th>h<tbody><tr><td>v</table>": "cap\nh\nv",
    "<table><td>no row<td>b</table>": "no row  b",
    "<table><tr><td><p>one<p>two</table>": "one\n\ntwo",
    "<table><tr><td colspan=1000000 rowspan=0>a<td>b<tr><td>c</table>": "a  b\n   c",
}


@pytest.mark.parametrize("page", [*STYLED, *TABLES])
def test_styles_and_tables(page):
    assert rendered(page).strip("\n") == (STYLED | TABLES)[page]


def test_trees_have_implied_tags():
    def plain(e):
        return e.text if e.text is not None else f"<{e.name}>" * bool(e.name) + "".join(map(plain, e.children)) + f"</{e.name}>" * bool(e.name)

    assert plain(tree("<ul><li>a<li>b<p>c<div>d")) == "<ul><li>a</li><li>b<p>c</p><div>d</div></li></ul>"
    assert plain(tree("<table><td>a<tr><td>b<table><td>c</table>d<th>e")) == "<table><tr><td>a</td></tr><tr><td>b<table><tr><td>c</td></tr></table>d</td><th>e</th></tr></table>"
    assert plain(tree("<dl><dt>k<dd>v<dt>l</dl><select><option>a<option>b</select></i>")) == "<dl><dt>k</dt><dd>v</dd><dt>l</dt></dl><select><option>a</option><option>b</option></select>"


@pytest.mark.parametrize("piece", ["<a", "<ul><li>", "<p><b>", "</x><div>", "<table><tr><td>", "<!--", "<a href='", '<a b="x" ', "<td rowspan=9>x", "<ul><b><li></li>", "<style>a{", "<p><table><tr><td><div>", "<a <", "&lt", "<i/", "<a =", "<select><optgroup><option>"])
def test_time_grows_with_the_page(piece):
    took = []
    for n in (1 << 16, 1 << 18):
        page = piece * (n // len(piece))
        start = time.process_time()
        rendered(page)
        took.append(time.process_time() - start)
    assert took[1] < 10 * max(took[0], 0.05)


def test_a_megabyte_of_unfinished_tags():
    start = time.process_time()
    assert rendered("before" + "<a" * 500_000) == "before" and rendered("x" + "<p class='" * 100_000) == "x"
    assert time.process_time() - start < 5


def test_visible_words_are_those_of_a_plain_walk():
    """Pages made as trees, so that what shows is known without parsing."""
    rng = random.Random(11)

    def made(depth, shown):
        out, seen = "", []
        for _ in range(rng.randint(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                w = f"w{rng.randrange(10**9)}"
                out += f" {w} "
                seen += [w] * shown
                continue
            tag, attributes, show = rng.choice("div span b section table ul em blockquote article script style".split()), "", True
            if rng.random() < 0.3:
                attributes, show = rng.choice([(" hidden", False), (" style='display:none'", False), (" class='gone x'", False), (" class=x", True), (" data-a='>'", True), (" style='color:red'", True)])
            if tag in ("script", "style"):
                out += f"<{tag}>var w0 = '<p>';</{tag}>"
                continue
            inner, words = made(depth - 1, shown and show)
            if tag == "table":
                inner = f"<tr><td>{inner}<td>"
            elif tag == "ul":
                inner = f"<li>{inner}" + ("</li>" if rng.random() < 0.5 else "")
            out += f"<{tag}{attributes}>{inner}</{tag}>"
            seen += words
        return out, seen

    for _ in range(200):
        body, seen = made(5, True)
        assert sorted(w for w in rendered("<head><title>w1</title><style>.gone{display:none}</style></head><body>" + body).split() if w != "-") == sorted(seen)


def test_awkward_rows(spark):
    deep = "<div>" * 20_000 + "deep" + "<b>" * 100
    rows = [(1, None), (2, ""), (3, deep), (4, "<"), (5, "</"), (6, "<p"), (7, "x" * 300_000), (7, "x" * 300_000), (None, "<p>a</p>"), (8, "<<>><p/><td>z</td></table></html>after")]
    df = spark.createDataFrame(rows, "page_id bigint, html string")
    got = df.select("page_id", text_column().alias("text")).collect()
    assert len(got) == 10 and got[0].text == "" and got[2].text == "deep" and len(got[6].text) == 300_000 and "after" in got[9].text
    assert df.limit(0).select(text_column()).count() == 0
