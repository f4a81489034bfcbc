"""Text of HTML pages as it is laid out: all visible text, with block spacing, lists and aligned table cells.

A tokenizer reads tags, comments, raw-text elements and character references; a tree builder makes a tree of nodes, closes elements whose end
tags are implied, supplies table rows that are left out, and ignores end tags that match nothing; style rules decide what shows; a renderer walks the tree
and makes lines. Each of them takes time in proportion to the page, whatever is left open or nested: the builder counts what is open in each scope, so it looks
for an element only where there is one to close.

Elements that are never shown, those with ``hidden`` and those with a ``display`` of none are left out with all they hold; what is merely invisible
(``visibility``) is left out except where something inside is visible again. Declarations come from ``style`` attributes and from the page's style
elements: selectors of tags, classes, ids and attributes, with descendants and children, by specificity, order and ``!important``; media rules hold if they
do for a screen of 1280 pixels; rules with other selectors don't apply. Of inline SVG the text elements and foreign HTML show, of MathML all but annotations and
phantoms, of a select all its options, of buttons made by input their labels.

Rules: white space collapses except in ``pre``, ``textarea`` and where a style keeps it; paragraphs, headings, lists, tables and quotations stand apart by an
empty line, other blocks by a line end; list items begin with "- " or their number and are indented by two columns a level. The cells of a table stand in
columns of one width each, two columns apart, measured as a terminal shows them; ``colspan`` and ``rowspan`` hold their places, cells of several
lines, such as tables in cells, keep these side by side; a table of one column is stacked as it is. Each option and each text element of
SVG has a line of its own; parts of fractions and cells of MathML are set apart by a space.

Defined results: null and empty pages give an empty text; pages of any length are rendered whole; text outside of any element counts; elements left open
end with the page; a tag that the page's end cuts off is no text, as in browsers; nesting of any depth is handled without recursion; repeated rows give
the same text each; an empty table gives none; other columns, whatever their names, aren't touched.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp noembed noframes iframe")
UNSEEN = _words("script style head title meta link template noembed noframes iframe datalist object video audio canvas base param source track area col colgroup")
#: Parts of inline SVG and of MathML that aren't drawn.
UNDRAWN = _words("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom")
#: HTML again inside SVG and MathML.
INTEGRATION = _words("foreignobject desc title mi mo mn ms mtext annotation-xml")
#: Tags that end SVG and MathML left open.
BREAKOUT = _words("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var")
SPACED = _words("mfrac mtable mtr mlabeledtr")
APART = _words("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset")
BLOCK = APART | _words("html body div section article aside main header footer nav address form li dt dd tr td th thead tbody tfoot caption figcaption details summary legend hgroup search center dir menu option optgroup")
LISTS = _words("ul ol menu dir")
CELLS = _words("td th")
TABLE_PARTS = _words("tr td th tbody thead tfoot caption colgroup")
#: What an opening tag closes is sought up to the nearest of the second set: name of the search, what is sought, where it ends.
_CELL_EDGE = _words("td th table caption button object html body")
SEARCHES = {
    "p": (_words("p"), _CELL_EDGE),
    "li": (_words("li"), LISTS | _CELL_EDGE),
    "dt": (_words("dt dd"), _words("dl") | _CELL_EDGE),
    "tr": (_words("tr td th caption colgroup"), _words("table")),
    "td": (_words("td th caption"), _words("tr table")),
    "tbody": (_words("thead tbody tfoot tr td th caption colgroup"), _words("table")),
    "option": (_words("option"), _words("select datalist")),
    "optgroup": (_words("option optgroup"), _words("select")),
    "body": (_words("head"), _words("html")),
}
OPENS = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "thead": "tbody", "tbody": "tbody", "tfoot": "tbody", "caption": "tbody", "option": "option", "optgroup": "optgroup", "body": "body"}
CLOSES_P = APART | _words("div section article aside main header footer nav address form li dd dt figcaption details summary center dir menu")
#: An end tag closes nothing beyond one of these; those of table parts nothing beyond the table.
EDGES = _words("table td th caption")

_NAME = re.compile(r"[^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]*)))?""")
_BLANK = re.compile(r"[\s/]*")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from a place in a tag, whether the tag ends with a slash, and where what follows begins; -1 if the page ends within the tag."""
    given: dict[str, str] = {}
    while True:
        blank = _BLANK.match(page, at).end()
        if blank >= len(page):
            return given, False, -1
        if page[blank] == ">":
            return given, page[blank - 1] == "/" and blank > at, blank + 1
        m = _ATTRIBUTE.match(page, blank)
        at = m.end()
        if m[2] is m[3] is m[4] is None:
            rest = _SPACE.match(page, at)
            after = rest.end() if rest else at
            if page[after : after + 1] == "=":  # a quotation that doesn't end
                return given, False, -1
        value = m[2] or m[3] or m[4] or ""
        given.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)


def tokens(page: str, foreign: Callable[[], str] = lambda: "") -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes): kinds are text, open, close and raw (the text of a raw-text element that isn't text to be decoded).

    foreign says whether SVG or MathML is open, where a tag that ends with a slash is an element without content.
    """
    at, n = 0, len(page)
    text = lambda s: html.unescape(s) if "&" in s else s
    while at < n:
        i = page.find("<", at)
        while i >= 0 and not (page[i + 1 : i + 2] in ("!", "?") or page[i + 1 : i + 2] == "/" and i + 2 < n or page[i + 1 : i + 2].isascii() and page[i + 1 : i + 2].isalpha()):
            i = page.find("<", i + 1)
        if i < 0:
            yield "text", text(page[at:]), {}
            return
        if i > at:
            yield "text", text(page[at:i]), {}
        if page.startswith("<!--", i):
            if page.startswith(">", i + 4) or page.startswith("->", i + 4):
                at = page.index(">", i) + 1
            else:
                end = _COMMENT_END.search(page, i + 4)
                at = end.end() if end else n
            continue
        closing = page[i + 1] == "/"
        first = page[i + 1 + closing]
        if not (first.isascii() and first.isalpha()):
            end = page.find(">", i + 1)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, i + 1 + closing)
        name = m[0].lower()
        given, slash, at = _attributes(page, m.end())
        if at < 0:
            return
        if closing:
            yield "close", name, {}
            continue
        inside = foreign() or name in ("svg", "math")
        yield "open", name, given
        if inside:
            if slash and name not in VOID and name not in BREAKOUT:
                yield "close", name, {}
        elif name in RAW:
            end = _RAW_END[name].search(page, at)
            inner = page[at : end.start()] if end else page[at:]
            yield ("text", text(inner), {}) if name in ("textarea", "title") else ("raw", inner, {})
            yield "close", name, {}
            at = n
            if end:
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
        elif name == "plaintext":
            yield "raw", page[at:], {}
            return


class Node:
    """An element or, with a text, a piece of it."""

    __slots__ = ("name", "given", "parent", "children", "text", "foreign")

    def __init__(self, name: str, given: dict[str, str], parent: Node | None, text: str | None = None, foreign: str = "") -> None:
        self.name, self.given, self.parent, self.text, self.foreign = name, given, parent, text, foreign
        self.children: list[Node] = []


class _Open:
    """The open elements, with counts of them in each scope."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.counts: dict[str, list[int]] = {k: [0] for k in SEARCHES}
        self.named: list[tuple[str, dict[str, int]]] = [("", {})]  # by edges
        self.all: dict[str, int] = {}

    def push(self, node: Node) -> None:
        name = node.name
        self.stack[-1].children.append(node)
        self.stack.append(node)
        for k, (sought, edges) in _INVOLVED.get(name, ()):
            if name in sought:
                self.counts[k][-1] += 1
            if name in edges:
                self.counts[k].append(0)
        here = self.named[-1][1]
        here[name] = here.get(name, 0) + 1
        self.all[name] = self.all.get(name, 0) + 1
        if name in EDGES:
            self.named.append((name, {}))

    def pop(self) -> None:
        name = self.stack.pop().name
        if name in EDGES:
            self.named.pop()
        self.named[-1][1][name] -= 1
        self.all[name] -= 1
        for k, (sought, edges) in _INVOLVED.get(name, ()):
            if name in edges:
                self.counts[k].pop()
            if name in sought:
                self.counts[k][-1] -= 1

    def close(self, search: str) -> None:
        """Closes what the search is for, if it is open."""
        while self.counts[search][-1]:
            sought = SEARCHES[search][0]
            while self.stack[-1].name not in sought:
                self.pop()
            self.pop()

    def end(self, name: str) -> bool:
        """Takes an end tag; whether there was something to close."""
        if name in ("table", "body", "html"):
            found = self.all.get(name, 0)
        elif name in TABLE_PARTS:
            found = 0
            for edge, counts in reversed(self.named):
                found = counts.get(name, 0)
                if found or edge in ("table", ""):
                    break
        else:
            found = self.named[-1][1].get(name, 0)
        if found:
            while self.stack[-1].name != name:
                self.pop()
            self.pop()
        return bool(found)


_INVOLVED: dict[str, list] = {}
for _k, _v in SEARCHES.items():
    for _name in _v[0] | _v[1]:
        _INVOLVED.setdefault(_name, []).append((_k, _v))


def tree(page: str) -> Node:
    """The page's tree under a nameless root."""
    root = Node("", {}, None)
    open_ = _Open(root)
    stack = open_.stack
    for kind, value, given in tokens(page, lambda: stack[-1].foreign):
        top = stack[-1]
        if kind in ("text", "raw"):
            top.children.append(Node("", {}, top, value))
            continue
        if kind == "close":
            if value == "br" or value == "p" and not open_.named[-1][1].get("p"):
                open_.push(Node(value, {}, stack[-1]))
                open_.pop()
            else:
                open_.end(value)
            continue
        if top.foreign and value in BREAKOUT:
            while stack[-1].foreign:
                open_.pop()
        if value in CLOSES_P:
            open_.close("p")
        if value in OPENS:
            open_.close(OPENS[value])
        if value in CELLS and open_.counts["tr"][-1] == 0 and open_.all.get("table"):
            open_.push(Node("tr", {}, stack[-1]))
        top = stack[-1]
        inside = value if value in ("svg", "math") else top.foreign
        if inside and value in INTEGRATION:
            inside = ""
        elif inside == "svg" and value == "text":
            inside = "text"
        open_.push(Node(value, given, top, foreign=inside))
        if value in VOID:
            open_.pop()
    return root


def _declared(text: str) -> dict[str, tuple[str, bool]]:
    """Declarations: property to value and whether it is important."""
    out: dict[str, tuple[str, bool]] = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        if colon:
            value, bang, mark = value.strip().lower().partition("!")
            important = bool(bang) and mark.strip() == "important"
            name = name.strip().lower()
            if not (name in out and out[name][1] and not important):
                out[name] = value.strip(), important
    return out


_HEEDED = ("display", "visibility", "white-space")
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[^\]\[]*\])*)")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


@dataclass(frozen=True)
class Compound:
    tag: str
    classes: tuple[str, ...]
    ids: tuple[str, ...]
    attributes: tuple[tuple[str, str | None], ...]

    def fits(self, e: Node) -> bool:
        given = e.given
        return (
            self.tag in ("", "*", e.name)
            and all(given.get("id") == i for i in self.ids)
            and all(a in given and v in (None, given[a]) for a, v in self.attributes)
            and (not self.classes or set(self.classes) <= set(given.get("class", "").split()))
        )


def _selector(text: str) -> list[tuple[str, Compound]] | None:
    """Compounds from the last to the first, each with what it is of the one before: " " an ancestor, ">" the parent. None: not a selector known here."""
    chain, way = [], " "
    for word in text.replace(">", " > ").split():
        if word == ">":
            way = ">"
            continue
        m = _COMPOUND.fullmatch(word)
        if not m or not word:
            return None
        classes, ids, attributes, at = [], [], [], 0
        for p in _PART.finditer(m[2]):
            if p.start() != at:
                return None
            at = p.end()
            if p[1]:
                (classes if p[1] == "." else ids).append(p[2])
            else:
                attributes.append((p[3].lower(), p[4]))
        if at != len(m[2]):
            return None
        chain.append((way, Compound((m[1] or "").lower(), tuple(classes), tuple(ids), tuple(attributes))))
        way = " "
    if not chain:
        return None
    ways = [w for w, _ in chain[1:]] + [""]
    return [(w, c) for w, (_, c) in zip(ways, chain, strict=True)][::-1]


def _for_screen(query: str) -> bool:
    for part in query.lower().split(","):
        features = re.findall(r"\(\s*([\w-]+)\s*:\s*([\d.]+)px\s*\)", part)
        widths = all({"min-width": 1280 >= float(n), "max-width": 1280 <= float(n)}.get(k, False) for k, n in features)
        words = set(re.findall(r"[a-z-]+", re.sub(r"\([^()]*\)", " ", part)))
        if part.count("(") == len(features) and widths and words <= {"screen", "all", "and", "only"}:
            return True
    return False


class Sheet:
    """Style rules about what is heeded, found by the id, class or tag of their last compound."""

    def __init__(self, texts: list[str]) -> None:
        self.rules: dict[str, list] = {}
        for text in texts:
            if any(p in text.lower() for p in _HEEDED):
                self._read(re.sub(r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)", " ", text).replace("<!--", " ").replace("-->", " "))

    def _read(self, text: str) -> None:
        levels: list[tuple[str, bool, int]] = []
        mark = 0
        for m in re.finditer(r"[{}]", text):
            active = levels[-1][1] if levels else True
            if m[0] == "{":
                prelude = text[mark : m.start()].rpartition(";")[2].strip()
                if prelude[:6].lower() == "@media":
                    active = active and _for_screen(prelude[6:])
                elif prelude[:1] == "@" and prelude[:9].lower() != "@supports" and prelude[:6].lower() != "@layer":
                    active = False
                levels.append((prelude, active, m.end()))
            elif levels:
                prelude, active, start = levels.pop()
                if active and prelude[:1] != "@":
                    self._add(prelude, text[start : m.start()].rpartition("}")[2])
            mark = m.end()

    def _add(self, selectors: str, body: str) -> None:
        heeded = {k: v for k, v in _declared(body).items() if k in _HEEDED}
        if not heeded:
            return
        order = sum(map(len, self.rules.values()))
        for s in selectors.split(","):
            chain = _selector(s)
            if chain:
                last = chain[0][1]
                key = f"#{last.ids[0]}" if last.ids else f".{last.classes[0]}" if last.classes else last.tag or "*"
                weight = tuple(sum(f(c) for _, c in chain) for f in (lambda c: len(c.ids), lambda c: len(c.classes) + len(c.attributes), lambda c: c.tag not in ("", "*")))
                self.rules.setdefault(key, []).append((chain, weight, order, heeded))

    @staticmethod
    def _fits(chain: list, e: Node) -> bool:
        """Ancestors are sought from the nearest on; a child step that fails goes on with the next ancestor of the last descendant step."""
        if not chain[0][1].fits(e):
            return False
        i, at, retry = 1, e.parent, None
        while i < len(chain):
            if at is None or not at.name:
                return False
            way, compound = chain[i]
            if compound.fits(at):
                if way == " ":
                    retry = i, at.parent
                i, at = i + 1, at.parent
            elif way == " ":
                at = at.parent
            elif retry is not None:
                i, at = retry
            else:
                return False
        return True

    def style(self, e: Node) -> dict[str, str]:
        """What holds for an element, of what is heeded."""
        given = e.given
        best: dict[str, tuple] = {}
        if "hidden" in given:
            best["display"] = ((False, -1), "none")
        if self.rules:
            keys = [f"#{given['id']}"] if "id" in given else []
            for key in [*keys, *(f".{c}" for c in set(given.get("class", "").split())), e.name, "*"]:
                for chain, weight, order, heeded in self.rules.get(key, ()):
                    if self._fits(chain, e):
                        for k, (value, important) in heeded.items():
                            rank = (important, 0, *weight, order)
                            if k not in best or rank >= best[k][0]:
                                best[k] = rank, value
        if "style" in given:
            for k, (value, important) in _declared(given["style"]).items():
                if k in _HEEDED:
                    rank = (important, 1)
                    if k not in best or rank >= best[k][0]:
                        best[k] = rank, value
        return {k: v for k, (_, v) in best.items()}


def width(s: str) -> int:
    """Columns that a terminal shows a text in."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


@dataclass
class Box:
    """Lines under construction: of the page, or of a table cell."""

    lines: list[str] = field(default_factory=list)
    line: list[str] = field(default_factory=list)
    gap: int = 0  # empty lines due before the next text
    space: bool = False
    prefix: str = ""  # list marker due before the next text

    def text(self, s: str, indent: int, keep: bool) -> None:
        if keep:
            first, *rest = s.split("\n")
            self._put(first, indent, raw=True)
            for r in rest:
                self.end()
                self._put(r, indent, raw=True)
            return
        if not s:
            return
        parts = _SPACE.split(s)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        body = " ".join(p for p in parts if p)
        if body:
            self._put(body, indent)
            self.space = parts[-1] == ""

    def _put(self, s: str, indent: int, raw: bool = False) -> None:
        if not s:
            return
        if not self.line:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            pad = " " * max(0, indent - len(self.prefix))
            self.line.append(pad + self.prefix)
            self.prefix = ""
        elif self.space and not raw:
            self.line.append(" ")
        self.space = False
        self.line.append(s)

    def end(self, gap: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
            self.gap = 0
        self.space = False
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end()
        return self.lines


def _span(given: dict[str, str], name: str, most: int) -> int:
    m = re.match(r"\s*\+?(\d{1,6})", given.get(name, ""))
    return min(int(m[1]), most) if m else 1


@dataclass
class Grid:
    """Cells of a table at their rows and columns."""

    rows: int = 0
    cells: list[tuple[int, int, int, list[str]]] = field(default_factory=list)  # row, column, columns, lines
    held: list[tuple[int, int, int]] = field(default_factory=list)  # by cells of earlier rows: first row that is free again, columns from, to
    column: int = 0

    def row(self) -> None:
        self.rows += 1
        self.column = 0
        self.held = sorted((h for h in self.held if h[0] > self.rows - 1), key=lambda h: h[1])

    def place(self, columns: int, rows: int) -> tuple[int, int]:
        """Row and column of the next cell."""
        if not self.rows:
            self.row()
        for until, a, b in self.held:
            if until > self.rows - 1 and a <= self.column < b:
                self.column = b
        at = self.rows - 1, self.column
        if rows != 1:
            self.held.append((self.rows - 1 + (rows or 1 << 30), self.column, self.column + columns))
        self.column += columns
        return at

    def lines(self) -> list[str]:
        shown = [c for c in self.cells if any(c[3])]
        used = {c: i for i, c in enumerate(sorted({c[1] for c in shown}))}
        if len(used) <= 1:
            return [line for c in shown for line in c[3]]
        starts = sorted(used)
        widths = [0] * len(used)
        for wide in (False, True):
            for _, column, columns, lines in shown:
                a = used[column]
                b = a + 1
                while b < len(starts) and starts[b] < column + columns:
                    b += 1
                if (b - a > 1) == wide:
                    least = max(map(width, lines)) - 2 * (b - a - 1) - sum(widths[a:b])
                    widths[b - 1] += max(0, least if wide else least)
        left = [sum(widths[:i]) + 2 * i for i in range(len(widths))]
        out: list[str] = []
        by_row: dict[int, list] = {}
        for row, column, _, lines in shown:
            by_row.setdefault(row, []).append((left[used[column]], lines))
        for row in sorted(by_row):
            for i in range(max(len(x) for _, x in by_row[row])):
                line, at = [], 0
                for start, lines in by_row[row]:
                    if i < len(lines) and lines[i]:
                        line.append(" " * (start - at) + lines[i])
                        at = start + width(lines[i])
                out.append("".join(line).rstrip())
        return out


@dataclass
class Listing:
    number: int | None


@dataclass(frozen=True)
class Context:
    """What an element's content inherits."""

    visible: bool = True
    keep: bool = False
    indent: int = 0
    item: bool = False
    listing: Listing | None = None
    grid: Grid | None = None


def _styles(root: Node) -> list[str]:
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.name == "style" and not e.foreign:
            if _for_screen(e.given.get("media") or "all"):
                found.append("".join(c.text or "" for c in e.children))
        else:
            todo += reversed(e.children)
    return found


def rendered(page: str) -> str:
    """The text of a page."""
    root = tree(page.replace("\r\n", "\n"))
    sheet = Sheet(_styles(root) if "<style" in page.lower() else [])
    boxes = [Box()]
    todo: list = [(c, Context()) for c in reversed(root.children)]
    while todo:
        node, context = todo.pop()
        if node is None:
            context()
        elif node.text is not None:
            if context.visible and node.parent.foreign != "svg":
                boxes[-1].text(node.text.replace("\xa0", " ") if context.keep else node.text, context.indent, context.keep)
        else:
            _enter(node, context, sheet, boxes, todo)
    return "\n".join(boxes[0].done()).strip("\n")


def _enter(e: Node, context: Context, sheet: Sheet, boxes: list[Box], todo: list) -> None:
    """Opens an element's lines and adds its content, and what is to be done after it, to what is to do."""
    name, given, out, above = e.name, e.given, boxes[-1], e.parent.foreign
    style = sheet.style(e) if given or sheet.rules else {}
    shown = name not in UNSEEN or above and name not in UNDRAWN
    if style.get("display") == "none" or not shown or above and (name in UNDRAWN or given.get("display") == "none") or name == "dialog" and "open" not in given:
        return
    seen = style.get("visibility", given.get("visibility") if above else None)
    visible = context.visible if seen is None or seen == "inherit" else seen in ("visible", "initial")
    space = style.get("white-space", "")
    keep = space.startswith(("pre", "break")) and space != "pre-line" or space not in ("normal", "nowrap") and (context.keep or name in ("pre", "textarea", "xmp", "plaintext"))
    inner = replace(context, visible=visible, keep=keep)
    if above and name == "text":
        out.end()
    if above and e.parent.name in SPACED:
        out.space = True
    if name == "br":
        if not out.line:
            out.gap = max(out.gap, 1) if out.lines else 0
        out.end()
        return
    block = name in BLOCK and not above
    if block and name not in CELLS and name != "tr":
        out.end(1 if name in APART and not (name in ("ul", "ol") and context.item) else 0)
    if name == "input" and visible and given.get("type", "").lower() in ("submit", "button", "reset"):
        out.text(given.get("value", ""), context.indent, False)
    if name in VOID:
        return

    def after(gap: int = 1 if name in APART else 0) -> None:
        boxes[-1].end(gap)

    then: Callable[[], None] | None = after if block or name == "text" and e.foreign == "text" else None
    if name in LISTS:
        start = given.get("start", "")
        number = (int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if name == "ol" else None
        inner = replace(inner, indent=context.indent + 2, listing=Listing(number))
    elif name in ("blockquote", "dd"):
        inner = replace(inner, indent=context.indent + 2)
    elif name == "li":
        mark, listing = "- ", context.listing
        if listing is not None and listing.number is not None:
            if re.fullmatch(r"-?\d{1,9}", given.get("value", "")):
                listing.number = int(given["value"])
            mark = f"{listing.number}. "
            listing.number += 1
        out.prefix = mark if visible else ""
        inner = replace(inner, indent=max(context.indent, len(mark)) if listing is not None else context.indent + 2, item=True)

        def then() -> None:
            boxes[-1].end()
            boxes[-1].prefix = ""

    elif name == "table":
        grid, indent = Grid(), context.indent
        boxes.append(Box())  # for the caption, and for what stands in no cell
        inner = replace(inner, indent=0, item=False, listing=None, grid=grid)

        def then() -> None:
            lines = boxes.pop().done() + grid.lines()
            for line in lines:
                if line:
                    boxes[-1].text(line, indent, True)
                    boxes[-1].end()
                else:
                    boxes[-1].gap = 1
            boxes[-1].end(1)

    elif name == "tr" and context.grid is not None:
        context.grid.row()
        then = None
    elif name in CELLS and context.grid is not None:
        grid, columns = context.grid, max(1, _span(given, "colspan", 1000))
        row, column = grid.place(columns, _span(given, "rowspan", 65534))
        boxes.append(Box())
        inner = replace(inner, indent=0, item=False, listing=None, grid=None)

        def then() -> None:
            grid.cells.append((row, column, columns, boxes.pop().done()))

    elif name in ("option", "optgroup") and given.get("label"):
        if visible:
            out.text(given["label"], context.indent, keep)
        out.end()
        if name == "option":
            return
    if then is not None:
        todo.append((None, then))
    todo += [(c, inner) for c in reversed(e.children)]


def text_column(page: str = "html") -> Column:
    """The rendered text of each page."""

    @F.arrow_udf("string")
    def visible_text(x: pa.Array) -> pa.Array:
        return pa.array([rendered(p.as_py() or "") for p in x], pa.string())

    return visible_text(F.col(page).cast("string"))
