"""HTML extraction by layout-aware rendering.

A tree builder reads tags with the implied ones of the format (a paragraph ends before a
block, an item before the next item, a cell before the next cell or row), and a renderer
walks the tree as a browser lays it out: what scripts, styles, metadata or hidden elements
hold is not visible; all other text is. White space collapses except in preformatted text;
blocks stand on lines of their own, paragraphs and headings with a blank line between; list
items get their bullet or number and their indent; a table's cells are placed on a grid, by
their column and row spans, and padded so that columns align. What a table holds outside of
its cells and caption moves before it, a cell outside of a row gets a row, and a form between
table parts is transparent, as browsers do.

``display`` and ``visibility`` come from style attributes and from the page's own style
sheets, by importance, specificity and order: rules of elements, classes, ids and attributes,
of descendants and children, for a screen of ``SCREEN`` pixels. ``display: none`` hides all
below; ``visibility`` is inherited, and a visible element inside a hidden one shows. Other
selectors (states, siblings) and sheets of other files do not count.

The tree is built and walked with explicit stacks, so nesting of any depth is rendered.

Defined cases: null or empty html gives the empty text; broken markup never fails: unknown
end tags are dropped and open elements end with the text; a repeated row gives its row again;
an empty table gives an empty result; pages of any length are rendered whole; other columns
stay, but for one named ``visible_text``, which is replaced.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enable_workers, text_of

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # where a quote is never closed
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
DECLARATION = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMPOUND = re.compile(r"""(\*|[a-zA-Z][\w-]*)?((?:[.\#][\w-]+|\[\s*[\w-]+\s*(?:[~|^$*]?=\s*(?:"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\])*)""", re.X)
SIMPLE = re.compile(r"""([.\#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""", re.X)
WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)px\s*\)", re.I)
SCREEN = 1280
WHITE = re.compile(r"[ \t\n\r\f]+")

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas annotation annotation-xml datalist area base link meta param source track".split())
DRAWN_UNSEEN = frozenset("defs desc metadata symbol marker mask pattern clippath lineargradient radialgradient filter".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir".split())
ENDS_P = BLOCK - {"body", "html", "legend", "optgroup", "option"}
HEAD_ONLY = frozenset("title meta link base style script template noscript".split())
# Start tag: the open elements it ends, and where the search for them stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"thead", "tbody", "tfoot", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "a": ({"a"}, {"table", "td", "th"}),
}
# Parts of a table: the open elements that may hold each, and what else may stand in a table.
PARTS = {
    **dict.fromkeys(("td", "th"), frozenset("tr tbody thead tfoot table".split())),
    "tr": frozenset("tbody thead tfoot table".split()),
    "col": frozenset("colgroup table".split()),
    **dict.fromkeys("tbody thead tfoot caption colgroup".split(), frozenset({"table"})),
}
FRAMES = frozenset("table tbody thead tfoot tr colgroup".split())
IN_TABLE = frozenset("script style template form".split())
LIMITS = frozenset("table td th caption html button object".split())


class Node:
    __slots__ = ("attrs", "kids", "met", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.kids = name, attrs, []
        self.met: tuple[int, int] | None = None  # the steps of selectors that end here, and those that end here or around; see Sheet


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for m in ATTRIBUTE.finditer(text):
            value = next((v for v in m.groups()[1:] if v is not None), "")
            out.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)
    return out


def parse(html: str) -> Node:
    """The element tree of a page."""
    root = Node("html", {})
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # of the open elements, by name

    def push(node: Node) -> None:
        places.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        """Closes all open elements from place i on."""
        while len(stack) > i:
            places[stack.pop().name].pop()

    def nearest(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names: Iterable[str], stop: Iterable[str]) -> bool:
        i = nearest(names)
        if not i or nearest(stop) > i:
            return False
        cut(i)
        return True

    def put(kid: Node | str) -> None:
        """Adds to the open element; before its table what no part of a table may hold."""
        if stack[-1].name in FRAMES and (not WHITE.fullmatch(kid) if isinstance(kid, str) else kid.name not in PARTS and kid.name not in IN_TABLE):
            if i := nearest(("table",)):
                stack[i - 1].kids.insert(len(stack[i - 1].kids) - 1, kid)  # an open element is the last child
                return
        stack[-1].kids.append(kid)

    def add_text(text: str) -> None:
        if text:
            put(entities.unescape(text) if "&" in text else text)

    while True:
        i = html.find("<", at)
        if i < 0:
            add_text(html[at:])
            return root
        after = html[i + 1 : i + 3]
        if after[:1] in ("!", "?") or (after[:1] == "/" and not after[1:].isalpha()):
            add_text(html[at:i])
            end = html.find("-->", i + 4) if html.startswith("<!--", i) else html.find(">", i)
            at = len(html) if end < 0 else end + (3 if html.startswith("<!--", i) else 1)
            continue
        letter = after.lstrip("/")[:1]
        if not (letter.isalpha() and letter.isascii()):
            add_text(html[at : i + 1])
            at = i + 1
            continue
        m = TAG.match(html, i) or PLAIN_TAG.match(html, i)
        add_text(html[at:i])
        if m is None:  # the text ends within a tag
            return root
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "br":
                put(Node("br", {}))
            elif name == "p" and not places.get("p"):
                put(Node("p", {}))
            elif name not in ("html", "body"):
                close({name}, {"table"} if name not in ("table", "caption") and name in IMPLIED else ({"td", "th"} if name not in ("tr", "tbody", "thead", "tfoot", "table") else frozenset()))
            continue
        if stack[-1].name == "head" and name not in HEAD_ONLY:
            cut(len(stack) - 1)
        if name in ("html", "body"):
            (root if name == "html" else stack[-1]).attrs.update({k: v for k, v in _attributes(m[3]).items() if k not in stack[-1].attrs})
            continue
        if name in IMPLIED:
            names, stop = IMPLIED[name]
            while close(names, stop):
                pass
        if name in ENDS_P:
            close({"p"}, LIMITS)
        if name[0] == "h" and len(name) == 2 and name[1].isdigit() and stack[-1].name[0] == "h" and stack[-1].name[1:].isdigit():
            cut(len(stack) - 1)
        framed = stack[-1].name in FRAMES or name in PARTS
        if framed and places.get("table"):
            if name in PARTS:
                while stack[-1].name not in PARTS[name]:
                    cut(len(stack) - 1)
                if name in ("td", "th") and stack[-1].name != "tr":
                    stack[-1].kids.append(Node("tr", {}))
                    push(stack[-1].kids[-1])
            elif name == "table":
                close({"table"}, frozenset())
            elif name == "form":
                continue
            elif stack[-1].name == "colgroup":
                cut(len(stack) - 1)
        node = Node(name, _attributes(m[3]))
        put(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            stop_at = end.start() if end else len(html)
            node.kids.append(entities.unescape(html[at:stop_at]) if name in ("title", "textarea") else html[at:stop_at])
            close_at = html.find(">", stop_at)
            at = len(html) if end is None or close_at < 0 else close_at + 1
            continue
        if not m[3].endswith("/") or not (name in ("svg", "math", "path") or places.get("svg") or places.get("math")):
            push(node)  # a slash does not end an element of the format, but one of a drawing or formula


class Sheet:
    """The rules of a page's style sheets on display and visibility.

    Selectors are matched from the outside in: an element keeps, as bits, the steps whose whole selector up to there
    ends at it, and those that end at it or around it. A step looks at its parent's bits only, so an element costs
    the steps that name its class, id or name, however deep it lies.
    """

    def __init__(self, root: Node):
        self.by: dict[tuple[str, str], list[tuple]] = {}
        self.inner: dict[tuple[str, str], list[tuple]] = {}  # steps before the last: (step, bit, bit of the one before)
        self.bits = 0
        self.order = 0
        for text in _sheets(root):
            self._read(re.sub(r"/\*.*?(?:\*/|$)", " ", text, flags=re.S))

    def _read(self, css: str) -> None:
        at = 0
        while (opened := css.find("{", at)) >= 0:
            closed = css.find("}", at)
            if 0 <= closed < opened:  # the end of a block around
                at = closed + 1
                continue
            head = css[at:opened].rpartition(";")[2].strip()
            if head.startswith("@"):
                word = head[1:].split(None, 1)[0].lower() if len(head) > 1 else ""
                if word in ("supports", "layer", "container") or (word == "media" and applies(head[6:])):
                    at = opened + 1
                else:
                    at = _after_block(css, opened)
                continue
            end = css.find("}", opened)
            body = css[opened : end if end >= 0 else len(css)]
            at = end + 1 if end >= 0 else len(css)
            said = _declared(body)
            if said:
                for selector in head.split(","):
                    self._add(selector.strip(), said)

    def _add(self, selector: str, said: dict[str, tuple[str, bool]]) -> None:
        steps: list[tuple] = []
        child = False
        for part in re.sub(r"\s*>\s*", " > ", selector).split():
            if part == ">":
                child = True
                continue
            m = COMPOUND.fullmatch(part)
            if not m:
                return
            tests = [(t[1] or "[", (t[2] or t[3]), t[4], next((v for v in t.groups()[4:] if v is not None), "")) for t in SIMPLE.finditer(m[2])]
            steps.append(((m[1] or "*").lower(), tests, child))
            child = False
        if not steps or child:
            return
        ids = sum(t[0] == "#" for _, tests, _ in steps for t in tests)
        classes = sum(t[0] != "#" for _, tests, _ in steps for t in tests)
        self.order += 1
        weight = (ids, classes, sum(name != "*" for name, _, _ in steps), self.order)
        before = 0
        for i, step in enumerate(steps):
            name, tests, _ = step
            key = next(((k, v) for kind in "#." for k, v, *_ in tests if k == kind), ("", name))
            if i == len(steps) - 1:
                self.by.setdefault(key, []).append((step, before, weight, said))
            else:
                bit = 1 << self.bits
                self.bits += 1
                self.inner.setdefault(key, []).append((step, bit, before))
                before = bit

    def met(self, path: list[Node]) -> tuple[int, int]:
        """The bits of the innermost element of a path, which are kept with each element."""
        i = len(path)
        while i and path[i - 1].met is None:
            i -= 1
        around = path[i - 1].met if i else (0, 0)
        for node in path[i:]:
            here = 0
            for key in _keys(node):
                for step, bit, before in self.inner.get(key, ()):
                    if _follows(step, before, around) and _fits(step, node):
                        here |= bit
            node.met = around = here, around[1] | here
        return around

    def of(self, node: Node, path: list[Node]) -> dict[str, str]:
        """The node's own display and visibility; path: the elements around it, outermost first."""
        best: dict[str, tuple] = {}
        attrs = node.attrs
        if self.by:
            around = self.met(path) if self.bits else (0, 0)
            for key in _keys(node):
                for step, before, weight, said in self.by.get(key, ()):
                    if _follows(step, before, around) and _fits(step, node):
                        for name, (value, important) in said.items():
                            best[name] = max(best.get(name, ((),)), ((important, 0, *weight), value))
        if style := attrs.get("style", ""):
            for name, (value, important) in _declared(style).items():
                best[name] = max(best.get(name, ((),)), ((important, 1), value))
        return {name: value for name, (_, value) in best.items()}


def applies(query: str) -> bool:
    """Whether a media query holds for a screen of SCREEN pixels."""
    for part in query.lower().split(","):
        rest = WIDTH.sub("", part)
        words = set(re.findall(r"[a-z-]+", rest))
        if words <= {"all", "screen", "only", "and"} and "(" not in rest:
            if all(float(n) <= SCREEN if kind == "min" else float(n) >= SCREEN for kind, n in WIDTH.findall(part)):
                return True
    return False


def _after_block(css: str, opened: int) -> int:
    depth = 0
    for m in re.compile("[{}]").finditer(css, opened):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(css)


def _declared(body: str) -> dict[str, tuple[str, bool]]:
    """Property to (value, whether important); the last one counts, an important one before others."""
    out: dict[str, tuple[str, bool]] = {}
    if "isplay" in body or "isibility" in body or "ISPLAY" in body or "ISIBILITY" in body:
        for name, value, important in DECLARATION.findall(body):
            if important or not out.get(name.lower(), ("", False))[1]:
                out[name.lower()] = (value.lower(), bool(important))
    return out


def _fits(step: tuple, node: Node) -> bool:
    name, tests, _ = step
    if name not in ("*", node.name):
        return False
    for kind, key, op, value in tests:
        if kind == "#":
            ok = node.attrs.get("id") == key
        elif kind == ".":
            ok = key in node.attrs.get("class", "").split()
        else:
            have = node.attrs.get(key.lower())
            ok = have is not None and {
                None: lambda: True,
                "=": lambda: have == value,
                "~=": lambda: value in have.split(),
                "|=": lambda: have == value or have.startswith(value + "-"),
                "^=": lambda: bool(value) and have.startswith(value),
                "$=": lambda: bool(value) and have.endswith(value),
                "*=": lambda: bool(value) and value in have,
            }[op]()
        if not ok:
            return False
    return True


def _keys(node: Node) -> list[tuple[str, str]]:
    keys = [("", node.name), ("", "*")]
    if node.attrs:
        keys += [(".", c) for c in dict.fromkeys(node.attrs.get("class", "").split())] + [("#", node.attrs.get("id", ""))]
    return keys


def _follows(step: tuple, before: int, around: tuple[int, int]) -> bool:
    """Whether the step before is met by the parent, for a child, or by any element around."""
    return not before or bool(around[0 if step[2] else 1] & before)


def _sheets(root: Node) -> Iterator[str]:
    left = [root]
    while left:
        node = left.pop()
        if node.name == "style":
            if applies(node.attrs.get("media") or "all"):
                yield "".join(k for k in node.kids if isinstance(k, str))
        else:
            left += [k for k in reversed(node.kids) if isinstance(k, Node)]


class _Lines:
    """Text as it is laid out: pending breaks become line ends only before more text."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks, self.space, self.prefix, self.indent = 0, False, "", ""

    def block(self, blank: bool) -> None:
        self.breaks = max(self.breaks, 2 if blank else 1)
        self.space = False

    def line(self) -> None:
        self.breaks += 1
        self.space = False

    def _start(self) -> None:
        if self.breaks and self.out:
            self.out.append("\n" * self.breaks)
        if self.breaks or not self.out:
            self.out.append(self.prefix if self.prefix else self.indent)
            self.prefix = ""
        self.breaks = 0

    def text(self, text: str) -> None:
        said = WHITE.sub(" ", text)
        if said == " ":
            self.space = True
            return
        if not said:
            return
        lead = self.space or said[0] == " "
        body = said.strip(" ")
        fresh = self.breaks or not self.out or bool(self.prefix)
        self._start() if self.breaks or not self.out else None
        if self.prefix:
            self.out.append(self.prefix)
            self.prefix = ""
        self.out.append(" " + body if lead and not fresh else body)
        self.space = said[-1] == " "

    def raw(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.line()
            if line:
                self._start() if self.breaks or not self.out else None
                self.out.append(line)

    def done(self) -> str:
        return "\n".join(x.rstrip() for x in "".join(self.out).split("\n")).strip("\n")


def _number(attrs: dict[str, str], name: str, default: int) -> int:
    return int(attrs[name]) if re.fullmatch(r"-?\d{1,6}", attrs.get(name, "").strip()) else default


BLOCKS = frozenset("block flex grid list-item table flow-root".split())
INLINES = frozenset("inline inline-block inline-flex inline-grid contents".split())
# The widest spans of the format.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Renderer:
    """Lays out a tree. Its steps are generators that yield the steps below them, run on one explicit stack."""

    def __init__(self, root: Node):
        self.sheet, self.path = Sheet(root), []

    def run(self, step: Generator) -> None:
        stack = [step]
        while stack:
            below = next(stack[-1], None)
            if below is None:
                stack.pop()
            else:
                stack.append(below)

    def look(self, node: Node, shown: bool) -> tuple[bool, bool, str]:
        """(whether it is there, whether its own text shows, its display)."""
        if node.name in UNSEEN:
            return False, False, "none"
        attrs = node.attrs
        if not attrs and not self.sheet.by:
            return node.name != "dialog", shown, ""
        said = self.sheet.of(node, self.path)
        display, visibility = said.get("display", ""), said.get("visibility", "")
        if visibility in ("hidden", "collapse"):
            shown = False
        elif visibility == "visible":
            shown = True
        if node.name == "input" and attrs.get("type", "").lower() == "hidden":
            return False, shown, "none"
        if not display and ("hidden" in attrs or (node.name == "dialog" and "open" not in attrs)):
            display = "none"
        return display != "none", shown, display

    def table(self, node: Node, lines: _Lines, shown: bool) -> Generator:
        """Cells on a grid, in aligned columns; a cell of several lines takes as many lines of its row."""
        rows: list[dict[int, list[str]]] = []
        taken: dict[int, int] = {}  # columns that cells of rows above still span

        def group(kids: list, shown: bool) -> Generator:
            for kid in kids:
                if not isinstance(kid, Node) or kid.name not in ("tr", "thead", "tbody", "tfoot"):
                    continue
                there, seen, _ = self.look(kid, shown)
                if not there:
                    continue
                self.path.append(kid)
                if kid.name == "tr":
                    yield row(kid, seen)
                else:
                    taken.clear()
                    yield group(kid.kids, seen)
                    taken.clear()
                self.path.pop()

        def row(node: Node, shown: bool) -> Generator:
            cells: dict[int, list[str]] = {}
            new: dict[int, int] = {}
            column = 0
            for kid in node.kids:
                if not isinstance(kid, Node) or kid.name not in ("td", "th"):
                    continue
                there, seen, _ = self.look(kid, shown)
                if not there:
                    continue
                while taken.get(column):
                    column += 1
                inner = _Lines()
                self.path.append(kid)
                yield self.walk(kid.kids, inner, False, seen)
                self.path.pop()
                cells[column] = inner.done().split("\n")
                wide = min(max(_number(kid.attrs, "colspan", 1), 1), MOST_COLUMNS)
                high = _number(kid.attrs, "rowspan", 1)
                high = MOST_ROWS if high == 0 or high > MOST_ROWS else max(high, 1)
                if high > 1:
                    new.update((column + i, high) for i in range(wide))
                column += wide
            for c in list(taken):
                taken[c] -= 1
                if not taken[c]:
                    del taken[c]
            taken.update((c, n - 1) for c, n in new.items())
            rows.append(cells)

        yield group(node.kids, shown)
        wide: dict[int, int] = {}
        for cells in rows:
            for c, said in cells.items():
                wide[c] = max(wide.get(c, 0), max(map(len, said)))
        order = sorted(wide)
        for kid in node.kids:  # what stands in a table but in no row keeps its place before it
            if isinstance(kid, str) or kid.name not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
                yield self.walk([kid], lines, False, shown)
                lines.block(False)
        for cells in rows:
            columns = order[: bisect_right(order, max(cells, default=-1))]
            for i in range(max(map(len, cells.values()), default=0)):
                said = "  ".join((cells[c][i] if c in cells and i < len(cells[c]) else "").ljust(wide[c]) for c in columns).rstrip()
                lines.block(False)
                if said:
                    lines.raw(said)

    def walk(self, kids: list, lines: _Lines, pre: bool, shown: bool) -> Generator:
        for kid in kids:
            if isinstance(kid, str):
                if shown:
                    lines.raw(kid) if pre else lines.text(kid)
                continue
            name = kid.name
            there, seen, display = self.look(kid, shown)
            if not there:
                continue
            if name == "br":
                lines.line()
                continue
            if name == "img":
                if seen and (alt := kid.attrs.get("alt", "")):
                    lines.text(alt)
                continue
            if name == "input":
                if seen and kid.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset") and kid.attrs.get("value"):
                    lines.text(kid.attrs["value"])
                continue
            block = (name in BLOCK or display in BLOCKS) and display not in INLINES
            spaced = block and name in SPACED
            if block:
                lines.block(spaced and not (name in ("ul", "ol") and lines.indent))
            self.path.append(kid)
            if name == "table":
                yield self.table(kid, lines, seen)
            elif name == "svg":
                yield self.drawing(kid.kids, lines, seen)
            elif name in ("ul", "ol", "menu", "dir"):
                yield self.items(kid, lines, pre, seen)
            elif name in ("blockquote", "dd"):
                outer = lines.indent
                lines.indent = outer + "  "
                yield self.walk(kid.kids, lines, pre, seen)
                lines.indent = outer
            else:
                body = kid.kids
                if name == "pre" and body and isinstance(body[0], str) and body[0].startswith("\n"):
                    body = [body[0][1:], *body[1:]]
                if name == "details" and "open" not in kid.attrs:
                    body = [k for k in body if isinstance(k, Node) and k.name == "summary"][:1]
                if body:
                    yield self.walk(body, lines, pre or name in ("pre", "textarea", "xmp", "listing"), seen)
            self.path.pop()
            if block:
                lines.block(spaced and not (name in ("ul", "ol") and lines.indent))

    def drawing(self, kids: list, lines: _Lines, shown: bool) -> Generator:
        """What a drawing says: its text elements, each a block, and the pages in it."""
        for kid in kids:
            if isinstance(kid, str) or kid.name in DRAWN_UNSEEN:
                continue
            there, seen, _ = self.look(kid, shown)
            if not there:
                continue
            self.path.append(kid)
            if kid.name in ("text", "foreignobject"):
                lines.block(False)
                yield self.walk(kid.kids, lines, False, seen)
                lines.block(False)
            else:
                yield self.drawing(kid.kids, lines, seen)
            self.path.pop()

    def items(self, node: Node, lines: _Lines, pre: bool, shown: bool) -> Generator:
        outer, n = lines.indent, _number(node.attrs, "start", 1)
        for item in node.kids:
            there, seen, _ = self.look(item, shown) if isinstance(item, Node) and item.name == "li" else (False, shown, "")
            if there:
                n = _number(item.attrs, "value", n)
                mark = f"{n}. " if node.name == "ol" else "- "
                lines.block(False)
                lines.prefix, lines.indent = outer + mark, outer + " " * len(mark)
                self.path.append(item)
                yield self.walk(item.kids, lines, pre, seen)
                self.path.pop()
                lines.prefix, lines.indent = "", outer
                n += 1
            else:
                yield self.walk([item], lines, pre, shown)


def render(html: str | None) -> str:
    """All visible text of a page, laid out."""
    if not html:
        return ""
    lines = _Lines()
    root = parse(html.replace("\r\n", "\n").replace("\r", "\n"))
    renderer = _Renderer(root)
    there, seen, _ = renderer.look(root, True)
    if there:
        renderer.path.append(root)
        renderer.run(renderer.walk(root.kids, lines, False, seen))
    return lines.done()


def rendered(html: Column) -> Column:
    """Column of visible texts."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([render(h) for h in batch], dtype=object)

    return run(text_of(html))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``visible_text``, which replaces a column of that name."""
    enable_workers(pages.sparkSession)
    return pages.withColumn("visible_text", rendered(F.col(html)))


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every page's visible text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    text = F.col("visible_text")
    return extract(pages).select("page_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
