"""Documents with a YAML head: the metadata, the body and each top-level key's line.

Heads are small, and each is read by itself where its file lies. What is read: block and flow
collections, plain, quoted, literal and folded scalars over any number of lines, comments, anchors,
aliases, merge keys and the standard tags, with the resolution of YAML 1.1. A head that the language
calls an error is a HeadError, and so are tags of one's own, keys that are collections (``?``) and a
node that holds itself.
"""

from __future__ import annotations

import datetime
import re


class HeadError(ValueError):
    """A head that cannot be read."""


# The forms that YAML 1.1 gives plain scalars.
WORDS = {w: v for v, ws in [(None, ["", "~", "null", "Null", "NULL"]), (True, "true True TRUE yes Yes YES on On ON".split()), (False, "false False FALSE no No NO off Off OFF".split())] for w in ws}
INT = re.compile(r"[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]+|0|[1-9][0-9_]*)$")
SIXTY = re.compile(r"[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+(\.[0-9_]*)?$")
REAL = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.(?:inf|Inf|INF))$|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?$|\.(?:nan|NaN|NAN)$")
DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)$")
TIME = re.compile(r"(\d{4})-(\d\d?)-(\d\d?)(?:[Tt]|[ \t]+)(\d\d?):(\d\d):(\d\d)(?:\.(\d*))?(?:[ \t]*(Z|([-+])(\d\d?)(?::?(\d\d))?))?$")
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
HEX = {"x": 2, "u": 4, "U": 8}

KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|((?:[^\s"'\[\]{}#&*!|>%@`,?:-]|[-?:](?=\S))(?:[^:#]|:(?=\S)|(?<!\s)#)*?)|\*(\S+))\s*:(?:\s+|$)""")
PROPERTY = re.compile(r"(?:&([^\s,\[\]{}]+)|(!<[^>]*>|![^\s,\[\]{}]*))(?:\s+|$|(?=[,\]}]))")


def _plain(text: str) -> object:
    """The value of a plain scalar."""
    if text in WORDS:
        return WORDS[text]
    bare = text.replace("_", "")
    if INT.match(text):
        digits = bare.lstrip("+-")
        base = 2 if digits[:2] == "0b" else 16 if digits[:2] == "0x" else 8 if digits[:1] == "0" else 10
        try:
            return int(digits, base) * (-1 if bare[0] == "-" else 1)
        except ValueError as e:
            raise HeadError(str(e)) from None
    if (m := SIXTY.match(text)) and (m[1] is not None or text.lstrip("+-")[0] != "0"):
        total = 0
        for part in bare.lstrip("+-").split(":"):
            total = total * 60 + (float(part) if m[1] is not None else int(part))
        return -total if bare[0] == "-" else total
    if REAL.match(text):
        return float(bare.replace(".", "") if bare.lower().endswith(("inf", "nan")) else bare)
    try:
        if m := DATE.match(text):
            return datetime.date(*map(int, m.groups()))
        if m := TIME.match(text):
            zone = None
            if m[8]:
                shift = datetime.timedelta(hours=int(m[10] or 0), minutes=int(m[11] or 0))
                zone = datetime.timezone(-shift if m[9] == "-" else shift)
            return datetime.datetime(*map(int, m.groups()[:6]), int((m[7] or "")[:6].ljust(6, "0")), tzinfo=zone)
    except ValueError as e:
        raise HeadError(str(e)) from None
    return text


class _Unclosed(HeadError):
    """More lines may close it."""


def _quoted(text: str) -> tuple[str, str]:
    """A quoted scalar and the text behind it."""
    quote, i, out = text[0], 1, []
    while i < len(text):
        c = text[i]
        if c == quote == "'" and text[i : i + 2] == "''":
            out.append("'")
            i += 2
        elif c == quote:
            return "".join(out), text[i + 1 :]
        elif c == "\\" and quote == '"':
            e = text[i + 1 : i + 2]
            wide = HEX.get(e, 0)
            if wide and re.fullmatch(r"[0-9a-fA-F]+", text[i + 2 : i + 2 + wide] or "-"):
                out.append(chr(int(text[i + 2 : i + 2 + wide], 16)))
            elif e in ESCAPES:
                out.append(ESCAPES[e])
            elif e:
                raise HeadError(f"unknown escape {e!r}")
            i += 2 + wide
        else:
            out.append(c)
            i += 1
    raise _Unclosed("unclosed quote")


class _Head:
    """One head, read line by line; anchors hold the nodes named so far."""

    def __init__(self, text: str):
        self.rows: list[tuple[int, str, int]] = []
        self.raw = text.split("\n")
        self.anchors: dict[str, object] = {}
        for n, line in enumerate(self.raw):
            inner = line.lstrip(" ")
            if inner.strip() and not inner.lstrip().startswith("#"):
                self.rows.append((len(line) - len(inner), inner.rstrip(), n))
        self.at = 0

    # properties

    def properties(self, text: str) -> tuple[str | None, str | None, str]:
        """The anchor and the tag in front of a node, and the rest."""
        anchor = tag = None
        while m := PROPERTY.match(text):
            if (anchor if m[1] else tag) is not None:
                raise HeadError(f"two anchors or tags: {text!r}")
            anchor, tag, text = m[1] or anchor, m[2] or tag, text[m.end() :]
        return anchor, tag, text

    def settle(self, anchor: str | None, tag: str | None, value: object, text: str | None) -> object:
        """A node under its tag, kept under its anchor. text: a scalar as it is written."""
        if tag:
            value = self.tagged(tag, value, "" if value is None and text is None else text)
        if anchor:
            if anchor in self.anchors:
                raise HeadError(f"the anchor {anchor!r} is there already")
            self.anchors[anchor] = value
        return value

    def tagged(self, tag: str, value: object, text: str | None) -> object:
        name = tag.removeprefix("!<tag:yaml.org,2002:").removesuffix(">") if tag.startswith("!<") else tag[2:] if tag.startswith("!!") else None
        if tag == "!":
            return value if text is None else text
        if name in ("map", "seq", "set") and isinstance(value, list if name == "seq" else dict):
            return set(value) if name == "set" else value
        if text is not None and name == "str":
            return text
        if text is not None and name == "null":
            return None
        plain = _plain(text) if text is not None and name in ("int", "float", "bool", "timestamp") else None
        kinds = {"int": (int,), "float": (int, float), "bool": (bool,), "timestamp": (datetime.date,)}.get(name, ())
        if isinstance(plain, kinds) and isinstance(plain, bool) == (name == "bool"):
            return float(plain) if name == "float" else plain
        raise HeadError(f"a value that {tag} does not fit")

    def alias(self, name: str) -> object:
        if name not in self.anchors:
            raise HeadError(f"no anchor {name!r}")
        return self.anchors[name]

    def merge(self, pairs: list[tuple[object, object, bool]]) -> dict:
        """A mapping of its pairs; those merged in stand back behind its own, and behind mappings merged before."""
        own, merged = {}, {}
        for key, value, merges in pairs:
            if merges:
                many = value if isinstance(value, list) else [value]
                if not all(isinstance(m, dict) for m in many):
                    raise HeadError("only mappings can be merged in")
                for m in reversed(many):
                    merged |= m
            else:
                try:
                    own[key] = value
                except TypeError:
                    raise HeadError("a collection is no key") from None
        return merged | own

    # flow

    def flow(self, text: str) -> tuple[object, str]:
        """A flow list or mapping and the text behind it."""
        closer, rest = {"[": "]", "{": "}"}[text[0]], text[1:].lstrip()
        items: list = []
        pairs: list = []
        while rest and rest[0] != closer:
            key, value, rest, bare = self.flow_node(rest)
            pair = rest[:1] == ":" and (rest[1:2] in " ,]}" or rest[1:2] == "" or not bare)
            if pair:
                merges = bare and key == "<<"
                rest = rest[1:].lstrip()
                key, value = value, None
                if rest and rest[0] not in ",]}":
                    _, value, rest, _ = self.flow_node(rest)
            if closer == "}":
                pairs.append((key, value, merges) if pair else (value, None, False))
            else:
                items.append(self.merge([(key, value, merges)]) if pair else value)
            if rest[:1] == ",":
                rest = rest[1:].lstrip()
            elif rest and rest[0] != closer:
                raise HeadError(f"unexpected text in a list: {rest!r}")
        if not rest:
            raise _Unclosed("unclosed list")
        return (self.merge(pairs) if closer == "}" else items), rest[1:]

    def flow_node(self, rest: str) -> tuple[str | None, object, str, bool]:
        """(text of a plain scalar, value, the rest, whether it is plain)."""
        anchor, tag, rest = self.properties(rest)
        text, bare = None, False
        if rest[:1] in ("[", "{"):
            value, rest = self.flow(rest)
        elif rest[:1] in ('"', "'"):
            value, rest = _quoted(rest)
            text = value
        elif m := re.match(r"\*([^\s,\[\]{}]+)", rest):
            value, rest = self.alias(m[1]), rest[m.end() :]
        else:
            m = re.match(r"(?:[^,\[\]{}:#]|:(?![\s,\[\]{}]|$)|(?<!\s)#)*", rest)
            text, rest, bare = m[0].strip(), rest[m.end() :], True
            if text[:1] and (text[0] in "%@`|>#" or text == "-"):
                raise HeadError(f"unsupported value {text!r}")
            value = _plain(text)
            if not text and not anchor and not tag and rest[:1] != ":":
                raise HeadError("an empty place in a list")
        return text if bare else None, self.settle(anchor, tag, value, text), rest.lstrip(), bare

    # blocks

    def dash(self, depth: int) -> bool:
        ahead = self.rows[self.at] if self.at < len(self.rows) else (-1, "", 0)
        return ahead[0] == depth and (ahead[1] == "-" or ahead[1].startswith("- "))

    def value(self, indent: int) -> object:
        """The block that begins at the next row, if that is indented so far."""
        if self.at >= len(self.rows) or self.rows[self.at][0] < indent:
            return None
        depth, text, n = self.rows[self.at]
        if text[0] == "\t":
            raise HeadError("a tab is not allowed as indent")
        if self.dash(depth):
            return self.sequence(depth)
        anchor, tag, rest = self.properties(text)
        if KEY.match(rest):
            return self.mapping(depth)
        self.at += 1
        if not rest or rest.startswith("#"):
            return self.settle(anchor, tag, self.value(indent), None)
        return self.settle(anchor, tag, *self.inline(rest, depth - 1, n))

    def sequence(self, depth: int) -> list:
        out = []
        while self.dash(depth):
            _, text, n = self.rows[self.at]
            rest = text[1:].lstrip()
            if KEY.match(self.properties(rest)[2]) or rest == "-" or rest.startswith("- "):
                self.rows[self.at] = (depth + len(text) - len(rest), rest, n)
                out.append(self.value(depth + 1))
            else:
                self.at += 1
                out.append(self.after(rest, depth, n, False))
        if self.at < len(self.rows) and self.rows[self.at][0] > depth:
            raise HeadError(f"unexpected indent: {self.rows[self.at][1]!r}")
        return out

    def mapping(self, depth: int) -> dict:
        pairs = []
        while self.at < len(self.rows) and self.rows[self.at][0] == depth:
            _, text, n = self.rows[self.at]
            anchor, tag, text = self.properties(text)
            m = KEY.match(text)
            if not m:
                raise HeadError(f"expected a key: {text!r}")
            if m[4] is not None:
                key = self.alias(m[4])
            else:
                written = _quoted(text)[0] if m[3] is None else m[3]
                key = self.settle(anchor, tag, written if m[3] is None else _plain(written), written)
            self.at += 1
            pairs.append((key, self.after(text[m.end() :].strip(), depth, n, True), m[3] == "<<" and not tag))
        if self.at < len(self.rows) and self.rows[self.at][0] > depth:
            raise HeadError(f"unexpected indent: {self.rows[self.at][1]!r}")
        return self.merge(pairs)

    def after(self, rest: str, depth: int, n: int, keyed: bool) -> object:
        """The node behind a key or a dash: on the same line, or the block below."""
        anchor, tag, rest = self.properties(rest)
        if rest and not rest.startswith("#"):
            return self.settle(anchor, tag, *self.inline(rest, depth, n))
        below = self.sequence(depth) if keyed and self.dash(depth) else self.value(depth + 1)
        return self.settle(anchor, tag, below, None)

    def skip(self, end: int) -> None:
        while self.at < len(self.rows) and self.rows[self.at][2] < end:
            self.at += 1

    def inline(self, rest: str, depth: int, n: int) -> tuple[object, str | None]:
        """The node that begins with rest on line n, and its text if it is a scalar."""
        if m := re.match(r"([|>])(?:([1-9])?([+-])?|([+-])([1-9]))\s*(?:\s#.*)?$", rest):
            text = self.block(m[1], int(m[2] or m[5] or 0), m[3] or m[4], depth, n)
            return text, text
        if rest[0] in "|>%@`":
            raise HeadError(f"unsupported value {rest!r}")
        if m := re.match(r"\*(\S+)\s*(?:\s#.*)?$", rest):
            return self.alias(m[1]), None
        if rest[0] in "\"'[{":
            return self.closed(rest, n)
        if rest[0] in "*&!" or re.match(r"[-?:](?:\s|$)", rest):
            raise HeadError(f"unsupported value {rest!r}")
        text, cut, last = "", False, n
        while True:
            part = re.split(r"(?:^|\s)#", rest, maxsplit=1)
            text, cut = text + part[0].strip(), len(part) > 1
            ahead = self.rows[self.at] if self.at < len(self.rows) else (-1, "", 0)
            if cut or ahead[0] <= depth or any(x.strip().startswith("#") for x in self.raw[last + 1 : ahead[2]]):
                break
            text += "\n" * (ahead[2] - last - 1) or " "  # a plain scalar goes on; blank lines are its line ends
            rest, last = ahead[1].strip(), ahead[2]
            self.at += 1
        if re.search(r":(?:\s|$)", text):
            raise HeadError(f"a mapping is not allowed here: {text!r}")
        return _plain(text), text

    def closed(self, rest: str, n: int) -> tuple[object, str | None]:
        """A quoted scalar or a flow collection, over as many lines as it takes."""
        quoted, end, blank = rest[0] in "\"'", n + 1, 0
        known = dict(self.anchors)
        while True:
            try:
                value, behind = _quoted(rest) if quoted else self.flow(rest)
                break
            except _Unclosed:
                self.anchors = dict(known)
                line = self.raw[end].strip() if end < len(self.raw) else None
                if line is None:
                    raise
                end += 1
                if not line or not quoted and line.startswith("#"):
                    blank += 1
                    continue
                joined = rest.rstrip()
                if quoted and rest[0] == '"' and (len(joined) - len(joined.rstrip("\\"))) % 2:
                    rest = joined[:-1] + "\n" * blank + line
                else:
                    rest = joined + ("\n" * blank if quoted and blank else " ") + line
                blank = 0
        if behind.strip() and not re.match(r"\s+#", behind):
            raise HeadError(f"unexpected text after a value: {behind.strip()!r}")
        self.skip(end)
        return value, value if quoted else None

    def block(self, style: str, indent: int, chomp: str | None, depth: int, n: int) -> str:
        """A literal or folded scalar."""
        end = n + 1
        while end < len(self.raw) and (not self.raw[end].strip() or len(self.raw[end]) - len(self.raw[end].lstrip(" ")) > depth):
            end += 1
        rows = self.raw[n + 1 : end]
        cut = max(depth, 0) + indent if indent else next((len(x) - len(x.lstrip(" ")) for x in rows if x.strip()), 0)
        for i, x in enumerate(rows):
            if x.strip() and len(x) - len(x.lstrip(" ")) < cut:
                raise HeadError(f"unexpected indent: {x.strip()!r}")
            rows[i] = x[cut:]
        self.skip(end)
        kept = len(rows)
        while kept and not rows[kept - 1].strip(" "):
            kept -= 1
        body, after = rows[:kept], len(rows) - kept
        if style == "|":
            text = "\n".join(body)
        else:
            text, blank = "", 0
            for i, x in enumerate(body):
                if not x:
                    blank += 1
                    continue
                before = next((b for b in reversed(body[:i]) if b), None)
                if before is None:
                    text += "\n" * blank
                elif before[0] in " \t" or x[0] in " \t":
                    text += "\n" * (blank + 1)
                else:
                    text += "\n" * blank or " "
                text, blank = text + x, 0
        if chomp == "-":
            return text
        ends = len(rows) - kept > 0 or end < len(self.raw)  # the last line of a head has no line end
        return text + ("\n" if body and ends else "") + ("\n" * (after - (end == len(self.raw))) if chomp == "+" else "")


def load_yaml(text: str) -> object:
    head = _Head(text)
    out = head.value(0)
    if head.at < len(head.rows):
        raise HeadError(f"unexpected {head.rows[head.at][1]!r}")
    return out


def parse_frontmatter(text: str) -> tuple[dict, str, dict[str, int]]:
    """(metadata, body, key lines). Without a head all is body; a head that is no mapping gives none."""
    rows = text.splitlines(keepends=True)
    if not rows or rows[0].strip() != "---":
        return {}, text, {}
    end = next((i for i, row in enumerate(rows[1:], 1) if row.strip() == "---"), None)
    if end is None:
        return {}, text, {}
    head = [row.rstrip("\r\n") for row in rows[1:end]]
    metadata = load_yaml("\n".join(head))
    if not isinstance(metadata, dict):
        metadata = {}
    places: dict[str, int] = {}
    for i, row in enumerate(head, 2):
        if (m := KEY.match(row)) and row[:1] not in " -#":
            places.setdefault(next(g for g in m.groups() if g is not None), i)
    return metadata, "".join(rows[end + 1 :]), {k: n for k, n in places.items() if k in metadata}
