"""Tokens and a recursive-descent parser of the SPARQL 1.1 query language to algebra nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..terms import RDF, XSD, literal_code


class QueryError(ValueError):
    """A query that cannot be parsed or analysed. Raised before any row is made."""


TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  |(?P<var>[?$]\w+)
  |(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)|\d*\.\d+|\d+)
  |(?P<pname>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\\[_~.!$&'()*+,;=/?#@%-])(?:(?:[\w:%.-]|\\[_~.!$&'()*+,;=/?#@%-])*(?:[\w:%-]|\\[_~.!$&'()*+,;=/?#@%-]))?)?)
  |(?P<word>[A-Za-z_]\w*)
  |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*/|^+?!=<>-])""",
    re.X | re.S,
)
ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
SIMPLE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else SIMPLE.get(m[1], m[1]), text)


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    code: str


@dataclass(frozen=True)
class Path:
    kind: str  # iri, inverse, seq, alt, star, plus, opt, not
    parts: tuple = ()
    iri: str = ""


@dataclass(frozen=True)
class Pattern:
    s: object
    p: object
    o: object


@dataclass
class Expr:
    op: str
    args: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)


@dataclass
class Group:
    """A group graph pattern: elements in order."""

    parts: list = field(default_factory=list)  # (kind, ...) tuples


@dataclass
class Select:
    where: Group
    items: list = field(default_factory=list)  # (name, Expr or None); empty: *
    distinct: bool = False
    group_by: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    values: tuple | None = None
    form: str = "select"


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str]):
        self.prefixes, self.base, self.at, self.fresh = dict(prefixes), "", 0, 0
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected text at {text[at : at + 20]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def is_word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def op(self, *ops: str) -> str:
        kind, text = self.peek()
        if kind == "op" and text in ops:
            self.at += 1
            return text
        return ""

    def need(self, op: str) -> None:
        if not self.op(op):
            raise QueryError(f"expected {op!r}, found {self.peek()[1]!r}")

    def parse(self) -> Select:
        while True:
            if self.word("PREFIX"):
                kind, name = self.next()
                if kind != "pname" or not name.endswith(":") or self.peek()[0] != "iri":
                    raise QueryError("malformed PREFIX")
                self.prefixes[name[:-1]] = self.iri(self.next()[1])
            elif self.word("BASE"):
                self.base = self.next()[1][1:-1]
            else:
                break
        if self.is_word("SELECT"):
            out = self.select()
        elif self.word("ASK"):
            self.word("WHERE")
            out = Select(self.group(), form="ask")
        else:
            raise QueryError(f"only SELECT and ASK are supported, found {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return out

    def iri(self, text: str) -> str:
        value = unescape(text[1:-1])
        return value if re.match(r"[A-Za-z][\w+.-]*:", value) or not self.base else self.base + value

    def pname(self, text: str) -> str:
        prefix, local = text.split(":", 1)
        if prefix not in self.prefixes:
            raise QueryError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def select(self) -> Select:
        self.word("SELECT")
        out = Select(Group(), distinct=self.word("DISTINCT"))
        self.word("REDUCED")
        if not self.op("*"):
            while True:
                if self.peek()[0] == "var":
                    out.items.append((self.next()[1][1:], None))
                elif self.op("("):
                    e = self.expr()
                    if not self.word("AS"):
                        raise QueryError("expected AS")
                    out.items.append((self.variable(), e))
                    self.need(")")
                else:
                    break
            if not out.items:
                raise QueryError("SELECT needs variables or *")
        self.word("WHERE")
        out.where = self.group()
        if self.word("GROUP"):
            self.by()
            while True:
                if self.peek()[0] == "var":
                    out.group_by.append((self.peek()[1][1:], Expr("var", [self.next()[1][1:]])))
                elif self.op("("):
                    e, name = self.expr(), None
                    if self.word("AS"):
                        name = self.variable()
                    self.need(")")
                    out.group_by.append((name or self.new(), e))
                elif self.peek()[0] == "word" and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    out.group_by.append((self.new(), self.primary()))
                else:
                    break
        if self.word("HAVING"):
            while self.peek()[1] == "(" or (self.peek()[0] == "word" and not self.is_word("ORDER", "LIMIT", "OFFSET", "VALUES")):
                out.having.append(self.primary())
        if self.word("ORDER"):
            self.by()
            while True:
                if self.is_word("ASC", "DESC"):
                    down = self.next()[1].upper() == "DESC"
                    self.need("(")
                    out.order_by.append((self.expr(), down))
                    self.need(")")
                elif self.peek()[0] == "var" or self.peek()[1] == "(" or (self.peek()[0] == "word" and not self.is_word("LIMIT", "OFFSET", "VALUES")):
                    out.order_by.append((self.primary(), False))
                else:
                    break
        while self.is_word("LIMIT", "OFFSET"):
            name = self.next()[1].upper()
            kind, n = self.next()
            if kind != "num" or not n.isdigit():
                raise QueryError(f"{name} needs a number")
            if name == "LIMIT":
                out.limit = int(n)
            else:
                out.offset = int(n)
        if self.word("VALUES"):
            out.values = self.values()
        return out

    def by(self) -> None:
        if not self.word("BY"):
            raise QueryError("expected BY")

    def variable(self) -> str:
        kind, text = self.next()
        if kind != "var":
            raise QueryError(f"expected a variable, found {text!r}")
        return text[1:]

    def new(self) -> str:
        self.fresh += 1
        return f".{self.fresh}"

    def group(self) -> Group:
        self.need("{")
        out = Group()
        if self.is_word("SELECT"):
            out.parts.append(("select", self.select()))
            self.need("}")
            return out
        while not self.op("}"):
            if self.word("OPTIONAL"):
                out.parts.append(("optional", self.group()))
            elif self.word("MINUS"):
                out.parts.append(("minus", self.group()))
            elif self.word("FILTER"):
                out.parts.append(("filter", self.primary()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expr()
                if not self.word("AS"):
                    raise QueryError("expected AS")
                out.parts.append(("bind", self.variable(), e))
                self.need(")")
            elif self.word("VALUES"):
                out.parts.append(("values", *self.values()))
            elif self.word("GRAPH", "SERVICE"):
                raise QueryError("named graphs and services are not supported")
            elif self.peek()[1] == "{":
                branches = [self.group()]
                while self.word("UNION"):
                    branches.append(self.group())
                out.parts.append(("union", branches) if len(branches) > 1 else ("group", branches[0]))
            elif self.peek()[0] == "end":
                raise QueryError("unclosed group")
            else:
                out.parts += [("triple", t) for t in self.triples()]
            self.op(".")
        return out

    def values(self) -> tuple[list[str], list[list[str | None]]]:
        names, rows = [], []
        if self.peek()[0] == "var":
            names = [self.variable()]
            self.need("{")
            while not self.op("}"):
                rows.append([self.data()])
        else:
            self.need("(")
            while not self.op(")"):
                names.append(self.variable())
            self.need("{")
            while not self.op("}"):
                self.need("(")
                row = []
                while not self.op(")"):
                    row.append(self.data())
                if len(row) != len(names):
                    raise QueryError("VALUES row of the wrong length")
                rows.append(row)
        return names, rows

    def data(self) -> str | None:
        if self.word("UNDEF"):
            return None
        term = self.term()
        if not isinstance(term, Const):
            raise QueryError("VALUES needs constants")
        return term.code

    def term(self) -> object:
        kind, text = self.next()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            return Const(self.iri(text))
        if kind == "pname":
            return Const(self.pname(text))
        if kind == "string":
            n = 3 if text[:3] in ('"""', "'''") else 1
            value = unescape(text[n:-n])
            if self.peek()[0] == "lang":
                return Const(literal_code(value, lang=self.next()[1][1:].lower()))
            if self.op("^^"):
                kind, text = self.next()
                return Const(literal_code(value, self.iri(text) if kind == "iri" else self.pname(text)))
            return Const(literal_code(value))
        sign = ""
        if kind == "op" and text in "+-" and self.peek()[0] == "num":
            sign = "-" if text == "-" else ""
            kind, text = self.next()
        if kind == "num":
            dt = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return Const(literal_code(sign + text, XSD + dt))
        if kind == "word" and text in ("true", "false"):
            return Const(literal_code(text, XSD + "boolean"))
        if kind == "op" and text == "[" and self.op("]"):
            return Var(self.new())
        raise QueryError(f"unexpected {text or 'end of query'!r}")

    def triples(self) -> list[Pattern]:
        out: list[Pattern] = []
        s = self.term()
        while True:
            if self.peek()[0] == "var":
                p: object = self.term()
            else:
                p = self.path()
                if p.kind == "iri":
                    p = Const(p.iri)
            while True:
                out.append(Pattern(s, p, self.term()))
                if not self.op(","):
                    break
            if not self.op(";"):
                return out
            while self.op(";"):
                pass
            if self.peek()[1] in (".", "}") or self.peek()[0] == "end":
                return out

    def path(self) -> Path:
        parts = [self.path_seq()]
        while self.op("|"):
            parts.append(self.path_seq())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_seq(self) -> Path:
        parts = [self.path_step()]
        while self.op("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_step(self) -> Path:
        inverse = bool(self.op("^"))
        if self.op("!"):
            items = []
            if self.op("("):
                while not self.op(")"):
                    items.append((bool(self.op("^")), self.path_iri()))
                    self.op("|")
            else:
                items.append((bool(self.op("^")), self.path_iri()))
            out = Path("not", tuple(items))
        elif self.op("("):
            out = self.path()
            self.need(")")
        else:
            out = Path("iri", iri=self.path_iri())
        mark = self.op("*", "+", "?")
        if mark:
            out = Path({"*": "star", "+": "plus", "?": "opt"}[mark], (out,))
        return Path("inverse", (out,)) if inverse else out

    def path_iri(self) -> str:
        kind, text = self.next()
        if kind == "word" and text == "a":
            return RDF + "type"
        if kind == "iri":
            return self.iri(text)
        if kind == "pname":
            return self.pname(text)
        raise QueryError(f"expected a predicate, found {text or 'end of query'!r}")

    # expressions

    def expr(self) -> Expr:
        left = self.conjunction()
        while self.op("||"):
            left = Expr("or", [left, self.conjunction()])
        return left

    def conjunction(self) -> Expr:
        left = self.relation()
        while self.op("&&"):
            left = Expr("and", [left, self.relation()])
        return left

    def relation(self) -> Expr:
        left = self.sum()
        if sign := self.op("=", "!=", "<", ">", "<=", ">="):
            return Expr(sign, [left, self.sum()])
        negated = self.is_word("NOT") and self.peek(1)[1].upper() == "IN"
        if negated:
            self.next()
        if self.word("IN"):
            self.need("(")
            options = []
            while not self.op(")"):
                options.append(self.expr())
                self.op(",")
            e = Expr("in", [left, *options])
            return Expr("not", [e]) if negated else e
        return left

    def sum(self) -> Expr:
        left = self.product()
        while sign := self.op("+", "-"):
            left = Expr(sign, [left, self.product()])
        return left

    def product(self) -> Expr:
        left = self.unary()
        while sign := self.op("*", "/"):
            left = Expr(sign, [left, self.unary()])
        return left

    def unary(self) -> Expr:
        if self.op("!"):
            return Expr("not", [self.unary()])
        if self.op("-"):
            return Expr("neg", [self.unary()])
        self.op("+")
        return self.primary()

    def primary(self) -> Expr:
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        kind, text = self.peek()
        if kind == "word" and text not in ("true", "false"):
            name = self.next()[1].upper()
            if name in ("EXISTS", "NOT"):
                if name == "NOT" and not self.word("EXISTS"):
                    raise QueryError("expected EXISTS")
                return Expr("exists" if name == "EXISTS" else "not exists", [self.group()])
            return self.call(name)
        if kind in ("iri", "pname"):
            term = self.term()
            if self.peek()[1] == "(":  # a cast such as xsd:integer(...)
                return Expr("cast", self.arguments(), {"to": term.code})
            return Expr("const", [term.code])
        term = self.term()
        return Expr("var", [term.name]) if isinstance(term, Var) else Expr("const", [term.code])

    def call(self, name: str) -> Expr:
        if name not in AGGREGATES:
            return Expr("call", self.arguments(), {"name": name})
        self.need("(")
        extra: dict = {"name": name, "distinct": self.word("DISTINCT"), "separator": " "}
        args = [] if self.op("*") else [self.expr()]
        if self.op(";"):
            if not self.word("SEPARATOR"):
                raise QueryError("expected SEPARATOR")
            self.need("=")
            extra["separator"] = unescape(self.next()[1][1:-1])
        self.need(")")
        return Expr("aggregate", args, extra)

    def arguments(self) -> list[Expr]:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expr())
            if not self.op(",") and self.peek()[1] != ")":
                raise QueryError(f"unexpected {self.peek()[1]!r}")
        return out


def parse(text: str, prefixes: dict[str, str]) -> Select:
    return Parser(text, prefixes).parse()
