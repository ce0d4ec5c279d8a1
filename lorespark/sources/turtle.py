"""Turtle documents as graphs, and graphs as Turtle documents.

A document of any size is read by ``turtle_scan.read_turtle``, in byte ranges on the executors,
and written by ``write_turtle``: Spark renders a line a triple in order of subjects into parts,
which a writer then strings together into one file, a buffer at a time. Stored graphs are
Parquet, partitioned by predicate.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parser import ESCAPE, SIMPLE
from ..plans.statistics import save_statistics
from ..terms import RDF, TRIPLE, XSD


class TurtleError(ValueError):
    """A malformed document."""


TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\x00-\x20]*>)
  |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<at>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  |(?P<blank>_:[\w.-]*\w)|(?P<pname>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w:%.-]|\\.)*(?:[\w:%-]|\\.))?)?)
  |(?P<word>[A-Za-z]+)|(?P<op>\^\^|[\[\]().;,])""",
    re.X | re.S,
)


def _text(token: str) -> str:
    n = 3 if token[:3] in ('"""', "'''") else 1
    return ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else SIMPLE.get(m[1], m[1]), token[n:-n])


CLOSE = {q: re.compile(rf"(?:[^{q}\\]|\\.|{q}(?!{q}{q}))*+{q}{q}{q}", re.S) for q in "\"'"}


class Lexer:
    """Tokens line by line; of all tokens only a long string goes over lines.

    quote is that of the long string that is open at the start, or None. A line is given without its end.
    """

    def __init__(self, quote: str | None = None, strict: bool = True):
        self.quote, self.strict, self.parts = quote, strict, []

    def feed(self, line: str) -> Iterator[tuple[str, str, int]]:
        """(kind, text, end in the line) of each token that ends in this line, without white space and comments."""
        at = 0
        while at < len(line) or self.quote:
            if self.quote is None and line[at : at + 3] in ('"""', "'''"):
                self.quote, self.parts = line[at], [line[at : at + 3]]
                at += 3
            if self.quote:
                m = CLOSE[self.quote].match(line, at)
                if not m:
                    self.parts.append(line[at:] + "\n")
                    return
                self.parts.append(m[0])
                at, self.quote = m.end(), None
                yield "string", "".join(self.parts), at
                continue
            m = TOKEN.match(line, at)
            if not m:
                if self.strict:
                    raise TurtleError(f"unexpected text at {line[at : at + 20]!r}")
                at += 1
                continue
            at = m.end()
            if m.lastgroup != "ws":
                yield m.lastgroup, m[0], at


def tokens(text: str) -> list[tuple[str, str]]:
    lexer = Lexer()
    out = [(kind, token) for line in text.split("\n") for kind, token, _ in lexer.feed(line)]
    if lexer.quote:
        raise TurtleError("a string has no end")
    return out


class Reader:
    """Triples of the tokens of whole statements; prefixes and base go on from one call of ``read`` to the next."""

    def __init__(self, prefixes: dict[str, str], base: str = "", label: str = "b"):
        self.prefixes, self.base, self.label, self.blanks = dict(prefixes), base, label, 0

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def op(self, op: str) -> bool:
        if self.tokens[self.at] == ("op", op):
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.op(op):
            raise TurtleError(f"expected {op!r}, found {self.tokens[self.at][1]!r}")

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            value = text[1:-1]
            return value if re.match(r"[A-Za-z][\w+.-]*:", value) else self.base + value
        if kind == "pname":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"expected an IRI, found {text!r}")

    def read(self, found: list[tuple[str, str]]) -> list[tuple]:
        self.tokens, self.at, self.rows = [*found, ("end", "")], 0, []
        while self.tokens[self.at][0] != "end":
            kind, text = self.tokens[self.at]
            if text.lower() in ("@prefix", "prefix"):
                self.at += 1
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.iri(*self.next())
                if text[0] == "@":
                    self.need(".")
            elif text.lower() in ("@base", "base"):
                self.at += 1
                self.base = self.iri(*self.next())
                if text[0] == "@":
                    self.need(".")
            else:
                alone = (kind, text) == ("op", "[")
                s = self.node()
                if not (alone and self.tokens[self.at] == ("op", ".")):
                    self.predicates(s)
                self.need(".")
        return self.rows

    def blank(self) -> str:
        self.blanks += 1
        return f"_:{self.label}{self.blanks}"

    def node(self) -> str:
        kind, text = self.next()
        if kind == "blank":
            return text
        if (kind, text) == ("op", "["):
            s = self.blank()
            if not self.op("]"):
                self.predicates(s)
                self.need("]")
            return s
        if (kind, text) == ("op", "("):
            items = []
            while not self.op(")"):
                items.append(self.object())
            rest = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                s = self.blank()
                self.rows += [(s, RDF + "first", *item), (s, RDF + "rest", *rest)]
                rest = (s, "iri", None, None)
            return rest[0]
        return self.iri(kind, text)

    def predicates(self, s: str) -> None:
        while True:
            kind, text = self.next()
            p = RDF + "type" if (kind, text) == ("word", "a") else self.iri(kind, text)
            while True:
                self.rows.append((s, p, *self.object()))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.tokens[self.at][1] in (".", "]"):
                return

    def object(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            value = _text(text)
            if self.tokens[self.at][0] == "at":
                return value, "lit", None, self.next()[1][1:].lower()
            if self.op("^^"):
                return value, "lit", self.iri(*self.next()), None
            return value, "lit", None, None
        if kind == "num":
            self.at += 1
            dt = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return text, "lit", XSD + dt, None
        if kind == "word" and text in ("true", "false"):
            self.at += 1
            return text, "lit", XSD + "boolean", None
        return self.node(), "iri", None, None


def parse_turtle(text: str, prefixes: dict[str, str] | None = None) -> list[tuple]:
    """(s, p, o, o_kind, o_dt, o_lang) of a document, in its order."""
    return Reader(prefixes or {}).read(tokens(text))


def save_graph(graph: DataFrame, path: str) -> None:
    """Parquet by predicate: a pattern with a known predicate reads only its folder.

    Rows are dealt by ranges of predicate and subject, so a frequent predicate is many tasks and files. The
    graph's statistics are kept beside it (``plans.statistics``).
    """
    graph.repartitionByRange("p", "s").write.mode("overwrite").partitionBy("p").parquet(path)
    save_statistics(load_graph(graph.sparkSession, path), path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIPLE).parquet(path).select("s", "p", "o", "o_kind", "o_dt", "o_lang")


def _escaped(c: Column) -> Column:
    for plain, said in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(said))
    return c


def _iri(c: Column, prefixes: dict[str, str]) -> Column:
    """An IRI as a prefixed name where one fits, a blank node as it stands."""
    out = F.when(F.startswith(c, F.lit("_:")), c)
    for name, space in sorted(prefixes.items(), key=lambda x: (-len(x[1]), x[0])):
        local = F.substr(c, F.lit(len(space) + 1))
        out = out.when(F.startswith(c, F.lit(space)) & local.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(f"{name}:"), local))
    return out.otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def _object(prefixes: dict[str, str]) -> Column:
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^"), _iri(F.col("o_dt"), prefixes))).otherwise("")
    return F.when(F.col("o_kind") == "iri", _iri(F.col("o"), prefixes)).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), suffix))


def _header(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {name}: <{space}> .\n" for name, space in sorted(prefixes.items()))


ORDER = ["s", "p", "o_kind", "o", "o_dt", "o_lang"]


def turtle_lines(graph: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(value): the document's lines in order, an object a line; equal graphs give equal lines.

    Whether a triple is its subject's or predicate's first or last comes from grouped bounds, so a subject
    of any number of triples may lie in several ranges.
    """
    g = graph.distinct().withColumn("t", F.struct(*ORDER[2:]))
    one = g.groupBy("s", "p").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    whole = one.groupBy("s").agg(F.min("p").alias("first_p"), F.max("p").alias("last_p"))
    marked = g.join(one.join(whole, "s"), ["s", "p"])
    opens, closes = F.col("t").eqNullSafe(F.col("first_t")), F.col("t").eqNullSafe(F.col("last_t"))
    predicate = F.when(F.col("p") == RDF + "type", "a").otherwise(_iri(F.col("p"), prefixes))
    lead = F.when(opens & (F.col("p") == F.col("first_p")), F.concat(F.lit("\n"), _iri(F.col("s"), prefixes), F.lit("\n    "), predicate)).when(opens, F.concat(F.lit("    "), predicate)).otherwise("       ")
    end = F.when(closes & (F.col("p") == F.col("last_p")), " .").when(closes, " ;").otherwise(" ,")
    dealt = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return dealt.select(F.concat(lead, F.lit(" "), _object(prefixes), end).alias("value"))


def to_turtle(graph: DataFrame, prefixes: dict[str, str]) -> str:
    """The document as one string, for graphs that fit in one; its lines come a partition at a time."""
    return _header(prefixes) + "".join(r.value + "\n" for r in turtle_lines(graph, prefixes).toLocalIterator())


def write_turtle(graph: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """One document of any size at any path that Spark writes, with its folders.

    Spark writes the lines in parts beside it; the parts are strung together in their order through a buffer
    into a hidden file, which then takes the document's place.
    """
    jvm, conf = graph.sparkSession._jvm, graph.sparkSession.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    target = hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    parent = target.getParent()
    fs.mkdirs(parent)
    parts, whole = (hadoop.fs.Path(parent, f".{target.getName()}-{uuid.uuid4().hex}{end}") for end in ("-parts", ""))
    try:
        turtle_lines(graph, prefixes).write.text(parts.toString())
        out = fs.create(whole)
        try:
            out.write(bytearray(_header(prefixes), "utf-8"))
            listed = sorted((s.getPath().getName() for s in fs.listStatus(parts)))
            for name in listed:
                if name.startswith("part-"):
                    part = fs.open(hadoop.fs.Path(parts, name))
                    try:
                        hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                    finally:
                        part.close()
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(whole, target):
            raise OSError(f"{path} could not be put in place")
    finally:
        fs.delete(parts, True)
        fs.delete(whole, False)


def save_turtle(graph: DataFrame, path: str) -> None:
    """A graph of any size as a folder of Turtle documents without prefixes, each a range of subjects in order."""
    line = F.concat_ws(" ", _iri(F.col("s"), {}), _iri(F.col("p"), {}), _object({}), F.lit("."))
    graph.distinct().repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(line.alias("value")).write.mode("overwrite").text(path)
