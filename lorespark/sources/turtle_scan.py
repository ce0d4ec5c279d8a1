"""Turtle documents of any size, read in byte ranges on the executors.

Spark's text source cuts a file into ranges of whole lines. A line on its own is not enough to
read a range: it may begin inside a long string or a statement, and prefixes may have been
bound before it. Two passes settle that:

1. Each range says, for each of the three states it may begin in (no string open, or a long
   string of either quote), in which state it ends, whether a statement ends in it and which
   directives stand in it. The driver chains these summaries, one a range and not a triple, which
   gives every range its true state, prefixes and base.
2. Each range is read from its true state: its statements become triples; what stands before its
   first and behind its last statement end are fragments, which are brought together by the
   statement they belong to and read likewise.

Memory: a task holds one statement at a time, the driver one summary a range. A statement must
fit in a task. Blank node labels hold for the whole path; nodes without a label get one from
their range. A folder is read as one graph, each file with prefixes of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store, ready_workers
from ..terms import KEYS, TRIPLE
from .turtle import Lexer, Reader, TurtleError, tokens

Token = tuple[str, str]
STATES = (None, '"', "'")
ROWS = 10_000  # of an Arrow batch that a task gives back
PIECE = "range_no int, whose int, piece string"
OUT = pa.schema([*[(k, pa.string()) for k in KEYS], ("range_no", pa.int32()), ("whose", pa.int32()), ("piece", pa.string())])
SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("summary", pa.string())])


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """((file, first byte), lines) of each range of a task, in order."""

    def rows() -> Iterator[tuple[str, int, str]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), strict=True)

    for key, lines in groupby(rows(), key=lambda r: r[:2]):
        yield key, (r[2] for r in lines)


class Directives:
    """Prefixes and base from a stream of tokens; open is a directive that has begun."""

    def __init__(self, begun: list[Token] = ()):
        self.open, self.before, self.found = list(begun), "", []

    def take(self, kind: str, text: str) -> None:
        if self.open:
            self.open.append((kind, text))
            need = 3 if self.open[0][1].lower().endswith("prefix") else 2
            if kind == "iri" or len(self.open) == need:
                if kind == "iri" and len(self.open) == need:
                    self.found.append([self.open[1][1][:-1] if need == 3 else None, text])
                self.open = []
        elif (kind == "at" and text.lower() in ("@prefix", "@base") and self.before != "string") or (kind == "word" and text.lower() in ("prefix", "base")):
            self.open = [(kind, text)]
        self.before = kind


def summarize(lines: list[str] | Iterator[str]) -> dict:
    """What a range does from each state that it may begin in."""
    lexers = [Lexer(q, strict=False) for q in STATES]
    seen = [Directives() for _ in STATES]
    first: list[list[Token]] = [[] for _ in STATES]
    stops = [False] * len(STATES)
    for line in lines:
        for i, lexer in enumerate(lexers):
            for kind, text, _ in lexer.feed(line):
                if len(first[i]) < 2:
                    first[i].append((kind, text[:4096]))
                seen[i].take(kind, text)
                stops[i] = stops[i] or (kind, text) == ("op", ".")
            lexer.parts = lexer.parts[:1]  # what a string holds is of no interest here
    return {"end": [x.quote for x in lexers], "stop": stops, "found": [d.found for d in seen], "open": [d.open for d in seen], "first": first}


def _bound(prefixes: dict[str, str], base: str, found: list) -> tuple[dict[str, str], str]:
    reader = Reader(prefixes, base)
    for name, text in found:
        value = reader.iri("iri", text)
        if name is None:
            reader.base = value
        else:
            reader.prefixes[name] = value
    return reader.prefixes, reader.base


def chained(summaries: list[tuple[str, int, dict]], prefixes: dict[str, str]) -> tuple[dict, dict]:
    """({(file, start): how to read the range}, {statement group: (prefixes, base) where it begins}).

    A group is the statement that is open behind a range, named by the range's number; what a file begins with
    is a group with a negative name.
    """
    plan: dict[tuple[str, int], dict] = {}
    groups: dict[int, tuple[dict[str, str], str]] = {}
    file, state, names, base, begun, group = None, 0, prefixes, "", [], 0
    for number, (path, start, s) in enumerate(sorted(summaries, key=lambda x: x[:2])):
        if path != file:
            file, state, names, base, begun, group = path, 0, dict(prefixes), "", [], -number - 1
            groups[group] = (names, base)
        first, old, of_old = s["first"][state], begun, (names, base)
        if begun:  # a directive that began in a range before
            rest = Directives(begun)
            for token in first:
                if rest.open:
                    rest.take(*token)
            names, base = _bound(names, base, rest.found)
            begun = rest.open
        plan[(path, start)] = {"number": number, "quote": STATES[state], "prefixes": of_old[0], "base": of_old[1], "begun": old, "whose": group}
        names, base = _bound(names, base, s["found"][state])
        begun = s["open"][state] or begun
        if s["stop"][state]:
            group = number
        groups[group] = groups.get(group, (names, base)) if group != number else (names, base)
        state = STATES.index(s["end"][state])
    if state:
        raise TurtleError("a string has no end")
    return plan, groups


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), OUT, strict=True)], schema=OUT)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), OUT, strict=True)], schema=OUT)


def read_range(lines: Iterator[str], how: dict) -> Iterator[tuple]:
    """Triples and fragments of a range: a row of a triple has no piece, that of a fragment nothing else."""
    lexer = Lexer(how["quote"])
    reader = Reader(how["prefixes"], how["base"], f"anon-{how['number']}-")
    # all that stands before the first statement end belongs to a statement that began before
    whose, raw, said = how["whose"], [], []
    for line in lines:
        at = 0
        for kind, text, end in lexer.feed(line):
            said.append((kind, text))
            if (kind, text) != ("op", "."):
                continue
            if whose != how["number"]:
                raw.append(line[at:end])
                yield (*[None] * 6, how["number"], whose, "\n".join(raw))
                whose = how["number"]
                directives = Directives(how["begun"])
                for token in said:
                    directives.take(*token)
                reader.prefixes, reader.base = _bound(reader.prefixes, reader.base, directives.found)
            else:
                for row in reader.read(said):
                    yield (*row, None, None, None)
            raw, said, at = [], [], end
        raw.append(line[at:])
    if raw:  # an empty line too may be one of a string
        yield (*[None] * 6, how["number"], whose, "\n".join(raw))


def read_turtle(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The graph of a document, or of a folder of them, at any path that Spark reads."""
    ready_workers(spark)
    store = Store(spark, "turtle")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), text in _ranges(batches):
            row = {"file": file, "start": start, "summary": json.dumps(summarize(text))}
            yield pa.RecordBatch.from_pylist([row], schema=SUMMARY)

    try:
        found = lines.mapInArrow(first, "file string, start long, summary string").collect()  # a row a range
        plan, groups = chained([(r.file, r.start, json.loads(r.summary)) for r in found], prefixes or {})

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, text in _ranges(batches):
                yield from _batches(read_range(text, plan[key]))

        def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for whose, pieces in zip(batch.column("whose").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                    names, base = groups[whose]
                    rows = Reader(names, base, f"anon-{'f' if whose < 0 else 's'}{abs(whose)}-").read(tokens("\n".join(p["piece"] for p in pieces)))
                    yield from _batches((*row, None, None, None) for row in rows)

        read = store.save(lines.mapInArrow(second, f"{TRIPLE}, {PIECE}"))
        pieces = read.where("piece is not null").groupBy("whose").agg(F.sort_array(F.collect_list(F.struct("range_no", "piece"))).alias("pieces"))
        joined = store.save(pieces.mapInArrow(third, f"{TRIPLE}, {PIECE}"))
    except PythonException as e:
        said = str(e)
        if "TurtleError: " not in said:
            raise
        raise TurtleError(said.split("TurtleError: ", 1)[1].split("\n", 1)[0]) from e
    return read.where("piece is null").select(*KEYS).union(joined.select(*KEYS)).distinct()
