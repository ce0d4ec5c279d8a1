"""Algebra to DataFrames.

Each solution is a DataFrame of one string column a variable (see ``terms``), with the set
of variables that may be unbound. Joins on variables bound on both sides are plain equi-joins;
where one may be unbound, the condition is compatibility and the output takes the bound side.
Patterns of a group are joined most-bound first, connected ones before others, so Catalyst
gets filters on the scans and no needless product; where the graph's statistics are known they
give the order, and patterns about one subject are read in one pass (see ``statistics``). Nothing
is made distinct but for DISTINCT, zero-or-more paths and graph union.

A variable that stands in an expression and is bound by an object takes its number along in a
hidden variable, made of the stored columns at the scan: comparing, adding up and sorting numbers
read that and take no code apart. Hidden variables never join; where one side of a union or an
OPTIONAL lacks it, it is dropped and the number is read off the code again.

Where the graph is made of tables and their rows are given, a group's patterns are joined as rows
(see ``over_rows``): codes and numbers are made of the joined rows, so that no shuffle carries them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reach import closure, reach_from
from ..operators.store import Store
from ..terms import KEYS, RDF, TYPE, XSD, datatype_of, is_literal, language_of, lexical, object_code, split_code, tail
from .parser import Const, Expr, Group, Path, Pattern, QueryError, Select, Var, parse
from .relational import Rows
from .statistics import Statistics, ordered

# The numeric datatypes.
WHOLE = "integer int long short nonNegativeInteger positiveInteger".split()
NUMERIC = [*WHOLE, "decimal", "double", "float"]


def typed(code: Column, names: list[str]) -> Column:
    """Whether a term is a literal of one of these datatypes; by plain splitting, for it is asked of every row."""
    return F.split_part(code, F.lit('"^^' + XSD), F.lit(-1)).isin(names)


def digits(code: Column) -> Column:
    """The lexical form of a number's code, which holds no quote."""
    return F.split_part(code, F.lit('"'), F.lit(2))


@dataclass
class Solution:
    df: DataFrame
    names: list[str]  # in order of first appearance
    maybe: frozenset[str] = frozenset()


@dataclass
class Val:
    """A compiled expression: kind is term (a code), num, int, str or bool."""

    kind: str
    col: Column
    num: Column | None = None  # a term's number beside its code, null where the term is unbound


NUM = "struct<value: double, whole: boolean, exact: bigint>"
HIDDEN = ".num "  # no variable's name begins with a dot


STEP = ".step"  # variables between the steps of a path
EXACT = {"tinyint", "smallint", "int", "bigint", "string"}  # keys that are equal just where their text is


@dataclass
class Place:
    """How joined rows give a variable: its code, its number and, of a node, its table's name and its key's type and column."""

    code: Column
    num: Column | None = None
    key: tuple[str, str, Column] | None = None

    def equals(self, other: Place) -> Column:
        if self.key and other.key and self.key[0] == other.key[0] and (self.key[1] == "string") == (other.key[1] == "string"):
            return self.key[2] == other.key[2]
        return self.code == other.code


def stored_number(o: Column, dt: Column) -> Column:
    """The number of a stored object: its value, whether it is a whole one, and that one exactly."""
    whole = F.coalesce(dt.isin([XSD + t for t in WHOLE]), F.lit(False))
    value = F.when(dt.isin([XSD + t for t in NUMERIC]), o.try_cast("double"))
    return F.struct(value.alias("value"), whole.alias("whole"), F.when(whole, o.try_cast("bigint")).alias("exact"))


def beside(v: Val) -> Column | None:
    """The number that goes beside a value's code, where it has one."""
    if v.kind in ("int", "num"):
        whole = v.kind == "int"
        exact = v.col.cast("bigint") if whole else F.lit(None).cast("bigint")
        number_ = F.struct(v.col.cast("double").alias("value"), F.lit(whole).alias("whole"), exact.alias("exact"))
        return F.when(v.col.isNotNull(), number_)
    return v.num


def asked(node: object) -> set[str]:
    """The variables that stand in expressions of a query."""
    if isinstance(node, Expr) and node.op == "var":
        return {node.args[0]}
    if is_dataclass(node):
        node = [getattr(node, f.name) for f in fields(node)]
    if isinstance(node, dict):
        node = list(node.values())
    return set().union(*map(asked, node)) if isinstance(node, (list, tuple)) else set()


def shown(names: list[str]) -> list[str]:
    return [n for n in names if not n.startswith(HIDDEN)]


def number(v: Val) -> Column:
    if v.kind in ("num", "int"):
        return v.col
    if v.num is not None:
        return v.num["value"]
    if v.kind == "term":
        return F.when(typed(v.col, NUMERIC), digits(v.col).try_cast("double"))
    return F.lit(None).cast("double")


def whole_number(v: Val) -> Column:
    if v.num is not None:
        return v.num["whole"]
    return typed(v.col, WHOLE) if v.kind == "term" else F.lit(v.kind == "int")


def string(v: Val) -> Column:
    if v.kind == "term":
        return lexical(v.col)
    return v.col.cast("string")


def truth(v: Val) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind in ("num", "int"):
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "str":
        return F.length(v.col) > 0
    t = tail(v.col)
    return (
        F.when(~is_literal(v.col), F.lit(None).cast("boolean"))
        .when(t == f"^^{XSD}boolean", lexical(v.col).isin("true", "1"))
        .when(typed(v.col, NUMERIC), F.coalesce(lexical(v.col).try_cast("double") != 0, F.lit(False)))
        .when((t == "") | F.startswith(t, F.lit("@")), F.length(lexical(v.col)) > 0)
    )


def term(v: Val) -> Column:
    if v.kind == "term":
        return v.col
    dt = {"num": f"^^{XSD}double", "int": f"^^{XSD}integer", "bool": f"^^{XSD}boolean", "str": ""}[v.kind]
    return F.concat(F.lit('"'), v.col.cast("string"), F.lit('"' + dt))


def constant(code: str) -> Val:
    kind, text, dt, lang = split_code(code)
    if kind == "lit" and lang is None:
        if dt in (f"{XSD}integer", f"{XSD}int", f"{XSD}long"):
            return Val("int", F.lit(int(text)))
        if dt in (f"{XSD}decimal", f"{XSD}double", f"{XSD}float"):
            return Val("num", F.lit(float(text)))
        if dt == f"{XSD}boolean":
            return Val("bool", F.lit(text in ("true", "1")))
        if dt is None:
            return Val("str", F.lit(text))
    return Val("term", F.lit(code))


def compare(op: str, a: Val, b: Val) -> Column:
    apply = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    kinds = {a.kind, b.kind}
    if kinds & {"num", "int"}:
        return apply(number(a), number(b))
    if kinds == {"bool"}:
        return apply(a.col, b.col)
    if kinds == {"str"}:
        return apply(a.col, b.col)
    x, y = term(a), term(b)
    if op in ("=", "!="):
        if kinds == {"term"}:
            both = number(a).isNotNull() & number(b).isNotNull()
            return F.when(both, apply(number(a), number(b))).otherwise(apply(x, y))
        return apply(x, y)
    numbers = F.when(number(a).isNotNull() & number(b).isNotNull(), apply(number(a), number(b)))
    return numbers.when(is_literal(x) & is_literal(y) & (tail(x) == tail(y)), apply(lexical(x), lexical(y)))


def is_blank(code: Column) -> Column:
    return F.startswith(code, F.lit("_:"))


def order_keys(v: Val) -> list[Column]:
    """Unbound, then IRIs, then literals: numbers by value, others by text."""
    c, value = v.col, F.coalesce(number(v), F.lit(float("inf")))
    if v.kind != "term":
        return [F.when(c.isNull(), 0).otherwise(2), value, c.cast("string")]
    return [F.when(c.isNull(), 0).when(~is_literal(c), 1).otherwise(2), value, lexical(c)]


class Compiler:
    def __init__(self, graph: DataFrame, known: Statistics | None = None, rows: list[Rows] | None = None):
        self.graph, self.known, self.rows, self.ids = graph, known, rows, {}
        self.asked: set[str] = set()  # variables whose numbers are taken along
        self.spark = graph.sparkSession

    def col(self, name: str) -> str:
        """A variable's column: variables are case-sensitive, columns are not."""
        return self.ids.setdefault(name, f"v{len(self.ids)}")

    # numbers beside codes

    def bare(self, a: Solution, names: list[str]) -> Solution:
        """a without the numbers of these variables."""
        gone = {HIDDEN + n for n in names} & set(a.names)
        if not gone:
            return a
        return Solution(a.df.drop(*map(self.col, gone)), [n for n in a.names if n not in gone], a.maybe - gone)

    def put(self, a: Solution, name: str, v: Val) -> Solution:
        """a with a variable more, its number beside it where that is asked for."""
        df, names, num = a.df.withColumn(self.col(name), term(v)), [*a.names, name], beside(v)
        if num is not None and name in self.asked:
            df = a.df.select("*", term(v).alias(self.col(name)), num.alias(self.col(HIDDEN + name)))
            names.append(HIDDEN + name)
        return Solution(df, names, a.maybe | {name})

    # patterns

    def pattern(self, p: Pattern) -> Solution:
        if isinstance(p.p, Path):
            pairs = self.pairs(p)
            places = [(p.s, F.col("a"), None), (p.o, F.col("b"), None)]
            df = pairs
        else:
            df = self.graph
            places = [(p.s, F.col("s"), "s"), (p.p, F.col("p"), "p"), (p.o, object_code(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")), "o")]
        out: dict[str, Column] = {}
        for t, c, place in places:
            if isinstance(t, Const):
                df = df.where(self.is_object(t.code) if place == "o" else c == t.code)
            elif t.name in out:
                df = df.where(out[t.name] == c)
            else:
                out[t.name] = c
                if place == "o" and t.name in self.asked:
                    out[HIDDEN + t.name] = stored_number(F.col("o"), F.col("o_dt"))
        return Solution(df.select(*[c.alias(self.col(n)) for n, c in out.items()]), list(out))

    def is_object(self, code: str, of: dict | None = None) -> Column:
        """Equality with a constant on the stored columns, or on an object's, so that it reaches the scan."""
        kind, text, dt, lang = split_code(code)
        o, o_kind, o_dt, o_lang = [of[k] if of else F.col(k) for k in KEYS[2:]]
        same = (o == text) & (o_kind == kind)
        if kind == "iri":
            return same
        plain = o_dt.isNull() | (o_dt == XSD + "string")
        same &= (o_dt == dt) if dt else F.lit(True) if lang else plain
        return same & ((o_lang == lang) if lang else o_lang.isNull())

    def pairs(self, p: Pattern) -> DataFrame:
        """Pairs (a, b) of a pattern's path. A closure with a known end is searched from there, not closed everywhere."""
        ends = [t.code for t in (p.s, p.o) if isinstance(t, Const)]
        if p.p.kind not in ("plus", "star") or not ends:
            return self.path(p.p, ends)
        start, other = ("a", "b") if isinstance(p.s, Const) else ("b", "a")
        seed = F.lit(ends[0])
        edges = self.path(p.p.parts[0], []).select(F.col(start).alias("a"), F.col(other).alias("b"))
        found = reach_from(edges, self.spark.range(1).select(seed.alias("a"))).select(F.col("b").alias(other))
        if p.p.kind == "star":
            found = found.union(self.spark.range(1).select(seed)).distinct()
        return found.select(*[(seed if side == start else F.col(other)).alias(side) for side in ("a", "b")])

    def path(self, p: Path, constants: list[str]) -> DataFrame:
        """Pairs (a, b) of a property path."""
        obj = object_code(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))
        if p.kind == "iri":
            return self.graph.where(F.col("p") == p.iri).select(F.col("s").alias("a"), obj.alias("b"))
        if p.kind == "inverse":
            return self.path(p.parts[0], constants).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if p.kind == "seq":
            steps = [self.path(x, constants) for x in p.parts]
            return reduce(lambda x, y: x.withColumnRenamed("b", "m").join(y.withColumnRenamed("a", "m"), "m").select("a", "b"), steps)
        if p.kind == "alt":
            return reduce(DataFrame.union, [self.path(x, constants) for x in p.parts])
        if p.kind == "not":
            ahead = [i for inverse, i in p.parts if not inverse]
            back = [i for inverse, i in p.parts if inverse]
            frames = []
            if ahead:
                frames.append(self.graph.where(~F.col("p").isin(ahead)).select(F.col("s").alias("a"), obj.alias("b")))
            if back:
                frames.append(self.graph.where(~F.col("p").isin(back)).select(obj.alias("a"), F.col("s").alias("b")))
            return reduce(DataFrame.union, frames)
        inner = self.path(p.parts[0], constants)
        if p.kind == "plus":
            return closure(inner)
        nodes = self.graph.select(F.col("s").alias("a")).union(self.graph.select(obj.alias("a")))
        if constants:
            nodes = nodes.union(self.spark.createDataFrame([(c,) for c in constants], "a string"))
        same = nodes.distinct().select("a", F.col("a").alias("b"))
        return same.union(closure(inner) if p.kind == "star" else inner).distinct()

    def star(self, star: list[Pattern]) -> Solution:
        """Patterns about one subject, each with a predicate of its own: one read, grouped by subject, the objects set out again."""
        obj = object_code(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))
        tests = [(F.col("p") == p.p.code) & (self.is_object(p.o.code) if isinstance(p.o, Const) else F.lit(True)) for p in star]
        read = self.graph.where(F.col("p").isin([p.p.code for p in star]) & reduce(Column.__or__, tests))
        numbered = {i for i, p in enumerate(star) if isinstance(p.o, Var) and p.o.name in self.asked}
        pair = F.struct(obj.alias("code"), stored_number(F.col("o"), F.col("o_dt")).alias("num"))
        kept = [F.when(t, pair if i in numbered else obj) for i, t in enumerate(tests)]
        df = read.groupBy("s").agg(*[F.collect_list(k).alias(f"m{i}") for i, k in enumerate(kept)])
        df = df.where(reduce(Column.__and__, [F.size(f"m{i}") > 0 for i in range(len(star))]))
        for i in range(len(star)):
            df = df.withColumn(f"m{i}", F.explode(f"m{i}"))
        out = {star[0].s.name: F.col("s")}
        for i, p in enumerate(star):
            if isinstance(p.o, Var):
                out[p.o.name] = F.col(f"m{i}.code" if i in numbered else f"m{i}")
            if i in numbered:
                out[HIDDEN + p.o.name] = F.col(f"m{i}.num")
        return Solution(df.select(*[c.alias(self.col(n)) for n, c in out.items()]), list(out))

    def steps(self, p: Pattern) -> list[Pattern]:
        """A pattern whose path is a sequence, as patterns that meet in variables of their own."""
        if not isinstance(p.p, Path):
            return [p]
        if p.p.kind == "iri":
            return [Pattern(p.s, Const(p.p.iri), p.o)]
        if p.p.kind == "inverse":
            return self.steps(Pattern(p.o, p.p.parts[0], p.s))
        if p.p.kind != "seq":
            return [p]
        ends = [p.s]
        for _ in p.p.parts[1:]:
            ends.append(Var(f"{STEP}{len(self.ids)}"))
            self.col(ends[-1].name)
        ends.append(p.o)
        return [x for s, path, o in zip(ends, p.p.parts, ends[1:], strict=False) for x in self.steps(Pattern(s, path, o))]

    def table(self, p: Pattern) -> Rows | None:
        """The one table that a pattern's triples are made of."""
        if not isinstance(p.p, Const):
            return None
        kind = p.o.code if p.p.code == TYPE and isinstance(p.o, Const) else None
        found = [r for r in self.rows if p.p.code in r.objects and kind in (None, r.kind)]
        return found[0] if len(found) == 1 else None

    def part(self, i: int, rows: Rows | None, patterns: list[Pattern]) -> tuple[DataFrame, dict[str, Place]]:
        """The rows that answer patterns about one node, and where they hold each variable. Column names are the part's own."""
        own = lambda c: F.col(f"r{i}_{c}")
        if rows is None:
            a = self.pattern(patterns[0])
            df = a.df.select(*[F.col(c).alias(f"r{i}_{c}") for c in a.df.columns])
            return df, {n: Place(own(self.col(n)), own(self.col(HIDDEN + n)) if HIDDEN + n in a.names else None) for n in shown(a.names)}
        df = rows.df.select(*[F.col(c).alias(f"r{i}_{c}") for c in rows.df.columns])
        types = dict(rows.df.dtypes)
        key = lambda table, c: (table, types[c], own(c)) if types[c] in EXACT else None
        out: dict[str, Place] = {}
        subject = Place(rows.node(own), None, key(rows.name, rows.keys[0]) if len(rows.keys) == 1 else None)
        held = [(patterns[0].s, subject, {"o": subject.code, "o_kind": F.lit("iri")})]
        for p in patterns:
            of = rows.objects[p.p.code](own)
            num = stored_number(of["o"], of["o_dt"]) if isinstance(p.o, Var) and p.o.name in self.asked else None
            held.append((p.o, Place(object_code(*[of[k] for k in KEYS[2:]]), num, key(*of["node"]) if "node" in of else None), of))
        for t, place, of in held:
            df = df.where((place.key[2] if place.key else of["o"]).isNotNull())
            if isinstance(t, Const):
                df = df.where(place.code == t.code if of is held[0][2] else self.is_object(t.code, of))
            elif t.name in out:
                df = df.where(out[t.name].code == place.code)
                out[t.name] = out[t.name] if out[t.name].num is not None else place
            else:
                out[t.name] = place
        return df, out

    def over_rows(self, patterns: list[Pattern]) -> Solution:
        """Joins patterns as rows of the tables that the graph is made of.

        Patterns about one node that one table answers are one read of its rows. Nodes of one table are compared by
        their keys, anything else by codes. Most constants come first, then those that share a variable.
        """
        units: list[tuple[Rows | None, list[Pattern]]] = []
        for p in [x for p in patterns for x in self.steps(p)]:
            rows = self.table(p)
            mine = next((u for r, u in units if rows is not None and r is rows and u[0].s == p.s), None)
            if mine is None:
                units.append((rows, [p]))
            else:
                mine.append(p)
        names = lambda u: {t.name for p in u for t in (p.s, p.p, p.o) if isinstance(t, Var)}
        bound = lambda u: max(sum(isinstance(t, Const) for t in (p.s, p.p, p.o)) + isinstance(p.o, Const) for p in u)
        left, df, places = list(units), None, {}
        while left:
            linked = [x for x in left if names(x[1]) & places.keys()] or left
            one = max(linked, key=lambda x: bound(x[1]))
            left = [x for x in left if x is not one]
            other, found = self.part(len(units) - len(left), *one)
            if df is None:
                df, places = other, found
                continue
            same = [places[n].equals(found[n]) for n in found if n in places]
            df = df.join(other, reduce(Column.__and__, same)) if same else df.crossJoin(other)
            places = found | {n: x if x.num is not None or n not in found else found[n] for n, x in places.items()}
        out: dict[str, Column] = {}
        for n, x in places.items():
            if n.startswith(STEP):
                continue
            out[n] = x.code
            if x.num is not None:
                out[HIDDEN + n] = x.num
        if not out:
            return Solution(df.select(F.lit(1).alias("unit")), [])
        return Solution(df.select(*[c.alias(self.col(n)) for n, c in out.items()]), list(out))

    def basic(self, patterns: list[Pattern]) -> Solution:
        """Joins patterns in the order that the statistics give; without any, most constants first, then those that share a variable."""
        if self.rows is not None:
            return self.over_rows(patterns)
        if self.known is not None:
            parts = [self.star(u) if len(u) > 1 else self.pattern(u[0]) for u in ordered(self.known, patterns)]
            return reduce(self.join, parts)
        bound = lambda p: sum(isinstance(t, Const) for t in (p.s, p.p, p.o)) + isinstance(p.o, Const)
        names = lambda p: {t.name for t in (p.s, p.p, p.o) if isinstance(t, Var)}
        left, out, seen = list(patterns), None, set()
        while left:
            linked = [p for p in left if names(p) & seen] or left
            p = max(linked, key=bound)
            left.remove(p)
            seen |= names(p)
            out = self.pattern(p) if out is None else self.join(out, self.pattern(p))
        return out

    # combination

    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(F.lit(1).alias("unit")), [])

    def _sides(self, a: Solution, b: Solution) -> tuple[DataFrame, DataFrame, list[str], Column | None, list[Column], list[Column]]:
        """b's columns renamed, the shared names, the join condition, merged output, both-bound tests."""
        b = self.bare(b, [n for n in shown(a.names) if HIDDEN + n in a.names])
        right = b.df.select(*[F.col(self.col(n)).alias(self.col(n) + "_r") for n in b.names])
        shared = [n for n in a.names if n in b.names]
        condition, both = None, []
        for n in shared:
            x, y = F.col(self.col(n)), F.col(self.col(n) + "_r")
            same = x == y
            if n in a.maybe or n in b.maybe:
                same = x.isNull() | y.isNull() | same
            both.append(x.isNotNull() & y.isNotNull())
            condition = same if condition is None else condition & same
        out = []
        for n in [*a.names, *[n for n in b.names if n not in a.names]]:
            c = self.col(n)
            if n in shared:
                out.append((F.coalesce(F.col(c), F.col(c + "_r")) if n in a.maybe else F.col(c)).alias(c))
            else:
                out.append((F.col(c) if n in a.names else F.col(c + "_r")).alias(c))
        return a.df, right, shared, condition, out, both

    def join(self, a: Solution, b: Solution) -> Solution:
        """The natural join. A shared variable that may be unbound splits it: where both sides bind it, an equi-join, else a join without it."""
        if not a.names:
            return b if a.df.columns == ["unit"] else Solution(a.df.select(F.lit(1).alias("one")).crossJoin(b.df).select(*b.df.columns), b.names, b.maybe)
        split = next((n for n in shown(a.names) if n in b.names and (n in a.maybe or n in b.maybe)), None)
        if split is not None:
            known = lambda x: Solution(x.df.where(F.col(self.col(split)).isNotNull()), x.names, x.maybe - {split})

            def open_(x: Solution) -> Solution:
                x = self.bare(x, [split])
                df = x.df.where(F.col(self.col(split)).isNull()).drop(self.col(split))
                return Solution(df, [n for n in x.names if n != split], x.maybe - {split})

            parts = [self.join(known(a), known(b))]
            if split in a.maybe:
                parts.append(self.join(open_(a), b))
            if split in b.maybe:
                parts.append(self.join(known(a), open_(b)))
            return self.union(parts)
        if not b.names:
            return Solution(a.df.crossJoin(b.df.select(F.lit(1).alias("unit"))).select(*a.df.columns), a.names, a.maybe)
        b = self.bare(b, [n for n in shown(a.names) if HIDDEN + n in a.names])
        left, right, shared, condition, out, _ = self._sides(a, b)
        df = left.crossJoin(right) if condition is None else left.join(right, condition)
        maybe = {n for n in a.maybe | b.maybe if n not in shared or (n in a.maybe and n in b.maybe)}
        return Solution(df.select(*out), [*a.names, *[n for n in b.names if n not in a.names]], frozenset(maybe))

    def merged(self, a: Solution, b: Solution) -> dict[str, Column]:
        """Each variable's column in a join of a with b's renamed columns."""
        out = {n: F.col(self.col(n)) for n in a.names}
        for n in b.names:
            if n in out and n.startswith(HIDDEN):
                continue
            right = F.col(self.col(n) + "_r")
            out[n] = F.coalesce(out[n], right) if n in a.maybe else out.get(n, right)
        return out

    def rows_of(self, a: Solution) -> tuple[Solution, str]:
        """a with a hidden variable that tells its rows apart; they are kept as a table, since a row's number must not change."""
        row = f".row{len(self.ids)}"
        kept = Store(self.spark, "solutions").save(a.df.withColumn(self.col(row), F.monotonically_increasing_id().cast("string")))
        return Solution(kept, [*a.names, row], a.maybe), row

    def matches(self, a: Solution, b: Solution, filters: list[Expr] = ()) -> Solution:
        """The join of a and b that passes the filters."""
        joined = self.join(a, b)
        env = {n: F.col(self.col(n)) for n in joined.names}
        df = joined.df
        for f in filters:
            df = df.where(truth(self.expr(f, env)))
        return Solution(df, joined.names, joined.maybe)

    def unsure(self, a: Solution, b: Solution) -> bool:
        """Whether a variable that both have may be unbound: such a join is split by what is bound, and its rows are marked."""
        return any(n in a.maybe or n in b.maybe for n in shown(a.names) if n in b.names)

    def optional(self, a: Solution, group: Group) -> Solution:
        inner, filters = self.group(group, defer=True)
        inner = self.bare(inner, a.names)
        new = [n for n in inner.names if n not in a.names]
        maybe = frozenset(a.maybe | set(new))
        if self.unsure(a, inner):
            marked, row = self.rows_of(a)
            found = self.matches(marked, inner, filters)
            rest = marked.df.join(found.df.select(self.col(row)).distinct(), self.col(row), "left_anti")
            both = self.union([Solution(found.df, found.names, found.maybe), Solution(rest, marked.names, a.maybe)])
            return Solution(both.df.drop(self.col(row)), [n for n in both.names if n != row], maybe & frozenset(both.names))
        left, right, _, condition, out, _ = self._sides(a, inner)
        for f in filters:
            test = truth(self.expr(f, self.merged(a, inner)))
            condition = test if condition is None else condition & test
        df = left.join(right, F.lit(True) if condition is None else condition, "left")
        return Solution(df.select(*out) if out else df, [*a.names, *new], maybe)

    def exists(self, a: Solution, group: Group, how: str) -> Solution:
        inner, filters = self.group(group, defer=True)
        if self.unsure(a, inner):
            marked, row = self.rows_of(a)
            found = self.matches(marked, inner, filters).df.select(self.col(row)).distinct()
            return Solution(marked.df.join(found, self.col(row), how).drop(self.col(row)), a.names, a.maybe)
        left, right, _, condition, _, _ = self._sides(a, inner)
        for f in filters:
            test = truth(self.expr(f, self.merged(a, inner)))
            condition = test if condition is None else condition & test
        return Solution(left.join(right, F.lit(True) if condition is None else condition, how), a.names, a.maybe)

    def minus(self, a: Solution, group: Group) -> Solution:
        b = self.group(group)[0]
        b = self.bare(b, shown(b.names))
        shared = [n for n in a.names if n in b.names]
        if not shared:
            return a
        if self.unsure(a, b):  # what is taken away must be bound on both sides in one variable at least
            flagged = lambda x, side: Solution(x.df.select("*", *[F.col(self.col(n)).isNotNull().cast("string").alias(self.col(f".{side}{n}")) for n in shared]), [*x.names, *[f".{side}{n}" for n in shared]], x.maybe)
            marked, row = self.rows_of(a)
            found = self.join(flagged(marked, "left"), flagged(b, "right")).df
            both = reduce(Column.__or__, [(F.col(self.col(f".left{n}")) == "true") & (F.col(self.col(f".right{n}")) == "true") for n in shared])
            gone = found.where(both).select(self.col(row)).distinct()
            return Solution(marked.df.join(gone, self.col(row), "left_anti").drop(self.col(row)), a.names, a.maybe)
        left, right, _, condition, _, _ = self._sides(a, b)
        return Solution(left.join(right, condition, "left_anti"), a.names, a.maybe)

    def union(self, branches: list[Solution]) -> Solution:
        names = list(dict.fromkeys(n for b in branches for n in b.names))
        lost = [n for n in shown(names) if any(n in b.names and HIDDEN + n not in b.names for b in branches)]
        branches = [self.bare(b, lost) for b in branches]
        names = [n for n in names if n not in {HIDDEN + x for x in lost}]
        none = lambda n: F.lit(None).cast(NUM if n.startswith(HIDDEN) else "string")
        frames = [b.df.select(*[(F.col(self.col(n)) if n in b.names else none(n)).alias(self.col(n)) for n in names] or [F.lit(1).alias("unit")]) for b in branches]
        maybe = {n for n in names for b in branches if n not in b.names or n in b.maybe}
        return Solution(reduce(DataFrame.union, frames), names, frozenset(maybe))

    def group(self, group: Group, defer: bool = False) -> tuple[Solution, list[Expr]]:
        """The solutions of a group; with defer, its own filters are handed back unapplied."""
        out, patterns, filters = self.unit(), [], []

        def flush() -> None:
            nonlocal out, patterns
            if patterns:
                out = self.join(out, self.basic(patterns))
                patterns = []

        for kind, *args in group.parts:
            if kind == "triple":
                patterns.append(args[0])
                continue
            if kind == "filter":
                filters.append(args[0])
                continue
            flush()
            if kind == "optional":
                out = self.optional(out, args[0])
            elif kind == "minus":
                out = self.minus(out, args[0])
            elif kind == "union":
                out = self.join(out, self.union([self.group(g)[0] for g in args[0]]))
            elif kind == "group":
                out = self.join(out, self.group(args[0])[0])
            elif kind == "select":
                out = self.join(out, self.select(args[0]))
            elif kind == "values":
                out = self.join(out, self.inline(*args))
            elif kind == "bind":
                name, e = args
                if name in out.names:
                    raise QueryError(f"?{name} is bound already")
                out, e = self.marked(out, e)
                out = self.put(out, name, self.expr(e, self.env(out)))
        flush()
        if defer:
            return out, filters
        for f in filters:
            out = self.filter(out, f)
        return out, []

    def marked(self, a: Solution, e: Expr) -> tuple[Solution, Expr]:
        """a with a hidden truth column for each EXISTS inside an expression, and the expression over those."""
        if e.op in ("exists", "not exists"):
            name = f".exists{len(self.ids)}"
            keys = [self.col(n) for n in shown(a.names)]
            mark = self.col(name)
            # solutions that agree in all variables agree in this too
            rows = self.exists(Solution(a.df.select(*keys).distinct(), shown(a.names), a.maybe), e.args[0], "left_semi").df.select(*[F.col(k).alias(k + "_e") for k in keys], F.lit(True).alias(mark))
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(k + "_e")) for k in keys], F.lit(True))
            held = F.coalesce(F.col(mark), F.lit(False))
            df = a.df.join(rows, same, "left").select(*a.df.columns, (held if e.op == "exists" else ~held).alias(mark))
            return Solution(df, a.names, a.maybe), Expr("done", [Val("bool", F.col(mark))])
        args = []
        for x in e.args:
            if isinstance(x, Expr):
                a, x = self.marked(a, x)
            args.append(x)
        return a, Expr(e.op, args, e.extra)

    def filter(self, a: Solution, f: Expr) -> Solution:
        if f.op == "and":
            return reduce(self.filter, f.args, a)
        if f.op == "not" and f.args[0].op in ("exists", "not exists"):
            f = Expr("exists" if f.args[0].op == "not exists" else "not exists", f.args[0].args)
        if f.op == "exists":
            return self.exists(a, f.args[0], "left_semi")
        if f.op == "not exists":
            return self.exists(a, f.args[0], "left_anti")
        a, f = self.marked(a, f)
        return Solution(a.df.where(truth(self.expr(f, self.env(a)))), a.names, a.maybe)

    def inline(self, names: list[str], rows: list[list[str | None]]) -> Solution:
        schema = ", ".join(f"{self.col(n)} string" for n in names)
        maybe = {n for i, n in enumerate(names) if any(r[i] is None for r in rows)}
        return Solution(self.spark.createDataFrame([tuple(r) for r in rows], schema), names, frozenset(maybe))

    def env(self, a: Solution) -> dict[str, Column]:
        return {n: F.col(self.col(n)) for n in a.names}

    # expressions

    def expr(self, e: Expr, env: dict[str, Column]) -> Val:
        if e.op == "var":
            return Val("term", env.get(e.args[0], F.lit(None).cast("string")), env.get(HIDDEN + e.args[0]))
        if e.op == "const":
            return constant(e.args[0])
        if e.op == "done":
            return e.args[0]
        if e.op in ("exists", "not exists"):
            raise QueryError("EXISTS stands in a filter or a BIND")
        if e.op == "aggregate":
            raise QueryError("an aggregate stands outside of a grouped SELECT")
        if e.op == "call" and e.extra["name"] == "BOUND":
            return Val("bool", self.expr(e.args[0], env).col.isNotNull())
        args = [self.expr(x, env) for x in e.args]
        if e.op == "or":
            return Val("bool", truth(args[0]) | truth(args[1]))
        if e.op == "and":
            return Val("bool", truth(args[0]) & truth(args[1]))
        if e.op == "not":
            return Val("bool", ~truth(args[0]))
        if e.op in ("=", "!=", "<", ">", "<=", ">="):
            return Val("bool", compare(e.op, *args))
        if e.op == "in":
            return Val("bool", reduce(Column.__or__, [compare("=", args[0], x) for x in args[1:]], F.lit(False)))
        if e.op == "neg":
            return Val(args[0].kind if args[0].kind == "int" else "num", -number(args[0]))
        if e.op in ("+", "-", "*", "/"):
            a, b = map(number, args)
            if e.op == "/":
                return Val("num", F.try_divide(a.cast("double"), b.cast("double")))
            made = {"+": a + b, "-": a - b, "*": a * b}[e.op]
            if {x.kind for x in args} <= {"int", "num"}:
                return Val("int" if {x.kind for x in args} == {"int"} else "num", made)
            # whole numbers stay whole; which they are shows only in the terms
            whole = whole_number(args[0]) & whole_number(args[1])
            num = F.struct(made.cast("double").alias("value"), whole.alias("whole"), F.when(whole, made.cast("bigint")).alias("exact"))
            code = F.when(whole, term(Val("int", made.cast("bigint")))).otherwise(term(Val("num", made.cast("double"))))
            return Val("term", code, F.when(made.isNotNull(), num))
        if e.op == "cast":
            return self.cast(e.extra["to"], args[0])
        return self.call(e.extra["name"], args)

    def cast(self, to: str, v: Val) -> Val:
        s, name = string(v), to.removeprefix(XSD)
        if name in ("integer", "int", "long"):
            return Val("int", F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint")))
        if name in ("double", "float", "decimal"):
            return Val("num", s.try_cast("double"))
        if name == "boolean":
            return Val("bool", s.try_cast("boolean"))
        if name == "string":
            return Val("str", s)
        raise QueryError(f"unknown function {to}")

    def call(self, name: str, a: list[Val]) -> Val:
        def flags(v: list[Val], at: int) -> Column:
            return F.concat(F.lit("(?"), string(v[at]), F.lit(")")) if len(v) > at else F.lit("")

        def same_kind(text: Column) -> Val:
            """A string result keeps its argument's language."""
            if a[0].kind != "term":
                return Val("str", text)
            t = tail(a[0].col)
            return Val("term", F.concat(F.lit('"'), text, F.lit('"'), F.when(F.startswith(t, F.lit("@")), t).otherwise("")))

        def zone(text: Column) -> Column:
            return F.regexp_extract(text, r"T\d\d:\d\d:\d\d(?:\.\d+)?(Z|[+-]\d\d:\d\d)?$", 1)

        def duration(text: Column) -> Column:
            """An offset as a day-time duration."""
            z = zone(text)
            part = lambda n, unit: F.when(F.substring(z, n, 2) != "00", F.concat(F.regexp_replace(F.substring(z, n, 2), "^0", ""), F.lit(unit))).otherwise("")
            said = F.concat(F.when(F.startswith(z, F.lit("-")), F.lit("-")).otherwise(""), F.lit("PT"), part(2, "H"), part(5, "M"))
            return F.when(z.isin("Z", "+00:00", "-00:00"), F.lit("PT0S")).when(z != "", said)

        none = {
            "NOW": lambda: Val("term", F.concat(F.lit('"'), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(f'"^^{XSD}dateTime'))),
            "RAND": lambda: Val("num", F.rand()),
            "UUID": lambda: Val("term", F.concat(F.lit("urn:uuid:"), F.uuid())),
            "STRUUID": lambda: Val("str", F.uuid()),
            "BNODE": lambda: Val("term", F.concat(F.lit("_:u"), F.replace(F.uuid(), F.lit("-"), F.lit("")))),
        }
        one = {
            "BNODE": lambda: Val("term", F.concat(F.lit("_:s"), F.sha2(string(a[0]).cast("binary"), 256))),
            "TZ": lambda: Val("str", F.when(string(a[0]).rlike("T"), zone(string(a[0])))),
            "TIMEZONE": lambda: Val("term", F.concat(F.lit('"'), duration(string(a[0])), F.lit(f'"^^{XSD}dayTimeDuration'))),
            "STR": lambda: Val("str", string(a[0])),
            "LANG": lambda: Val("str", language_of(term(a[0]))),
            "DATATYPE": lambda: Val("term", datatype_of(term(a[0]))),
            "IRI": lambda: Val("term", string(a[0])),
            "URI": lambda: Val("term", string(a[0])),
            "ISIRI": lambda: Val("bool", ~is_literal(term(a[0])) & ~is_blank(term(a[0]))),
            "ISURI": lambda: Val("bool", ~is_literal(term(a[0])) & ~is_blank(term(a[0]))),
            "ISLITERAL": lambda: Val("bool", is_literal(term(a[0]))),
            "ISBLANK": lambda: Val("bool", is_blank(term(a[0]))),
            "ISNUMERIC": lambda: Val("bool", number(a[0]).isNotNull()),
            "STRLEN": lambda: Val("int", F.length(string(a[0])).cast("bigint")),
            "UCASE": lambda: same_kind(F.upper(string(a[0]))),
            "LCASE": lambda: same_kind(F.lower(string(a[0]))),
            "ABS": lambda: Val("int" if a[0].kind == "int" else "num", F.abs(number(a[0]))),
            "CEIL": lambda: Val("int", F.ceil(number(a[0]))),
            "FLOOR": lambda: Val("int", F.floor(number(a[0]))),
            "ROUND": lambda: Val("int", F.floor(number(a[0]) + 0.5)),
            "YEAR": lambda: Val("int", F.regexp_extract(string(a[0]), r"^(-?\d+)", 1).try_cast("bigint")),
            "MONTH": lambda: Val("int", F.regexp_extract(string(a[0]), r"^-?\d+-(\d\d)", 1).try_cast("bigint")),
            "DAY": lambda: Val("int", F.regexp_extract(string(a[0]), r"^-?\d+-\d\d-(\d\d)", 1).try_cast("bigint")),
            "HOURS": lambda: Val("int", F.regexp_extract(string(a[0]), r"T(\d\d)", 1).try_cast("bigint")),
            "MINUTES": lambda: Val("int", F.regexp_extract(string(a[0]), r"T\d\d:(\d\d)", 1).try_cast("bigint")),
            "SECONDS": lambda: Val("num", F.regexp_extract(string(a[0]), r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1).try_cast("double")),
            "ENCODE_FOR_URI": lambda: Val("str", F.replace(F.url_encode(string(a[0])), F.lit("+"), F.lit("%20"))),
            "MD5": lambda: Val("str", F.md5(string(a[0]).cast("binary"))),
            "SHA1": lambda: Val("str", F.sha1(string(a[0]).cast("binary"))),
            "SHA256": lambda: Val("str", F.sha2(string(a[0]).cast("binary"), 256)),
            "SHA384": lambda: Val("str", F.sha2(string(a[0]).cast("binary"), 384)),
            "SHA512": lambda: Val("str", F.sha2(string(a[0]).cast("binary"), 512)),
        }
        many = {
            "CONTAINS": lambda: Val("bool", F.contains(string(a[0]), string(a[1]))),
            "STRSTARTS": lambda: Val("bool", F.startswith(string(a[0]), string(a[1]))),
            "STRENDS": lambda: Val("bool", F.endswith(string(a[0]), string(a[1]))),
            "STRBEFORE": lambda: same_kind(F.when(F.instr(string(a[0]), string(a[1])) > 0, F.substr(string(a[0]), F.lit(1), F.instr(string(a[0]), string(a[1])) - 1)).otherwise("")),
            "STRAFTER": lambda: same_kind(F.when(F.instr(string(a[0]), string(a[1])) > 0, F.substr(string(a[0]), F.instr(string(a[0]), string(a[1])) + F.length(string(a[1])))).otherwise("")),
            "SUBSTR": lambda: same_kind(F.substr(string(a[0]), number(a[1]).cast("int"), number(a[2]).cast("int")) if len(a) > 2 else F.substr(string(a[0]), number(a[1]).cast("int"))),
            "CONCAT": lambda: Val("str", F.concat(*map(string, a)) if a else F.lit("")),
            "REPLACE": lambda: same_kind(F.regexp_replace(string(a[0]), F.concat(flags(a, 3), string(a[1])), string(a[2]))),
            "REGEX": lambda: Val("bool", F.rlike(string(a[0]), F.concat(flags(a, 2), string(a[1])))),
            "COALESCE": lambda: Val("term", F.coalesce(*map(term, a))),
            "IF": lambda: Val("term", F.when(truth(a[0]), term(a[1])).when(~truth(a[0]), term(a[2]))),
            "SAMETERM": lambda: Val("bool", term(a[0]) == term(a[1])),
            "STRDT": lambda: Val("term", F.concat(F.lit('"'), string(a[0]), F.lit('"^^'), string(a[1]))),
            "STRLANG": lambda: Val("term", F.concat(F.lit('"'), string(a[0]), F.lit('"@'), string(a[1]))),
            "LANGMATCHES": lambda: Val("bool", F.when(string(a[1]) == "*", string(a[0]) != "").otherwise((F.lower(string(a[0])) == F.lower(string(a[1]))) | F.startswith(F.lower(string(a[0])), F.concat(F.lower(string(a[1])), F.lit("-"))))),
        }
        least = {"REPLACE": 3, "IF": 3, "CONCAT": 0, "COALESCE": 1}
        try:
            if name in none and not a:
                return none[name]()
            if name in one and len(a) == 1:
                return one[name]()
            if name in many and len(a) >= least.get(name, 2):
                return many[name]()
        except IndexError:
            pass
        raise QueryError(f"unknown function {name} of {len(a)} arguments")

    # SELECT

    def aggregate(self, e: Expr, env: dict[str, Column]) -> Val:
        name, distinct = e.extra["name"], e.extra["distinct"]
        if not e.args:
            if name != "COUNT":
                raise QueryError(f"{name}(*) is not an aggregate")
            return Val("int", F.count_distinct(F.struct(*[env[n] for n in shown(list(env))])) if distinct else F.count(F.lit(1)))
        v = self.expr(e.args[0], env)
        c = term(v)
        if name == "COUNT":
            return Val("int", F.count_distinct(c) if distinct else F.count(c))
        if name in ("MIN", "MAX"):
            num = [] if beside(v) is None else [beside(v).alias("num")]
            key = F.when(c.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order_keys(v))], c.alias("c"), *num))
            best = (F.min if name == "MIN" else F.max)(key)
            return Val("term", best["c"], best["num"] if num else None)
        if name == "SAMPLE":
            return Val("term", F.min(c))
        if name == "GROUP_CONCAT":
            items = F.collect_set(lexical(c)) if distinct else F.collect_list(lexical(c))
            return Val("str", F.array_join(F.sort_array(items), e.extra["separator"]))
        n = number(v)
        if name == "AVG":
            return Val("num", F.coalesce(F.try_divide(F.sum_distinct(n), F.count_distinct(n)) if distinct else F.avg(n), F.lit(0.0)))
        num = beside(v)
        whole = F.coalesce(F.min(typed(c, WHOLE) if num is None else num["whole"]), F.lit(True))
        exact = digits(c).try_cast("bigint") if num is None else num["exact"]
        total = F.sum_distinct if distinct else F.sum
        code = F.when(whole, F.concat(F.lit('"'), F.coalesce(total(exact), F.lit(0)).cast("string"), F.lit(f'"^^{XSD}integer')))
        code = code.otherwise(F.concat(F.lit('"'), total(n).cast("string"), F.lit(f'"^^{XSD}double')))
        value = F.when(whole, F.coalesce(total(exact), F.lit(0)).cast("double")).otherwise(total(n))
        return Val("term", code, F.struct(value.alias("value"), whole.alias("whole"), F.when(whole, F.coalesce(total(exact), F.lit(0))).alias("exact")))

    def select(self, q: Select) -> Solution:
        a = self.group(q.where)[0]
        if q.values:
            a = self.join(a, self.inline(*q.values))
        names = [n for n, _ in q.items] or [n for n in a.names if not n.startswith(".")]
        if len(set(names)) != len(names):
            raise QueryError("a variable is selected twice")
        items, having, order = [(n, e) for n, e in q.items], list(q.having), list(q.order_by)
        found: list[Expr] = []

        def lift(e: Expr) -> Expr:
            """Each aggregate becomes a column of the grouped frame."""
            if e.op == "aggregate":
                found.append(e)
                return Expr("lifted", [len(found) - 1])
            return Expr(e.op, [lift(x) if isinstance(x, Expr) else x for x in e.args], e.extra)

        items = [(n, lift(e) if e is not None else None) for n, e in items]
        having, order = [lift(e) for e in having], [(lift(e), down) for e, down in order]
        if found or q.group_by:
            env = self.env(a)
            keys = [(n, term(self.expr(e, env)).alias(self.col(n))) for n, e in q.group_by]
            vals = [self.aggregate(e, env) for e in found]
            columns = [v.col.alias(f"agg{i}") for i, v in enumerate(vals)] or [F.count(F.lit(1)).alias("agg")]
            columns += [v.num.alias(f"agg{i}_num") for i, v in enumerate(vals) if v.num is not None]
            df = a.df.groupBy(*[c for _, c in keys]).agg(*columns)
            grouped = [n for n, _ in keys]
            for n, e in items:
                if e is None and n not in grouped:
                    raise QueryError(f"?{n} is neither grouped nor aggregated")
            a = Solution(df, grouped, a.maybe & set(grouped))

            def settle(e: Expr) -> Expr:
                if e.op == "lifted":
                    v = vals[e.args[0]]
                    num = None if v.num is None else F.col(f"agg{e.args[0]}_num")
                    return Expr("done", [Val(v.kind, F.col(f"agg{e.args[0]}"), num)])
                return Expr(e.op, [settle(x) if isinstance(x, Expr) else x for x in e.args], e.extra)

            items = [(n, settle(e) if e is not None else None) for n, e in items]
            having, order = [settle(e) for e in having], [(settle(e), down) for e, down in order]
            for h in having:
                a = Solution(a.df.where(truth(self.expr(h, self.env(a)))), a.names, a.maybe)
        made = []
        for n, e in items:
            if e is not None:
                if n in a.names:
                    raise QueryError(f"?{n} is bound already")
                a = self.put(a, n, self.expr(e, self.env(a)))
                made.append(n)
        df = a.df
        keys = []
        for i, (e, down) in enumerate(order):
            for j, k in enumerate(order_keys(self.expr(e, self.env(a)))):
                df = df.withColumn(f"sort{i}_{j}", k)
                keys.append(F.col(f"sort{i}_{j}").desc_nulls_last() if down else F.col(f"sort{i}_{j}").asc_nulls_first())
        for n in names:
            if n not in a.names:  # selected but nowhere bound
                df = df.withColumn(self.col(n), F.lit(None).cast("string"))
        if not q.distinct:
            names = names + [HIDDEN + n for n in names if HIDDEN + n in a.names]
        out = [self.col(n) for n in names]
        if q.distinct:
            df = df.groupBy(*out).agg(*[F.min(c).alias(c) for c in df.columns if c.startswith("sort")]) if keys else df.select(*out).distinct()
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solution(df.select(*out), names, frozenset(n for n in names if n in a.maybe or n not in a.names))


def sparql(graph: DataFrame, text: str, prefixes: dict[str, str] | None = None, known: Statistics | None = None, rows: list[Rows] | None = None) -> DataFrame:
    """The rows of a SELECT: one string column a variable, null where unbound. known: statistics of this very graph; rows: the tables that it is made of.

    The text is parsed and analysed before any row is made; an error is a QueryError. An ASK
    has no rows of this kind and gives an empty frame; other forms are errors.
    """
    query = parse(text, {"rdf": RDF, "xsd": XSD, **(prefixes or {})})
    compiler = Compiler(graph, known, rows)
    compiler.asked = asked(query)
    if query.form == "ask":
        compiler.group(query.where)
        return graph.sparkSession.createDataFrame([], "ask string")
    found = compiler.select(query)
    return found.df.select(*[lexical(F.col(compiler.col(n))).alias(n) for n in shown(found.names)])
