"""What a graph is known to hold, so that patterns can be joined in a good order and stars read in one pass.

Of each predicate: its triples, subjects, objects (an estimate) and the most triples that one subject
has of it. Of each characteristic set, which is the set of predicates that a subject has: its subjects.
Both are counted over the whole graph and kept beside a stored one. Orders follow the estimates;
results never do. Only the ``LARGEST`` predicates and sets are kept, so the driver holds a bounded number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store
from .parser import Const, Path, Pattern, Var

LARGEST = 10_000
#: A star's members are grouped by subject only where no subject has more triples of any of them.
MOST = 64
#: A member this much smaller than another is better joined first: it may be broadcast.
UNEVEN = 20


@dataclass(frozen=True)
class Predicate:
    rows: int
    subjects: int
    objects: int
    most: int | None = None  # unknown where the predicate is


@dataclass
class Statistics:
    predicates: dict[str, Predicate]
    sets: list[tuple[frozenset[str], int]] = field(default_factory=list)

    @property
    def total(self) -> int:
        return max(sum(p.rows for p in self.predicates.values()), 1)

    def of(self, iri: str) -> Predicate:
        """An unknown predicate is one of those too rare to keep, or none at all."""
        return self.predicates.get(iri, Predicate(1, 1, 1))

    def subjects_with(self, iris: set[str]) -> int:
        """Subjects that have all of these predicates."""
        found = sum(n for has, n in self.sets if iris <= has)
        return found or min(self.of(i).subjects for i in iris)


def predicates(graph: DataFrame) -> DataFrame:
    """(p, rows, subjects, objects, most) of each predicate."""
    pairs = graph.groupBy("p", "s").agg(F.count("*").alias("n"))
    counts = pairs.groupBy("p").agg(F.sum("n").alias("rows"), F.count("*").alias("subjects"), F.max("n").alias("most"))
    values = graph.groupBy("p").agg(F.approx_count_distinct(F.struct("o", "o_kind", "o_dt", "o_lang")).alias("objects"))
    return counts.join(values, "p").select("p", "rows", "subjects", "objects", "most")


def characteristic_sets(graph: DataFrame) -> DataFrame:
    """(predicates, subjects): each set of predicates that a subject has, and how many have just it."""
    of_subject = graph.groupBy("s").agg(F.array_sort(F.collect_set("p")).alias("predicates"))
    return of_subject.groupBy("predicates").agg(F.count("*").alias("subjects"))


def collected(one: DataFrame, sets: DataFrame) -> Statistics:
    """The largest rows of the two tables, as the compiler uses them."""
    rows = one.orderBy(F.desc("rows"), "p").limit(LARGEST).collect()
    stars = sets.orderBy(F.desc("subjects"), "predicates").limit(LARGEST).collect()
    return Statistics({r.p: Predicate(r["rows"], r.subjects, r.objects, r.most) for r in rows}, [(frozenset(r.predicates), r.subjects) for r in stars])


def measure(graph: DataFrame) -> Statistics:
    """The statistics of a graph, counted now."""
    store = Store(graph.sparkSession, "statistics")
    return collected(store.save(predicates(graph)), store.save(characteristic_sets(graph)))


def save_statistics(graph: DataFrame, path: str) -> None:
    """Counts a stored graph and keeps the counts beside it, where no scan of the graph looks."""
    predicates(graph).coalesce(1).write.mode("overwrite").parquet(f"{path}/_statistics/predicates")
    characteristic_sets(graph).write.mode("overwrite").parquet(f"{path}/_statistics/sets")


def load_statistics(spark: SparkSession, path: str) -> Statistics:
    return collected(*[spark.read.parquet(f"{path}/_statistics/{name}") for name in ("predicates", "sets")])


# estimates


def names(p: Pattern) -> list[str]:
    return [t.name for t in (p.s, p.p, p.o) if isinstance(t, Var)]


@dataclass
class Estimate:
    """Rows expected of a solution, and distinct values expected of each of its variables."""

    rows: float
    values: dict[str, float]

    def joined(self, other: Estimate) -> Estimate:
        rows = self.rows * other.rows
        for v in self.values.keys() & other.values.keys():
            rows /= max(self.values[v], other.values[v], 1)
        both = self.values | {v: min(n, self.values.get(v, n)) for v, n in other.values.items()}
        return Estimate(rows, {v: min(n, max(rows, 1)) for v, n in both.items()})


def _leaves(path: Path) -> list[str]:
    return [path.iri] if path.kind == "iri" else [i for x in path.parts if isinstance(x, Path) for i in _leaves(x)]


def of_pattern(known: Statistics, p: Pattern) -> Estimate:
    """A pattern's rows: its predicate's, shared out evenly among subjects and objects where those are given."""
    if isinstance(p.p, Const):
        one = known.of(p.p.code)
    elif isinstance(p.p, Path):
        rows = sum(known.of(i).rows for i in _leaves(p.p)) or known.total
        rows *= 10 if p.p.kind in ("plus", "star") else 1
        one = Predicate(rows, max(rows // 10, 1), max(rows // 10, 1))
    else:
        one = Predicate(known.total, max(sum(n for _, n in known.sets), 1), max(known.total // 2, 1))
    rows = float(one.rows)
    if isinstance(p.s, Const):
        rows /= max(one.subjects, 1)
    if isinstance(p.o, Const):
        rows /= max(one.objects, 1)
    values = {t.name: min(float(n), max(rows, 1)) for t, n in ((p.s, one.subjects), (p.o, one.objects)) if isinstance(t, Var)}
    if isinstance(p.p, Var):
        values[p.p.name] = float(len(known.predicates) or 1)
    return Estimate(rows, values)


def of_star(known: Statistics, star: list[Pattern]) -> Estimate:
    """A star's rows, from the sets that hold all its predicates."""
    subjects = rows = float(known.subjects_with({p.p.code for p in star}))
    values = {}
    for p in star:
        one = known.of(p.p.code)
        if isinstance(p.o, Const):
            rows /= max(one.objects, 1)
            subjects /= max(one.objects, 1)
        else:
            rows *= one.rows / max(one.subjects, 1)
            values[p.o.name] = float(one.objects)
    return Estimate(rows, {v: min(n, max(rows, 1)) for v, n in values.items()} | {star[0].s.name: max(subjects, 1)})


def units(known: Statistics, patterns: list[Pattern]) -> list[list[Pattern]]:
    """The patterns, those of a star that can be read in one pass together.

    A member has a given predicate, one of its own, and an object that no other pattern of the star has. No
    subject has more than ``MOST`` triples of it, so a subject's rows are a bounded group however the graph is
    skewed; and none is so much smaller than another that joining it first would be cheaper.
    """
    left, out = list(patterns), []
    while left:
        first = left.pop(0)
        star: list[Pattern] = []
        for p in [first, *left]:
            taken = {q.p.code for q in star} | {q.o.name for q in star if isinstance(q.o, Var)}
            if not (isinstance(p.s, Var) and p.s == first.s and isinstance(p.p, Const)):
                continue
            mine = p.o.name if isinstance(p.o, Var) else None
            most = known.of(p.p.code).most
            if p.p.code not in taken and mine not in {p.s.name, *taken} and most is not None and most <= MOST:
                star.append(p)
        sizes = [of_pattern(known, p).rows for p in star]
        if first in star and len(star) > 1 and max(sizes) <= UNEVEN * max(min(sizes), 1):
            left = [p for p in left if not any(p is q for q in star)]
            out.append(star)
        else:
            out.append([first])
    return out


def ordered(known: Statistics, patterns: list[Pattern]) -> list[list[Pattern]]:
    """The units in the order to join them: the smallest first, then always the linked one that keeps the result smallest."""
    left = [(u, of_star(known, u) if len(u) > 1 else of_pattern(known, u[0])) for u in units(known, patterns)]
    out, so_far = [], None
    while left:
        linked = [x for x in left if so_far and x[1].values.keys() & so_far.values.keys()] or left
        best = min(linked, key=lambda x: (so_far.joined(x[1]) if so_far else x[1]).rows)
        left = [x for x in left if x is not best]
        so_far = so_far.joined(best[1]) if so_far else best[1]
        out.append(best[0])
    return out
