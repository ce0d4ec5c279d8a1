"""Interval joins by dyadic cells: equi-joins only, each pair once.

Two intervals overlap exactly if one begins inside the other. So overlaps are two joins of
points with intervals. An interval is cut into the few largest aligned cells (of 1, 2, 4, ...
units) that cover it and no two of which overlap; a point lies in one cell of each size. Equal cells
meet in an equi-join, and of all cells of a point exactly one is an interval's if it lies inside. Rows
grow with the logarithm of the range, not with the length of intervals or the square of their number.

The pairs themselves may grow with that square, so where only their count and sums are asked for,
``overlap_totals`` makes none: of the spans that begin no later than another one's end all overlap it but those
that end before its begin. Both are sums up to a place, which the few cells before that place add up to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = "struct<level: int, at: bigint>"


def _cells(low: Column, high: Column, levels: int) -> Column:
    """The cells that cover low to high, both within it, of numbers from 0."""
    size = lambda level: F.pow(F.lit(2.0), level)
    first = lambda level: F.ceil(low / size(level)).cast("long")
    behind = lambda level: F.floor((high + 1) / size(level)).cast("long")

    def at_level(level: Column) -> Column:
        left = F.when(first(level) % 2 == 1, F.struct(level.alias("level"), first(level).alias("at")))
        right = F.when(behind(level) % 2 == 1, F.struct(level.alias("level"), (behind(level) - 1).alias("at")))
        # the last cell left is not given from both sides
        both = F.array(left, F.when((behind(level) - 1 > first(level)) | (first(level) % 2 == 0), right))
        return F.when(first(level) < behind(level), both).otherwise(F.array().cast(f"array<{CELL}>"))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at_level))
    return F.filter(found, lambda c: c.isNotNull())


def _path(at: Column, levels: int) -> Column:
    """The cells that a point lies in."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), F.floor(at / F.pow(F.lit(2.0), level)).cast("long").alias("at")))


def _placed(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str]) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the ends of their spans as numbers from 0, without spans that hold no number, and the levels of cells."""
    bounds = [df.agg(F.least(F.min(lo), F.min(hi)).alias("lo"), F.greatest(F.max(lo), F.max(hi)).alias("hi")) for df, (lo, hi) in ((a, a_span), (b, b_span))]
    low, high = bounds[0].union(bounds[1]).agg(F.min("lo"), F.max("hi")).first()
    low, high = (0, 0) if low is None else (int(low), int(high))

    def placed(df: DataFrame, span: tuple[str, str], mark: str) -> DataFrame:
        lo, hi = (F.coalesce(F.col(c).cast("long"), F.lit(x)) - low for c, x in zip(span, (low, high), strict=True))
        return df.withColumn(f"__lo{mark}", lo).withColumn(f"__hi{mark}", hi).where(F.col(f"__lo{mark}") <= F.col(f"__hi{mark}"))

    return placed(a, a_span, "a"), placed(b, b_span, "b"), max((high - low + 1).bit_length(), 1)


def overlaps(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """All columns of a and b for each pair whose spans of whole numbers, ends included, share a number.

    A null end is open. A span that ends before it begins has no number and overlaps none. Columns must not
    clash; repeated rows give their pairs again; an empty side gives an empty result.
    """
    names = [*a.columns, *b.columns]
    if len(set(names)) < len(names):
        raise ValueError("columns of both sides must differ")
    left, right, levels = _placed(a, b, a_span, b_span)

    def inside(points: DataFrame, p: str, whole: DataFrame, w: str, strict: bool) -> DataFrame:
        """Pairs whose point, the begin of a span, is in the other span; with strict, behind the other's begin."""
        begin = F.col(f"__lo{w}") + (1 if strict else 0)
        cut = whole.withColumn("__c", F.explode(_cells(begin, F.col(f"__hi{w}"), levels)))
        at = points.withColumn("__d", F.explode(_path(F.col(f"__lo{p}"), levels)))
        return at.join(cut, (F.col("__c.level") == F.col("__d.level")) & (F.col("__c.at") == F.col("__d.at"))).select(*names)

    return inside(right, "b", left, "a", False).union(inside(left, "a", right, "b", True))


def overlap_totals(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Each row of a that overlaps rows of b, with their number as n and the sums of b's named columns of whole numbers.

    The same as ``overlaps`` grouped by rows of a, without its pairs: rows grow with the sides and the logarithm
    of the range. A sum without a value is null.
    """
    names = [*a.columns, "n", *sums]
    if len(set(names)) < len(names):
        raise ValueError("columns of a, n and the sums must differ")
    left, right, levels = _placed(a, b, a_span, b_span)
    parts = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(sums):  # differences of larger sums, which need not fit in a long
        parts += [F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"__s{i}"), F.count(c).alias(f"__k{i}")]
    facts = ["__n", *[f"__{x}{i}" for i in range(len(sums)) for x in "sk"]]
    added = [F.sum(c).cast("decimal(38,0)" if c.startswith("__s") else "long").alias(c) for c in facts]

    def up_to(asked: Column, point: str, mark: str) -> DataFrame:
        """(asked, facts): of each place asked for, the facts of b's spans whose point is there or before."""
        at = right.groupBy(F.col(point).alias("__at")).agg(*parts).withColumn("__c", F.explode(_path(F.col("__at"), levels)))
        cells = at.groupBy(F.col("__c.level").alias("level"), F.col("__c.at").alias("at")).agg(*added)
        places = left.select(asked.alias("__x")).distinct().withColumn("__c", F.explode(_cells(F.lit(0).cast("long"), F.col("__x"), levels)))
        met = places.select("__x", F.col("__c.level").alias("level"), F.col("__c.at").alias("at")).join(cells, ["level", "at"])
        return met.groupBy("__x").agg(*added).select(F.col("__x").alias(f"__{mark}"), *[F.col(c).alias(f"{c}{mark}") for c in facts])

    begun = left.join(up_to(F.col("__hia"), "__lob", "begun"), F.col("__hia") == F.col("__begun"))
    both = begun.join(up_to(F.col("__loa") - 1, "__hib", "over"), F.col("__loa") - 1 == F.col("__over"), "left")
    less = lambda c: F.col(f"{c}begun") - F.coalesce(F.col(f"{c}over"), F.lit(0))
    totals = [F.when(less(f"__k{i}") > 0, F.coalesce(less(f"__s{i}"), F.lit(0)).cast("long")).alias(c) for i, c in enumerate(sums)]
    return both.where(less("__n") > 0).select(*a.columns, less("__n").alias("n"), *totals)
