"""Embedding near-dedup by NN-descent.

Vectors that are equal once scaled to length one are one class with a weight. Neighbour
lists of the classes start from sorted random-hyperplane codes (a row's window in each of
``tables`` orders) and are refined by neighbours-of-neighbours joins: the nearest ``LIST`` of
the lists that meet in a class, forward and backward, are compared with each other, and better
neighbours enter. Only classes whose lists changed are joined again. A list that is full of
links is saturated and is enlarged, twice at a time, up to ``MOST`` entries. Neighbours beyond
three times the threshold's angle help no search for links and enter no list, so rows that are
near nothing cost no more than their windows.

The search moves vectors in half precision. The edges that may reach the threshold then give
components. Lists that are full of links may hide links to another component: both ends of
such a link lie in components of more than ``LIST`` classes, which are compared with each
other exactly and joined where they link (``bridges``). Then each component is completed in
double precision, where links are counted, not listed: one of at most ``BLOCK`` classes is
compared with itself; of a larger one, all classes within half the threshold's angle of its
centre link with each other by the triangle inequality and are only counted, and the others
are compared with all in pairs of blocks. So a dense group of any size costs one copy of its
vectors, never one row a pair, and no list length caps the links. Links below the threshold
never count. The descent ends when few lists that are not full of links still gain links.
``audit`` compares bounded sets of queries, inside and outside the largest component, with all
rows; where the mean share of a query's links that was found is under ``min_recall`` in either
set, the descent starts again with twice the orders, and the last attempt fails.

Wide rows are dealt by ranges that include a hash, so a hub or a crowded code is split, and
what meets in one class is compared in runs, none of which is held whole.

Defined cases: null ids and vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component (null for a null id); vectors of
different lengths never link; rows that repeat an id are vectors of their own that share the
id, the larger link count and the component; of neighbours of equal similarity at the end of a
list those of lesser ids stay, which changes no result; extra columns are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, components

BLOCK, WINDOW, LIST, MOST, SLACK = 512, 48, 12, 48, 4e-3  # the search holds half-precision vectors


def _numbers(col: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, None where it is not one."""
    out: list[np.ndarray | None] = []
    for x in col:
        values = x.values if x.is_valid else None
        if values is None or len(values) == 0 or values.null_count:
            out.append(None)
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, units = [], []
        for i, v in zip(batch.column(0).to_pylist(), _numbers(batch.column(1)), strict=True):
            if i is not None and v is not None:
                ids.append(i)
                units.append(unit(v).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(units, pa.binary())], names=["id", "u"])


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of equal keys in a stream sorted by its first columns: (key, the other columns)."""
    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_pylist() for c in batch.columns]
        rows = list(zip(*cols[:keys], strict=True))
        at = 0
        while at < len(rows):
            end = at + 1
            while end < len(rows) and rows[end] == rows[at]:
                end += 1
            part = [c[at:end] for c in cols[keys:]]
            if rows[at] == key:
                for have, more in zip(held, part, strict=True):
                    have.extend(more)
            else:
                if key is not None:
                    yield key, held
                key, held = rows[at], part
            at = end
    if key is not None:
        yield key, held


def near_enough(threshold: float) -> float:
    """The least similarity of a neighbour that is of use: three times the threshold's angle."""
    return float(np.cos(min(3 * np.arccos(threshold), np.pi)))


def _codes(tables: int, seed: int):
    """(dimension, order, code) of each unit vector, tables rows a vector."""
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.int64(1) << np.arange(31, -1, -1, dtype=np.int64)
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            raw = batch.column(1).to_pylist()
            for i, u in enumerate(raw):
                by_size.setdefault(len(u) // 8, []).append(i)
            for dim, at in by_size.items():
                if dim not in planes:
                    planes[dim] = np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, 32 * tables))
                x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), dim)
                side = (x @ planes[dim] > 0).reshape(len(at), tables, 32) @ bits
                small = [row.tobytes() for row in x.astype(np.float16)]
                ids = np.asarray(batch.column(0))[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(tables) + dim * 1000, len(at)), pa.int64()),
                        pa.array(side.T.reshape(-1), pa.int64()),
                        pa.array(np.tile(ids, tables), pa.int64()),
                        pa.array(small * tables, pa.binary()),
                    ],
                    names=["order", "code", "id", "u"],
                )

    return run


EDGE = "id long, nb long, sim float"


def _edges(a: list, b: list, s: list) -> pa.RecordBatch:
    cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.RecordBatch.from_arrays([cat(a, pa.int64()), cat(b, pa.int64()), cat(s, pa.float32())], names=["id", "nb", "sim"])


def _best(x: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k nearest others in x, those above least."""
    s = x @ x.T
    s[ids[:, None] == ids[None, :]] = -2
    k = min(k, len(ids) - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sims = np.take_along_axis(s, at, 1)
    good = sims > (-2 if least is None else least[:, None])
    row = np.repeat(np.arange(len(ids)), k).reshape(len(ids), k)
    return ids[row[good]], ids[at[good]], sims[good]


def _wide(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def _window_neighbours(k: int, least: float):
    """Neighbours from blocks of 2 * WINDOW rows in sorted order, overlapping by half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, rows = None, [], []
        a: list = []
        b: list = []
        s: list = []

        def flush() -> None:
            if len(ids) > 1:
                for x, y in zip((a, b, s), _best(_wide(rows), np.array(ids, np.int64), k, np.full(len(ids), least, np.float32)), strict=True):
                    x.append(y)

        for batch in batches:
            for order, i, u in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if order != last or len(ids) == 2 * WINDOW:
                    flush()
                    keep = WINDOW if order == last else 2 * WINDOW
                    del ids[:keep], rows[:keep]
                    last = order
                ids.append(i)
                rows.append(u)
            yield _edges(a, b, s)
            a, b, s = [], [], []
        flush()
        yield _edges(a, b, s)

    return run


def _local_join(k: int):
    """Compares the classes that meet in one class, in runs of at most 4 * WINDOW as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        last, ids, least, rows = None, [], [], []

        def flush() -> None:
            if len(ids) > 1:
                found = _best(_wide(rows), np.array(ids, np.int64), k, np.array(least, np.float32))
                for have, more in zip(out, found, strict=True):
                    have.append(more)
            for held in (ids, least, rows):
                held.clear()

        for batch in batches:
            for c, i, low, u in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if c != last or len(ids) == 4 * WINDOW:
                    flush()
                    last = c
                ids.append(i)
                least.append(low)
                rows.append(u)
            yield _edges(*out)
            out = ([], [], [])
        flush()
        yield _edges(*out)

    return run


def _count_block(threshold: float):
    """Of one pair of blocks of a component: each member's links (weighted) and local component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for (_, i, j), (side, ids, weight, rows) in groups(batches, 3):
            ids, weight, side = np.array(ids, np.int64), np.array(weight, np.int64), np.array(side)
            x = np.frombuffer(b"".join(rows), np.float64).reshape(len(ids), -1)
            n, label = np.zeros(len(ids), np.int64), ids.copy()
            for turn in range(len(ids) + 1):
                before = label.copy()
                for at in range(0, len(ids), 256):
                    part = slice(at, at + 256)
                    near = x[part] @ x.T >= threshold
                    near &= ids[part, None] != ids[None, :]
                    if i != j:  # links inside a block count where the block meets itself
                        near &= side[part, None] != side[None, :]
                    if turn == 0:
                        n[part] = near @ weight
                    low = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
                    label[part] = np.minimum(label[part], low)
                if (before == label).all():
                    break
            for have, more in zip(out, (ids, n, label), strict=True):
                have.append(more)
            if sum(map(len, out[0])) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["id", "n", "low"])
                out = ([], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["id", "n", "low"])

    return run


def _merge(found: DataFrame, threshold: float) -> DataFrame:
    """Lists (id, nb, sim, born, place): the best LIST of each id; where those are all links twice as many, and so on up to MOST."""
    one = found.groupBy("id", "nb").agg(F.max("sim").alias("sim"), F.min("born").alias("born"))
    ranked = one.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("d"), "nb", "born"))).alias("l"))
    links = F.size(F.filter("l", lambda x: x["d"] <= SLACK - threshold))
    size, room = LIST, F.lit(LIST)
    while size < MOST:
        room = F.when(links >= size, F.lit(min(2 * size, MOST))).otherwise(room)
        size *= 2
    kept = ranked.select("id", F.posexplode(F.slice("l", F.lit(1), room)).alias("place", "x"))
    return kept.select("id", "x.nb", (-F.col("x.d")).alias("sim"), "x.born", "place")


def _settled(lists: DataFrame, threshold: float, born: int) -> bool:
    """Whether under 0.1 % of the lists with links got one in round born; lists full of links, which only turn over, do not count."""
    linked = lists.where(F.col("sim") >= threshold).groupBy("id").agg(F.count("*").alias("n"), F.max("born").alias("last")).where(F.col("n") < LIST)
    n, new = linked.agg(F.count("*"), F.count_if(F.col("last") == born)).first()
    return new <= n * 0.001


def descend(work: Work, points: DataFrame, threshold: float, tables: int, rounds: int) -> DataFrame:
    """Edges (a, b) of the final lists that may reach the threshold. points: id, u in double precision."""
    spark = points.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tag = f"t{tables}"
    codes = points.mapInArrow(_codes(tables, 11), "order long, code long, id long, u binary")
    codes = codes.repartitionByRange(parts, "order", "code", F.xxhash64("id")).sortWithinPartitions("order", "code", "id")
    far = near_enough(threshold)
    first = codes.mapInArrow(_window_neighbours(LIST, far), EDGE)
    lists = work.save(_merge(first.withColumn("born", F.lit(0)), threshold), f"{tag}lists0")
    small = work.save(points.mapInArrow(_single, "m long, u binary"), f"{tag}small")
    for i in range(1, rounds + 1):
        if i > 1 and _settled(lists, threshold, i - 1):
            break
        nearest = lists.where(F.col("place") < LIST)
        fresh = nearest.where(F.col("born") == i - 1)
        if not fresh.take(1):
            break
        ends = lists.groupBy("id").agg(F.when(F.count("*") >= LIST, F.min("sim")).otherwise(F.lit(far)).cast("float").alias("least"))
        # classes that meet in c: c's list and the lists that hold c, where either is new
        both = nearest.select(F.col("id").alias("c"), F.col("nb").alias("m")).union(nearest.select(F.col("nb").alias("c"), F.col("id").alias("m")))
        active = fresh.select(F.col("id").alias("c")).union(fresh.select(F.col("nb").alias("c"))).distinct()
        meet = both.distinct().join(work.save(active, f"{tag}active{i}"), "c", "left_semi")
        meet = meet.join(work.save(ends.withColumnRenamed("id", "m"), f"{tag}ends{i}"), "m").join(small, "m")
        meet = meet.select("c", F.xxhash64("m").alias("h"), "m", "least", "u")
        dealt = meet.repartitionByRange(parts, "c", "h").sortWithinPartitions("c", "h")
        better = dealt.mapInArrow(_local_join(LIST // 2), EDGE).withColumn("born", F.lit(i))
        new = work.save(_merge(lists.drop("place").union(better), threshold), f"{tag}lists{i}")
        work.drop(f"{tag}lists{i - 1}", f"{tag}active{i}", f"{tag}ends{i}")
        lists = new
    edges = lists.where(F.col("sim") >= threshold - SLACK)
    return edges.select(F.col("id").alias("a"), F.col("nb").alias("b"))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        small = [np.frombuffer(u, np.float64).astype(np.float16).tobytes() for u in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], names=["m", "u"])


def _angle(x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x, -1, 1))


def _from_pivot(reach: float | None):
    """Of rows (key, id, side, w, u, p, r): those within reach + r of the pivot p, or, without reach, (key, angle) of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, p = batch.column("u").to_pylist(), batch.column("p").to_pylist()
            angle = _angle(np.array([np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64) for x, y in zip(u, p, strict=True)], np.float64))
            if reach is None:
                yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(angle, pa.float64())], names=["component", "r"])
            else:
                near = pa.array(angle <= reach + np.asarray(batch.column("r")), pa.bool_())
                yield batch.select(["a", "b", "side", "id", "w", "u"]).filter(near)

    return run


def _near_pivots(reach: float):
    """Of one pair of blocks of pivots: the pairs of components within reach plus both radii."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (side, ids, r, rows) in groups(batches, 3):
            ids, r, side = np.array(ids, np.int64), np.array(r), np.array(side)
            x = np.frombuffer(b"".join(rows), np.float64).reshape(len(ids), -1)
            for at in range(0, len(ids), 256):
                part = slice(at, at + 256)
                near = (_angle(x[part] @ x.T) <= reach + r[part, None] + r[None, :]) & (ids[part, None] < ids[None, :])
                if i != j:
                    near &= side[part, None] != side[None, :]
                a, b = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part][a], pa.int64()), pa.array(ids[b], pa.int64())], names=["a", "b"])

    return run


def bridges(work: Work, points: DataFrame, member: DataFrame, threshold: float, tag: str) -> DataFrame | None:
    """Links (a, b) between components of more than LIST classes, at least one of each two that link; None without two such.

    A component's least class is its pivot. By the triangle inequality of angles two components
    can only link where their pivots are within the threshold's angle and both radii, and there
    only members that near the other's pivot; those are compared in blocks, all of them.
    """
    reach = float(np.arccos(threshold)) + 1e-6
    big = work.save(member.groupBy("component").count().where(F.col("count") > LIST).select("component"), f"{tag}big")
    if len(big.take(2)) < 2:
        return None
    inside = member.join(big, "component", "left_semi").join(points.withColumnRenamed("id", "node"), "node")
    inside = work.save(inside.select("component", "node", "w", "u"), f"{tag}inside")
    pivot = inside.where("node = component").select("component", F.col("u").alias("p"))
    radius = inside.select("component", "u").join(pivot, "component").mapInArrow(_from_pivot(None), "component long, r double")
    pivots = work.save(pivot.join(radius.groupBy("component").agg(F.max("r").alias("r")), "component"), f"{tag}pivots")
    n = -(-pivots.count() // BLOCK)
    cells = pivots.select(F.length("p").alias("size"), F.pmod(F.xxhash64("component"), F.lit(n)).cast("int").alias("i"), "component", "r", "p")
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = cells.select("size", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), F.col("i").alias("side"), "component", "r", "p")
    cells = cells.repartition("size", "x", "y").sortWithinPartitions("size", "x", "y")
    pairs = work.save(cells.mapInArrow(_near_pivots(reach), "a long, b long"), f"{tag}pairs")
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("component"), F.col("b").alias("other"))
    sides = sides.union(pairs.select("a", "b", F.lit(1), F.col("b"), F.col("a")))
    there = inside.join(sides, "component").join(pivots.withColumnRenamed("component", "other"), "other")
    there = there.select("a", "b", "side", F.col("node").alias("id"), "w", "u", "p", "r")
    there = work.save(there.mapInArrow(_from_pivot(reach), "a long, b long, side int, id long, w long, u binary"), f"{tag}there")
    blocks = lambda s: F.ceil(F.sum((F.col("side") == s).cast("int")) / BLOCK).cast("int")
    sizes = there.groupBy("a", "b").agg(blocks(0).alias("m"), blocks(1).alias("n")).where("m > 0 and n > 0")
    placed = there.join(work.save(sizes, f"{tag}bridged"), ["a", "b"])
    mine, others = F.when(F.col("side") == 0, F.col("m")).otherwise(F.col("n")), F.when(F.col("side") == 0, F.col("n")).otherwise(F.col("m"))
    placed = placed.withColumn("at", F.pmod(F.xxhash64("id"), mine).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), others - 1)))
    i, j = (F.when(F.col("side") == s, F.col("at")).otherwise(F.col("to")) for s in (0, 1))
    placed = placed.select(F.struct("a", "b").alias("component"), i.alias("i"), (-1 - j).alias("j"), "side", "id", "w", "u")
    placed = placed.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    linked = placed.mapInArrow(_count_block(threshold), "id long, n long, low long").where("id <> low")
    return work.save(linked.select(F.col("id").alias("a"), F.col("low").alias("b")), f"{tag}bridges")


def _sums(whole: bool):
    """Of rows (component, u): the sum of each component's vectors; with whole, scaled to length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[c] = total[c] + np.frombuffer(u, np.float64) if c in total else np.frombuffer(u, np.float64)
        vectors = [unit(v) if whole and v.any() else v for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["component", "p"])

    return run


def _core(reach: float):
    """Of rows (component, node, w, u, p): whether u is within reach of p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, p = batch.column("u").to_pylist(), batch.column("p").to_pylist()
            inside = [bool(_angle(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) <= reach) for x, y in zip(u, p, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(["component", "node", "w", "u"]).columns, pa.array(inside, pa.bool_())], names=["component", "node", "w", "u", "core"])

    return run


COUNTED = "id long, n long, low long"


def _large(work: Work, inside: DataFrame, threshold: float, tag: str) -> DataFrame:
    """COUNTED of the members (component, node, w, u) of components of more than BLOCK classes."""
    sums = inside.select("component", "u").mapInArrow(_sums(False), "component long, p binary")
    centres = work.save(sums.repartition("component").mapInArrow(_sums(True), "component long, p binary"), f"{tag}centres")
    reach = float(np.arccos(threshold)) / 2 - 1e-6
    told = inside.join(centres, "component").mapInArrow(_core(reach), "component long, node long, w long, u binary, core boolean")
    told = work.save(told, f"{tag}told")
    core, fringe = told.where("core"), told.where("not core")
    parts = lambda name: F.ceil(F.count_if(name) / BLOCK).cast("int")
    facts = told.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("w"))).alias("total"), F.min(F.when(F.col("core"), F.col("node"))).alias("low"), parts(F.col("core")).alias("cores"), parts(~F.col("core")).alias("fringes"))
    facts = work.save(facts, f"{tag}facts")
    known = core.join(facts, "component").select(F.col("node").alias("id"), (F.col("total") - F.col("w")).alias("n"), "low")
    # the others meet each other and the core, in pairs of blocks
    own = fringe.join(facts, "component").withColumn("at", F.pmod(F.xxhash64("node"), F.col("fringes")).cast("int"))
    met = own.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("fringes") - 1)))
    met = met.select("component", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), F.col("at").alias("side"), "node", "w", "u")
    out = own.where("cores > 0").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("cores") - 1)))
    out = out.select("component", F.col("at").alias("i"), (-1 - F.col("to")).alias("j"), F.lit(0).alias("side"), "node", "w", "u")
    middle = core.join(facts.where("fringes > 0"), "component").withColumn("at", F.pmod(F.xxhash64("node"), F.col("cores")).cast("int"))
    middle = middle.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("fringes") - 1)))
    middle = middle.select("component", F.col("to").alias("i"), (-1 - F.col("at")).alias("j"), F.lit(1).alias("side"), "node", "w", "u")
    pairs = met.union(out).union(middle).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return known.union(pairs.mapInArrow(_count_block(threshold), COUNTED))


def complete(work: Work, points: DataFrame, edges: DataFrame, threshold: float, tag: str) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) and (node, component) of every class in a component of the edges, exact within it."""
    member = work.save(components(work, edges), f"{tag}member")
    across = bridges(work, points, member, threshold, tag)
    if across is not None and across.take(1):
        member = work.save(components(work, edges.union(across)), f"{tag}member1")
    sizes = work.save(member.groupBy("component").agg((F.count("*") > BLOCK).alias("large")), f"{tag}sizes")
    placed = member.join(sizes, "component").join(points.withColumnRenamed("id", "node"), "node").select("component", "node", "w", "u", "large")
    zero = F.lit(0)
    one = placed.where("not large").select("component", zero.alias("i"), zero.alias("j"), zero.alias("side"), "node", "w", "u")
    counted = one.repartition("component").sortWithinPartitions("component").mapInArrow(_count_block(threshold), COUNTED)
    if sizes.where("large").take(1):
        inside = work.save(placed.where("large").drop("large"), f"{tag}large")
        counted = counted.union(_large(work, inside, threshold, tag))
    counted = work.save(counted, f"{tag}counted")
    n = counted.groupBy("id").agg(F.sum("n").alias("n_links"))
    final = components(work, counted.select(F.col("id").alias("a"), F.col("low").alias("b")))
    out = work.save(n, f"{tag}n"), work.save(final, f"{tag}final")
    work.drop(*[f"{tag}{x}" for x in ("member", "member1", "sizes", "large", "centres", "told", "facts", "counted", "big", "inside", "pivots", "pairs", "there", "bridged", "bridges")])
    return out


def audit(points: DataFrame, counts: DataFrame, final: DataFrame, threshold: float, queries: int = 500) -> float:
    """Mean share of a query's links that were found, each query by itself, against all rows.

    Half of the queries are inside the largest component and half outside, as far as there are
    so many; the result is the lower of the two means, so neither set hides the other.
    """
    largest = final.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).collect()
    hot = final.where(F.col("component") == (largest[0]["component"] if largest else None)).select(F.col("node").alias("id"))
    some = lambda how, n: points.join(hot, "id", how).orderBy(F.xxhash64("id"), "id").limit(n).collect()  # noqa: E731  # bounded by its parameter
    chosen = some("left_semi", queries // 2)
    inside = {r.id for r in chosen}
    chosen += some("left_anti", queries - len(chosen))
    by_size: dict[int, list] = {}
    for r in chosen:
        by_size.setdefault(len(r.u), []).append(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = {size: (np.array([r.id for r in rows]), np.frombuffer(b"".join(r.u for r in rows), np.float64).reshape(len(rows), -1)) for size, rows in by_size.items()}
        total: dict[int, int] = {}
        for batch in batches:
            ids, w, raw = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            for size, (q, x) in ask.items():
                at = [i for i, u in enumerate(raw) if len(u) == size]
                if at:
                    y = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
                    near = (x @ y.T >= threshold) & (q[:, None] != ids[at][None, :])
                    for i, n in zip(q.tolist(), (near @ w[at]).tolist(), strict=True):
                        total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    true = points.select("id", "w", "u").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = true.where("n > 0").join(counts, "id", "left").select("id", F.coalesce("n_links", F.lit(0)) / F.col("n")).collect()  # at most one a query
    sets = [[share for i, share in rows if (i in inside) == side] for side in (True, False)]
    return min((sum(shares) / len(shares) for shares in sets if shares), default=1.0)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, tables: int = 6, rounds: int = 6, min_recall: float = 0.95, attempts: int = 3, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    work = Work(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    units = work.save(rows.mapInArrow(_units, "id long, u binary"), "units")
    points = work.save(units.groupBy("u").agg(F.min("id").alias("id"), F.count("*").alias("w")).select("id", "w", "u"), "points0")
    # an id with two different vectors: such classes get numbers of their own, below all ids
    twice = points.groupBy("id").count().where("count > 1").select("id")
    clash = bool(twice.take(1))
    if clash:
        own = points.join(work.save(twice, "twice"), "id", "left_semi").select((-1 - F.shiftrightunsigned(F.xxhash64("u"), 2)).alias("id"), "w", "u")
        points = work.save(points.join(twice, "id", "left_anti").select("id", "w", "u").union(own), "points1")
    search = points.select("id", "u")
    for attempt in range(attempts):
        t = tables * 2**attempt
        edges = work.save(descend(work, search, threshold, t, rounds).distinct(), f"t{t}edges")
        counts, final = complete(work, points, edges, threshold, f"t{t}")
        recall = audit(points, counts, final, threshold)
        if recall >= min_recall:
            break
    else:
        raise RuntimeError(f"embeddings: recall {recall:.3f} is under {min_recall} after {attempts} attempts")
    several = points if clash else points.where("w > 1")
    copies = work.save(several.select(F.sha2("u", 256).alias("s"), F.col("id").alias("rep"), "w"), "copies")
    mine = units.select("id", F.sha2("u", 256).alias("s")).join(copies, "s", "left")
    mine = mine.select("id", F.coalesce("rep", "id").alias("rep"), (F.coalesce("w", F.lit(1)) - 1).alias("own"))
    facts = work.save(counts.join(final, counts["id"] == final["node"], "full").select(F.coalesce("id", "node").alias("rep"), "n_links", "component"), "facts")
    linked = mine.join(facts, "rep", "left").select(
        "id", (F.col("own") + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = work.save(linked.where("n_links > 0").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "linked")
    if clash:  # a number is not an id: a component is named by its least id
        least = work.save(linked.groupBy("component_id").agg(F.min("id").alias("least")), "least")
        linked = linked.join(least, "component_id").select("id", "n_links", F.col("least").alias("component_id"))
    out = rows.select("vec_id").join(linked, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector's number of links, component and whether it is the one kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
