"""Reachability: closure by chain labels, search from seeds, strongly connected components by colouring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

BIN = 1024  # positions of a chain that are handled together
SMALL = 500  # edges whose pairs, their square at most, are cheaper made outright than labels are


def _bin(at: Column | str) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / BIN)


def _matched(edges: DataFrame) -> DataFrame:
    """Edges of which no two share a start or an end: of a node's edges one is chosen by hash, of those to a node one again."""
    chosen = edges.groupBy("a").agg(F.min_by("b", F.xxhash64("a", "b")).alias("b"))
    return chosen.groupBy("b").agg(F.min_by("a", F.xxhash64("b", "a")).alias("a")).select("a", "b")


def _ranked(store: Store, nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, chain, at) of nodes on chains that begin, (node, least) of nodes on rings of links), by pointer jumping.

    A chain is named by its first node, and at counts from 0. Each round doubles the reach, rows stay those of nodes.
    """
    start = nodes.join(links.select(F.col("b").alias("node"), F.col("a").alias("up")), "node", "left")
    step = start.select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().cast("long").alias("at"), F.least(F.coalesce("up", "node"), "node").alias("least"), F.col("up").isNull().alias("done"))
    step = store.save(step)
    rounds, size = 0, nodes.count()
    # only a chain's first node is at 0, on whatever round, so a node that meets one there is done and jumps no more
    while step.where("not done").take(1) and 1 << rounds <= 4 * size:
        ahead = step.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("at").alias("at2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        jumped = step.where("not done").join(ahead, "up").select("node", F.col("up2").alias("up"), (F.col("at") + F.col("at2")).alias("at"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"))
        step = store.save(step.where("done").union(jumped))
        rounds += 1
    return step.where("done").select("node", F.col("up").alias("chain"), "at"), step.where("not done").select("node", "least")


def chains(store: Store, edges: DataFrame) -> DataFrame:
    """(node, chain, at): the nodes of edges (a, b), dealt over paths of the graph that share no node."""
    nodes = store.save(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    links = store.save(_matched(edges))
    left = edges.join(links.select("a"), "a", "left_anti").join(links.select("b"), "b", "left_anti").select("a", "b")
    links = links.union(store.save(_matched(left)))
    placed, rings = _ranked(store, nodes, links)
    if rings.take(1):  # a ring is opened before its least node
        least = store.save(rings.select(F.col("least").alias("b")).distinct())
        placed, _ = _ranked(store, nodes, store.save(links.join(least, "b", "left_anti").select("a", "b")))
    return store.save(placed)


def _exits(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(ac, ap, bc, bp): the edges that lead to another chain or back on their own, by the places of their ends."""
    end = lambda x: placed.select(F.col("node").alias(x), F.col("chain").alias(f"{x}c"), F.col("at").alias(f"{x}p"))
    out = edges.join(end("a"), "a").join(end("b"), "b").where("ac <> bc or bp <= ap")
    return out.groupBy("ac", "ap", "bc").agg(F.min("bp").alias("bp"))


def _components(store: Store, placed: DataFrame, exits: DataFrame) -> DataFrame:
    """(node, comp): strongly connected components, named by a place.

    Only places where an exit begins or ends need a search; what lies on a chain between two places of a component is in it too.
    """
    place = F.struct("chain", "at")
    ends = exits.select(F.col("ac").alias("chain"), F.col("ap").alias("at")).union(exits.select("bc", "bp")).distinct().withColumn("bin", _bin("at"))
    ends = store.save(ends)
    inside = ends.select("chain", "at", F.lead("at").over(Window.partitionBy("chain", "bin").orderBy("at")).alias("to"))
    bins = ends.groupBy("chain", "bin").agg(F.min("at").alias("low"), F.max("at").alias("at"))
    between = bins.select("chain", "at", F.lead("low").over(Window.partitionBy("chain").orderBy("bin")).alias("to"))
    on = inside.union(between).where("to is not null").select(place.alias("a"), F.struct("chain", F.col("to").alias("at")).alias("b"))
    out = exits.select(F.struct(F.col("ac").alias("chain"), F.col("ap").alias("at")).alias("a"), F.struct(F.col("bc").alias("chain"), F.col("bp").alias("at")).alias("b"))
    found = cycles(store.save(out.union(on)))
    spans = found.groupBy("component", F.col("node.chain").alias("chain")).agg(F.min("node.at").alias("low"), F.max("node.at").alias("high"))
    spans = spans.select("chain", "low", "high", "component", F.explode(F.sequence(_bin("low"), _bin("high"))).alias("bin"))
    at = placed.withColumn("bin", _bin("at"))
    inner = at.join(spans, ["chain", "bin"]).where("at between low and high").select("node", "component")
    return placed.join(inner, "node", "left").select("node", F.coalesce("component", place).alias("comp"))


def _labels(store: Store, placed: DataFrame, exits: DataFrame, limit: int) -> DataFrame:
    """(node, chain, at): of an acyclic graph, the chains that a node reaches and the first place that it reaches on each."""
    known = fresh = exits
    for _ in range(limit):
        left = lambda df: df.select("ac", "ap", F.col("bc").alias("m"), F.col("bp").alias("low"))
        right = lambda df: df.select(F.col("ac").alias("m"), F.col("ap").alias("high"), "bc", "bp")
        both = left(fresh).join(right(known), "m").where("high >= low").union(left(known).join(right(fresh), "m").where("high >= low"))
        new = both.where("ac <> bc").groupBy("ac", "ap", "bc").agg(F.min("bp").alias("bp"))
        old = known.groupBy("ac", "ap", "bc").agg(F.min("bp").alias("was"))
        fresh = store.save(new.join(old, ["ac", "ap", "bc"], "left").where("was is null or bp < was").select("ac", "ap", "bc", "bp"))
        if not fresh.take(1):
            break
        known = store.save(known.union(fresh).groupBy("ac", "ap", "bc").agg(F.min("bp").alias("bp")))
    else:
        raise RuntimeError(f"the labels did not settle in {limit} rounds")
    own = placed.select("node", "chain", (F.col("at") + 1).alias("at"))
    others = placed.join(known, (F.col("chain") == F.col("ac")) & (F.col("ap") >= F.col("at")))
    return own.union(others.groupBy("node", F.col("bc").alias("chain")).agg(F.min("bp").alias("at")))


def _doubled(store: Store, known: DataFrame, limit: int) -> DataFrame:
    """All pairs of a small graph: new pairs are joined with all known ones, so the rounds grow with the logarithm of the longest path."""
    fresh = known
    for _ in range(limit):
        step = fresh.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        back = known.select("a", F.col("b").alias("m")).join(fresh.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        fresh = store.save(step.union(back).distinct().join(known, ["a", "b"], "left_anti"))
        if not fresh.take(1):
            return known
        known = known.union(fresh)
    raise RuntimeError(f"the closure did not settle in {limit} rounds")


def closure(edges: DataFrame, limit: int = 60, small: int = SMALL) -> DataFrame:
    """All pairs (a, b) with a path of one or more edges (a, b), each once; null ends are ignored.

    The nodes are dealt over chains, strongly connected components become one node each, and the acyclic
    rest gets chains again. A node's label is the chains it reaches and its first place on each, so a
    chain of any length is one row a node and not a pair of nodes. The pairs are made from the labels
    at the end, each once.
    """
    store = Store(edges.sparkSession, "closure")
    all_edges = store.save(edges.select("a", "b").where("a is not null and b is not null").distinct())
    if all_edges.count() <= small:
        return _doubled(store, all_edges, limit)
    member, order, labels = _condensed(store, all_edges, limit)
    side = lambda x, c: member.select(F.col("node").alias(x), F.col("comp").alias(c))
    last = order.groupBy("chain").agg(F.max("at").alias("end"))
    reach = labels.join(last, "chain").where("at <= end").select("node", "chain", "at", F.explode(F.sequence(_bin("at"), _bin("end"))).alias("bin"))
    there = order.select(F.col("node").alias("to"), "chain", F.col("at").alias("place"), _bin("at").alias("bin"))
    pairs = reach.join(there, ["chain", "bin"]).where("place >= at").select(F.col("node").alias("ca"), F.col("to").alias("cb"))
    several = member.groupBy("comp").count().where("count > 1").select(F.col("comp").alias("ca"), F.col("comp").alias("cb"))
    out = pairs.union(several).join(side("a", "ca"), "ca").join(side("b", "cb"), "cb").select("a", "b")
    # a node alone reaches itself by an edge to itself only
    alone = all_edges.where("a = b").join(side("a", "ca").join(several.select("ca"), "ca", "left_semi").select("a"), "a", "left_anti")
    return out.union(alone.select("a", "b"))


def _condensed(store: Store, all_edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((node, comp), (node, chain, at) of comps on chains, (node, chain, at) of the first place each comp reaches on a chain).

    A chain's place behind its end stands for none. Where no edge leaves its chain, comps are places and the chains stay.
    """
    proper = all_edges.where("a <> b")
    placed = chains(store, proper)
    exits = store.save(_exits(proper, placed))
    place = F.struct("chain", "at").alias("comp")
    if not exits.take(1):
        member = placed.select("node", place)
        order = placed.select(place.alias("node"), "chain", "at")
        return member, order, order.select("node", "chain", (F.col("at") + 1).alias("at"))
    member = store.save(_components(store, placed, exits))
    side = lambda x, c: member.select(F.col("node").alias(x), F.col("comp").alias(c))
    dag = store.save(proper.join(side("a", "ca"), "a").join(side("b", "cb"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    order = chains(store, dag)
    return member, order, store.save(_labels(store, order, store.save(_exits(dag, order)), limit))


def closure_totals(edges: DataFrame, limit: int = 60, small: int = SMALL) -> DataFrame:
    """(a, n, total): of each node that reaches any, how many nodes (b) its closure has and their sum; nodes are whole numbers.

    The same as ``closure`` grouped by a, without its pairs: every place of a chain gets the totals of all places from
    it on, and a node adds up those of its labels.
    """
    store = Store(edges.sparkSession, "closure")
    all_edges = store.save(edges.select("a", "b").where("a is not null and b is not null").distinct())
    both = [F.sum("n").alias("n"), F.sum("total").alias("total")]
    if all_edges.count() <= small:
        return _doubled(store, all_edges, limit).groupBy("a").agg(F.count("*").alias("n"), F.sum("b").alias("total"))
    member, order, labels = _condensed(store, all_edges, limit)
    size = member.groupBy("comp").agg(F.count("*").alias("n"), F.sum("node").alias("total"))
    at = order.join(size, F.col("node") == F.col("comp")).select("chain", "at", _bin("at").alias("bin"), "n", "total")
    bins = at.groupBy("chain", "bin").agg(*both)
    later = Window.partitionBy("chain").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("chain", "bin", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("n", "total")])
    inside = Window.partitionBy("chain", "bin").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rest = at.select("chain", "bin", "at", F.sum("n").over(inside).alias("n"), F.sum("total").over(inside).alias("total"))
    rest = rest.join(bins, ["chain", "bin"]).select("chain", "at", (F.col("n") + F.col("n_later")).alias("n"), (F.col("total") + F.col("total_later")).alias("total"))
    found = labels.join(rest, ["chain", "at"]).select(F.col("node").alias("comp"), "n", "total")
    found = found.union(size.where("n > 1").select("comp", "n", "total"))  # its members reach each other and themselves
    out = member.join(found.groupBy("comp").agg(*both), "comp").select(F.col("node").alias("a"), "n", "total")
    # a node alone reaches itself by an edge to itself only
    several = member.join(size.where("n > 1"), "comp", "left_semi").select(F.col("node").alias("a"))
    alone = all_edges.where("a = b").select("a").join(several, "a", "left_anti").select("a", F.lit(1).cast("long").alias("n"), F.col("a").cast("long").alias("total"))
    return out.union(alone).groupBy("a").agg(*both)


def reach_from(edges: DataFrame, seeds: DataFrame, limit: int = 10_000) -> DataFrame:
    """(b) of all nodes with a path of one or more edges (a, b) from a seed (a), without closing the rest of the graph."""
    store = Store(edges.sparkSession, "reach")
    edges = edges.select("a", "b").where("a is not null and b is not null")
    known = store.save(edges.join(seeds, "a", "left_semi").select("b").distinct())
    fresh = known
    for _ in range(limit):
        if not fresh.take(1):
            return known
        step = edges.join(fresh.withColumnRenamed("b", "a"), "a", "left_semi").select("b").distinct()
        fresh = store.save(step.join(known, "b", "left_anti"))
        known = store.save(known.union(fresh))
    raise RuntimeError(f"the search did not settle in {limit} rounds")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components with at least two nodes; component: the least node.

    A node alone, with a self-loop or not, is no cycle. Edges that can't lie on a cycle are
    trimmed; then the least label that reaches a node colours it, and what reaches a colour's
    root backwards within that colour is its component. Those leave, and the rest goes on. Rows
    of a round never outnumber the edges; nothing is closed.
    """
    spark = edges.sparkSession
    store = Store(spark, "cycles")
    left = store.save(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    found: list[DataFrame] = []
    while True:
        size = left.count()
        while size:  # an edge lies on a cycle only if something leads to it and on from it
            left = store.save(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            before, size = size, left.count()
            if size == before:
                break
        if not size:
            break
        nodes = left.select(F.col("a").alias("node")).distinct()  # each one left has an edge out
        colour = store.save(nodes.select("node", F.col("node").alias("colour")))
        while True:
            came = left.join(colour.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("low"))
            new = store.save(colour.join(came, "node", "left").select("node", F.least("colour", "low").alias("colour"), (F.col("low") < F.col("colour")).alias("changed")))
            colour = new.select("node", "colour")
            if not new.where("changed").take(1):
                break
        paint = lambda side: colour.select(F.col("node").alias(side), F.col("colour").alias(f"c{side}"))
        inside = store.save(left.join(paint("a"), "a").join(paint("b"), "b").where("ca = cb").select("a", "b"))
        member = fresh = store.save(colour.where("node = colour"))
        while fresh.take(1):
            back = inside.join(fresh.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "colour").distinct()
            fresh = store.save(back.join(member.select("node"), "node", "left_anti"))
            member = store.save(member.union(fresh))
        found.append(member)
        gone = member.select("node")
        left = store.save(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    if not found:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    members = found[0]
    for more in found[1:]:
        members = members.union(more)
    several = members.groupBy("colour").count().where("count > 1").select("colour")
    return members.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component"))
