"""MinHash near-dedup with circulant signatures and exact verification.

Signatures: one permutation scatters a document's shingles over a circle of 2**64 places, a
second one, shifted by k places around the circle, gives coordinate k as the least value
over the set. Both are bijective 64-bit mixers, so two permutations stand for all
``BANDS * ROWS`` coordinates. ``BANDS`` bands of ``ROWS`` coordinates each are bucketed: of a
pair with Jaccard 0.85 all bands differ with probability (1 - 0.85**5)**24 < 1e-6.

Documents with equal word sequences are one unit, which the least id stands for. A bucket's
candidates are confirmed on their whole shingle sets, as 64-bit hashes of the shingles, each
computed once, with integer arithmetic. No bucket is expanded into all pairs: its least unit
leads and every other member is compared with the leader; then only buckets whose members lie
in different components go on. There the most central member leads. Whatever is still open,
such as a group whose members differ by a little too much, is settled exactly by a prefix
filter over the open units (``_prefix_pairs``), so no link between documents that share a
bucket is lost, while rows stay near the number of members. Later links only contract the
components found before.

Bucket members that meet many leaders are shuffled on plain exchanges, whose partitions AQE
splits; per-bucket facts are aggregates. Phase results are tables in the shared folder; those
that the result does not read are removed.

Defined cases: null or wordless texts have an empty set and no link; a null id has no
component and is kept; rows that repeat an id are one node, linked where any of its texts
is; extra columns are not read, whatever their names; very long texts are taken whole, one
at a time; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, components, text_of

WORDS, BANDS, ROWS = 5, 24, 5
_U = np.uint64
SIGNATURE = "doc_id long, n_shingles long, content binary, buckets array<long>"


def mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 64-bit numbers, in place."""
    x ^= x >> _U(33)
    x *= _U(a)
    x ^= x >> _U(29)
    x *= _U(b)
    x ^= x >> _U(32)
    return x


def words_of(text: str | None) -> list[bytes]:
    """Words between the white space of the contract, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> set:
    """The exact set: tuples of WORDS words, or the whole sequence where there are fewer."""
    if not words:
        return set()
    if len(words) < WORDS:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(WORDS)), strict=False))


def hashed_shingles(words: list[bytes]) -> np.ndarray:
    """The distinct shingles as 64-bit numbers."""
    import xxhash

    if not words:
        return np.zeros(0, _U)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], _U)
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words), 1)], _U)
    out = h[: len(h) - WORDS + 1].copy()
    for i in range(1, WORDS):
        out = mix(out, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53) + h[i : len(h) - WORDS + 1 + i]
    return np.unique(mix(out, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def signature(items: np.ndarray) -> np.ndarray:
    """BANDS * ROWS circulant coordinates of a non-empty set.

    Coordinate k is the least pi(sigma(x) + k); pi(y) is y * a, its halves folded, times b.
    """
    a, b = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
    placed = mix(items.copy(), 0xBF58476D1CE4E5B9, 0x94D049BB133111EB) * a  # the scattering permutation
    shifts = np.arange(BANDS * ROWS, dtype=_U)[:, None] * a
    out = np.full(BANDS * ROWS, 2**64 - 1, _U)
    for at in range(0, len(placed), 512):
        y = shifts + placed[None, at : at + 512]
        y ^= y >> _U(32)
        y *= b
        np.minimum(out, y.min(axis=1), out=out)
    return out


def buckets(sig: np.ndarray) -> list[int]:
    """One 64-bit bucket a band."""
    bands = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        h = mix(h + bands[:, i], 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
    return h.view(np.int64).tolist()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, content, found = [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            items = hashed_shingles(words)
            n.append(len(items))
            content.append(digest_of(words))
            found.append(buckets(signature(items)) if len(items) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "content", "buckets"],
        )


def similar(a: set, b: set, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    if not a or not b or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def digest_of(words: list[bytes]) -> bytes | None:
    return hashlib.sha256(b" ".join(words)).digest()[:16] if words else None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, content, items) of (id, text): the digest of the words, and the distinct shingles in order as the bytes of 64-bit numbers."""
    for batch in batches:
        content, items = [], []
        for text in batch.column(1):  # one text at a time
            words = words_of(text.as_py())
            content.append(digest_of(words))
            items.append(hashed_shingles(words).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(items, pa.binary())], names=["unit", "content", "items"])


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(side[i].as_buffer(), _U) for side in (left, right))
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    continue
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return verify


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of units whose sets are similar."""
    left = sets.select(F.col("unit").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("unit").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verifier(percent), "a long, b long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, m, h): every shingle of a unit, and how many it has."""
    for batch in batches:
        for i, items in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = np.frombuffer(items.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(np.full(len(h), len(h))), pa.array(h)], names=["unit", "m", "h"])


def _prefix_pairs(work: Work, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar at all, by the prefix filter.

    open_: unit, component. Shingles are ordered by how many open units have them, rarest
    first. Sets of sizes m <= n are similar only if they share w = ceil(p (m + n) / (100 + p))
    shingles, so the first m - w + 1 of the smaller and n - w + 1 of the larger must meet. With
    n = m at least, the smaller side's part is shorter than the larger side's: units that differ
    from all others by a little too much fill it with shingles of their own, and meet nothing,
    however many they are. In a shingle's list, members of its largest component are only joined
    with those of others.
    """
    open_ = work.save(open_, "open_units")
    tokens = work.save(sets.join(open_.select("unit"), "unit").mapInArrow(_tokens, "unit long, m long, h long"), "tokens")
    counts = work.save(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    placed = tokens.join(counts, "h", "left").groupBy("unit", "m").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h"))).alias("l"))
    reach = F.col("m") - F.expr(f"({percent} * m + 99) div 100") + 1
    prefix = placed.select("unit", "m", F.posexplode(F.slice("l", F.lit(1), reach.cast("int"))).alias("pos", "x")).where("x.df > 1")
    prefix = work.save(prefix.select("unit", "m", "pos", F.col("x.h").alias("h")).join(open_, "unit"), "prefix")
    lists = prefix.groupBy("h", "component").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("c0"), F.count("*").alias("k"))
    prefix = work.save(prefix.join(work.save(lists.where("k > 1").select("h", "c0"), "lists"), "h"), "listed")
    side = lambda n: prefix.select("h", *[F.col(c).alias(c + n) for c in ("unit", "m", "pos", "component", "c0")])
    need = f"({percent} * (mx + my) + {99 + percent}) div {100 + percent}"
    can = F.expr(f"componentx <> componenty and posx < mx - {need} + 1 and posy < my - {need} + 1 and (mx < my or (mx = my and unitx < unity)) and mx * 100 >= {percent} * my")
    small = side("x").where(f"posx < mx - ({percent} * 2 * mx + {99 + percent}) div {100 + percent} + 1")
    hot, others = small.where("componentx = c0x"), small.where("componentx <> c0x")
    met = [hot.join(side("y").where("componenty <> c0y"), "h").where(can), others.join(side("y"), "h").where(can)]
    pairs = [df.select(F.col("unitx").alias("a"), F.col("unity").alias("b")) for df in met]
    pairs = work.save(pairs[0].union(pairs[1]).distinct(), "prefix_pairs")
    work.drop("open_units", "tokens", "counts", "prefix", "lists", "listed")
    return pairs


def _units(work: Work, signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, copies, own): a unit is one word sequence of one document that stands for all equal ones.

    units: unit, doc_id, content, buckets, rows. Its number is its document's id; an id that
    stands for several sequences has numbers made from their digests, above all ids, which own
    (unit, doc_id) lists. rows counts the rows with that id and sequence.
    copies: (rep, doc_id) of documents that hold the sequence of another, whose id is rep.
    """
    live = signed.where("doc_id is not null and n_shingles > 0")
    classes = work.save(live.groupBy("content").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("content", "rep"), "classes")
    joined = live.select("doc_id", "content", "buckets").join(classes, "content", "left")
    copies = work.save(live.select("doc_id", "content").join(classes, "content").where("doc_id <> rep").select("rep", "doc_id").distinct(), "copies")
    single = joined.where("rep is null").select("doc_id", "content", "buckets", F.lit(1).cast("long").alias("rows"))
    several = joined.where("rep = doc_id").groupBy("doc_id", "content").agg(F.first("buckets").alias("buckets"), F.count("*").alias("rows"))
    units = work.save(single.union(several), "reps")
    twice = work.save(units.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    number = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("content", "doc_id"), 2)
    if twice.take(1):
        marked = units.join(twice.withColumn("many", F.lit(True)), "doc_id", "left")
        units = work.save(marked.select(F.when(F.col("many"), number).otherwise(F.col("doc_id")).alias("unit"), "doc_id", "content", "buckets", "rows"), "units")
    else:
        units = units.select(F.col("doc_id").alias("unit"), "doc_id", "content", "buckets", "rows")
    own = units.where("unit <> doc_id").select("unit", "doc_id")
    return units, copies, own


@dataclass
class Linked:
    """signed: doc_id, n_shingles, content of every row; labels: node, component of linked nodes, the least of its nodes."""

    signed: DataFrame
    units: DataFrame
    own: DataFrame
    labels: DataFrame
    work: Work


def link(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text", by_id: bool = True) -> Linked:
    """Links the documents. Nodes are ids or, without by_id, units, so that one id's different texts stay apart."""
    spark = docs.sparkSession
    work = Work(spark, "minhash")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    signed = work.save(docs.mapInArrow(_sign, SIGNATURE), "signed")
    units, copies, own = _units(work, signed)

    # candidates: buckets with at least two units
    members = work.save(units.select("unit", F.explode("buckets").alias("bucket")), "all_members")
    led = members.groupBy("bucket").agg(F.min("unit").alias("leader"), F.count("*").alias("size")).where("size > 1")
    led = work.save(led, "led")
    members = work.save(members.join(led, "bucket").select("bucket", "unit", "leader", "size"), "members0")
    work.drop("all_members", "led")

    pairs = work.save(members.where("unit <> leader").select(F.col("leader").alias("a"), F.col("unit").alias("b")).distinct(), "pairs0")
    involved = work.save(pairs.select(F.col("a").alias("unit")).union(pairs.select(F.col("b").alias("unit"))).distinct(), "involved")
    wanted = work.save(units.select("unit", "doc_id", "content", "rows").join(involved, "unit"), "wanted")
    ids = involved.select(F.col("unit").alias("doc_id"))
    if own.take(1):  # an id may have several texts: the digest tells which is meant
        ids = work.save(wanted.select("doc_id").distinct(), "ids")
    held = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "unit long, content binary, items binary")
    if own.take(1):
        mine = wanted.select(F.col("doc_id").alias("id"), F.col("content").alias("c"), F.col("unit").alias("u"))
        held = held.join(mine, (F.col("unit") == F.col("id")) & (F.col("content") == F.col("c"))).select(F.col("u").alias("unit"), "items")
    sets = work.save(held.select("unit", "items"), "sets")
    again = wanted.where("rows > 1").select("unit")
    if again.take(1):  # rows that repeat an id and its words give equal sets
        once = sets.join(again, "unit").groupBy("unit").agg(F.first("items").alias("items"))
        sets = work.save(sets.join(again, "unit", "left_anti").union(once), "sets_once")
    work.drop("wanted", "involved", "ids")
    found = work.save(_confirm(pairs, sets, percent), "links0")
    links = found
    if by_id:
        links = found.union(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))).union(own.select(F.col("unit").alias("a"), F.col("doc_id").alias("b")))
    labels = work.save(components(work, links), "labels0")
    work.drop("pairs0", "links0")

    def still_open(members: DataFrame, i: int) -> DataFrame:
        """Members of buckets that hold two components."""
        open_ = members.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
        out = work.save(members.join(work.save(open_.select("bucket"), f"open{i}"), "bucket", "left_semi"), f"members{i}")
        work.drop(f"open{i}")
        return out

    def merged(members: DataFrame, labels: DataFrame, found: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
        """Members and labels after more links: only components are contracted, not all links again."""
        place = work.save(members.select("unit", "component").distinct(), f"place{i}")
        ends = found.join(place.withColumnRenamed("unit", "a").withColumnRenamed("component", "ca"), "a").join(place.withColumnRenamed("unit", "b").withColumnRenamed("component", "cb"), "b")
        into = work.save(components(work, ends, "ca", "cb").withColumnRenamed("component", "into"), f"into{i}")
        step = lambda df: df.join(into.withColumnRenamed("node", "component"), "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")
        # a node that had no link until now is its own component
        alone = into.select("node").join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
        every = work.save(step(labels.select("node", "component").union(alone)).select("node", "component"), f"labels{i}")
        return step(members).select("bucket", "unit", "size", "component"), every

    placed = members.select("bucket", "unit", "size").join(labels.withColumnRenamed("node", "unit"), "unit", "left")
    members = still_open(work.save(placed.select("bucket", "unit", "size", F.coalesce("component", "unit").alias("component")), "placed"), 1)
    work.drop("members0", "placed")
    if members.take(1):
        # the most central member leads: the one whose buckets are largest
        central = work.save(members.groupBy("unit").agg(F.sum("size").alias("degree")), "central")
        ranked = members.join(central, "unit")
        best = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "unit", "component")).alias("l"))
        best = work.save(best.select("bucket", F.col("l.unit").alias("a"), F.col("l.component").alias("ca")), "best")
        pairs = members.join(best, "bucket").where("component <> ca").select("a", F.col("unit").alias("b")).distinct()
        found = work.save(_confirm(work.save(pairs, "pairs1"), sets, percent), "links1")
        members, labels = merged(members, labels, found, 1)
        members = still_open(members, 2)
        work.drop("central", "best", "pairs1", "links1", "labels0", "members1", "place1", "into1")
    if members.take(1):
        pairs = _prefix_pairs(work, members.select("unit", "component").distinct(), sets, percent)
        found = work.save(_confirm(pairs, sets, percent), "links2")
        _, labels = merged(members, labels, found, 2)
        work.drop("prefix_pairs", "links2", "labels1", "place2", "into2")
    work.drop("sets", "sets_once", "members2")
    return Linked(signed, units, own, labels, work)


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    found = link(docs, percent, doc_id, text)
    joined = found.signed.select("doc_id", "n_shingles").join(found.labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sha, content): digests of the text and of its words."""
    for batch in batches:
        sha, content = [], []
        for text in batch.column(1).to_pylist():
            sha.append(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest())
            content.append(digest_of(words_of(text)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha), pa.array(content, pa.binary())], names=["id", "sha", "content"])


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies, that of the least id.

    Rows with a null id stay. Rows that share an id are judged each by its own words; of those
    with equal words one stays.
    """
    found = link(docs, percent, by_id=False)
    signed, units, labels, work = found.signed, found.units, found.labels, found.work
    gone = labels.where("node <> component").select(F.col("node").alias("unit"))
    repeated = signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeated.take(1):  # ids are units: those of other units of a component go, and copies, whose id is no unit
        stay = units.select("unit").join(gone, "unit", "left_anti").select(F.col("unit").alias("doc_id"))
        stay = work.save(stay.union(signed.where("n_shingles = 0").select("doc_id")), "stay")
        work.drop("signed", "reps", "copies", "classes")
        return docs.join(stay, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).where("doc_id is not null")
    marks = work.save(rows.mapInArrow(_marks, "id long, sha string, content binary"), "marks")
    stay = units.join(gone, "unit", "left_anti").select(F.col("doc_id").alias("id"), "content")
    stay = stay.union(marks.where("content is null").select("id", "content").distinct())
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("content").eqNullSafe(F.col("c"))
    chosen = marks.join(stay.select(F.col("id").alias("i"), F.col("content").alias("c")), same).groupBy("id", "content").agg(F.min("sha").alias("sha"))
    chosen = work.save(chosen.select(F.col("id").alias("__id"), F.col("sha").alias("__sha")), "chosen")
    marked = docs.withColumn("__text", F.sha2(text_of("text").cast("binary"), 256))
    kept = marked.join(chosen, (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__sha")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text"]).drop("__text").union(docs.where("doc_id is null"))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it is the one kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, 85)


def brute_force(rows: list[tuple[int, str | None]], percent: int = 85) -> list[tuple[int, int, int, bool]]:
    """The result by comparing all pairs, for tests."""
    sets = [(i, shingles(words_of(t))) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if similar(a, b, percent):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return [(i, len(s), root(i), root(i) == i) for i, s in sets]


def brute_force_ids(rows: list[tuple[int, str | None]], percent: int = 85) -> list[tuple[int, int, int, bool]]:
    """The same where ids may repeat: an id is one node, linked where any of its texts is."""
    found = brute_force(list(enumerate(t for _, t in rows)), percent)
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for at, _, to, _ in found:
        p, q = sorted((root(ids[at]), root(ids[to])))
        parent[q] = p
    return [(i, n, root(i), root(i) == i) for i, (_, n, _, _) in zip(ids, found, strict=True)]
