"""Sharding by sampled splitters, in DataFrame functions only.

Records of equal key are a group, and keys are ordered by a hash. Sizes are to be near equal
over the shards, and a group stays in one shard unless it alone is over half a shard. A sample
of records, drawn with a chance in proportion to their size, is sorted by key, and the keys at
its weighted quantiles split all records into ranges, some ``RANGES`` a shard. Then every range
is measured exactly. One that is overfull (twice its share) is split again: by splitters of a
sample of its own records where it holds several groups, by a hash of the record where it
is one group of over half a shard; groups over a range's share are ranges of their own from
the start. When no range is overfull, the ranges go to the shards largest first, each to the
emptiest shard, so shards differ by about the smallest ranges.

Chances come from hashes, so a lost task draws the same sample again. Bounds: a sample has
``DRAWN`` records for each range's share of bytes, and there are at most a few thousand ranges
however large the table, which is what is broadcast. Texts are read once and never shuffled: all
later steps use a table of id, key, size and checksum. Slots are numbered in bins, so no task
numbers a whole shard.

Defined cases: a null text has no bytes, size 1, checksum 0 and is of the empty text's group;
a record as large as a shard is alone as far as it can be; equal ids and equal rows each
get a slot of their own; null ids count as any id; an empty table gives an empty result; other
columns are not looked at, and ``sharded`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, text_of

SHARDS, RANGES, DRAWN = 8, 64, 32
BIN_ROWS = 200_000
PIECES = 256  # of a group that is split by hash


def _uniform(*cols) -> F.Column:
    """A number above 0 and up to 1 by hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 1) / float(1 << 52)


def splitters(records: DataFrame, share: float, turn: int) -> DataFrame:
    """(range, bounds): the keys at which each range's records are to be split, from a sample weighted by size.

    A record is drawn with a chance of its size by ``share / DRAWN``, at most 1, and stands for that much if it is smaller.
    """
    unit = share / DRAWN
    drawn = records.where(_uniform("record", "key", F.lit(turn)) <= F.col("size") / unit)
    drawn = drawn.groupBy("range", "key").agg(F.sum(F.greatest("size", F.lit(unit))).alias("weight"))
    by_key = Window.partitionBy("range").orderBy("key")
    step = F.floor((F.sum("weight").over(by_key) - F.col("weight") / 2) / share)
    stepped = drawn.select("range", "key", step.alias("step"))
    new = stepped.withColumn("new", F.col("step") > F.lag("step").over(by_key)).where("new")
    return new.groupBy("range").agg(F.sort_array(F.collect_list("key")).alias("bounds"))


def ranges(work: Work, records: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(records with ``range`` and ``sub``, one row a range with ``shard``). records: record, key, size."""
    total, n = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share, whole = max(total / (shards * RANGES), 1.0), total / (2 * shards)
    # at most shards * RANGES groups are that large
    heavy = records.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where(F.col("bytes") >= share)
    heavy = work.save(heavy.select("key", (-F.row_number().over(Window.orderBy(F.desc("bytes"), "key"))).alias("own")), "heavy")
    # a range's number: the group's own, or 0 for all others to begin with
    open_ = records.join(F.broadcast(heavy), "key", "left").withColumn("range", F.coalesce("own", F.lit(0)).cast("long")).drop("own")
    done, measured, turn = [], [], 0
    while True:
        bounds = splitters(open_.where("range >= 0"), share, turn)
        cut = open_.join(F.broadcast(bounds), "range", "left")
        by_key = F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col("key"))), F.lit(0)).cast("long")
        by_hash = F.pmod(F.xxhash64("record", F.lit(turn)), F.lit(PIECES)) if turn else F.lit(0).cast("long")
        sub = F.when(F.col("range") >= 0, by_key).otherwise(by_hash)
        cut = work.save(cut.select(*records.columns, "range", sub.alias("sub")), f"cut{turn}")
        sizes = cut.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        one = F.col("low") == F.col("high")
        # what is one group is split only if it is over half a shard
        overfull = F.when(one, (F.col("bytes") > whole) & (F.col("rows") > 1)).otherwise(F.col("bytes") > 2 * share)
        number = F.row_number().over(Window.orderBy("range", "sub")) + F.lit(turn * 1_000_000)
        sizes = sizes.select("*", overfull.alias("overfull"), F.when(one, -number).otherwise(number).cast("long").alias("next"))
        sizes = work.save(sizes, f"sizes{turn}")
        named = cut.join(F.broadcast(sizes.select("range", "sub", "next", "overfull")), ["range", "sub"])
        done.append(named.where("not overfull").select(*records.columns, F.col("next").alias("range")))
        measured.append(sizes.where("not overfull").select(F.col("next").alias("range"), "bytes", "rows"))
        if not sizes.where("overfull").take(1):
            break
        open_ = named.where("overfull").select(*records.columns, F.col("next").alias("range"))
        turn += 1
        if turn > 30:
            raise RuntimeError("ranges stay overfull")
    placed, sized = done[0], measured[0]
    for more, its in zip(done[1:], measured[1:], strict=True):
        placed, sized = placed.union(more), sized.union(its)
    return placed, work.save(packed(sized, shards), "packed")


def packed(sized: DataFrame, shards: int) -> DataFrame:
    """(range, rows, shard): largest ranges first, each to the shard with the fewest bytes so far."""
    listed = sized.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "range", "rows"))).alias("l"))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("shards"))

    def put(state, r):
        at = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        loads = F.transform(state["loads"], lambda x, i: x - F.when(i == at, r["less"]).otherwise(0))
        return F.struct(loads.alias("loads"), F.array_append(state["shards"], at.cast("int")).alias("shards"))

    dealt = listed.select("l", F.aggregate("l", zero, put)["shards"].alias("s"))
    return dealt.select(F.explode(F.arrays_zip("l", "s")).alias("z")).select("z.l.range", "z.l.rows", F.col("z.s").alias("shard"))


def with_slots(work: Work, placed: DataFrame, packed: DataFrame, n: int, shards: int) -> DataFrame:
    """placed with ``shard`` and ``slot``, gapless from 0 in each shard.

    A shard's rows are numbered in bins of bounded rows; a bin's first slot is the rows of the bins before it.
    """
    # small tables get bins of a few hundredths of a shard too, so that many tasks number them
    rows = max(1, min(BIN_ROWS, n // (shards * 64)))
    known = placed.join(F.broadcast(packed), "range")
    bin_ = F.pmod(F.xxhash64("record", "range"), F.greatest(F.ceil(F.col("rows") / rows), F.lit(1)))
    binned = known.withColumn("bin", bin_).drop("rows")
    binned = work.save(binned, "binned")
    counted = binned.groupBy("shard", "range", "bin").agg(F.count("*").alias("held"))
    ahead = Window.partitionBy("shard").orderBy("range", "bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = work.save(counted.select("range", "bin", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("from")), "offsets")
    within = F.row_number().over(Window.partitionBy("range", "bin").orderBy("record")) - 1
    numbered = binned.withColumn("within", within).join(offsets, ["range", "bin"])
    return numbered.withColumn("slot", (F.col("from") + F.col("within")).cast("long")).drop("within", "from", "bin", "range")


def sharded(docs: DataFrame, key: F.Column, size: F.Column, shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with ``shard`` and ``slot``, which replace columns of those names.

    key: what equal rows have in common; size: a whole number from 1. Columns not kept are never written.
    """
    work = Work(docs.sparkSession, "sharding")
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("shard", "slot")]
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]  # so that no name clashes
    slim = docs.select(F.monotonically_increasing_id().alias("record"), F.xxhash64(key).alias("key"), size.cast("long").alias("size"), *kept)
    slim = work.save(slim, "records")  # a record's number is fixed from here
    placed, dealt = ranges(work, slim, shards)
    out = with_slots(work, placed, dealt, slim.count(), shards)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "shard", "slot")


def save_shards(docs: DataFrame, path: str, key: F.Column, size: F.Column, shards: int = SHARDS) -> None:
    """Writes docs with all columns as a folder a shard, in slot order within files."""
    out = sharded(docs, key, size, shards)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's size, checksum, shard and slot; sizes are near equal over the shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    data = text_of("text").cast("binary")
    sized = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), text_of("text").alias("text"))
    out = sharded(sized, F.col("text"), F.col("size"), SHARDS, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
