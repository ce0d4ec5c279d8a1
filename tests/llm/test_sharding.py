"""Sharding: its laws on the given and on skewed tables."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lorespark.llm import sharding

SF = "/root/testdata/sf0.01"


def check(rows, docs, groups_whole=True):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, sizes, where, held = defaultdict(list), Counter(), defaultdict(set), Counter()
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        where[(r.text_crc32, r.size)].add(r.shard)
        held[(r.text_crc32, r.size)] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(sizes.values())
    if groups_whole:
        assert all(len(where[g]) == 1 for g in where if held[g] <= total / 16)
    return [sizes[i] for i in range(8)], total


def as_table(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(f"{path}/documents.parquet")
    return sharding.op11_sharding(spark, str(path))


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = sharding.op11_sharding(spark, SF)
    sizes, total = check(out.collect(), docs)
    assert max(sizes) < 1.01 * total / 8 and min(sizes) > 0.99 * total / 8
    kinds = dict(out.dtypes)
    assert {k: kinds[k] for k in ("size", "text_crc32", "shard", "slot")} == {"size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint"}


def test_same_rows_same_shards(spark):
    """A second run draws the same samples."""
    shards = lambda: {r.doc_id: (r.shard, r.slot) for r in sharding.op11_sharding(spark, SF).collect()}
    assert shards() == shards()


def test_a_third_are_copies_and_some_are_giants(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "copy " * 40, "x") for i in range(1500)]
    rows += [(i, "w" * rng.randint(0, 400), None) for i in range(1500, 4500)]
    rows += [(5000, "g" * 90_000, ""), (5001, "g" * 90_000, ""), (5002, "h" * 60_000, "")]
    rows += [(7, "same", "")] * 50 + [(None, None, None)] * 20 + [(8, None, None), (9, "", None), (10, "é ", None)]
    got = as_table(spark, rows, tmp_path).collect()
    sizes, total = check(got, [r[:2] for r in rows])
    assert max(sizes) < 1.02 * total / 8 and min(sizes) > 0.98 * total / 8
    assert len({r.shard for r in got if r.size == 201}) > 1  # the large group is split


def test_few_rows_and_none(spark, tmp_path):
    assert as_table(spark, [], tmp_path / "none").count() == 0
    one = as_table(spark, [(1, None, None)], tmp_path / "one").collect()
    assert [(r.size, r.text_crc32, r.slot) for r in one] == [(1, 0, 0)]
    rows = [(i, "x" * (9 * (i == 3) + 1), None) for i in range(9)]
    sizes, _ = check(as_table(spark, rows, tmp_path / "few").collect(), [r[:2] for r in rows], False)
    assert max(sizes) <= 11 + 2


def test_overfull_ranges_are_split_again(spark):
    """A first sample that misses most records leaves ranges that are split in later turns."""
    work = sharding.Work(spark, "test")
    records = spark.range(3000).select(F.col("id").alias("record"), F.xxhash64(F.col("id")).alias("key"), F.lit(10).cast("long").alias("size"))
    before = sharding.DRAWN
    sharding.DRAWN = 0.6
    try:
        placed, packed = sharding.ranges(work, work.save(records, "r"), 8)
    finally:
        sharding.DRAWN = before
    assert placed.count() == 3000 and placed.select("record").distinct().count() == 3000
    loads = placed.join(packed, "range").groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert sum(r.b for r in loads) == 30_000 and max(r.b for r in loads) < 1.1 * 30_000 / 8


def test_shards_are_written(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("slot", F.lit("old"))
    sharding.save_shards(docs, f"{tmp_path}/out", F.col("text"), F.octet_length("text") + 1)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8
    assert set(docs.columns) <= set(back.columns) and dict(back.dtypes)["slot"] == "bigint"
