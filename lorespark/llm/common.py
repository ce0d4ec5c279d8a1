"""Shared plumbing of the training-data operators.

``Work`` keeps phase results as Parquet tables in the shared checkpoint folder: lineage
ends there, so a lost executor costs no more than the running phase. ``components``
labels connected components with DataFrame joins only.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import shared_dir, write_back

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def enable_workers(spark: SparkSession) -> None:
    """Readies Python workers: they can import this package from a checkout, and batches are small.

    Texts may be long, and a worker holds its batch several times over, so where the session
    has Spark's default of 64 MB a batch, it becomes 8 MB.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if spark.conf.get(BATCH_BYTES).lower().removesuffix("b") in (str(64 << 20), "64m"):
        spark.conf.set(BATCH_BYTES, "8m")


class Work:
    """A folder of phase results below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        enable_workers(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back; the shuffle files behind it are removed."""
        return write_back(self.spark, df, f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes results that no later phase reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def text_of(col: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def components(work: Work, links: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """Connected components of the undirected graph ``links`` as (node, component).

    component is the smallest node reachable. Alternating large-star and small-star rounds:
    each is a min per node and a join, rows never outnumber the links, and the round count
    grows with the logarithm of the graph. The mins are written before they are joined, so
    that both join sides are plain shuffles and a hub's rows can be split by AQE. Null ends
    and self links are ignored; an empty input gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = edges.where("u is not null and v is not null and u <> v").distinct()
    edges = work.save(edges, "cc0")
    size, i, before = None, 0, 0
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size[0] == 0 or size == before or i >= limit:
            break
        before = size
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = work.save(low.select("u", F.least("u", "m").alias("m")), f"low{i}")
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = work.save(big.where("u <> v"), f"big{i}")
        low2 = work.save(big.groupBy("u").agg(F.min("v").alias("m")), f"low2{i}")
        small = big.join(low2, "u")
        new = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = new.union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = work.save(new, f"cc{i + 1}")
        work.drop(f"cc{i}", f"low{i}", f"big{i}", f"low2{i}")
        edges, i = new, i + 1
    if size[0] and size != before:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
