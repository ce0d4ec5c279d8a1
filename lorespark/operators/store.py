"""Phase results as tables in the folder that the cluster shares.

Lineage ends at such a table, so a lost executor costs no more than the running phase.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir; where it is unset, a local session gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")


def write_back(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back; the shuffle files behind it are removed."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ready_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from a checkout."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


class Store:
    """A folder of phase results below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return write_back(self.spark, df, f"{self.root}/{self.n}")

    def save_counted(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """The table, and aggregates of its rows, taken while they are written."""
        seen = Observation(f"counts-{uuid.uuid4().hex}")
        kept = self.save(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
        return kept, seen.get
