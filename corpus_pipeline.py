"""The training-data pipeline: five operators in order over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and reads it back as the next stage's input. All stages but the
last return the columns of documents.

1. toxicity: documents that the classifier chain flags as toxic go; rows are judged one by one.
2. near-dedup: one document of each group of near copies stays (five words, similarity 0.8).
3. decontamination: documents that hold a benchmark item go.
4. secrets: secrets in the texts become ``[SECRET]``; n_chars is that of the new text.
5. BPE: token count and digests of ids and decoded text of every document left.

Defined cases: a null text is judged as the empty one, is no copy, holds no item and no secret
and has no tokens; rows with a null id are judged like others, but are no copies; of rows that
share an id each is judged by its own text, and of equal ones one stays; texts of any length are
taken whole; without labels no document is toxic, without items none is contaminated; extra
columns pass all stages but the last; an empty table, or one that a stage leaves empty, gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import bpe, decontamination, minhash, secrets, toxicity
from lorespark.llm.common import Work, enable_workers


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    enable_workers(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(~toxicity.scores(model, F.col("text"))["toxic"])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    matches = decontamination.item_matches(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.where(F.size(matches(F.col("text"))) == 0)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    enable_workers(spark)
    clean = docs.withColumn("text", secrets.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select("doc_id", "text"), bpe.default_path(), with_ids=False).select("doc_id", "bpe.*")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: The classifier's training and the tokenizer can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), name)
        if at:
            work.drop(STAGES[at - 1][0])
    return docs
