"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, decontamination, embeddings, html_text, minhash, runs, secrets, sharding, suffix_dedup, token_counts, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": decontamination.op1_benchmark_decontamination,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_bpe_encoding": bpe.op3_bpe_encoding,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
    "op11_sharding": sharding.op11_sharding,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {"op7_url_filters": url_filters.ORACLE_SQL}
