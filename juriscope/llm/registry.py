"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import contamination, html_layout, katz, mixing, neardup, quality, secrets, sharding, substrings, topk
from .shared import documents


def op3_shard_tree(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir), shards=24)


def op5_mix_sources(spark, sf_dir):
    return mixing.op5_mix(documents(spark, sf_dir))


def op2_contamination(spark, sf_dir):
    return contamination.op2_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_secrets(spark, sf_dir):
    return secrets.op8_secrets(documents(spark, sf_dir))


def op4_top_k(spark, sf_dir):
    return topk.op4_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_quality(spark, sf_dir):
    return quality.op9_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_near_duplicates(spark, sf_dir):
    return neardup.op10_near_duplicates(documents(spark, sf_dir))


def op6_substrings(spark, sf_dir):
    return substrings.op6_substrings(documents(spark, sf_dir))


def op1_katz(spark, sf_dir):
    return katz.op1_katz(documents(spark, sf_dir))


def op7_html(spark, sf_dir):
    return html_layout.op7_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_katz": op1_katz,
    "op2_contamination": op2_contamination,
    "op3_shard_tree": op3_shard_tree,
    "op4_top_k": op4_top_k,
    "op5_mix_sources": op5_mix_sources,
    "op6_substrings": op6_substrings,
    "op7_html": op7_html,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_near_duplicates": op10_near_duplicates,
    "pipeline": corpus_pipeline.run,
}

#: Fitted networks, language models and rendered pages are tested against brute force instead.
ORACLES = {
    "op2_contamination": contamination.ORACLE,
    "op3_shard_tree": sharding.ORACLE,
    "op4_top_k": topk.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op6_substrings": substrings.ORACLE,
    "op8_secrets": secrets.ORACLE,
    "op10_near_duplicates": neardup.ORACLE,
}
