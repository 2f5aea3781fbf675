"""From raw documents to packed training windows: language, repeated passages, near copies, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import stages
from loomstone.llm.scratch import Scratch

STAGES = [
    ("language_id", stages.language_stage),
    ("line_dedup", stages.line_stage),
    ("near_copies", stages.jaccard_stage),
    ("mixing", stages.mixing_stage),
    ("packing", stages.packing_stage),
]

#: The first stage is a trained network and the last a tokenizer: no SQL says them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
