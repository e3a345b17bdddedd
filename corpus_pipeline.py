"""A corpus pipeline: each stage takes what the one before kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import stages

STAGES = [
    ("quality rules", stages.quality),
    ("line dedup", stages.line_dedup_),
    ("n-gram Jaccard join", stages.ngram_jaccard),
    ("benchmark decontamination", stages.decontamination),
    ("mixing to target weights", stages.mixing_),
]

#: No SQL: quality rules, the n-gram join and decontamination aren't expressed in it. Tests hold each stage's operator against brute force, and
#: run() against the stages one by one and planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; their tables go to the shared folder in spark.checkpoint.dir."""
    from tickloom.llm.common import shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
