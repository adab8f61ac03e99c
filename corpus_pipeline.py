"""The corpus pipeline: five operators of tessella.llm, one after the other.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as
the next one's documents; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontamination, line_dedup, mixing, near_duplicates, quality
from tessella.llm.spread import cut

STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", line_dedup.stage),
    ("minhash near-dedup", near_duplicates.stage),
    ("benchmark decontamination", decontamination.stage),
    ("mixing to target weights", mixing.stage),
]

#: MinHash and raking have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
