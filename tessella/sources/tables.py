"""Tables from text and array files: tab-separated values, JSON lines, numpy archives."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table with a header line; without a schema all columns are text."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_npz(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of the arrays of numpy archives, column by column; arrays of more than one dimension give array columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    yield pd.DataFrame({c: list(held[c]) if held[c].ndim > 1 else held[c] for c in columns})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{c} {t}" for c, t in columns.items()))
