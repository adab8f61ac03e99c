"""Queries by name, each with the SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


#: Splits up to which a scan may be dealt out again; at 128 MB a split that moves 2 GB at most.
FEW_SPLITS = 16


def spread(df: DataFrame) -> DataFrame:
    """A scan of very few splits, such as one file of one row group, dealt out to all cores; any other is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored() -> list[Column]:
    """Where a row of a table that was just read is stored: orders rows that are otherwise tied as a scan from the first file on does."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
