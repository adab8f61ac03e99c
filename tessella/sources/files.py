"""Saved state with a checksum, and datasets by split; trees of files are in tree.py."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_state(df: DataFrame, path: str) -> str:
    """A table with a checksum of its rows beside it, so that a damaged copy is found out."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    mark = checksum(df.sparkSession.read.parquet(f"{path}/rows"))
    df.sparkSession.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").parquet(f"{path}/mark")
    return mark


def load_state(spark: SparkSession, path: str) -> DataFrame:
    rows, mark = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/mark").first()[0]
    if checksum(rows) != mark:
        raise ValueError(f"{path}: the rows don't match their checksum")
    return rows


def checksum(df: DataFrame) -> str:
    """Independent of row order: count and sum of row hashes."""
    h = F.xxhash64(*df.columns)
    row = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((row[0], str(row[1]), df.dtypes)).encode()).hexdigest()


def save_split(df: DataFrame, path: str, split: str = "split") -> DataFrame:
    """A dataset by split, and its row counts."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(split).agg(F.count(F.lit(1)).alias("n"))
