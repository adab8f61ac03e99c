"""Sparse matrices as long tables (row, col, value): built from vectors, stacked, gathered by row, multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def built(df: DataFrame, row: str, vector: Column, value: Column | None = None) -> DataFrame:
    """The entries over 0 of a vector of each row; value: what is kept of an entry `x`, else the entry."""
    x = df.select(F.col(row).alias("row"), F.posexplode(vector).alias("col", "x")).where("x > 0")
    return x.select("row", "col", (value if value is not None else F.col("x")).cast("double").alias("value"))


def stacked(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices one below the other; each comes with its number of rows, of which empty ones have no entries."""
    out, offset = None, 0
    for part, rows in parts:
        x = part.select((F.col("row") + offset).alias("row"), "col", "value")
        out, offset = x if out is None else out.unionByName(x), offset + rows
    return out


def gathered(matrix: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that wanted (at, row) asks for, as rows `at`; a row may be asked for any number of times."""
    return matrix.join(wanted.select("at", "row"), "row").select(F.col("at").alias("row"), "col", "value")


def times(matrix: DataFrame, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """(row, product) with a vector of weights (col, weight); a column without a weight counts 0, a row without entries is absent."""
    x = matrix.join(weights, "col", "left")
    return x.groupBy("row").agg((F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))) + bias).alias("product"))
