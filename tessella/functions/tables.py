"""Table functions for SQL: one row in, any number out, over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from tessella.session import ship

#: A quoted string right after an opening sign, and the name before it: fixed values.
CANDIDATE = re.compile(r'([A-Za-z_][A-Za-z0-9_-]*)?[ ]*([(\[{,=:])[ ]*"([^"\n]*)"')


@udtf
class StringCandidates:
    """string_candidates(TABLE(t) PARTITION BY (key), 'text'): the strings that an opening sign announces, in order.

    Gives every column of the table but the text, then idx (from 0, within a row),
    name (of what stands before the sign, null if nothing does), sign and string.
    """

    def __init__(self):
        self.column = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or text.value is None:
            raise ValueError("string_candidates takes a table and the name of its text column")
        if text.value not in rows.dataType.fieldNames():
            raise ValueError(f"there is no column {text.value}")
        schema = StructType([f for f in rows.dataType.fields if f.name != text.value])
        return AnalyzeResult(schema.add("idx", IntegerType()).add("name", StringType()).add("sign", StringType()).add("string", StringType()))

    def eval(self, row, text: str):
        kept = [v for k, v in row.asDict().items() if k != text]
        for i, m in enumerate(CANDIDATE.finditer(row[text] or "")):
            yield (*kept, i, m[1], m[2], m[3])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("string_candidates", StringCandidates)
