"""User functions by kind: a table function that names its own columns, a grouped aggregate over Arrow arrays, and SQL functions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from concordia.plans.schema import SEVERITIES


class WordWindows:
    """word_windows(text, size [, 'text']): a row for every window of size words: window_no, n_words, and the words where asked for.

    Words are separated by ASCII white space. A null text and one without words give no row. size must be a constant above 0.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, more: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(size.value, int) or size.value < 1:
            raise ValueError("word_windows: size must be a constant above 0")
        schema = StructType().add("window_no", IntegerType()).add("n_words", IntegerType())
        if more is not None:
            if more.value != "text":
                raise ValueError("word_windows: the third argument can only be 'text'")
            schema = schema.add("words", StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str | None, size: int, more: str | None = None):
        words = (text or "").encode().split()
        for k in range(0, len(words), size):
            own = words[k : k + size]
            yield (k // size, len(own)) if more is None else (k // size, len(own), b" ".join(own).decode())


def _geometric_mean(v: pa.Array) -> float:
    logs = [math.log(x) for x in v.to_pylist() if x is not None and x > 0]
    return math.exp(math.fsum(logs) / len(logs)) if logs else None


def geometric_mean(c):
    """A grouped aggregate of positive numbers, null for a group without one. A group is one Arrow array: for groups of bounded size."""
    return F.arrow_udf(_geometric_mean, "double")(c)


def register(spark: SparkSession) -> None:
    """Make word_windows, severity_name and relative_gap known to SQL in this session."""
    spark.udtf.register("word_windows", F.udtf(WordWindows))
    names = ", ".join(f"'{s}'" for s in SEVERITIES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION severity_name(n INT) RETURNS STRING RETURN try_element_at(array({names}), n + 1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION relative_gap(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN abs(a - b) / nullif(greatest(abs(a), abs(b)), 0)")
