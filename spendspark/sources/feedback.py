"""Category corrections as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendspark import schema


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.select(*schema.FEEDBACK.fieldNames()).write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.FEEDBACK).json(path)
