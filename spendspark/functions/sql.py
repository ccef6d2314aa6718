"""The rules and the receipt fields as temporary SQL functions, for users of plain SQL.

    register(spark)
    SELECT keyword_category(title, description, vendor).category FROM expenses
    SELECT receipt_fields(text, kv).amount FROM receipts

A function's body is the very column expression that the DataFrame operators use, written out as SQL; Spark
puts it into the query's plan, so nothing is called per row and no Python runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spendspark import fixed
from spendspark.functions.scalars import let
from spendspark.operators.categorize import best_of, claim_text, score_array
from spendspark.operators.receipts import receipt_fields

# text literals stay as they are; operators that are written like functions get quoted; fractions are doubles
_PIECES = re.compile(r"""('(?:[^'\\]|\\.)*')|(?<![\w`])(<=>|[<>=!]=?|[-+*/%]|or|and|not)(?=\()|(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])""", re.DOTALL)


def sql_text(column: Column) -> str:
    """The column's expression as Spark prints it, so that Spark's SQL reads it back."""
    def piece(found: re.Match) -> str:
        literal, operator, fraction = found.groups()
        return literal or (f"`{operator}`" if operator else f"{fraction}D")

    return _PIECES.sub(piece, column._jc.toString())


def keyword_choice() -> Column:
    """STRUCT<category, confidence> of the keyword rules over title, description and vendor."""
    def chosen(best: Column) -> Column:
        return F.struct(F.when(best["score"] > 0, best["category"]).otherwise("other").alias("category"), best["score"].alias("confidence"))

    return let(best_of(score_array(claim_text(), fixed.KEYWORDS), last_wins=True), chosen)


def functions() -> dict[str, tuple[str, Column]]:
    """Name, parameters and body of each function."""
    return {
        "keyword_category": ("title STRING, description STRING, vendor STRING", keyword_choice()),
        "receipt_fields": ("text STRING, kv MAP<STRING, STRING>", receipt_fields(F.col("text"), F.col("kv"))),
        "receipt_fields_local": ("text STRING, kv MAP<STRING, STRING>", receipt_fields(F.col("text"), F.col("kv"), "locale")),
    }


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in this session, replacing those of the same names."""
    for name, (parameters, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {sql_text(body)}")
    return list(functions())
