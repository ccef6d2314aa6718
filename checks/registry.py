"""Registered queries: a Spark callable and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendspark.plans.fixtures import Claims, with_views
from spendspark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as double, dates and times as text: types that read the same in both
    engines."""
    changes = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "decimal":
            changes[field.name] = F.col(field.name).cast("double")
        elif kind == "date":
            changes[field.name] = F.date_format(field.name, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            changes[field.name] = F.date_format(field.name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(changes) if changes else df


def query(name: str, sql: str | None = None, views: str = "expenses"):
    """Registers fn(claims) -> DataFrame under the name; views are the derived tables
    the SQL reads."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(Claims(configure(spark), folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *views.split()) if views else sql.strip()
        return fn

    return register


def at(column: str) -> str:
    """Timestamp as text in DuckDB."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
