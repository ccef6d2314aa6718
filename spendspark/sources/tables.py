"""Reading and writing the claim tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendspark import schema
from spendspark.functions.scalars import date_text, money_text


def _typed(df: DataFrame, name: str) -> DataFrame:
    """Declared columns in declared types; missing ones null, others (secrets) dropped."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.TABLES[name].fields])


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(schema.TABLES[name])
    if fmt == "csv":
        reader = reader.option("header", True)
    return _typed(reader.load(path), name)


def jdbc_options(name: str, url: str, lower: str, upper: str, partitions: int,
                 partition_column: str = "created_at", **more: str) -> dict[str, str]:
    """Options of a partitioned JDBC read: `partitions` range queries in parallel. Only
    declared columns are asked for, so secrets never leave the database."""
    columns = ", ".join(schema.TABLES[name].fieldNames())
    return {"url": url, "dbtable": f"(SELECT {columns} FROM {name}) AS t", "partitionColumn": partition_column,
            "lowerBound": lower, "upperBound": upper, "numPartitions": str(partitions),
            "pushDownPredicate": "true", **more}


def read_table_jdbc(spark: SparkSession, name: str, url: str, lower: str, upper: str, partitions: int,
                    **more: str) -> DataFrame:
    options = jdbc_options(name, url, lower, upper, partitions, **more)
    return _typed(spark.read.format("jdbc").options(**options).load(), name)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet; expenses are best partitioned by the month of expense_date
    (partition_by='expense_month') and clustered by user, which the reports prune by."""
    if partition_by == "expense_month":
        df = df.withColumn("expense_month", F.trunc("expense_date", "MM"))
        df = df.repartitionByRange("expense_month", "user_id").sortWithinPartitions("expense_month", "user_id")
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int = 256, mode: str = "errorifexists") -> DataFrame:
    """A catalog table at a path, dealt into buckets by a key and sorted by it within them; gives the table.

    Tables with equally many buckets by the key that they are joined or grouped by need no shuffle for it:
    expenses by id, and comments, audit lines and queue jobs by expense_id. Each bucket is one file; choose
    so many that a bucket's rows fit a task (about 256 MB)."""
    dealt = df.repartition(buckets, key)
    dealt.write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str] | str) -> DataFrame:
    """target plus those rows whose key it lacks; of rows with equal keys the one that
    sorts first over all columns is kept, so the result does not depend on row order."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in rows.columns if c not in keys]
    single = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("r")).select(*keys, "r.*") if others \
        else rows.distinct()
    return target.unionByName(single.join(target, keys, "left_anti"), allowMissingColumns=True)


REPORT_COLUMNS = ["id", "title", "description", "amount", "currency", "expense_date", "vendor", "category",
                  "status", "approver_name", "created_at"]


def report_columns(listed: DataFrame, localized: bool = False) -> DataFrame:
    """Columns of the expense report; localized=True renders amount and date as pt-BR text."""
    rows = listed.select(*[c for c in REPORT_COLUMNS if c in listed.columns])
    if localized:
        rows = rows.withColumns({"amount": money_text(F.col("amount"), F.col("currency")),
                                 "expense_date": date_text(F.col("expense_date"))})
    return rows


def export_csv(listed: DataFrame, path: str, localized: bool = False, mode: str = "errorifexists") -> None:
    (report_columns(listed, localized).write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
