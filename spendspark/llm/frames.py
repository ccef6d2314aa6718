"""How the operators hand Arrow batches to numpy code, and the settings that bound a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendspark.session import configure

# A Python worker holds one batch at a time: at most so many rows and about so many bytes.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{table}.parquet")


def with_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: list[T.StructField],
                 drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows of df with the columns that fn computes from each batch appended, and the
    columns in drop left out on the way back to the JVM."""
    names = df.columns
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, *added])
    arrow = to_arrow_schema(schema)
    # Spark resolves the names it sends, so one with a dot travels under another name
    plain = [f"column {i}" for i in range(len(schema.fields))]
    sent = T.StructType([T.StructField(name, f.dataType, f.nullable) for name, f in zip(plain, schema.fields, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                named = batch.rename_columns(names)
                found = fn(named)
                yield pa.RecordBatch.from_arrays(
                    [(named.column(f.name) if f.name in names and f.name not in found else found[f.name]).cast(f.type) for f in arrow],
                    names=plain)

    return df.toDF(*[f"given {i}" for i in range(len(names))]).mapInArrow(run, sent).toDF(*schema.names)
