"""Session settings the jobs rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: sizes (shuffle partitions, memory) stay with the cluster.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where a later aggregate then needs its own shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows dealt out by some of the join keys needn't be dealt out again by all of them
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


# tables written by cut, per application
_cuts: dict[str, list[str]] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors, as the cluster names it in
    spark.checkpoint.dir (or SparkContext.setCheckpointDir, as tests do)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table into the shared checkpoint folder and go on from
    there: a lost executor re-reads them, later steps read only the columns they
    need, and the plan stays small. remove_cuts deletes such tables."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/spendspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def cuts_so_far(spark: SparkSession) -> int:
    return len(_cuts.get(spark.sparkContext.applicationId, []))


def remove_cuts(spark: SparkSession, first: int = 0, end: int | None = None) -> None:
    """Delete the tables that cut has written in this application, by their number. What
    was read from them can't be computed again afterwards."""
    paths = _cuts.get(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for i, path in list(enumerate(paths))[first:end]:
        if path:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            paths[i] = ""
