"""Salting of hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendspark.session import cut


class Salting:
    """Spreads the rows of hot keys over several tasks for a join with rows that are
    unique per key.

    Hot keys are the MOST keys with the most rows, of those that have at least hot_rows: a bound
    that makes their list broadcastable at any size. They are counted once and written, as every
    join reads the list. All other keys keep salt 0 and are not copied.
    """

    MOST = 10_000

    def __init__(self, rows: DataFrame, key: str, row_id: str, hot_rows: int = 1_000_000, salts: int = 64,
                 keep: Callable[[DataFrame], DataFrame] = cut):
        self.key, self.row_id, self.salts = key, row_id, salts
        counts = rows.groupBy(F.col(key).alias("hot_id")).agg(F.count(F.lit(1)).alias("n"))
        most = counts.filter(F.col("n") >= hot_rows).orderBy(F.col("n").desc(), "hot_id").limit(self.MOST)
        self.hot = keep(most.select("hot_id"))

    def _marked(self, df: DataFrame, key: str) -> DataFrame:
        return df.join(F.broadcast(self.hot), F.col(key) == F.col("hot_id"), "left")

    def scatter(self, rows: DataFrame) -> DataFrame:
        salt = F.when(F.col("hot_id").isNotNull(), F.pmod(F.xxhash64(self.row_id), F.lit(self.salts)).cast("int"))
        return self._marked(rows, self.key).withColumn("salt", F.coalesce(salt, F.lit(0))).drop("hot_id")

    def meet(self, scattered: DataFrame, unique: DataFrame, unique_key: str, how: str = "left") -> DataFrame:
        """Join of scattered rows with the one row of their key, which is copied once per
        salt for hot keys."""
        salts = F.when(F.col("hot_id").isNotNull(), F.sequence(F.lit(0), F.lit(self.salts - 1)))
        copies = self._marked(unique, unique_key).withColumn(
            "copy_salt", F.explode(F.coalesce(salts, F.array(F.lit(0))))).drop("hot_id")
        met = scattered.join(
            copies, (F.col(self.key) == F.col(unique_key)) & (F.col("salt") == F.col("copy_salt")), how)
        return met.drop("copy_salt")
