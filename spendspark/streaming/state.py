"""Tables that micro-batches keep up to date: the newest row of every key, in plain Parquet folders.

    tail/batch=N/bucket=B        the rows that batch N changed or deleted
    snapshot/upto=N/bucket=B     the rows of a bucket after all batches before N

A bucket is a value computed from the key. A reader takes the newest finished snapshot of each
bucket it needs and the tail from there on; other buckets are neither listed row by row nor
opened. Every `every` batches the buckets that changed since their snapshot get a new one. A
bucket keeps its last two snapshots and the tail behind the older one: so batch N can be worked
off again, even after the snapshot that includes it was written. All else is removed, so a
bucket has two snapshot folders and at most 2 * every tail folders, however many batches ran.

A snapshot has one row per key. Of its rows only those are shuffled whose keys may occur in the tail:
a table of MARK_WORDS words of 64 bits, one bit per hash of a key, tells them from the others and is small
enough for a broadcast at any size. When it is full, more rows are shuffled than needed, none less.

A folder counts once Spark has put _SUCCESS into it; a job lost half way leaves a folder that
no reader takes, and repeating the batch replaces it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GONE, BATCH, BUCKET = "gone", "batch", "bucket"
WORD, BITS, MARKED = "mark word", "mark bits", "marked"
MARK_WORDS = 1 << 20


class Folders:
    """Listing and removing of folders by the file system that Spark uses."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, pattern: str) -> list[str]:
        """Paths below the root that fit the pattern, as they are below the root."""
        depth = pattern.count("/") + 1
        found = self._fs.globStatus(self._path(f"{self.root}/{pattern}"))
        return ["/".join(str(f.getPath()).split("/")[-depth:]) for f in found or []]

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class VersionedTable:
    """kind: the fields of a row; keys: fields that name it; bucket: an expression over fields
    that never change for a key, whose values are numbers, dates or plain words."""

    def __init__(self, spark: SparkSession, folder: str, kind: T.StructType, keys: list[str], bucket: Column, every: int = 16):
        self.spark, self.folder, self.kind, self.keys, self.every = spark, folder.rstrip("/"), kind, keys, every
        self.bucket = F.coalesce(bucket.cast("string"), F.lit("none"))
        self.layout = T.StructType([*kind.fields, T.StructField(GONE, T.BooleanType()), T.StructField(BATCH, T.LongType())])
        self.folders = Folders(spark, self.folder)

    # --- what there is ---------------------------------------------------------------------------

    def _finished(self, kind: str, field: str) -> dict[int, set[str]]:
        """Number of every finished folder with the buckets it has."""
        done: dict[int, set[str]] = {int(n.split("/")[1].split("=")[1]): set() for n in self.folders.names(f"{kind}/{field}=*/_SUCCESS")}
        for name in self.folders.names(f"{kind}/{field}=*/bucket=*"):
            _, number, bucket = name.split("/")
            if int(number.split("=")[1]) in done:
                done[int(number.split("=")[1])].add(bucket.split("=", 1)[1])
        return done

    def started(self) -> bool:
        return bool(self.folders.names("snapshot/upto=*/_SUCCESS"))

    def _snapshots(self, last: int | None = None) -> dict[str, list[int]]:
        """Numbers of each bucket's snapshots, newest first, up to the given one."""
        found: dict[str, list[int]] = defaultdict(list)
        for upto, buckets in sorted(self._finished("snapshot", "upto").items(), reverse=True):
            if last is None or upto <= last:
                for bucket in buckets:
                    found[bucket].append(upto)
        return found

    def _paths(self, last_snapshot: int | None, before: int | None, buckets: Iterable[str] | None) -> list[str]:
        wanted = None if buckets is None else set(buckets)
        bases = {b: uptos[0] for b, uptos in self._snapshots(last_snapshot).items()}
        found = [f"snapshot/upto={upto}/bucket={b}" for b, upto in bases.items() if wanted is None or b in wanted]
        for batch, own in self._finished("tail", "batch").items():
            if before is None or batch < before:
                found += [f"tail/batch={batch}/bucket={b}" for b in own if batch >= bases.get(b, 0) and (wanted is None or b in wanted)]
        return [f"{self.folder}/{name}" for name in sorted(found)]

    def paths(self, before: int | None = None, buckets: Iterable[str] | None = None) -> list[str]:
        """The folders that hold the state before a batch, of the given buckets or of all."""
        return self._paths(before, before, buckets)

    def _mark(self) -> tuple[Column, Column]:
        """The word of the marks that a row's key has its bit in, and that bit."""
        spot = F.pmod(F.xxhash64(*self.keys), F.lit(64 * MARK_WORDS))
        return F.shiftright(spot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))

    def _with_marks(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows with a column that is true wherever their key is among the given ones, and false for most others."""
        word, bit = self._mark()
        marks = keys.groupBy(word.alias(WORD)).agg(F.bit_or(bit).alias(BITS))
        met = rows.join(F.broadcast(marks), word == F.col(WORD), "left")
        return met.withColumn(MARKED, F.coalesce(F.col(BITS).bitwiseAND(bit) != 0, F.lit(False))).drop(WORD, BITS)

    def _last(self, rows: DataFrame, *within: str) -> DataFrame:
        """The newest row of every key, or of every key within something."""
        newest = rows.groupBy(*within, *self.keys).agg(F.max_by(F.struct(*self.layout.fieldNames()), BATCH).alias("newest"))
        return newest.select(*within, "newest.*")

    def _newest(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.layout)

        def rows(some: list[str]) -> DataFrame:
            return self.spark.read.schema(self.layout).parquet(*some)

        bases = [p for p in paths if p.startswith(f"{self.folder}/snapshot/")]
        later = [p for p in paths if p.startswith(f"{self.folder}/tail/")]
        if not later:
            return rows(bases)
        if not bases:
            return self._last(rows(later))
        base = self._with_marks(rows(bases), rows(later).select(*self.keys))
        changed = base.filter(MARKED).drop(MARKED).unionByName(rows(later))
        return base.filter(~F.col(MARKED)).drop(MARKED).unionByName(self._last(changed))

    def read(self, before: int | None = None, buckets: Iterable[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows as they are, or were before a batch, of all buckets or of some. keys: a table of the keys, of
        the types they have here; most others are left out then, without a shuffle of the snapshot."""
        newest = self._newest(self.paths(before, buckets)).filter(~F.col(GONE)).select(*self.kind.fieldNames())
        return newest if keys is None else self._with_marks(newest, keys).filter(MARKED).drop(MARKED)

    # --- changes ---------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str, repeats: bool = False) -> None:
        # rows of a bucket meet in one task, so a bucket is one file, and rows that repeat a key are found there
        dealt = rows.select(*self.layout.fieldNames()).withColumn(BUCKET, self.bucket).repartition(BUCKET)
        if repeats:
            dealt = self._last(dealt, BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/{name}")

    def begin(self, rows: DataFrame) -> None:
        """Writes the first snapshot, unless there is one: one row of every key."""
        if not self.started():
            self._write(rows.withColumns({GONE: F.lit(False), BATCH: F.lit(-1).cast("long")}), "snapshot/upto=0", repeats=True)

    def put(self, rows: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """New versions of rows, and rows that are gone from now on. Repeating the batch replaces them."""
        both = rows.withColumn(GONE, F.lit(False))
        if gone is not None:
            both = both.unionByName(gone.withColumn(GONE, F.lit(True)))
        self._write(both.withColumn(BATCH, F.lit(batch).cast("long")), f"tail/batch={batch}")

    def buckets_of(self, rows: DataFrame) -> list[str]:
        return [row[0] for row in rows.select(self.bucket.alias(BUCKET)).distinct().collect()]

    def compact(self, upto: int, expired: Column | None = None) -> None:
        """New snapshots of the buckets that batches before `upto` changed since their last one. Rows
        that were gone or expired before the last snapshot of any bucket are left out. Younger ones stay
        once more: a changed bucket has one of them or a living row, so it never comes out empty, which
        would bring its older snapshot back."""
        bases = {b: uptos[0] for b, uptos in self._snapshots(upto - 1).items()}
        changed = {b for batch, own in self._finished("tail", "batch").items() for b in own if bases.get(b, 0) <= batch < upto}
        if changed:
            over = F.col(GONE) if expired is None else F.col(GONE) | F.coalesce(expired, F.lit(False))
            newest = self._newest(self._paths(upto - 1, upto, changed))
            self._write(newest.filter(~over | (F.col(BATCH) >= max(bases.values(), default=0))), f"snapshot/upto={upto}")
        self._tidy()

    def after(self, batch: int, expired: Column | None = None) -> None:
        """To be called when a batch is written: compacts every `every` batches."""
        if (batch + 1) % self.every == 0:
            self.compact(batch + 1, expired)

    def _tidy(self) -> None:
        """Removes what neither a reader nor the repetition of the last batch needs."""
        snapshots = self._snapshots()
        newest = max((uptos[0] for uptos in snapshots.values()), default=0)
        for kind, field in (("snapshot", "upto"), ("tail", "batch")):
            for number, buckets in self._finished(kind, field).items():
                if kind == "snapshot":
                    stay = {b for b in buckets if number in snapshots[b][:2]}
                else:
                    stay = {b for b in buckets if number >= (snapshots[b][1] if len(snapshots[b]) > 1 else 0)}
                if not stay and number < newest:
                    self.folders.remove(f"{kind}/{field}={number}")
                for b in buckets - stay if stay else ():
                    self.folders.remove(f"{kind}/{field}={number}/bucket={b}")
