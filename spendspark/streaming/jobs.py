"""Structured Streaming forms of the batch jobs. Each gives what its batch twin gives
on the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from spendspark import fixed
from spendspark.operators.categorize import suggest_category
from spendspark.operators.ml import Categorizer, suggest_with_model
from spendspark.operators.receipts import extract_receipt
from spendspark.operators.reports import rows_count
from spendspark.operators.workflow import apply_actions
from spendspark.session import cut, cuts_so_far, remove_cuts
from spendspark.streaming.state import VersionedTable


def run_available(stream: DataFrame, checkpoint: str, mode: str,
                  each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what is there in micro-batches, then stops."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(each).start())
    query.awaitTermination()
    return query


def _stored(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """Rows of the batch folders under path with their batch, none when there are no folders yet."""
    layout = T.StructType([*kind.fields, T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(layout).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # a damaged table must not pass for an empty one
            raise
        return spark.createDataFrame([], layout)
    return rows


def _put(df: DataFrame, path: str, batch: int) -> None:
    """Rows of one micro-batch. Repeating the batch replaces its folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


# --- approval workflow ---------------------------------------------------------------------------

TOO_LATE = "Older than the horizon of the stream"


class ActionStream:
    """Applies a stream of actions to a table of expenses.

    The state is kept in buckets of the expenses' ids (see state.VersionedTable): the expenses and
    the ids of the actions seen. The first batch writes the given expenses as the first snapshot;
    from then on a batch reads the buckets of the expenses it touches and writes the new version of these
    expenses, and its audit rows, notifications, comments, refusals, queue jobs and deletions beside
    them. Batch N reads only what batches before N left, and a repeated batch N replaces its own
    folders, so each action counts once however often a batch or an action is delivered.

    An action id is remembered for horizon_days behind the newest action of earlier batches. An
    action older than that is refused, since it can't be told whether it has counted; with
    horizon_days=None every id is remembered for good. An action that arrives later than a
    micro-batch with later actions takes effect after them.
    """

    OUTPUTS = ("audit", "notifications", "comments", "rejected", "ocr_jobs", "feedback")

    def __init__(self, base: DataFrame, users: DataFrame, folder: str, buckets: int = 256, every: int = 16,
                 horizon_days: int | None = 90, **options):
        self.base, self.users, self.folder, self.options = base, users, folder.rstrip("/"), options
        self.spark, self.buckets, self.every, self.horizon_days = base.sparkSession, buckets, every, horizon_days
        self.state = VersionedTable(self.spark, f"{self.folder}/expenses", base.schema, ["id"], self._bucket("id"), every)
        clock = T.StructType([T.StructField("name", T.StringType()), T.StructField("ts", T.TimestampType())])
        self.clock = VersionedTable(self.spark, f"{self.folder}/clock", clock, ["name"], F.lit("0"), every)

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets))

    def current(self, before: int | None = None) -> DataFrame:
        """Expenses after all batches, or before a given one."""
        self.state.begin(self.base)
        return self.state.read(before)

    def output(self, name: str, kind: T.StructType) -> DataFrame:
        rows = _stored(self.spark, f"{self.folder}/{name}", kind)
        if name == "rejected":
            return rows.drop("batch")
        # a deleted expense takes along what was written about it until then
        column = "related_expense_id" if name == "notifications" else "expense_id"
        gone_kind = T.StructType([T.StructField("expense_id", kind[column].dataType)])
        gone = _stored(self.spark, f"{self.folder}/deleted", gone_kind).select(
            F.col("expense_id").alias("gone_id"), F.col("batch").alias("gone_batch"))
        return rows.join(gone, (F.col(column) == F.col("gone_id")) & (F.col("batch") <= F.col("gone_batch")), "left_anti").drop("batch")

    def apply(self, actions: DataFrame, batch: int) -> None:
        first_cut = cuts_so_far(self.spark)
        self.state.begin(self.base)
        seen_kind = actions.select("action_id", "expense_id", F.col("ts").cast("timestamp").alias("ts")).schema
        seen = VersionedTable(self.spark, f"{self.folder}/seen", seen_kind, ["action_id"], self._bucket("expense_id"), self.every)
        given = cut(actions.dropDuplicates(["action_id"]))
        # at most as many values as there are buckets
        buckets = given.select(self._bucket("expense_id").cast("string")).distinct().toArrow().column(0).to_pylist()
        known = seen.read(batch, buckets).select(F.col("action_id").alias("seen_id"))
        clock = self.clock.read(batch).agg(F.max("ts")).first()[0]
        limit = None if clock is None or self.horizon_days is None else clock - timedelta(days=self.horizon_days)
        unseen = given.join(known, F.col("action_id") == F.col("seen_id"), "left_anti")
        late = F.lit(False) if limit is None else F.coalesce(F.col("ts") < F.lit(limit), F.lit(False))
        fresh = cut(unseen.withColumn("late", late))
        on_time = fresh.filter("not late").drop("late")
        touched = on_time.select(F.col("expense_id").alias("touched_id")).distinct()
        wanted = touched.select(F.col("touched_id").alias("id"))
        before = cut(self.state.read(batch, buckets, wanted).join(touched, F.col("id") == F.col("touched_id"), "left_semi"))
        result = apply_actions(before, on_time, self.users, **self.options)
        for name in self.OUTPUTS:
            rows = getattr(result, name)
            if name == "rejected":
                rows = rows.unionByName(fresh.filter("late").withColumn("reason", F.lit(TOO_LATE)).select(*rows.columns))
            _put(rows, f"{self.folder}/{name}", batch)
        _put(result.deleted, f"{self.folder}/deleted", batch)
        tombs = before.join(result.deleted, F.col("id") == F.col("expense_id"), "left_semi")
        self.state.put(result.changed, batch, gone=tombs)
        seen.put(fresh.filter("not late").select(*seen_kind.fieldNames()), batch)
        newest = on_time.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
        times = [t for t in (clock, newest) if t is not None]
        self.clock.put(self.spark.createDataFrame([("newest", max(times))] if times else [], self.clock.kind), batch)
        self.state.after(batch)
        self.clock.after(batch)
        seen.after(batch, None if limit is None else F.col("ts") < F.lit(limit))
        remove_cuts(self.spark, first_cut, cuts_so_far(self.spark))

    def run(self, actions: DataFrame, checkpoint: str) -> StreamingQuery:
        return run_available(actions, checkpoint, "append", self.apply)


def stream_apply_actions(actions: DataFrame, expenses: DataFrame, users: DataFrame, folder: str,
                         checkpoint: str, **options) -> ActionStream:
    job = ActionStream(expenses, users, folder, **options)
    job.run(actions, checkpoint)
    return job


# --- stateless jobs --------------------------------------------------------------------------------


def receipt_stream(spark: SparkSession, path: str) -> DataFrame:
    """New receipt text files, one row per file."""
    return spark.readStream.format("text").option("wholetext", True).load(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def stream_receipts(receipts: DataFrame, mode: str = "reference") -> DataFrame:
    return extract_receipt(receipts, mode)


def stream_suggestions(claims: DataFrame, categorizer: Categorizer | None = None, rules: bool = True) -> DataFrame:
    """Suggestions for new claims, from the keyword rules or from a trained model."""
    return suggest_category(claims) if rules else suggest_with_model(categorizer, claims)


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to parquet; once=True processes what is there and stops."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet")
    query = (writer.trigger(availableNow=True) if once else writer).start(path)
    if once:
        query.awaitTermination()
    return query


# --- windowed jobs -----------------------------------------------------------------------------------


def rate_limit_counts(events: DataFrame, client: str = "user_id", at: str = "ts",
                      minutes: int = fixed.RATE_WINDOW_MINUTES, delay: str = "1 hour") -> DataFrame:
    """Requests per client and aligned window; works on streams and tables."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, delay)
    counted = timed.groupBy(F.window(at, f"{minutes} minutes").alias("w"), F.col(client).alias("client")).agg(
        rows_count().alias("requests"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "client", "requests")


def rate_limit_breaches(events: DataFrame, limit: int = fixed.RATE_MAX_REQUESTS, **options) -> DataFrame:
    return rate_limit_counts(events, **options).filter(F.col("requests") > limit)


def stream_daily_trend(expenses: DataFrame, at: str = "created_at", delay: str = "1 day") -> DataFrame:
    """Daily count and total, kept up to date. Rows later than the watermark are
    dropped by Spark and counted in the query's progress (numRowsDroppedByWatermark)."""
    timed = expenses.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, delay)
    daily = timed.groupBy(F.window(at, "1 day").alias("w")).agg(
        rows_count().alias("expense_count"), F.sum("amount").alias("total_amount"))
    return daily.select(F.to_date("w.start").alias("date"), "expense_count", "total_amount")


def latest_table(spark: SparkSession, kind: T.StructType, keys: list[str], folder: str, bucket: Column | None = None,
                 every: int = 16) -> VersionedTable:
    hashed = F.pmod(F.xxhash64(*keys), F.lit(16))
    return VersionedTable(spark, folder, kind, keys, hashed if bucket is None else bucket, every)


def keep_latest(stream: DataFrame, keys: list[str], folder: str, checkpoint: str, bucket: Column | None = None,
                every: int = 16) -> DataFrame:
    """Runs an aggregate in update mode; each micro-batch writes the groups it changed, and every so
    many batches the changed buckets get a snapshot. Returns the table of the last value of each group.

    bucket: what a group is kept under. For windows it should be the day or month of the window: groups
    behind the watermark never change again, so their buckets are never written again either."""
    table = latest_table(stream.sparkSession, stream.schema, keys, folder, bucket, every)

    def each(df: DataFrame, batch: int) -> None:
        table.put(df, batch)
        table.after(batch)

    run_available(stream, checkpoint, "update", each)
    return table.read()


# --- notifications from the audit trail -----------------------------------------------------------------

# audit action -> action whose notification text applies
_TOLD = {"submitted": "submit", "approved": "approve", "rejected": "reject",
         "changes_requested": "request_changes", "reimbursed": "reimburse"}


def notifications_from_audit(audit: DataFrame, expenses: DataFrame, users: DataFrame,
                             delay: str = "1 hour") -> DataFrame:
    """Notification rows for audit rows (stream or table): to the owner, for a
    submission to the expense's approver. An audit id delivered again within the
    delay gives no second one."""
    from spendspark.functions.scalars import display_name

    told = audit.filter(F.col("action").isin(list(_TOLD)))
    if told.isStreaming:
        told = told.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
    else:
        told = told.dropDuplicates(["id"])
    people = users.select(F.col("id").alias("p_id"), display_name(F.col("first_name"), F.col("last_name")).alias("actor"))
    claims = expenses.select(F.col("id").alias("e_id"), F.col("user_id").alias("owner"), "approver_id", "title",
                             "currency", F.col("amount").cast("string").alias("amount"))
    joined = told.select("id", "expense_id", "user_id", "action", "created_at").join(
        claims, F.col("expense_id") == F.col("e_id")).join(people, F.col("user_id") == F.col("p_id"))
    kind, title, message = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for audit_action, action in _TOLD.items():
        n_kind, n_title, template = fixed.NOTIFICATIONS[action]
        hit = F.col("action") == audit_action
        text = F.lit(template)
        for name in ("actor", "currency", "amount", "title"):
            text = F.replace(text, F.lit("{" + name + "}"), F.col(name).cast("string")) \
                if "{" + name + "}" in template else text
        kind = F.when(hit, n_kind).otherwise(kind)
        title = F.when(hit, n_title).otherwise(title)
        message = F.when(hit, text).otherwise(message)
    receiver = F.when(F.col("action") == "submitted", F.col("approver_id")).otherwise(F.col("owner"))
    return joined.withColumns({"n_title": title}).select(
        F.col("id").alias("audit_id"), receiver.alias("user_id"), F.col("n_title").alias("title"),
        message.alias("message"), kind.alias("type"), F.col("expense_id").alias("related_expense_id"),
        F.lit(False).alias("read"), "created_at")
