"""Streaming jobs run over the event tables until they are used up, against the SQL of
their batch twins."""

import uuid

from pyspark.sql import functions as F

from checks.registry import at, query
from checks.suggestions import ALL
from checks.receipts import DAY, READ
from checks.workflow import VIEWS, WALK
from spendspark.session import checkpoint_dir
from spendspark.streaming import jobs


def folder(c, name):
    return f"{checkpoint_dir(c.spark)}/{name}-{uuid.uuid4().hex}"


def stream_of(c, df, name):
    """The rows as a file stream."""
    path = folder(c, f"{name}-source")
    df.write.parquet(path)
    return c.spark.readStream.schema(df.schema).parquet(path)


def run_actions(c):
    """Three deliveries in order of time, the later two with the one before repeated;
    each is worked off as it arrives."""
    source, offsets = folder(c, "actions-source"), folder(c, "offsets")
    job = jobs.ActionStream(c.expenses, c.users, folder(c, "state"), buckets=8, every=2, bucket=F.pmod("id", F.lit(256)), pick=F.col("sent_id"))
    third = F.ceil(F.dayofmonth("ts") / 11)
    for delivery in (1, 2, 3):
        part = c.actions.filter(third.isin(delivery, delivery - 1))
        part.write.mode("append").parquet(source)
        job.run(c.spark.readStream.schema(c.actions.schema).parquet(source), offsets)
    return job


@query("stream_actions_expenses", WALK + f"""
SELECT id, user_id, title, CAST(amount AS DOUBLE) AS amount, status, approver_id, approval_notes,
       {at('approved_at')} AS approved_at, {at('updated_at')} AS updated_at FROM state""", VIEWS)
def _(c):
    return run_actions(c).current().select(
        "id", "user_id", "title", "amount", "status", "approver_id", "approval_notes", "approved_at", "updated_at")


@query("stream_actions_rejected", WALK + """
SELECT action_id, expense_id, actor_id, action, reason FROM done WHERE reason IS NOT NULL""", VIEWS)
def _(c):
    actions = c.actions
    kind = actions.select("action_id", "expense_id", "actor_id", "action", F.lit("").alias("reason")).schema
    return run_actions(c).output("rejected", kind)


@query("stream_receipts", f"WITH {READ} SELECT expense_id, vendor, amount, {DAY} AS date FROM read", "receipts")
def _(c):
    parsed = jobs.stream_receipts(stream_of(c, c.receipts, "receipts"))
    flat = parsed.select("expense_id", "parsed.vendor", "parsed.amount", "parsed.date")
    path = folder(c, "receipts")
    jobs.write_stream(flat, path, folder(c, "offsets"))
    return c.spark.read.schema(flat.schema).parquet(path)


@query("stream_suggestions", f"{ALL} SELECT id, category, round(confidence, 9) AS confidence FROM final")
def _(c):
    suggested = jobs.stream_suggestions(stream_of(c, c.expenses, "claims")).select(
        "id", F.col("suggested_category").alias("category"), F.round("suggested_confidence", 9).alias("confidence"))
    path = folder(c, "suggestions")
    jobs.write_stream(suggested, path, folder(c, "offsets"))
    return c.spark.read.schema(suggested.schema).parquet(path)


RATE = """SELECT strftime(time_bucket(INTERVAL '15' MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS client,
       count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1"""


@query("rate_limit_breaches", RATE, "")
def _(c):
    return jobs.rate_limit_breaches(c.base("events"), 1).select("window_start", "client", "requests")


@query("stream_rate_limit", RATE, "")
def _(c):
    counts = jobs.rate_limit_counts(stream_of(c, c.base("events"), "requests"))
    kept = jobs.keep_latest(counts, ["window_start", "window_end", "client"], folder(c, "rates"), folder(c, "offsets"),
                            bucket=F.to_date("window_start"))
    return kept.filter("requests > 1").select("window_start", "client", "requests")


@query("stream_daily_trend", """
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, count(*) AS expense_count, CAST(sum(amount) AS DOUBLE) AS total_amount
FROM expenses GROUP BY ALL""")
def _(c):
    daily = jobs.stream_daily_trend(stream_of(c, c.expenses, "claims"))
    return jobs.keep_latest(daily, ["date"], folder(c, "daily"), folder(c, "offsets"), bucket=F.date_format("date", "yyyy-MM"))


TOLD = """SELECT a.id AS audit_id, CASE WHEN a.action = 'submitted' THEN e.approver_id ELSE e.user_id END AS user_id,
       CASE a.action WHEN 'submitted' THEN 'approval_request' WHEN 'approved' THEN 'expense_approved' ELSE 'expense_rejected' END AS type,
       CASE a.action WHEN 'submitted' THEN concat(u.first_name, ' ', u.last_name, ' submitted an expense for BRL ', e.amount)
         ELSE concat('Your expense "', e.title, '" has been ', a.action, ' by ', u.first_name, ' ', u.last_name) END AS message
FROM audit_log a JOIN expenses e ON e.id = a.expense_id JOIN users u ON u.id = a.user_id
WHERE a.action IN ('submitted', 'approved', 'rejected')"""


@query("notifications_from_audit", TOLD, "users expenses audit_log")
def _(c):
    twice = c.audit_log.unionByName(c.audit_log)
    return jobs.notifications_from_audit(twice, c.expenses, c.users).select("audit_id", "user_id", "type", "message")


@query("stream_notifications", TOLD, "users expenses audit_log")
def _(c):
    audit = stream_of(c, c.audit_log.unionByName(c.audit_log), "audit")
    told = jobs.notifications_from_audit(audit, c.expenses, c.users).select("audit_id", "user_id", "type", "message")
    path = folder(c, "told")
    jobs.write_stream(told, path, folder(c, "offsets"))
    return c.spark.read.schema(told.schema).parquet(path)
