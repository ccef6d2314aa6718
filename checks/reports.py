"""Aggregate reports against plain GROUP BY queries."""

from pyspark.sql import functions as F

from checks.registry import query
from spendspark.operators import reports, views
from spendspark.plans.fixtures import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
RECENT = f"created_at > {NOW} - INTERVAL '30' DAY"
MEAN = "CAST(SUM(amount) AS DOUBLE) / COUNT(amount)"
SUMMARY = """count(e.id) AS total_expenses,
       count(*) FILTER (WHERE e.status = 'pending') AS pending_count,
       count(*) FILTER (WHERE e.status = 'approved') AS approved_count,
       count(*) FILTER (WHERE e.status = 'rejected') AS rejected_count,
       count(*) FILTER (WHERE e.status = 'reimbursed') AS reimbursed_count,
       CAST(coalesce(sum(e.amount), 0) AS DOUBLE) AS total_amount,
       CAST(coalesce(sum(CASE WHEN e.status = 'pending' THEN e.amount ELSE 0 END), 0) AS DOUBLE) AS pending_amount,
       CAST(coalesce(sum(CASE WHEN e.status IN ('approved', 'reimbursed') THEN e.amount ELSE 0 END), 0) AS DOUBLE)
         AS approved_amount"""


@query("user_summary", f"""
SELECT u.id AS user_id, {SUMMARY}
FROM users u LEFT JOIN expenses e ON e.user_id = u.id GROUP BY u.id""", "users expenses")
def _(c):
    return reports.user_summary(c.expenses, c.users)


@query("status_flags", """
SELECT """ + ", ".join(
    f"count(*) FILTER (WHERE status = '{s}') AS {s}_count, "
    f"CAST(coalesce(sum(amount) FILTER (WHERE status = '{s}'), 0) AS DOUBLE) AS {s}_amount"
    for s in ("draft", "pending", "approved", "rejected", "reimbursed", "changes_requested")) + " FROM expenses")
def _(c):
    return reports.status_flags(c.expenses)


@query("monthly_breakdown", f"""
SELECT user_id, CAST(CAST(date_trunc('month', expense_date) AS DATE) AS VARCHAR) AS month,
       count(*) AS count, CAST(sum(amount) AS DOUBLE) AS total_amount
FROM expenses WHERE extract(year FROM expense_date) = extract(year FROM {NOW}) GROUP BY ALL""")
def _(c):
    return reports.monthly_breakdown(c.expenses, AS_OF)


@query("category_breakdown", """
SELECT user_id, category, count(*) AS count, CAST(sum(amount) AS DOUBLE) AS total_amount
FROM expenses GROUP BY ALL""")
def _(c):
    return reports.category_breakdown(c.expenses)


STATUS_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}_expenses"
                          for s in ("pending", "approved", "rejected", "reimbursed"))


@query("system_stats", f"""
SELECT count(*) AS total_expenses, count(DISTINCT user_id) AS active_users, {STATUS_COUNTS},
       CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount, coalesce({MEAN}, 0) AS avg_amount
FROM expenses WHERE {RECENT}""")
def _(c):
    return reports.system_stats(c.expenses, AS_OF)


@query("user_role_stats", """
SELECT count(*) AS total_users, count(*) FILTER (WHERE is_active) AS active_users,
       count(*) FILTER (WHERE role = 'employee') AS employees, count(*) FILTER (WHERE role = 'approver') AS approvers,
       count(*) FILTER (WHERE role = 'admin') AS admins FROM users""", "users")
def _(c):
    return reports.user_role_stats(c.users)


@query("category_stats", f"""
SELECT category, count(*) AS count, CAST(sum(amount) AS DOUBLE) AS total_amount, {MEAN} AS avg_amount
FROM expenses WHERE {RECENT} GROUP BY category""")
def _(c):
    return reports.category_stats(c.expenses, AS_OF)


@query("category_share", f"""
SELECT category, CAST(sum(amount) AS DOUBLE) AS total_amount,
       CAST(round(100 * (CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER () AS DOUBLE)), 0) AS INT) AS percent
FROM expenses WHERE {RECENT} GROUP BY category""")
def _(c):
    return reports.category_share(c.expenses, AS_OF)


@query("daily_trend", f"""
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, count(*) AS expense_count,
       CAST(sum(amount) AS DOUBLE) AS total_amount
FROM expenses WHERE {RECENT} GROUP BY ALL""")
def _(c):
    return reports.daily_trend(c.expenses, AS_OF)


@query("daily_trend_filled", f"""
SELECT CAST(d AS VARCHAR) AS date, count(e.id) AS expense_count, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-05-04', {NOW}, INTERVAL '1' DAY)) AS DATE) AS d) AS days
LEFT JOIN (SELECT * FROM expenses WHERE created_at > {NOW} - INTERVAL '90' DAY) e ON CAST(e.created_at AS DATE) = d
GROUP BY d""")
def _(c):
    return reports.daily_trend(c.expenses, AS_OF, days=90, fill=True)


@query("user_stats", f"""
SELECT user_id, count(*) AS total_expenses, {STATUS_COUNTS}, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount,
       {MEAN} AS avg_amount, CAST(max(amount) AS DOUBLE) AS max_amount
FROM expenses WHERE {RECENT} GROUP BY user_id""")
def _(c):
    return reports.user_stats(c.expenses, AS_OF)


@query("user_monthly_trend", f"""
SELECT user_id, CAST(CAST(date_trunc('month', created_at) AS DATE) AS VARCHAR) AS month, count(*) AS expense_count,
       CAST(sum(amount) AS DOUBLE) AS total_amount
FROM expenses WHERE created_at > {NOW} - INTERVAL '12' MONTH GROUP BY ALL""")
def _(c):
    return reports.user_monthly_trend(c.expenses, AS_OF)


@query("user_category_stats", f"""
SELECT user_id, category, count(*) AS count, CAST(sum(amount) AS DOUBLE) AS total_amount, {MEAN} AS avg_amount
FROM expenses WHERE {RECENT} GROUP BY ALL""")
def _(c):
    return reports.user_category_stats(c.expenses, AS_OF)


SUGGESTIONS = """count(*) AS total_expenses, count(ml_suggested_category) AS ml_categorized,
       count(*) FILTER (WHERE ml_suggested_category = category) AS ml_correct,
       CAST(sum(ml_confidence) AS DOUBLE) / count(ml_confidence) AS avg_confidence"""


@query("suggestion_stats_by_category", f"SELECT category, {SUGGESTIONS} FROM expenses WHERE {RECENT} GROUP BY category")
def _(c):
    return reports.suggestion_stats_by_category(c.expenses, AS_OF)


@query("suggestion_stats_overall", f"SELECT {SUGGESTIONS} FROM expenses WHERE {RECENT}")
def _(c):
    return reports.suggestion_stats_overall(c.expenses, AS_OF)


@query("suggestion_stats", f"""
SELECT category, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS level, {SUGGESTIONS}
FROM expenses WHERE {RECENT} GROUP BY ROLLUP (category)""")
def _(c):
    return reports.suggestion_stats(c.expenses, AS_OF)


@query("count_matching", """
SELECT user_id, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
FROM expenses WHERE status = 'pending' GROUP BY user_id""")
def _(c):
    return views.count_matching(c.expenses.filter("status = 'pending'"), 20, ["user_id"])


@query("count_matching_all", """
SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM notifications WHERE NOT read""",
       "notifications")
def _(c):
    return views.count_matching(c.notifications.filter("NOT read"), 20)


@query("training_counts", f"""
SELECT category, count(*) AS samples, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM expenses
WHERE status IN ('approved', 'reimbursed') AND created_at > {NOW} - INTERVAL '6' MONTH GROUP BY category""")
def _(c):
    return reports.training_counts(views.training_sample(c.expenses, AS_OF, None))


@query("classification_report", """
WITH pairs AS (SELECT category AS actual, ml_suggested_category AS said FROM expenses
               WHERE ml_suggested_category IS NOT NULL),
classes AS (SELECT actual AS class FROM pairs UNION SELECT said FROM pairs),
per AS (SELECT class, (SELECT count(*) FROM pairs WHERE actual = class) AS support,
               (SELECT count(*) FROM pairs WHERE said = class) AS said_n,
               (SELECT count(*) FROM pairs WHERE said = class AND actual = class) AS hits FROM classes),
pr AS (SELECT class, support, hits, CASE WHEN said_n > 0 THEN hits / said_n ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM pr),
rows AS (
SELECT class, precision, recall, f1, support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) FROM f
UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support)
          FROM f)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
       CAST(support AS BIGINT) AS support FROM rows""")
def _(c):
    said = c.expenses.filter("ml_suggested_category IS NOT NULL")
    report = reports.classification_report(said, "category", "ml_suggested_category")
    return report.withColumns({m: F.round(m, 9) for m in ("precision", "recall", "f1")})
