"""Filters, joined views, sorting, paging."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import at, query
from spendspark import fixed
from spendspark.functions import scalars
from spendspark.functions.predicates import in_year, within
from spendspark.operators import filters, views
from spendspark.plans.fixtures import AS_OF
from spendspark.session import checkpoint_dir
from spendspark.sources import tables

NOW = f"TIMESTAMP '{AS_OF}'"
NAME = "concat({0}.first_name, ' ', {0}.last_name)"
RANK = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(fixed.STATUSES)) + " END"


def placed(ordered, owner):
    """Place of each row among those of its owner in the order in which the rows came."""
    numbered = ordered.withColumn("came", F.monotonically_increasing_id())
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy("came")).cast("long")).drop("came")


@query("accessible_expenses", """
SELECT 'employee' AS role, id FROM expenses WHERE user_id = 7 UNION ALL SELECT 'approver', id FROM expenses
UNION ALL SELECT 'admin', id FROM expenses""")
def _(c):
    """What one viewer of each role may open."""
    seen = [filters.accessible_expenses(c.expenses, 7, role).select(F.lit(role).alias("role"), "id") for role in ("employee", "approver", "admin")]
    return seen[0].union(seen[1]).union(seen[2])


@query("filter_expenses", """
SELECT id, user_id, status, category, CAST(amount AS DOUBLE) AS amount, CAST(expense_date AS VARCHAR) AS expense_date
FROM expenses WHERE status = 'approved' AND category = 'travel' AND expense_date >= DATE '1996-01-01'
  AND expense_date <= DATE '2000-12-31' AND amount >= 500 AND amount <= 4000.50""")
def _(c):
    rows = filters.filter_expenses(c.expenses, user="", status="approved", category="travel", start="1996-01-01",
                                   end="2000-12-31", min_amount="500", max_amount=4000.5)
    return rows.select("id", "user_id", "status", "category", "amount", "expense_date")


@query("filter_users", "SELECT id, role, is_active FROM users WHERE role = 'approver' AND NOT is_active", "users")
def _(c):
    return filters.filter_users(c.users, "approver", "yes").select("id", "role", "is_active")


@query("unread_only", "SELECT id, user_id FROM notifications WHERE NOT read", "notifications")
def _(c):
    return filters.unread_only(c.notifications).select("id", "user_id")


@query("with_status", "SELECT id FROM expenses WHERE status = 'pending'")
def _(c):
    return filters.with_status(c.expenses, "pending").select("id")


@query("safe_user_columns", f"""
SELECT id, email, first_name, last_name, role, department, is_active, email_verified, two_factor_enabled, avatar_url,
       notification_preferences, {at('created_at')} AS created_at, {at('last_login')} AS last_login FROM users""", "users")
def _(c):
    return filters.safe_user_columns(c.users, "profile")


@query("display_name", f"SELECT id, {NAME.format('users')} AS name FROM users", "users")
def _(c):
    return c.users.select("id", scalars.display_name(F.col("first_name"), F.col("last_name")).alias("name"))


@query("within_periods", f"""
SELECT count(*) FILTER (WHERE created_at > {NOW} - INTERVAL '30' DAY) AS days,
       count(*) FILTER (WHERE created_at > {NOW} - INTERVAL '6' MONTH) AS months,
       count(*) FILTER (WHERE created_at > {NOW} - INTERVAL '240' HOUR) AS hours FROM expenses""")
def _(c):
    return c.expenses.agg(*[F.count_if(within("created_at", AS_OF, unit, n)).alias(unit)
                            for unit, n in (("days", 30), ("months", 6), ("hours", 240))])


@query("in_year", "SELECT id FROM expenses WHERE extract(year FROM expense_date) = 2001")
def _(c):
    return c.expenses.filter(in_year("expense_date", AS_OF)).select("id")


@query("check_access", f"""
SELECT e.id AS request_id, e.user_id AS viewer_id, e.expense_id,
       CASE WHEN u.id IS NULL THEN '{fixed.REFUSE_UNKNOWN_ACTOR}' WHEN NOT u.is_active THEN '{fixed.REFUSE_INACTIVE_ACTOR}'
            WHEN x.id IS NULL THEN '{fixed.REFUSE_NOT_FOUND}'
            WHEN u.role IN ('approver', 'admin') OR x.user_id = e.user_id THEN 'granted'
            ELSE '{fixed.REFUSE_ACCESS}' END AS access
FROM audit_log e LEFT JOIN users u ON u.id = e.user_id LEFT JOIN expenses x ON x.id = e.expense_id""",
       "audit_log users expenses")
def _(c):
    asked = c.audit_log.select(F.col("id").alias("request_id"), F.col("user_id").alias("viewer_id"), "expense_id")
    return filters.check_access(asked, c.users, c.expenses)


# --- joins ---------------------------------------------------------------------------------


@query("expense_list", f"""
SELECT e.id, e.user_id, e.title, e.status, CASE WHEN a.id IS NULL THEN ' ' ELSE {NAME.format('a')} END AS approver_name
FROM expenses e LEFT JOIN users a ON e.approver_id = a.id""", "users expenses")
def _(c):
    return views.expense_list(c.expenses, c.users).select("id", "user_id", "title", "status", "approver_name")


@query("expense_list_page", f"""
SELECT e.id, e.user_id, CAST(e.amount AS DOUBLE) AS amount, CAST(e.rn AS INT) AS rn,
       CASE WHEN a.id IS NULL THEN ' ' ELSE {NAME.format('a')} END AS approver_name
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, id) AS rn FROM expenses) e
LEFT JOIN users a ON e.approver_id = a.id WHERE e.rn BETWEEN 4 AND 6""", "users expenses")
def _(c):
    return views.expense_list(c.expenses, c.users, "amount", "DESC", page_no=2, limit=3).select(
        "id", "user_id", "amount", "rn", "approver_name")


@query("with_submitter_contact", """
SELECT e.id, e.status, u.email, u.first_name, u.last_name FROM expenses e JOIN users u ON e.user_id = u.id""",
       "users expenses")
def _(c):
    return views.with_submitter_contact(c.expenses, c.users).select("id", "status", "email", "first_name", "last_name")


@query("expense_detail", f"""
SELECT e.id, CAST(e.amount AS DOUBLE) AS amount, {NAME.format('u')} AS user_name, u.email AS user_email,
       CASE WHEN a.id IS NULL THEN ' ' ELSE {NAME.format('a')} END AS approver_name, a.email AS approver_email
FROM expenses e JOIN users u ON e.user_id = u.id LEFT JOIN users a ON e.approver_id = a.id""", "users expenses")
def _(c):
    return views.expense_detail(c.expenses, c.users).select(
        "id", "amount", "user_name", "user_email", "approver_name", "approver_email")


@query("comment_thread", f"""
SELECT c.id, c.expense_id, c.comment, c.is_internal, {NAME.format('u')} AS user_name,
       row_number() OVER (PARTITION BY c.expense_id ORDER BY c.created_at, c.id) AS place
FROM comments c JOIN users u ON c.user_id = u.id""", "users comments")
def _(c):
    return placed(views.comment_thread(c.comments, c.users), "expense_id").select(
        "id", "expense_id", "comment", "is_internal", "user_name", "place")


@query("audit_trail", f"""
SELECT a.id, a.expense_id, a.action, a.metadata, {NAME.format('u')} AS user_name,
       row_number() OVER (PARTITION BY a.expense_id ORDER BY a.created_at DESC, a.id) AS place
FROM audit_log a JOIN users u ON a.user_id = u.id""", "users audit_log")
def _(c):
    return placed(views.audit_trail(c.audit_log, c.users), "expense_id").select(
        "id", "expense_id", "action", "metadata", "user_name", "place")


LINES = f"""lines AS (SELECT c.expense_id, 'comment' AS section, c.id AS line_id, {NAME.format('u')} AS user_name, c.comment AS text,
    row_number() OVER (PARTITION BY c.expense_id ORDER BY c.created_at, c.id) AS place
  FROM comments c JOIN users u ON c.user_id = u.id
  UNION ALL SELECT a.expense_id, 'audit', a.id, {NAME.format('u')}, a.action,
    row_number() OVER (PARTITION BY a.expense_id ORDER BY a.created_at DESC, a.id DESC)
  FROM audit_log a JOIN users u ON a.user_id = u.id)"""


@query("expense_dossier", f"WITH {LINES} SELECT expense_id, section, CAST(line_id AS VARCHAR) AS line_id, user_name, text, place FROM lines",
       "users expenses comments audit_log")
def _(c):
    lines = views.expense_dossier(c.users, c.comments.withColumn("id", F.col("id").cast("string")), c.audit_log.withColumn("id", F.col("id").cast("string")))
    return lines.select("expense_id", "section", "line_id", "user_name", "text",
                        F.row_number().over(Window.partitionBy("expense_id", "section").orderBy(*views.dossier_order())).cast("long").alias("place"))


@query("dossier_nested", f"""WITH {LINES},
talk AS (SELECT expense_id, count(*) AS n, string_agg(user_name || ': ' || text, chr(10) ORDER BY place) AS lines
         FROM lines WHERE section = 'comment' GROUP BY expense_id),
trail AS (SELECT expense_id, count(*) AS n, string_agg(user_name || ': ' || text, ', ' ORDER BY place) AS lines
          FROM lines WHERE section = 'audit' GROUP BY expense_id)
SELECT e.id, {NAME.format('u')} AS user_name,
       CASE WHEN p.id IS NULL THEN ' ' ELSE {NAME.format('p')} END AS approver_name,
       CAST(coalesce(talk.n, 0) AS INT) AS comment_count, coalesce(talk.lines, '') AS comments,
       CAST(coalesce(trail.n, 0) AS INT) AS audit_count, coalesce(trail.lines, '') AS audit_log
FROM expenses e JOIN users u ON e.user_id = u.id LEFT JOIN users p ON e.approver_id = p.id
LEFT JOIN talk ON talk.expense_id = e.id LEFT JOIN trail ON trail.expense_id = e.id""",
       "users expenses comments audit_log")
def _(c):
    lines = views.expense_dossier(c.users, c.comments.withColumn("id", F.col("id").cast("string")), c.audit_log.withColumn("id", F.col("id").cast("string")))
    d = views.nest(views.expense_detail(c.expenses, c.users), lines)

    def joined(column, sep):
        return F.array_join(F.transform(column, lambda x: F.concat(x["user_name"], F.lit(": "), x["text"])), sep)

    return d.select("id", "user_name", "approver_name", F.size("comments").alias("comment_count"),
                    joined("comments", "\n").alias("comments"), F.size("audit_log").alias("audit_count"),
                    joined("audit_log", ", ").alias("audit_log"))


@query("page_per_user_deep", """
WITH ranked AS (SELECT id, user_id % 2 AS user_id, row_number() OVER (PARTITION BY user_id % 2 ORDER BY created_at DESC NULLS FIRST, id) AS rn FROM expenses)
SELECT id, user_id, rn FROM ranked WHERE rn > 1180 AND rn <= 1200""", "expenses")
def _(c):
    """Page 60 of two users who hold all rows."""
    rows = c.expenses.withColumn("user_id", F.col("user_id") % 2)
    return views.page_per_user(rows, views.sort_keys(), page=60, limit=20).select("id", "user_id", F.col("rn").cast("long").alias("rn"))


@query("pending_queue", f"""
SELECT e.id, {at('e.created_at')} AS created_at, {NAME.format('u')} AS user_name, u.email AS user_email,
       u.department AS user_department, row_number() OVER (PARTITION BY e.user_id ORDER BY e.created_at, e.id) AS place
FROM expenses e JOIN users u ON e.user_id = u.id WHERE e.status = 'pending'""", "users expenses")
def _(c):
    return placed(views.pending_queue(c.expenses, c.users), "user_id").select(
        "id", "created_at", "user_name", "user_email", "user_department", "place")


@query("pending_queue_page", f"""
SELECT e.id, {NAME.format('u')} AS user_name FROM expenses e JOIN users u ON e.user_id = u.id
WHERE e.status = 'pending' ORDER BY e.created_at, e.id LIMIT 20 OFFSET 40""", "users expenses")
def _(c):
    return views.pending_queue(c.expenses, c.users, 3, 20).select("id", "user_name")


@query("resolve_keys", """
WITH dim AS (SELECT lower(department) AS code, id FROM users
             UNION ALL SELECT email, id FROM users),
one AS (SELECT code, min(id) AS id, count(*) AS n FROM dim GROUP BY code)
SELECT n.id, CASE WHEN one.code IS NULL THEN 'missing' WHEN one.n > 1 THEN 'ambiguous' END AS resolve_error,
       CASE WHEN one.n = 1 THEN one.id END AS resolved_id
FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'building' ELSE 'user' || (user_id * 20) || '@example.com' END AS code
      FROM notifications) n LEFT JOIN one ON one.code = n.code""", "users notifications")
def _(c):
    dim = c.users.selectExpr("lower(department) AS code", "id").unionByName(
        c.users.selectExpr("email AS code", "id"))
    rows = c.notifications.selectExpr(
        "id", "CASE WHEN id % 4 = 0 THEN 'building' ELSE 'user' || (user_id * 20) || '@example.com' END AS code")
    return views.resolve_keys(rows, dim, "code").select("id", "resolve_error", "resolved_id")


@query("assign_approver", """
WITH slots AS (SELECT id AS assigned_to, row_number() OVER (ORDER BY id % 256, id) - 1 AS slot FROM users
               WHERE role IN ('approver', 'admin') AND is_active)
SELECT e.id, s.assigned_to FROM expenses e
JOIN slots s ON s.slot = e.id % (SELECT count(*) FROM slots) WHERE e.status = 'draft'""", "users expenses")
def _(c):
    drafts = c.expenses.filter("status = 'draft'")
    return views.assign_approver(drafts, c.users, bucket=F.pmod("id", F.lit(256)), pick=F.col("id")).select(
        "id", "assigned_to")


@query("owner_of", """
SELECT a.id, e.user_id AS owner_id FROM audit_log a JOIN expenses e ON e.id = a.expense_id""", "audit_log expenses")
def _(c):
    return views.owner_of(c.audit_log.select("id", "expense_id"), c.expenses).select("id", "owner_id")


# --- windows, sorting, paging --------------------------------------------------------------------


@query("page_per_user", f"""
SELECT id, user_id, CAST(rn AS INT) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {RANK} ASC, id) AS rn FROM expenses) x
WHERE rn BETWEEN 6 AND 10""")
def _(c):
    return views.page_per_user(c.expenses, views.sort_keys("status", "asc"), 2, 5).select("id", "user_id", "rn")


@query("recent_expenses", """
SELECT id, user_id, CAST(rn AS INT) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rn FROM expenses) x WHERE rn <= 3""")
def _(c):
    return views.recent_expenses(c.expenses).select("id", "user_id", "rn")


@query("sort_expenses", f"""SELECT id, user_id, status, row_number() OVER (PARTITION BY user_id ORDER BY {RANK} DESC, id) AS place FROM expenses""")
def _(c):
    return placed(views.sort_expenses(c.expenses, "status", "down"), "user_id").select("id", "user_id", "status", "place")


@query("page", "SELECT id FROM expenses ORDER BY title ASC, id LIMIT 25 OFFSET 50")
def _(c):
    return views.page(c.expenses, views.sort_keys("title", "asc"), 3, 25).select("id")


@query("expense_activity", f"""
WITH s AS (SELECT expense_id, count(*) AS n, max(created_at) AS last FROM comments GROUP BY expense_id),
a AS (SELECT expense_id, count(*) AS n, max(created_at) AS last FROM audit_log GROUP BY expense_id)
SELECT e.id, coalesce(s.n, 0) AS n_comments, {at('s.last')} AS last_comment_at, coalesce(a.n, 0) AS n_audit, {at('a.last')} AS last_audit_at
FROM expenses e LEFT JOIN s ON s.expense_id = e.id LEFT JOIN a ON a.expense_id = e.id""", "expenses comments audit_log")
def _(c):
    """From tables bucketed by the expense."""
    run = uuid.uuid4().hex
    stored = [tables.write_bucketed(df, f"{name}_{run}", f"{checkpoint_dir(c.spark)}/{name}-{run}", key, 8) for name, df, key in (
        ("expenses", c.expenses, "id"), ("comments", c.comments, "expense_id"), ("audit", c.audit_log, "expense_id"))]
    return views.with_activity(*stored).select("id", "n_comments", "last_comment_at", "n_audit", "last_audit_at")


@query("page_from_ranges", "SELECT id, title FROM (SELECT * FROM expenses ORDER BY title DESC NULLS FIRST, id LIMIT 20 OFFSET 9980)")
def _(c):
    """Page 500 of all expenses, from the ranges that hold it."""
    return views.RangedPages(c.expenses.select("id", "title"), views.sort_keys("title", "desc"), 64).page(500, 20)


@query("page_after", f"""
SELECT id, {at('created_at')} AS created_at FROM expenses
WHERE created_at < TIMESTAMP '2000-01-01' OR (created_at = TIMESTAMP '2000-01-01' AND id > 100)
ORDER BY expenses.created_at DESC, id LIMIT 50""")
def _(c):
    return views.page_after(c.expenses, "created_at", "2000-01-01 00:00:00", 100, 50).select("id", "created_at")


@query("training_sample", f"""
SELECT id, title, vendor, CAST(amount AS DOUBLE) AS amount, category FROM expenses
WHERE status IN ('approved', 'reimbursed') AND created_at > {NOW} - INTERVAL '6' MONTH
ORDER BY created_at DESC, id LIMIT 1000""")
def _(c):
    return views.training_sample(c.expenses, AS_OF).select("id", "title", "vendor", "amount", "category")


@query("retry_candidates", f"""
SELECT id, attempts FROM ocr_queue WHERE status = 'failed' AND attempts < max_attempts
  AND created_at > {NOW} - INTERVAL '240' HOUR""", "ocr_queue")
def _(c):
    return views.retry_candidates(c.ocr_queue, AS_OF, None, 240).select("id", "attempts")


@query("user_list", f"""
SELECT id, email, role, is_active, {at('created_at')} AS created_at FROM users WHERE role = 'employee' AND is_active
ORDER BY users.created_at DESC, id LIMIT 20 OFFSET 20""", "users")
def _(c):
    return views.user_list(c.users, "employee", "true", 2).select("id", "email", "role", "is_active", "created_at")


@query("notification_list", f"""
SELECT id, user_id, CAST(rn AS INT) AS rn, {at('created_at')} AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rn
  FROM notifications WHERE NOT read) x WHERE rn BETWEEN 11 AND 20""", "notifications")
def _(c):
    return views.notification_list(c.notifications, True, 2, 10).select("id", "user_id", "rn", "created_at")


# --- scalars, keys, files --------------------------------------------------------------------------


@query("storage_keys", """
SELECT id, concat('receipts/', user_id, '/', id, '.pdf') AS storage_key,
       concat('receipts/', user_id, '/', id, '.jpg') AS receipt_key, concat(user_id, '/', id, '.jpg') AS short_key
FROM expenses""")
def _(c):
    return c.expenses.select(
        "id", scalars.storage_key("receipts", F.col("user_id"), F.col("id").cast("string"), F.lit(".pdf")).alias("storage_key"),
        scalars.receipt_key(F.col("receipt_url")).alias("receipt_key"),
        scalars.receipt_key(F.col("receipt_url"), 2).alias("short_key"))


@query("local_texts", """
SELECT id, concat('R$', chr(160), replace(replace(replace(format('{:,.2f}', CAST(amount AS DOUBLE)), ',', '_'), '.', ','), '_', '.'))
         AS amount_text, strftime(expense_date, '%d/%m/%Y') AS date_text FROM expenses""")
def _(c):
    return c.expenses.select("id", scalars.money_text(F.col("amount"), F.col("currency")).alias("amount_text"),
                             scalars.date_text(F.col("expense_date")).alias("date_text"))


@query("leading_number", """
SELECT id, TRY_CAST(nullif(regexp_extract(description, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DOUBLE) AS n
FROM expenses""")
def _(c):
    return c.expenses.select("id", scalars.leading_number(F.col("description")).alias("n"))


@query("insert_ignore", """
WITH new_rows AS (SELECT lower(email) AS email, min(id) AS id FROM (
    SELECT id + 1000 AS id, 'user' || (id + 1000) || '@example.com' AS email FROM users
    UNION ALL SELECT id + 5000, 'user' || (id + 1000) || '@example.com' FROM users) x GROUP BY ALL)
SELECT id, email FROM users UNION ALL
SELECT id, email FROM new_rows n WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.email = n.email)""", "users")
def _(c):
    new = c.users.selectExpr("id + 1000 AS id", "'user' || (id + 1000) || '@example.com' AS email").unionByName(
        c.users.selectExpr("id + 5000 AS id", "'user' || (id + 1000) || '@example.com' AS email"))
    return tables.insert_ignore(c.users.select("id", "email"), new, "email")


@query("expense_report", f"""
SELECT CAST(e.id AS VARCHAR) AS id, e.title, e.vendor,
       concat('R$', chr(160), replace(replace(replace(format('{{:,.2f}}', CAST(amount AS DOUBLE)), ',', '_'), '.', ','), '_', '.'))
         AS amount, strftime(e.expense_date, '%d/%m/%Y') AS expense_date,
       CASE WHEN a.id IS NULL THEN ' ' ELSE {NAME.format('a')} END AS approver_name
FROM expenses e LEFT JOIN users a ON e.approver_id = a.id""", "users expenses")
def _(c):
    """The CSV export, written to the shared folder and read back."""
    import uuid

    from spendspark.session import checkpoint_dir

    path = f"{checkpoint_dir(c.spark)}/report-{uuid.uuid4().hex}"
    tables.export_csv(views.expense_list(c.expenses, c.users), path, localized=True)
    back = c.spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return back.select("id", "title", "vendor", "amount", "expense_date", "approver_name")


@query("typed_tables", """
SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, CAST(amount AS DOUBLE) AS amount,
       CAST(expense_date AS VARCHAR) AS expense_date, status FROM expenses""")
def _(c):
    """The expense table written by month and read back in declared types."""
    import uuid

    from spendspark.session import checkpoint_dir

    path = f"{checkpoint_dir(c.spark)}/expenses-{uuid.uuid4().hex}"
    tables.write_table(c.expenses, path, "expense_month")
    return tables.read_table(c.spark, "expenses", path).select("id", "user_id", "amount", "expense_date", "status")
