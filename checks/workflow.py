"""The approval workflow against a step-by-step recursive query, and history backfill."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import at, query
from spendspark import fixed
from spendspark.operators import workflow

TEXT_ACTIONS = "', '".join(fixed.REFUSE_TEXT)


def cases(column, values):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


NEEDED = cases("a.action", {a: t[0] for a, t in fixed.TRANSITIONS.items()} | {"update": "draft", "delete": "draft"})
WALK = f"""WITH RECURSIVE acts AS (
  SELECT a.*, u.role, u.first_name || ' ' || u.last_name AS actor_name,
         row_number() OVER (PARTITION BY a.expense_id ORDER BY a.ts, a.action_id) AS rn,
         CASE WHEN u.id IS NULL THEN '{fixed.REFUSE_UNKNOWN_ACTOR}'
              WHEN NOT u.is_active THEN '{fixed.REFUSE_INACTIVE_ACTOR}'
              WHEN a.action IN ('approve', 'reject', 'request_changes') AND u.role = 'employee' THEN '{fixed.REFUSE_ROLE}'
              WHEN a.action = 'reimburse' AND u.role <> 'admin' THEN '{fixed.REFUSE_ROLE}'
              WHEN a.action IN ('{TEXT_ACTIONS}') AND coalesce(trim(a.notes), '') = ''
                THEN {cases('a.action', fixed.REFUSE_TEXT)}
              WHEN a.action IN ('create', 'update') AND a.amount = '-1' THEN 'Validation failed: {fixed.MSG_AMOUNT}'
         END AS early
  FROM actions a LEFT JOIN users u ON u.id = a.actor_id),
walk AS (
  SELECT s.expense_id, CAST(0 AS BIGINT) AS rn, e.status, e.user_id AS owner, CAST(NULL AS BIGINT) AS action_id,
         CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS before
  FROM (SELECT DISTINCT expense_id FROM acts) s LEFT JOIN expenses e ON e.id = s.expense_id
  UNION ALL
  SELECT expense_id, rn,
         CASE WHEN reason IS NOT NULL THEN status WHEN action = 'create' THEN 'draft' WHEN action = 'delete' THEN 'gone'
              ELSE coalesce({cases('action', workflow.NEW_STATE)}, status) END,
         CASE WHEN reason IS NULL AND action = 'create' THEN actor_id ELSE owner END,
         action_id, reason, status
  FROM (SELECT a.expense_id, a.rn, w.status, w.owner, a.action_id, a.action, a.actor_id,
          CASE WHEN a.early IS NOT NULL THEN a.early
               WHEN a.action = 'create' THEN CASE WHEN w.status IS NOT NULL THEN 'Expense already exists' END
               WHEN w.status IS NULL OR w.status = 'gone' THEN '{fixed.REFUSE_NOT_FOUND}'
               WHEN a.action IN ('update', 'submit', 'delete') AND w.owner <> a.actor_id THEN '{fixed.REFUSE_NOT_FOUND}'
               WHEN a.action = 'comment' AND w.owner <> a.actor_id AND a.role = 'employee'
                 THEN '{fixed.REFUSE_COMMENT_ACCESS}'
               WHEN {NEEDED} <> w.status THEN {cases('a.action', fixed.REFUSE_STATE)} END AS reason
        FROM walk w JOIN acts a ON a.expense_id = w.expense_id AND a.rn = w.rn + 1) AS step),
done AS (SELECT a.*, w.reason, w.before FROM walk w JOIN acts a ON a.action_id = w.action_id),
gone AS (SELECT expense_id FROM done WHERE reason IS NULL AND action = 'delete'),
ok AS (SELECT * FROM done WHERE reason IS NULL AND expense_id NOT IN (SELECT expense_id FROM gone)),
slots AS (SELECT id, row_number() OVER (ORDER BY id % 256, id) - 1 AS slot FROM users
          WHERE role IN ('approver', 'admin') AND is_active),
sent AS (SELECT ok.expense_id, s.id AS assigned FROM ok JOIN slots s ON s.slot = ok.expense_id % (SELECT count(*) FROM slots)
         WHERE ok.action = 'submit'),
edit AS (SELECT expense_id, arg_max(title, rn) AS title, arg_max(amount, rn) AS amount, arg_max(expense_date, rn) AS day,
                arg_max(category, rn) AS category, arg_max(receipt_url, rn) FILTER (WHERE receipt_url IS NOT NULL) AS url,
                count(*) FILTER (WHERE action = 'update') AS updates
         FROM ok WHERE action IN ('create', 'update') GROUP BY expense_id),
fate AS (SELECT expense_id, max(ts) FILTER (WHERE action <> 'comment') AS touched,
                arg_max(actor_id, rn) FILTER (WHERE action IN ('approve', 'reject', 'request_changes')) AS decider,
                arg_max(struct_pack(n := notes), rn) FILTER (WHERE action IN ('approve', 'reject', 'request_changes')) AS word,
                max(ts) FILTER (WHERE action = 'approve') AS approved, max(ts) FILTER (WHERE action = 'reject') AS rejected,
                max(ts) FILTER (WHERE action = 'reimburse') AS reimbursed, max(actor_id) FILTER (WHERE action = 'create') AS maker,
                max(ts) FILTER (WHERE action = 'create') AS born
         FROM ok GROUP BY expense_id),
last AS (SELECT expense_id, arg_max(status, rn) AS status, arg_max(owner, rn) AS owner FROM walk GROUP BY expense_id),
state AS (
  SELECT coalesce(e.id, f.expense_id) AS id, coalesce(e.user_id, f.maker) AS user_id, coalesce(d.title, e.title) AS title,
         coalesce(CAST(d.amount AS DECIMAL(10,2)), e.amount) AS amount,
         coalesce(CAST(d.day AS DATE), e.expense_date) AS expense_date, coalesce(d.category, e.category) AS category,
         CASE WHEN d.expense_id IS NULL THEN e.description END AS description,
         coalesce(d.url, e.receipt_url) AS receipt_url, coalesce(l.status, e.status) AS status,
         coalesce(f.decider, s.assigned, e.approver_id) AS approver_id,
         CASE WHEN f.decider IS NOT NULL THEN f.word.n ELSE e.approval_notes END AS approval_notes,
         coalesce(f.approved, e.approved_at) AS approved_at, coalesce(f.rejected, e.rejected_at) AS rejected_at,
         coalesce(f.reimbursed, e.reimbursed_at) AS reimbursed_at,
         coalesce(f.touched, e.updated_at) AS updated_at, e.ml_suggested_category, e.ml_confidence
  FROM expenses e FULL JOIN fate f ON f.expense_id = e.id LEFT JOIN edit d ON d.expense_id = coalesce(e.id, f.expense_id)
  LEFT JOIN last l ON l.expense_id = coalesce(e.id, f.expense_id)
  LEFT JOIN sent s ON s.expense_id = coalesce(e.id, f.expense_id)
  WHERE (e.id IS NOT NULL OR f.maker IS NOT NULL) AND coalesce(e.id, f.expense_id) NOT IN (SELECT expense_id FROM gone))
"""
VIEWS = "users expenses actions"


def applied(c, **options):
    return workflow.apply_actions(c.expenses, c.actions, c.users, bucket=F.pmod("id", F.lit(256)),
                                  pick=F.col("sent_id"), **options)


@query("actions_expenses", WALK + f"""
SELECT id, user_id, title, description, CAST(amount AS DOUBLE) AS amount, CAST(expense_date AS VARCHAR) AS expense_date,
       category, receipt_url, status, approver_id, approval_notes, {at('approved_at')} AS approved_at,
       {at('rejected_at')} AS rejected_at, {at('reimbursed_at')} AS reimbursed_at, {at('updated_at')} AS updated_at
FROM state""", VIEWS)
def _(c):
    return applied(c).expenses.select(
        "id", "user_id", "title", "description", "amount", "expense_date", "category", "receipt_url", "status",
        "approver_id", "approval_notes", "approved_at", "rejected_at", "reimbursed_at", "updated_at")


AUDIT = {"create": "created", "update": "updated", "comment": "commented"} | {a: t[2] for a, t in fixed.TRANSITIONS.items()}


@query("actions_audit", WALK + f"""
SELECT action_id, expense_id, actor_id AS user_id, {cases('action', AUDIT)} AS action,
       CASE WHEN action IN ('submit', 'approve', 'reject', 'request_changes', 'reimburse') THEN before END AS old_status,
       CASE WHEN action = 'create' THEN 'draft' ELSE {cases('action', workflow.NEW_STATE)} END AS new_status,
       CASE action WHEN 'create' THEN '{fixed.NOTE_CREATED}' WHEN 'update' THEN '{fixed.NOTE_UPDATED}'
            WHEN 'comment' THEN CASE WHEN is_internal THEN 'Added internal comment' ELSE 'Added comment' END
            WHEN 'submit' THEN 'Expense submitted for approval' WHEN 'approve' THEN coalesce(notes, 'Expense approved')
            WHEN 'reimburse' THEN coalesce(notes, 'Expense reimbursed') ELSE notes END AS notes,
       {at('ts')} AS created_at FROM ok""", VIEWS)
def _(c):
    return applied(c).audit


@query("actions_notifications", WALK + f"""
SELECT ok.action_id, ok.expense_id AS related_expense_id, CASE WHEN action = 'submit' THEN sent.assigned ELSE s.user_id END AS user_id,
       {cases('action', {a: n[1] for a, n in fixed.NOTIFICATIONS.items()})} AS title,
       CASE action WHEN 'submit' THEN actor_name || ' submitted an expense for BRL ' || s.amount
         WHEN 'approve' THEN 'Your expense "' || s.title || '" has been approved by ' || actor_name
         WHEN 'reject' THEN 'Your expense "' || s.title || '" has been rejected by ' || actor_name
         WHEN 'request_changes' THEN actor_name || ' has requested changes to your expense "' || s.title || '"'
         ELSE 'Your expense "' || s.title || '" has been reimbursed' END AS message,
       {cases('action', {a: n[0] for a, n in fixed.NOTIFICATIONS.items()})} AS type
FROM ok JOIN state s ON s.id = ok.expense_id LEFT JOIN sent ON sent.expense_id = ok.expense_id
WHERE action IN ('submit', 'approve', 'reject', 'request_changes', 'reimburse')""", VIEWS)
def _(c):
    return applied(c).notifications.drop("read", "created_at")


@query("actions_comments", WALK + """
SELECT action_id, expense_id, actor_id AS user_id, CASE WHEN action = 'comment' THEN trim(notes) ELSE notes END AS comment,
       action = 'comment' AND is_internal AS is_internal FROM ok WHERE action IN ('comment', 'request_changes')""", VIEWS)
def _(c):
    return applied(c).comments.drop("created_at")


@query("actions_rejected", WALK + """
SELECT action_id, expense_id, actor_id, action, reason FROM done WHERE reason IS NOT NULL""", VIEWS)
def _(c):
    return applied(c).rejected.drop("ts")


@query("actions_deleted", WALK + "SELECT expense_id FROM gone", VIEWS)
def _(c):
    return applied(c).deleted


@query("actions_rejected_salted", WALK + """
SELECT action_id, expense_id, actor_id, action, reason FROM done WHERE reason IS NOT NULL""", VIEWS)
def _(c):
    """Every expense with three or more actions treated as hot."""
    return applied(c, hot_rows=3, salts=4).rejected.drop("ts")


@query("actions_ocr_jobs", WALK + """
SELECT expense_id, arg_max(receipt_url, rn) AS receipt_url FROM ok
WHERE action IN ('create', 'update') AND receipt_url IS NOT NULL GROUP BY expense_id""", VIEWS)
def _(c):
    return applied(c).ocr_jobs.drop("created_at")


@query("actions_feedback", WALK + """
SELECT s.id AS expense_id, s.title, s.ml_suggested_category AS predicted_category, s.category AS actual_category,
       CAST(s.ml_confidence AS DOUBLE) AS confidence
FROM state s JOIN ok ON ok.expense_id = s.id AND ok.action = 'approve' WHERE s.ml_suggested_category <> s.category""", VIEWS)
def _(c):
    return applied(c).feedback.select("expense_id", "title", "predicted_category", "actual_category", "confidence")


@query("cascade_delete", WALK + """
SELECT id, expense_id FROM audit_log WHERE expense_id NOT IN (SELECT expense_id FROM gone)""", VIEWS + " audit_log")
def _(c):
    return workflow.cascade_delete({"audit": c.audit_log.select("id", "expense_id")}, applied(c).deleted)["audit"]


# tables that hold an expense or refer to one, and the column that does
REFERRING = {"expenses": "id", "audit_log": "expense_id", "comments": "expense_id", "notifications": "related_expense_id",
             "ocr_queue": "expense_id"}


@query("cascade_delete_everywhere", WALK + " UNION ALL ".join(f"""
SELECT '{t}' AS table_name, count(*) AS n, count(DISTINCT t.{k}) AS n_expenses FROM {t} t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.expense_id = t.{k})"""
       for t, k in REFERRING.items()), VIEWS + " audit_log comments notifications ocr_queue")
def _(c):
    """What is left of the five tables when the deleted expenses have gone."""
    left = workflow.cascade_delete({t: getattr(c, t) for t in REFERRING}, applied(c).deleted)
    counts = [df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(REFERRING[t]).alias("n_expenses")).select(
        F.lit(t).alias("table_name"), "n", "n_expenses") for t, df in left.items()]
    return functools.reduce(DataFrame.unionByName, counts)


@query("backfill_status_times", f"""
SELECT id, {at("CASE WHEN status IN ('approved', 'reimbursed') THEN created_at + INTERVAL '1' DAY ELSE approved_at END")} AS approved_at,
       {at("CASE WHEN status = 'reimbursed' THEN created_at + INTERVAL '4' DAY ELSE reimbursed_at END")} AS reimbursed_at
FROM expenses""")
def _(c):
    return workflow.backfill_status_times(c.expenses).select("id", "approved_at", "reimbursed_at")


@query("backfill_audit", f"""
SELECT id AS expense_id, user_id, 'created' AS action, NULL AS old_status, 'draft' AS new_status,
       '{fixed.NOTE_CREATED}' AS notes, {at('created_at')} AS created_at FROM expenses
UNION ALL SELECT id, user_id, 'submitted', 'draft', 'pending', 'Expense submitted for approval',
       {at("created_at + INTERVAL '5' MINUTE")} FROM expenses WHERE status IN ('approved', 'reimbursed', 'pending')
UNION ALL SELECT id, approver_id, 'approved', 'pending', 'approved', '{fixed.NOTE_APPROVED_BACKFILL}', {at('approved_at')}
       FROM expenses WHERE status IN ('approved', 'reimbursed') AND approver_id IS NOT NULL
UNION ALL SELECT id, (SELECT min(id) FROM users WHERE role = 'admin'), 'reimbursed', 'approved', 'reimbursed',
       'Expense reimbursed', {at('reimbursed_at')} FROM expenses WHERE status = 'reimbursed' AND reimbursed_at IS NOT NULL""",
       "users expenses")
def _(c):
    return workflow.backfill_audit(c.expenses, c.users)
