"""Validation, integrity, tokens and the batch changes outside the approval states."""

from pyspark.sql import functions as F

from checks.registry import at, query
from spendspark import fixed
from spendspark.operators import checks, mutations
from spendspark.plans.fixtures import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"


@query("validate_expenses", f"""
WITH raw AS (SELECT id, CASE WHEN id % 10 = 0 THEN '  ' ELSE title END AS title,
    CASE WHEN id % 12 = 0 THEN repeat('x', 1001) ELSE description END AS description,
    CASE id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '0.001' WHEN 2 THEN '1e3' WHEN 3 THEN NULL ELSE CAST(amount AS VARCHAR) END AS amount,
    CASE WHEN id % 9 = 0 THEN 'REAL' ELSE currency END AS currency,
    CASE id % 8 WHEN 0 THEN '2001-02-30' WHEN 1 THEN '2002/1/5' WHEN 2 THEN '05-01-2001' ELSE CAST(expense_date AS VARCHAR) END AS day,
    CASE WHEN id % 11 = 0 THEN repeat('v', 256) ELSE vendor END AS vendor,
    CASE WHEN id % 13 = 0 THEN 'food' ELSE category END AS category, id % 8 AS d, id % 7 AS a FROM expenses)
SELECT id, concat_ws('; ',
    CASE WHEN trim(title) = '' THEN '{fixed.MSG_TITLE}' END, CASE WHEN length(description) > 1000 THEN '{fixed.MSG_DESCRIPTION}' END,
    CASE WHEN a IN (0, 1, 3) THEN '{fixed.MSG_AMOUNT}' END, CASE WHEN length(currency) <> 3 THEN '{fixed.MSG_CURRENCY}' END,
    CASE WHEN d IN (0, 2) THEN '{fixed.MSG_DATE}' END, CASE WHEN d = 1 THEN '{fixed.MSG_DATE_FUTURE}' END,
    CASE WHEN length(vendor) > 255 THEN '{fixed.MSG_VENDOR}' END, CASE WHEN category = 'food' THEN '{fixed.MSG_CATEGORY}' END) AS errors
FROM raw""")
def _(c):
    raw = c.expenses.selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN '  ' ELSE title END AS title",
        "CASE WHEN id % 12 = 0 THEN repeat('x', 1001) ELSE description END AS description",
        "CASE id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '0.001' WHEN 2 THEN '1e3' WHEN 3 THEN NULL ELSE CAST(amount AS STRING) END AS amount",
        "CASE WHEN id % 9 = 0 THEN 'REAL' ELSE currency END AS currency",
        "CASE id % 8 WHEN 0 THEN '2001-02-30' WHEN 1 THEN '2002/1/5' WHEN 2 THEN '05-01-2001' ELSE CAST(expense_date AS STRING) END AS expense_date",
        "CASE WHEN id % 11 = 0 THEN repeat('v', 256) ELSE vendor END AS vendor",
        "CASE WHEN id % 13 = 0 THEN 'food' ELSE category END AS category")
    return checks.validate_expenses(raw, AS_OF).select("id", F.array_join("errors", "; ").alias("errors"))


@query("validate_users", f"""
WITH raw AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'shared@example.com' WHEN id % 7 = 0 THEN 'no at sign' ELSE email END AS email,
    CASE WHEN id % 6 = 0 THEN ' ' ELSE first_name END AS first_name, last_name, department,
    CASE WHEN id % 9 = 0 THEN 'boss' ELSE role END AS role FROM users),
first AS (SELECT lower(email) AS email, min(id) AS id FROM raw GROUP BY 1)
SELECT r.id, concat_ws('; ', CASE WHEN r.email NOT LIKE '%@%' THEN '{fixed.MSG_EMAIL}' END,
    CASE WHEN r.id <> f.id THEN '{fixed.MSG_EMAIL_TAKEN}' END, CASE WHEN trim(first_name) = '' THEN '{fixed.MSG_FIRST_NAME}' END,
    CASE WHEN role = 'boss' THEN '{fixed.MSG_ROLE}' END) AS errors
FROM raw r JOIN first f ON f.email = lower(r.email)""", "users")
def _(c):
    raw = c.users.selectExpr(
        "id", "CASE WHEN id % 5 = 0 THEN 'shared@example.com' WHEN id % 7 = 0 THEN 'no at sign' ELSE email END AS email",
        "CASE WHEN id % 6 = 0 THEN ' ' ELSE first_name END AS first_name", "last_name", "department",
        "CASE WHEN id % 9 = 0 THEN 'boss' ELSE role END AS role")
    return checks.validate_users(raw).select("id", F.array_join("errors", "; ").alias("errors"))


@query("integrity_report", """
SELECT 'users' AS "table", 'unique id' AS rule, count(*) AS bad_rows FROM (SELECT id FROM users GROUP BY id HAVING count(*) > 1) x
UNION ALL SELECT 'users', 'email not null', count(*) FILTER (WHERE email IS NULL) FROM users
UNION ALL SELECT 'users', 'first_name not null', count(*) FILTER (WHERE first_name IS NULL) FROM users
UNION ALL SELECT 'users', 'last_name not null', count(*) FILTER (WHERE last_name IS NULL) FROM users
UNION ALL SELECT 'expenses', 'unique id', count(*) FROM (SELECT id FROM expenses GROUP BY id HAVING count(*) > 1) x
UNION ALL SELECT 'expenses', 'user_id not null', count(*) FILTER (WHERE user_id IS NULL) FROM expenses
UNION ALL SELECT 'expenses', 'title not null', count(*) FILTER (WHERE title IS NULL) FROM expenses
UNION ALL SELECT 'expenses', 'amount not null', count(*) FILTER (WHERE amount IS NULL) FROM expenses
UNION ALL SELECT 'expenses', 'expense_date not null', count(*) FILTER (WHERE expense_date IS NULL) FROM expenses
UNION ALL SELECT 'expenses', 'category not null', count(*) FILTER (WHERE category IS NULL) FROM expenses
UNION ALL SELECT 'expenses', 'amount > 0', count(*) FILTER (WHERE NOT amount > 0) FROM expenses
UNION ALL SELECT 'expense_audit_log', 'unique id', count(*) FROM (SELECT id FROM actions_log GROUP BY id HAVING count(*) > 1) x
UNION ALL SELECT 'expense_audit_log', 'expense_id not null', count(*) FILTER (WHERE expense_id IS NULL) FROM actions_log
UNION ALL SELECT 'expense_audit_log', 'user_id not null', count(*) FILTER (WHERE user_id IS NULL) FROM actions_log
UNION ALL SELECT 'expense_audit_log', 'action not null', count(*) FILTER (WHERE action IS NULL) FROM actions_log
UNION ALL SELECT 'expenses', 'user_id in users', count(*) FROM expenses WHERE user_id NOT IN (SELECT id FROM users)
UNION ALL SELECT 'expenses', 'approver_id in users', count(*) FROM expenses
          WHERE approver_id IS NOT NULL AND approver_id NOT IN (SELECT id FROM users)
UNION ALL SELECT 'expense_audit_log', 'expense_id in expenses', count(*) FROM actions_log
          WHERE expense_id NOT IN (SELECT id FROM expenses)
UNION ALL SELECT 'expense_audit_log', 'user_id in users', count(*) FROM actions_log WHERE user_id NOT IN (SELECT id FROM users)
""".replace("actions_log", "(SELECT action_id AS id, expense_id, actor_id AS user_id, action FROM actions)"),
       "users expenses actions")
def _(c):
    log = c.actions.selectExpr("action_id AS id", "expense_id", "actor_id AS user_id", "action")
    return checks.integrity_report({"users": c.users, "expenses": c.expenses, "expense_audit_log": log})


@query("token_status", f"""
WITH tokens AS (SELECT CASE WHEN id % 2 = 0 THEN 'reset' ELSE 'verification' END AS kind, user_id + id % 3 AS user_id, id % 5 = 0 AS used,
    created_at + CASE WHEN id % 2 = 0 THEN INTERVAL '10' MINUTE ELSE INTERVAL '24' HOUR END AS expires_at FROM expenses)
SELECT kind, CASE WHEN used THEN 'used' WHEN expires_at > TIMESTAMP '2001-08-01 00:00:00' THEN 'open' ELSE 'expired' END AS status,
       count(*) AS tokens FROM tokens JOIN users u ON u.id = tokens.user_id GROUP BY ALL""", "users expenses")
def _(c):
    tokens = c.expenses.selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'reset' ELSE 'verification' END AS kind", "user_id + id % 3 AS user_id", "id % 5 = 0 AS used",
        "created_at + CASE WHEN id % 2 = 0 THEN INTERVAL '10' MINUTE ELSE INTERVAL '24' HOUR END AS expires_at")
    return checks.token_status(tokens, c.users, "2001-08-01 00:00:00")


# --- users ------------------------------------------------------------------------------------

WISHES = """wishes AS (SELECT id AS update_id, user_id * 3 AS user_id, CASE WHEN id % 3 = 0 THEN user_id * 3 ELSE (id % 20) * 50 END AS actor_id,
    CASE id % 4 WHEN 0 THEN 'approver' WHEN 1 THEN 'admin' WHEN 2 THEN 'owner' ELSE 'employee' END AS role,
    id % 2 = 0 AS active, created_at AS ts FROM notifications)"""


def user_wishes(c, column):
    return c.notifications.selectExpr(
        "id AS update_id", "user_id * 3 AS user_id",
        "CASE WHEN id % 3 = 0 THEN user_id * 3 ELSE (id % 20) * 50 END AS actor_id",
        "CASE id % 4 WHEN 0 THEN 'approver' WHEN 1 THEN 'admin' WHEN 2 THEN 'owner' ELSE 'employee' END AS role"
        if column == "role" else "id % 2 = 0 AS is_active", "created_at AS ts")


def judged(own_rule, self_message):
    return f"""WITH {WISHES}, judged AS (SELECT w.*, CASE WHEN a.id IS NULL THEN '{fixed.REFUSE_UNKNOWN_ACTOR}'
    WHEN NOT a.is_active THEN '{fixed.REFUSE_INACTIVE_ACTOR}' WHEN a.role <> 'admin' THEN '{fixed.REFUSE_ROLE}'
    {own_rule} WHEN w.user_id = w.actor_id THEN '{self_message}' WHEN t.id IS NULL THEN '{fixed.REFUSE_NO_USER}' END AS reason
    FROM wishes w LEFT JOIN users a ON a.id = w.actor_id LEFT JOIN users t ON t.id = w.user_id)"""


ROLE_RULE = judged(f"WHEN w.role = 'owner' THEN '{fixed.MSG_ROLE}'", fixed.REFUSE_SELF_ROLE)
ACTIVE_RULE = judged("", fixed.REFUSE_SELF_STATUS)


@query("set_roles", f"""{ROLE_RULE}, good AS (SELECT user_id, arg_max(role, (ts, update_id)) AS role FROM judged
  WHERE reason IS NULL GROUP BY user_id)
SELECT u.id, coalesce(g.role, u.role) AS role FROM users u LEFT JOIN good g ON g.user_id = u.id""", "users notifications")
def _(c):
    return mutations.set_roles(c.users, user_wishes(c, "role"))[0].select("id", "role")


@query("set_roles_rejected", f"{ROLE_RULE} SELECT update_id, reason FROM judged WHERE reason IS NOT NULL", "users notifications")
def _(c):
    return mutations.set_roles(c.users, user_wishes(c, "role"))[1].select("update_id", "reason")


@query("set_active", f"""{ACTIVE_RULE}, good AS (SELECT user_id, arg_max(active, (ts, update_id)) AS active, max(ts) AS ts
  FROM judged WHERE reason IS NULL GROUP BY user_id)
SELECT u.id, coalesce(g.active, u.is_active) AS is_active, {at('coalesce(g.ts, u.updated_at)')} AS updated_at
FROM users u LEFT JOIN good g ON g.user_id = u.id""", "users notifications")
def _(c):
    return mutations.set_active(c.users, user_wishes(c, "is_active"))[0].select("id", "is_active", "updated_at")


PATCHES = """patches AS (SELECT id AS update_id, user_id * 12 AS user_id,
    CASE id % 4 WHEN 0 THEN ' New' || id WHEN 1 THEN '  ' END AS first_name,
    CASE WHEN id % 5 = 0 THEN 'Name' || id END AS last_name, CASE WHEN id % 6 = 2 THEN '' END AS department, created_at AS ts
    FROM notifications),
judged AS (SELECT p.*, CASE WHEN trim(p.first_name) = '' THEN 'Validation failed: First name must be 1-100 characters'
    WHEN coalesce(p.first_name, p.last_name, p.department) IS NULL THEN 'No fields to update'
    WHEN u.id IS NULL THEN 'User not found' END AS reason FROM patches p LEFT JOIN users u ON u.id = p.user_id),
good AS (SELECT user_id, arg_max(trim(first_name), update_id) FILTER (WHERE first_name IS NOT NULL) AS first_name,
    arg_max(last_name, update_id) FILTER (WHERE last_name IS NOT NULL) AS last_name,
    arg_max(department, update_id) FILTER (WHERE department IS NOT NULL) AS department
    FROM judged WHERE reason IS NULL GROUP BY user_id)"""


def patches(c):
    return c.notifications.selectExpr(
        "id AS update_id", "user_id * 12 AS user_id", "CASE id % 4 WHEN 0 THEN ' New' || id WHEN 1 THEN '  ' END AS first_name",
        "CASE WHEN id % 5 = 0 THEN 'Name' || id END AS last_name", "CASE WHEN id % 6 = 2 THEN '' END AS department",
        "created_at AS ts")


@query("patch_profiles", f"""WITH {PATCHES}
SELECT u.id, coalesce(g.first_name, u.first_name) AS first_name, coalesce(g.last_name, u.last_name) AS last_name,
       coalesce(g.department, u.department) AS department FROM users u LEFT JOIN good g ON g.user_id = u.id""",
       "users notifications")
def _(c):
    return mutations.patch_profiles(c.users, patches(c))[0].select("id", "first_name", "last_name", "department")


@query("patch_profiles_rejected", f"WITH {PATCHES} SELECT update_id, reason FROM judged WHERE reason IS NOT NULL",
       "users notifications")
def _(c):
    return mutations.patch_profiles(c.users, patches(c))[1].select("update_id", "reason")


@query("set_preferences", """
WITH last AS (SELECT user_id, arg_max(id, (created_at, id)) AS id FROM notifications GROUP BY user_id)
SELECT u.id, CASE WHEN l.id IS NULL THEN u.notification_preferences ELSE
  '{"email":' || CASE l.id % 3 WHEN 0 THEN 'false' ELSE 'true' END || ',"in_app":true,"expense_approved":'
  || CASE WHEN l.id % 2 = 0 THEN 'false' ELSE 'true' END || ',"expense_rejected":true,"expense_submitted":true}' END
  AS notification_preferences FROM users u LEFT JOIN last l ON l.user_id = u.id""", "users notifications")
def _(c):
    wishes = c.notifications.selectExpr(
        "id AS update_id", "user_id", "created_at AS ts", "CASE id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS email",
        "CAST(NULL AS BOOLEAN) AS in_app", "id % 2 <> 0 AS expense_approved", "CAST(NULL AS BOOLEAN) AS expense_rejected",
        "true AS expense_submitted")
    return mutations.set_preferences(c.users, wishes).select("id", "notification_preferences")


@query("last_login", f"""
SELECT u.id, {at('coalesce(l.ts, u.last_login)')} AS last_login FROM users u
LEFT JOIN (SELECT user_id, max(created_at) AS ts FROM audit_log GROUP BY user_id) l ON l.user_id = u.id""", "users audit_log")
def _(c):
    return mutations.last_login(c.users, c.audit_log.select("user_id", F.col("created_at").alias("ts"))).select("id", "last_login")


# --- notifications ---------------------------------------------------------------------------------

REQUESTS = "requests AS (SELECT id, CASE WHEN id % 4 = 0 THEN user_id + 1 ELSE user_id END AS user_id FROM audit_log)"


def requests(c):
    return c.audit_log.selectExpr("id", "CASE WHEN id % 4 = 0 THEN user_id + 1 ELSE user_id END AS user_id")


@query("mark_read", f"""WITH {REQUESTS}
SELECT n.id, n.user_id, n.read OR r.id IS NOT NULL AS read FROM notifications n
LEFT JOIN requests r ON r.id = n.id AND r.user_id = n.user_id""", "notifications audit_log")
def _(c):
    return mutations.mark_read(c.notifications, requests(c))[0].select("id", "user_id", "read")


@query("mark_all_read", """
SELECT user_id, count(*) AS changed FROM notifications WHERE NOT read
  AND user_id IN (SELECT id FROM users WHERE role = 'employee') GROUP BY user_id""", "users notifications")
def _(c):
    owners = c.users.filter("role = 'employee'").select(F.col("id").alias("user_id"))
    return mutations.mark_all_read(c.notifications, owners)[1]


@query("delete_notifications", f"""WITH {REQUESTS}
SELECT n.id, n.user_id FROM notifications n WHERE NOT EXISTS (
  SELECT 1 FROM requests r WHERE r.id = n.id AND r.user_id = n.user_id)""", "notifications audit_log")
def _(c):
    return mutations.delete_notifications(c.notifications, requests(c))[0].select("id", "user_id")


@query("delete_notifications_rejected", f"""WITH {REQUESTS}
SELECT r.id, r.user_id, '{fixed.REFUSE_NO_NOTIFICATION}' AS reason FROM requests r WHERE NOT EXISTS (
  SELECT 1 FROM notifications n WHERE r.id = n.id AND r.user_id = n.user_id)""", "notifications audit_log")
def _(c):
    return mutations.delete_notifications(c.notifications, requests(c))[1]


@query("preference_filter", """
SELECT n.id, n.type FROM (SELECT id, user_id, CASE WHEN id % 3 = 0 THEN 'email' ELSE type END AS type FROM notifications) n
LEFT JOIN users u ON u.id = n.user_id
WHERE coalesce(u.notification_preferences NOT LIKE '%"in_app": false%', true)
  AND NOT (n.type = 'email' AND coalesce(u.notification_preferences LIKE '%"email": false%', false))""", "users notifications")
def _(c):
    typed = c.notifications.withColumn("type", F.when(F.col("id") % 3 == 0, "email").otherwise(F.col("type")))
    return mutations.preference_filter(typed, c.users).select("id", "type")


# --- settings --------------------------------------------------------------------------------------

SETTINGS = """settings AS (SELECT 'part-' || p_partkey AS key, CAST(p_size AS VARCHAR) AS value, p_name AS description,
    CAST(NULL AS BIGINT) AS updated_by, TIMESTAMP '2024-01-01' AS updated_at FROM part),
updates AS (SELECT id AS update_id, 'part-' || (user_id * 20) AS key, CASE id % 5 WHEN 0 THEN 'false' WHEN 1 THEN NULL
    ELSE '{"n": ' || id || '}' END AS value, CASE WHEN id % 3 = 0 THEN 'note ' || id END AS description, user_id AS updated_by,
    created_at AS ts FROM notifications)"""


def settings_and_updates(c):
    settings = c.base("part").selectExpr(
        "'part-' || p_partkey AS key", "CAST(p_size AS STRING) AS value", "p_name AS description",
        "CAST(NULL AS BIGINT) AS updated_by", "TIMESTAMP '2024-01-01' AS updated_at")
    updates = c.notifications.select(
        F.col("id").alias("update_id"), F.concat(F.lit("part-"), F.col("user_id") * 20).alias("key"),
        F.when(F.col("id") % 5 == 0, "false").when(F.col("id") % 5 != 1, F.concat(F.lit('{"n": '), F.col("id"), F.lit("}"))).alias("value"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("note "), F.col("id"))).alias("description"),
        F.col("user_id").alias("updated_by"), F.col("created_at").alias("ts"))
    return settings, updates


@query("upsert_settings", f"""WITH {SETTINGS}, good AS (SELECT key, arg_max(value, (ts, update_id)) AS value,
    arg_max(updated_by, (ts, update_id)) AS updated_by, max(ts) AS ts,
    arg_max(description, (ts, update_id)) FILTER (WHERE description IS NOT NULL) AS description
    FROM updates WHERE value IS NOT NULL AND value <> 'false' GROUP BY key)
SELECT coalesce(s.key, g.key) AS key, coalesce(g.value, s.value) AS value, coalesce(g.description, s.description) AS description,
       coalesce(g.updated_by, s.updated_by) AS updated_by, {at('coalesce(g.ts, s.updated_at)')} AS updated_at
FROM settings s FULL JOIN good g ON g.key = s.key""", "notifications")
def _(c):
    return mutations.upsert_settings(*settings_and_updates(c))[0]


@query("upsert_settings_rejected", f"""WITH {SETTINGS}
SELECT update_id, key, '{fixed.REFUSE_NO_SETTING_VALUE}' AS reason FROM updates WHERE value IS NULL OR value = 'false'""",
       "notifications")
def _(c):
    return mutations.upsert_settings(*settings_and_updates(c))[1]


@query("record_training", f"""WITH {SETTINGS}
SELECT key, CASE WHEN key = 'ml_last_training' THEN count_ ELSE value END AS value FROM (
  SELECT key, value, NULL AS count_ FROM settings
  UNION ALL SELECT 'ml_last_training', NULL, (SELECT CAST(count(*) AS VARCHAR) FROM expenses WHERE status = 'approved')) x""",
       "notifications expenses")
def _(c):
    settings, _updates = settings_and_updates(c)
    result = c.expenses.filter("status = 'approved'").agg(F.count(F.lit(1)).alias("training_samples")).select(
        "training_samples", F.lit("1.1").alias("model_version"), F.lit(0.5).alias("accuracy"))
    recorded = mutations.record_training(settings, result, AS_OF)
    samples = F.get_json_object("value", "$.training_samples")
    return recorded.select("key", F.when(F.col("key") == "ml_last_training", samples).otherwise(F.col("value")).alias("value"))


@query("approval_route", """
SELECT id, CASE WHEN amount <= 60 THEN 'auto' WHEN amount >= 2000 THEN 'admin' WHEN amount >= 500 THEN 'manager'
                ELSE 'approver' END AS route FROM expenses""")
def _(c):
    # one threshold is not stored: its default applies
    lowest = c.expenses.agg(F.max(F.lit(60)).alias("low"))
    settings = lowest.select(F.lit("approval_thresholds").alias("key"), F.concat(
        F.lit('{"auto_approve_limit": '), F.col("low"), F.lit(', "requires_admin": 2000}')).alias("value"))
    return mutations.approval_route(c.expenses, settings).select("id", "route")


@query("render_messages", r"""
WITH letters AS (SELECT id, user_id, title, CAST(amount AS VARCHAR) AS amount, approval_notes, CAST(id % 8 AS INT) AS kind FROM expenses)
SELECT l.id, CASE kind WHEN 0 THEN 'Verify your account' WHEN 1 THEN 'Reset your password' WHEN 2 THEN 'Expense submitted for approval'
         WHEN 3 THEN 'Expense approved' WHEN 4 THEN 'Expense rejected' WHEN 5 THEN 'Own subject' WHEN 6 THEN NULL ELSE NULL END AS subject,
       CASE kind WHEN 0 THEN 'Hello ' || u.first_name || ', confirm here: {{verificationUrl}}'
         WHEN 1 THEN 'Hello ' || u.first_name || ', choose a new password: {{resetUrl}}'
         WHEN 2 THEN 'Hello ' || u.first_name || ', ' || l.title || ' (BRL ' || l.amount || ', {{expenseDate}}, {{category}}, {{vendor}}) waits for approval: '
         WHEN 3 THEN 'Hello ' || u.first_name || ', ' || u.last_name || ' approved ' || l.title || ' (BRL ' || l.amount || ') on {{approvalDate}}. '
         WHEN 4 THEN 'Hello ' || u.first_name || ', ' || u.last_name || ' rejected ' || l.title || ' (BRL ' || l.amount || ') on {{rejectionDate}}.'
              || CASE WHEN coalesce(l.approval_notes, '') <> '' THEN ' Reason: ' || l.approval_notes ELSE '' END || ' '
         WHEN 5 THEN 'Hello ' || u.last_name || ', {{submitterName}} sent ' || l.title || ' (BRL ' || l.amount
              || ', {{expenseDate}}, {{category}}, {{vendor}}) on {{submissionDate}}: {{approvalUrl}}'
         WHEN 6 THEN 'given ' || u.first_name END AS body,
       CASE kind WHEN 7 THEN 'unknown template' END AS reason
FROM letters l JOIN users u ON u.id = l.user_id""", "users expenses")
def _(c):
    """All six templates, a custom subject, a given text and an unknown template."""
    people = c.users.select(F.col("id").alias("p_id"), "first_name", "last_name")
    kind = F.pmod("id", F.lit(8)).cast("int")
    names = ["email-verification", "password-reset", "expense-submitted", "expense-approved", "expense-rejected", "approval-request", "own", "none"]
    rows = c.expenses.join(people, F.col("user_id") == F.col("p_id")).select(
        "id", F.element_at(F.array(*[F.lit(n) for n in names]), kind + 1).alias("template"),
        F.when(kind == 5, "Own subject").alias("custom_subject"), F.when(kind == 6, "given {{firstName}}").alias("html"),
        F.create_map(
            F.lit("firstName"), F.col("first_name"), F.lit("approverName"), F.col("last_name"), F.lit("expenseTitle"), F.col("title"),
            F.lit("currency"), F.col("currency"), F.lit("amount"), F.col("amount").cast("string"),
            F.lit("rejectionReason"), F.col("approval_notes"), F.lit("expenseUrl"), F.lit(None).cast("string")).alias("vars"))
    return mutations.render_messages(rows, mutations.default_templates(c.spark)).select("id", "subject", "body", "reason")


@query("outbox", """
WITH m AS (SELECT a.id, a.action, e.title, u.email AS owner_email, u.first_name AS owner_first, p.email AS approver_email, p.id AS approver_id,
                  x.first_name || ' ' || x.last_name AS actor, p.first_name || ' ' || p.last_name AS approver
           FROM audit_log a JOIN expenses e ON e.id = a.expense_id JOIN users u ON u.id = e.user_id
           LEFT JOIN users p ON p.id = e.approver_id LEFT JOIN users x ON x.id = a.user_id
           WHERE a.action IN ('submitted', 'approved', 'rejected'))
SELECT id, owner_email AS receiver, 'expense-' || action AS template, title, actor AS approver_name, owner_first AS first_name FROM m
UNION ALL SELECT id, approver_email, 'approval-request', title, approver, owner_first FROM m WHERE action = 'submitted' AND approver_id IS NOT NULL""",
       "users expenses audit_log")
def _(c):
    mails = mutations.outbox(c.audit_log.withColumn("notes", F.lit("n")), c.expenses, c.users, "https://claims.example.com/")
    return mails.select("id", "receiver", "template", F.col("vars")["expenseTitle"].alias("title"), F.col("vars")["approverName"].alias("approver_name"),
                        F.col("vars")["firstName"].alias("first_name"))


@query("set_avatars", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'https://files.example.com/a/' || id || '-2.png' WHEN id % 3 = 1 THEN 'https://files.example.com/a/' || id || '-1.png'
           END AS avatar_url FROM users""", "users")
def _(c):
    """Two uploads of every user, some refused."""
    uploads = c.users.select(F.col("id").alias("user_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ts")).select(
        "user_id", "ts", F.concat(F.lit("https://files.example.com/a/"), F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("string"),
                                  F.lit(".png")).alias("avatar_url"),
        F.when((F.col("user_id") % 3 == 2) | ((F.col("user_id") % 3 == 1) & (F.col("ts") == 2)), "refused").alias("rejected"))
    return mutations.set_avatars(c.users, uploads, AS_OF)[0].select("id", "avatar_url")


@query("settings_map", """
SELECT 'k1' AS key, CAST(count(*) AS VARCHAR) AS value FROM expenses UNION ALL SELECT 'k3', CAST(sum(id) AS VARCHAR) FROM expenses""")
def _(c):
    sums = c.expenses.agg(F.count(F.lit(1)).cast("string").alias("n"), F.sum("id").cast("string").alias("s"))
    rows = sums.select(F.explode(F.create_map(F.lit("k1"), "n", F.lit("k2"), "n", F.lit("k3"), "s")).alias("key", "value")).withColumns(
        {"description": F.lit(None).cast("string"), "updated_at": F.lit(AS_OF).cast("timestamp")})
    found = mutations.settings_map(rows, ["k1", "k3", "k9"])
    return found.select(F.explode("settings").alias("key", "v")).select("key", "v.value")


@query("new_id", """SELECT id, sha256(id || '|' || title) AS made FROM expenses""")
def _(c):
    from pyspark.sql import types as T

    return c.expenses.select("id", mutations.new_id(T.StringType(), F.col("id"), F.col("title")).alias("made"))
