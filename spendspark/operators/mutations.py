"""Batch changes outside the approval states. Each takes a table and a table of
wishes and returns the new table and the refused wishes.

Several wishes for one row: the last one by (ts, update_id) counts. Rights are those
in the table given, not changed by other wishes of the same batch. The wishes are
reduced to one row per target by a partial aggregation before they meet the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark import fixed
from spendspark.functions.scalars import moment, trim_all


def new_id(kind: T.DataType, *parts: Column) -> Column:
    """Key of a new row made from its content, so that a repeated run makes the same."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.sha2(text, 256) if isinstance(kind, T.StringType) else F.xxhash64(text).cast(kind)


def _order() -> Column:
    return F.struct("ts", "update_id")


def _by_admin(wishes: DataFrame, users: DataFrame) -> DataFrame:
    """Wishes with actor_reason: why their actor may not act as admin, else null."""
    actors = users.select(F.col("id").alias("a_id"), F.col("role").alias("a_role"), F.col("is_active").alias("a_active"))
    reason = (
        F.when(F.col("a_id").isNull(), fixed.REFUSE_UNKNOWN_ACTOR)
        .when(~F.coalesce(F.col("a_active"), F.lit(False)), fixed.REFUSE_INACTIVE_ACTOR)
        .when(F.col("a_role") != "admin", fixed.REFUSE_ROLE))
    return wishes.join(actors, F.col("actor_id") == F.col("a_id"), "left").withColumn("actor_reason", reason)


def _refused_wishes(wishes: DataFrame, users: DataFrame, *columns: str) -> DataFrame:
    """Wishes with a reason, and those for users that do not exist."""
    targets = users.select(F.col("id").alias("t_id"))
    joined = wishes.join(targets, F.col("user_id") == F.col("t_id"), "left").withColumn(
        "reason", F.coalesce(F.col("reason"), F.when(F.col("t_id").isNull(), fixed.REFUSE_NO_USER)))
    return joined.filter(F.col("reason").isNotNull()).select(*columns, "reason")


def _change_users(users: DataFrame, wishes: DataFrame, column: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    judged = wishes.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).groupBy(F.col("user_id").alias("w_id")).agg(
        F.max_by(F.struct(F.col(column), F.col("ts")), _order()).alias("w"))
    new = good.select("w_id", F.col(f"w.{column}").alias("w_value"), F.col("w.ts").alias("w_ts"))
    changed = F.col("w_id").isNotNull()
    values = {column: F.when(changed, F.col("w_value")).otherwise(F.col(column)),
              "updated_at": F.when(changed, F.col("w_ts")).otherwise(F.col("updated_at"))}
    result = users.join(new, F.col("id") == F.col("w_id"), "left").withColumns(values).select(*users.columns)
    return result, _refused_wishes(judged, users, "update_id", "user_id", "actor_id")


def set_roles(users: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """updates: update_id, user_id, actor_id, role, ts. By admins, not on themselves."""
    reason = F.coalesce(
        F.col("actor_reason"),
        F.when(~F.coalesce(F.col("role").isin(fixed.ROLES), F.lit(False)), fixed.MSG_ROLE),
        F.when(F.col("user_id") == F.col("actor_id"), fixed.REFUSE_SELF_ROLE))
    return _change_users(users, _by_admin(updates, users), "role", reason)


def set_active(users: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """updates: update_id, user_id, actor_id, is_active, ts. By admins, not on themselves."""
    reason = F.coalesce(
        F.col("actor_reason"),
        F.when(F.col("user_id") == F.col("actor_id"), fixed.REFUSE_SELF_STATUS))
    return _change_users(users, _by_admin(updates, users), "is_active", reason)


def patch_profiles(users: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """patches: update_id, user_id, first_name, last_name, department, ts. Null keeps
    the old value, an empty department is a value; each field takes its last patch."""
    fields = ["first_name", "last_name", "department"]
    trimmed = patches.withColumns({f: trim_all(F.col(f)) for f in fields})

    def wrong(column: str, least: int) -> Column:
        return F.coalesce(~F.char_length(column).between(least, 100), F.lit(False))

    rules = [(wrong("first_name", 1), fixed.MSG_FIRST_NAME), (wrong("last_name", 1), fixed.MSG_LAST_NAME),
             (wrong("department", 0), fixed.MSG_DEPARTMENT)]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(m)) for bad, m in rules]))
    judged = trimmed.withColumn("reason", F.coalesce(
        F.when(F.size(errors) > 0, F.concat(F.lit("Validation failed: "), F.array_join(errors, ", "))),
        F.when(F.coalesce(*fields).isNull(), fixed.REFUSE_NO_FIELDS)))
    new = judged.filter(F.col("reason").isNull()).groupBy(F.col("user_id").alias("p_id")).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), _order())).alias(f"p_{f}") for f in fields],
        F.max("ts").alias("p_ts"))
    result = users.join(new, F.col("id") == F.col("p_id"), "left").withColumns({
        **{f: F.coalesce(f"p_{f}", f) for f in fields},
        "updated_at": F.coalesce("p_ts", "updated_at")}).select(*users.columns)
    return result, _refused_wishes(judged, users, "update_id", "user_id")


def set_avatars(users: DataFrame, uploads: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(users with avatar_url and updated_at set, refused uploads with their reason).

    uploads: user_id, avatar_url, rejected (as scan_avatars judges files), ts. The last
    accepted upload of a user counts; rejected ones and unknown users are refused."""
    from spendspark.functions.scalars import moment, one_per

    good = uploads.filter(F.col("rejected").isNull())
    last = one_per(good, "user_id", [F.col("ts"), F.col("avatar_url")]).select(F.col("user_id").alias("a_id"), F.col("avatar_url").alias("a_url"))
    changed = F.col("a_id").isNotNull()
    result = users.join(last, F.col("id") == F.col("a_id"), "left").withColumns({
        "avatar_url": F.when(changed, F.col("a_url")).otherwise(F.col("avatar_url")),
        "updated_at": F.when(changed, moment(as_of)).otherwise(F.col("updated_at"))}).select(*users.columns)
    known = users.select(F.col("id").alias("k_id"))
    refused = uploads.join(known, F.col("user_id") == F.col("k_id"), "left").withColumn(
        "reason", F.coalesce("rejected", F.when(F.col("k_id").isNull(), fixed.REFUSE_UNKNOWN_ACTOR)))
    return result, refused.filter(F.col("reason").isNotNull()).select("user_id", "avatar_url", "reason")


def set_preferences(users: DataFrame, wishes: DataFrame) -> DataFrame:
    """wishes: update_id, user_id, ts and the five flags; an absent flag means true. The
    whole preference value is replaced."""
    flags = F.struct(*[F.coalesce(F.col(f), F.lit(True)).alias(f) for f in fixed.PREFERENCE_FLAGS])
    last = wishes.groupBy(F.col("user_id").alias("p_id")).agg(
        F.max_by(F.to_json(flags), _order()).alias("p_value"), F.max("ts").alias("p_ts"))
    return users.join(last, F.col("id") == F.col("p_id"), "left").withColumns({
        "notification_preferences": F.coalesce("p_value", "notification_preferences"),
        "updated_at": F.coalesce("p_ts", "updated_at")}).select(*users.columns)


def last_login(users: DataFrame, logins: DataFrame) -> DataFrame:
    """logins: user_id, ts. Users without one keep their value."""
    latest = logins.groupBy(F.col("user_id").alias("l_id")).agg(F.max("ts").alias("l_ts"))
    return users.join(latest, F.col("id") == F.col("l_id"), "left").withColumn(
        "last_login", F.coalesce("l_ts", "last_login")).select(*users.columns)


# --- notifications ------------------------------------------------------------------------


def _wanted(requests: DataFrame) -> DataFrame:
    return requests.select(F.col("id").alias("w_id"), F.col("user_id").alias("w_user")).distinct()


def _refused(requests: DataFrame, notifications: DataFrame) -> DataFrame:
    owned = notifications.select(F.col("id").alias("n_id"), F.col("user_id").alias("n_user"))
    return requests.join(owned, (F.col("id") == F.col("n_id")) & (F.col("user_id") == F.col("n_user")),
                         "left_anti").withColumn("reason", F.lit(fixed.REFUSE_NO_NOTIFICATION))


def _is_wanted() -> Column:
    return (F.col("id") == F.col("w_id")) & (F.col("user_id") == F.col("w_user"))


def mark_read(notifications: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: id, user_id. Only the owner's notifications are found."""
    marked = notifications.join(_wanted(requests), _is_wanted(), "left").withColumn(
        "read", F.col("read") | F.col("w_id").isNotNull())
    return marked.select(*notifications.columns), _refused(requests, notifications)


def mark_all_read(notifications: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """owners: user_id. Also returns how many notifications changed per user."""
    chosen = owners.select(F.col("user_id").alias("w_user")).distinct()
    joined = notifications.join(chosen, F.col("user_id") == F.col("w_user"), "left")
    # counted before the join: one row per user and map task is shuffled
    unread = notifications.filter(~F.col("read")).groupBy("user_id").agg(F.count(F.lit(1)).alias("changed"))
    changed = unread.join(chosen, F.col("user_id") == F.col("w_user"), "left_semi")
    return joined.withColumn("read", F.col("read") | F.col("w_user").isNotNull()).select(
        *notifications.columns), changed


def delete_notifications(notifications: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: id, user_id. Returns the rest and the requests that found nothing."""
    return (notifications.join(_wanted(requests), _is_wanted(), "left_anti"),
            _refused(requests, notifications))


def preference_filter(notifications: DataFrame, users: DataFrame) -> DataFrame:
    """Notifications the receiver wants in the application: flag in_app and the flag
    named like the type, both true unless stored as false."""
    stored = F.from_json("notification_preferences", "map<string,boolean>")
    off = F.map_keys(F.map_filter(stored, lambda _, on: ~on))  # parsed once per user, not per notification
    prefs = users.select(F.col("id").alias("p_id"), off.alias("p_off"))
    joined = notifications.join(prefs, F.col("user_id") == F.col("p_id"), "left")
    unwanted = F.array_contains("p_off", "in_app") | F.array_contains("p_off", F.coalesce("type", F.lit("")))
    return joined.filter(~F.coalesce(unwanted, F.lit(False))).select(*notifications.columns)


# --- settings and queue ----------------------------------------------------------------------


def upsert_settings(settings: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """updates: update_id, key, value (json), description, updated_by, ts. Null, false,
    0 and empty values are refused; a null description keeps the old one."""
    falsy = F.col("value").isNull() | trim_all(F.col("value")).isin("", "null", "false", "0", "0.0", "-0", '""')
    good = updates.filter(~falsy).groupBy(F.col("key").alias("u_key")).agg(
        F.max_by(F.struct("value", "updated_by", "ts"), _order()).alias("u"),
        F.max_by("description", F.when(F.col("description").isNotNull(), _order())).alias("u_description"))
    flat = good.select("u_key", "u_description", F.col("u.value").alias("u_value"),
                       F.col("u.updated_by").alias("u_by"), F.col("u.ts").alias("u_ts"))
    new = F.col("u_key").isNotNull()
    merged = settings.join(flat, F.col("key") == F.col("u_key"), "full_outer").select(
        F.coalesce("key", "u_key").alias("key"),
        F.coalesce("u_value", "value").alias("value"),
        F.coalesce("u_description", "description").alias("description"),
        F.when(new, F.col("u_by")).otherwise(F.col("updated_by")).alias("updated_by"),
        F.coalesce("u_ts", "updated_at").alias("updated_at"))
    return merged, updates.filter(falsy).select("update_id", "key").withColumn(
        "reason", F.lit(fixed.REFUSE_NO_SETTING_VALUE))


def settings_list(settings: DataFrame) -> DataFrame:
    """All settings by key."""
    return settings.select("key", "value", "description", "updated_at").orderBy("key")


def settings_map(settings: DataFrame, keys: list[str]) -> DataFrame:
    """key -> value, description, updated_at of the keys asked for, in one row."""
    entry = F.struct("key", F.struct("value", "description", "updated_at"))
    return settings.filter(F.col("key").isin(keys)).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("settings"))


def record_training(settings: DataFrame, result: DataFrame, as_of) -> DataFrame:
    """Stores the training result (training_samples, model_version, accuracy) under
    ml_last_training."""
    now = moment(as_of)
    value = F.to_json(F.struct(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "training_samples",
        F.coalesce(F.col("model_version"), F.lit("1.0")).alias("model_version"), "accuracy"))
    update = result.select(
        F.lit(0).alias("update_id"), F.lit("ml_last_training").alias("key"), value.alias("value"),
        F.lit("Last ML model training information").alias("first_description"), now.alias("ts"))
    # an existing row keeps its description and its updated_by
    old = settings.select(F.col("key").alias("o_key"), F.col("description").alias("o_description"),
                          F.col("updated_by").alias("o_by"))
    filled = update.join(old, F.col("key") == F.col("o_key"), "left").select(
        "update_id", "key", "value", F.coalesce("o_description", "first_description").alias("description"),
        F.col("o_by").alias("updated_by"), "ts")
    return upsert_settings(settings, filled)[0]


def upsert_ocr_queue(queue: DataFrame, receipts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """receipts: expense_id, receipt_url, created_at; the last per expense counts. A
    queued expense starts over with the new receipt, others get a new row."""
    last = receipts.groupBy(F.col("expense_id").alias("r_id")).agg(
        F.max(F.struct("created_at", "receipt_url")).alias("r")).select(
        "r_id", F.col("r.created_at").alias("r_at"), F.col("r.receipt_url").alias("r_url"))
    joined = queue.join(last, F.col("expense_id") == F.col("r_id"), "full_outer")
    seen, fresh = F.col("r_id").isNotNull(), F.col("expense_id").isNull()
    kinds = {f.name: f.dataType for f in queue.schema.fields}
    values = {
        "id": F.when(fresh, new_id(kinds["id"], F.col("r_id"), F.col("r_url"))).otherwise(F.col("id")),
        "expense_id": F.coalesce("expense_id", "r_id"),
        "receipt_url": F.coalesce("r_url", "receipt_url"),
        "status": F.when(seen, F.lit("pending")).otherwise(F.col("status")),
        "attempts": F.when(seen, F.lit(0)).otherwise(F.col("attempts")),
        "max_attempts": F.coalesce("max_attempts", F.lit(max_attempts)),
        "created_at": F.coalesce("r_at", "created_at"),
    }
    return joined.select(*[values.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in queue.columns])


def approval_route(expenses: DataFrame, settings: DataFrame) -> DataFrame:
    """Adds route: auto up to the limit, admin or manager from their thresholds on,
    else approver. Thresholds come from the setting approval_thresholds."""
    names = fixed.DEFAULT_SETTINGS["approval_thresholds"]
    stored = settings.filter(F.col("key") == "approval_thresholds").agg(
        F.from_json(F.max("value"), ", ".join(f"{n} double" for n in names)).alias("t"))

    def threshold(name: str) -> Column:
        return F.coalesce(stored.select(F.col(f"t.{name}")).scalar(), F.lit(float(names[name])))

    amount = F.col("amount").cast("double")
    return expenses.withColumn(
        "route",
        F.when(amount <= threshold("auto_approve_limit"), "auto")
        .when(amount >= threshold("requires_admin"), "admin")
        .when(amount >= threshold("requires_manager"), "manager")
        .otherwise("approver"))


# --- mail merge ---------------------------------------------------------------------------------


def render_messages(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Outbox rows: receiver, template, vars MAP<STRING,STRING>, and optionally html and
    custom_subject -> subject, body, reason.

    A row of an unknown template takes its own html; without one it stays, with a null body
    and the reason. A custom subject goes before the template's.

    {{name}} takes the value, empty when null; {{#if name}}..{{/if}} stays for a value
    that is not empty. Names the row does not give stay as they are, their blocks go.
    """
    known = templates.select(F.col("name").alias("t_name"), F.col("subject").alias("t_subject"), F.col("html").alias("t_html"))
    joined = rows.join(known, F.col("template") == F.col("t_name"), "left").drop("t_name")
    given = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    joined = joined.withColumns({
        "subject": F.coalesce(given("custom_subject"), F.col("t_subject")),
        "html": F.coalesce(F.col("t_html"), given("html")),
        "reason": F.when(F.coalesce(F.col("t_html"), given("html")).isNull(), "unknown template"),
    })
    entries = F.map_entries(F.coalesce("vars", F.create_map().cast("map<string,string>")))

    def fill(text: Column, entry: Column) -> Column:
        tag = F.concat(F.lit("{{"), entry["key"], F.lit("}}"))
        return F.replace(text, tag, F.coalesce(entry["value"], F.lit("")))

    def settle(text: Column, entry: Column) -> Column:
        name = F.regexp_replace(entry["key"], r"(\W)", r"\\$1")  # a key is no pattern
        block = F.concat(F.lit(r"(?s)\{\{#if "), name, F.lit(r"\}\}(.*?)\{\{/if\}\}"))
        keep = F.when(F.coalesce(entry["value"], F.lit("")) != "", F.lit("$1")).otherwise(F.lit(""))
        return F.regexp_replace(text, block, keep)

    filled = F.aggregate(entries, F.col("html"), fill)
    settled = F.aggregate(entries, filled, settle)
    body = F.regexp_replace(settled, r"(?s)\{\{#if \w+\}\}.*?\{\{/if\}\}", "")
    return joined.withColumn("body", body).drop("html", "vars", "t_subject", "t_html", "custom_subject")


def outbox(moves: DataFrame, expenses: DataFrame, users: DataFrame, base_url: str) -> DataFrame:
    """Mail rows for render_messages from the audit lines of submissions, approvals and
    rejections: id, receiver (e-mail), template, vars. A submission writes to its owner
    and, where one is assigned, to the approver; a decision writes to the owner.

    moves: id, expense_id, user_id (who acted), action, notes, created_at, as the workflow's
    audit has them."""
    kinds = {"submitted": "expense-submitted", "approved": "expense-approved", "rejected": "expense-rejected"}
    person = lambda p: users.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "email", "first_name", "last_name")])
    claims = expenses.select(F.col("id").alias("c_id"), F.col("user_id").alias("c_owner"), F.col("approver_id").alias("c_approver"),
                             "title", "currency", "amount", "expense_date", "category", "vendor")
    facts = (moves.filter(F.col("action").isin(list(kinds))).join(claims, F.col("expense_id") == F.col("c_id"))
             .join(person("owner"), F.col("c_owner") == F.col("owner_id"))
             .join(person("approver"), F.col("c_approver") == F.col("approver_id"), "left")
             .join(person("actor"), F.col("user_id") == F.col("actor_id"), "left"))
    full = lambda p: F.concat_ws(" ", F.col(f"{p}_first_name"), F.col(f"{p}_last_name"))
    day = F.date_format("created_at", "yyyy-MM-dd")
    url = F.concat(F.lit(f"{base_url.rstrip('/')}/expenses/"), F.col("expense_id").cast("string"))
    common = {"expenseTitle": F.col("title"), "currency": F.col("currency"), "amount": F.col("amount").cast("string"),
              "expenseDate": F.date_format("expense_date", "yyyy-MM-dd"), "category": F.col("category"), "vendor": F.col("vendor"),
              "expenseUrl": url, "approvalUrl": url, "submissionDate": day, "approvalDate": day, "rejectionDate": day,
              "approvalNotes": F.col("notes"), "rejectionReason": F.col("notes"), "firstName": F.col("owner_first_name"),
              "submitterName": full("owner")}

    def letter(to: str, template: Column, approver: Column) -> Column:
        entries = [x for k, v in {**common, "approverName": approver}.items() for x in (F.lit(k), v)]
        return F.struct(F.col(f"{to}_email").alias("receiver"), template.alias("template"), F.create_map(*entries).alias("vars"))

    template = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("action"))
    to_owner = letter("owner", template, full("actor"))
    request = F.when((F.col("action") == "submitted") & F.col("approver_id").isNotNull(), letter("approver", F.lit("approval-request"), full("approver")))
    return facts.select("id", F.explode(F.array_compact(F.array(to_owner, request))).alias("mail")).select("id", "mail.*")


def default_templates(spark) -> DataFrame:
    """Plain templates for the six message kinds, to be replaced by an installation's own."""
    texts = {
        "email-verification": ("Verify your account", "Hello {{firstName}}, confirm here: {{verificationUrl}}"),
        "password-reset": ("Reset your password", "Hello {{firstName}}, choose a new password: {{resetUrl}}"),
        "expense-submitted": (
            "Expense submitted for approval",
            "Hello {{firstName}}, {{expenseTitle}} ({{currency}} {{amount}}, {{expenseDate}}, {{category}}, "
            "{{vendor}}) waits for approval: {{expenseUrl}}"),
        "expense-approved": (
            "Expense approved",
            "Hello {{firstName}}, {{approverName}} approved {{expenseTitle}} ({{currency}} {{amount}}) on "
            "{{approvalDate}}.{{#if approvalNotes}} Notes: {{approvalNotes}}{{/if}} {{expenseUrl}}"),
        "expense-rejected": (
            "Expense rejected",
            "Hello {{firstName}}, {{approverName}} rejected {{expenseTitle}} ({{currency}} {{amount}}) on "
            "{{rejectionDate}}.{{#if rejectionReason}} Reason: {{rejectionReason}}{{/if}} {{expenseUrl}}"),
        "approval-request": (
            "New expense requires your approval",
            "Hello {{approverName}}, {{submitterName}} sent {{expenseTitle}} ({{currency}} {{amount}}, "
            "{{expenseDate}}, {{category}}, {{vendor}}) on {{submissionDate}}: {{approvalUrl}}"),
    }
    return spark.createDataFrame([(n, s, h) for n, (s, h) in texts.items()], "name string, subject string, html string")
