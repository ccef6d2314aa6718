import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spendspark import fixed
from spendspark.operators import checks, mutations, workflow
from tests import seed


def run(spark, rows, **options):
    return workflow.apply_actions(seed.expenses(spark), seed.actions(spark, rows), seed.users(spark), **options)


def test_one_expense_through_all_states(spark):
    result = run(spark, [
        (1, "e6", "u4", "submit", None), (2, "e6", "u2", "approve", ""), (3, "e6", "u2", "reimburse", None),
        (4, "e6", "u1", "reimburse", "paid"), (5, "e6", "u4", "submit", None), (6, "e6", "u4", "comment", " thanks ")])
    row = result.expenses.filter("id = 'e6'").first()
    assert (row["status"], row["approver_id"], row["approval_notes"]) == ("reimbursed", "u2", "")
    assert (row["approved_at"], row["reimbursed_at"]) == (datetime(2024, 2, 1, 0, 2), datetime(2024, 2, 1, 0, 4))
    assert row["updated_at"] == datetime(2024, 2, 1, 0, 4) and result.expenses.count() == 9 and result.changed.count() == 1
    audit = {r["action_id"]: (r["action"], r["old_status"], r["new_status"], r["notes"]) for r in result.audit.collect()}
    assert audit == {1: ("submitted", "draft", "pending", "Expense submitted for approval"),
                     2: ("approved", "pending", "approved", "Expense approved"),
                     4: ("reimbursed", "approved", "reimbursed", "paid"), 6: ("commented", None, None, "Added comment")}
    assert seed.as_dict(result.rejected, "action_id", "reason") == {
        3: fixed.REFUSE_ROLE, 5: "Can only submit expenses in draft status"}
    told = {r["action_id"]: (r["type"], r["message"]) for r in result.notifications.collect()}
    assert told[1] == ("approval_request", "Leo Santos submitted an expense for BRL 45.75")
    assert told[2] == ("expense_approved", 'Your expense "Office Supplies" has been approved by Jo Checker')
    assert told[4] == ("expense_reimbursed", 'Your expense "Office Supplies" has been reimbursed')
    assert [r["comment"] for r in result.comments.collect()] == ["thanks"]


def test_a_deleted_expense_takes_everything_along(spark):
    result = run(spark, [(1, "e6", "u4", "comment", "x"), (2, "e6", "u4", "delete", None), (3, "e6", "u4", "submit", None),
                         (4, "e6", "u2", "comment", "late")])
    assert result.expenses.filter("id = 'e6'").count() == 0 and result.expenses.count() == 8
    assert [r["expense_id"] for r in result.deleted.collect()] == ["e6"]
    assert result.audit.count() == 0 and result.comments.count() == 0
    assert seed.as_dict(result.rejected, "action_id", "reason") == {3: fixed.REFUSE_NOT_FOUND, 4: fixed.REFUSE_NOT_FOUND}
    left = workflow.cascade_delete({"expenses": seed.expenses(spark)}, result.deleted)["expenses"]
    assert left.count() == 8


def test_create_and_edit(spark):
    payload = spark.createDataFrame([
        (1, "n1", "u3", "create", "Taxi ride", "12.5", "2024-02-01", "transportation", None, datetime(2024, 2, 1)),
        (2, "n1", "u3", "update", " Taxi home ", "13", "2024/02/02", "transportation", "s/u3/a.png", datetime(2024, 2, 2)),
        (3, "n1", "u3", "create", "Again", "1", "2024-02-01", "meals", None, datetime(2024, 2, 3)),
        (4, "n2", "u3", "create", "", "0", "soon", "fun", None, datetime(2024, 2, 3)),
        (5, "n1", "u4", "update", "Mine now", "1", "2024-02-01", "meals", None, datetime(2024, 2, 4)),
        (6, "n1", "u3", "submit", None, None, None, None, None, datetime(2024, 2, 5))],
        "action_id long, expense_id string, actor_id string, action string, title string, amount string, expense_date string, "
        "category string, receipt_url string, ts timestamp").withColumn("notes", F.lit(None).cast("string"))
    result = workflow.apply_actions(seed.expenses(spark), payload, seed.users(spark))
    row = result.expenses.filter("id = 'n1'").first()
    assert (row["title"], float(row["amount"]), str(row["expense_date"]), row["currency"], row["status"], row["receipt_url"]) == (
        "Taxi home", 13.0, "2024-02-02", "BRL", "pending", "s/u3/a.png")
    assert row["created_at"] == datetime(2024, 2, 1)
    reasons = seed.as_dict(result.rejected, "action_id", "reason")
    assert reasons[3] == "Expense already exists" and reasons[5] == fixed.REFUSE_NOT_FOUND
    assert reasons[4] == "Validation failed: " + ", ".join(
        [fixed.MSG_TITLE, fixed.MSG_AMOUNT, fixed.MSG_DATE, fixed.MSG_CATEGORY])
    assert [r["receipt_url"] for r in result.ocr_jobs.collect()] == ["s/u3/a.png"]
    assert result.notifications.first()["message"] == "Mia Silva submitted an expense for BRL 13.00"


def test_order_of_refusals(spark):
    result = run(spark, [(1, "nope", "u3", "reject", " "), (2, "nope", "u2", "reject", " "), (3, "nope", "u2", "reject", "x"),
                         (4, "e3", "zz", "approve", None), (5, "e3", "u4", "comment", "hi"), (6, "e3", "u3", "dance", None),
                         (7, "e1", "u2", "approve", None), (8, "e6", "u3", "submit", None)])
    assert seed.as_dict(result.rejected, "action_id", "reason") == {
        1: fixed.REFUSE_ROLE, 2: "Rejection reason is required", 3: fixed.REFUSE_NOT_FOUND, 4: fixed.REFUSE_UNKNOWN_ACTOR,
        5: fixed.REFUSE_COMMENT_ACCESS, 6: "Unknown action", 7: "Can only approve pending expenses", 8: fixed.REFUSE_NOT_FOUND}


def test_without_approvers_nothing_is_submitted(spark):
    people = seed.users(spark).filter("role = 'employee'")
    result = workflow.apply_actions(seed.expenses(spark), seed.actions(spark, [(1, "e6", "u4", "submit", None)]), people)
    assert seed.as_dict(result.rejected, "action_id", "reason") == {1: fixed.REFUSE_NO_APPROVER}


def test_own_claims_may_be_barred(spark):
    own = seed.expenses(spark).withColumn("user_id", F.when(F.col("id") == "e3", "u2").otherwise(F.col("user_id")))
    acts = seed.actions(spark, [(1, "e3", "u2", "approve", None)])
    assert workflow.apply_actions(own, acts, seed.users(spark)).rejected.count() == 0
    barred = workflow.apply_actions(own, acts, seed.users(spark), forbid_self=True)
    assert seed.as_dict(barred.rejected, "action_id", "reason") == {1: fixed.REFUSE_ROLE}


def replay(rows):
    """The plain step-by-step reading of the rules, for comparison."""
    people = {i: role for i, _f, _n, role, _d in seed.PEOPLE}
    owner, state = {c[0]: c[1] for c in seed.CLAIMS}, {c[0]: c[7] for c in seed.CLAIMS}
    accepted = []
    for n, expense, actor, action, notes in rows:
        role, blank = people.get(actor), not (notes or "").strip()
        if role is None or (action in workflow.DECISIONS and role == "employee") or (action == "reimburse" and role != "admin"):
            continue
        if (action in fixed.REFUSE_TEXT and blank) or expense not in state:
            continue
        if action in workflow.OWNER_ACTIONS and owner[expense] != actor:
            continue
        if action == "comment":
            if role == "employee" and owner[expense] != actor:
                continue
        elif action == "delete":
            if state[expense] != "draft":
                continue
            del state[expense]
        else:
            before, after, _a, _n = fixed.TRANSITIONS[action]
            if state[expense] != before:
                continue
            state[expense] = after
        accepted.append(n)
    return accepted, state


@pytest.mark.parametrize("hot_rows", [1_000_000, 30])
def test_random_batches_equal_a_step_by_step_replay(spark, hot_rows):
    """A third of the actions hits one expense; with hot_rows=30 that one is salted."""
    draw = random.Random(11)
    kinds = ["submit", "delete", "comment", *workflow.DECISIONS, "reimburse"]
    rows = []
    for n in range(400):
        expense = "e6" if draw.random() < 0.33 else draw.choice([c[0] for c in seed.CLAIMS] + ["e404"])
        action = "submit" if n < 60 and draw.random() < 0.3 else draw.choice([k for k in kinds if k != "delete" or n > 300])
        rows.append((n, expense, draw.choice(["u1", "u2", "u3", "u4", "u5", "u9"]), action, draw.choice([None, " ", "text"])))
    acts = seed.actions(spark, rows).withColumn("ts", F.lit(datetime(2024, 2, 1)))  # same time: action_id decides
    result = workflow.apply_actions(seed.expenses(spark), acts, seed.users(spark), hot_rows=hot_rows, salts=4)
    accepted, state = replay(rows)
    rejected = {r["action_id"] for r in result.rejected.collect()}
    assert {r[0] for r in rows} - rejected == set(accepted)
    assert seed.as_dict(result.expenses, "id", "status") == state


def test_tables_are_checked(spark):
    expenses = seed.expenses(spark).withColumn(
        "user_id", F.when(F.col("id") == "e1", "ghost").otherwise(F.col("user_id"))).withColumn(
        "amount", F.when(F.col("id") == "e2", F.lit(0)).otherwise(F.col("amount")).cast("decimal(10,2)"))
    doubled = expenses.unionByName(expenses.filter("id = 'e3'"))
    report = {(r["table"], r["rule"]): r["bad_rows"] for r in checks.integrity_report(
        {"users": seed.users(spark), "expenses": doubled}).collect()}
    assert report[("expenses", "unique id")] == 1 and report[("expenses", "user_id in users")] == 1
    assert report[("expenses", "amount > 0")] == 1 and report[("expenses", "title not null")] == 0


def test_valid_and_refused_claims_are_split(spark):
    raw = spark.createDataFrame([("ok", None, "5", None, "2024-01-31", None, "meals"), ("ok", None, "1e400", "R$", "2024-1-32", None, None)],
                                "title string, description string, amount string, currency string, expense_date string, vendor string, category string")
    good, bad = checks.split_valid(checks.validate_expenses(raw))
    assert good.count() == 1
    assert bad.first()["errors"] == [fixed.MSG_AMOUNT, fixed.MSG_CURRENCY, fixed.MSG_DATE, fixed.MSG_CATEGORY]


def test_settings_keep_description_and_refuse_falsy(spark):
    settings = seed.table(spark, "system_settings", [dict(key="a", value="1", description="old"), dict(key="b", value="2")])
    updates = spark.createDataFrame(
        [(1, "a", '{"x": 1}', None, "u1", datetime(2024, 2, 1)), (2, "a", "0", "zero", "u1", datetime(2024, 2, 2)),
         (3, "c", '"new"', "fresh", "u1", datetime(2024, 2, 3))],
        "update_id long, key string, value string, description string, updated_by string, ts timestamp")
    merged, refused = mutations.upsert_settings(settings, updates)
    assert {r["key"]: (r["value"], r["description"]) for r in merged.collect()} == {
        "a": ('{"x": 1}', "old"), "b": ("2", None), "c": ('"new"', "fresh")}
    assert [r["update_id"] for r in refused.collect()] == [2]
    shown = mutations.settings_map(merged, ["a", "c"]).first()["settings"]
    assert shown["c"]["value"] == '"new"' and set(shown) == {"a", "c"}
    assert [r["key"] for r in mutations.settings_list(merged).collect()] == ["a", "b", "c"]


def test_default_thresholds(spark):
    amounts = spark.createDataFrame([(100,), (101,), (500,), (1000,)], "amount int")
    empty = seed.table(spark, "system_settings", [])
    assert [r["route"] for r in mutations.approval_route(amounts, empty).orderBy("amount").collect()] == [
        "auto", "approver", "manager", "admin"]


def test_templates(spark):
    templates = spark.createDataFrame(
        [("t", "Hi", "Dear {{name}}{{#if note}}, note: {{note}}{{/if}}{{#if none}} never\n{{/if}} {{other}} {{name}}")],
        "name string, subject string, html string")
    rows = spark.createDataFrame([(1, "t", {"name": "Ana", "note": "R$ 5 \\1"}), (2, "t", {"name": None, "note": ""}), (3, "x", {})],
                                 "id int, template string, vars map<string,string>")
    assert seed.as_dict(mutations.render_messages(rows, templates), "id", "body") == {
        1: "Dear Ana, note: R$ 5 \\1 {{other}} Ana", 2: "Dear  {{other}} ", 3: None}
    assert seed.as_dict(mutations.render_messages(rows, templates), "id", "reason") == {1: None, 2: None, 3: "unknown template"}
    own = spark.createDataFrame([(1, "x", {"a.b": "v"}, "{{a.b}}{{#if a.b}}!{{/if}}", "Mine"), (2, "t", None, "unused", None)],
                                "id int, template string, vars map<string,string>, html string, custom_subject string")
    assert {r["id"]: (r["subject"], r["body"]) for r in mutations.render_messages(own, templates).collect()} == {
        1: ("Mine", "v!"), 2: ("Hi", "Dear {{name}} {{other}} {{name}}")}
    assert mutations.default_templates(spark).count() == 6


def test_milestones_by_hash_aggregate(spark):
    """The first action by (ts, id) with its kind from one number, before 1970 and with negative ids too."""
    from datetime import datetime

    from spendspark.operators.workflow import _earliest

    rows = [("a", datetime(1969, 12, 31, 23, 59, 59, 999_999), 5, "submit"), ("a", datetime(1969, 12, 31, 23, 59, 59, 999_999), -7, "delete"),
            ("b", datetime(2025, 1, 2, 3, 4, 5, 6), 2**63 - 1, "reimburse"), ("b", datetime(9999, 12, 31), 1, "create"),
            ("c", datetime(9999, 12, 31, 23, 59, 59), -2**63, "request_changes"), ("d", datetime(1, 1, 2), 0, "comment")]
    first = _earliest(spark.createDataFrame(rows, "expense_id string, ts timestamp, action_id long, action string"), "m")
    assert "SortAggregate" not in first._jdf.queryExecution().toString()
    assert {r["m_id"]: (r["m_ts"], r["m_action_id"], r["m_action"]) for r in first.collect()} == {
        "a": (rows[1][1], -7, "delete"), "b": (rows[2][1], 2**63 - 1, "reimburse"), "c": (rows[4][1], -2**63, "request_changes"),
        "d": (rows[5][1], 0, "comment")}
