from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendspark.operators import reports, views, workflow
from tests import seed


def test_user_summary_of_the_seed(spark):
    rows = {r["user_id"]: r for r in reports.user_summary(seed.expenses(spark), seed.users(spark)).collect()}
    got = {u: (r["total_expenses"], r["pending_count"], r["approved_count"], r["rejected_count"], r["reimbursed_count"],
               r["total_amount"], r["pending_amount"], r["approved_amount"]) for u, r in rows.items()}
    assert got["u3"] == (3, 1, 1, 0, 1, Decimal("430.50"), Decimal("320.00"), Decimal("110.50"))
    assert got["u4"] == (3, 1, 1, 0, 0, Decimal("1345.75"), Decimal("850.00"), Decimal("450.00"))
    assert got["u5"] == (3, 0, 2, 0, 1, Decimal("1250.00"), Decimal("0.00"), Decimal("1250.00"))
    assert got["u1"] == (0, 0, 0, 0, 0, 0, 0, 0)


def test_category_breakdown_of_the_seed(spark):
    all_users = seed.expenses(spark).withColumn("user_id", F.lit("all"))
    got = {r["category"]: (r["count"], float(r["total_amount"])) for r in reports.category_breakdown(all_users).collect()}
    assert got == {"software": (2, 770.0), "training": (1, 850.0), "travel": (1, 650.0), "accommodation": (1, 420.0),
                   "meals": (2, 265.5), "office_supplies": (1, 45.75), "transportation": (1, 25.0)}


def test_category_sums_add_up_to_the_summary(claims):
    total = claims.expenses.agg(F.sum("amount")).first()[0]
    assert reports.category_breakdown(claims.expenses).agg(F.sum("total_amount")).first()[0] == total
    assert reports.user_summary(claims.expenses).agg(F.sum("total_amount")).first()[0] == total


def test_pending_queue_is_oldest_first(spark):
    queue = views.pending_queue(seed.expenses(spark), seed.users(spark))
    assert [(r["title"], r["user_name"]) for r in queue.collect()] == [
        ("Adobe Creative Suite", "Mia Silva"), ("Tech Conference Ticket", "Leo Santos")]


def test_backfill_of_the_seed(spark):
    full = workflow.backfill_status_times(seed.expenses(spark))
    audit = workflow.backfill_audit(full, seed.users(spark))
    assert seed.as_dict(audit.groupBy("action").count(), "action", "count") == {
        "created": 9, "submitted": 8, "approved": 6, "reimbursed": 2}


def test_sorting_places_nulls_and_states(spark):
    df = spark.createDataFrame([(1, "rejected"), (2, "draft"), (3, None), (4, "changes_requested"), (5, "pending")],
                               "id int, status string")
    assert [r["id"] for r in views.sort_expenses(df, "status", "asc").collect()] == [2, 5, 1, 4, 3]
    assert [r["id"] for r in views.sort_expenses(df, "status", "DESC").collect()] == [3, 4, 1, 5, 2]


def test_unknown_sort_field_means_created_at(spark):
    rows = views.sort_expenses(seed.expenses(spark), "password", "asc").collect()
    assert rows[0]["id"] == "e1" and rows[-1]["id"] == "e6"


def test_dossier_has_one_shape_and_order_at_any_size(spark):
    users, expenses = seed.users(spark), seed.expenses(spark)
    comments = spark.range(500).selectExpr(
        "CAST(id AS STRING) AS id", "CASE WHEN id % 3 = 0 THEN 'e1' ELSE 'e2' END AS expense_id", "'u2' AS user_id",
        "'text ' || id AS comment", "false AS is_internal", "TIMESTAMP '2024-01-01' + CAST(id AS INT) * INTERVAL '1' SECOND AS created_at")
    audit = spark.range(2500).selectExpr("CAST(id AS STRING) AS id", "'e1' AS expense_id", "'u2' AS user_id", "'updated' AS action",
                                         "TIMESTAMP '2024-01-01' + CAST(id AS INT) * INTERVAL '1' SECOND AS created_at")
    lines = views.expense_dossier(users, comments, audit)
    assert lines.count() == 3000
    ordered = [r["line_id"] for r in lines.filter("expense_id = 'e1'").orderBy("expense_id", *views.dossier_order()).collect()]
    assert ordered == [str(i) for i in range(0, 500, 3)] + [str(i) for i in range(2499, -1, -1)]
    rows = {r["id"]: r for r in views.nest(views.expense_detail(expenses, users), lines).collect()}
    assert len(rows) == 9 and rows["e3"]["comments"] == [] == rows["e3"]["audit_log"]
    assert [x["line_id"] for x in rows["e1"]["audit_log"]] == [str(i) for i in range(2499, -1, -1)]
    assert [x["text"] for x in rows["e2"]["comments"]] == [f"text {i}" for i in range(500) if i % 3]


def test_page_per_user_trims_before_the_shuffle(claims):
    plan = views.page_per_user(claims.expenses, views.sort_keys(), 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_deep_page_ranks_parts_of_a_user_first(claims):
    deep = views.page_per_user(claims.expenses.withColumn("user_id", F.lit(1)), views.sort_keys(), 60, 20)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number()") >= 2 and "part#" in plan
    wanted = views.page(claims.expenses, views.sort_keys(), 60, 20)
    assert [r["id"] for r in deep.orderBy("rn").collect()] == [r["id"] for r in wanted.collect()]


def test_approvers_are_numbered_without_gaps(claims):
    slots = [r["slot"] for r in views.number_approvers(claims.users).orderBy("slot").collect()]
    assert slots == list(range(len(slots))) and slots


def test_no_approver_leaves_the_draw_empty(spark):
    nobody = seed.users(spark).filter("role = 'employee'")
    assert {r["assigned_to"] for r in views.assign_approver(seed.expenses(spark), nobody).collect()} == {None}


def test_every_draw_is_an_active_approver(spark):
    drawn = views.assign_approver(seed.expenses(spark), seed.users(spark), seed=7)
    assert drawn.count() == 9 and {r["assigned_to"] for r in drawn.collect()} <= {"u1", "u2"}


def test_filters_reach_the_scan(claims):
    one = reports.user_summary(claims.expenses).filter("user_id = 5")
    assert "EqualTo(o_custkey,5)" in one._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["user_summary", "expense_detail", "suggest_category", "extract_receipt", "backfill_audit"])
def test_no_python_and_no_cross_product(spark, name):
    from checks import load_all
    from checks.registry import QUERIES

    load_all()
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bucketed_tables_meet_without_a_shuffle(spark, claims, folder):
    import uuid

    from spendspark.sources.tables import write_bucketed

    run = uuid.uuid4().hex
    plain = {"expenses": (claims.expenses, "id"), "comments": (claims.comments, "expense_id"), "audit": (claims.audit_log, "expense_id")}
    stored = {n: write_bucketed(df, f"{n}_{run}", f"{folder}/{n}", key, 8) for n, (df, key) in plain.items()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        active = views.with_activity(**{n: stored[n] for n in plain})
        plan = active._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        # the lines of the expenses too
        joined = stored["expenses"].join(stored["audit"].withColumnRenamed("id", "line_id"), stored["expenses"]["id"] == stored["audit"]["expense_id"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        twin = views.with_activity(*[df for df, _ in plain.values()])
        assert "Exchange" in twin._jdf.queryExecution().executedPlan().toString()
        assert active.exceptAll(twin).count() == 0 and active.count() == twin.count()
        total = active.agg(F.sum("n_comments"), F.sum("n_audit")).first()
        held = claims.expenses.select(F.col("id").alias("expense_id"))
        assert tuple(total) == tuple(df.join(held, "expense_id", "left_semi").count() for df in (claims.comments, claims.audit_log))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in plain:
            spark.sql(f"DROP TABLE {name}_{run}")
