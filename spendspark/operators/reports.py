"""Aggregate reports.

Every per-user report is one aggregation for all users; a single user's report is
a filter on it, which Catalyst moves below the aggregation. Partial aggregation
runs before each shuffle, so a user with a third of all rows arrives as one row
per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendspark.functions.predicates import in_year, within
from spendspark.functions.scalars import mean_of, moment


def status_count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def amount_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("amount")).otherwise(F.lit(0))), F.lit(0))


def rows_count() -> Column:
    return F.count(F.lit(1))


def total_amount() -> Column:
    return F.coalesce(F.sum("amount"), F.lit(0))


def status_flags(expenses: DataFrame) -> DataFrame:
    """Counts and amounts by status for the whole table in one pass."""
    from spendspark import fixed

    return expenses.agg(
        *[status_count(s).alias(f"{s}_count") for s in fixed.STATUSES],
        *[amount_where(F.col("status") == s).alias(f"{s}_amount") for s in fixed.STATUSES])


def user_summary(expenses: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Totals per user. With users given, those without expenses appear with zeros."""
    status = F.col("status")
    summary = expenses.groupBy("user_id").agg(
        rows_count().alias("total_expenses"),
        status_count("pending").alias("pending_count"),
        status_count("approved").alias("approved_count"),
        status_count("rejected").alias("rejected_count"),
        status_count("reimbursed").alias("reimbursed_count"),
        total_amount().alias("total_amount"),
        amount_where(status == "pending").alias("pending_amount"),
        amount_where(status.isin("approved", "reimbursed")).alias("approved_amount"))
    if users is None:
        return summary
    values = [c for c in summary.columns if c != "user_id"]
    ids = users.select(F.col("id").alias("listed_id"))
    joined = ids.join(summary, F.col("listed_id") == F.col("user_id"), "left")
    return joined.select(F.col("listed_id").alias("user_id"),
                         *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values])


def monthly_breakdown(expenses: DataFrame, as_of) -> DataFrame:
    """Months of the current year by expense date."""
    return expenses.filter(in_year("expense_date", as_of)).groupBy(
        "user_id", F.trunc("expense_date", "MM").alias("month")
    ).agg(rows_count().alias("count"), F.sum("amount").alias("total_amount"))


def category_breakdown(expenses: DataFrame) -> DataFrame:
    return expenses.groupBy("user_id", "category").agg(
        rows_count().alias("count"), F.sum("amount").alias("total_amount"))


def system_stats(expenses: DataFrame, as_of, days: int = 30, approximate: bool = False) -> DataFrame:
    """One row over the last days. approximate=True counts users by sketch."""
    distinct = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    return expenses.filter(within("created_at", as_of, "days", days)).agg(
        rows_count().alias("total_expenses"),
        distinct.alias("active_users"),
        status_count("pending").alias("pending_expenses"),
        status_count("approved").alias("approved_expenses"),
        status_count("rejected").alias("rejected_expenses"),
        status_count("reimbursed").alias("reimbursed_expenses"),
        total_amount().alias("total_amount"),
        F.coalesce(mean_of(F.col("amount")), F.lit(0.0)).alias("avg_amount"))


def user_role_stats(users: DataFrame) -> DataFrame:
    role = F.col("role")
    return users.agg(
        rows_count().alias("total_users"),
        F.count_if(F.col("is_active")).alias("active_users"),
        F.count_if(role == "employee").alias("employees"),
        F.count_if(role == "approver").alias("approvers"),
        F.count_if(role == "admin").alias("admins"))


def _category_aggregates() -> list[Column]:
    return [rows_count().alias("count"), F.sum("amount").alias("total_amount"),
            mean_of(F.col("amount")).alias("avg_amount")]


def category_stats(expenses: DataFrame, as_of, days: int = 30) -> DataFrame:
    return expenses.filter(within("created_at", as_of, "days", days)).groupBy("category").agg(
        *_category_aggregates())


def category_share(expenses: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Percentage of the total per category. The unpartitioned window runs over the
    grouped rows only: one per category."""
    stats = category_stats(expenses, as_of, days)
    share = F.col("total_amount").cast("double") / F.sum("total_amount").over(Window.partitionBy()).cast("double")
    return stats.select("category", "total_amount", F.round(share * 100, 0).cast("int").alias("percent"))


def daily_trend(expenses: DataFrame, as_of, days: int = 30, fill: bool = False) -> DataFrame:
    """Per creation day; fill=True adds the days without expenses."""
    trend = expenses.filter(within("created_at", as_of, "days", days)).groupBy(
        F.to_date("created_at").alias("date")
    ).agg(rows_count().alias("expense_count"), F.sum("amount").alias("total_amount"))
    if not fill:
        return trend
    last = F.to_date(moment(as_of))
    calendar = expenses.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days), last)).alias("date"))
    return calendar.join(trend, "date", "left").select(
        "date", F.coalesce("expense_count", F.lit(0)).alias("expense_count"),
        F.coalesce("total_amount", F.lit(0)).alias("total_amount"))


def user_stats(expenses: DataFrame, as_of, days: int = 30, users: DataFrame | None = None) -> DataFrame:
    stats = expenses.filter(within("created_at", as_of, "days", days)).groupBy("user_id").agg(
        rows_count().alias("total_expenses"),
        status_count("pending").alias("pending_expenses"),
        status_count("approved").alias("approved_expenses"),
        status_count("rejected").alias("rejected_expenses"),
        status_count("reimbursed").alias("reimbursed_expenses"),
        total_amount().alias("total_amount"),
        mean_of(F.col("amount")).alias("avg_amount"),
        F.max("amount").alias("max_amount"))
    if users is None:
        return stats
    values = [c for c in stats.columns if c != "user_id"]
    ids = users.select(F.col("id").alias("listed_id"))
    joined = ids.join(stats, F.col("listed_id") == F.col("user_id"), "left")
    return joined.select(F.col("listed_id").alias("user_id"),
                         *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values])


def user_monthly_trend(expenses: DataFrame, as_of, months: int = 12) -> DataFrame:
    return expenses.filter(within("created_at", as_of, "months", months)).groupBy(
        "user_id", F.trunc(F.to_date("created_at"), "MM").alias("month")
    ).agg(rows_count().alias("expense_count"), F.sum("amount").alias("total_amount"))


def user_category_stats(expenses: DataFrame, as_of, days: int = 30) -> DataFrame:
    return expenses.filter(within("created_at", as_of, "days", days)).groupBy("user_id", "category").agg(
        *_category_aggregates())


def _suggestion_aggregates() -> list[Column]:
    suggested = F.col("ml_suggested_category")
    return [rows_count().alias("total_expenses"),
            F.count(suggested).alias("ml_categorized"),
            F.count_if(suggested == F.col("category")).alias("ml_correct"),
            mean_of(F.col("ml_confidence")).alias("avg_confidence")]


def suggestion_stats_by_category(expenses: DataFrame, as_of, days: int = 30) -> DataFrame:
    return expenses.filter(within("created_at", as_of, "days", days)).groupBy("category").agg(
        *_suggestion_aggregates())


def suggestion_stats_overall(expenses: DataFrame, as_of, days: int = 30) -> DataFrame:
    return expenses.filter(within("created_at", as_of, "days", days)).agg(*_suggestion_aggregates())


def suggestion_stats(expenses: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Both levels in one pass; the overall row has level 'overall' and no category."""
    rolled = expenses.filter(within("created_at", as_of, "days", days)).rollup("category").agg(
        F.when(F.grouping("category") == 1, "overall").otherwise("category").alias("level"),
        *_suggestion_aggregates())
    return rolled


def training_counts(samples: DataFrame) -> DataFrame:
    """Usable rows per class, with the total beside each class."""
    from spendspark import fixed

    counts = samples.filter(F.col("category").isin(fixed.CATEGORIES)).groupBy("category").agg(
        rows_count().alias("samples"))
    # at most one row per category is left here
    return counts.withColumn("total", F.sum("samples").over(Window.partitionBy()))


def ocr_confidence(blocks: DataFrame) -> DataFrame:
    """Mean confidence of the LINE blocks on a 0..1 scale, 0 when there is none."""
    line = F.when(F.col("BlockType") == "LINE", F.col("Confidence"))
    return blocks.groupBy("receipt_key").agg(
        (F.coalesce(F.avg(line), F.lit(0.0)) / 100).alias("confidence"))


def classification_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, f1, support per class, then macro and weighted averages and
    accuracy, as rows. Only the confusion counts (classes squared) leave the first
    aggregation; a zero denominator gives 0."""
    cells = predictions.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        rows_count().alias("n"))
    hit = F.col("actual") == F.col("predicted")
    both_sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"),
                     F.when(hit, F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                     F.col("n").alias("said"), F.lit(0).cast("long").alias("hits")),
        )).alias("side")).select("side.*")
    sums = both_sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hits").alias("hits"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))

    per_class = (
        sums.withColumn("precision", ratio(F.col("hits"), F.col("said")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    measures = ["precision", "recall", "f1"]
    whole = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.sum("support").alias("support"))
    rows = F.array(*[
        F.struct(F.lit(name).alias("class"),
                 *[(F.col("accuracy") if name == "accuracy" else F.col(f"{name.split()[0]}_{m}")).alias(m)
                   for m in measures],
                 F.col("support"))
        for name in ("accuracy", "macro avg", "weighted avg")])
    summary = whole.select(F.explode(rows).alias("r")).select("r.*")
    return per_class.select("class", *measures, "support").unionByName(summary)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("predicted_category", "actual_category").agg(
        rows_count().alias("count"), F.avg("confidence").alias("mean_confidence"))
