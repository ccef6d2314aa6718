"""Row filters and column selections."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark import fixed
from spendspark.functions.predicates import both


def _given(value) -> bool:
    """Null and empty text mean 'no filter'; the text '0' does filter."""
    return value is not None and value != ""


def filter_expenses(
    expenses: DataFrame,
    user=None,
    status: str | None = None,
    category: str | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    min_amount: Decimal | float | str | None = None,
    max_amount: Decimal | float | str | None = None,
) -> DataFrame:
    """Any subset of the conditions, AND-ed, bounds inclusive."""
    conditions: list[Column] = []
    if _given(user):
        conditions.append(F.col("user_id") == F.lit(user))
    if _given(status):
        conditions.append(F.col("status") == status)
    if _given(category):
        conditions.append(F.col("category") == category)
    if _given(start):
        conditions.append(F.col("expense_date") >= F.lit(str(start)).cast("date"))
    if _given(end):
        conditions.append(F.col("expense_date") <= F.lit(str(end)).cast("date"))
    if _given(min_amount):
        conditions.append(F.col("amount") >= F.lit(str(min_amount)).cast("decimal(12,2)"))
    if _given(max_amount):
        conditions.append(F.col("amount") <= F.lit(str(max_amount)).cast("decimal(12,2)"))
    return expenses.filter(both(conditions)) if conditions else expenses


def filter_users(users: DataFrame, role: str | None = None, active: str | bool | None = None) -> DataFrame:
    """active is compared with the text 'true'; any other given value means false."""
    conditions: list[Column] = []
    if _given(role):
        conditions.append(F.col("role") == role)
    if active is not None:
        wanted = active is True or active == "true"
        conditions.append(F.col("is_active") == F.lit(wanted))
    return users.filter(both(conditions)) if conditions else users


def with_status(expenses: DataFrame, status: str) -> DataFrame:
    return expenses.filter(F.col("status") == status)


def unread_only(notifications: DataFrame) -> DataFrame:
    return notifications.filter(~F.col("read"))


_USER_LIST = ["id", "email", "first_name", "last_name", "role", "department", "is_active",
              "email_verified", "two_factor_enabled", "created_at", "last_login"]
USER_LEVELS = {
    "list": _USER_LIST,
    "profile": _USER_LIST[:9] + ["avatar_url", "notification_preferences"] + _USER_LIST[9:],
    "session": ["id", "email", "first_name", "last_name", "role", "is_active", "created_at"],
}


def safe_user_columns(users: DataFrame, level: str = "list") -> DataFrame:
    """Columns fit to show at that level; those the table lacks are left out."""
    return users.select(*[c for c in USER_LEVELS[level] if c in users.columns])


def accessible_expenses(expenses: DataFrame, viewer, role: str) -> DataFrame:
    """What one viewer may open: approvers and admins everything, others their own."""
    if role in fixed.PRIVILEGED_ROLES:
        return expenses
    return expenses.filter(F.col("user_id") == F.lit(viewer))


def check_access(requests: DataFrame, users: DataFrame, expenses: DataFrame) -> DataFrame:
    """The same rule for a table of (viewer_id, expense_id) requests: access is
    'granted' or the refusal. Two equi joins; the viewer x expense pairs that nobody
    asked for are never built."""
    viewers = users.select(F.col("id").alias("v_id"), F.col("role").alias("v_role"),
                           F.col("is_active").alias("v_active"))
    owners = expenses.select(F.col("id").alias("e_id"), F.col("user_id").alias("e_owner"))
    asked = (
        requests.join(viewers, F.col("viewer_id") == F.col("v_id"), "left")
        .join(owners, F.col("expense_id") == F.col("e_id"), "left")
    )
    own = F.col("e_owner") == F.col("viewer_id")
    access = (
        F.when(F.col("v_id").isNull(), fixed.REFUSE_UNKNOWN_ACTOR)
        .when(~F.col("v_active"), fixed.REFUSE_INACTIVE_ACTOR)
        .when(F.col("e_id").isNull(), fixed.REFUSE_NOT_FOUND)
        .when(F.col("v_role").isin(fixed.PRIVILEGED_ROLES) | own, "granted")
        .otherwise(fixed.REFUSE_ACCESS)
    )
    return asked.select(*requests.columns, access.alias("access"))
