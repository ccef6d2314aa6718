"""Joined views, sorting and paging.

Joins are plain equi joins without hints: Spark broadcasts the user side only
while its size is below spark.sql.autoBroadcastJoinThreshold, otherwise it
shuffles and AQE splits the keys that are too large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendspark import fixed
from spendspark.functions.scalars import display_name, enum_rank
from spendspark.session import cut

SORT_FIELDS = ["created_at", "expense_date", "amount", "status", "title"]


def sort_keys(by: str = "created_at", order: str = "desc", tiebreak: str = "id") -> list[Column]:
    """Unknown field: created_at. Anything but 'asc': descending. Nulls sort as the
    largest value; status sorts by its position in the enum."""
    field = by if by in SORT_FIELDS else "created_at"
    key = enum_rank(F.col("status"), fixed.STATUSES) if field == "status" else F.col(field)
    if str(order).lower() == "asc":
        return [key.asc_nulls_last(), F.col(tiebreak).asc()]
    return [key.desc_nulls_first(), F.col(tiebreak).asc()]


def sort_expenses(expenses: DataFrame, by: str = "created_at", order: str = "desc") -> DataFrame:
    return expenses.orderBy(*sort_keys(by, order))


def page(df: DataFrame, keys: list[Column], page: int = 1, limit: int = 20) -> DataFrame:
    """One page of the whole result: a distributed top-k, not a full sort."""
    return df.orderBy(*keys).offset((page - 1) * limit).limit(limit)


def page_after(df: DataFrame, column: str, after, after_id, limit: int = 20, id_column: str = "id") -> DataFrame:
    """Newest-first page that starts behind a given row: no deep offset to skip."""
    at = F.lit(after).cast(df.schema[column].dataType)
    behind = (F.col(column) < at) | ((F.col(column) == at) & (F.col(id_column) > F.lit(after_id)))
    return df.filter(behind).orderBy(F.col(column).desc(), F.col(id_column).asc()).limit(limit)


class RangedPages:
    """A table dealt into ranges of its order, for pages at any depth.

    Spark samples the order once and deals the rows into `ranges` ranges, which are written with their
    number and counted: one row per range reaches the driver. A page then reads and sorts only the
    ranges that hold it, two as a rule, however deep it lies. Rows that the order can't tell apart lie
    in one range, so it should end with a key. Select the columns that the pages need beforehand."""

    RANGE = "range of the pages"

    def __init__(self, df: DataFrame, keys: list[Column], ranges: int | None = None):
        self.keys = keys
        number = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.held = cut(df.repartitionByRange(number, *keys).withColumn(self.RANGE, F.spark_partition_id()))
        sizes = self.held.groupBy(F.col(f"`{self.RANGE}`").alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()
        self.sizes = sorted((row["r"], row["n"]) for row in sizes)

    def ranges_of(self, page: int, limit: int) -> tuple[list[int], int]:
        """Ranges that hold a page, and how many rows of the first of them come before it."""
        first, end = (page - 1) * limit, page * limit
        at, found, skip = 0, [], 0
        for number, n in self.sizes:
            if at < end and at + n > first:
                skip = first - at if not found else skip
                found.append(number)
            at += n
        return found, skip

    def page(self, page: int = 1, limit: int = 20) -> DataFrame:
        """The rows that views.page gives, in their order."""
        found, skip = self.ranges_of(page, limit)
        rows = self.held.filter(F.col(f"`{self.RANGE}`").isin(found)).orderBy(*self.keys)
        return rows.offset(skip).limit(limit if found else 0).drop(self.RANGE)


def page_per_user(df: DataFrame, keys: list[Column], page: int = 1, limit: int = 20,
                  owner: str = "user_id", row_id: str = "id", salts: int = 64) -> DataFrame:
    """The same page of every user at once. Rows are first ranked in `salts` parts of
    each user and only the first page*limit of each part go on to the rank over the user,
    so a user with a third of all rows costs at most salts*page*limit rows in one task,
    on deep pages too."""
    part = F.pmod(F.xxhash64(row_id), F.lit(salts))
    first = df.withColumn("part", part).withColumn(
        "rn", F.row_number().over(Window.partitionBy(owner, "part").orderBy(*keys))).filter(F.col("rn") <= page * limit).drop("rn", "part")
    numbered = first.withColumn("rn", F.row_number().over(Window.partitionBy(owner).orderBy(*keys)))
    return numbered.filter((F.col("rn") <= page * limit) & (F.col("rn") > (page - 1) * limit))


def recent_expenses(expenses: DataFrame, n: int = 3) -> DataFrame:
    return page_per_user(expenses, sort_keys(), page=1, limit=n)


def count_matching(df: DataFrame, limit: int = 20, by: list[str] | None = None) -> DataFrame:
    """Rows and pages of a filtered table, as a whole or per group."""
    total = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / F.lit(limit)).cast("long"))


def page_count(total: int, limit: int) -> int:
    return math.ceil(total / limit)


# --- joins ------------------------------------------------------------------------


def _person(users: DataFrame, role: str, *extra: str) -> DataFrame:
    """Users in one role of a query: (role_key, role_name, role_<extra>...)."""
    return users.select(
        F.col("id").alias(f"{role}_key"),
        display_name(F.col("first_name"), F.col("last_name")).alias(f"{role}_name"),
        *[F.col(c).alias(f"{role}_{c}") for c in extra],
    )


def with_approver(expenses: DataFrame, users: DataFrame, *extra: str) -> DataFrame:
    approver = _person(users, "approver", *extra)
    joined = expenses.join(approver, F.col("approver_id") == F.col("approver_key"), "left").drop("approver_key")
    # without an approver the name is the blank between two empty names
    return joined.withColumn("approver_name", F.coalesce(F.col("approver_name"), F.lit(" ")))


def expense_list(expenses: DataFrame, users: DataFrame, by: str = "created_at", order: str = "desc",
                 page_no: int | None = None, limit: int = 20, per_user: bool = True) -> DataFrame:
    """Expenses with the approver's name. With a page number the page is cut before
    the join (a left join keeps every row), so only page rows are looked up."""
    if page_no is not None:
        keys = sort_keys(by, order)
        if per_user:
            expenses = page_per_user(expenses, keys, page_no, limit)
        else:
            expenses = page(expenses, keys, page_no, limit)
    return with_approver(expenses, users)


def with_submitter_contact(expenses: DataFrame, users: DataFrame) -> DataFrame:
    """Expenses with the submitter's e-mail and names; unknown submitters drop out."""
    contact = users.select(F.col("id").alias("contact_id"), "email", "first_name", "last_name")
    return expenses.join(contact, F.col("user_id") == F.col("contact_id")).drop("contact_id")


def expense_detail(expenses: DataFrame, users: DataFrame) -> DataFrame:
    submitter = _person(users, "user", "email")
    joined = expenses.join(submitter, F.col("user_id") == F.col("user_key")).drop("user_key")
    return with_approver(joined, users, "email")


def _with_author(rows: DataFrame, users: DataFrame) -> DataFrame:
    author = _person(users, "user")
    return rows.join(author, F.col("user_id") == F.col("user_key")).drop("user_key")


def comment_thread(comments: DataFrame, users: DataFrame, order_by: str = "created_at") -> DataFrame:
    """Oldest first within each expense."""
    return _with_author(comments, users).orderBy("expense_id", F.col(order_by).asc(), "id")


def audit_trail(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Newest first within each expense."""
    return _with_author(audit, users).orderBy("expense_id", F.col("created_at").desc(), "id")


def expense_dossier(users: DataFrame, comments: DataFrame, audit: DataFrame, comment_order: str = "created_at") -> DataFrame:
    """Comments and audit lines of expenses in long form: one row per line, at any size.

    Columns: expense_id, section (comment or audit), at, line_id, user_name, text,
    is_internal. dossier_order puts comments oldest first, audit lines newest first. The
    expense itself is a row of expense_detail; nest makes arrays of the lines.
    """
    said = comments.select("expense_id", F.lit("comment").alias("section"), F.col(comment_order).alias("at"),
                           F.col("id").alias("line_id"), "user_id", F.col("comment").alias("text"), "is_internal")
    done = audit.select("expense_id", F.lit("audit").alias("section"), F.col("created_at").alias("at"),
                        F.col("id").alias("line_id"), "user_id", F.col("action").alias("text"), F.lit(None).cast("boolean").alias("is_internal"))
    return _with_author(said.unionByName(done), users).select(
        "expense_id", "section", "at", "line_id", "user_name", "text", "is_internal")


def with_activity(expenses: DataFrame, comments: DataFrame, audit: DataFrame) -> DataFrame:
    """Expenses with n_comments, last_comment_at, n_audit and last_audit_at. On tables that are
    bucketed by the expense (tables.write_bucketed) nothing is shuffled."""
    def told(rows: DataFrame, name: str, number: str) -> DataFrame:
        return rows.groupBy(F.col("expense_id").alias(f"{name}_of")).agg(
            F.count(F.lit(1)).alias(number), F.max("created_at").alias(f"last_{name}_at"))

    met = expenses.join(told(comments, "comment", "n_comments"), F.col("id") == F.col("comment_of"), "left").join(
        told(audit, "audit", "n_audit"), F.col("id") == F.col("audit_of"), "left").drop("comment_of", "audit_of")
    return met.fillna(0, ["n_comments", "n_audit"])


def dossier_order() -> list[Column]:
    """Sort keys of the lines of one expense."""
    newest = F.col("section") == "audit"
    return [F.col("section").desc(), F.when(~newest, F.col("at")).asc(), F.when(~newest, F.col("line_id")).asc(),
            F.when(newest, F.col("at")).desc(), F.when(newest, F.col("line_id")).desc()]


def nest(details: DataFrame, lines: DataFrame) -> DataFrame:
    """Details (one row per expense) with the arrays comments and audit_log. For the
    expenses that are to be shown, such as a page of them: all lines of one expense
    meet in one row, so whoever asks for it decides how much that is."""
    def array(section: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("at", "line_id", "user_name", "text", "is_internal"))))

    nested = lines.join(details.select(F.col("id").alias("expense_id")), "expense_id", "left_semi").groupBy(
        F.col("expense_id").alias("n_id")).agg(array("comment").alias("comments"), F.reverse(array("audit")).alias("audit_log"))
    met = details.join(nested, F.col("id") == F.col("n_id"), "left").drop("n_id")
    empty = {name: F.coalesce(F.col(name), F.array().cast(nested.schema[name].dataType)) for name in ("comments", "audit_log")}
    return met.withColumns(empty)


def pending_queue(expenses: DataFrame, users: DataFrame, page_no: int | None = None, limit: int = 20) -> DataFrame:
    """Pending expenses, oldest first, with the submitter's name, e-mail, department."""
    submitter = _person(users, "user", "email", "department")
    queue = (
        expenses.filter(F.col("status") == "pending")
        .join(submitter, F.col("user_id") == F.col("user_key")).drop("user_key")
    )
    keys = [F.col("created_at").asc(), F.col("id").asc()]
    return queue.orderBy(*keys) if page_no is None else page(queue, keys, page_no, limit)


def user_list(users: DataFrame, role: str | None = None, active: str | None = None,
              page_no: int = 1, limit: int = 20) -> DataFrame:
    """Newest accounts first, without secret columns."""
    from spendspark.operators.filters import filter_users, safe_user_columns

    keys = [F.col("created_at").desc_nulls_first(), F.col("id").asc()]
    return page(safe_user_columns(filter_users(users, role, active)), keys, page_no, limit)


def notification_list(notifications: DataFrame, unread: bool = False, page_no: int = 1,
                      limit: int = 20) -> DataFrame:
    """The same page of every user's notifications, newest first."""
    from spendspark.operators.filters import unread_only

    rows = unread_only(notifications) if unread else notifications
    keys = [F.col("created_at").desc_nulls_first(), F.col("id").asc()]
    return page_per_user(rows, keys, page_no, limit)


def training_sample(expenses: DataFrame, as_of, n: int | None = 1000) -> DataFrame:
    """Decided expenses of the last six months for training, newest first; n=None
    takes them all (the limit is a single-machine habit)."""
    from spendspark.functions.predicates import within

    rows = expenses.filter(
        F.col("status").isin("approved", "reimbursed") & within("created_at", as_of, "months", 6)
    )
    if n is not None:
        rows = rows.orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(n)
    return rows.select("id", "title", "description", "vendor", "amount", "category")


def retry_candidates(queue: DataFrame, as_of, n: int | None = None, hours: int = 24) -> DataFrame:
    """Failed jobs with attempts left, from the last day; with n, the n oldest of them."""
    from spendspark.functions.predicates import within

    rows = queue.filter(
        (F.col("status") == "failed") & (F.col("attempts") < F.col("max_attempts"))
        & within("created_at", as_of, "hours", hours)
    )
    if n is None:
        return rows
    return rows.orderBy(F.col("created_at").asc(), F.col("id").asc()).limit(n)


def owner_of(rows: DataFrame, expenses: DataFrame, key: str = "expense_id") -> DataFrame:
    """Adds the owner of each expense id; unknown ids give no row."""
    owner = expenses.select(F.col("id").alias("owned_id"), F.col("user_id").alias("owner_id"))
    return rows.join(owner, F.col(key) == F.col("owned_id")).drop("owned_id")


def resolve_keys(rows: DataFrame, dimension: DataFrame, natural_key: str, row_key: str | None = None,
                 id_column: str = "id") -> DataFrame:
    """Looks up an id by natural key (e-mail, title). resolve_error says 'missing' or
    'ambiguous' where there is not exactly one; such a lookup would fail as a scalar
    subquery. The dimension is reduced to one row per key first, so duplicates never
    multiply rows."""
    row_key = row_key or natural_key
    unique = dimension.groupBy(F.col(natural_key).alias("natural_key")).agg(
        F.min(id_column).alias("found_id"), F.count(F.lit(1)).alias("found"))
    joined = rows.join(unique, F.col(row_key) == F.col("natural_key"), "left").drop("natural_key")
    error = (F.when(F.col("found").isNull(), "missing").when(F.col("found") > 1, "ambiguous"))
    return (joined.withColumn("resolve_error", error)
            .withColumn("resolved_id", F.when(F.col("resolve_error").isNull(), F.col("found_id")))
            .drop("found_id", "found"))


# --- picking an approver --------------------------------------------------------------


def number_approvers(users: DataFrame, buckets: int = 256, bucket: Column | None = None) -> DataFrame:
    """Active approvers and admins numbered 0..n-1 without pulling them through one
    task: a rank inside each hash bucket plus the sizes of the buckets before it
    (the running total runs over at most `buckets` rows)."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)) if bucket is None else bucket
    active = users.filter(F.col("role").isin(fixed.PRIVILEGED_ROLES) & F.col("is_active")).select(
        F.col("id").alias("approver_id"), bucket.cast("long").alias("bucket"))
    sizes = active.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(
        F.col("bucket").alias("of_bucket"),
        (F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("approver_id")) - 1
    return (
        active.withColumn("rank", rank)
        .join(F.broadcast(before), F.col("bucket") == F.col("of_bucket"))
        .select("approver_id", (F.coalesce("before", F.lit(0)) + F.col("rank")).alias("slot"))
    )


def assign_approver(expenses: DataFrame, users: DataFrame, seed: int = 0, key: str = "id",
                    bucket: Column | None = None, pick: Column | None = None) -> DataFrame:
    """One active approver or admin per expense, repeatable for a seed. Without any
    approver assigned_to is null: "No approvers available"."""
    slots = number_approvers(users, bucket=bucket).withColumnRenamed("approver_id", "assigned_to")
    total = slots.agg(F.count(F.lit(1)).alias("n")).scalar()
    draw = F.xxhash64(F.col(key), F.lit(seed)) if pick is None else pick
    drawn = expenses.withColumn("draw", F.when(total > 0, F.pmod(draw.cast("long"), total)))
    return drawn.join(slots, F.col("draw") == F.col("slot"), "left").drop("draw", "slot")
