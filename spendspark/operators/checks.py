"""Input validation, table integrity and token status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendspark import fixed, schema
from spendspark.functions.scalars import moment, trim_all


def _length_over(text: Column, limit: int) -> Column:
    return F.coalesce(F.char_length(trim_all(text)) > limit, F.lit(False))


def claim_date(text: Column) -> Column:
    """yyyy-mm-dd or yyyy/mm/dd as a date, else null."""
    shaped = text.rlike(r"^\d{4}([-/])\d{1,2}\1\d{1,2}$")
    return F.when(shaped, F.try_to_date(F.translate(text, "/", "-"), "yyyy-M-d"))


def claim_number(text: Column) -> Column:
    shaped = text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    return F.when(shaped, text.try_cast("double"))


def claim_amount(text: Column) -> Column:
    return claim_number(text).try_cast("decimal(10,2)")


def expense_errors(as_of=None, prefix: str = "") -> Column:
    """Messages for raw claim columns (text): title, description, amount, currency,
    expense_date, vendor, category. With as_of, dates after it are refused too."""
    def col(name: str) -> Column:
        return F.col(prefix + name).cast("string")

    title = F.coalesce(trim_all(col("title")), F.lit(""))
    # the number as given is compared: rounding first would let 0.007 pass
    number, amount = claim_number(col("amount")), claim_amount(col("amount"))
    day = claim_date(col("expense_date"))
    rules = [
        ((F.char_length(title) < 1) | (F.char_length(title) > 255), fixed.MSG_TITLE),
        (_length_over(col("description"), 1000), fixed.MSG_DESCRIPTION),
        (F.coalesce((number < 0.01) | amount.isNull(), F.lit(True)), fixed.MSG_AMOUNT),
        (F.coalesce(F.char_length(col("currency")) != 3, F.lit(False)), fixed.MSG_CURRENCY),
        (day.isNull(), fixed.MSG_DATE),
    ]
    if as_of is not None:
        rules.append((F.coalesce(day > F.to_date(moment(as_of)), F.lit(False)), fixed.MSG_DATE_FUTURE))
    rules += [
        (_length_over(col("vendor"), 255), fixed.MSG_VENDOR),
        (~F.coalesce(col("category").isin(fixed.CATEGORIES), F.lit(False)), fixed.MSG_CATEGORY),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in rules]))


def validate_expenses(claims: DataFrame, as_of=None) -> DataFrame:
    """Adds errors ARRAY<STRING>; empty means valid."""
    return claims.withColumn("errors", expense_errors(as_of))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def validate_users(users: DataFrame) -> DataFrame:
    """E-mail shape, names, department, role, and one account per e-mail. Addresses
    are compared in lower case; the first account (by id) of an address is the one
    that stands. The doubles come from a pre-aggregated join, not from a window, so
    one address on very many rows is no hot task."""
    email = F.lower(trim_all(F.col("email")))
    keyed = users.withColumn("email_key", email)
    taken = keyed.groupBy(F.col("email_key").alias("taken_key")).agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("accounts")
    ).filter(F.col("accounts") > 1)
    joined = keyed.join(taken, F.col("email_key") == F.col("taken_key"), "left")

    def name_bad(column: str) -> Column:
        length = F.char_length(F.coalesce(trim_all(F.col(column)), F.lit("")))
        return (length < 1) | (length > 100)

    rules = [
        (~F.coalesce(F.col("email_key").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s.]{2,}$"), F.lit(False)), fixed.MSG_EMAIL),
        (F.coalesce(F.col("id") != F.col("first_id"), F.lit(False)), fixed.MSG_EMAIL_TAKEN),
        (name_bad("first_name"), fixed.MSG_FIRST_NAME),
        (name_bad("last_name"), fixed.MSG_LAST_NAME),
        (_length_over(F.col("department"), 100), fixed.MSG_DEPARTMENT),
        (~F.coalesce(F.col("role").isin(fixed.ROLES), F.lit(False)), fixed.MSG_ROLE),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in rules]))
    return joined.withColumn("errors", errors).select(*users.columns, "errors")


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, bad_rows) for the constraints the tables given should keep:
    unique keys, references, amount > 0, required columns. Rules whose table or
    column is not given are left out."""
    parts: list[DataFrame] = []

    def add(table: str, rule: str, bad: DataFrame) -> None:
        parts.append(bad.agg(F.count(F.lit(1)).alias("bad_rows")).select(
            F.lit(table).alias("table"), F.lit(rule).alias("rule"), "bad_rows"))

    for table, df in tables.items():
        key = schema.KEYS.get(table, "id")
        if key in df.columns:
            doubled = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
            add(table, f"unique {key}", doubled)
        # one pass per table for its row rules
        row_rules = [(f"{c} not null", F.col(c).isNull()) for c in schema.NOT_NULL.get(table, []) if c in df.columns]
        if table == "expenses":
            row_rules.append(("amount > 0", ~(F.col("amount") > 0)))
        if row_rules:
            counted = df.agg(*[F.count_if(bad).alias(rule) for rule, bad in row_rules])
            entries = F.array(*[F.struct(F.lit(table).alias("table"), F.lit(rule).alias("rule"),
                                         F.col(f"`{rule}`").alias("bad_rows")) for rule, _ in row_rules])
            parts.append(counted.select(F.explode(entries).alias("r")).select("r.*"))
    for table, column, parent in schema.FOREIGN_KEYS:
        if table in tables and parent in tables and column in tables[table].columns:
            # one row per distinct reference before the join: a frequent key is no skew
            references = tables[table].filter(F.col(column).isNotNull()).groupBy(
                F.col(column).alias("ref")).agg(F.count(F.lit(1)).alias("rows"))
            parents = tables[parent].select(F.col(schema.KEYS[parent]).alias("known"))
            orphans = references.join(parents, F.col("ref") == F.col("known"), "left_anti")
            parts.append(orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("bad_rows")).select(
                F.lit(table).alias("table"), F.lit(f"{column} in {parent}").alias("rule"), "bad_rows"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def token_status(tokens: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Tokens per kind that are used, expired or open; tokens of unknown users do not
    count. tokens: kind, user_id, used, expires_at."""
    known = tokens.join(users.select(F.col("id").alias("known_user")), F.col("user_id") == F.col("known_user"))
    status = (F.when(F.col("used"), "used").when(F.col("expires_at") > moment(as_of), "open").otherwise("expired"))
    return known.groupBy("kind", status.alias("status")).agg(F.count(F.lit(1)).alias("tokens"))
