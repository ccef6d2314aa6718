"""Declared table schemas. Secret columns (password hash, two-factor secret) are
left out on purpose, so no job can load them."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
CONFIDENCE = T.DecimalType(3, 2)

STRING = T.StringType()
BOOL = T.BooleanType()
INT = T.IntegerType()
TS = T.TimestampType()
DATE = T.DateType()


def _table(*columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


TABLES: dict[str, T.StructType] = {
    "users": _table(
        ("id", STRING), ("email", STRING), ("first_name", STRING), ("last_name", STRING),
        ("role", STRING), ("department", STRING), ("manager_id", STRING), ("is_active", BOOL),
        ("email_verified", BOOL), ("two_factor_enabled", BOOL), ("avatar_url", STRING),
        ("notification_preferences", STRING), ("created_at", TS), ("updated_at", TS), ("last_login", TS),
    ),
    "expenses": _table(
        ("id", STRING), ("user_id", STRING), ("title", STRING), ("description", STRING),
        ("amount", MONEY), ("currency", STRING), ("expense_date", DATE), ("vendor", STRING),
        ("category", STRING), ("status", STRING), ("receipt_url", STRING), ("receipt_filename", STRING),
        ("ocr_data", STRING), ("ocr_status", STRING), ("ml_suggested_category", STRING),
        ("ml_confidence", CONFIDENCE), ("approver_id", STRING), ("approved_at", TS), ("rejected_at", TS),
        ("reimbursed_at", TS), ("approval_notes", STRING), ("created_at", TS), ("updated_at", TS),
    ),
    "expense_audit_log": _table(
        ("id", STRING), ("expense_id", STRING), ("user_id", STRING), ("action", STRING),
        ("old_status", STRING), ("new_status", STRING), ("notes", STRING), ("metadata", STRING),
        ("created_at", TS),
    ),
    "expense_comments": _table(
        ("id", STRING), ("expense_id", STRING), ("user_id", STRING), ("comment", STRING),
        ("is_internal", BOOL), ("created_at", TS), ("updated_at", TS),
    ),
    "notifications": _table(
        ("id", STRING), ("user_id", STRING), ("title", STRING), ("message", STRING), ("type", STRING),
        ("related_expense_id", STRING), ("read", BOOL), ("email_sent", BOOL), ("created_at", TS),
    ),
    "system_settings": _table(
        ("key", STRING), ("value", STRING), ("description", STRING), ("updated_by", STRING),
        ("updated_at", TS),
    ),
    "ocr_queue": _table(
        ("id", STRING), ("expense_id", STRING), ("receipt_url", STRING), ("status", STRING),
        ("attempts", INT), ("max_attempts", INT), ("error_message", STRING), ("processed_at", TS),
        ("created_at", TS),
    ),
    "password_reset_tokens": _table(
        ("id", STRING), ("user_id", STRING), ("token", STRING), ("expires_at", TS), ("used", BOOL),
        ("created_at", TS),
    ),
    "email_verification_tokens": _table(
        ("id", STRING), ("user_id", STRING), ("token", STRING), ("expires_at", TS), ("used", BOOL),
        ("created_at", TS),
    ),
}

KEYS = {name: "key" if name == "system_settings" else "id" for name in TABLES}

# (table, column, referenced table)
FOREIGN_KEYS = [
    ("users", "manager_id", "users"),
    ("password_reset_tokens", "user_id", "users"),
    ("email_verification_tokens", "user_id", "users"),
    ("expenses", "user_id", "users"),
    ("expenses", "approver_id", "users"),
    ("expense_audit_log", "expense_id", "expenses"),
    ("expense_audit_log", "user_id", "users"),
    ("expense_comments", "expense_id", "expenses"),
    ("expense_comments", "user_id", "users"),
    ("notifications", "user_id", "users"),
    ("notifications", "related_expense_id", "expenses"),
    ("system_settings", "updated_by", "users"),
    ("ocr_queue", "expense_id", "expenses"),
]

NOT_NULL = {
    "users": ["email", "first_name", "last_name"],
    "expenses": ["user_id", "title", "amount", "expense_date", "category"],
    "expense_audit_log": ["expense_id", "user_id", "action"],
    "expense_comments": ["expense_id", "user_id", "comment"],
    "notifications": ["user_id", "title", "message", "type"],
    "system_settings": ["key", "value"],
    "ocr_queue": ["expense_id", "receipt_url"],
    "password_reset_tokens": ["user_id", "token", "expires_at"],
    "email_verification_tokens": ["user_id", "token", "expires_at"],
}

BLOCKS = T.StructType([
    T.StructField("receipt_key", STRING), T.StructField("pos", INT), T.StructField("Id", STRING),
    T.StructField("BlockType", STRING), T.StructField("Text", STRING),
    T.StructField("Confidence", T.DoubleType()), T.StructField("EntityTypes", T.ArrayType(STRING)),
    T.StructField("Relationships", T.ArrayType(T.StructType([
        T.StructField("Type", STRING), T.StructField("Ids", T.ArrayType(STRING))]))),
])

FEEDBACK = T.StructType([
    T.StructField("timestamp", STRING),
    T.StructField("expense_data", T.StructType([
        T.StructField("title", STRING), T.StructField("description", STRING),
        T.StructField("vendor", STRING), T.StructField("amount", T.DoubleType())])),
    T.StructField("predicted_category", STRING), T.StructField("actual_category", STRING),
    T.StructField("confidence", T.DoubleType()),
])

SAMPLE_RECEIPTS = T.StructType([T.StructField("receipts", T.ArrayType(T.StructType(
    [T.StructField(n, STRING) for n in ("id", "type", "vendor")]
    + [T.StructField("amount", T.DoubleType()), T.StructField("currency", STRING),
       T.StructField("date", STRING), T.StructField("category", STRING),
       T.StructField("description", STRING), T.StructField("items", T.ArrayType(STRING)),
       T.StructField("tax", T.DoubleType()), T.StructField("total", T.DoubleType())]
    + [T.StructField(n, STRING) for n in ("from", "to", "distance", "plan", "billing_cycle")]
    + [T.StructField("nights", INT), T.StructField("room_type", STRING),
       T.StructField("breakfast", STRING)])))])
