"""Claim tables derived from the star-schema test tables.

The view texts run unchanged in Spark and in DuckDB ({STRING} is the one word that
differs), so the same text prefixes every oracle query. Keys and enums come from
integer arithmetic; every view holds all rows of its base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-02 00:00:00"  # now for claims (orders end on 2001-08-01)
AS_OF_EVENTS = "2024-02-01 00:00:00"  # now for event based tables

BASE_TABLES = ["customer", "orders", "events", "conversations", "documents", "labels", "part", "supplier", "pages"]

_ACTION = """CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'approve'
         WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'reject' ELSE 'request_changes' END
         WHEN 'purchase' THEN 'reimburse'
         ELSE CASE event_id % 4 WHEN 0 THEN 'comment' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'submit' END END"""

VIEWS: dict[str, str] = {
    "users": """SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email,
       'First' || (c_custkey % 97) AS first_name, 'Last' || c_custkey AS last_name,
       CASE WHEN c_custkey % 50 = 0 THEN 'admin'
            WHEN c_custkey % 10 = 0 THEN 'approver' ELSE 'employee' END AS role,
       c_mktsegment AS department, c_acctbal >= 0 AS is_active,
       c_custkey % 3 <> 0 AS email_verified, c_custkey % 4 = 0 AS two_factor_enabled,
       CAST(NULL AS {STRING}) AS avatar_url,
       CASE WHEN c_custkey % 6 = 0 THEN NULL
            ELSE '{"email": ' || CASE WHEN c_custkey % 5 = 0 THEN 'false' ELSE 'true' END
                 || ', "in_app": ' || CASE WHEN c_custkey % 7 = 0 THEN 'false' ELSE 'true' END || '}'
            END AS notification_preferences,
       TIMESTAMP '1999-01-01 00:00:00' + CAST(c_custkey AS INT) * INTERVAL '1' HOUR AS created_at,
       TIMESTAMP '1999-01-01 00:00:00' + CAST(c_custkey AS INT) * INTERVAL '1' HOUR AS updated_at,
       CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS last_login
FROM customer""",
    "expenses": """SELECT o_orderkey AS id, o_custkey AS user_id,
       CASE o_orderkey % 11 WHEN 0 THEN 'Team Lunch Meeting' WHEN 1 THEN 'Uber to Client Office'
         WHEN 2 THEN 'Adobe Creative Suite' WHEN 3 THEN 'AWS Cloud Services'
         WHEN 4 THEN 'Tech Conference Ticket' WHEN 5 THEN 'Office Supplies'
         WHEN 6 THEN 'Client Dinner' WHEN 7 THEN 'Hotel Stay - Business Trip'
         WHEN 8 THEN 'Flight to Sao Paulo' WHEN 9 THEN 'Campaign branding' ELSE 'Misc' END AS title,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lower(o_orderpriority) END AS description,
       CAST(floor(o_totalprice) * 0.01 AS DECIMAL(10,2)) AS amount,
       'BRL' AS currency, CAST(o_orderdate AS DATE) AS expense_date,
       CASE o_orderkey % 5 WHEN 0 THEN 'Restaurante Central' WHEN 1 THEN 'Uber'
         WHEN 2 THEN 'Papelaria Central' WHEN 3 THEN 'Hotel Business Center' ELSE NULL END AS vendor,
       CASE o_orderkey % 9 WHEN 0 THEN 'meals' WHEN 1 THEN 'transportation' WHEN 2 THEN 'accommodation'
         WHEN 3 THEN 'office_supplies' WHEN 4 THEN 'software' WHEN 5 THEN 'training'
         WHEN 6 THEN 'marketing' WHEN 7 THEN 'travel' ELSE 'other' END AS category,
       CASE o_orderkey % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'pending' WHEN 2 THEN 'approved'
         WHEN 3 THEN 'draft' WHEN 4 THEN 'rejected' WHEN 5 THEN 'reimbursed'
         ELSE 'changes_requested' END AS status,
       'https://files.example.com/receipts/' || o_custkey || '/' || o_orderkey || '.jpg' AS receipt_url,
       o_orderkey || '.jpg' AS receipt_filename,
       CAST(NULL AS {STRING}) AS ocr_data, 'pending' AS ocr_status,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'meals' WHEN 2 THEN 'travel'
         ELSE 'software' END AS ml_suggested_category,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL
            ELSE CAST((o_orderkey % 100) * 0.01 AS DECIMAL(3,2)) END AS ml_confidence,
       CASE WHEN o_orderkey % 7 IN (0, 3) THEN NULL ELSE (o_orderkey % 15) * 10 END AS approver_id,
       CASE WHEN o_orderkey % 7 IN (2, 5)
            THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY END AS approved_at,
       CASE WHEN o_orderkey % 7 = 4
            THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY END AS rejected_at,
       CASE WHEN o_orderkey % 7 = 5
            THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '4' DAY END AS reimbursed_at,
       CASE WHEN o_orderkey % 7 = 4 THEN 'no receipt' END AS approval_notes,
       CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at
FROM orders""",
    "actions": f"""SELECT action_id, expense_id,
       CASE WHEN action = 'create' THEN grp % 140
            WHEN action IN ('submit', 'update', 'delete', 'comment') AND action_id % 8 <> 0
            THEN coalesce(o_custkey, grp % 140)
            WHEN action_id % 16 = 1 THEN user_id + 1000000
            WHEN action = 'reimburse' THEN (action_id % 3) * 50
            ELSE (action_id % 15) * 10 END AS actor_id,
       action, CASE WHEN action_id % 9 = 0 THEN NULL WHEN action_id % 9 = 1 THEN '  '
                    ELSE ' note ' || action_id END AS notes,
       action_id % 10 = 3 AS is_internal,
       CASE WHEN action IN ('create', 'update') THEN 'Claim ' || action_id END AS title,
       CASE WHEN action IN ('create', 'update')
            THEN CASE WHEN action_id % 7 = 5 THEN '-1' ELSE (action_id % 50 + 1) || '.50' END END AS amount,
       CASE WHEN action IN ('create', 'update') THEN '2001-07-0' || (action_id % 9 + 1) END AS expense_date,
       CASE WHEN action IN ('create', 'update') THEN 'meals' END AS category,
       CASE WHEN action IN ('create', 'update') AND action_id % 3 = 0
            THEN 'https://files.example.com/receipts/new/' || action_id || '.png' END AS receipt_url,
       ts
FROM (SELECT event_id AS action_id, grp, user_id, ts,
             CASE WHEN grp % 10 = 9 THEN grp + 1000000000 ELSE grp END AS expense_id,
             CASE WHEN grp % 10 = 9 AND event_id % 6 = 0 THEN 'create' ELSE {_ACTION} END AS action
      FROM (SELECT event_id, CAST(floor(event_id / 6) AS BIGINT) AS grp, user_id, event_type,
                   CAST(ts AS TIMESTAMP) AS ts FROM events) AS grouped_events) AS raw_actions
LEFT JOIN orders ON o_orderkey = expense_id""",
    "audit_log": """SELECT event_id AS id, CAST(floor(event_id / 6) AS BIGINT) AS expense_id, user_id,
       CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'submitted'
         WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'commented' END AS action,
       CAST(NULL AS {STRING}) AS notes, props AS metadata, CAST(ts AS TIMESTAMP) AS created_at
FROM events""",
    "comments": """SELECT conv_id * 100 + turn AS id, conv_id AS expense_id, conv_id % 150 AS user_id,
       text AS comment, role = 'system' AS is_internal, turn,
       TIMESTAMP '2024-01-01 00:00:00' + CAST(turn AS INT) * INTERVAL '1' MINUTE AS created_at
FROM conversations""",
    "notifications": """SELECT event_id AS id, user_id, 'Title ' || event_type AS title,
       'expense_' || event_type AS type, CAST(floor(event_id / 6) AS BIGINT) AS related_expense_id,
       event_id % 3 = 0 AS read, CAST(ts AS TIMESTAMP) AS created_at
FROM events""",
    "ocr_queue": """SELECT o_orderkey AS id, o_orderkey AS expense_id,
       'https://files.example.com/receipts/' || o_custkey || '/' || o_orderkey || '.jpg' AS receipt_url,
       CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing'
         WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
       CAST(o_orderkey % 5 AS INT) AS attempts, 3 AS max_attempts,
       CAST(NULL AS {STRING}) AS error_message, CAST(NULL AS TIMESTAMP) AS processed_at,
       CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM orders""",
    "receipts": """SELECT o_orderkey AS expense_id,
       CASE WHEN o_orderkey % 8 = 0 THEN chr(10) || '   ' || chr(10) ELSE '' END ||
       '  Vendor ' || (o_orderkey % 50) || ' ' || chr(10) ||
       CASE o_orderkey % 4 WHEN 0 THEN 'Total: ' WHEN 1 THEN 'Amount: $' WHEN 2 THEN 'R$ ' ELSE 'SUBTOTAL   ' END ||
       CAST(CAST(floor(o_totalprice) AS BIGINT) AS {STRING}) || CASE o_orderkey % 2 WHEN 0 THEN ',' ELSE '.' END ||
       '5' || (o_orderkey % 10) || chr(10) ||
       CASE o_orderkey % 6 WHEN 0 THEN 'Date: ' || CAST(CAST(o_orderdate AS DATE) AS {STRING})
         WHEN 1 THEN 'Data: ' || day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate)
         WHEN 2 THEN month(o_orderdate) || '-' || day(o_orderdate) || '-' || (year(o_orderdate) % 100)
         WHEN 3 THEN 'on ' || day(o_orderdate) || ' ' ||
              CASE month(o_orderdate) % 4 WHEN 0 THEN 'Aug' WHEN 1 THEN 'January' WHEN 2 THEN 'fevereiro' ELSE 'Mar' END
              || ' ' || year(o_orderdate)
         WHEN 4 THEN 'Date 2/' || (28 + o_orderkey % 5) || '/' || year(o_orderdate)
         ELSE 'no day' END AS text
FROM orders""",
}

# which base tables or views a view reads
_NEEDS = {
    "users": ["customer"], "expenses": ["orders"], "actions": ["events", "orders"], "audit_log": ["events"],
    "comments": ["conversations"], "notifications": ["events"], "ocr_queue": ["orders"], "receipts": ["orders"],
}


class Claims:
    """The derived tables as DataFrames: Claims(spark, folder).users and so on. Only
    the tables asked for are opened."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        """A parquet table of the folder; its zone-less timestamps become UTC ones."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: df[c].cast("timestamp") for c in zoneless}) if zoneless else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._known:
            tables = {t: self.base(t) for t in _NEEDS[name]}
            text = VIEWS[name].replace("{STRING}", "STRING")
            for table in tables:
                text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
            # braces of JSON literals are not placeholders
            text = text.replace('\'{"email"', "'{{\"email\"").replace("|| '}'", "|| '}}'")
            self._known[name] = self.spark.sql(text, **tables)
        return self._known[name]


def with_views(sql: str, *names: str) -> str:
    """The query with the named views in front, as DuckDB text."""
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n].replace('{STRING}', 'VARCHAR')}\n)" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"
