"""Receipt extraction and OCR write-back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import at, query
from spendspark.functions import sql
from spendspark.operators import mutations, receipts, reports
from spendspark.plans.fixtures import AS_OF

VENDOR = r"nullif(trim(regexp_extract(text, '^\s*(\S[^\n]*)', 1)), '')"
AMOUNT = r"""TRY_CAST(replace(coalesce(
    nullif(regexp_extract(text, '(?i)total[:\s]*[$]?(\d+[.,]\d{2})', 1), ''),
    nullif(regexp_extract(text, '(?i)amount[:\s]*[$]?(\d+[.,]\d{2})', 1), ''),
    nullif(regexp_extract(text, '(?i)[$]?(\d+[.,]\d{2})\s*total', 1), ''),
    nullif(regexp_extract(text, '(?m)[$]?(\d+[.,]\d{2})$', 1), '')), ',', '.') AS DOUBLE)"""


def composed(y, m, d):
    """Date from numbers with roll-over past the month's end, as text."""
    return (f"CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN CAST(CAST(make_date("
            f"CASE WHEN {y} < 50 THEN {y} + 2000 WHEN {y} < 100 THEN {y} + 1900 ELSE {y} END, {m}, 1) "
            f"+ CAST({d} - 1 AS INT) AS DATE) AS VARCHAR) END")


def numbers(pattern):
    return [f"TRY_CAST(nullif(regexp_extract(text, '{pattern}', {g}), '') AS BIGINT)" for g in (1, 2, 3)]


MONTHS = ("CASE lower(substr(w, 1, 3)) " + " ".join(
    f"WHEN '{m}' THEN {i}" for i, m in enumerate(
        ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"], 1)) + " END")
P1, P2 = (numbers(r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})"), numbers(r"(\d{2,4})[/\-](\d{1,2})[/\-](\d{1,2})"))
P3 = r"(\d{1,2})\s+(\w+)\s+(\d{2,4})"
READ = f"""read AS (SELECT expense_id, {VENDOR} AS vendor, {AMOUNT} AS amount,
    {P1[0]} AS a1, {P1[1]} AS a2, {P1[2]} AS a3, {P2[0]} AS b1, {P2[1]} AS b2, {P2[2]} AS b3,
    TRY_CAST(nullif(regexp_extract(text, '{P3}', 1), '') AS BIGINT) AS c1,
    regexp_extract(text, '{P3}', 2) AS w,
    TRY_CAST(nullif(regexp_extract(text, '{P3}', 3), '') AS BIGINT) AS c3 FROM receipts)"""
DAY = f"""coalesce(
    CASE WHEN a1 BETWEEN 1 AND 31 THEN {composed('a3', 'a1', 'a2')} ELSE {composed('a1', 'a2', 'a3')} END,
    CASE WHEN b1 BETWEEN 1 AND 31 THEN {composed('b3', 'b1', 'b2')} ELSE {composed('b1', 'b2', 'b3')} END,
    CASE WHEN c1 BETWEEN 1 AND 31 THEN {composed('c3', MONTHS, 'c1')} END)"""


@query("extract_receipt", f"WITH {READ} SELECT expense_id, vendor, amount, {DAY} AS date FROM read", "receipts")
def _(c):
    parsed = receipts.extract_receipt(c.receipts)
    return parsed.select("expense_id", "parsed.vendor", "parsed.amount", "parsed.date")


@query("extract_vendor", f"SELECT expense_id, {VENDOR} AS vendor FROM receipts", "receipts")
def _(c):
    return c.receipts.select("expense_id", receipts.vendor_of(F.col("text")).alias("vendor"))


@query("extract_amount", f"SELECT expense_id, {AMOUNT} AS amount FROM receipts", "receipts")
def _(c):
    return c.receipts.select("expense_id", receipts.amount_of(F.col("text")).alias("amount"))


@query("extract_date", f"WITH {READ} SELECT expense_id, {DAY} AS date FROM read", "receipts")
def _(c):
    return c.receipts.select("expense_id", receipts.date_of(F.col("text")).alias("date"))


@query("extract_receipt_local", r"""
WITH read AS (SELECT expense_id, trim(regexp_extract(text, '(?m)^([^\n]*[A-Za-z][^\n]*)$', 1)) AS vendor,
    coalesce(nullif(regexp_extract(text, '(?im)^total: (\d+[.,]\d\d)$', 1), ''),
             nullif(regexp_extract(text, '(?im)^subtotal +(\d+[.,]\d\d)$', 1), ''),
             nullif(regexp_extract(text, '(?m)^R\$ (\d+[.,]\d\d)$', 1), ''),
             nullif(regexp_extract(text, '(?im)^amount: \$(\d+[.,]\d\d)$', 1), '')) AS price,
    TRY_CAST(nullif(regexp_extract(text, '(\d{4})-(\d\d)-(\d\d)', 1), '') AS BIGINT) AS y,
    TRY_CAST(nullif(regexp_extract(text, '(\d{4})-(\d\d)-(\d\d)', 2), '') AS BIGINT) AS m,
    TRY_CAST(nullif(regexp_extract(text, '(\d{4})-(\d\d)-(\d\d)', 3), '') AS BIGINT) AS d,
    TRY_CAST(nullif(regexp_extract(text, '\b(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})\b', 1), '') AS BIGINT) AS d2,
    TRY_CAST(nullif(regexp_extract(text, '\b(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})\b', 2), '') AS BIGINT) AS m2,
    TRY_CAST(nullif(regexp_extract(text, '\b(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})\b', 3), '') AS BIGINT) AS y2
  FROM receipts)
SELECT expense_id, vendor, TRY_CAST(replace(price, ',', '.') AS DOUBLE) AS amount,
       coalesce(""" + composed("y", "m", "d") + ", " + composed("y2", "m2", "d2") + ") AS date FROM read", "receipts")
def _(c):
    parsed = receipts.extract_receipt(c.receipts, "locale")
    return parsed.select("expense_id", "parsed.vendor", "parsed.amount", "parsed.date")


@query("sql_extract_receipt", f"WITH {READ} SELECT expense_id, vendor, amount, {DAY} AS date FROM read", "receipts")
def _(c):
    """The fields by the function of Spark's SQL."""
    sql.register(c.spark)
    parsed = c.spark.sql("SELECT expense_id, receipt_fields(text, NULL) AS parsed FROM {receipts}", receipts=c.receipts)
    return parsed.select("expense_id", "parsed.vendor", "parsed.amount", "parsed.date")


def itemised(c):
    """A receipt per order: a line per line item, and its total among the pairs."""
    line = F.concat(F.lit("  Part "), "l_partkey", F.lit(" no. "), "l_linenumber", F.lit("   "), F.col("l_quantity").cast("int"), F.lit("  R$ "),
                    F.floor("l_extendedprice").cast("string"), F.lit(",50"))
    rows = c.base("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.count(F.lit(1)).alias("n"))
    text = F.concat_ws("\n", F.lit("Store"), F.array_join("lines", "\n"), F.concat(F.lit("SUBTOTAL R$ 1,00\nTOTAL R$ "), "n", F.lit(",75")))
    return rows.select(F.col("l_orderkey").alias("expense_id"), text.alias("text"), F.create_map(
        F.lit("total items"), F.lit("none"), F.lit("amount due"), F.concat(F.lit("R$ "), "n", F.lit(",25"))).alias("kv"))


@query("extract_receipt_items", """
SELECT l_orderkey AS expense_id, 'Part ' || l_partkey || ' no. ' || l_linenumber AS name, CAST(l_quantity AS INT) AS qty,
       floor(l_extendedprice) + 0.5 AS price FROM lineitem""", "")
def _(c):
    return receipts.extract_receipt(itemised(c), "locale").select("expense_id", F.explode("parsed.items").alias("i")).select("expense_id", "i.*")


@query("extract_receipt_totals", """
SELECT l_orderkey AS expense_id, 'Store' AS vendor, count(*) + 0.75 AS amount, count(*) + 0.25 AS total, CAST(count(*) AS INT) AS n_items,
       0 AS n_items_reference FROM lineitem GROUP BY l_orderkey""", "")
def _(c):
    both = receipts.extract_receipt(itemised(c), "locale").withColumnRenamed("parsed", "local")
    return receipts.extract_receipt(both).select(
        "expense_id", "local.vendor", "local.amount", "parsed.total", F.size("local.items").alias("n_items"),
        F.size("parsed.items").alias("n_items_reference"))


# --- OCR blocks made from line items: per line one LINE, one KEY, one VALUE block and their words --------


def numbered(c):
    # by the receipt's name, so that what groups by it needn't deal the blocks out again
    order = Window.partitionBy("receipt_key").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                                                      "l_returnflag")
    return c.base("lineitem").withColumn("receipt_key", F.col("l_orderkey").cast("string")).select(
        "receipt_key", F.row_number().over(order).alias("n"),
        F.col("l_quantity").cast("int").alias("qty"), F.floor("l_extendedprice").cast("string").alias("price"),
        F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))


def blocks(c):
    def ref(prefix):
        return F.concat(F.lit(prefix), F.col("n").cast("string"))

    def relation(kind, *ids):
        return F.struct(F.lit(kind).alias("Type"), F.array(*ids).alias("Ids"))

    def block(offset, block_id, kind, text=None, confidence=None, entity=None, relations=()):
        related = F.array(*relations) if relations else F.lit(None).cast("array<struct<Type:string,Ids:array<string>>>")
        return F.struct(
            (F.col("n") * 10 + offset).cast("int").alias("pos"), block_id.alias("Id"), F.lit(kind).alias("BlockType"),
            (F.lit(None).cast("string") if text is None else text).alias("Text"),
            (F.lit(None).cast("double") if confidence is None else confidence).alias("Confidence"),
            (F.array(F.lit(entity)) if entity else F.lit(None).cast("array<string>")).alias("EntityTypes"),
            related.alias("Relationships"))

    confidence = F.when(F.col("line") != 3, (F.lit(90) + F.col("line")).cast("double"))
    parts = F.array(
        block(0, ref("l"), "LINE", F.concat(F.lit("Qty "), F.col("qty").cast("string")), confidence),
        block(1, ref("k"), "KEY_VALUE_SET", entity="KEY", relations=[
            relation("VALUE", ref("v"), F.lit("nowhere")), relation("CHILD", ref("w"), F.lit("lost"), ref("f"))]),
        block(2, ref("v"), "KEY_VALUE_SET", entity="VALUE", relations=[relation("CHILD", ref("p"))]),
        block(3, ref("w"), "WORD", F.lit("Total")), block(4, ref("f"), "WORD", F.col("flag")),
        block(5, ref("p"), "WORD", F.concat(F.lit("R$ "), F.col("price"), F.lit(",50"))))
    return numbered(c).select("receipt_key", F.explode(parts).alias("b")).select("receipt_key", "b.*")


NUMBERED = """numbered AS (SELECT CAST(l_orderkey AS VARCHAR) AS receipt_key, CAST(l_quantity AS INT) AS qty,
    CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS price, l_returnflag AS flag, l_linenumber AS line,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                       l_returnflag) AS n FROM lineitem)"""


@query("blocks_to_text", f"""WITH {NUMBERED}
SELECT receipt_key, string_agg('Qty ' || qty, chr(10) ORDER BY n) AS text FROM numbered GROUP BY receipt_key""", "")
def _(c):
    return receipts.blocks_to_text(blocks(c))


@query("blocks_to_text_long", """
WITH lines AS (SELECT CAST(l_orderkey % 3 AS VARCHAR) AS receipt_key, l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS qty FROM lineitem)
SELECT receipt_key, md5(string_agg('Qty ' || qty, chr(10) ORDER BY l_orderkey, l_linenumber, qty)) AS text, count(*) AS n_lines
FROM lines GROUP BY receipt_key""", "")
def _(c):
    """Three receipts that hold a third of all lines each."""
    place = F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int"))
    lines = c.base("lineitem").select(
        F.pmod("l_orderkey", F.lit(3)).cast("string").alias("receipt_key"), place.alias("pos"), F.lit("LINE").alias("BlockType"),
        F.concat(F.lit("Qty "), F.col("l_quantity").cast("int").cast("string")).alias("Text"))
    text = receipts.blocks_to_text(lines, long=True)
    # breaks are counted without making a string of every line
    breaks = F.length("text") - F.length(F.translate("text", "\n", ""))
    return text.select("receipt_key", F.md5("text").alias("text"), (breaks + 1).cast("long").alias("n_lines"))


DATES = ["01/20/2025", "2025-01-20T23:00:00-05:00", "01/20/2025 abc", "20 Jan 2025", "Jan 31, 2025 11:30 PM", "2025-01-01 00:30+02:00",
         "2025-02-30x", "31/12/2024 10:00"]


@query("date_overrides", """
SELECT CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS receipt_key, 7.5 AS total, min(CASE (l_orderkey + l_linenumber) % 8
    WHEN 0 THEN '2025-01-20' WHEN 1 THEN '2025-01-21' WHEN 3 THEN '2025-01-20' WHEN 4 THEN '2025-01-31' WHEN 5 THEN '2024-12-31'
    END) AS date FROM lineitem GROUP BY l_orderkey, l_linenumber""", "")
def _(c):
    """Dates with times, zones and what follows them."""
    kind = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8)).cast("int")
    lines = c.base("lineitem").select("l_orderkey", "l_linenumber").distinct()
    pairs = lines.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("receipt_key"),
        F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("total").alias("key"), F.lit("7,50").alias("value")),
                          F.struct(F.lit(2).alias("pos"), F.lit("date").alias("key"),
                                   F.element_at(F.array(*[F.lit(d) for d in DATES]), kind + 1).alias("value")))).alias("p")).select("receipt_key", "p.*")
    return receipts.pair_overrides(pairs)


PAIRS = f"""{NUMBERED}, pairs AS (SELECT receipt_key, 'total ' || lower(flag) AS key, min(n * 10 + 1) AS pos,
    'R$ ' || max_by(price, n) || ',50' AS value FROM numbered GROUP BY receipt_key, flag)"""


@query("blocks_to_kv", f"""WITH {PAIRS}
SELECT receipt_key, string_agg(key || '=' || value, '; ' ORDER BY pos) AS kv FROM pairs GROUP BY receipt_key""", "")
def _(c):
    kv = receipts.blocks_to_kv(blocks(c))
    shown = F.transform(F.map_entries("kv"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return kv.select("receipt_key", F.array_join(shown, "; ").alias("kv"))


@query("kv_overrides", f"""WITH {PAIRS}
SELECT receipt_key, CAST(replace(replace(max_by(value, pos), 'R$ ', ''), ',', '.') AS DOUBLE) AS total
FROM pairs GROUP BY receipt_key""", "")
def _(c):
    return receipts.blocks_to_kv(blocks(c)).select("receipt_key", receipts.total_from_kv(F.col("kv")).alias("total"))


@query("pair_overrides", f"""WITH {PAIRS}
SELECT receipt_key, CAST(replace(replace(max_by(value, pos), 'R$ ', ''), ',', '.') AS DOUBLE) AS total,
       CAST(NULL AS VARCHAR) AS date FROM pairs GROUP BY receipt_key""", "")
def _(c):
    return receipts.pair_overrides(receipts.blocks_to_pairs(blocks(c)))


@query("ocr_confidence", f"""WITH {NUMBERED}
SELECT receipt_key, round(coalesce(avg(CASE WHEN line <> 3 THEN CAST(90 + line AS DOUBLE) END), 0) / 100, 9) AS confidence
FROM numbered GROUP BY receipt_key""", "")
def _(c):
    return reports.ocr_confidence(blocks(c)).withColumn("confidence", F.round("confidence", 9))


# --- write-back -----------------------------------------------------------------------------------


def ocr_results(c):
    parsed = receipts.extract_receipt(c.receipts.withColumn("kv", F.lit(None).cast("map<string,string>")))
    return parsed.select(
        "expense_id", F.col("text").alias("full_text"), "kv",
        (F.pmod(F.col("expense_id"), F.lit(40)) / 40).alias("confidence"), "parsed",
        F.when(F.col("parsed.date").isNull(), "no date").alias("error"))


OUTCOME = f"""WITH {READ}, outcome AS (SELECT expense_id, amount, {DAY} AS date FROM read)"""


@query("apply_ocr_results", f"""{OUTCOME}
SELECT e.id, CASE WHEN o.date IS NULL THEN 'failed' ELSE 'completed' END AS ocr_status, q.attempts + CASE WHEN o.date IS NULL
       THEN 1 ELSE 0 END AS attempts, CASE WHEN o.date IS NULL THEN 'no date' END AS error_message,
       CASE WHEN o.date IS NOT NULL THEN o.amount END AS stored_amount, '2001-08-02 00:00:00' AS processed_at
FROM expenses e JOIN ocr_queue q ON q.expense_id = e.id JOIN outcome o ON o.expense_id = e.id""",
       "receipts expenses ocr_queue")
def _(c):
    new_expenses, new_queue, _audit = receipts.apply_ocr_results(c.expenses, c.ocr_queue, ocr_results(c), AS_OF)
    stored = F.get_json_object("ocr_data", "$.parsed.amount").cast("double").alias("stored_amount")
    queue = new_queue.select("expense_id", "attempts", "error_message", "processed_at")
    return new_expenses.select("id", "ocr_status", stored).join(queue, F.col("id") == F.col("expense_id")).drop("expense_id")


@query("apply_ocr_results_twice", f"""{OUTCOME}
SELECT e.id, CASE WHEN o.date IS NULL THEN 'failed' ELSE 'completed' END AS ocr_status, q.attempts + CASE WHEN o.date IS NULL
       THEN 1 ELSE 0 END AS attempts, CASE WHEN o.date IS NOT NULL THEN 1 ELSE 0 END AS audit_rows
FROM expenses e JOIN ocr_queue q ON q.expense_id = e.id JOIN outcome o ON o.expense_id = e.id""",
       "receipts expenses ocr_queue")
def _(c):
    """Every result delivered twice: nothing multiplies."""
    results = ocr_results(c)
    new_expenses, new_queue, audit = receipts.apply_ocr_results(c.expenses, c.ocr_queue, results.union(results), AS_OF)
    logged = audit.groupBy(F.col("expense_id").alias("a_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    queue = new_queue.select("expense_id", "attempts")
    return new_expenses.join(queue, F.col("id") == F.col("expense_id")).join(logged, F.col("id") == F.col("a_id"), "left").select(
        "id", "ocr_status", "attempts", F.coalesce("n", F.lit(0)).alias("audit_rows"))


@query("ocr_audit", f"""{OUTCOME}
SELECT e.id AS expense_id, e.user_id,
       concat('OCR processing completed with ', printf('%.1f', (e.id % 40) / 40.0 * 100), '% confidence') AS notes
FROM expenses e JOIN outcome o ON o.expense_id = e.id WHERE o.date IS NOT NULL""", "receipts expenses")
def _(c):
    audit = receipts.apply_ocr_results(c.expenses, c.ocr_queue, ocr_results(c), AS_OF)[2]
    return audit.select("expense_id", "user_id", "notes")


@query("retry_failed", f"""{OUTCOME}
SELECT q.id, q.attempts, CASE WHEN q.status = 'failed' AND q.attempts < 3
                      AND q.created_at > TIMESTAMP '{AS_OF}' - INTERVAL '240' HOUR THEN 'completed' ELSE q.status END AS status
FROM ocr_queue q""", "receipts ocr_queue")
def _(c):
    texts = c.receipts.select("expense_id", F.col("text").alias("full_text"),
                              F.lit(None).cast("map<string,string>").alias("kv"), F.lit(0.9).alias("confidence"))
    queue = receipts.retry_failed(c.expenses, c.ocr_queue, texts, AS_OF, None, 240)[1]
    return queue.select("id", "attempts", "status")


@query("autofill_expenses", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'Shop ' || id ELSE vendor END AS vendor,
       CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN id + 0.5 ELSE CAST(amount AS DOUBLE) END AS amount,
       CASE WHEN id % 5 = 0 THEN '2001-02-03' ELSE CAST(expense_date AS VARCHAR) END AS expense_date,
       coalesce(ml_suggested_category, category) AS category FROM expenses""")
def _(c):
    forms = c.expenses.select(
        "id", "vendor", "amount", "expense_date", "category", F.col("ml_suggested_category").alias("suggested_category"),
        F.create_map(
            F.lit("vendor"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("Shop "), F.col("id").cast("string"))),
            F.lit("amount"), F.when(F.col("id") % 4 == 0, "n/a").when(F.col("id") % 4 == 1, F.concat(F.col("id").cast("string"), F.lit(".5"))),
            F.lit("date"), F.when(F.col("id") % 5 == 0, "2001-02-03")).alias("ocr"))
    return receipts.autofill_expenses(forms).select("id", "vendor", "amount", "expense_date", "category")


@query("upsert_ocr_queue", f"""
WITH wishes AS (SELECT expense_id, max_by(receipt_url, action_id) AS url, max(ts) AS ts FROM actions
                WHERE receipt_url IS NOT NULL GROUP BY expense_id)
SELECT coalesce(q.expense_id, w.expense_id) AS expense_id, coalesce(w.url, q.receipt_url) AS receipt_url,
       CASE WHEN w.url IS NULL THEN q.status ELSE 'pending' END AS status,
       CASE WHEN w.url IS NULL THEN q.attempts ELSE 0 END AS attempts,
       {at('coalesce(w.ts, q.created_at)')} AS created_at
FROM ocr_queue q FULL JOIN wishes w ON q.expense_id = w.expense_id""", "actions ocr_queue")
def _(c):
    wishes = c.actions.filter("receipt_url IS NOT NULL").select("expense_id", "receipt_url", F.col("ts").alias("created_at"))
    return mutations.upsert_ocr_queue(c.ocr_queue, wishes).select(
        "expense_id", "receipt_url", "status", "attempts", "created_at")
