"""Receipt files, texts and sample receipts: rows of a given table written as files, one each, and read back."""

import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from checks.registry import query
from spendspark import fixed
from spendspark.session import checkpoint_dir
from spendspark.sources import receipt_files


def as_files(c, rows, name):
    """Writes each row (file, content) as a file of a new shared folder, in the tasks."""
    folder = f"{checkpoint_dir(c.spark)}/{name}-{uuid.uuid4().hex}"
    place = urlsplit(folder).path

    def run(batches):
        system = fs.LocalFileSystem()
        system.create_dir(place, recursive=True)
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with system.open_output_stream(f"{place}/{file}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("file")], names=["file"])

    rows.mapInArrow(run, "file string").count()
    return folder


# every supplier's file: its kind by the key, its first bytes now and then those of another kind, its size by the name
KINDS = ["jpg", "PNG", "pdf", "gif", "jpeg", "JPG"]
STARTS = {"jpg": "FFD8FFE0", "jpeg": "FFD8FFE1", "png": "89504E47", "pdf": "25504446", "gif": "47494638"}
KIND = "CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
START_OF = "CASE CASE WHEN s_suppkey % 7 = 0 THEN 'gif' ELSE lower(kind) END " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STARTS.items()) + " END"


def supplier_files(c):
    rows = c.base("supplier").withColumn("kind", F.expr(KIND)).select(
        F.concat(F.lit("s"), "s_suppkey", F.lit("."), "kind").alias("file"),
        F.concat(F.unhex(F.expr(START_OF)), F.repeat(F.col("s_name"), (1 + F.col("s_suppkey") % 4).cast("int")).cast("binary")).alias("content"))
    return as_files(c, rows, "receipts")


def judged(limit, kinds, message):
    good = " OR ".join(f"(lower(kind) = '{k}' AND starts_with(start, '{m}'))" for k, m in receipt_files.MAGIC.items())
    return f"""SELECT 's' || s_suppkey || '.' || kind AS file, size AS length,
       CASE WHEN lower(kind) NOT IN ({", ".join(f"'{k}'" for k in kinds)}) THEN '{message}' WHEN size > {limit} THEN '{fixed.MSG_FILE_SIZE}'
            WHEN NOT ({good}) THEN '{message}' END AS rejected
FROM (SELECT *, {START_OF} AS start, 4 + length(s_name) * (1 + s_suppkey % 4) AS size FROM (SELECT *, {KIND} AS kind FROM supplier))"""


def listed(files):
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "rejected")


@query("scan_receipts", judged(70, receipt_files.RECEIPT_TYPES, fixed.MSG_FILE_TYPE), "")
def _(c):
    return listed(receipt_files.scan_receipts(c.spark, supplier_files(c), max_bytes=70, check_content=True))


@query("scan_avatars", judged(fixed.AVATAR_MAX_BYTES, receipt_files.AVATAR_TYPES, fixed.MSG_AVATAR_TYPE), "")
def _(c):
    return listed(receipt_files.scan_avatars(c.spark, supplier_files(c), check_content=True))


@query("scan_receipt_text", """SELECT 's' || s_suppkey || '.txt' AS file, s_name || chr(10) || 'Total: ' || s_acctbal || chr(10) AS text
FROM supplier""", "")
def _(c):
    rows = c.base("supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".txt")).alias("file"), F.concat(
        "s_name", F.lit("\nTotal: "), F.col("s_acctbal").cast("string"), F.lit("\n")).cast("binary").alias("content"))
    return receipt_files.scan_receipt_text(c.spark, as_files(c, rows, "texts"))


def sample_receipts(c):
    """One file per supplier with a receipt for it and, for some, a second one without items."""
    price = F.concat(F.lit("R$ "), F.format_number(F.lit(1.5) * (F.col("s_suppkey") % 50) + 1, 2))
    items = F.array(F.concat("s_name", F.lit(" - "), price), F.lit("no price"))
    receipt = F.struct(F.concat(F.lit("r"), "s_suppkey").alias("id"), F.col("s_name").alias("vendor"), (F.col("s_suppkey") % 90 + 0.5).alias("amount"),
                       F.lit("2025-01-15").alias("date"), items.alias("items"))
    second = F.struct(F.concat(F.lit("q"), "s_suppkey").alias("id"), F.lit(None).cast("string").alias("vendor"), F.lit(7.0).alias("amount"),
                      F.lit("not a date").alias("date"), F.lit(None).cast("array<string>").alias("items"))
    both = F.when(F.col("s_suppkey") % 3 == 0, F.array(receipt, second)).otherwise(F.array(receipt))
    rows = c.base("supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".json")).alias("file"),
                                     F.to_json(F.struct(both.alias("receipts"))).cast("binary").alias("content"))
    return as_files(c, rows, "samples")


@query("sample_receipts", """
SELECT 'r' || s_suppkey AS id, s_name AS vendor, s_suppkey % 90 + 0.5 AS amount FROM supplier
UNION ALL SELECT 'q' || s_suppkey, NULL, 7.0 FROM supplier WHERE s_suppkey % 3 = 0""", "")
def _(c):
    return receipt_files.read_sample_receipts(c.spark, sample_receipts(c)).select("id", "vendor", "amount")


@query("sample_receipt_items", """
SELECT 'r' || s_suppkey AS id, 0 AS item_no, s_name AS name, 1.5 * (s_suppkey % 50) + 1 AS price FROM supplier
UNION ALL SELECT 'r' || s_suppkey, 1, NULL, NULL FROM supplier UNION ALL SELECT 'q' || s_suppkey, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 3 = 0""", "")
def _(c):
    return receipt_files.read_sample_receipts(c.spark, sample_receipts(c), items=True).select("id", "item_no", "name", "price")
