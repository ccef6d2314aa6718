"""Receipt files, receipt texts and sample receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendspark import fixed, schema
from spendspark.operators.receipts import price_of
from spendspark.sources import file_heads

RECEIPT_TYPES = ("jpg", "jpeg", "png", "pdf")
AVATAR_TYPES = ("jpg", "jpeg", "png")
# first bytes of the accepted formats
HEAD_BYTES = 4
MAGIC = {"jpg": "FFD8FF", "jpeg": "FFD8FF", "png": "89504E47", "pdf": "25504446"}


def scan_receipts(spark: SparkSession, path: str, max_bytes: int = fixed.RECEIPT_MAX_BYTES,
                  extensions: tuple[str, ...] = RECEIPT_TYPES, check_content: bool = False) -> DataFrame:
    """Files with rejected = why they are refused, null when accepted. The check by
    name and size reads no content; check_content also compares the first bytes of
    the files that pass: HEAD_BYTES of each are read where pyarrow knows the path's scheme, else,
    through Spark, whole files up to max_bytes. Spark leaves empty files out of its listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    type_message = fixed.MSG_FILE_TYPE if "pdf" in extensions else fixed.MSG_AVATAR_TYPE
    bad_type, too_large = ~extension.isin(*extensions), F.col("length") > max_bytes
    described = ["path", "length", "modificationTime", extension.alias("extension")]
    by_name = files.select(*described, F.when(bad_type, type_message).when(too_large, fixed.MSG_FILE_SIZE).alias("rejected"))
    if not check_content:
        return by_name
    # the size limit reaches the scan, so content above it is never read
    passed = files.filter((F.col("length") <= max_bytes) & ~bad_type)
    if file_heads.opens(path):
        passed = file_heads.with_heads(passed.select(*described), HEAD_BYTES)
        start = F.hex("head")
    else:
        passed = passed.select(*described, "content")
        start = F.hex(F.substring("content", 1, HEAD_BYTES))
    looks_right = F.lit(False)
    for name, magic in MAGIC.items():
        looks_right = looks_right | ((F.col("extension") == name) & start.startswith(magic))
    judged = passed.withColumn("rejected", F.when(~looks_right, type_message)).drop("content", "head")
    return by_name.filter(F.col("rejected").isNotNull()).unionByName(judged)


def scan_avatars(spark: SparkSession, path: str, check_content: bool = False) -> DataFrame:
    return scan_receipts(spark, path, fixed.AVATAR_MAX_BYTES, AVATAR_TYPES, check_content)


def scan_receipt_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: file, text (whole)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_sample_receipts(spark: SparkSession, path: str, items: bool = False) -> DataFrame:
    """Receipts of nested, ragged JSON files; items=True gives one row per item with
    its name and price ("name - R$ 25.90")."""
    receipts = spark.read.schema(schema.SAMPLE_RECEIPTS).json(path, multiLine=True).select(
        F.explode("receipts").alias("r")).select("r.*")
    receipts = receipts.withColumns({"amount": F.col("amount").cast(schema.MONEY), "date": F.to_date("date"),
                                     "tax": F.col("tax").cast(schema.MONEY), "total": F.col("total").cast(schema.MONEY)})
    if not items:
        return receipts
    lines = receipts.select("id", F.posexplode_outer("items").alias("item_no", "item"))
    pattern = r"^(.*\S)\s+-\s+R\$\s*(\d[\d.,]*)$"
    return lines.select(
        "id", "item_no",
        F.nullif(F.regexp_extract("item", pattern, 1), F.lit("")).alias("name"),
        price_of(F.nullif(F.regexp_extract("item", pattern, 2), F.lit(""))).cast(schema.MONEY).alias("price"))
