import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from spendspark import fixed
from spendspark.functions import scalars
from spendspark.operators import categorize, reports, views
from spendspark.sources import feedback, receipt_files, tables
from tests import seed


def put(folder, name, content):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(content)


def test_receipt_files_are_judged_by_name_size_and_content(spark, folder):
    put(folder, "a.JPG", b"\xff\xd8\xff\xe0" + b"0" * 10)
    put(folder, "b.png", b"not a picture")
    put(folder, "c.exe", b"MZ")
    put(folder, "d.pdf", b"%PDF-1.7" + b"0" * 50)
    names = lambda df: {r["path"].rsplit("/", 1)[1]: r["rejected"] for r in df.collect()}
    quick = receipt_files.scan_receipts(spark, folder, max_bytes=40)
    assert names(quick) == {"a.JPG": None, "b.png": None, "c.exe": fixed.MSG_FILE_TYPE, "d.pdf": fixed.MSG_FILE_SIZE}
    plan = quick._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert names(receipt_files.scan_receipts(spark, folder, check_content=True)) == {
        "a.JPG": None, "b.png": fixed.MSG_FILE_TYPE, "c.exe": fixed.MSG_FILE_TYPE, "d.pdf": None}
    assert names(receipt_files.scan_avatars(spark, folder))["d.pdf"] == fixed.MSG_AVATAR_TYPE


def test_receipt_texts_are_read_whole(spark, folder):
    put(folder, "one.txt", "Bar\nTOTAL 5,00\n".encode())
    row = receipt_files.scan_receipt_text(spark, folder).first()
    assert (row["file"], row["text"]) == ("one.txt", "Bar\nTOTAL 5,00\n")


def test_ragged_receipts(spark, folder):
    put(folder, "r.json", json.dumps({"receipts": [
        {"id": "r1", "vendor": "Bar", "amount": 45.8, "date": "2025-01-15", "items": ["Soup - R$ 25.90", "odd"]},
        {"id": "r2", "vendor": "Cab", "amount": 9, "from": "A", "total": 9.0}]}, indent=1).encode())
    rows = {r["id"]: r for r in receipt_files.read_sample_receipts(spark, folder).collect()}
    assert str(rows["r1"]["amount"]) == "45.80" and rows["r2"]["from"] == "A" and rows["r2"]["items"] is None
    items = receipt_files.read_sample_receipts(spark, folder, items=True).orderBy("id", "item_no").collect()
    assert [(r["id"], r["name"], None if r["price"] is None else float(r["price"])) for r in items] == [
        ("r1", "Soup", 25.9), ("r1", None, None), ("r2", None, None)]


def test_secrets_are_not_loaded(spark, folder):
    seed.users(spark).withColumn("password_hash", F.lit("x")).write.parquet(folder + "/users")
    loaded = tables.read_table(spark, "users", folder + "/users")
    assert "password_hash" not in loaded.columns and loaded.count() == 5
    assert loaded.schema["created_at"].dataType.typeName() == "timestamp"
    options = tables.jdbc_options("users", "jdbc:x", "2020-01-01", "2025-01-01", 32)
    assert "password_hash" not in options["dbtable"] and options["numPartitions"] == "32"


def test_expenses_by_month(spark, folder):
    path = folder + "/expenses"
    tables.write_table(seed.expenses(spark), path, "expense_month")
    assert any(n.startswith("expense_month=") for n in os.listdir(path))
    assert tables.read_table(spark, "expenses", path).count() == 9


def test_feedback_is_appended(spark, folder):
    expenses = seed.expenses(spark).withColumns({"ml_suggested_category": F.lit("travel"), "ml_confidence": F.lit(0.5)})
    rows, audit = categorize.feedback_rows(expenses, "2024-03-01 00:00:00")
    path = folder + "/feedback"
    feedback.append_feedback(rows, path)
    feedback.append_feedback(rows, path)
    stats = reports.feedback_stats(feedback.read_feedback(spark, path))
    got = {r["actual_category"]: (r["count"], r["mean_confidence"]) for r in stats.collect()}
    assert got == {"meals": (4, 0.5), "software": (2, 0.5)} and audit.count() == 3


def test_csv_report(spark, folder):
    listed = views.expense_list(seed.expenses(spark), seed.users(spark))
    tables.export_csv(listed, folder + "/csv", localized=True)
    back = spark.read.option("header", True).csv(folder + "/csv")
    row = back.filter("id = 'e5'").first()
    assert (row["amount"], row["expense_date"]) == ("R$\u00a0850,00", "22/01/2024")
    assert back.count() == 9 and back.columns == [c for c in tables.REPORT_COLUMNS]


def test_insert_ignore(spark):
    new = seed.table(spark, "users", [dict(id="x1", email="jo@example.com"), dict(id="x2", email="new@example.com"),
                                      dict(id="x3", email="new@example.com")])
    merged = tables.insert_ignore(seed.users(spark), new, "email")
    assert {r["id"] for r in merged.collect()} == {"u1", "u2", "u3", "u4", "u5", "x2"}


def test_scalars(spark):
    df = spark.createDataFrame([("1.234,56", None, 1234567.5), (" -2x", "x", -0.5), ("x", "", 0.0)], "t string, n string, a double")
    rows = df.select(scalars.leading_number(F.col("t")).alias("v"), scalars.display_name(F.col("n"), F.col("n")).alias("d"),
                     scalars.money_text(F.col("a")).alias("m")).collect()
    assert [r["v"] for r in rows] == [1.234, -2.0, None]
    assert [r["d"] for r in rows] == [" ", "x x", " "]
    assert [r["m"] for r in rows] == ["R$ 1.234.567,50", "-R$ 0,50", "R$ 0,00"]


def test_keys(spark):
    df = spark.createDataFrame([("https://h/b/receipts/u1/f.jpg",)], "u string")
    row = df.select(scalars.receipt_key(F.col("u")).alias("a"), scalars.receipt_key(F.col("u"), 2).alias("b")).first()
    assert (row["a"], row["b"]) == ("receipts/u1/f.jpg", "u1/f.jpg")


def test_checkpoint_folder_is_the_cluster_s(spark):
    from spendspark import session

    kept = session.cut(spark.range(5).withColumn("t", F.lit(datetime(2024, 1, 1))))
    assert kept.count() == 5
    files = kept.inputFiles()
    assert files and all(spark.sparkContext.getCheckpointDir().replace("file:", "") in f for f in files)


def test_content_above_the_size_limit_is_not_read(spark, folder):
    os.makedirs(f"{folder}/r")
    for name, data in (("ok.png", b"\x89PNG123"), ("fake.png", b"GIF8123"), ("big.pdf", b"%PDF" + b"x" * 5000), ("note.txt", b"hi")):
        put(f"{folder}/r", name, data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        found = {r["path"].rsplit("/", 1)[1]: r["rejected"] for r in receipt_files.scan_receipts(
            spark, f"{folder}/r", max_bytes=1000, check_content=True).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == {"ok.png": None, "fake.png": fixed.MSG_FILE_TYPE, "big.pdf": fixed.MSG_FILE_SIZE, "note.txt": fixed.MSG_FILE_TYPE}


def test_the_shared_folder_must_be_named():
    from unittest.mock import MagicMock

    import pytest

    from spendspark.session import checkpoint_dir

    session = MagicMock()
    session.sparkContext.getCheckpointDir.return_value = None
    session.conf.get.return_value = None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)


def test_cuts_can_be_removed(spark):
    from spendspark.session import cut, cuts_so_far, remove_cuts

    first = cuts_so_far(spark)
    kept = cut(spark.range(3).toDF("x"))
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert kept.count() == 3 and os.path.isdir(path)
    remove_cuts(spark, first)
    assert not os.path.isdir(path)



def test_only_first_bytes_are_read(spark, folder, monkeypatch):
    from spendspark.sources import file_heads

    put(folder, "a%20b#c.png", bytes.fromhex("89504E47"))
    put(folder, "a b%.png", bytes.fromhex("89504E47") + b"0" * 1_000_000)
    put(folder, "short.png", b"\x89P")
    names = lambda df: {r["path"].rsplit("/", 1)[1]: r["rejected"] for r in df.collect()}
    scan = receipt_files.scan_receipts(spark, folder, check_content=True)
    assert "content" not in scan._jdf.queryExecution().executedPlan().toString()
    by_heads = names(scan)
    assert file_heads.opens("s3a://bucket/x") and file_heads.opens("/x") and not file_heads.opens("wasb://c@a/x")
    monkeypatch.setattr(file_heads, "opens", lambda path: False)  # as for a scheme that only Spark knows
    assert by_heads == names(receipt_files.scan_receipts(spark, folder, check_content=True))
    assert by_heads == {"a b%.png": None, "a%20b#c.png": None, "short.png": fixed.MSG_FILE_TYPE}
    assert file_heads.first_bytes(f"file:{folder}/a b%.png", 4, {}) == bytes.fromhex("89504E47")
