from datetime import date

import pytest
from pyspark.sql import functions as F

from spendspark import schema
from spendspark.operators import receipts
from tests import seed

RULE = "=" * 30
LUNCH = "\n".join([RULE, "      CANTINA DO BAIRRO", RULE, "Rua Alta, 12", "Data: 15/01/2025", RULE,
                   "Prato Feito            1      R$ 25,90", "Suco                   2      R$  8,50", "-" * 30,
                   "SUBTOTAL:                  R$ 45,80", "IMPOSTOS:                  R$  4,58", RULE,
                   "TOTAL:                     R$ 50,38", "Obrigado!", ""])
RIDE = "\n".join([RULE, "     TAXI", RULE, "Data: 16/01/2025", "DIST: 8.5 km", "TARIFA BASE:       R$ 8,50",
                  "SUBTOTAL:          R$ 32,50", RULE])
PLAIN = "\n".join(["PLAIN RECEIPT", "=====", "Vendor: Shop", "Amount: R$ 25.00", "Date: 2025-01-20", "====="])


def fields(spark, text, kv=None, mode="reference"):
    df = spark.createDataFrame([(text, kv)], "text string, kv map<string,string>")
    return receipts.extract_receipt(df, mode).first()["parsed"]


@pytest.mark.parametrize("text, vendor, amount, day", [
    (LUNCH, RULE, 25.90, None), (RIDE, RULE, 8.50, None), (PLAIN, "PLAIN RECEIPT", 25.00, date(2025, 1, 20)),
    ("\n \n  Bar \nGrand total: 12,34\n", "Bar", 12.34, None), ("no price", "no price", None, None), ("", None, None, None)])
def test_historic_reading(spark, text, vendor, amount, day):
    got = fields(spark, text)
    assert (got["vendor"], got["amount"], got["date"], got["items"], got["total"]) == (vendor, amount, day, [], None)


@pytest.mark.parametrize("text, vendor, amount, day", [
    (LUNCH, "CANTINA DO BAIRRO", 50.38, date(2025, 1, 15)), (RIDE, "TAXI", 32.50, date(2025, 1, 16)),
    (PLAIN, "PLAIN RECEIPT", 25.00, date(2025, 1, 20)), ("Loja\nTOTAL R$ 1.234,56", "Loja", 1234.56, None)])
def test_local_reading(spark, text, vendor, amount, day):
    got = fields(spark, text, mode="locale")
    assert (got["vendor"], got["amount"], got["date"]) == (vendor, amount, day)


def test_items_of_the_local_reading(spark):
    got = fields(spark, LUNCH, mode="locale")["items"]
    assert [(i["name"], i["qty"], i["price"]) for i in got] == [("Prato Feito", 1, 25.9), ("Suco", 2, 8.5)]


@pytest.mark.parametrize("text, day", [
    ("01/02/2025", date(2025, 1, 2)), ("15/01/2025", None), ("2/30/2025", date(2025, 3, 2)), ("3-4-49", date(2049, 3, 4)),
    ("3-4-50", date(1950, 3, 4)), ("2025-01-20", date(2025, 1, 20)), ("2025/13/01", None), ("20 Jan 2025", date(2025, 1, 20)),
    ("20 fevereiro 2025", None), ("10 05 2025", date(2025, 10, 5)), ("45/10/20", date(2045, 10, 20)), ("on 7 May 24 x", date(2024, 5, 7)),
    ("15/01/2025 then 2025-01-20", None), ("25 then, 2025-01-20", date(2025, 1, 20)), ("nothing", None)])
def test_dates(spark, text, day):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(receipts.date_of(F.col("text"))).first()[0] == day


def test_pairs_override(spark):
    kv = {"total due": "R$ 1.2", "sub total": "12,50 BRL", "amount": "n/a", "date": "2025-02-03", "time": "12:30"}
    got = fields(spark, PLAIN, kv)
    assert (got["amount"], got["total"], got["date"]) == (25.0, 12.5, date(2025, 2, 3))


def blocks(spark, rows):
    return spark.createDataFrame(
        [("r", i, *r) for i, r in enumerate(rows)], schema.BLOCKS)


def test_blocks(spark):
    def related(**kinds):
        return [(k, v) for k, v in kinds.items()]

    df = blocks(spark, [
        ("l1", "LINE", "First", 90.0, None, None), ("l2", "LINE", "Second", None, None, None),
        ("k1", "KEY_VALUE_SET", None, 80.0, ["KEY"], related(VALUE=["v1", "gone"], CHILD=["w1", "w2"])),
        ("w1", "WORD", "Total", 99.0, None, None), ("w2", "WORD", "Due", 99.0, None, None),
        ("v1", "KEY_VALUE_SET", None, 80.0, ["VALUE"], related(CHILD=["w3", "w4"])),
        ("w3", "WORD", "12,50", 99.0, None, None), ("w4", "WORD", None, 99.0, None, None),
        ("k2", "KEY_VALUE_SET", "DATE", 80.0, ["KEY"], related(VALUE=["v2"], CHILD=["w1"])),
        ("v2", "KEY_VALUE_SET", "2025-01-20", 80.0, ["VALUE"], None),
        ("k3", "KEY_VALUE_SET", "date", 80.0, ["KEY"], related(VALUE=["v3"])),
        ("v3", "KEY_VALUE_SET", "2025-01-21", 80.0, ["VALUE"], None),
        ("k4", "KEY_VALUE_SET", "Empty", 80.0, ["KEY"], related(VALUE=["v4"])),
        ("v4", "KEY_VALUE_SET", None, 80.0, ["VALUE"], None),
    ])
    text = receipts.blocks_to_text(df).first()
    assert text["text"] == "First\nSecond"
    assert receipts.blocks_to_kv(df).first()["kv"] == {"total due": "12,50", "date": "2025-01-21"}
    row = receipts.pair_overrides(receipts.blocks_to_pairs(df)).first()
    assert (row["total"], row["date"]) == (12.5, date(2025, 1, 21))


def test_results_reach_expense_queue_and_log(spark):
    expenses = seed.expenses(spark)
    queue = seed.table(spark, "ocr_queue", [
        dict(id="q1", expense_id="e1", receipt_url="u", status="pending", attempts=0, max_attempts=3),
        dict(id="q2", expense_id="e2", receipt_url="u", status="pending", attempts=1, max_attempts=3)])
    results = receipts.extract_receipt(spark.createDataFrame(
        [("e1", PLAIN, {"total": "9"}, 0.8731, None), ("e2", None, None, None, "no file")],
        "expense_id string, full_text string, kv map<string,string>, confidence double, error string"), text="full_text")
    new_expenses, new_queue, audit = receipts.apply_ocr_results(expenses, queue, results, "2024-03-01 00:00:00")
    status = seed.as_dict(new_expenses, "id", "ocr_status")
    assert (status["e1"], status["e2"], status["e3"]) == ("completed", "failed", None)
    rows = {r["id"]: r for r in new_queue.collect()}
    assert (rows["q1"]["status"], rows["q1"]["attempts"]) == ("completed", 0)
    assert (rows["q2"]["status"], rows["q2"]["attempts"], rows["q2"]["error_message"]) == ("failed", 2, "no file")
    assert [r["notes"] for r in audit.collect()] == ["OCR processing completed with 87.3% confidence"]
    stored = new_expenses.filter("id = 'e1'").select(F.get_json_object("ocr_data", "$.parsed.total")).first()[0]
    assert float(stored) == 9.0


def test_repeated_results_count_once(spark):
    expenses = seed.expenses(spark)
    queue = seed.table(spark, "ocr_queue", [dict(id="q1", expense_id="e1", receipt_url="u", status="pending", attempts=0, max_attempts=3)])
    raw = spark.createDataFrame(
        [("e1", None, None, None, "lost", 1), ("e1", PLAIN, {"total": "9"}, 0.5, None, 2), ("e1", PLAIN, {"total": "9"}, 0.5, None, 2),
         ("e1", None, None, None, "late failure", 3)],
        "expense_id string, full_text string, kv map<string,string>, confidence double, error string, at int")
    results = receipts.extract_receipt(raw, text="full_text")
    for latest, status in ((None, "completed"), ("at", "failed")):
        new_expenses, new_queue, audit = receipts.apply_ocr_results(expenses, queue, results, "2024-03-01 00:00:00", latest)
        assert new_expenses.count() == expenses.count() and new_queue.count() == 1
        assert seed.as_dict(new_expenses, "id", "ocr_status")["e1"] == status
        assert audit.count() == (status == "completed")


def test_dates_with_times_and_zones(spark):
    texts = {"01/20/2025": "2025-01-20", "01/20/2025 abc": None, "2025-01-20T23:00:00-05:00": "2025-01-21", "2025-01-20T23:00:00Z": "2025-01-20",
             "Jan 1, 2025 12:30 AM +0100": "2024-12-31", "20 Jan 2025 11:30 PM": "2025-01-20", "2025-01-20T": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", receipts.date_from(F.col("t")).cast("string").alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == texts


def many_blocks(spark, n):
    """A receipt of n lines with a key of two words, every tenth key once more, and its value."""
    rows = []
    for i in range(n):
        rows += [(f"k{i}", "KEY_VALUE_SET", None, None, ["KEY"], [("VALUE", [f"v{i}", "gone"]), ("CHILD", [f"w{i}", "lost", "no"])]),
                 (f"v{i}", "KEY_VALUE_SET", None, None, ["VALUE"], [("CHILD", [f"p{i}"])]),
                 (f"w{i}", "WORD", f"Total {i - i % 10 if i % 10 == 9 else i}", None, None, None), (f"p{i}", "WORD", f"{i},50", None, None, None)]
    return blocks(spark, [("no", "WORD", "No", None, None, None), *rows])


def test_receipt_of_many_blocks(spark):
    df = many_blocks(spark, 400)
    expected = {}
    for i in range(400):
        expected[f"total {i - i % 10 if i % 10 == 9 else i} no"] = f"{i},50"
    found = receipts.blocks_to_kv(df).select("kv", F.map_keys("kv").alias("keys")).first()
    assert found["kv"] == expected and found["keys"] == list(expected)
    assert {r["key"]: r["value"] for r in receipts.blocks_to_pairs(df).collect()} == expected
    assert receipts.pair_overrides(receipts.blocks_to_pairs(df)).first()["total"] == 398.5  # key 399 has the place of key 390


def test_blocks_are_dealt_out_once(spark):
    df = many_blocks(spark, 3)
    for found in (receipts.blocks_to_kv(df), receipts.pair_overrides(receipts.blocks_to_pairs(df))):
        plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_receipts_without_a_name_or_pairs(spark):
    nameless = blocks(spark, [("k1", "KEY_VALUE_SET", "Total", None, ["KEY"], [("VALUE", ["v1"])]), ("v1", "KEY_VALUE_SET", "1", None, ["VALUE"], None)])
    df = nameless.withColumn("receipt_key", F.lit(None).cast("string")).union(
        blocks(spark, [("k1", "KEY_VALUE_SET", "Total", None, ["KEY"], [("VALUE", ["gone"])]), ("w", "WORD", "Word", None, None, None)]))
    assert receipts.blocks_to_kv(df).count() == 0 and receipts.blocks_to_pairs(df).count() == 0
    assert sorted(r["block_text"] for r in receipts.block_texts(df).collect()) == ["1", "Total", "Total"]


def test_long_texts_are_joined_by_ranges(spark):
    """The same text in both forms: places of several fields, ties, nulls, other blocks, a receipt without a name."""
    rows = [(None if i % 7 == 0 else str(i % 3), (i * 37 % 500 // 2, i % 2), "LINE" if i % 11 else "WORD", None if i % 13 == 0 else f"Qty {i}\n" if i % 17 == 0
             else f"Qty {i}") for i in range(2000)]
    blocks = spark.createDataFrame(rows, "receipt_key string, pos struct<a:int,b:int>, BlockType string, Text string").repartition(5)
    wanted = {r.receipt_key: r.text for r in receipts.blocks_to_text(blocks).collect()}
    got = receipts.blocks_to_text(blocks, long=True)
    assert {r.receipt_key: r.text for r in got.collect()} == wanted
    assert len(wanted) == 4
    # lines are dealt out by their place, so that no task has to hold a whole receipt's lines
    assert "rangepartitioning(receipt_key" in got._jdf.queryExecution().toString().replace(" ", "")
    assert receipts.blocks_to_text(blocks.limit(0), long=True).collect() == []


def test_readers_meet_a_match_not_the_whole_text(spark):
    """A date's readers use what was found many times; the receipt is searched once per pattern."""
    df = spark.createDataFrame([("Shop\n20 Jan 2025\nTotal: 12,50\n  Pen   2  R$ 3,50\n",), ("",), (None,)], "text string")
    parsed = df.select(receipts.date_of(F.col("text")).alias("date"), receipts._local_items(F.col("text")).alias("items"))
    shown = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("regexp_extract(text#") == 3 and shown.count("regexp_extract_all(text#") == 1
    rows = parsed.collect()
    assert [str(r.date) for r in rows] == ["2025-01-20", "None", "None"]
    assert [r["items"] and [tuple(i) for i in r["items"]] for r in rows] == [[("Pen", 2, 3.5)], [], None]
