from datetime import datetime

from pyspark.sql import functions as F

from spendspark.operators import reports
from spendspark.operators.receipts import extract_receipt
from spendspark.streaming import jobs
from tests import seed


def source(spark, df, path):
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_action_stream_survives_repeats(spark, folder):
    job = jobs.ActionStream(seed.expenses(spark), seed.users(spark), folder + "/state")
    first = seed.actions(spark, [(1, "e6", "u4", "submit", None), (2, "e3", "u2", "approve", "fine")])
    second = seed.actions(spark, [(2, "e3", "u2", "approve", "fine"), (3, "e6", "u2", "reject", "why"), (4, "e3", "u1", "reimburse", None)])
    for batch in (first, second):
        job.run(source(spark, batch, folder + "/in"), folder + "/offsets")
    assert {k: v for k, v in seed.as_dict(job.current(), "id", "status").items() if k in ("e3", "e6")} == {
        "e3": "reimbursed", "e6": "rejected"}
    # the second batch once more, as after a lost acknowledgement
    job.apply(second, 1)
    assert job.current().count() == 9
    kind = spark.createDataFrame([], "action_id long, expense_id string, user_id string, action string, old_status string, "
                                     "new_status string, notes string, created_at timestamp").schema
    assert sorted(r["action_id"] for r in job.output("audit", kind).collect()) == [1, 2, 3, 4]


def test_a_later_delete_clears_earlier_output(spark, folder):
    job = jobs.ActionStream(seed.expenses(spark), seed.users(spark), folder + "/state")
    job.apply(seed.actions(spark, [(1, "e6", "u4", "comment", "hello")]), 0)
    job.apply(seed.actions(spark, [(2, "e6", "u4", "delete", None)]), 1)
    kind = spark.createDataFrame([], "action_id long, expense_id string, user_id string, comment string, is_internal boolean, "
                                     "created_at timestamp").schema
    assert job.output("comments", kind).count() == 0 and job.current().count() == 8


def test_receipt_files_as_a_stream(spark, folder):
    import os

    os.makedirs(folder + "/in")
    for n in range(3):
        with open(f"{folder}/in/{n}.txt", "w") as f:
            f.write(f"Shop {n}\nTotal: 1{n},50\n2025-01-1{n}\n")
    parsed = jobs.stream_receipts(jobs.receipt_stream(spark, folder + "/in")).select("file", "parsed.vendor", "parsed.amount")
    jobs.write_stream(parsed, folder + "/out", folder + "/offsets")
    assert seed.as_dict(spark.read.parquet(folder + "/out"), "file", "amount") == {"0.txt": 10.5, "1.txt": 11.5, "2.txt": 12.5}


def test_daily_trend_equals_its_batch_twin(spark, claims, folder):
    stream = source(spark, claims.expenses, folder + "/in")
    kept = jobs.keep_latest(jobs.stream_daily_trend(stream), ["date"], folder + "/out", folder + "/offsets")
    twin = reports.daily_trend(claims.expenses, "2001-08-02 00:00:00", days=4000)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, twin.collect()))


def test_late_rows_are_dropped_and_counted(spark, folder):
    def rows(*days):
        return spark.createDataFrame([(datetime(2024, 1, d), 1) for d in days], "created_at timestamp, amount int")

    daily = lambda df: jobs.stream_daily_trend(source(spark, df, folder + "/in"))
    jobs.keep_latest(daily(rows(1, 20)), ["date"], folder + "/out", folder + "/offsets")
    jobs.keep_latest(daily(rows(21)), ["date"], folder + "/out", folder + "/offsets")
    dropped = []
    stream = daily(rows(2, 21))
    query = jobs.run_available(stream, folder + "/offsets", "update", lambda df, n: dropped.append(df.count()))
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert late == 1


def test_rate_limit(spark, folder):
    events = spark.range(200).select(
        F.when(F.col("id") < 120, "a").otherwise("b").alias("user_id"),
        (F.lit(datetime(2024, 1, 1)).cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, id * 7)")).alias("ts"))
    batch = jobs.rate_limit_breaches(events, 100)
    assert [(r["client"], r["requests"]) for r in batch.collect()] == [("a", 120)]
    kept = jobs.keep_latest(jobs.rate_limit_counts(source(spark, events, folder + "/in")), ["window_start", "window_end", "client"],
                            folder + "/out", folder + "/offsets")
    assert kept.filter("requests > 100").count() == 1


def test_receipt_stream_equals_batch(spark, claims, folder):
    flat = ["expense_id", "parsed.vendor", "parsed.amount", "parsed.date"]
    stream = jobs.stream_receipts(source(spark, claims.receipts, folder + "/in")).select(*flat)
    jobs.write_stream(stream, folder + "/out", folder + "/offsets")
    got = spark.read.parquet(folder + "/out")
    twin = extract_receipt(claims.receipts).select(*flat)
    assert got.exceptAll(twin).count() == 0 and got.count() == twin.count()
