"""Versioned tables against a dictionary that is told the same changes: compaction, repeats, lost jobs, bounds."""

import os
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spendspark.streaming import jobs
from spendspark.streaming.state import VersionedTable
from tests import seed

KIND = "id long, v long"


@pytest.fixture()
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def table(spark, folder, every=4):
    kind = spark.createDataFrame([], KIND).schema
    return VersionedTable(spark, folder + "/t", kind, ["id"], F.pmod("id", F.lit(5)), every)


def rows(spark, found):
    return spark.createDataFrame([tuple(r) for r in found], KIND)


def held(df):
    return {r["id"]: r["v"] for r in df.collect()}


def folders(folder):
    return [f"{at}/{d}" for at, dirs, _ in os.walk(folder) for d in dirs if d.startswith("bucket=")]


def test_equals_a_dictionary_and_stays_small(spark, folder, few_tasks):
    random.seed(2)
    t, every = table(spark, folder), 4
    told = {i: 0 for i in range(20)}
    t.begin(rows(spark, told.items()))
    t.begin(rows(spark, [(99, 9)]))  # only the first one counts
    for batch in range(26):
        # some buckets rest for long, one loses all its rows
        ids = [i for i in range(30) if i % 5 != 4 or batch in (3, 17)]
        new = {i: batch for i in random.sample(ids, 4)}
        gone = set(random.sample([i for i in told if i not in new], 3)) if batch % 3 == 0 else set()
        if batch == 9:
            gone = {i for i in told if i % 5 == 2} - set(new)
        before = dict(told)
        dead = rows(spark, [(i, told[i]) for i in gone]) if gone else None
        told = {i: v for i, v in {**told, **new}.items() if i not in gone}
        t.put(rows(spark, new.items()), batch, gone=dead)
        t.after(batch)
        if batch % 5 == 0 or batch % every == every - 1:
            # the batch once more, as after a lost driver: the state before it is still there
            assert held(t.read(batch)) == before
            t.put(rows(spark, new.items()), batch, gone=dead)
            t.after(batch)
            assert held(t.read()) == told
        assert len(folders(folder)) <= 5 * (2 + 2 * every)
    assert held(t.read()) == told and held(table(spark, folder).read()) == told
    assert held(t.read(buckets=["1", "3"])) == {i: v for i, v in told.items() if i % 5 in (1, 3)}
    assert all("/bucket=1" in p or "/bucket=3" in p for p in t.paths(buckets=["1", "3"]))


def test_jobs_lost_half_way(spark, folder, few_tasks):
    t = table(spark, folder)
    t.begin(rows(spark, [(1, 0), (2, 0)]))
    for batch in range(3):
        t.put(rows(spark, [(1, batch)]), batch)
    t.compact(3)
    # a snapshot and a tail folder that were never finished
    shutil.copytree(f"{folder}/t/snapshot/upto=3", f"{folder}/t/snapshot/upto=9")
    shutil.copytree(f"{folder}/t/tail/batch=2", f"{folder}/t/tail/batch=7")
    os.remove(f"{folder}/t/snapshot/upto=9/_SUCCESS")
    os.remove(f"{folder}/t/tail/batch=7/_SUCCESS")
    assert held(t.read()) == {1: 2, 2: 0}
    t.put(rows(spark, [(1, 7)]), 7)
    assert held(t.read()) == {1: 7, 2: 0}
    # between the snapshot and the removal of what it replaces
    kept = [shutil.copytree(f"{folder}/t/tail/batch={n}", f"{folder}/kept{n}") for n in (0, 1, 2)]
    t.compact(8)
    for n, path in enumerate(kept):
        if not os.path.exists(f"{folder}/t/tail/batch={n}"):
            shutil.copytree(path, f"{folder}/t/tail/batch={n}")
    assert held(t.read()) == {1: 7, 2: 0}


def test_expired_rows_go_at_the_second_snapshot(spark, folder, few_tasks):
    t = table(spark, folder)
    old = F.col("v") < 100
    t.begin(rows(spark, []))
    t.put(rows(spark, [(1, 1), (6, 500)]), 0)
    t.compact(1, old)
    assert held(t.read()) == {1: 1, 6: 500}
    t.put(rows(spark, [(11, 600)]), 1)
    t.compact(2, old)
    assert held(t.read()) == {6: 500, 11: 600}


def test_a_batch_reads_the_buckets_it_touches(spark, folder, few_tasks, monkeypatch):
    job = jobs.ActionStream(seed.expenses(spark), seed.users(spark), folder + "/state", buckets=8)
    job.current()
    opened = []
    plain = VersionedTable._newest
    monkeypatch.setattr(VersionedTable, "_newest", lambda self, paths: (opened.extend(paths), plain(self, paths))[1])
    actions = seed.actions(spark, [(1, "e6", "u4", "comment", "hello")])
    job.apply(actions, 0)
    own = job.state.buckets_of(actions.select(F.col("expense_id").alias("id")))
    assert len(own) == 1 and [p for p in opened if "/expenses/" in p] and all(
        p.endswith(f"/bucket={own[0]}") for p in opened if "/expenses/" in p or "/seen/" in p)


def test_deleted_and_created_anew(spark, folder, few_tasks):
    job = jobs.ActionStream(seed.expenses(spark), seed.users(spark), folder + "/state", buckets=4, every=2)
    kind = spark.createDataFrame([], "action_id long, expense_id string, user_id string, comment string, is_internal boolean, "
                                     "created_at timestamp").schema
    job.apply(seed.actions(spark, [(1, "e6", "u4", "comment", "first life")]), 0)
    job.apply(seed.actions(spark, [(2, "e6", "u4", "delete", None)]), 1)
    assert job.current().filter("id = 'e6'").count() == 0 and job.output("comments", kind).count() == 0
    fields = ["title", "amount", "expense_date", "category"]
    again = seed.actions(spark, [(3, "e6", "u4", "create", None)]).withColumns(
        {c: F.lit(v) for c, v in zip(fields, ["Taxi", "12.50", "2025-01-02", "travel"])})
    job.apply(again, 2)
    job.apply(seed.actions(spark, [(4, "e6", "u4", "comment", "second life")]), 3)
    assert [r["status"] for r in job.current().filter("id = 'e6'").collect()] == ["draft"]
    assert [r["comment"] for r in job.output("comments", kind).collect()] == ["second life"]


def test_actions_behind_the_horizon_are_refused(spark, folder, few_tasks):
    at = datetime(2025, 3, 1, 12)

    def action(number, days, delivered):
        rows = [(number, "e6", "u4", "comment", "note", at + timedelta(days=days))]
        return spark.createDataFrame(rows, "action_id long, expense_id string, actor_id string, action string, notes string, ts timestamp")

    job = jobs.ActionStream(seed.expenses(spark), seed.users(spark), folder + "/state", buckets=2, every=2, horizon_days=10)
    kind = spark.createDataFrame([], "action_id long, expense_id string, actor_id string, action string, ts timestamp, reason string").schema
    for batch, (number, days) in enumerate([(1, 0), (2, 5), (3, 40), (4, 41), (5, 42), (6, 43), (1, 0), (6, 43)]):
        job.apply(action(number, days, batch), batch)
    assert [(r["action_id"], r["reason"]) for r in job.output("rejected", kind).collect()] == [(1, jobs.TOO_LATE)]
    seen = [r[0] for r in VersionedTable(spark, folder + "/state/seen", spark.createDataFrame(
        [], "action_id long, expense_id string, ts timestamp").schema, ["action_id"], F.lit("0"), 2).read().collect()]
    assert sorted(seen) == [3, 4, 5, 6]


def test_latest_table_keeps_few_folders(spark, folder, few_tasks):
    kind = spark.createDataFrame([], "day date, client long, n long").schema
    t = jobs.latest_table(spark, kind, ["day", "client"], folder + "/latest", bucket=F.col("day"), every=3)
    told = {}
    for batch in range(20):
        day = datetime(2024, 1, 1 + batch // 7).date()
        new = {(day, c): batch for c in (batch % 3, 5)}
        told |= new
        t.put(spark.createDataFrame([(d, c, n) for (d, c), n in new.items()], kind), batch)
        t.after(batch)
    assert {(r["day"], r["client"]): r["n"] for r in t.read().collect()} == told
    # three days, and no more folders than two snapshots and two rounds of batches of each
    assert len(folders(folder)) <= 3 * (2 + 2 * 3)


def test_a_snapshot_alone_is_read_without_a_shuffle(spark, folder, few_tasks):
    t = table(spark, folder)
    t.begin(rows(spark, [(i, 0) for i in range(50)]))
    read = t.read()
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    assert held(read) == dict.fromkeys(range(50), 0)


def test_only_rows_that_may_have_changed_meet(spark, folder, few_tasks):
    t, met = table(spark, folder), []
    t.begin(rows(spark, [(i, 0) for i in range(1000)]))
    t.put(rows(spark, [(1, 1), (2000, 1)]), 0, gone=rows(spark, [(7, 0)]))
    last = t._last
    t._last = lambda found, *within: met.append(found.count()) or last(found, *within)
    assert held(t.read()) == {i: 0 for i in range(1000) if i != 7} | {1: 1, 2000: 1}
    keys = spark.createDataFrame([(1,), (3,), (7,), (5000,)], "id long")
    assert {k: v for k, v in held(t.read(keys=keys)).items() if k in (1, 3, 7, 5000)} == {1: 1, 3: 0}
    # the rows of 1 and 7 in the snapshot and three in the tail
    assert all(n <= 10 for n in met)


def test_marks_that_are_full_leave_nothing_out(spark, folder, few_tasks, monkeypatch):
    from spendspark.streaming import state

    monkeypatch.setattr(state, "MARK_WORDS", 1)
    t = table(spark, folder)
    t.begin(rows(spark, [(i, 0) for i in range(500)]))
    t.put(rows(spark, [(i, 1) for i in range(0, 400, 2)]), 0, gone=rows(spark, [(1, 0)]))
    told = {i: int(i < 400 and i % 2 == 0) for i in range(500) if i != 1}
    assert held(t.read()) == told
    t.compact(1)
    assert held(t.read()) == told


def test_the_first_snapshot_has_one_row_of_a_key(spark, folder, few_tasks):
    t = table(spark, folder)
    t.begin(rows(spark, [(1, 5), (1, 5), (None, 3), (None, 3), (2, 1)]))
    assert sorted(map(tuple, t.read().collect()), key=str) == [(1, 5), (2, 1), (None, 3)]
    t.put(rows(spark, [(None, 4)]), 0)
    assert sorted(map(tuple, t.read().collect()), key=str) == [(1, 5), (2, 1), (None, 4)]
