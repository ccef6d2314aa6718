"""Hits against a brute-force comparison of all windows."""

import random
import re

from pyspark.sql import functions as F

from spendspark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        sequence = words(item_text)
        size = min(window, len(sequence))
        windows = {tuple(sequence[i:i + size]) for i in range(len(sequence) - size + 1)} if size else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


def sample():
    random.seed(5)
    vocabulary = ["a", "B", "é", "c1", "dd", "E", "x"]
    draw = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, draw(random.choice([1, 3, 12, 13, 14, 30]) if i > 3 else 20)) for i in range(12)]
    items += [(20, items[2][1]), (21, None), (22, " .,"), (2, items[2][1])]
    docs = [(i, draw(random.randrange(60)) + random.choice([" ", ", ", "\n"]) + random.choice(items)[1:][0].__str__()
             + " " + draw(random.randrange(30))) for i in range(80)]
    return [*docs, (90, None), (91, ""), (92, ".."), (93, docs[0][1]), (93, docs[0][1]), (None, docs[1][1])], items


def test_hits_equal_brute_force(spark):
    docs, items = sample()
    long_items = [(i, t) for i, t in items if t is None or len(words(t)) != 1]  # a one-word item hits nearly everything
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    for chosen in (items, long_items):
        bench = spark.createDataFrame(chosen, "item_id long, text string")
        for block_words in (10**6, 40):
            got = decontaminate.mark(table, bench, block_words=block_words).collect()
            assert len(got) == len(docs)
            for row in got:
                assert (row.n_words, row.n_hit, row.hit_items) == brute(row.text, chosen), row


def test_remove_and_reject(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    clean = "nothing to see here"
    docs = spark.createDataFrame(
        [(1, f"start, {passage}. the end"), (2, clean), (3, passage.upper()), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut == {1: "start, the end", 2: clean, 3: "", 4: None}
    assert sorted(r.doc_id for r in decontaminate.reject(docs, bench).collect()) == [2, 4]


def test_coverage_limit(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    rows = [(1, passage + " z" * 247), (2, passage + " z" * 248)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("b", passage)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_words, r.contaminated) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (13, 260, True), 2: (13, 261, False)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, bench).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.report(one, bench).collect()] == [(2, 0, False)]


def test_columns_of_the_user_stay(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, passage, 7, "mine", 1.5), (2, "clean", 8, "too", 2.5)],
                                 "doc_id long, text string, n_words int, hit_spans string, `a.b` double")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    for block_words in (10**6, 3):
        left = decontaminate.reject(docs, bench, block_words=block_words)
        assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "clean", 8, "too", 2.5)]
        rest = decontaminate.remove_spans(docs, bench, block_words=block_words)
        assert rest.columns == docs.columns and sorted(tuple(r) for r in rest.collect()) == [(1, "", 7, "mine", 1.5), (2, "clean", 8, "too", 2.5)]


def test_blocks_follow_the_bytes_of_the_items(spark):
    """However the words are parted, no block holds more of them than it may, but for one item or the spread of the hash."""
    items = spark.createDataFrame([(i, "\t".join(f"{i}x{k}" for k in range(50)) + ",;" * 40) for i in range(400)], "item_id long, text string")
    numbered, n = decontaminate.in_blocks(items, "item_id", "text", 2000)
    sizes = [sum(len(words(r["text"])) for r in rows) for rows in
             [numbered.filter(F.col("block") == k).collect() for k in range(n)]]
    assert sum(sizes) == 400 * 50 and n > 10 and max(sizes) <= 2000
