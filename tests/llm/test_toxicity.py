"""Held-out accuracy, unseen misspellings, and the cases of the docstring."""

import os

import pytest
from pyspark.sql import functions as F

from spendspark.llm import toxicity
from spendspark.llm.frames import read

DATA = "/root/testdata/sf0.1"

CLEAN = "the weather is fine and the river runs down to the sea where boats lie in the sun".split()


def sentences(n, bad=None):
    out = []
    for i in range(n):
        words = [CLEAN[(i * 7 + k * 3) % len(CLEAN)] for k in range(20)]
        if bad:
            words[i % 20] = bad[i % len(bad)]
        out.append(" ".join(words))
    return out


def test_misspellings_and_long_texts():
    bad = ["idiotic", "worthless", "moronic", "disgusting"]
    texts = sentences(120) + sentences(120, bad)
    model = toxicity.fit(texts, [0] * 120 + [1] * 120)
    import pyarrow as pa

    asked = ["the sea is idiottic and fine", "boats are wortthless in the sun", " ".join(CLEAN * 200) + " disgussting " + " ".join(CLEAN * 200),
             "the boats lie in the sun", " ".join(CLEAN * 400)]
    found = model.scores(pa.array(asked, pa.string()))
    assert (found[:3] >= 0.5).all() and (found[3:] < 0.5).all(), found


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    labels = read(spark, DATA, "labels").select("doc_id", "toxic")
    rows = toxicity.report(read(spark, DATA, "documents"), labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.toxic == r.predicted for r in rows) / len(rows)
    toxic = [r for r in rows if r.toxic == 1]
    caught = sum(r.predicted for r in toxic) / len(toxic)
    assert right > 0.95 and caught > 0.8, (right, caught)


def test_cases(spark):
    rows = [(1, "a b", 1), (1, "a b", 1), (2, None, 1), (3, "", 1), (None, "?!", 1), (4, "so fine", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 6
    assert toxicity.report(docs.limit(0), labels.limit(0)).collect() == []
    model = toxicity.train(spark.createDataFrame([(5, "x y")], "doc_id long, text string"), spark.createDataFrame([(5, 1)], "doc_id long, toxic int"))
    scored = toxicity.score(docs.withColumn("s", F.lit(1)), model, column="s").collect()
    assert {r.doc_id: r.s for r in scored if r.doc_id in (2, 3, 4)} == {2: 0.0, 3: 0.0, 4: 1.0}
