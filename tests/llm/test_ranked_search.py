"""Rankings against a plain computation, with small units and blocks, and the cases of the docstring."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from spendspark.llm import ranked_search as R
from spendspark.llm.frames import prepare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        scored.sort()
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=20, units=(1 << 20, 1 << 13), blocks=(512, 100_000)):
    prepare(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id string, text string")
    found = R.search(R.build(d, unit_words=units[0], unit_docs=units[1]), q, k, block_queries=blocks[0], block_terms=blocks[1])
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in found.collect()], key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    vocabulary = [f"t{i}" for i in range(60)] + ["É", "naïve", "x1"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    docs = [(i, draw(int(rng.choice([0, 1, 3, 3, 3, 20, 60])))) for i in range(400)]
    docs += [(500 + i, docs[7][1] or "t1 t2") for i in range(150)]  # copies
    docs += [(700, None), (701, ""), (702, "!! --"), (703, "T1, t1_T1"), (704, "t2 " * 3000 + "t40")]
    items = [(f"q{i}", draw(int(rng.integers(1, 25)))) for i in range(15)] + [("q1", "t1"), ("none", "unheard of"), ("null", None), ("rep", "t3 t3 T4-t3")]
    return docs, items


@pytest.mark.parametrize("k,units,blocks", [(20, (1 << 20, 1 << 13), (512, 100_000)), (3, (200, 16), (4, 30)), (1000, (500, 1000), (512, 100_000))])
def test_equals_plain_ranking(spark, corpus, k, units, blocks):
    docs, items = corpus
    assert ranked(spark, docs, items, k, units, blocks) == plain(docs, items, k)


def test_cases(spark):
    docs = [(5, "a b"), (3, "a b"), (None, "a b"), (3, "a b"), (9, "c")]
    items = [("i", "a"), ("i", "a"), (None, "c")]
    assert ranked(spark, docs, items, 3) == plain(docs, items, 3)
    assert [r[2] for r in sorted(ranked(spark, docs, items[:1]), key=lambda r: r[1])] == [3, 3, 5, None]
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None)], items) == []


def test_other_columns_and_names(spark):
    prepare(spark)
    docs = spark.createDataFrame([("x", "a b", 1, 2)], "`my.id` string, body string, term int, m int")
    items = spark.createDataFrame([(1, "b", 3)], "item_id int, text string, score int")
    assert [tuple(r) for r in R.search(R.build(docs, "my.id", "body"), items).collect()] == [(1, 1, "x", 287 * (10**9 // (1000 + 1200)))]


def test_index_holds_every_posting_once(spark, corpus):
    docs, _ = corpus
    prepare(spark)
    index = R.build(spark.createDataFrame(docs, "doc_id long, text string"), unit_words=300, unit_docs=20)
    rows = index.postings.collect()
    ids = {(r["m"], r["unit"]): r["ids"] for r in rows if r["term"] is None}
    got = sorted((ids[r["m"], r["unit"]][p], r["term"], r["tf"]) for r in rows if r["term"] is not None for p in r["places"])
    assert got == sorted((i, t, n) for i, text in docs for t, n in Counter(terms(text)).items())
    assert max(len(x) for x in ids.values()) <= 60
