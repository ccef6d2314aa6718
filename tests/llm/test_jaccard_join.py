"""Components against brute force, with the star rounds forced and without."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendspark.llm import components as components_of
from spendspark.llm import jaccard_join
from spendspark.llm.components import components


def words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def shingles(text, n=5):
    own = words(text)
    return {tuple(own[i:i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def sample():
    random.seed(11)
    draw = lambda n: [random.choice("abcdefghijklmnopqrstuvwxyzé") + str(random.randrange(40)) for _ in range(n)]
    common = draw(30)
    rows = []
    for base in (draw(60) for _ in range(12)):
        for _ in range(8):
            copy = list(base)
            for _ in range(random.randrange(5)):
                copy[random.randrange(len(copy))] = draw(1)[0]
            rows.append(" ".join(copy + (common if random.random() < 0.3 else [])))
    chain = draw(80)
    for k in range(10):  # each a little further on: linked in a chain, not end to end
        rows.append(" ".join(chain[3 * k:3 * k + 50]))
    rows += [" ".join(common + draw(random.randrange(8))) for _ in range(40)]
    rows += ["", None, "one", "ONE", "one two", "a b c d", "a  b\tc\nd", "a b c d e", " ", "\x1c x"]
    rows += [rows[0]] * 5 + [rows[0].upper()]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, rows[5]), (None, "lonely text of five words"), (200, "y")]


@pytest.mark.parametrize("limit,heavy", [(4, 1 << 16), (0, 50)])
def test_components_equal_brute_force(spark, monkeypatch, limit, heavy):
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ENTRY", limit)
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    monkeypatch.setattr(jaccard_join, "PART", 3 if not limit else 10_000)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 2)
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).repartition(3)
    got = sorted(jaccard_join.report(docs).collect(), key=str)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted([tuple(r) for r in got], key=key) == sorted(brute(rows), key=key)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (2, text + " more"), (9, "other text that stands by itself here"), (7, None), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted(docs.filter("doc_id in (2, 9, 7) or doc_id is null").collect(), key=str)


def test_keep_first_leaves_one_row_of_each_group(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "wv")
    rows = [(5, text, "b"), (2, text + " more", "b"), (2, text + " more", "a"), (2, text + " more", "a"), (None, text, "c"), (2, text, "a"),
            (None, other, "y"), (None, other, "x"), (None, other + " more", "x"), (2, "unlike all of them it stands alone", "z"),
            (7, None, "n"), (8, "", "e"), (None, None, "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    of_text = [r for r in got if (r[1] or "").startswith("w")]
    of_other = [r for r in got if (r[1] or "").startswith("v")]
    assert of_text in ([(2, text + " more", "a")], [(2, text, "a")])
    assert of_other in ([(None, other, "x")], [(None, other + " more", "x")])
    assert [r for r in got if r not in of_text + of_other] == sorted(rows[9:], key=str)
    assert jaccard_join.keep_first(docs.limit(0)).collect() == []


def test_empty(spark):
    assert jaccard_join.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 3), (9, 8), (8, 9), (10, 9), (2, 3)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(3, 2), (4, 2), (5, 2), (9, 8), (10, 8)}
    assert components(links.limit(0)).collect() == []


def found_by_search(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {(x, find(x)) for x in root if find(x) != x}


@pytest.mark.parametrize("chunk", [40, 1 << 16])
def test_components_of_chunks(spark, monkeypatch, chunk):
    """Chains, circles and a hub over links that make many chunks, or one."""
    monkeypatch.setattr(components_of, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    names = rng.permutation(np.arange(-300, 300)).tolist()
    links = [*zip(names[:200], names[1:201], strict=True), *((names[300], x) for x in names[301:400]), (names[0], names[200])]
    links += [(names[i], names[j]) for i, j in rng.integers(400, 600, (120, 2)).tolist()]
    rng.shuffle(links)
    links = [(int(a), int(b)) for a, b in links]
    got = [tuple(r) for r in components(spark.createDataFrame(links, "a long, b long").repartition(6)).select("node", "root").collect()]
    assert len(got) == len(set(got)) and set(got) == found_by_search(links)


def test_few_links_take_few_jobs(spark):
    """Links of one chunk are counted and written once: alternating stars took a shuffle after another for a chain."""
    spark.sparkContext.setJobGroup("few links", "few links")
    try:
        links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert components(links).count() == 60
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 6


@pytest.mark.parametrize("at_once", [0, 1000])
def test_pairs_count_alike_in_turn_and_at_once(spark, at_once):
    rows = [(i, t) for i, t in sample() if t and i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, _ = jaccard_join.sets_and_counts(docs, "doc_id", "text", 5)
    node = {r["doc_id"]: r for r in sets.collect()}
    own = {i: shingles(t) for i, t in rows}
    every = [(i, j) for i in range(0, 100, 3) for j in range(i + 1, 100, 2) if node[i]["node"] != node[j]["node"]]
    pairs = spark.createDataFrame([(node[i]["node"], node[i]["size"], node[j]["node"], node[j]["size"]) for i, j in every],
                                  "a long, size_a int, b long, size_b int").distinct()
    heavy = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    got = {tuple(r) for r in jaccard_join.linked(pairs, docs, "text", 5, 75, heavy, at_once).collect()}
    assert got == {(node[i]["node"], node[j]["node"]) for i, j in every if 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j])}


def test_sketches_rule_out_no_link(spark):
    """Sets that differ in more and more shingles: no pair that links is left out, unrelated sets are."""
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for size in (1, 7, 60, 400, 5000):
        base = draw(size)
        sets = [np.concatenate([base[k:], draw(k)]) for k in range(0, size // 3 + 1, max(1, size // 40))] + [draw(size + 1), draw(size + 2)]
        sketches = spark.createDataFrame([(i, jaccard_join.sketch_of(s).tolist()) for i, s in enumerate(sets)], "node long, sketch array<long>")
        every = [(i, len(sets[i]), j, len(sets[j])) for i in range(len(sets)) for j in range(i + 1, len(sets))]
        pairs = spark.createDataFrame(every, "a long, size_a int, b long, size_b int")
        left = {(r["a"], r["b"]) for r in jaccard_join.could_link(pairs, sketches, 75).collect()}
        common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, _, j, _ in every}
        assert {(i, j) for i, n, j, m in every if 100 * common[i, j] >= 75 * (n + m - common[i, j])} <= left
        if 60 <= size <= 400:
            assert not any(j >= len(sets) - 2 for _, j in left)
