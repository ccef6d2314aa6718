"""Runs against brute force over all periods, planted repeats against SQL, and the cases of the docstring."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spendspark.llm import periodic_runs as P
from spendspark.llm.frames import prepare


def brute(words):
    n, out = len(words), set()
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(24, 3 * p):
                run = words[i:i + length]
                if not any(run[q:] == run[:-q] for q in range(1, p)):
                    out.add((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_in(texts):
    edges = np.append(0, np.cumsum([len(t) for t in texts]))
    runs, counts = P.find_runs(np.array([w for t in texts for w in t], np.int64), edges)
    parts = np.split(runs, np.cumsum(counts)[:-1])
    return [[tuple(r) for r in part.tolist()] for part in parts]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


blocks = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.integers(1, 9)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(blocks, min_size=1, max_size=4))
def test_equals_brute_force(texts):
    words = [[w for unit, times in text for w in unit * times][:300] for text in texts]
    assert found_in(words) == [brute(t) for t in words]


def test_structured_texts():
    thue = [bin(i).count("1") % 2 for i in range(400)]
    nested = (([0] * 9 + [1]) * 4 + [2]) * 5
    rare = [i % 97 for i in range(700)]
    texts = [fibonacci(400), thue, nested, rare, [1] * 30, [1] * 23, [], list(range(100))]
    assert found_in(texts) == [brute(t) for t in texts]


def test_equal_hashes_change_nothing(monkeypatch):
    """With every hash equal the proposals are useless, but what is reported is still a run."""
    monkeypatch.setattr(P, "mix", lambda h: h % np.uint64(2))
    texts = [fibonacci(200), (list(range(7)) * 9), list(range(50))]
    for found, text in zip(found_in(texts), texts):
        assert set(found) <= set(brute(text))


def changed(words, number):
    h = zlib.crc32(str(number).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_report_against_brute_force(spark):
    prepare(spark)
    rng = np.random.default_rng(5)
    docs = [(int(i), " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 120)))) for i in range(200)]
    docs += [(1000, "\t a  a\n" * 30 + "  b"), (1001, None), (1002, ""), (None, "x y " * 20), (None, "x y " * 20)]
    got = {r["doc_id"]: r for r in P.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    planted = 0
    for number, text in docs:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        if number is not None:
            planted += words != changed(words, number)
            words = changed(words, number)
        runs, r = brute(words), got[number]
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        rest = " ".join(w for i, w in enumerate(words) if i not in drop)
        assert r["collapsed_sha256"] == hashlib.sha256(rest.encode()).hexdigest()
        if runs:
            from fractions import Fraction
            best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
    assert planted > 5


def test_cases(spark):
    prepare(spark)
    long = "a b c " * 100_000 + "end"
    docs = spark.createDataFrame([(1, long, "k", 1), (1, long, "k", 1), (2, None, None, None)], "doc_id long, text string, `a.b` string, runs int")
    out = P.with_runs(docs)
    assert out.columns == ["doc_id", "text", "a.b", "runs", "collapsed"]
    rows = out.orderBy("doc_id").collect()
    assert [[tuple(x) for x in r["runs"]] for r in rows] == [[(0, 300_000, 3)]] * 2 + [[]]
    assert [r["collapsed"] for r in rows] == ["a b c end", "a b c end", ""]
    assert P.with_runs(docs.limit(0)).count() == 0


def test_memory_follows_the_group():
    words = np.random.default_rng(1).integers(0, 5, 200_000)
    assert P.lowest(np.array([3, 1, 2, 5, 4]), 2).tolist() == [1, 1, 2]
    runs, _ = P.find_runs(words, np.array([0, 200_000]))
    assert all(words[s:s + n - q].tolist() == words[s + q:s + n].tolist() for s, n, q in runs.tolist())
    assert pa.array([]).null_count == 0
