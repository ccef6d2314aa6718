"""Held-out accuracy, Viterbi against a plain one, mixed texts, and the cases of the docstring."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendspark.llm import language_id as L
from spendspark.llm.frames import prepare, read

DATA = "/root/testdata/sf0.1"

TEXTS = {
    "en": "the river runs down to the sea and the boats lie in the sun while the children play with their friends",
    "de": "der fluss läuft hinab zum meer und die boote liegen in der sonne während die kinder mit ihren freunden spielen",
    "el": "το ποτάμι κυλά προς τη θάλασσα και οι βάρκες είναι στον ήλιο ενώ τα παιδιά παίζουν με τους φίλους τους",
    "ru": "река течёт вниз к морю и лодки лежат на солнце пока дети играют со своими друзьями",
}


def rows(n=40):
    out = []
    for k in range(n):
        for lang, text in TEXTS.items():
            words = text.split()
            out.append((len(out), " ".join(words[(k + 3 * i) % len(words)] for i in range(12)), lang))
    return out


@pytest.fixture(scope="module")
def model(spark):
    prepare(spark)
    return L.train(spark.createDataFrame(rows(), "doc_id long, text string, lang string"), F.lit(True))


def plain_path(scores, switch):
    """Viterbi step by step."""
    n, k = scores.shape
    value, back = scores[0].astype(np.float64), []
    for t in range(1, n):
        step = value[:, None] - switch * (1 - np.eye(k))
        back.append(step.argmax(0))
        value = step.max(0) + scores[t]
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1]), value.max()


def test_best_path_equals_a_plain_one():
    rng = np.random.default_rng(3)
    for sizes in ([0, 1, 5, 127, 128, 129, 700, 0, 2], [1000], [3] * 50):
        edges = np.append(0, np.cumsum(sizes))
        for labels in (1, 2, 5):
            scores = rng.normal(0, 2, (edges[-1], labels)).astype(np.float32)
            found = L.best_path(scores, edges, 3.0)
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a:
                    path, value = plain_path(scores[a:b], 3.0)
                    own = scores[a:b][np.arange(b - a), found[a:b]].sum() - 3.0 * (np.diff(found[a:b]) != 0).sum()
                    assert own == pytest.approx(value, abs=1e-2)
                    assert (path == found[a:b]).mean() > 0.98


def test_scripts_and_mixed_spans(spark, model):
    mixed = " ".join([TEXTS["en"], TEXTS["de"], TEXTS["ru"]])
    docs = spark.createDataFrame([(1, mixed, "x"), (2, TEXTS["el"].upper(), "y")], "doc_id long, text string, spans string")
    found = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    spans = found[1]["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    n = [len(TEXTS[k].split()) for k in ("en", "de", "ru")]
    assert spans[0]["first"] == 0 and spans[-1]["end"] == sum(n) and [s["first"] for s in spans[1:]] == [s["end"] for s in spans[:-1]]
    assert abs(spans[0]["end"] - n[0]) <= 2 and spans[1]["end"] == n[0] + n[1]
    assert found[2]["lang_pred"] == "el" and found[2]["score"] == 1.0
    # a script rules languages out
    allowed = dict(zip(L.SCRIPTS, model.allowed[1:]))
    assert allowed["cyrillic"].tolist() == [k == "ru" for k in model.langs]
    assert allowed["latin"].tolist() == [k in ("en", "de") for k in model.langs] and allowed["han"].all()


def test_cases(spark, model):
    long = TEXTS["de"] + " " + (TEXTS["en"] + " ") * 20_000
    given = [(1, None), (2, ""), (3, "12 34 !!"), (4, "—…"), (5, long), (None, TEXTS["ru"]), (None, TEXTS["ru"]), (7, "漢字"), (8, "été")]
    docs = spark.createDataFrame([(i, t, 1.5, "z") for i, t in given], "doc_id long, text string, score double, `a.b` string")
    out = L.identify(docs, model, spans=None)
    assert out.columns == ["doc_id", "text", "a.b", "lang_pred", "score"]
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in out.collect()]
    by_id = {r[0]: r for r in found}
    assert all(by_id[i][1:] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert by_id[5][1] == "en" and 0.99 < by_id[5][2] < 1
    assert found.count((None, "ru", 1.0)) == 2
    assert by_id[7][1] in model.langs and by_id[8][1] in model.langs
    assert L.identify(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "text", None), (None, "text", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    model = L.train(docs, F.lit(True))
    assert model.langs == []
    assert {(r["lang_pred"], r["score"], len(r["spans"])) for r in L.identify(docs, model).collect()} == {("und", 0.0, 0)}
    one = L.train(spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string"), F.lit(True))
    assert [r["lang_pred"] for r in L.identify(docs, one).orderBy("doc_id").collect()] == ["en", "en", "und"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = read(spark, DATA, "documents")
    found = L.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 2000 and right / n > 0.995
